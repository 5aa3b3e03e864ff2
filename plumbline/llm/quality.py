"""Quality classifier: hashed word n-gram logistic regression.

Features are counts of single words, word pairs and runs of three word shapes (letters, digits or
symbols, capitals, length), hashed into one fixed space, damped by a logarithm and scaled to length
one. The model is trained with follow-the-regularised-leader updates, one document at a time, on a
bounded sample of labelled documents; scoring is a sparse dot product per document, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ROW, field, packed, text_or_empty, unpacked
from plumbline.llm.hashing import FINE, WordHasher, draws, mix, text_slices
from plumbline.llm.streams import binary, bounds

FEATURES = 1 << 18
TRAINING_ROWS = 12_000
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Leader:
    """Settings of the follow-the-regularised-leader updates."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1
    epochs: int = 4


def held_out(id_col: Column) -> Column:
    """Is the row kept from training: crc32 of the id as text, divisible by five."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of every text, in order; place 0 is the constant."""
    words, owner, shapes = hasher.shaped(data, offsets)
    seeds = draws(7, 8)
    symbol = (shapes >> 8) == 3
    shapes = np.where(symbol, (words & np.uint64(0xFFFF)).astype(np.int64) | 1 << 20, shapes).astype(np.uint64)
    kinds, owners = [mix(words ^ seeds[0])], [owner]
    kinds.append(mix(words[:-1] * seeds[1] + words[1:] * seeds[2]))
    owners.append(np.where(owner[:-1] == owner[1:], owner[1:], -1))
    kinds.append(mix(shapes[:-2] * seeds[3] + shapes[1:-1] * seeds[4] + shapes[2:] * seeds[5]))
    owners.append(np.where(owner[:-2] == owner[2:], owner[2:], -1))
    places = [k % np.uint64(FEATURES - 1) + np.uint64(1) for k in kinds]
    at = [np.searchsorted(owner, np.arange(len(offsets)))] * 3
    for text in range(len(offsets) - 1):
        lo, hi = at[0][text], at[0][text + 1]
        if lo == hi:
            yield np.zeros(1, np.int64), np.ones(1)
            continue
        one = np.concatenate([places[0][lo:hi], places[1][lo : max(lo, hi - 1)], places[2][lo : max(lo, hi - 2)]])
        one.sort()
        cut = bounds(one)
        values = np.log1p(np.diff(cut))
        values /= np.sqrt(values @ values)
        yield np.r_[0, one[cut[:-1]].astype(np.int64)], np.r_[1.0, values]


def train(rows: Iterator[tuple[float, np.ndarray, np.ndarray]], settings: Leader) -> np.ndarray:
    """Weights after the rows, in their order, as often as the settings say."""
    rows = list(rows)
    lead, seen = np.zeros(FEATURES), np.zeros(FEATURES)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * settings.l1 - z) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)
        return np.where(np.abs(z) > settings.l1, w, 0.0)

    for _ in range(settings.epochs):
        for label, places, values in rows:
            z, n = lead[places], seen[places]
            w = weights(z, n)
            gradient = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            squares = gradient * gradient
            lead[places] = z + gradient - (np.sqrt(n + squares) - np.sqrt(n)) / settings.alpha * w
            seen[places] = n + squares
    return weights(lead, seen)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    training_rows: int = TRAINING_ROWS,
    settings: Leader = Leader(),
) -> np.ndarray:
    """Weights learnt from at most ``training_rows`` labelled documents.

    Documents whose id is held out never train. The sample is the labelled ids with the smallest
    hashes, so it does not depend on the order or layout of the tables. Rows with a null id or label are
    no examples. Without any example all weights are 0. The sample's ids are broadcast: their number is
    the bound.
    """
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(training_rows)
    )
    texts = packed(docs).select(field(id_col).alias("id"), text_or_empty(field(text)).alias("norm"))
    rows = texts.join(F.broadcast(sample), "id").select(
        F.xxhash64("id", "norm").alias("turn"), "y", "norm"
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(FINE)
        for batch in batches:
            places, values = [], []
            for _, data, offsets in text_slices(batch.column("norm")):
                for p, v in features(data, offsets, hasher):
                    places.append(p.astype(np.int32).tobytes())
                    values.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("y"), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
                ["turn", "y", "places", "features"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
            for batch in batches:
                for i, y in enumerate(batch.column("y").to_pylist()):
                    yield (
                        y,
                        np.frombuffer(binary(batch.column("places"), i), np.int32).copy(),
                        np.frombuffer(binary(batch.column("features"), i), np.float32).copy(),
                    )

        model = train(examples(), settings)
        used = np.flatnonzero(model)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(model[used])], ["place", "weight"])

    described = rows.mapInArrow(describe, "turn bigint, y double, places binary, features binary")
    # one task learns, from the bounded sample only; repeated documents are bounded with it
    one = described.repartition(1).sortWithinPartitions("turn", "y", "places")
    model = np.zeros(FEATURES)
    for row in one.mapInArrow(learn, "place bigint, weight double").toLocalIterator():
        model[row["place"]] = row["weight"]
    return model


def _scored(rows: DataFrame, weights: np.ndarray, text: str) -> DataFrame:
    """Packed rows with ``score``; the text is read out of the row, so it moves once."""
    model = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = WordHasher(FINE), model.value
        for batch in batches:
            texts = pc.struct_field(batch.column(0), text)
            sums = np.array([w[p] @ v for _, data, offsets in text_slices(texts) for p, v in features(data, offsets, hasher)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-sums)), pa.float64())], [ROW, "score"]
            )

    return rows.mapInArrow(run, rows.select(ROW).schema.add("score", "double"))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Every input row with ``score``, from 0 to 1: the chance that its label is 1.

    Only the text is read. Null and empty texts get the score of the constant alone. Nothing is
    shuffled; repeated rows stay. An input column ``score`` is kept as ``score_in``.
    """
    done = _scored(packed(docs), weights, text)
    return done.select(*unpacked(done, docs.columns, ["score"]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows whose score reaches the threshold, with their columns."""
    weights = fit(docs, labels, **options)
    kept = _scored(packed(docs), weights, options.get("text", "text")).where(F.col("score") >= threshold)
    return kept.select(*unpacked(kept, docs.columns, []))
