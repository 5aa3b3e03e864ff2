"""Document fingerprints from improbable features.

Every run of 64 bytes of a text is a candidate. Its entropy says how usual it looks: the rarer an entropy
is among all documents, the better the candidate ranks. A candidate that ranks best among 64 neighbours
gets a vote; those with enough votes are the text's features. A text with
fewer than eight adds the best candidate of each of its eighths. Features are hashed into a chain of Bloom
filters, a new one after each 160 features. Two fingerprints are compared filter by filter, by the
bits they share beyond what chance would share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import field, packed, text_or_empty
from plumbline.llm.hashing import CHUNK_BYTES, draws, mix, utf8

WINDOW = 64
NEIGHBOURS = 64
VOTES = 16
FEWEST = 8
LEVELS = 1024
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
CHANCE_MARGIN = 0.1
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 16
LARGE_RANGE = 256 << 20
TASK_BYTES = 16 << 20

# f(c) - f(c - 1) for f(c) = c log2 c, in whole steps so that sums are exact
_STEPS = np.round(
    np.diff(np.r_[0.0, 0.0, np.arange(2, WINDOW + 1) * np.log2(np.arange(2, WINDOW + 1))], prepend=0.0) * 65536
).astype(np.int64)
_FULL = int(_STEPS.sum())
_PLACE = (1 << 40) - 1
_POWER_STEP = np.uint64(0xD1342543DE82EF95)
_POWER_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level, 0 to 1023, of the 64 bytes from every place on; the last 63 places have none."""
    size = len(data)
    if size < WINDOW:
        return np.empty(0, np.int64)
    order = np.argsort(data, kind="stable")
    spaced = data[order].astype(np.int64) * (size + 2 * WINDOW) + order
    index = np.arange(size)
    earliest = np.searchsorted(spaced, spaced - (WINDOW - 1))  # first equal byte within the window before
    back = index - earliest + 1
    ahead = np.cumsum(np.bincount(earliest, minlength=size)) - index  # equal bytes within the window after
    enters, leaves = np.empty(size, np.int64), np.empty(size, np.int64)
    enters[order] = _STEPS[back]
    leaves[order] = _STEPS[ahead]
    total = np.cumsum(enters)[WINDOW - 1 :]
    total[1:] -= np.cumsum(leaves[: size - WINDOW])
    return (_FULL - total) * (LEVELS - 1) // _FULL


def _level_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows of each level lie inside the texts; the same however texts are put together."""
    found = np.zeros(LEVELS, np.int64)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        start, end = int(offsets[lo]), int(offsets[hi])
        # a text beyond the chunk size goes in chunks that share all but one byte of a window
        for first in range(start, end, CHUNK_BYTES):
            part = data[first : min(end, first + CHUNK_BYTES + WINDOW - 1)]
            levels = entropy_levels(part)
            places = first + np.arange(len(levels))
            within = places + WINDOW <= offsets[np.searchsorted(offsets, places, "right")]
            found += np.bincount(levels[within], minlength=LEVELS)
        lo = hi
    return found


def rarity_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy level, rarest first, over every window inside every text.

    Only the 1,024 counts reach the driver. Levels that never occur come first; ties go by level. How the table is stored or
    dealt out makes no difference.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(LEVELS, np.int64)
        for batch in batches:
            found += _level_counts(*utf8(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(found)], ["level", "n"])

    texts = packed(docs).select(text_or_empty(field(text)).alias("norm"))
    counts = np.zeros(LEVELS, np.int64)
    for row in texts.mapInArrow(count, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return ranks


class Fingerprinter:
    """Fingerprints of many texts; ``ranks`` are those of :func:`rarity_ranks`."""

    def __init__(self, ranks: np.ndarray) -> None:
        self.ranks = ranks
        self.table = draws(11, 256)
        self._powers(CHUNK_BYTES)

    def _powers(self, size: int) -> None:
        step, back = np.full(size, _POWER_STEP, np.uint64), np.full(size, _POWER_BACK, np.uint64)
        step[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(step), np.cumprod(back)

    def many(self, data: np.ndarray, offsets: np.ndarray) -> list[str]:
        """One fingerprint per text: the number of features, a colon, the filters in hex."""
        out: list[str] = []
        lo = 0
        while lo < len(offsets) - 1:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
            bounds = offsets[lo : hi + 1] - offsets[lo]
            out += self._chunk(data[offsets[lo] : offsets[hi]], bounds)
            lo = hi
        return out

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[str]:
        if len(data) > len(self.power):
            return [self._long(data)]
        places = self._features(data, offsets)
        running = np.r_[np.uint64(0), np.cumsum(self.table[data] * self.power[: len(data)])]
        owner = np.searchsorted(offsets, places, "right") - 1
        hashes = mix((running[places + WINDOW] - running[places]) * self.inverse[places])
        cut = np.searchsorted(owner, np.arange(len(offsets)))
        out = []
        for i in range(len(offsets) - 1):
            size = offsets[i + 1] - offsets[i]
            if 0 < size < WINDOW:
                lo, hi = offsets[i : i + 1], offsets[i + 1 : i + 2]
                out.append(_digest(mix((running[hi] - running[lo]) * self.inverse[lo])))
            else:
                out.append(_digest(hashes[cut[i] : cut[i + 1]]))
        return out

    def _long(self, data: np.ndarray) -> str:
        """A text beyond the chunk size, in overlapping chunks whose features are the same as in one piece."""
        span = CHUNK_BYTES - WINDOW - 2 * NEIGHBOURS
        count = len(data) - WINDOW + 1
        edges = np.r_[_eighths(count), count]
        found: dict[int, np.uint64] = {}
        fill: dict[int, tuple[int, int, np.uint64]] = {}  # the best (rank, place, hash) of each eighth so far
        for lo in range(0, count, span):
            # a place's votes come from neighbours on both sides: read those too, keep only own places
            first, hi = max(0, lo - NEIGHBOURS + 1), min(lo + span, count)
            part = data[first : lo + span + NEIGHBOURS - 1 + WINDOW - 1]
            best = self._ranked(part)
            places = self._voted(best, np.array([0, len(part)])) + first
            places = places[(places >= lo) & (places < hi)]
            own = np.searchsorted(edges, [lo, hi - 1], "right") - 1
            tops = [best[max(edges[e], lo) - first : min(edges[e + 1], hi) - first].min() for e in range(own[0], own[1] + 1)]
            at = np.r_[places - first, np.array(tops) & _PLACE].astype(np.int64)
            running = np.r_[np.uint64(0), np.cumsum(self.table[part] * self.power[: len(part)])]
            hashes = mix((running[at + WINDOW] - running[at]) * self.inverse[at])
            found.update(zip(places.tolist(), hashes, strict=False))
            for e, top, place, digest in zip(
                range(own[0], own[1] + 1), tops, at[len(places) :] + first, hashes[len(places) :], strict=True
            ):
                one = (int(top) >> 40, int(place), digest)
                fill[e] = min(fill.get(e, one), one)
        if len(found) < FEWEST:
            found.update((place, digest) for _, place, digest in fill.values())
        return _digest(np.array([found[place] for place in sorted(found)], np.uint64))

    def _ranked(self, data: np.ndarray) -> np.ndarray:
        """Rank and place of every window in one number; the leftmost of equal ranks is the smallest."""
        levels = entropy_levels(data)
        return (self.ranks[levels] << 40) | np.arange(len(levels))

    def _voted(self, best: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places with enough votes, in order."""
        count = len(best)
        last = offsets[1:] - WINDOW  # last window of each text
        width, lowest = 1, best
        while width < NEIGHBOURS and len(lowest) > width:
            lowest = np.minimum(lowest[:-width], lowest[width:])
            width *= 2
        votes = np.zeros(count, np.int64)
        if width == NEIGHBOURS:
            starts = np.arange(len(lowest))
            owner = np.searchsorted(offsets, starts, "right") - 1
            inside = starts + NEIGHBOURS - 1 <= last[owner]
            votes = np.bincount(lowest[inside] & _PLACE, minlength=count)
        return np.flatnonzero(votes >= VOTES)

    def _features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places of the chosen windows, in order; a sparse text gets the best of each eighth."""
        best = self._ranked(data)
        if not len(best):
            return np.empty(0, np.int64)
        places = self._voted(best, offsets)
        sizes = np.maximum(offsets[1:] - WINDOW - offsets[:-1] + 1, 0)
        cut = np.searchsorted(places, offsets)
        few = np.flatnonzero((sizes > 0) & (np.diff(cut) < FEWEST))
        if len(few):
            more = [places]
            for i in few:
                edges = offsets[i] + _eighths(sizes[i])
                more.append(np.minimum.reduceat(best[: offsets[i + 1] - WINDOW + 1], edges) & _PLACE)
            places = np.unique(np.concatenate(more))
        return places


def _eighths(count: int) -> np.ndarray:
    """Where the eighths of so many windows begin; fewer for less than eight windows."""
    return np.unique(np.arange(FEWEST) * count // FEWEST)


def _digest(hashes: np.ndarray) -> str:
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    filters = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), bool)
    chain = np.arange(len(hashes)) // FILTER_FEATURES
    for i in range(HASHES):
        filters[chain, (hashes >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)] = True
    return f"{len(hashes)}:{np.packbits(filters, axis=1).tobytes().hex()}"


def likeness(left: str, right: str) -> float:
    """From 0 to 1: how much of the shorter fingerprint the other holds beyond chance; 1 if equal.

    Two empty fingerprints are alike, an empty one is like no other.
    """
    if left == right:
        return 1.0
    (n, a), (m, b) = _filters(left), _filters(right)
    if not n or not m:
        return 0.0
    if (len(a), n) > (len(b), m):
        a, b = b, a
    bits_a, bits_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    scores = []
    for one, bits in zip(a, bits_a, strict=True):
        shared = np.bitwise_count(one & b).sum(axis=1, dtype=np.int64)
        chance = bits * bits_b / FILTER_BITS
        most = np.minimum(bits, bits_b)
        floor = chance + CHANCE_MARGIN * (most - chance)
        scores.append(np.max(np.where(shared > floor, (shared - floor) / np.maximum(most - floor, 1e-9), 0.0)))
    return float(min(1.0, np.mean(scores)))


def _filters(fingerprint: str) -> tuple[int, np.ndarray]:
    count, _, bits = fingerprint.partition(":")
    return int(count), np.frombuffer(bytes.fromhex(bits), np.uint8).reshape(-1, FILTER_BITS // 8)


def fingerprint(docs: DataFrame, ranks: np.ndarray, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """(row, ``name``): every packed input row with the fingerprint of its text; null reads as empty.

    An empty text has the empty fingerprint ``0:``; a text below 64 bytes is one feature. Rows are
    independent; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shared.value)
        for batch in batches:
            found = maker.many(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row", name])

    rows = packed(docs).select("row", text_or_empty(field(text)).alias("norm"))
    return rows.mapInArrow(run, rows.select("row").schema.add(name, "string"))


def _ordinal(kind: str) -> Column:
    """A number that rises with the id ``k_id``."""
    if kind == "string":
        letters = F.substring(F.hex(F.encode(F.substring("k_id", 1, 6), "utf-8")), 1, 12)
        return F.conv(F.rpad(letters, 12, "0"), 16, 10).cast("double")
    return F.col("k_id").cast("double")


def with_next(docs: DataFrame, id_col: str, text: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, tail, k_id, k_text, norm): rows laid out so that a reader meets each text's successor next.

    Rows go by ranges of the id (null first; a text by its first six bytes), sorted inside a range by id, then text. The first
    row of each range also comes, marked as tail, at the end of the range before it, and the very first at
    the very end. Ranges are near-even quantiles of about ``range_bytes``; beyond 2^16 of them, of up to 256 megabytes, as the
    table of their first rows is broadcast.
    """
    rows = packed(docs).select(
        field(id_col).alias("k_id"), F.xxhash64(field(text)).alias("k_text"), text_or_empty(field(text)).alias("norm")
    )
    total = rows.agg(F.sum(F.octet_length("norm") + 1)).first()[0] or 0
    ranges = max(min(MOST_RANGES, -(-total // range_bytes)), total // LARGE_RANGE) or 1
    number = rows.withColumn("key", F.coalesce(_ordinal(dict(rows.dtypes)["k_id"]), F.lit(float("-inf"))))
    steps = [i / ranges for i in range(1, ranges)]
    inner = sorted(set(number.select("key").approxQuantile("key", steps, 0.2 / ranges))) if steps else []
    splits = [float("-inf"), *([s for s in inner if s > float("-inf")] or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="key", outputCol="range").transform(number)
    dealt = dealt.withColumn("part", F.col("range").cast("int")).drop("key", "range")
    order = F.struct(F.col("k_id").isNotNull().alias("named"), "k_id", "k_text")
    firsts = dealt.groupBy("part").agg(F.min(order).alias("first")).collect()  # at most one row per range
    if not firsts:
        return dealt.withColumn("tail", F.lit(False))
    firsts = sorted((r["part"], r["first"]["k_id"], r["first"]["k_text"]) for r in firsts)
    before = [(p, i, t, firsts[n - 1][0]) for n, (p, i, t) in enumerate(firsts)]
    kind = dict(dealt.dtypes)["k_id"]
    table = docs.sparkSession.createDataFrame(before, f"p int, i {kind}, t bigint, to int")
    tails = dealt.join(
        F.broadcast(table),
        (F.col("part") == F.col("p")) & F.col("k_id").eqNullSafe(F.col("i")) & (F.col("k_text") == F.col("t")),
    ).select(F.col("to").alias("part"), F.lit(True).alias("tail"), "k_id", "k_text", "norm")
    both = dealt.select("part", F.lit(False).alias("tail"), "k_id", "k_text", "norm").unionByName(tails)
    return both.repartition(total // TASK_BYTES + 1, "part").sortWithinPartitions("part", "tail", F.col("k_id").asc_nulls_first(), "k_text")


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """Each text beside a copy whose second half is the beginning of the next text, both fingerprinted.

    One row per input row: ``doc_id``, ``n_chars``, ``edited`` (the copy), ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next`` (likeness to the copy's and to the next text's
    fingerprint). The next text is that of the next larger id (repeated ids by text hash, null first);
    after the last comes the first, a single text is its own next. Null text is empty.
    """
    ranks = rarity_ranks(docs, text) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    laid = with_next(docs, id_col, text)
    kind = dict(laid.dtypes)["k_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shared.value)
        held: tuple | None = None  # (part, tail, id, text, fingerprint) of the row before
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                prints = maker.many(*utf8(batch.column("norm")))
                rows = list(
                    zip(
                        batch.column("part").to_pylist(),
                        batch.column("tail").to_pylist(),
                        batch.column("k_id").to_pylist(),
                        batch.column("norm").to_pylist(),
                        prints,
                        strict=True,
                    )
                )
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                changed = maker.many(*utf8(pa.array(edited, pa.string())))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], batch.schema.field("k_id").type),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array(edited, pa.string()),
                        pa.array([a[4] for a, _ in pairs], pa.string()),
                        pa.array(changed, pa.string()),
                        pa.array([likeness(a[4], c) for (a, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                        pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return laid.mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
