"""Classifier, fingerprints, BPE and the pipeline, on given tables and on odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, fingerprints, quality
from plumbline.llm.hashing import FINE, WordHasher, utf8
from plumbline.llm.queries import QUERIES

DOCS = "doc_id long, text string, name string"


@pytest.fixture(scope="module")
def hundredth():
    return "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark, hundredth):
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, hundredth).collect()}
    docs = spark.read.parquet(f"{hundredth}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{hundredth}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert np.mean([rows[i].predicted == labels[i] for i in held]) > 0.9
    good, bad = ([rows[i].score for i in held if labels[i] == y] for y in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_held_out_labels_are_never_read(spark, hundredth):
    docs = spark.read.parquet(f"{hundredth}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{hundredth}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first = quality.fit(docs, labels)
    assert (first == quality.fit(docs.repartition(3), turned.repartition(5))).all() and first.any()
    assert (first != quality.fit(docs, labels, training_rows=50)).any()


def test_features_count_whole_texts():
    rng = random.Random(1)
    texts = ["", "one", "ONE two!! 33", " ".join(rng.choice(["a", "B c", "d!", "é"]) for _ in range(5000))]
    found = list(quality.features(*utf8(pa.array(texts)), WordHasher(FINE)))
    assert [len(p) for p, _ in found][:2] == [1, 2] and all(p[0] == 0 and v[0] == 1 for p, v in found)
    assert all(abs((v[1:] ** 2).sum() - 1) < 1e-9 for _, v in found[1:])
    alone = list(quality.features(*utf8(pa.array(texts[3:])), WordHasher(FINE)))[0]
    assert (alone[0] == found[3][0]).all() and (alone[1] == found[3][1]).all()


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (None, "", "y"), (2, "w " * 200_000, "z"), (2, "w " * 200_000, "z"), (3, "good", "q")],
        "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 0)], "doc_id long, quality int")
    weights = quality.fit(docs, labels)
    rows = quality.score(docs, weights).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score_in == "x"
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality.keep_good(docs, labels, threshold=0.0).columns == docs.columns
    empty = spark.createDataFrame([], DOCS)
    assert not quality.fit(empty, labels.limit(0)).any()
    assert quality.score(empty, weights).count() == 0
    assert [r.score for r in quality.score(docs.limit(1), quality.fit(docs, labels.limit(0))).collect()] == [0.5]


def reference_features(data, ranks):
    """Places by the documented rule, one window at a time."""
    steps = fingerprints._STEPS
    whole = np.cumsum(steps)

    def level(window):
        total = sum(int(whole[c]) for c in collections.Counter(window).values())
        return (int(whole[-1]) - total) * 1023 // int(whole[-1])

    n = len(data) - 63
    rank = [int(ranks[level(data[i : i + 64])]) for i in range(n)]
    votes = collections.Counter(
        min(range(s, s + 64), key=lambda i: (rank[i], i)) for s in range(n - 63)
    )
    places = {i for i, v in votes.items() if v >= 16}
    if len(places) < 8 and n > 0:
        edges = sorted({i * n // 8 for i in range(8)}) + [n]
        places |= {min(range(a, b), key=lambda i: (rank[i], i)) for a, b in zip(edges, edges[1:], strict=False)}
    return sorted(places)


def test_fingerprint_features_by_brute_force(monkeypatch):
    rng = random.Random(3)
    ranks = np.random.default_rng(1).permutation(1024)
    texts = ["".join(rng.choice("abcdefgh ,.\né") for _ in range(n)) for n in (64, 70, 127, 128, 190, 700, 1500)] + ["ab" * 200]
    maker = fingerprints.Fingerprinter(ranks)
    data, offsets = utf8(pa.array(texts))
    got = maker._features(data, offsets)
    want = [offsets[i] + p for i, t in enumerate(texts) for p in reference_features(t.encode(), ranks)]
    assert got.tolist() == want
    prints = maker.many(data, offsets)
    assert prints == [maker.many(*utf8(pa.array([t])))[0] for t in texts]
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 600)
    small = fingerprints.Fingerprinter(ranks)
    assert small.many(*utf8(pa.array(texts[-2:-1]))) == prints[-2:-1]  # a text in several chunks


def test_likeness():
    rng = random.Random(5)
    maker = fingerprints.Fingerprinter(np.arange(1024))
    text = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    long, other = text(3000), text(3000)
    one, half, two, empty = maker.many(*utf8(pa.array([long, long[:8000] + other[8000:], other, ""])))
    assert fingerprints.likeness(one, one) == fingerprints.likeness(empty, empty) == 1.0
    assert fingerprints.likeness(one, empty) == 0.0
    assert fingerprints.likeness(one, half) > 0.3 > 0.05 > fingerprints.likeness(one, two)
    assert fingerprints.likeness(one, half) == fingerprints.likeness(half, one)


def test_edited_copies_follow_the_next_document(spark):
    rng = random.Random(9)
    rows = [(i * 3, "".join(rng.choice("abc é日\n") for _ in range(rng.choice([0, 1, 2, 63, 64, 500])))) for i in range(300)]
    rows += [(7, None), (None, "null id"), (10**15, "far"), (4, "x" * 30_000)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(i, t, "n") for i, t in shuffled], "doc_id long, text string, part string").repartition(5)
    laid = fingerprints.with_next(df, "doc_id", "text", range_bytes=700)
    assert laid.select("part").distinct().count() > 5
    monkey = fingerprints.RANGE_BYTES
    fingerprints.with_next.__defaults__ = (700,)
    try:
        out = {r.doc_id: r for r in fingerprints.edited_copies(df).collect()}
    finally:
        fingerprints.with_next.__defaults__ = (monkey,)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(out) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        assert out[i].edited == t[: len(t) - half] + nxt[:half] and out[i].n_chars == len(t)
    prints = collections.defaultdict(set)
    for i, t in rows:
        prints[t or ""].add(out[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.edited_copies(spark.createDataFrame([], DOCS)).count() == 0
    alone = fingerprints.edited_copies(spark.createDataFrame([(1, "abcd", "n")], DOCS)).collect()
    assert [(r.edited, r.near_next) for r in alone] == [("abab", 1.0)]


def test_near_beats_next(spark, hundredth):
    rows = QUERIES["op8_fingerprints"](spark, hundredth).collect()
    near = np.array([r.near_edited for r in rows])
    following = np.array([r.near_next for r in rows])
    assert len(rows) == 1000 and ((near >= 0) & (near <= 1) & (following >= 0) & (following <= 1)).all()
    assert np.median(near) > 0.3 and np.mean(following > 0.3) < 0.05 and np.mean(near > following) > 0.9


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_the_library():
    codec, theirs = bpe.Codec(bpe.load_vocabulary(bpe.vocabulary_path())), library()
    rng = random.Random(2)
    pool = ["<|startoftext|>", "<|endoftext|>", "<|", "|>", "'s", "'LL", "don't", "ΑΣ", "Σ", "\xa0", "\n", "é", "é", "İ", "12", "!!", "日本", "👩‍👩‍👧",
            " ", "​", "\x85", "a", "internationalization", "\x00", "﻿", "x" * 300]
    texts = ["", " "] + ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert codec.decode(got).decode() == theirs.decode(ids, skip_special_tokens=False), text


def test_texts_encoded_together_are_those_encoded_alone(monkeypatch):
    monkeypatch.setattr(bpe, "EQUAL_WORDS", 3)
    codec, theirs = bpe.Codec(bpe.load_vocabulary(bpe.vocabulary_path())), library()
    rng = random.Random(5)
    pool = ["<|endoftext|>", "<|", "'", "''", "'s", "'LL", "'re", "'v", "don't", "Σ", "\xa0", "\n", " ", "\x1c", "\x1f", "é", "İ", "12", "٣", "²",
            "!!", "日本", "👍", "\U0001d400", "\u200b", "\x85", "ve", "straße", "internationalization", "\x00", "x" * 300]
    texts = ["", " ", "'", "\n"] + ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    words = []
    merge = codec._words
    monkeypatch.setattr(codec, "_words", lambda equal: words.extend(equal) or merge(equal))
    got = codec.encode_rows(texts)
    assert len(words) > 2000 and codec.encode_rows([]) == []
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    monkeypatch.setattr(bpe, "CHARS_AT_ONCE", 30)
    small = bpe.Codec(bpe.load_vocabulary(bpe.vocabulary_path()))
    assert small.encode_rows(texts) == got and len(small.young) <= 5 and len(small.old) <= 5
    other = bpe.load_vocabulary(bpe.vocabulary_path()) | {"kinds": None}
    assert bpe.Codec(other).encode_rows(texts) == got


def test_remembered_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    codec, theirs = bpe.Codec(bpe.load_vocabulary(bpe.vocabulary_path())), library()
    text = " ".join(f"word{chr(97 + i % 26)} next{chr(97 + i % 7)}" for i in range(200))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert len(codec.young) <= 5 and len(codec.old) <= 5


def test_bpe_of_rows(spark, folder):
    theirs = library()
    rows = QUERIES["op10_bpe"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = theirs.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "x" * 20_000, "c")], "doc_id long, text string, IDS string")
    out = bpe.encode(spark, odd, bpe.vocabulary_path(), decoded=True)
    assert out.columns == ["doc_id", "text", "IDS_in", "ids", "decoded"]
    got = out.collect()
    assert len(got) == 4 and [(bytes(r.ids), r.decoded) for r in got[:3]] == [(b"", "")] * 3
    again = bpe.decode(spark, out.drop("decoded"), bpe.vocabulary_path()).collect()
    assert [r.decoded for r in again] == [r.decoded for r in got]
    assert bpe.encode(spark, spark.createDataFrame([], DOCS), bpe.vocabulary_path()).count() == 0


STAGES = {name: stage for name, stage in corpus_pipeline.STAGES}
FULL = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_what_they_should(spark, hundredth):
    docs = spark.read.parquet(f"{hundredth}/documents.parquet")
    columns = docs.columns
    scores = {r.doc_id: r.predicted for r in QUERIES["op5_quality"](spark, hundredth).collect()}
    good = STAGES["quality classifier"](spark, docs, hundredth)
    assert good.columns == columns
    good = spark.createDataFrame(good.collect(), good.schema)
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for r in good.collect():
        last[r.text.translate(low)] = max(last.get(r.text.translate(low), -1), r.doc_id)
    single = STAGES["exact dedup"](spark, good, hundredth)
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())


def test_pipeline_end_to_end(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    theirs = library()
    for r in rows[::7]:
        assert np.frombuffer(r.ids, "<u4").tolist() == theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
    copies = collections.Counter(r.doc_id for r in rows)
    assert max(copies.values()) <= 3
    kept = {i: re.findall(r"[^\x20\x09-\x0D]+", texts[i]) for i in copies}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in kept.items()}
    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            assert not a & b or len(a & b) < 0.8 * len(a | b)


def test_stages_on_empty_and_odd_tables(spark, folder):
    empty = spark.createDataFrame([], FULL)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)], FULL)
    wide = odd.withColumns({"row": F.lit(1), "size": F.lit("s"), "score": F.lit(2.0), "k_id": F.lit("k")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
        out = stage(spark, wide, folder)
        rows = out.collect()
        assert name == "BPE encoding" or out.columns == wide.columns, name
        assert name != "BPE encoding" or len(rows) == 3


def test_long_texts_get_the_features_they_would_get_in_one_piece(monkeypatch):
    rng = np.random.default_rng(6)
    ranks = rng.permutation(fingerprints.LEVELS).astype(np.int64)
    texts = [b"abc" * 3_000, b"x" * 5_000, b"abcdefgh" * 900 + b"z" * 40, bytes(rng.integers(97, 123, 9_000, dtype=np.uint8))]
    texts += [b"abc" * 1_000 + bytes(rng.integers(97, 123, 70, dtype=np.uint8)) + b"abc" * 1_500]
    texts += [b"ab" * (n // 2) + b"c" * (n % 2) for n in range(1_020, 1_170)]

    def prints():
        maker = fingerprints.Fingerprinter(ranks)
        return [maker.many(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]

    whole = prints()
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 1_024)
    assert prints() == whole
    assert not any(one.startswith("0:") for one in whole)


def test_a_periodic_text_beyond_a_chunk_is_not_empty():
    maker = fingerprints.Fingerprinter(np.arange(fingerprints.LEVELS))
    text = np.frombuffer(b"abc" * 400_000, np.uint8)
    assert len(text) > fingerprints.CHUNK_BYTES
    one, other = (maker.many(t, np.array([0, len(t)]))[0] for t in (text, text[: len(text) - 300_000]))
    assert not one.startswith("0:") and fingerprints.likeness(one, "0:") == 0.0
    assert fingerprints.likeness(one, other) > 0.5


def test_rarity_and_fingerprints_do_not_depend_on_the_layout(spark, hundredth, monkeypatch):
    docs = spark.read.parquet(f"{hundredth}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    texts = [r.text or "" for r in docs.collect()] + ["", "é" * 40, "x" * 63, "abc" * 3000]
    want = np.zeros(fingerprints.LEVELS, np.int64)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        want += np.bincount(fingerprints.entropy_levels(data), minlength=fingerprints.LEVELS)
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 4000)
    for order in (texts, texts[::-1]):
        found = fingerprints._level_counts(*utf8(pa.array(order)))
        assert (found == want).all()
    monkeypatch.undo()
    seen = []
    for parts in (1, 7):
        dealt = docs.repartition(parts, "text")
        ranks = fingerprints.rarity_ranks(dealt)
        rows = fingerprints.edited_copies(dealt).select("doc_id", "fingerprint", "edited_fingerprint", "near_next").collect()
        seen.append((ranks.tolist(), sorted(map(tuple, rows))))
    assert seen[0] == seen[1]


def test_text_ids_are_ordered_by_their_letters(spark):
    ids = ["b", "a", None, "aaaaaaaz", "aaaaaaab", "é", "B", "10", "9"]
    df = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id string, text string").repartition(3)
    out = {r.doc_id: r for r in fingerprints.edited_copies(df).collect()}
    named = sorted((i for i in ids if i is not None), key=lambda i: i.encode())
    ring = [None, *named]
    for at, name in enumerate(ring):
        following = f"text of {ring[(at + 1) % len(ring)]}"
        own = f"text of {name}"
        assert out[name].edited == own[: len(own) - len(own) // 2] + following[: len(own) // 2]


def test_leader_updates_by_plain_python():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Good", "words", "here", "!!", "42", "spam", "é"]) for _ in range(rng.randrange(12))) for _ in range(25)]
    rows = list(quality.features(*utf8(pa.array(texts)), WordHasher(FINE)))
    labels = [float("spam" not in t) for t in texts]
    settings = quality.Leader(alpha=0.7, beta=0.9, l1=0.05, l2=0.2, epochs=3)
    lead, seen = collections.defaultdict(float), collections.defaultdict(float)

    def weight(place):
        z, n = lead[place], seen[place]
        if abs(z) <= settings.l1:
            return 0.0
        return (np.copysign(settings.l1, z) - z) / ((settings.beta + n**0.5) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for y, (places, values) in zip(labels, rows, strict=True):
            known = {p: weight(p) for p in places.tolist()}
            margin = sum(known[p] * v for p, v in zip(places.tolist(), values.tolist(), strict=True))
            off = 1 / (1 + np.exp(-margin)) - y
            for p, v in zip(places.tolist(), values.tolist(), strict=True):
                g = off * v
                rate = ((seen[p] + g * g) ** 0.5 - seen[p] ** 0.5) / settings.alpha
                lead[p] += g - rate * known[p]
                seen[p] += g * g
    found = quality.train(((y, p, v) for y, (p, v) in zip(labels, rows, strict=True)), settings)
    want = {p: weight(p) for p in lead if weight(p)}
    assert set(np.flatnonzero(found).tolist()) == set(want) and len(want) > 20
    assert all(abs(found[p] - w) < 1e-9 for p, w in want.items())
