"""Chat formatting, mixing and sharding against brute force and on odd inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_format as chat
from plumbline.llm import mixing, sharding, token_shards
from plumbline.session import ensure_checkpoint_dir

CHATS = "conv_id long, turn long, role string, text string"


def test_texts_come_back_and_mask_covers_assistants(spark):
    odd = [
        "", None, "plain", r"\### Assistant: </turn> ok", "</turn>", r"<\/turn>", r"<\\/turn>\\", "### ", r"#\## #### x",
        "<image> <audio><other>", "é 日本 👍\n\n", "#" * 9 + " ", "<" * 3 + "/turn>", ": a: b", "long " * 50_000,
    ]
    rows = [(c, t, ("user", "assistant", "sys: </turn>", None)[(c + t) % 4], odd[(c * 7 + t) % len(odd)])
            for c in range(6) for t in range(20)]
    rows += [(None, 0, "assistant", "x"), (9, None, "assistant", "null turn"), (9, 0, "user", "a"), (9, 0, "user", "a")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, CHATS)
    out = chat.parse_chats(chat.format_chats(df))
    out = out.withColumn("loss", chat.masked_texts(out))
    got = {r.conv_id: r for r in out.collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort()
        row = got[conv]
        assert [(t.role, t.text) for t in row.parsed] == [(r, x) for _, r, x in turns]
        assert row.loss == [x for _, r, x in turns if r == "assistant"]
        assert row.formatted.count("</turn>") == len(turns)
        for t, piece in zip(row.turns, turns, strict=True):
            body = row.formatted[t.body_start : t.body_start + t.body_length]
            assert "</turn>" not in body and "### " not in body
            assert row.formatted[t.start : t.start + t.length].endswith(body + "</turn>\n")
            assert t.loss == (piece[1] == "assistant")


def test_parts_become_ordered_placeholders(spark):
    part = {f.name: None for f in chat.PART.fields}
    image = {**part, "kind": "image", "ref": "a.png", "width": 28, "height": 15}
    audio = {**part, "kind": "audio", "ref": "b.wav", "seconds": 2.01}
    pages = {**part, "kind": "document", "ref": "c.pdf", "pages": 3}
    odd = {**part, "kind": "hologram", "ref": "d"}
    text = {**part, "kind": "text", "text": "see <image>: "}
    schema = "conv_id long, turn long, role string, row string, parts " + chat.PART.simpleString().join(["array<", ">"])
    df = spark.createDataFrame(
        [(1, 1, "assistant", "x", [audio, None, odd]), (1, 0, "user", "x", [text, image, pages, {**image, "width": -1, "height": None}]),
         (2, 0, "user", "x", None), (3, 0, "user", "x", [])], schema)
    got = {r.conv_id: r for r in chat.format_chats(df, parts="parts").collect()}
    first = got[1]
    assert first.formatted == "### user: see <\\image>: <image><document><image></turn>\n### assistant: <audio><other></turn>\n"
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in first.attachments] == [
        (1, "image", "a.png", 4), (2, "document", "c.pdf", 3072), (3, "image", "a.png", 0), (4, "audio", "b.wav", 51), (5, "other", "d", 0)]
    for a in first.attachments:
        assert first.formatted[a.position :].startswith(f"<{a.kind}>")
    assert first.expanded_tokens == 4 + 3072 + 51
    assert got[2].formatted == got[3].formatted == "### user: </turn>\n"


def test_chat_of_nothing(spark):
    assert chat.format_chats(spark.createDataFrame([], CHATS)).count() == 0


def brute_mix(docs, max_epochs=3, seed=0, budget=None):
    """docs: (id, source, size) with distinct ids."""
    names = sorted({"=" + s if s is not None else ">" for _, s, _ in docs})
    weight = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    size = Counter({s: 0 for s in names})
    for _, s, n in docs:
        size["=" + s if s is not None else ">"] += n
    budget = sum(size.values()) if budget is None else budget
    target, left, rest = {}, float(budget), set(names)
    while rest:
        share = left / sum(weight[s] for s in rest)
        full = {s for s in rest if weight[s] * share > max_epochs * size[s]}
        if not full:
            target |= {s: weight[s] * share for s in rest}
            break
        for s in full:
            target[s] = float(max_epochs * size[s])
            left -= target[s]
        rest -= full
    queue, sent = [], Counter()
    for i, s, n in sorted(docs, key=lambda d: (hashlib.md5(f"{seed}:{d[0]}".encode()).hexdigest())):
        s = "=" + s if s is not None else ">"
        sent[s] += n
        digest = hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
        queue += [((sent[s] + e * size[s]) / weight[s], s, e, digest, i, n) for e in range(max_epochs) if n]
    taken, total = Counter(), 0
    for _, _, _, _, i, n in sorted(queue):
        total += n
        if total > budget:
            break
        taken[i] += n
    return size, target, taken


@pytest.mark.parametrize("range_rows", [7, 10_000])
def test_mix_equals_brute_force(spark, range_rows):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a"] * 12 + ["b", "B", "é", "zz", None]), rng.choice([0, 1, 5, 40, 300])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n long")
    size, target, taken = brute_mix(docs)
    rows = mixing.mix_sources(df, size="n", range_rows=range_rows).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = "=" + r.source if r.source is not None else ">"
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken == taken[r.doc_id] <= 3 * r.size
    per_source = Counter()
    for r in rows:
        per_source["=" + r.source if r.source is not None else ">"] += r.taken
    assert all(abs(per_source[s] - target[s]) <= 600 for s in target)


def test_mix_order_holds_every_copy_and_clashing_names_survive(spark):
    docs = spark.createDataFrame(
        [(1, "x", "a b c", "mine", 7), (1, "x", "a b c", "mine", 7), (2, "y", None, "m", 8), (3, None, "", "m", 9), (4, "y", "w " * 100_000, "m", 1)],
        "doc_id long, source string, text string, SIZE string, weight int")
    mixed = mixing.mix_sources(docs)
    assert {"SIZE_in", "weight_in", "size", "weight"} <= set(mixed.columns)
    rows = mixed.collect()
    assert len(rows) == 5 and {r.copies for r in rows if r.doc_id == 1} == {rows[0].copies if rows[0].doc_id == 1 else 3}
    assert all(r.copies == 0 for r in rows if r.doc_id in (2, 3))
    order = mixing.in_mix_order(mixed, ["doc_id"]).collect()
    assert len(order) == sum(r.copies for r in rows)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(empty).count() == 0
    wordless = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert [(r.copies, r.target) for r in mixing.mix_sources(wordless).collect()] == [(0, 0.0)]
    some = spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string")
    assert [r.copies for r in mixing.mix_sources(some, budget=0).collect()] == [0]


def test_shards_hold_all_rows_in_gapless_slots(spark, tmp_path):
    rows = [(i if i % 10 else None, "t" * (i % 50) if i % 7 else None, i, "mine") for i in range(500)] + [(7, "same", 0, "mine")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard int, bucket string")
    out = sharding.external_shuffle(docs, shards=16, bucket_bytes=900)
    again = sharding.external_shuffle(docs.repartition(5), shards=16, bucket_bytes=900)
    key = lambda df: sorted((r.shard, r.slot, r.doc_id or -1, r.text or "", r.Shard_in, r.bucket, r.size) for r in df.collect())
    got = key(out)
    assert Counter((r[2], r[3], r[4]) for r in got) == Counter((a or -1, b or "", c) for a, b, c, _ in rows)
    assert [r[:4] for r in got] == [r[:4] for r in key(again)]
    counts = Counter(r[0] for r in got)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert [r[1] for r in got if r[0] == shard] == list(range(counts[shard]))
    path = sharding.write_shards(out, str(tmp_path / "shards"))
    assert key(spark.read.parquet(path)) == got
    # a random order: neighbours in the input are not neighbours in the output
    place = {r[4]: i for i, r in enumerate(got)}
    assert sum(abs(place[i] - place[i + 1]) == 1 for i in range(400)) < 20


def test_shards_of_little(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.external_shuffle(empty).count() == 0
    two = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    rows = sharding.external_shuffle(two, shards=16).collect()
    assert len({r.shard for r in rows}) == 2 and {r.slot for r in rows} == {0}


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation_with_an_inverse(size):
    import numpy as np

    order = token_shards.SlotPermutation(size, 5)
    slots = order.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert order.numbers(slots).tolist() == list(range(size))
    if size > 100:
        assert (slots != token_shards.SlotPermutation(size, 6).slots(np.arange(size))).mean() > 0.9


def test_token_shards_read_back_from_any_slot(spark, tmp_path):
    texts = [(i, "".join(chr(97 + (i * j) % 26) for j in range(i * 3 % 200)), "x") for i in range(120)]
    texts += [(500, None, "x"), (None, "null id\nwith a line end", "x"), (3, texts[3][1], "x"), (-5, "negative", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, slot string")
    df = docs.select("doc_id", F.col("text").cast("binary").alias("ids"), "slot")
    stride = token_shards.record_bytes(16, 1)
    records = token_shards.training_order(df, token_bytes=1, record_tokens=16, shard_bytes=stride * 50, key=9)
    rows = records.collect()
    total = sum(max(1, -(-len((t or "").encode()) // 16)) for _, t, _ in texts)
    assert sorted(r.slot for r in rows) == list(range(total))
    path = token_shards.write_shards(records, str(tmp_path / "tokens"))
    by_slot = {r.slot: r for r in rows}
    pieces = defaultdict(dict)
    for shard in range(-(-total // 50)):
        files = list((tmp_path / "tokens" / f"shard={shard}").glob("part-*"))
        assert len(files) == 1 and files[0].stat().st_size == stride * min(50, total - 50 * shard)
        with files[0].open("rb") as file:
            start = shard * 50 + 3  # resume inside the shard
            found = list(token_shards.read_records(file, start, 100, 50, 16, 1))
            assert len(found) == min(50, total - 50 * shard) - 3
            for slot, (doc, part, tokens) in enumerate(found, start):
                row = by_slot[slot]
                assert doc == (row.doc_id if row.doc_id is not None else -(1 << 63)) and part == row.part
                assert row.offset == (slot % 50) * stride and len(tokens) == row.n_tokens
            for doc, part, tokens in token_shards.read_records(file, shard * 50, 50, 50, 16, 1):
                pieces[doc].setdefault(part, []).append(tokens.tobytes())
    for doc, text, _ in texts:
        if doc != 3:
            got = b"".join(pieces[doc if doc is not None else -(1 << 63)][p][0] for p in sorted(pieces[doc if doc is not None else -(1 << 63)]))
            assert got == (text or "").encode()
    assert all(len(v) == 2 for v in pieces[3].values())
    assert path.endswith("tokens")


def test_token_shards_of_nothing(spark):
    assert token_shards.training_order(spark.createDataFrame([], "doc_id long, ids binary")).count() == 0


def test_token_shards_query_writes_bpe_ids_and_reads_them_back(spark, folder, monkeypatch):
    import numpy as np

    from plumbline.llm import bpe, queries

    written = []
    write = token_shards.write_shards
    monkeypatch.setattr(token_shards, "write_shards", lambda records, path=None: written.append(write(records, path)) or written[-1])
    texts = {i: t for i, t in queries.table(spark, folder, "documents").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op3_token_shards"](spark, folder).collect()
    files = {r.shard: r.content for r in spark.read.format("binaryFile").load(written[0]).collect()}
    stride = token_shards.record_bytes(1024, 2)
    assert len(written) == 1 and sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(map(len, files.values())) == stride * len(rows)
    codec, found = bpe.Codec(bpe.load_vocabulary(bpe.vocabulary_path())), defaultdict(dict)
    for r in rows:
        assert bytes(files[r.shard])[r.offset : r.offset + stride] == bytes(r.record) + b"\n"
        found[r.doc_id][r.part] = np.frombuffer(bytes(r.record)[16 : 16 + 2 * r.n_tokens], "<u2")
    assert set(found) == set(texts)
    for i, t in texts.items():
        ids = np.concatenate([found[i][p] for p in sorted(found[i])])
        assert ids.tolist() == np.frombuffer(codec.encode(t or ""), "<u4").tolist()


def test_stored_records_are_the_written_ones(spark, tmp_path):
    rows = [(1, b"\n\x00" * 40), (None, b"\xff\n" * 3), (-5, b""), (7, None), (7, b"ab" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary")
    size = {"token_bytes": 2, "record_tokens": 16, "shard_bytes": 3 * token_shards.record_bytes(16, 2)}
    records = token_shards.training_order(df, **size)
    path = token_shards.write_shards(records, str(tmp_path / "tokens"))
    back = token_shards.stored_records(spark, path, **size)
    assert back.columns == records.columns
    assert sorted(map(tuple, back.collect()), key=lambda r: r[3]) == sorted(map(tuple, records.collect()), key=lambda r: r[3])
    nothing = token_shards.training_order(df.limit(0), **size)
    empty = token_shards.write_shards(nothing, str(tmp_path / "none"))
    assert token_shards.stored_records(spark, empty, **size).count() == 0


def test_token_shards_leave_one_copy_of_the_tokens_and_no_shuffle_of_them(spark, tmp_path):
    def lasting():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return sum(f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data"))

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    draw, before = random.Random(7), spark.conf.get(key)
    rows = [(i % 90, draw.randbytes(draw.randrange(20_000))) for i in range(100)]
    size = {"token_bytes": 2, "record_tokens": 256, "shard_bytes": 100 * token_shards.record_bytes(256, 2)}
    df = spark.createDataFrame(rows, "doc_id long, ids binary").localCheckpoint()
    spark._jvm.System.gc()
    shared, floor = Path(ensure_checkpoint_dir(spark).removeprefix("file:")), lasting()
    there = set(shared.iterdir())
    records = token_shards.training_order(df, **size)
    path = token_shards.write_shards(records, str(tmp_path / "tokens"))
    total = sum(max(1, -(-len(b) // 512)) for _, b in rows)
    shards = -(-total // 100)
    assert shards > 16
    assert [len(list((tmp_path / "tokens" / f"shard={n}").glob("part-*"))) for n in range(shards)] == [1] * shards
    assert {f.name.rsplit("-", 1)[0] for f in set(shared.iterdir()) - there} == {"token-records"}
    assert lasting() - floor < sum(len(b) for _, b in rows) / 4 and spark.conf.get(key) == before
    back = token_shards.stored_records(spark, path, **size).orderBy("slot").collect()
    assert back == records.orderBy("slot").collect() and [r.slot for r in back] == list(range(total))
    found = defaultdict(list)
    for r in sorted(back, key=lambda r: (r.doc_id, r.part)):
        found[r.doc_id].append(bytes(r.record)[16 : 16 + 2 * r.n_tokens])
    for i in range(10, 90):
        assert b"".join(found[i]) == rows[i][1][: len(rows[i][1]) // 2 * 2]


def test_a_wave_of_shards_reads_only_its_records(spark):
    df = spark.createDataFrame([(i, b"ab" * i) for i in range(50)], "doc_id long, ids binary")
    records = token_shards.training_order(df, token_bytes=2, record_tokens=4, shard_bytes=5 * token_shards.record_bytes(4, 2))
    wave = records.where(F.col("shard").between(8, 15))
    plan = wave._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(shard,8), LessThanOrEqual(shard,15)" in plan


def test_buckets_are_shuffled_by_seed_and_alike_in_every_run(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")

    def order(seed, parts):
        rows = sharding.external_shuffle(docs.repartition(parts), shards=1, seed=seed, bucket_bytes=400).orderBy("slot").collect()
        assert [r.slot for r in rows] == list(range(300))
        return [r.doc_id for r in rows]

    first = order(1, 3)
    assert first == order(1, 6) != order(2, 3) and sorted(first) == list(range(300))
    # neighbours in a bucket are not in the order of their draws
    one = sharding.external_shuffle(docs, shards=1, bucket_bytes=1 << 20).orderBy("slot").select(
        F.xxhash64(F.lit(0), "doc_id", "text").alias("draw")
    ).collect()
    rises = sum(a.draw < b.draw for a, b in zip(one, one[1:], strict=False))
    assert 110 < rises < 190
