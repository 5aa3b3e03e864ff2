"""Exact dedup, n-gram join and line dedup against brute force and on odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import exact_dedup, line_dedup, ngram_join
from plumbline.llm.components import components
from plumbline.llm.hashing import WordHasher, utf8
from plumbline.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").translate(LOWER)


DOCS = "doc_id long, text string, name string"


def odd_texts():
    rng = random.Random(5)
    base = ["".join(rng.choice("abÀÉé \n") for _ in range(n)) for n in (1, 15, 16, 17, 31, 32, 33, 48, 200)]
    rows = []
    for i in range(150):
        text = rng.choice(base)
        rows.append((i, text.upper() if rng.random() < 0.2 and text.isascii() else text))
    # the same blocks in another order, shared beginnings, empty and null texts, a null id, repeated rows
    rows += [(200, "a" * 16 + "b" * 16), (201, "b" * 16 + "a" * 16), (202, "A" * 16 + "B" * 16), (203, "a" * 16)]
    rows += [(210, None), (211, ""), (None, "a" * 16), (None, "only here"), (220, "twice"), (220, "twice"), (220, "TWICE")]
    rows += [(230, "x" * 5_000), (231, "X" * 5_000), (232, "x" * 4_999 + "y")]
    return rows


@pytest.mark.parametrize("fewest_hot", [1000, 1])  # 1: every block that occurs more than once is spread
def test_exact_groups(spark, fewest_hot):
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], DOCS)
    out = exact_dedup.duplicate_report(df, block_bytes=16, fewest_hot=fewest_hot).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_dedup_keeps_rows_and_columns(spark):
    df = spark.createDataFrame(
        [(1, "A", 5, "x"), (2, "a", 6, "y"), (3, None, 7, "z"), (3, None, 7, "z"), (None, "b", 8, "w")],
        "doc_id long, text string, k_id int, row string")
    assert sorted(map(tuple, exact_dedup.drop_duplicates(df).collect()), key=str) == sorted(
        [(2, "a", 6, "y"), (3, None, 7, "z"), (None, "b", 8, "w")], key=str)
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.drop_duplicates(empty).count() == exact_dedup.duplicate_report(empty).count() == 0


def test_components_by_star_steps(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 530)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(-5, 7), (7, 7), (-5, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent) if any(x in e and e[0] != e[1] for e in edges)}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def shingle_set(text, width=5):
    w = WORD.findall(low(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[find(i)].append(rows[i][0])
    return Counter(
        (rows[i][0], len(sets[i]), min(ids[find(i)], default=None) if sets[i] else rows[i][0]) for i in range(len(rows))
    )


def near_copies():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    shared = text(60)
    for family in range(12):
        base = text(rng.choice([8, 40, 150, 300]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            one = list(base)
            for _ in range(rng.choice([0, 1, 2, max(1, len(base) // 40), max(1, len(base) // 25)])):
                at = rng.randrange(len(one))
                one[at : at + 1] = rng.choice([[], ["new" + str(rng.random())], [one[at], "more"]])
            if rng.random() < 0.1:
                one = one[: int(len(one) * 0.82)]
            rows.append(" ".join(one).upper() if rng.random() < 0.1 else "  ".join(one))
        del family
    rows += [" ".join(text(200) + shared + text(100)) for _ in range(40)]
    out = list(enumerate(rows))
    out += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, " \t\n"), (None, "one two"), (906, "é À x"),
            (907, "É À x"), (908, rows[0]), (908, rows[0]), (None, "nameless words only here")]
    rng.shuffle(out)
    return out


def test_near_copies_by_brute_force(spark, monkeypatch):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], DOCS).repartition(3)
    want = brute_components(rows)
    got = ngram_join.ngram_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    # tiny blocks and trees, and no cheap first links: the crossing step alone finds them all
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "TREE_SETS", 3)
    monkeypatch.setattr(ngram_join, "STAR_TOKENS", 0)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 50)
    got = ngram_join.ngram_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_keep_one_of_each_group(spark):
    rows = near_copies()
    want = brute_components(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, comp int, row string")
    kept = ngram_join.keep_one(df).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "comp", "row"]
    groups = {c for _, n, c in want if n}
    assert Counter(r.doc_id for r in kept if shingle_set(r.text)) == Counter(groups)
    assert sum(not shingle_set(r.text) for r in kept) == sum(k for (_, n, _), k in want.items() if not n)


def test_near_copies_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.ngram_components(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "n"), (2, " ", "n")], DOCS)
    assert sorted(tuple(r)[:3] for r in ngram_join.ngram_components(blank).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert ngram_join.keep_one(blank).count() == 2


def test_tree_finds_what_comparing_each_set_finds():
    rng = np.random.default_rng(4)
    universe = np.sort(rng.integers(0, 1 << 58, 400, dtype=np.uint64))
    base = universe[rng.random(400) < 0.5]
    sets = []
    for _ in range(60):
        flips = universe[rng.random(400) < rng.choice([0.01, 0.05, 0.2])]
        sets.append(np.array(sorted(set(base.tolist()) ^ set(flips.tolist())), np.uint64))
    sets += [sets[0], np.empty(0, np.uint64), universe]
    for percent in (50, 80, 100):
        tree = ngram_join.PrefixTree(sets, list(range(len(sets))), percent)
        for walker in (sets[3], base, universe, np.empty(0, np.uint64)):
            want = [
                i for i, s in enumerate(sets)
                if 100 * len(np.intersect1d(s, walker)) >= percent * len(np.union1d(s, walker))
            ]
            assert sorted(tree.linked(walker)) == want


def test_words_of_any_length_hash_alike_in_any_chunk(monkeypatch):
    import pyarrow as pa

    texts = ["a B c", "", None, "x" * 500 + " y\tz", "é  ü", "a b c", "ends "]
    whole = WordHasher().shingles(*utf8(pa.array(texts)), 2)
    monkeypatch.setattr("plumbline.llm.hashing.CHUNK_BYTES", 16)
    parts = WordHasher().shingles(*utf8(pa.array(texts)), 2)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    sliced = WordHasher().shingles(*utf8(pa.array(["skip", *texts]).slice(1)), 2)
    assert all((a == b).all() for a, b in zip(whole, sliced, strict=True))
    first = whole[0][whole[1] == 0].tolist()
    assert first == whole[0][whole[1] == 5].tolist() and len(first) == 2


def all_repeated_runs(rows):
    """The rule itself: of every stretch of three lines or 50 words, all places but the first; ids are distinct."""
    docs = {}
    for i, t in sorted(rows):
        docs[i] = [(at, x.strip(" "), len(WORD.findall(x))) for at, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    places = defaultdict(list)
    for i, lines in docs.items():
        for p in range(len(lines)):
            for q in range(p + 1, len(lines) + 1):
                run = lines[p:q]
                if len(run) >= 3 or sum(x[2] for x in run) >= 50:
                    places[tuple(x[1] for x in run)].append([(i, x[0]) for x in run])
    gone = {x for found in places.values() for run in found[1:] for x in run}
    return {i: sorted(at for j, at in gone if j == i) for i, _ in rows}


def test_line_runs_by_brute_force(spark):
    rng = random.Random(8)
    pool = [f"line {i} here" for i in range(60)] + ["", "  ", "common"] * 4
    passages = [[f"p{k} {j}" for j in range(rng.choice([2, 3, 6]))] for k in range(8)]
    long = " ".join(f"w{i}" for i in range(55))
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) + (f" {rng.random()}" if rng.random() < 0.6 else "") for _ in range(rng.randrange(12))]
        if rng.random() < 0.5:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(passages)
        if rng.random() < 0.2:
            lines.insert(0, " " + long)
        rows.append((i, "\n".join(lines)))
    rows += [(200, "x y\n" * 300), (201, rows[3][1]), (202, None), (203, ""), (204, "\n\n"), (205, long), (206, long + " ")]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, removed string").repartition(4)
    want = all_repeated_runs(rows)
    got = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id: r.removed for r in got} == want and len(got) == len(rows)
    assert sum(map(len, want.values())) > 350
    texts = dict(rows)
    for r in got:
        lines = (texts[r.doc_id] or "").split("\n")
        assert r.removed_in == "mine" and r.n_lines == len(lines)
        assert r.clean_text == "\n".join(x for at, x in enumerate(lines) if at not in r.removed)
    # every long line but the first is gone
    assert sum(long in r.clean_text for r in got) == 1


def test_every_repeated_run_is_found(spark):
    rng = random.Random(21)
    rows = []
    for k in range(40):  # two lines of 30 words each, between lines of their own
        pair = [" ".join(f"{side}{k}x{j}" for j in range(30)) for side in "ab"]
        for i in (2 * k, 2 * k + 1):
            own = [f"{rng.random()} own" for _ in range(4)]
            rows.append((i, "\n".join([*own[:2], *pair, *own[2:]])))
    for k in range(40):  # an older document has just a part of the run that two later ones share
        run = [f"run {k} {j}" for j in range(rng.choice([3, 4]))]
        part = run[:2] if rng.random() < 0.5 else run[1:3]
        for i, lines in ((100 + k, part), (200 + k, run), (300 + k, run)):
            rows.append((i, "\n".join([f"{rng.random()} own", "", *lines, f"{rng.random()} own"])))
    rows += [(400, "x y\n" * 7), (401, "x y\nx y\nx y\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(df).collect()}
    want = all_repeated_runs(rows)
    assert got == want
    assert all(len(want[2 * k + 1]) == 2 and len(want[300 + k]) >= 3 for k in range(40))


def test_lines_with_null_ids_repeats_and_nothing(spark):
    text = "a b\nc d\ne f\ng h"
    df = spark.createDataFrame([(None, text), (1, text), (2, "q"), (2, "q"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.clean_text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, text), (1, ""), (2, "q"), (2, "q"), (3, "")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_source_mix", "op4_ngram_join", "op6_line_dedup", "op9_block_naming"])
def test_query_equals_sql(spark, folder, name):
    import glob
    import os

    import duckdb

    from check_oracle import rows_of

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df = QUERIES[name](spark, folder)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())
