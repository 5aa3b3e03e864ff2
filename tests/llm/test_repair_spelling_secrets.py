"""Conversation repair, spelling groups and secret scans against brute force and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_repair, queries, secret_scan, spelling

CHATS = "conv_id long, turn long, role string, text string"


def brute_paths(steps, entry, exits):
    """Least (cost, audit) by relaxation over all nodes until nothing changes."""
    end = len(steps)
    best = {(0, entry): (0, "")}
    changed = True
    while changed:
        changed = False
        for (at, state), (cost, audit) in list(best.items()):
            ways = [(at, chat_repair.NEXT_TURN[state], 3, "I")]
            if at < end:
                step = steps[at]
                more = 3 if step.truncated else 0
                if step.forced:
                    ways.append((at + 1, state, 4 * step.forced, "D" * step.forced))
                else:
                    ways.append((at + 1, state, 4, "D"))
                    ways.append((at + 1, chat_repair.NEXT_TURN[state], 3 + more, "R"))
                    if step.initial == "s" and state == 0:
                        ways.append((at + 1, 1, more, "K"))
                    if step.initial == "u" and state in (0, 1, 3):
                        ways.append((at + 1, 2, more, "K"))
                    if step.initial == "a" and state == 2:
                        ways.append((at + 1, 3, more, "K"))
            for i, s, c, edit in ways:
                label = (cost + c, audit + edit)
                if (i, s) not in best or label < best[i, s]:
                    best[i, s] = label
                    changed = True
    return min((best[end, x] for x in exits if (end, x) in best), default=chat_repair.UNREACHED)


def test_heaps_that_meet_find_the_least_audit():
    for seed in range(300):
        rnd = random.Random(seed)
        steps = [
            chat_repair.Step("", rnd.randint(1, 3)) if rnd.random() < 0.2 else chat_repair.Step(rnd.choice(["s", "u", "a", ""]), 0, rnd.random() < 0.3)
            for _ in range(rnd.randint(0, 9))
        ]
        for entry in chat_repair.STATES:
            assert chat_repair.cheapest(steps, entry, chat_repair.ENDS) == brute_paths(steps, entry, chat_repair.ENDS)
            for leave in chat_repair.STATES:
                assert chat_repair.cheapest(steps, entry, (leave,)) == brute_paths(steps, entry, (leave,))


def brute_repair(rows):
    """Rows (turn, role, text), in order, to the report and the repaired lines of the whole conversation."""
    seen, steps, faults, copies = set(), [], Counter(), []
    for _, role, text in rows:
        said = text.rstrip(chat_repair.SPACES)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        copies.append(1)
        steps.append(chat_repair.Step("", 1) if fault in ("blank", "duplicate") else chat_repair.Step(role[:1], 0, fault == "truncated"))
    cost, audit = brute_paths(steps, 0, (0, 3))
    lines, state, at = [], 0, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        else:
            state = 3 if state == 2 else 2
            role = "user" if state == 2 else "assistant"
        lines.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit), lines


def odd_chats(seed, convs=12, most=14):
    rnd = random.Random(seed)
    texts = ["", " \t", "a.", "a.", "b", "c!", "Is it?\n", "é…", "x.  ", None, "long " * 30_000 + ".", "d.e", "日本."]
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(rnd.randint(1, most)):
            rows.append((conv, rnd.choice([None, *range(8)]), rnd.choice(["system", "user", "assistant", "user", "tool", "", None, "agent"]), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("segment", [2, 512])
def test_repairs_by_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(chat_repair, "SEGMENT_ROWS", segment)
    rows = odd_chats(segment)
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(40)] + [(78, 5, "user", "same.")] * 9
    df = spark.createDataFrame(rows, CHATS).select("*", F.lit(1).alias("conv"), F.lit("x").alias("said"), F.lit(3).alias("copies"))
    repaired = chat_repair.repair(df.repartition(5))
    got = {r.conv: tuple(r)[1:] for r in repaired.report.collect()}
    digests = {r.conv: r.sha256 for r in repaired.digests().collect()}
    turns = defaultdict(list)
    for r in repaired.turns().orderBy("conv", "position").collect():
        assert r.position == len(turns[r.conv])
        turns[r.conv].append((r.edit, f"{r.role}:{r.text}"))
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups["" if conv is None else f"={conv}"].append((turn, role or "", text or ""))
    assert got.keys() == groups.keys() == digests.keys()
    for name, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        report, lines = brute_repair(group)
        assert got[name] == report
        assert [line for _, line in turns[name]] == lines
        assert "".join(e for e, _ in turns[name]) == report[-1].replace("D", "")
        assert digests[name] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_one_long_conversation_is_cut_and_chained(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "SEGMENT_ROWS", 16)
    rnd = random.Random(3)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(400)]
    repaired = chat_repair.repair(spark.createDataFrame(rows, CHATS).repartition(7))
    assert repaired.segments.where("not whole").count() >= 25
    report, lines = brute_repair([r[1:] for r in rows])
    assert tuple(repaired.report.first())[1:] == report
    assert repaired.digests().first().sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_of_nothing(spark):
    repaired = chat_repair.repair(spark.createDataFrame([], CHATS))
    assert repaired.report.count() == repaired.turns().count() == repaired.digests().count() == 0
    lost = chat_repair.repair(spark.createDataFrame([(1, 0, "user", "a.")], CHATS), copies=F.lit(0))
    assert lost.report.count() == 0


def test_damaged_query_covers_lost_conversations(spark, tmp_path):
    lost = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [*odd_chats(9, convs=40, most=3), (lost, 0, "user", "gone.")]
    spark.createDataFrame(rows, CHATS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.QUERIES["op11_chat_repair"](spark, str(tmp_path)).collect()}
    groups = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            damaged = (turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            groups[conv] += [damaged] * (2 if fault == 3 else 1)
    assert got.keys() == groups.keys() and not groups[lost]
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        report, lines = brute_repair(group)
        row = got[conv]
        assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal, row.cost, row.audit) == report
        assert row.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if one_apart(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    for word, row in list(out.items()):
        root = word
        while out[root][0]:
            root = out[root][0]
        out[word] = (*row, root)
    return out


def test_band_over_a_sorted_list_by_brute_force():
    for seed in range(300):
        rnd = random.Random(seed)
        size = rnd.randint(1, 7)
        words = list({"".join(rnd.choice("abc") for _ in range(size + rnd.randint(0, 1))) for _ in range(rnd.randint(1, 60))})
        want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(a) == size <= len(b) and one_apart(a, b))
        assert sorted(spelling.near_in_block(words, size, 0, size + 1)) == want


@pytest.mark.parametrize("block", [2, 1024])
def test_spelling_groups_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rnd = random.Random(block)
    counts = {}
    for _ in range(250):
        word = "".join(rnd.choice("abé") for _ in range(rnd.choice([1, 2, 3, 6, 6, 7, 8])))
        counts[word] = rnd.choice([1, 1, 2, 5, 25, 25, 125, 700])
    counts |= {"x" * 3000: 4, "x" * 3001: 30, "x" * 1500 + "y" + "x" * 1499: 1}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("block", F.lit(1))
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling.spelling_groups(rows.repartition(6)).collect()}
    assert got == brute_groups(counts)


def test_vocabulary_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rnd = random.Random(4)
    texts = [None, "", "Klorem École ECOLE'lorems×dolor", "lorem" * 20_000, "1234567", "日本lorems日本 😀lorems"]
    texts += [" ".join(rnd.choice(["ipsumx", "Dolores", "ÀÉÎÕÜß", "consectetur"]) for _ in range(60)) for _ in range(40)]
    rows = [(None if i == 5 else i % 30, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w"))
    for drop in (None, 3):
        want = Counter()
        for name, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(c.lower() if c.isascii() else c for c in run)
                check = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
                if drop and check % drop == 0:
                    run = run[: check % len(run)] + run[check % len(run) + 1 :]
                want[run] += 1
        got = {r.word: r.n for r in spelling.vocabulary(df, drop=drop).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def test_spelling_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(spelling.vocabulary(empty)).count() == 0


def brute_spans(text):
    """All matches by plain search, then links by looking at all pairs of a scope."""
    names = "(?:password|passwd|secret|token|api_?key)"
    is_ = r"""["']?\x20*[:=]\x20*["']?"""
    parts = []
    for m in re.finditer(names + is_ + r"([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        parts.append(("assign" if len(m[1]) >= 6 else "short", *m.span()))
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        parts += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    strong = [p for p in parts if p[0] in secret_scan.STRONG]
    weak = [p for p in parts if p[0] == "short"]
    weak += [("user", *m.span()) for m in re.finditer("(?:username|user|login|account|client_?id)" + is_ + "[A-Za-z0-9._@+-]{2,}", text, re.I | re.A)]
    weak += [("opaque", *m.span()) for m in re.finditer("[A-Za-z0-9+/]{32,}", text)]
    weak += [("endpoint", *m.span()) for m in re.finditer(secret_scan.ENDPOINT, text)]
    weak = [w for w in weak if not any(b[1] < w[2] and w[1] < b[2] for b in strong)]
    borders = [m.span() for m in re.finditer(secret_scan.SCOPE_END, text)]
    found = [(*p, None) for p in strong]
    for kind, start, end in weak:
        scope = sum(b[1] <= start for b in borders)
        beside = {k for k, s, _ in strong + weak if abs(s - start) <= secret_scan.REACH and sum(b[1] <= s for b in borders) == scope}
        login, secret = bool(beside & set(secret_scan.IDENTIFIERS)), bool(beside & set(secret_scan.SECRETS))
        if {"user": secret, "short": login, "opaque": login, "endpoint": login and secret}[kind]:
            found.append((kind, start, end, scope))
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_secrets_by_brute_force(spark):
    rnd = random.Random(5)
    pieces = [
        "token = \"deadbeef\"", "Secret:abc", "secret:token:abcdef", "API_KEY='x'", "apikey=Key12345", "paſsword: abcdefg", "user: bob", "Login=ann@x.org",
        "AKIA" + "Z" * 16, "AKIA" + "Q" * 15, "xAKIAKIA" + "7" * 14, "0123456789abcdef" * 2, "f" * 23, "f" * 24 + "G", "A1b2C3d4" * 5,
        "https://db.example.com:5432/x", "ftp://h", "password", "token==abcdef", "é👍", "words and so on, ", "\n", "\n\n", "\n \n", "\n\n\n", " ", "x" * 390,
    ]
    texts = [None, "", "\n\n", "token=" + "a" * 50_000, "user: x1 " * 3000 + "\n\n" + "pw secret: abc " * 500, "user: bob" + "\n" * 9000 + " secret: abc"]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    rows = [(i % 50 or None, t, "in") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").select("*", F.lit(1).alias("number"), F.lit("k").alias("kind"))
    found = secret_scan.find_secrets(df.repartition(5))
    assert found.columns == ["doc_id", "text", "spans_in", "number", "kind", "spans"]
    got = Counter((r.text, tuple((s.kind, s.start, s.end, s.scope) for s in r.spans)) for r in found.collect())
    assert got == Counter((t, tuple(brute_spans(t or ""))) for _, t, _ in rows)
    kinds = {s[0] for t, spans in got for s in spans}
    assert kinds == set(secret_scan.KINDS)


def test_weak_parts_alone_are_none(spark):
    texts = ["user: bob went on", "secret: abc", "https://example.com/a", "A1b2C3d4" * 5, "user: bob\n\nsecret: abc", "user: bob" + " " * 500 + "secret: abc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(r.spans == [] for r in secret_scan.find_secrets(df).collect())
    linked = spark.createDataFrame([("user: bob, secret: abc at https://example.com",)], "text string")
    assert [s.kind for s in secret_scan.find_secrets(linked).first().spans] == ["user", "short", "endpoint"]


def test_secrets_of_nothing(spark):
    assert secret_scan.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
