"""Spelling variants: which words are one edit apart, and which frequent word a rare one stands for.

The method is dynamic programming over sorted word lists. A query word is laid against a sorted list; the rows of its
edit matrix (a band of three cells, as one edit moves the diagonal by one at most) are kept per letter, so the next
word of the list starts at the row where its common prefix with the last one ends. Where all cells of a row exceed one
edit, all words with that prefix are skipped.

Words meet in blocks. Two near words first differ at one place of the shorter one, of length m. That place lies
in one of the zones [0, m/2) and [m/2, m], and all letters before and behind its zone are equal in both. So a word joins
the block of each zone by the letters outside it, and a pair is reported by the one block whose zone holds its first
difference. A block of more than ``BLOCK_WORDS`` words is dealt again with its zone halved, down to one letter: then a
block holds at most as many words as two letters have values. No block is cut off, and none grows with the data.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.streams import bounds, whole_groups

LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_RATIO = 5
BLOCK_WORDS = 1024
TASK_WORDS = 50_000
HELD_WORDS = 300_000
FAR = 2
LAST = "\U0010ffff"
BLOCK_KEYS = ["block", "size", "low", "high"]

# Letters are A-Z, a-z and U+00C0 to U+00FF, which are one byte each in Latin-1; any other character becomes "?".
RUN = re.compile(rb"[a-z\xc0-\xff]+")


def _counted(drop: int | None):
    """(id, text) batches to (word, n): words of enough letters, summed as far as a task can hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            counts = pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32((name.as_py() or "").encode() + b":")
                for word in RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower()):
                    if drop and len(word) >= LEAST_LETTERS:
                        plain = word if word.isascii() else word.decode("latin-1").encode()
                        check = zlib.crc32(plain, start)
                        if check % drop == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LETTERS:
                        held[word] = held.get(word, 0) + 1
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop: int | None = None) -> DataFrame:
    """``word``, ``n``: the words of at least six letters seen at least five times in whole texts.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lowered. With ``drop``, a run loses a letter
    where ``drop`` divides the CRC-32 of ``<id>:<run>``: the place is that number modulo the run's length. Null texts have no words;
    a null id reads as empty. Texts are read whole, whatever their length; repeated rows count again.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_counted(drop), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def one_edit(query: str, words: list[str], prefixes: list[int]) -> list[int]:
    """Places of the words that are one edit from the query and at least as long as it.

    ``words`` are sorted and at most one letter longer; ``prefixes[i]`` is what words i-1 and i have in common. Row d of
    the edit matrix holds the cells d-1, d and d+1 of the query for the first d letters of the word.
    """
    size, found = len(query), []
    rows = [(FAR, 0, 1)]
    at, known = 0, 0
    while at < len(words):
        word = words[at]
        del rows[known + 1 :]
        low, mid, high = rows[known]
        depth = known
        while depth < len(word):
            letter = word[depth]
            below = min(low + (depth == 0 or query[depth - 1] != letter), mid + 1) if 0 < depth <= size else mid + 1
            same = mid + (query[depth] != letter) if depth < size else FAR
            same = min(same, high + 1, below + 1)
            above = high + (query[depth + 1] != letter) if depth + 1 < size else FAR
            above = min(above, same + 1)
            if depth >= size:
                same = above = FAR
            elif depth + 1 >= size:
                above = FAR
            low, mid, high = below, same, above
            depth += 1
            if low > 1 and mid > 1 and high > 1:
                break
            rows.append((low, mid, high))
        else:
            if (mid if len(word) == size else low) == 1:
                found.append(at)
            known = prefixes[at + 1] if at + 1 < len(words) else 0
            at += 1
            continue
        # No word that starts like this one can be near.
        following = bisect_right(words, word[:depth] + LAST, at + 1)
        if following < len(words):
            known = min(depth - 1, *prefixes[at + 1 : following + 1]) if following - at < 8 else _common(word, words[following], depth - 1)
        at = following
    return found


def _common(left: str, right: str, most: int) -> int:
    size = 0
    while size < most and size < len(right) and left[size] == right[size]:
        size += 1
    return size


def near_in_block(words: list[str], size: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Pairs (shorter or equal, other), by place in ``words``, whose first difference lies in [low, high).

    Words have ``size`` letters or one more; pairs of the longer ones belong to the next size. A pair of equal length
    comes in both orders.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    listed = [words[i] for i in order]
    prefixes = [0] + [_common(a, b, len(a)) for a, b in zip(listed, listed[1:], strict=False)]
    for place, query in zip(order, listed, strict=True):
        if len(query) == size:
            for other in one_edit(query, listed, prefixes):
                if low <= _common(query, listed[other], size) < high:
                    yield place, order[other]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, size, low, high, word, n) to (word, near, near_n), both ways."""
    for batch in whole_groups(batches, BLOCK_KEYS):
        cuts = np.unique(np.concatenate([bounds(batch.column(k).to_numpy()) for k in BLOCK_KEYS]))
        sizes, lows, highs = (batch.column(c).to_pylist() for c in ("size", "low", "high"))
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        out: list[tuple[str, str, int]] = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for a, b in near_in_block(words[lo:hi], sizes[lo], lows[lo], highs[lo]):
                a, b = lo + a, lo + b
                out.append((words[a], words[b], counts[b]))
                if len(words[b]) > len(words[a]):
                    out.append((words[b], words[a], counts[a]))
        if out:
            left, right, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(np.array(n, np.int64))], ["word", "near", "near_n"]
            )


def _block(size: Column, low: Column, high: Column) -> Column:
    """The block of a word in a zone: a hash of the zone and of the letters outside it.

    Two blocks of one zone with one hash are one larger block, whose pairs are still told by the letters.
    """
    behind = F.greatest(size - high, F.lit(0))
    return F.xxhash64(
        size,
        low,
        high,
        F.left("word", low),
        F.when(behind > 0, F.right("word", behind)).otherwise(""),
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n`` for all pairs of ``words`` (word, n; distinct words) one edit apart, both ways."""
    length = F.length("word")
    half = F.floor(F.col("size") / 2).cast("int")
    placed = words.select(
        "word", "n", F.explode(F.filter(F.array(length, length - 1), lambda s: s >= 1)).alias("size")
    )
    zones = F.array(
        F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("size") + 1).alias("high"))
    )
    dealt = placed.select("*", F.inline(F.filter(zones, lambda z: z["low"] < z["high"])))
    waiting = dealt.withColumn("block", _block(F.col("size"), F.col("low"), F.col("high")))
    done = []
    while True:
        waiting = stored(waiting, "word-blocks")
        large = waiting.where("high - low > 1").groupBy("block").count().where(F.col("count") > BLOCK_WORDS).select("block")
        if large.isEmpty():
            done.append(waiting)
            break
        large = stored(large, "large-word-blocks")
        done.append(waiting.join(large, "block", "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))
        )
        split = waiting.join(large, "block", "left_semi").select("word", "n", "size", F.inline(halves))
        waiting = split.withColumn("block", _block(F.col("size"), F.col("low"), F.col("high")))
    blocks = done[0]
    for more in done[1:]:
        blocks = blocks.unionByName(more)
    meeting = blocks.select(*BLOCK_KEYS, "word", "n")
    tasks = 1 + meeting.count() // TASK_WORDS  # the searches cost far more than their bytes tell adaptive execution
    meeting = meeting.repartition(tasks, "block").sortWithinPartitions(*BLOCK_KEYS)
    return meeting.mapInArrow(_near, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where the chain of forms (word, form) ends. Chains must not be circular.

    Every round doubles the length of the steps, so the rounds are the logarithm of the longest chain.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = state.join(onward, "root", "left")
        if joined.where(F.col("beyond").isNotNull()).isEmpty():
            return state
        state = stored(joined.select("word", F.coalesce("beyond", "root").alias("root")), "word-roots")


def spelling_groups(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of a vocabulary (word, n).

    Near words differ by one inserted, deleted or replaced letter. A word's form is its near word of largest n (ties: the
    least in code-point order), if that n is at least five times the word's; else null. As n grows along forms, chains end;
    the root is their end, the word itself without a form. A word without near words has ``n_near`` 0; an empty table gives no rows.
    """
    words = stored(words.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    best = near_words(words).groupBy("word").agg(
        F.count("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    counted = words.join(best, "word", "left")
    takes = -F.col("best.less") >= FORM_RATIO * F.col("n")
    counted = stored(
        counted.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"),
            F.when(takes, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    ends = roots(counted.where("form is not null"))
    return counted.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
