"""N-gram Jaccard components: which documents hang together by shingle sets that are similar enough, exactly.

Only components are computed, not all links: a pair is verified only while its documents are in different
components, so most links inside a group are never looked at, and none are returned.

A document's set holds its distinct runs of five words as 58-bit tokens. Sets that are similar enough share a token
among the first ``n - ceil(t n) + 1`` of each, the prefix, in one global order, so prefix tokens decide which sets
meet. The order is rare before frequent: how many sets hold a token is counted over all tokens, by a shuffle of sorted and
difference-coded slots that go to the counts of their slice and come back to their block (``shared_prefixes``). A token that only one set holds meets
nothing; a set with enough of them has no prefix to offer and is done.

Where sets meet, they are compared by a prefix-tree join: the
ordered sets form a tree in which equal beginnings are one path, a set walks down the tree, overlaps
are counted once per shared path, and subtrees are left as soon as the lengths that remain cannot
reach the overlap needed.

Work follows links, not pairs. Equal sets are one class. Classes first meet only one class, drawn by hash,
for each of the eight smallest tokens of their set; what that links is one component. Then only tokens
that occur in several components are looked at, and only pairs from different components, which a bit
signature of the whole set may rule out for certain before sets are moved: first the closest pair for each
class and smallest token, which joins what a drawn class missed, then all pairs that share a prefix token,
which makes the result exact. So a group of copies is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import ROW, field, null_safe, packed, stored, text_or_empty, unpacked
from plumbline.llm.components import components
from plumbline.llm.hashing import TOKEN_BITS, WordHasher, draws, mix, text_slices
from plumbline.llm.streams import binary, bounds, whole_groups

SHINGLE_WORDS = 5
PERCENT = 80
TEXT_BUCKETS = 1 << 20  # rows of the broadcast text filter at most; for more texts than a quarter of it a join takes over
STAR_TOKENS = 8
BLOCK = 512  # sets of one meeting that are compared in one place
TREE_SETS = 64  # sets in one tree
PAIRS_AT_ONCE = 1 << 20
NOTE_BYTES = 64  # of a signature that travels with a token
SLICE_TOKENS = 1 << 22  # tokens counted in one place
BLOCK_TOKENS = 1 << 21  # tokens of a task that are sent together
BLOCK_SETS = 1 << 16


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-(n + m) * percent // (100 + percent))


def _sets(column: pa.Array, hasher: WordHasher, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct tokens, ascending) for every text with words."""
    for first, data, offsets in text_slices(column):
        tokens, owner = hasher.shingles(data, offsets, width)
        at = bounds(owner)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi > lo:
                one = np.sort(tokens[lo:hi])
                keep = np.ones(len(one), bool)
                keep[1:] = one[1:] != one[:-1]
                yield first + int(owner[lo]), one[keep]


_SALT = draws(3, 1)[0]


def _class(tokens: np.ndarray) -> int:
    """The name of a set: equal sets have equal names."""
    total = mix(tokens ^ _SALT).sum(dtype=np.uint64)
    return int((mix(np.array([total ^ np.uint64(len(tokens))])) >> np.uint64(1))[0])


def _signature(tokens: np.ndarray) -> bytes:
    """Parities of the tokens per place, in one to two places per token.

    Two sets differ at least as often as their parities; few differences hide each other.
    """
    places = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount(tokens & np.uint64(places - 1), minlength=places) & 1 > 0).tobytes()


def _described(texts: DataFrame, width: int) -> DataFrame:
    """Per text: n, class, and once per class and task its signature, a short form of it, and its smallest tokens."""
    kinds = dict(texts.dtypes)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            rows = batch.num_rows
            sizes, names = [0] * rows, [None] * rows
            signs, notes, smallest = ([None] * rows for _ in range(3))
            for row, one in _sets(batch.column("norm"), hasher, width):
                name = _class(one)
                sizes[row], names[row] = len(one), name
                if name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                signs[row] = _signature(one)
                notes[row] = _folded(np.frombuffer(signs[row], np.uint8)[None], NOTE_BYTES).tobytes()
                smallest[row] = one[:STAR_TOKENS].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k_id"),
                    batch.column("k_text"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(signs, pa.binary()),
                    pa.array(notes, pa.binary()),
                    pa.array(smallest, pa.list_(pa.int64())),
                ],
                ["k_id", "k_text", "n", "class", "sign", "note", "smallest"],
            )

    return texts.mapInArrow(
        describe,
        f"k_id {kinds['k_id']}, k_text bigint, n bigint, class bigint, sign binary, note binary, smallest array<bigint>",
    )


def _packed_slots(slots: np.ndarray, owners: np.ndarray) -> bytes:
    """Ascending slots as differences, byte by byte (the upper bytes are mostly zero and compress away), and their owners."""
    steps = np.diff(slots, prepend=np.uint64(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes() + owners.astype("<u2").tobytes()


def _unpacked_slots(data: memoryview, tail: int = 0) -> tuple[np.ndarray, ...]:
    """Slots, owners and, with a ``tail`` of 1, a byte each."""
    count = len(data) // (6 + tail)
    steps = np.frombuffer(data, np.uint8, 4 * count).reshape(4, -1).T.copy().view("<u4").ravel()
    owners = np.frombuffer(data, "<u2", count, 4 * count)
    more = (np.frombuffer(data, np.uint8, count, 6 * count),) if tail else ()
    return np.cumsum(steps.astype(np.uint64)), owners, *more


def _level(count: np.ndarray) -> np.ndarray:
    """How often, in a byte: exact to 200, one more for each doubling beyond."""
    return np.where(count <= 200, count, 200 + np.floor(np.log2(np.maximum(count, 1) / 200.0))).clip(0, 255).astype(np.uint8)


def shared_prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(class, n, first, prefix): the tokens of each set's prefix that other sets hold too, rare before frequent.

    ``first`` is how many tokens of the set come before them, as nothing else holds these. Sets whose prefix is all their own
    have no row. A class has a row per task that met it. Tokens are cut to so many bits that few of them meet by chance, whatever the
    number of tokens; a chance meeting costs a comparison, not a wrong link.
    """
    chars = texts.agg(F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()[0]
    bits = max(1, int(chars // 4).bit_length())  # about as many tokens or more
    slot_bits = min(TOKEN_BITS, bits + 6)
    slice_bits = max(0, bits - SLICE_TOKENS.bit_length() + 1)
    drop, inside = np.uint64(TOKEN_BITS - slot_bits), np.uint64(slot_bits - slice_bits)
    slices = 1 << slice_bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, number = WordHasher(), set(), TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        names: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(h) for h in held])
            slots = np.concatenate(held) >> drop
            owners = np.repeat(np.arange(len(held)), sizes)
            order = np.argsort(slots, kind="stable")
            slots, owners = slots[order], owners[order]
            cuts = np.searchsorted(slots, np.arange(slices + 1, dtype=np.uint64) << inside)
            known = np.array(names, "<i8").tobytes() + sizes.astype("<i4").tobytes()
            rows = [(number % slices, number, True, known)]
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                run = slice(cuts[part], cuts[part + 1])
                rows.append((part, number, False, _packed_slots(slots[run] - (np.uint64(part) << inside), owners[run])))
            held.clear()
            names.clear()
            types = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["slice", "block", "named", "data"])

        for batch in batches:
            for _, one in _sets(batch.column(0), hasher, width):
                name = _class(one)
                if name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                held.append(one)
                names.append(name)
                size += len(one)
                if size >= BLOCK_TOKENS or len(held) == BLOCK_SETS:
                    yield block()
                    number, size = number + 1, 0
        if held:
            yield block()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["slice"]):
            parts = group.column("slice").to_numpy()
            for lo, hi in zip((at := bounds(parts))[:-1], at[1:], strict=True):
                told = group.column("named").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                blocks = group.column("block").to_numpy()[lo:hi]
                known = np.flatnonzero(told)
                lists = [_unpacked_slots(binary(group.column("data"), lo + i)) for i in np.flatnonzero(~told)]
                of = np.repeat(blocks[~told], [len(x[0]) for x in lists])
                names, data = blocks[known].tolist(), [bytes(binary(group.column("data"), lo + i)) for i in known]
                flags = [True] * len(names)
                if lists:
                    slots, owners = (np.concatenate([x[k] for x in lists]) for k in range(2))
                    order = np.argsort(slots, kind="stable")
                    slots, owners, of = slots[order], owners[order], of[order]
                    starts = bounds(slots)
                    many = np.diff(starts)
                    level = np.repeat(_level(many), many)
                    shared = np.repeat(many > 1, many)
                    slots, owners, of, level = slots[shared], owners[shared], of[shared], level[shared]
                    order = np.argsort(of, kind="stable")  # slots stay ascending inside a block
                    slots, owners, of, level = slots[order], owners[order], of[order], level[order]
                    front = np.uint64(parts[lo]) << inside
                    for a, b in zip((cut := bounds(of))[:-1], cut[1:], strict=True):
                        names.append(int(of[a]))
                        data.append(int(front).to_bytes(8, "little") + _packed_slots(slots[a:b], owners[a:b]) + level[a:b].tobytes())
                        flags.append(False)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(flags, pa.bool_()), pa.array(data, pa.binary())], ["block", "named", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["block"]):
            told = group.column("named").to_numpy(zero_copy_only=False)
            for lo, hi in zip((at := bounds(group.column("block").to_numpy()))[:-1], at[1:], strict=True):
                known = binary(group.column("data"), lo + int(np.flatnonzero(told[lo:hi])[0]))
                sets = len(known) // 12
                names, sizes = np.frombuffer(known, "<i8", sets), np.frombuffer(known, "<i4", sets, 8 * sets).astype(np.int64)
                found = []
                for i in (lo + np.flatnonzero(~told[lo:hi])).tolist():
                    data = binary(group.column("data"), i)
                    slots, owners, level = _unpacked_slots(data[8:], 1)
                    found.append((slots + np.uint64(int.from_bytes(data[:8], "little")), owners, level))
                if not found:
                    continue
                slots, owners, level = (np.concatenate([f[k] for f in found]) for k in range(3))
                order = np.lexsort((slots, level, owners))
                slots, owners = slots[order].astype(np.int64), owners[order]
                own = sizes - np.bincount(owners, minlength=sets)
                wanted = sizes - -(-percent * sizes // 100) + 1 - own  # shared tokens of the prefix
                rank = np.arange(len(owners)) - np.searchsorted(owners, owners)
                keep = rank < wanted[owners]
                counts = np.bincount(owners[keep], minlength=sets)
                rows = np.flatnonzero(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts[rows])].astype(np.int32)), pa.array(slots[keep]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[rows]), pa.array(sizes[rows]), pa.array(own[rows]), lists], ["class", "n", "first", "prefix"]
                )

    asked = texts.select("norm").mapInArrow(ask, "slice int, block bigint, named boolean, data binary")
    counted = asked.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(count, "block bigint, named boolean, data binary")
    return counted.repartition(slices, "block").sortWithinPartitions("block").mapInArrow(
        answer, "class bigint, n bigint, first bigint, prefix array<bigint>"
    )


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, with a text of each) that are linked, by a prefix-tree join around each b."""
    # one text per class is read again; which ones is told by a filter of bounded size, or by a join where it would pass most
    chosen = pairs.select(F.explode(F.array("a_text", "b_text")).alias("k_text")).distinct()
    if 4 * chosen.count() <= TEXT_BUCKETS:
        buckets = chosen.select(F.pmod("k_text", F.lit(TEXT_BUCKETS)).alias("bucket")).distinct()
        again = texts.withColumn("bucket", F.pmod("k_text", F.lit(TEXT_BUCKETS))).join(
            F.broadcast(buckets), "bucket", "left_semi"
        )
    else:
        again = texts.join(chosen, "k_text", "left_semi")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            names, values = [], []
            for _, one in _sets(batch.column("norm"), hasher, width):
                name = _class(one)
                if name not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    values.append(one.tobytes())
                if len(values) >= 256:
                    yield _set_rows(names, values)
                    names, values = [], []
            yield _set_rows(names, values)

    sets = stored(again.select("norm").mapInArrow(rebuild, "class bigint, tokens binary").dropDuplicates(["class"]), "sets")
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TREE_SETS).alias("trees"))
    placed = pairs.join(sizes, "b").withColumn("tree", F.pmod(F.xxhash64("a"), F.col("trees"))).select("a", "b", "tree")
    members = placed.join(sets.withColumnRenamed("class", "a"), "a").select("b", "tree", F.col("a"), "tokens")
    walkers = (
        placed.select("b", "tree").distinct().join(sets.withColumnRenamed("class", "b"), "b")
        .select("b", "tree", F.lit(None).cast("long").alias("a"), "tokens")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["b", "tree"]):
            hubs = batch.column("b").to_numpy()
            trees = batch.column("tree").to_numpy()
            names = batch.column("a").to_pylist()
            edges = np.flatnonzero((hubs[1:] != hubs[:-1]) | (trees[1:] != trees[:-1])) + 1
            left, right = [], []
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(hubs)], strict=True):
                values = [np.frombuffer(binary(batch.column("tokens"), i), np.uint64) for i in range(lo, hi)]
                if names[lo] is not None:
                    continue  # the set of b is gone: not a class of this input
                tree = PrefixTree(values[1:], names[lo + 1 : hi], percent)
                found = tree.linked(values[0])
                left += found
                right += [int(hubs[lo])] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    together = members.unionByName(walkers).repartition("b", "tree").sortWithinPartitions(
        "b", "tree", F.col("a").asc_nulls_first()
    )
    return together.mapInArrow(walk, "a bigint, b bigint")


def _set_rows(names: list[int], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.binary())], ["class", "tokens"])


class PrefixTree:
    """Ordered sets as a tree: sets that begin alike share the path of their common beginning.

    The tree is kept as the sorted sequences and the lengths of their common beginnings; a node is a
    run of sequences, its path the beginning they share.
    """

    def __init__(self, sets: list[np.ndarray], names: list[int], percent: int) -> None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in order]
        self.names = [names[i] for i in order]
        self.percent = percent
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.common = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.common[i] = differ[0] if len(differ) else n

    def linked(self, walker: np.ndarray) -> list[int]:
        """Names of the sets similar enough to the walker."""
        found: list[int] = []
        if not self.sets:
            return found
        todo = [(0, len(self.sets), 0, 0)]
        while todo:
            lo, hi, depth, overlap = todo.pop()
            end = int(self.sizes[lo]) if hi - lo == 1 else int(self.common[lo + 1 : hi].min())
            sizes = self.sizes[lo:hi]
            # before the path is compared: nothing below can have more than what remains on both sides
            if not self._possible(sizes, depth, overlap, walker, self.sets[lo][depth - 1] if depth else None):
                continue
            path = self.sets[lo][depth:end]
            overlap += _shared(path, walker)
            if hi - lo == 1:
                if overlap >= needed(end, len(walker), self.percent):
                    found.append(self.names[lo])
                continue
            if end and not self._possible(sizes, end, overlap, walker, self.sets[lo][end - 1]):
                continue
            splits = lo + 1 + np.flatnonzero(self.common[lo + 1 : hi] == end)
            for a, b in zip(np.r_[lo, splits], np.r_[splits, hi], strict=True):
                todo.append((int(a), int(b), end, overlap))
        return found

    def _possible(self, sizes: np.ndarray, depth: int, overlap: int, walker: np.ndarray, last) -> bool:
        ahead = len(walker) - (int(np.searchsorted(walker, last, "right")) if last is not None else 0)
        best = overlap + np.minimum(sizes - depth, ahead)
        return bool((best >= needed(sizes, len(walker), self.percent)).any())


def _shared(path: np.ndarray, walker: np.ndarray) -> int:
    if not len(path) or not len(walker):
        return 0
    at = np.searchsorted(walker, path)
    at[at == len(walker)] = 0
    return int((walker[at] == path).sum())


def _stars(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class and the class drawn for one of its smallest tokens; linear in the classes.

    Similar sets mostly have the same smallest tokens, whatever is rare in one of them. Each token draws
    anew, so that a class that misses one hub of its group meets another.
    """
    keys = classes.select("class", "n", F.explode("smallest").alias("token"))
    drawn = F.struct(F.xxhash64("class", "token").alias("draw"), "class", "n")
    hubs = keys.groupBy("token").agg(F.min(drawn).alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    # written before the join, which then can split a token that very many classes share
    hubs = stored(hubs.select("token", "hub.class", "hub.n").toDF("token", "b", "m"), "hubs")
    met = keys.join(hubs, "token").where(F.col("class") != F.col("b"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return _plausible(met.where(fits).select(F.col("class").alias("a"), "b").distinct(), classes, percent)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out, with the hash of a text of each."""
    signs = classes.select("class", "n", "sign", "k_text").dropDuplicates(["class"])
    both = pairs.join(signs.toDF("a", "n", "sign", "a_text"), "a").join(signs.toDF("b", "m", "b_sign", "b_text"), "b")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = _Signatures(pa.concat_arrays([batch.column("sign"), batch.column("b_sign")]))
            rows = np.arange(batch.num_rows)
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            keep = signatures.differ(rows, rows + len(rows)) <= n + m - 2 * needed(n, m, percent)
            chosen, names = pa.array(np.flatnonzero(keep)), ["a", "b", "a_text", "b_text"]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(chosen) for c in names], names)

    return both.mapInArrow(possible, "a bigint, b bigint, a_text bigint, b_text bigint")


def _crossing(sets: DataFrame, notes: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs from different components that share one of the tokens of ``sets`` and that no bound rules out.

    ``sets`` has (class, n, comp, first, tokens): the tokens, in the global order, from place ``first`` of the set on. ``notes`` has
    the short signature (note) of each class. With ``best_only``, each meeting gives a class only its closest partner.

    Only tokens of several components go on, told exactly by their counts.
    """
    tokens = sets.select("class", "n", "comp", "first", F.posexplode("tokens").alias("at", "token"))
    tokens = tokens.select("token", (F.col("first") + F.col("at")).cast("int").alias("position"), "class", "comp", F.col("n").cast("int"))
    by_comp = tokens.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("sets"))
    met = (
        by_comp.groupBy("token")
        .agg(F.max(F.struct("sets", "comp")).alias("top"), F.sum("sets").alias("sets"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1")
        .select("token", F.col("top.comp").alias("top"), F.col("top.sets").alias("top_sets"), "sets")
    )
    # written before the join, which then can split a token that very many sets share
    met = stored(met, "crossing-tokens")
    postings = stored(tokens.join(met, "token"), "crossing-postings")
    noted = postings.join(notes.select("class", "note").dropDuplicates(["class"]), "class")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["token", "i", "j"]):
            for left, right in _meetings(batch, percent, best_only):
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return (
        _dealt(noted)
        .repartition("token", "i", "j")
        .sortWithinPartitions("token", "i", "j", "comp")
        .mapInArrow(meet, "a bigint, b bigint")
        .distinct()
    )


def _dealt(postings: DataFrame) -> DataFrame:
    """Postings with their meetings (token, i, j); most tokens are one meeting.

    A token with very many sets is met in blocks. Its largest component is never met with itself: a block
    of it (j) only meets the blocks of the other sets (i < 0), and those meet each other (0 <= i <= j).
    ``side`` tells which rows of a meeting of two blocks belong together.
    """
    top_blocks = F.ceil(F.col("top_sets") / BLOCK)
    rest_blocks = F.ceil((F.col("sets") - F.col("top_sets")) / BLOCK)
    one = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("side"))
    draw = F.xxhash64("class")
    top_block, block = F.pmod(draw, top_blocks), F.pmod(draw, rest_blocks)

    def blocks(count: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), count - 1)

    of_top = F.transform(
        blocks(rest_blocks), lambda r: F.struct((-1 - r).alias("i"), top_block.alias("j"), F.lit(-1).cast("long").alias("side"))
    )
    with_top = F.transform(
        blocks(top_blocks), lambda t: F.struct((-1 - block).alias("i"), t.alias("j"), F.lit(0).cast("long").alias("side"))
    )
    with_rest = F.transform(
        blocks(rest_blocks),
        lambda r: F.struct(F.least(block, r).alias("i"), F.greatest(block, r).alias("j"), block.alias("side")),
    )
    meetings = (
        F.when(F.col("sets") <= BLOCK, F.array(one))
        .when(F.col("comp") == F.col("top"), of_top)
        .otherwise(F.concat(with_top, with_rest))
    )
    kept = ["token", "position", "class", "comp", "n", "note"]
    return postings.select(*kept, F.explode(meetings).alias("meeting")).select(*kept, "meeting.*")


def _meetings(batch: pa.RecordBatch, percent: int, best_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class pairs of whole meetings that may be linked, larger name first; rows are sorted by component."""
    col = {c: batch.column(c).to_numpy() for c in ("token", "position", "i", "j", "side", "class", "comp", "n")}
    col["n"] = col["n"].astype(np.int64)
    rows = batch.num_rows
    new = np.ones(rows, bool)
    new[1:] = (
        (col["token"][1:] != col["token"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
    )
    start = np.flatnonzero(new)
    first = np.repeat(start, np.diff(np.r_[start, rows]))
    new[1:] |= col["comp"][1:] != col["comp"][:-1]
    start = np.flatnonzero(new)
    before = np.repeat(start, np.diff(np.r_[start, rows])) - first  # rows of the meeting in earlier components
    signs = _Signatures(batch.column("note"))
    row, done = 0, np.r_[0, np.cumsum(before)]
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(done, done[row] + PAIRS_AT_ONCE)) - 1)
        stop = min(stop, rows)
        count = before[row:stop]
        right = np.repeat(np.arange(row, stop), count)
        left = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[right]
        row = stop
        across = col["i"][left] != col["j"][left]
        n, m = col["n"][left], col["n"][right]
        need = needed(n, m, percent)
        keep = ~across | (col["side"][left] != col["side"][right])
        # where this token is the first they share, no more than what follows it can be shared
        keep &= np.minimum(n - col["position"][left], m - col["position"][right]) >= need
        left, right, n, m, need = left[keep], right[keep], n[keep], m[keep], need[keep]
        differ = signs.differ(left, right)
        keep = differ <= n + m - 2 * need
        differ = differ[keep]
        left, right = left[keep], right[keep]
        if best_only and len(left):
            one, other, apart = np.r_[left, right], np.r_[right, left], np.r_[differ, differ]
            order = np.lexsort((col["class"][other], apart, one))
            order = order[bounds(one[order])[:-1]]
            left, right = one[order], other[order]
        a, b = col["class"][left], col["class"][right]
        if len(a):
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            yield pairs[0], pairs[1]


class _Signatures:
    """Signatures of a batch, by their length."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)
        self.power = np.log2(np.diff(offsets)).astype(np.int64)
        self.present = self.power >= 3  # a set of any size has eight bytes at least
        self.slot = np.zeros(len(column), np.int64)
        self.rows = {}
        for power in np.unique(self.power):
            of = np.flatnonzero(self.power == power)
            self.slot[of] = np.arange(len(of))
            self.rows[int(power)] = data[offsets[of][:, None] + np.arange(1 << power)]

    def differ(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A lower bound on how many tokens each pair of sets does not share."""
        out = np.zeros(len(left), np.int64)
        both = np.stack([self.power[left], self.power[right]])
        for p, q in np.unique(both, axis=1).T:
            of = np.flatnonzero((both[0] == p) & (both[1] == q))
            size = 1 << min(p, q)
            step = max(1, (1 << 24) >> max(p, q))
            for lo in range(0, len(of), step):
                some = of[lo : lo + step]
                a = _folded(self.rows[int(p)][self.slot[left[some]]], size)
                b = _folded(self.rows[int(q)][self.slot[right[some]]], size)
                out[some] = np.bitwise_count(a ^ b).sum(axis=1)
        return out


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Signatures halved to ``size`` bytes: a place of the half has the parity of both its places."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _grouped(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """(k_id, k_text, n, class, comp, low): per row its class, component and the component's lowest row."""
    texts = packed(docs).select(
        field(id_col).alias("k_id"), F.xxhash64(field(text)).alias("k_text"), text_or_empty(field(text)).alias("norm")
    )
    described = stored(_described(texts, width), "ngram-sets")
    classes = described.where(F.col("sign").isNotNull()).select("class", "n", "k_text", "sign", "note", "smallest")
    pairs = stored(_stars(classes, percent), "pairs")
    links = stored(_verified(pairs, texts, width, percent), "links")
    smallest = classes.select("class", "n", F.lit(0).alias("first"), F.col("smallest").alias("tokens")).dropDuplicates(["class"])
    prefixes = shared_prefixes(texts, width, percent).withColumnRenamed("prefix", "tokens").dropDuplicates(["class"])
    for sets, best_only in ((smallest, True), (prefixes, False)):
        labels = components(links)
        labelled = sets.join(labels, F.col("class") == F.col("node"), "left").select(
            "class", "n", "first", "tokens", F.coalesce("component", "class").alias("comp")
        )
        found = _crossing(stored(labelled, "labelled-sets"), classes, percent, best_only)
        pairs = stored(_plausible(found, classes, percent), "pairs")
        links = stored(links.unionByName(_verified(pairs, texts, width, percent)), "links")
    labels = stored(components(links), "labels")
    named = described.select("k_id", "k_text", "n", "class").join(labels, F.col("class") == F.col("node"), "left").select(
        "k_id", "k_text", "n", "class", F.coalesce("component", "class").alias("comp")
    )
    row = F.struct(F.col("k_id").isNull().alias("nameless"), "k_id", "k_text")
    lowest = named.where("comp is not null").groupBy("comp").agg(F.min(row).alias("low"))
    return named.join(lowest, "comp", "left")


def ngram_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``class_id``.

    Words are runs of anything but space, tab and line ends, A-Z lower-cased; a document with fewer
    than ``width`` words is one shingle of all its words. Documents link when 100 * intersection >=
    ``percent`` * union of their sets; a component's id is its smallest document id. Rows with equal
    ``class_id`` have equal sets. A document without words or text has 0 shingles, a null class and is
    alone. A null id takes part but names a component only if nothing else can. Repeated rows keep one
    row each; other columns are ignored; an empty table gives no rows.

    Sets are named by 63-bit and shingles by 58-bit hashes: the chance of any mix-up among a billion
    classes is about one in twenty.
    """
    return _grouped(docs, id_col, text, width, percent).select(
        F.col("k_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("k_id")).otherwise(F.col("low.k_id")).alias("component_id"),
        F.col("class").alias("class_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each component stays, the one with the smallest id (null last), with all its columns.

    Documents without words are no copies of anything: all stay.
    """
    found = _grouped(docs, id_col, text, width, percent)
    stay = found.where(
        F.col("comp").isNull()
        | (F.col("k_id").eqNullSafe(F.col("low.k_id")) & (F.col("k_text") == F.col("low.k_text")))
    ).select("k_id", "k_text", F.col("comp").isNull().alias("wordless")).distinct()
    rows = packed(docs).select(ROW, field(id_col).alias("k_id"), F.xxhash64(field(text)).alias("k_text"))
    kept = rows.alias("d").join(
        stay.alias("k"), null_safe([F.col("d.k_id"), F.col("d.k_text")], [F.col("k.k_id"), F.col("k.k_text")])
    ).select(ROW, "d.k_id", "d.k_text", "wordless")
    nth = F.row_number().over(Window.partitionBy("k_id", "k_text").orderBy("wordless"))
    kept = kept.withColumn("nth", nth).where(F.col("wordless") | (F.col("nth") == 1))
    return kept.select(*unpacked(kept, docs.columns, []))
