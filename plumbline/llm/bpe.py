"""BPE encoding and decoding with a vocabulary file of a public tokenizer.

A text is cut at the special tokens, normalised, and cut into words by the file's pattern. A word's
symbols form a doubly linked list; possible merges wait in a priority queue by rank, then place, and
entries whose symbols have changed meanwhile are skipped. Many new words of equal length are merged beside
each other in numpy: in each round every word takes its first merge by rank, then place. Decoding joins
vocabulary strings.

The vocabulary is read on the driver and broadcast (its size is that of the file). Each Python worker
remembers the words it has encoded, in two generations of bounded size. Several texts are cut at once by
the kinds of their characters, and each distinct word among them is looked up once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import ROW, field, packed, text_or_empty, unpacked

# the pattern whose words follow from the kinds of characters; files with another one are cut text by text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SYMBOL, LETTER, NUMBER, SPACE = range(4)
REMEMBERED_WORDS = 160_000
ROWS_AT_ONCE = 512
CHARS_AT_ONCE = 1 << 21
# fewer words of one length than this, or longer ones, go through the queue one by one
EQUAL_WORDS, EQUAL_BYTES = 64, 32
NO_MERGE = np.iinfo(np.int64).max


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the driver's machine keeps a vocabulary file of a public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for byte in range(256):
        if byte in prints:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def character_kinds() -> bytes:
    """Symbol, letter, number or white space, for each code point."""
    kinds = np.full(0x110000, SYMBOL, np.uint8)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (SPACE, "White_Space")):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            kinds[points[run.start()] : points[run.end() - 1] + 1] = kind
    return kinds.tobytes()


def load_vocabulary(path: str) -> dict:
    """What encoding needs from a tokenizer file, as plain values.

    The file has to describe the scheme this module implements: NFC, white space to one space, lower case,
    a pattern whose matches are the words, byte alphabet, BPE with a word end.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
    cut, level = spec["pre_tokenizer"]["pretokenizers"]
    if (
        model["type"] != "BPE"
        or steps != ["NFC", "Replace", "Lowercase"]
        or (cut["type"], cut["behavior"], cut["invert"]) != ("Split", "Removed", True)
        or level["type"] != "ByteLevel"
        or level["add_prefix_space"]
        or level["use_regex"]
        or spec["decoder"] is not None
        or model["continuing_subword_prefix"]
    ):
        raise ValueError(f"{path} describes another scheme")
    ids = model["vocab"]
    end = model["end_of_word_suffix"] or ""
    merges = {}
    for rank, (left, right) in enumerate(model["merges"]):
        merges[ids[left] << 20 | ids[right]] = rank << 20 | ids[left + right]
    strings = {i: s for s, i in ids.items()}
    strings |= {t["id"]: t["content"] for t in spec["added_tokens"]}
    return {
        "inner": [ids[c] for c in byte_alphabet()],
        "last": [ids[c + end] for c in byte_alphabet()],
        "merges": merges,
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "strings": [strings.get(i, "").encode() for i in range(max(strings) + 1)],
        "pattern": cut["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"),
        "kinds": character_kinds() if cut["pattern"]["Regex"] == PATTERN else None,
    }


def merge_symbols(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merges neighbours by rank until none is left that the table knows."""
    count = len(symbols)
    queue = []
    for at in range(count - 1):
        entry = merges.get(symbols[at] << 20 | symbols[at + 1])
        if entry is not None:
            queue.append((entry, at))
    if not queue:
        return symbols
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    heapq.heapify(queue)
    while queue:
        entry, at = heapq.heappop(queue)
        here = symbols[at]
        if here < 0:
            continue  # merged into its left neighbour meanwhile
        right = after[at]
        if right >= count or merges.get(here << 20 | symbols[right]) != entry:
            continue  # one of the two has changed meanwhile
        merged = entry & 0xFFFFF
        symbols[at] = merged
        symbols[right] = -1
        following = after[at] = after[right]
        if following < count:
            before[following] = at
            entry = merges.get(merged << 20 | symbols[following])
            if entry is not None:
                heapq.heappush(queue, (entry, at))
        left = before[at]
        if left >= 0:
            entry = merges.get(symbols[left] << 20 | merged)
            if entry is not None:
                heapq.heappush(queue, (entry, left))
    return [s for s in symbols if s >= 0]


def _lowered(text: str) -> str:
    if not text.isascii():
        # lower() knows a final sigma; the library lower-cases letter by letter
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Codec:
    """Encodes and decodes with the tables of :func:`load_vocabulary`; lives in a worker."""

    def __init__(self, tables: dict) -> None:
        self.tables = tables
        self.words = regex.compile(tables["pattern"])
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in tables["special"]) + ")")
        # kept with the broadcast tables, so that a worker's next task finds them
        self.kinds = None if tables["kinds"] is None else np.frombuffer(tables["kinds"], np.uint8)
        self.inner, self.last = np.array(tables["inner"]), np.array(tables["last"])
        pairs = np.array([*tables["merges"].items()], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0].argsort()]
        self.pairs, self.entries = pairs[:, 0].copy(), pairs[:, 1].copy()
        # first merges of neighbouring bytes, inside a word and at its end
        self.inside = self._merges(self.inner[:, None], self.inner[None, :])
        self.ending = self._merges(self.inner[:, None], self.last[None, :])
        self.young, self.old = tables.setdefault("young", {}), tables.setdefault("old", {})

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return b"".join(self._plain(text))
        out = []
        for piece in self.special.split(text):
            found = self.tables["special"].get(piece)
            out += [found.to_bytes(4, "little")] if found is not None else self._plain(piece)
        return b"".join(out)

    def encode_rows(self, texts: list[str]) -> list[bytes]:
        """What :meth:`encode` gives for each text."""
        out: list[bytes] = [b""] * len(texts)
        some, size = [], 0
        for at, text in enumerate(texts):
            if self.kinds is None or "<|" in text or len(text) > CHARS_AT_ONCE:
                out[at] = self.encode(text)
                continue
            some.append(at)
            size += len(text)
            if size > CHARS_AT_ONCE or len(some) == ROWS_AT_ONCE:
                self._together(texts, some, out)
                some, size = [], 0
        if some:
            self._together(texts, some, out)
        return out

    def decode(self, ids: bytes) -> bytes:
        """Vocabulary strings in UTF-8, joined as the library joins them without a decoder: by spaces."""
        strings = self.tables["strings"]
        return b" ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def _together(self, texts: list[str], some: list[int], out: list[bytes]) -> None:
        lowered = [_lowered(texts[at]) for at in some]
        joined = "\n".join([*lowered, ""])
        points, data = np.frombuffer(joined.encode("utf-32-le"), "<u4"), joined.encode()
        first = np.flatnonzero(self._starts(points)).astype(np.int32)
        offsets = first
        if len(data) > len(points):
            widths = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000) + 1
            offsets = np.cumsum(widths, dtype=np.int32)[first] - widths[first]
        offsets = np.append(offsets, np.int32(len(data)))
        pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        words, codes = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        ids = list(map(self.young.get, words))
        new: dict[int, list[int]] = {}
        for at, known in enumerate(ids):
            if known is None:
                word = words[at]
                known = b"" if self.kinds[ord(word[0])] == SPACE else self.old.get(word)
                if known is None:
                    new.setdefault(len(word.encode()), []).append(at)
                else:
                    ids[at] = self._remembered(word, known)
        for length, places in new.items():
            equal = [words[at] for at in places]
            alone = len(equal) < EQUAL_WORDS or length > EQUAL_BYTES
            for at, found in zip(places, map(self._word, equal) if alone else self._words(equal), strict=True):
                ids[at] = found
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        counts = sizes[codes]
        ends = np.cumsum(counts, dtype=np.int32)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[codes] - ends + counts
        tokens = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1], dtype=np.int32) + np.repeat(shift, counts)]
        # a text begins after the line end of the one before; white space has no tokens
        begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        bounds = np.append(0, ends)[np.searchsorted(first, begins)].tolist()
        for at, lo, hi in zip(some, bounds, bounds[1:], strict=False):
            out[at] = tokens[lo:hi].tobytes()

    def _starts(self, points: np.ndarray) -> np.ndarray:
        """Where a word of the pattern, or white space, begins; the last code point is a line end."""
        kinds = self.kinds[points]
        starts = kinds == NUMBER
        starts[0] = True
        starts[1:] |= kinds[1:] != kinds[:-1]
        # an apostrophe that opens its run of symbols takes s, t, m, d, re, ve or ll with it
        quotes = np.flatnonzero(points == ord("'"))
        quotes = quotes[(kinds[quotes - 1] != SYMBOL) & (kinds[quotes + 1] == LETTER)]
        one, two = points[quotes + 1], points[quotes + 1].astype(np.int64) << 21 | points[quotes + 2]
        pairs = [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")]
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(np.isin(two, pairs), 3, 0))
        quotes, length = quotes[length > 0], length[length > 0]
        starts[quotes + 1] = False
        ends = quotes + length
        starts[ends[kinds[ends] == LETTER]] = True
        return starts

    def _plain(self, text: str) -> list[bytes]:
        words = self.words.findall(_lowered(text))
        found = list(map(self.young.get, words))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    found[at] = self._word(words[at])
        return found

    def _word(self, word: str) -> bytes:
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            data = word.encode()
            inner = self.tables["inner"]
            symbols = [inner[b] for b in data]
            symbols[-1] = self.tables["last"][data[-1]]
            ids = b"".join([i.to_bytes(4, "little") for i in merge_symbols(symbols, self.tables["merges"])])
        return self._remembered(word, ids)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of equally many bytes, merged in rounds."""
        data = np.frombuffer("".join(words).encode(), np.uint8).reshape(len(words), -1)
        symbols = self.inner[data]
        symbols[:, -1] = self.last[data[:, -1]]
        merges = self.inside[data[:, :-1], data[:, 1:]]
        merges[:, -1:] = self.ending[data[:, -2:-1], data[:, 1:][:, -1:]]
        out, left = [b""] * len(words), np.arange(len(words))
        while len(left):
            each, width = np.arange(len(left)), symbols.shape[1]
            first = merges.argmin(axis=1) if width > 1 else each
            entry = merges[each, first] if width > 1 else np.full(len(left), NO_MERGE)
            done = entry == NO_MERGE
            ready = symbols[done].astype("<u4").tobytes()
            for at, place in enumerate(left[done].tolist()):
                out[place] = self._remembered(words[place], ready[4 * width * at : 4 * width * (at + 1)])
            left, symbols, merges, first, entry = (v[~done] for v in (left, symbols, merges, first, entry))
            each = np.arange(len(left))
            symbols[each, first] = entry & 0xFFFFF
            keep = np.ones(symbols.shape, bool)
            keep[each, first + 1] = False
            symbols = symbols[keep].reshape(len(left), width - 1)
            keep = np.ones(merges.shape, bool)
            keep[each, first] = False
            merges = merges[keep].reshape(len(left), max(width - 2, 0))
            for at in (first - 1, first):
                some = np.flatnonzero((at >= 0) & (at < width - 2))
                place = at[some]
                merges[some, place] = self._merges(symbols[some, place], symbols[some, place + 1])
        return out

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.entries[at], NO_MERGE)

    def _remembered(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 64:
            if len(self.young) >= REMEMBERED_WORDS:
                self.old.clear()
                self.old.update(self.young)
                self.young.clear()
            self.young[word] = ids
        return ids


def encode(
    spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = False, id_bytes: int = 4
) -> DataFrame:
    """Every input row with ``ids`` (little-endian unsigned integers) and, on request, ``decoded``.

    ``id_bytes`` is 4, or 2 for a vocabulary of at most 65,536 strings.

    Whole texts are encoded as the public library does without added special tokens, truncation or
    padding; special tokens written in a text become their ids. Null and empty texts have no ids and
    decode to an empty text. Letters that Unicode added after the library's tables (17.0) may be cut
    differently. Rows are independent of each other: nothing is shuffled and repeated rows
    stay. Input columns named like an added one are kept as ``<name>_in``.
    """
    loaded = load_vocabulary(vocabulary)
    if id_bytes not in (2, 4) or len(loaded["strings"]) > 1 << 8 * id_bytes:
        raise ValueError(f"ids of {vocabulary} do not fit {id_bytes} bytes")
    tables = spark.sparkContext.broadcast(loaded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                ids = codec.encode_rows(batch.column(1).to_pylist())
                sized = ids if id_bytes == 4 else [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in ids]
                columns, names = [batch.column(0), pa.array(sized, pa.binary())], [ROW, "ids"]
                if decoded:
                    columns.append(pa.array([codec.decode(i) for i in ids], pa.binary()).cast(pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks

    rows = packed(docs).select(ROW, text_or_empty(field(text)).alias("norm"))
    added = ["ids", "decoded"] if decoded else ["ids"]
    schema = rows.select(ROW).schema.add("ids", "binary")
    if decoded:
        schema = schema.add("decoded", "string")
    done = rows.mapInArrow(run, schema)
    return done.select(*unpacked(done, docs.columns, added))


def decode(spark: SparkSession, tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Every input row with ``decoded``; null ids decode to an empty text."""
    tables = spark.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                texts = [codec.decode(i or b"") for i in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], [ROW, "decoded"]
                )

    rows = packed(tokens).select(ROW, field(ids).alias("ids"))
    done = rows.mapInArrow(run, rows.select(ROW).schema.add("decoded", "string"))
    return done.select(*unpacked(done, tokens.columns, ["decoded"]))
