"""Line dedup by winnowing over line hashes.

Documents are sequences of non-blank lines. A repeated run is long enough if it has three lines or 50
words. Of every window of three lines (or fewer that reach 50 words) the line with the least hash is a fingerprint. Equal
windows have equal fingerprints, so a window whose fingerprint stands at one place only repeats nothing: fingerprints, single
numbers, are counted first, and only windows around shared ones go on. Their whole keys are joined by position: each place meets the
earliest one with the same lines. Windows that overlap are one match, so a match reaches as far both ways as its
lines agree, and the lines of all later places are deleted. Documents are ordered by id, so the first place of every run stays.

Extending from single fingerprints alone would lose runs (an earliest place may hold the fingerprint and no more of the run);
meeting the earliest place of each whole window does not.

A run that very many documents share never makes pairs of documents: each place meets one earliest place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ROW, field, null_safe, packed, stored, text_or_empty, unpacked, word_count

RUN_LINES = 3
RUN_WORDS = 50


def line_hash(line: Column) -> Column:
    """60 bits of the digest of a line without outer blanks."""
    return F.conv(F.substring(F.md5(F.trim(line)), 1, 15), 16, 10).cast("long")


def _documents(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(k_id, k_text, at, h, w): a document's non-blank lines: place, hash, words; equal rows once."""
    lines = F.filter(
        F.transform(
            F.split(text_or_empty(field(text)), "\n"),
            lambda line, i: F.struct(i.alias("at"), line_hash(line).alias("h"), word_count(line).alias("w")),
        ),
        lambda line: line["w"] > 0,
    )
    rows = packed(docs).select(
        field(id_col).alias("k_id"), F.xxhash64(field(text)).alias("k_text"), lines.alias("lines")
    )
    return (
        rows.where(F.size("lines") > 0)
        .dropDuplicates(["k_id", "k_text"])
        .select("k_id", "k_text", F.col("lines.at").alias("at"), F.col("lines.h").alias("h"), F.col("lines.w").alias("w"))
    )


def _windows() -> Column:
    """Per document (n, p, mark): its windows of three lines, and shorter ones that have 50 words, with the place of the
    least hash in each, the first of equals."""

    def at(i: Column) -> Column:
        hashes, words, best, found = [], F.lit(0).cast("long"), i, []
        for n in range(1, RUN_LINES + 1):
            place = i + (n - 1)
            hashes.append(F.get("h", place))
            words = words + F.get("w", place)
            if n > 1:
                best = F.when(hashes[-1] < F.get("h", best), place).otherwise(best)
            whole = hashes[-1].isNotNull() if n == RUN_LINES else words >= RUN_WORDS
            found.append(F.when(whole, F.struct(F.lit(n).alias("n"), i.alias("p"), best.alias("mark"))))
        return F.array(*found)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size("h") - 1), at)), lambda r: r.isNotNull())


def _short_runs(lines: DataFrame) -> DataFrame:
    """(key, h, k_id, k_text, p, n): the windows whose fingerprint stands at two places or more, by a key of all their lines;
    ``h`` is the first line's hash, which keeps windows apart whose keys collide."""
    runs = lines.select("k_id", "k_text", "h", F.explode(_windows()).alias("run"))

    def line(k: int) -> Column:
        return F.when(F.col("run.n") > k, F.get("h", F.col("run.p") + k))

    keyed = runs.select(
        F.xxhash64("run.n", *[line(k) for k in range(RUN_LINES)]).alias("key"),
        line(0).alias("h"),
        "k_id",
        "k_text",
        "run.p",
        "run.n",
        F.get("h", F.col("run.mark")).alias("mark"),
        F.xxhash64("k_id", "k_text", "run.mark").alias("place"),
    )
    places = keyed.groupBy("mark").agg(F.min("place").alias("one"), F.max("place").alias("other"))
    # written before the join, which then can split a line that very many documents have
    shared = stored(places.where("one != other").select("mark"), "line-marks")
    return keyed.drop("place").join(shared, "mark", "left_semi").drop("mark")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(k_id, k_text, gone): the places of a document's lines that belong to later repeated runs."""
    lines = stored(_documents(docs, id_col, text), "lines")
    runs = stored(_short_runs(lines), "line-runs")
    order = F.struct(F.col("k_id").isNotNull().alias("named"), "k_id", "k_text", "p")
    firsts = runs.groupBy("key", "h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    # written before the join, which then can split a run that very many documents share
    firsts = stored(firsts.drop("places"), "line-firsts")
    later = runs.join(firsts, ["key", "h"]).where(
        ~(F.col("k_id").eqNullSafe(F.col("first.k_id")) & (F.col("k_text") == F.col("first.k_text")) & (F.col("p") == F.col("first.p")))
    )
    later = later.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("p", "n")).alias("runs"))
    at = lines.select(F.col("k_id").alias("d_id"), F.col("k_text").alias("d_text"), "at")
    both = later.join(at, null_safe([F.col("k_id"), F.col("k_text")], [F.col("d_id"), F.col("d_text")]))
    places = F.flatten(F.transform("runs", lambda run: F.slice("at", run["p"] + 1, run["n"])))
    return both.select("k_id", "k_text", F.array_distinct(places).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every input row with ``n_lines``, ``removed`` (places of deleted lines, from 0) and ``clean_text``.

    A run is a stretch of non-blank lines that are equal, but for outer blanks, to a stretch at an earlier
    place (smaller id, or higher up in the same text); it is deleted if it has at least three lines or 50
    words. Every such run is found, whatever stands around it and wherever its earlier place is.

    Null text is empty text and cleans to an empty text; blank lines stay. A null id comes first. Rows
    equal in id and text are one document and get the same result. Lines are compared by 60-bit digests.
    Input columns with the names of added ones are kept as ``<name>_in``.
    """
    gone = repeated_lines(docs, id_col, text)
    rows = packed(docs).select(ROW, field(id_col).alias("k_id"), F.xxhash64(field(text)).alias("k_text"))
    joined = rows.alias("d").join(
        gone.alias("g"), null_safe([F.col("d.k_id"), F.col("d.k_text")], [F.col("g.k_id"), F.col("g.k_text")]), "left"
    ).select(ROW, F.coalesce(F.array_sort("gone"), F.array().cast("array<int>")).alias("removed"))
    lines = F.split(text_or_empty(field(text)), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    done = joined.withColumn("lines", lines).withColumn("n_lines", F.size("lines").cast("long")).withColumn(
        "clean_text",
        F.when(F.size("removed") == 0, text_or_empty(field(text))).otherwise(F.array_join(kept, "\n")),
    )
    return done.select(*unpacked(done, docs.columns, ["n_lines", "removed", "clean_text"]))
