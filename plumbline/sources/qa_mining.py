"""Numeric question-answer pairs mined from nested reading-comprehension data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.draws import draw
from plumbline.operators.ordered import take_first

SOURCE_SCHEMA = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<"
    "id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,"
    "answer_start:int>>>>>>>>"
)
MAX_CONTEXT = 12_000
LABEL_ORIGIN = "human reference, number changed by rule"
REVIEW_STATUS = "checked by rules, not yet by a person"


def _corrupted(reference: Column) -> Column:
    """The number plus a tenth of itself, at least one unit in its last place, as text.

    Works on the digits, so a number may have any length. In units of the last place the number is
    its digits D; a tenth is D without its last digit q, rounded half to even; so the sum is D + q + 0 or 1,
    added digit by digit.
    """
    places = F.coalesce(F.length(F.get(F.split(reference, r"\."), F.lit(1))), F.lit(0))
    digits = F.transform(
        F.filter(F.split(F.reverse(F.replace(reference, F.lit("."), F.lit(""))), ""), lambda d: d != ""),
        lambda d: d.cast("int"),
    )
    last, second = F.get(digits, F.lit(0)), F.coalesce(F.get(digits, F.lit(1)), F.lit(0))
    up = (last > 5) | ((last == 5) & (second % 2 == 1))
    no_tenth = F.forall(F.slice(digits, 2, F.greatest(F.size(digits) - 1, F.lit(0))), lambda d: d == 0)
    added = F.transform(digits, lambda d, i: d + F.coalesce(F.get(digits, i + 1), F.lit(0)))
    summed = F.aggregate(
        added,
        F.struct(F.when(up | no_tenth, 1).otherwise(0).alias("carry"), F.lit("").alias("text")),
        lambda state, d: F.struct(
            F.floor((state["carry"] + d) / 10).cast("int").alias("carry"),
            F.concat(((state["carry"] + d) % 10).cast("string"), state["text"]).alias("text"),
        ),
        lambda state: F.concat(F.when(state["carry"] > 0, state["carry"].cast("string")).otherwise(""), state["text"]),
    )
    whole = F.regexp_replace(F.substring(summed, F.lit(1), F.length(summed) - places), r"^0+(?=\d)", "")
    fraction = F.substring(summed, F.length(summed) - places + 1, places)
    return F.when(places > 0, F.concat(whole, F.lit("."), fraction)).otherwise(whole)


def eligible_pairs(source: DataFrame, max_context: int = MAX_CONTEXT) -> DataFrame:
    """The first eligible question of every passage, with a corrupted copy of its numeric answer.

    Eligible: answerable, all annotators agree on a plain number, every answer span is where it
    says it is, and the corrupted number does not occur in the passage. The corruption adds a tenth, at
    least one unit in the last place; numbers of any length are taken.
    """
    articles = source.select(F.explode("data").alias("a"))
    passages = (
        articles.select("a.title", F.explode("a.paragraphs").alias("p"))
        .select("title", "p.context", "p.qas")
        .where(F.length("context") <= max_context)
    )

    def agreed(q: Column) -> Column:
        values = F.array_distinct(F.transform(q["answers"], lambda a: F.trim(a["text"])))
        spans = F.forall(
            q["answers"],
            lambda a: F.substring(F.col("context"), a["answer_start"] + 1, F.length(a["text"]))
            == a["text"],
        )
        answerable = ~F.coalesce(q["is_impossible"], F.lit(False)) & (F.size(q["answers"]) > 0)
        return F.when(answerable & spans & (F.size(values) == 1), F.get(values, F.lit(0)))

    referenced = passages.withColumn(
        "qas",
        F.transform("qas", lambda q: F.struct(q.alias("q"), agreed(q).alias("reference"))),
    )
    numeric = referenced.withColumn(
        "qas", F.filter("qas", lambda r: F.coalesce(r["reference"].rlike(r"^\d+(\.\d+)?$"), F.lit(False)))
    )
    corrupted = numeric.withColumn(
        "qas",
        F.transform("qas", lambda r: r.withField("candidate", _corrupted(r["reference"]))),
    )
    usable = F.filter(
        "qas",
        lambda r: (r["candidate"] != r["reference"])
        & (F.instr(F.col("context"), r["candidate"]) == 0),
    )
    first = corrupted.withColumn("r", F.get(usable, F.lit(0))).where(F.col("r").isNotNull())
    return first.select(
        F.col("r.q.id").alias("id"),
        F.col("title").alias("source_id"),
        "context",
        F.col("r.q.question").alias("question"),
        "r.reference",
        "r.candidate",
        F.lit("numeric_swap").alias("degradation"),
        F.lit("test").alias("split"),
        F.struct(
            F.col("r.q.answers").alias("answer_spans"),
            F.concat(
                F.lit("Replaced "), F.col("r.reference"), F.lit(" by "), F.col("r.candidate")
            ).alias("edit"),
            F.lit(LABEL_ORIGIN).alias("label_origin"),
            F.lit(REVIEW_STATUS).alias("review_status"),
        ).alias("metadata"),
    )


def mine_numeric_pairs(source: DataFrame, n: int = 100, seed: int = 20260731) -> DataFrame:
    """n eligible pairs in hash order; fewer than n is an error."""
    if n < 1:
        raise ValueError("n must be positive")
    ranked = eligible_pairs(source).withColumn("_rank", draw(F.col("id"), seed))
    chosen = take_first(ranked, ["_rank", "id"], n).drop("_rank")
    found = chosen.count()
    if found < n:
        raise ValueError(f"only {found} eligible passages for requested {n}")
    return chosen
