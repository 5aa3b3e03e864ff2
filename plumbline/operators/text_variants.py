"""Gold-labelled text variants: copies of a reference answer damaged in a recorded way.

An item row carries its whole fact list, so every kind of damage except topic drift is a row-local
expression: one pass over the items yields all kinds and severities with no shuffle. Topic drift
needs sentences of other items and takes them from the rows that follow in the hash order of a domain.
What does not depend on the severity is made once per item, and a column that is not asked for is not made.

Every draw is a hash of item, kind, severity, seed and index, so any partitioning and any retry
gives the same variants.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.draws import at_least_one, draw, let, pick_indexes, shuffled
from plumbline.functions.printing import decimals, fixed4
from plumbline.operators.ordered import numbered
from plumbline.session import cut_lineage

SEED = 20260731
SEVERITIES = (0.2, 0.5, 0.9)

# Filler, unsupported claims and vague phrases used by the damage rules.
FILLER = [
    "It is worth emphasising that these figures were compiled with care and reflect the "
    "underlying record as reported.",
    "Readers should bear in mind that context matters when interpreting results of this kind, "
    "as with any summary of a detailed source.",
    "Taken together, the picture that emerges is one that rewards close attention to the "
    "particulars rather than a hasty reading.",
    "This is, of course, only a summary, and the full record contains the complete detail "
    "behind each of the points above.",
    "It bears repeating that the values above are stated exactly as they appear in the source "
    "material and have not been adjusted.",
    "On the whole, the reported picture is consistent with what the source describes, and the "
    "summary reflects that consistency.",
]
FABRICATIONS = [
    "An independent replication confirmed every figure above within one percent.",
    "The result was subsequently ranked among the strongest in its category that year.",
    "A follow-up review found no methodological concerns of any kind.",
    "The findings were cited as decisive by the relevant oversight committee.",
    "A parallel cohort produced identical values under blinded conditions.",
    "The reported figures were later adopted as the reference standard for the field.",
]
VAGUE = [
    "a modest amount",
    "a fairly typical level",
    "a reasonably high figure",
    "something in the usual range",
    "a number of units",
    "a noticeable share",
]
HEDGE_PREFIX = "It is generally understood that this was "
DRIFT_SENTENCE = " The remainder addresses a different question."
MAX_PADDING = 40
MAX_WIDENING = 12

DONORS = 3
CHUNK_ROWS = 50_000


def render_value(fact: Column) -> Column:
    """Value and unit of a fact."""
    return F.when(fact["unit"] != "", F.concat(fact["value"], F.lit(" "), fact["unit"])).otherwise(
        fact["value"]
    )


def sentence(fact: Column) -> Column:
    """The fact's clause with its value filled in."""
    return F.replace(fact["clause"], F.lit("{value}"), render_value(fact))


def compose(facts: Column) -> Column:
    """The sentences of a fact list, joined by blanks."""
    return joined(F.transform(facts, sentence))


def joined(sentences: Column) -> Column:
    return F.array_join(sentences, " ")


def with_source_record(items: DataFrame) -> DataFrame:
    """Adds the reference answer, and the list of all facts to the context."""
    lines = F.array_join(
        F.transform(
            "facts",
            lambda f: F.concat(
                F.lit("  - "), F.replace(f["key"], F.lit("_"), F.lit(" ")), F.lit(": "), render_value(f)
            ),
        ),
        "\n",
    )
    return items.withColumn("reference", compose(F.col("facts"))).withColumn(
        "context", F.concat(F.col("context"), F.lit("\n\nSOURCE RECORD\n"), lines)
    )


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _none() -> Column:
    return F.array().cast("array<string>")


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index.cast("int"))


def _damage(
    kind: str | Column, text: Column, edit: Column, removed: Column | None = None,
    corrupted: Column | None = None, error: bool = True,
) -> dict[str, Column]:
    return {
        "degradation": kind if isinstance(kind, Column) else F.lit(kind),
        "text": text,
        "edit": edit,
        "facts_removed": _none() if removed is None else removed,
        "facts_corrupted": _none() if corrupted is None else corrupted,
        "introduces_error": F.lit(error),
    }


def _facts() -> Column:
    return F.col("facts")


def _said() -> Column:
    """The sentences of the item's facts."""
    return F.col("said")


def _size() -> Column:
    return F.size("facts")


def _identity(kind: str, seed: int) -> tuple:
    return (F.col("item_id"), kind, F.col("severity_label"), seed)


def _order(kind: str, array: Column, seed: int) -> Column:
    return shuffled(array, *_identity(kind, seed))


def _drop_indexes(seed: int) -> Column:
    k = at_least_one(F.col("severity") * (_size() - 1))
    return pick_indexes(_size(), k, *_identity("omission", seed))


def omission(seed: int) -> dict[str, Column]:
    """Required facts dropped; what is left stays fluent."""
    facts, drop = _facts(), F.col("omission_drop")
    text = let(drop, lambda d: joined(F.filter(_said(), lambda s, i: ~F.array_contains(d, i))))
    removed = F.transform(drop, lambda i: _at(facts, i)["key"])
    edit = F.concat(
        F.lit("Left out "), F.size(drop).cast("string"), F.lit(" of "), _size().cast("string"),
        F.lit(" facts: "), F.array_join(removed, ", "),
    )
    return _damage("omission", text, edit, removed=removed)


def _claims(seed: int) -> Column:
    k = F.least(at_least_one(F.col("severity") * 3), F.lit(len(FABRICATIONS)))
    return F.slice(_order("fabrication", _texts(FABRICATIONS), seed), 1, k)


def fabrication(seed: int) -> dict[str, Column]:
    """Unsupported claims appended; every fact stays."""
    claims = F.col("fabrication_claims")
    text = F.trim(F.concat(joined(_said()), F.lit(" "), F.array_join(claims, " ")))
    names = F.transform(claims, lambda _, i: F.concat(F.lit("fabricated_claim_"), i.cast("string")))
    edit = F.concat(
        F.lit("Added claims the source does not support: "), F.size(claims).cast("string")
    )
    return _damage("fabrication", text, edit, corrupted=names)


def _swapped_value(fact: Column, sign: Column) -> Column:
    """A numeric value moved by a share that grows with severity, widened until its print changes."""
    value = fact["value"].try_cast("double")
    point = F.instr(fact["value"], ".")
    places = F.when(point > 0, F.length(fact["value"]) - point).otherwise(0)
    share = F.lit(0.02) + F.lit(0.60) * F.pow(F.col("severity"), F.lit(1.5))

    def moved(n: Column) -> Column:
        def printed(delta: Column) -> Column:
            return decimals(n["value"] + delta * n["sign"], n["places"])

        def widen(state: Column, _: Column) -> Column:
            wider = state["delta"] + n["step"]
            return F.when(
                state["text"] == fact["value"],
                F.struct(wider.alias("delta"), printed(wider).alias("text")),
            ).otherwise(state)

        def widened(start: Column) -> Column:
            steps = F.sequence(F.lit(1), F.lit(MAX_WIDENING))
            return F.when(start["text"] == fact["value"], F.aggregate(steps, start, widen)["text"]).otherwise(start["text"])

        delta = F.greatest(F.abs(n["value"]) * share, n["step"])
        return let(let(delta, lambda d: F.struct(d.alias("delta"), printed(d).alias("text"))), widened)

    step = F.when(places > 0, F.pow(F.lit(10.0), -places.cast("double"))).otherwise(1.0)
    number = F.struct(value.alias("value"), places.alias("places"), step.alias("step"), sign.alias("sign"))
    return F.coalesce(let(number, moved), fact["value"])


def _numeric_places(seed: int) -> Column:
    return F.filter(F.sequence(F.lit(0), _size() - 1), lambda i: _at(_facts(), i)["kind"] == "numeric")


def _numeric_targets(seed: int) -> Column:
    places = F.col("numeric_places")
    k = at_least_one(F.col("severity") * F.least(F.lit(3), F.size(places)))
    return F.slice(_order("numeric_swap", places, seed), 1, k)


def _swapped_values(seed: int) -> Column:
    identity = _identity("numeric_swap", seed)

    def sign(i: Column) -> Column:
        odd = F.conv(F.substring(draw(*identity, "sign", i), 1, 1), 16, 10).cast("int") % 2
        return F.when(odd == 1, 1.0).otherwise(-1.0)

    def swapped(chosen: Column) -> Column:
        return F.transform(
            _facts(), lambda f, i: F.when(F.array_contains(chosen, i), _swapped_value(f, sign(i))).otherwise(f["value"])
        )

    return let(F.col("numeric_targets"), swapped)


def numeric_swap(seed: int) -> dict[str, Column]:
    """Numbers moved; the prose reads as before."""

    def told(values: Column) -> Column:
        return joined(
            F.transform(
                _facts(),
                lambda f, i: F.when(_at(values, i) == f["value"], _at(_said(), i)).otherwise(
                    sentence(f.withField("value", _at(values, i)))
                ),
            )
        )

    changed = F.filter(
        F.arrays_zip(_facts().alias("old"), F.col("numeric_values").alias("new")),
        lambda z: z["old"]["value"] != z["new"],
    )
    keys = F.transform(changed, lambda z: z["old"]["key"])
    notes = F.transform(
        changed,
        lambda z: F.concat(z["old"]["key"], F.lit(": "), z["old"]["value"], F.lit(" -> "), z["new"]),
    )
    edit = F.concat(F.lit("Changed numbers ["), F.array_join(notes, "; "), F.lit("]"))
    return _damage("numeric_swap", let(F.col("numeric_values"), told), edit, corrupted=keys)


def _filler_order(seed: int) -> Column:
    return _order("verbosity", _texts(FILLER), seed)


def _filler_count(seed: int) -> Column:
    """How many filler sentences it takes, in turn, to reach the length wanted; at most ``MAX_PADDING``."""
    goal = lambda size: (F.lit(1.5) + F.lit(1.5) * F.col("severity")) * size
    missing = let(F.length("reference"), lambda size: F.ceil(goal(size) - size).cast("bigint"))
    turn = sum(len(f) + 1 for f in FILLER)

    def count(short: Column) -> Column:
        """``short`` is what is missing after whole turns, ``upto`` the length so far and ``n`` the sentences that do not reach it."""

        def step(state: Column, text: Column) -> Column:
            upto = state["upto"] + F.length(text) + 1
            return F.struct(upto.alias("upto"), (state["n"] + F.when(upto < short, 1).otherwise(0)).alias("n"))

        start = F.struct(F.lit(0).alias("upto"), F.lit(1).alias("n"))
        return F.aggregate("filler_order", start, step)["n"]

    def total(m: Column) -> Column:
        whole = F.call_function("div", m - 1, F.lit(turn))
        return F.least(whole * len(FILLER) + let(m - whole * turn, count), F.lit(MAX_PADDING)).cast("int")

    return let(missing, lambda m: F.when(m > 0, total(m)).otherwise(0))


def verbosity(seed: int) -> dict[str, Column]:
    """The probe: filler after the untouched reference, up to three times its length."""
    pool, count = F.col("filler_order"), F.col("filler_count")
    added = F.slice(F.flatten(F.array_repeat(pool, 1 + MAX_PADDING // len(FILLER))), F.lit(1), count)
    text = joined(F.concat(F.array(F.col("reference")), added))
    edit = F.concat(F.lit("Padded with filler sentences, nothing else changed: "), count.cast("string"))
    return _damage("verbosity", text, edit, error=False)


def _without_first_the(clause: Column) -> Column:
    at = F.instr(clause, "the ")
    rest = F.substring(clause, at + 4, F.length(clause))
    return F.when(at > 0, F.concat(F.substring(clause, F.lit(1), at - 1), rest)).otherwise(clause)


def _hedge_targets(seed: int) -> Column:
    k = F.least(at_least_one(F.col("severity") * _size()), _size())
    return pick_indexes(_size(), k, *_identity("hedging", seed))


def _softened(seed: int) -> Column:
    """Every fact's clause as a hedge, its value still open."""
    return F.transform(
        _facts(), lambda f: F.concat(F.lit(HEDGE_PREFIX), let(F.lower(f["clause"]), _without_first_the))
    )


def hedging(seed: int) -> dict[str, Column]:
    """Committed values replaced by vague phrases."""
    facts, chosen = _facts(), F.col("hedge_targets")
    identity = _identity("hedging", seed)

    def vague(i: Column) -> Column:
        at = F.conv(F.substring(draw(*identity, "phrase", i), 1, 7), 16, 10).cast("int")
        return _at(_texts(VAGUE), at % len(VAGUE))

    def told(hedged: Column) -> Column:
        def soften(i: Column) -> Column:
            return F.replace(_at(F.col("softened"), i), F.lit("{value}"), vague(i))

        return joined(F.transform(_said(), lambda s, i: F.when(F.array_contains(hedged, i), soften(i)).otherwise(s)))

    keys = F.transform(chosen, lambda i: _at(facts, i)["key"])
    edit = F.concat(F.lit("Made vague instead of committed: "), F.array_join(keys, ", "))
    return _damage("hedging", let(chosen, told), edit, corrupted=keys)


def _drift_options(seed: int) -> Column:
    """For each position, the clauses that really differ and could stand there: those of the donor items, null where they
    do not differ, and the end that serves if none of these does.
    """

    def other(own: Column, text: Column, item: Column) -> Column:
        return F.when(text != own, F.struct(text.alias("sentence"), item.alias("item_id")))

    def options(own: Column, i: Column) -> Column:
        near = F.transform(
            F.col("donors.near"), lambda d: other(own, _at(d["said"], i % F.size(d["said"])), d["item_id"])
        )
        ends = F.flatten(
            F.transform(
                F.col("donors.wide"), lambda w: F.array(_at(w["low"], i % w["size"]), _at(w["high"], i % w["size"]))
            )
        )
        end = F.get(F.filter(ends, lambda d: d["sentence"] != own), F.lit(0))
        return let(
            near,
            lambda n: F.struct(
                n.alias("near"), F.when(~F.coalesce(F.exists(n, lambda d: d.isNotNull()), F.lit(False)), end).alias("end")
            ),
        )

    return F.transform(_said(), options)


def _drift_places(seed: int) -> Column:
    """Positions that some other item's clause can really change."""
    usable = F.filter(
        F.transform("drift_options", lambda o, i: F.struct(i.alias("at"), (o["end"].isNotNull() | F.exists(o["near"], lambda d: d.isNotNull())).alias("ok"))),
        lambda u: u["ok"],
    )
    return F.transform(usable, lambda u: u["at"])


def _drift_swaps(seed: int) -> Column:
    """The first usable positions in draw order, each with its new clause: the first that differs, from a drawn donor on."""
    k = at_least_one(F.col("severity") * _size())
    identity = _identity("topic_drift", seed)
    first = F.conv(F.substring(draw(*identity, "donor"), 1, 7), 16, 10).cast("int")

    def taken(at: Column, start: Column) -> Column:
        def by(o: Column) -> Column:
            many = F.greatest(F.size(o["near"]), F.lit(1))
            turned = [_at(o["near"], (start + j) % many) for j in range(DONORS)]
            return F.struct(at.alias("at"), F.coalesce(*turned, o["end"]).alias("by"))

        return let(_at(F.col("drift_options"), at), by)

    def swaps(places: Column) -> Column:
        ranks = F.transform(places, lambda i: F.struct(draw(*identity, i).alias("rank"), i.alias("at")))
        chosen = F.slice(F.sort_array(ranks), 1, k)
        return let(first, lambda start: F.transform(chosen, lambda c: taken(c["at"], start)))

    return let(F.col("drift_places"), swaps)


def _either(test: Column, yes: dict[str, Column], no: dict[str, Column]) -> dict[str, Column]:
    return {name: F.when(test, yes[name]).otherwise(no[name]) for name in yes}


def topic_drift(seed: int) -> dict[str, Column]:
    """Clauses replaced by clauses that answer another item's question."""
    facts, n, swaps = _facts(), _size(), F.col("drift_swaps")
    k = at_least_one(F.col("severity") * n)

    def told(found: Column) -> Column:
        def replaced(s: Column, i: Column) -> Column:
            hit = F.get(F.filter(found, lambda o: o["at"] == i), F.lit(0))
            return F.coalesce(hit["by"]["sentence"], s)

        return joined(F.transform(_said(), replaced))

    keys = F.array_sort(F.transform(swaps, lambda o: _at(facts, o["at"])["key"]))
    edit = F.concat(
        F.lit("Clauses taken from other answers ("),
        F.array_join(F.array_distinct(F.transform(swaps, lambda o: o["by"]["item_id"])), ", "),
        F.lit("): "), F.array_join(keys, ", "),
    )
    alone = F.col("alone")
    keep = F.when(alone, n - k).otherwise(F.greatest(F.lit(1), n - k))
    cut_text = F.concat(joined(F.slice(_said(), F.lit(1), keep)), F.lit(DRIFT_SENTENCE))
    cut_keys = F.when(alone, _none()).otherwise(
        F.transform(F.slice(facts, keep + 1, n), lambda f: f["key"])
    )
    cut = _damage(
        "topic_drift", cut_text, F.lit("Clauses cut off, no other answer had usable ones"),
        corrupted=cut_keys,
    )
    drift = _damage("topic_drift", let(swaps, told), edit, corrupted=keys)
    return _either(alone | (F.size(swaps) == 0), cut, drift)


@dataclass(frozen=True)
class Degradation:
    """One kind of damage: columns made once per item, the columns it draws per severity, step by step, and the fields of
    the damage built from them. ``instead`` names the kind that an item gets where its condition holds."""

    build: Callable[[int], dict[str, Column]]
    draws: tuple[tuple[str, Callable[[int], Column]], ...]
    introduces_error: bool = True
    needs_donors: bool = False
    prepared: tuple[tuple[str, Callable[[int], Column]], ...] = ()
    instead: tuple[str, Callable[[], Column]] | None = None


DEGRADATIONS: dict[str, Degradation] = {
    "omission": Degradation(omission, (("omission_drop", _drop_indexes),)),
    "fabrication": Degradation(fabrication, (("fabrication_claims", _claims),)),
    "numeric_swap": Degradation(
        numeric_swap,
        (("numeric_targets", _numeric_targets), ("numeric_values", _swapped_values)),
        prepared=(("numeric_places", _numeric_places),),
        instead=("hedging", lambda: ~F.coalesce(F.size("numeric_places") > 0, F.lit(False))),
    ),
    "verbosity": Degradation(
        verbosity,
        (("filler_order", _filler_order), ("filler_count", _filler_count)),
        introduces_error=False,
    ),
    "topic_drift": Degradation(
        topic_drift,
        (("drift_swaps", _drift_swaps),),
        needs_donors=True,
        prepared=(
            ("drift_options", _drift_options),
            ("alone", lambda seed: F.col("donors").isNull()),
            ("drift_places", _drift_places),
        ),
    ),
    "hedging": Degradation(hedging, (("hedge_targets", _hedge_targets),), prepared=(("softened", _softened),)),
}


def error_kinds() -> list[str]:
    return [k for k, d in DEGRADATIONS.items() if d.introduces_error]


def probe_kinds() -> list[str]:
    return [k for k, d in DEGRADATIONS.items() if not d.introduces_error]


def _clause_ends(items: DataFrame) -> DataFrame:
    """Per domain, one entry for each number of facts: the first and last sentence at every position.

    If any sentence an item of the domain has for a position differs from an item's own, one of these two
    does, so they settle exactly whether a clause can be replaced. The entries number the different lengths of fact lists.
    """
    worded = items.where(F.size("facts") > 0).select(
        "domain", F.size("facts").alias("size"), F.posexplode("said").alias("at", "sentence"), "item_id"
    )
    clause = F.struct("sentence", "item_id")
    return worded.groupBy("domain", "size", "at").agg(F.min(clause).alias("low"), F.max(clause).alias("high"))


def _wide(ends: DataFrame, *by: str) -> DataFrame:
    """The clause ends of each group in one array."""
    outer = ends.groupBy(*by, "size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = outer.groupBy(*by, "size").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("e"))
    entry = F.struct("size", F.col("e.low").alias("low"), F.col("e.high").alias("high"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("wide"))


def _near_of_all(items: DataFrame, alone: DataFrame) -> DataFrame:
    """The donors of the items of the domains ``alone``: those that follow in the ring of all items."""
    usable = items.where(F.size("facts") > 0).select("item_id", draw(F.col("item_id"), "ring").alias("_draw"))
    places = cut_lineage(numbered(usable, [], ["_draw", "item_id"], "_rank").select("item_id", "_rank"))
    wanting = (
        items.join(alone, "domain")
        .select("item_id")
        .join(places, "item_id")
        .select(F.col("item_id").alias("_for"), "_rank", F.explode(F.sequence(F.lit(1), F.lit(DONORS))).alias("_step"))
        .withColumn("_members", places.agg(F.count(F.lit(1)).alias("n")).scalar())
        .where(F.col("_step") < F.col("_members"))
        .select("_for", "_step", ((F.col("_rank") - 1 + F.col("_step")) % F.col("_members") + 1).alias("_rank"))
    )
    given = wanting.join(places, "_rank").join(items.select("item_id", "said"), "item_id")
    near = given.groupBy(F.col("_for").alias("item_id")).agg(
        F.array_sort(F.collect_list(F.struct("_step", "item_id", "said"))).alias("near")
    )
    return near.select("item_id", F.transform("near", lambda d: F.struct(d["item_id"].alias("item_id"), d["said"].alias("said"))).alias("_near_of_all"))


def with_donors(items: DataFrame) -> DataFrame:
    """Each item with donors: items that follow it in the hash order of its domain, as a ring.

    An item that is alone in its domain takes them from the ring of all items; an item that is alone
    altogether has none. Every item serves as donor, and each as often as any other. A domain's ring is cut by the first
    digits of the hash into chunks of about ``CHUNK_ROWS`` rows; the last rows of a chunk get their donors from the first
    rows of the chunks that follow.
    """
    named = items if "said" in items.columns else items.withColumn("said", F.transform("facts", sentence))
    serves = F.coalesce(F.size("facts") > 0, F.lit(False))
    sizes = items.groupBy("domain").agg(F.count(F.lit(1)).alias("_in_domain"), F.count_if(serves).alias("_members"))
    single = F.col("domain").isNotNull() & (F.col("_in_domain") == 1)
    about = sizes.agg(F.sum("_in_domain").alias("total"), F.count_if(single).alias("lonely")).first()
    digits = F.ceil(F.log(16.0, F.col("_in_domain") / CHUNK_ROWS)).cast("int").alias("_digits")
    large = F.broadcast(sizes.where(F.col("_in_domain") > CHUNK_ROWS).select("domain", digits))  # one per CHUNK_ROWS items at most
    placed = (
        named.withColumns({"_serves": serves, "_draw": draw(F.col("item_id"), "ring")})
        .join(large, "domain", "left")
        .withColumn("_chunk", F.substring("_draw", F.lit(1), F.when(F.col("domain").isNull(), 3).otherwise(F.coalesce("_digits", F.lit(0)))))
    )
    ring = Window.partitionBy("domain", "_chunk").orderBy(~F.col("_serves"), "_draw", "item_id")
    placed = placed.withColumn("_me", F.when(F.col("_serves"), F.struct("item_id", "said")))
    first = placed.select("domain", "_chunk", "_me", F.row_number().over(ring).alias("_place")).where(F.col("_place") <= DONORS)
    chunks = first.where(F.col("domain").isNotNull()).groupBy("domain", "_chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("_me").isNotNull(), F.struct("_place", "_me")))).alias("_heads")
    )
    turns = chunks.where(F.size("_heads") > 0).withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1))))
    ahead = Window.partitionBy("domain").orderBy("_turn", "_chunk").rowsBetween(1, DONORS)
    beyond = turns.select("domain", "_chunk", "_turn", F.flatten(F.collect_list("_heads").over(ahead))["_me"].alias("_beyond")).where(F.col("_turn") == 0)
    ends = cut_lineage(_clause_ends(named))
    everyone = _wide(ends).select("wide").scalar()
    pools = sizes.join(_wide(ends, "domain"), "domain", "left").select(
        "domain", "_members", F.when(F.col("_in_domain") > 1, F.col("wide")).when(F.lit(about.total or 0) > 1, everyone).alias("_wide")
    )
    known = chunks.select("domain", "_chunk").join(beyond.drop("_turn"), ["domain", "_chunk"], "left").join(pools, "domain")
    after = placed.withColumns({f"_after{j}": F.lead("_me", j).over(ring) for j in range(1, DONORS + 1)})
    joined_ = after.join(known, ["domain", "_chunk"], "left")
    none = F.array().cast("array<struct<item_id:string,said:array<string>>>")
    following = F.concat(F.array_compact(F.array(*[f"_after{j}" for j in range(1, DONORS + 1)])), F.coalesce("_beyond", none))
    near = F.when(F.col("_serves"), F.slice(following, F.lit(1), F.least(F.lit(DONORS), F.greatest(F.col("_members") - 1, F.lit(0))).cast("int"))).otherwise(none)
    if about.lonely:
        joined_ = joined_.join(_near_of_all(named, sizes.where(single).select("domain")), "item_id", "left")
        near = F.coalesce("_near_of_all", near)
    donors = F.when(F.col("_wide").isNotNull(), F.struct(near.alias("near"), F.col("_wide").alias("wide")))
    return joined_.select(*items.columns, donors.alias("donors"))


def _levels(kinds: Sequence[str], steps: Callable[[Degradation], tuple]) -> list[dict[str, tuple]]:
    """The named steps of all kinds, by depth, with the kinds that own each."""
    levels: list[dict[str, tuple]] = []
    for k in kinds:
        for depth, (name, make) in enumerate(steps(DEGRADATIONS[k])):
            if depth == len(levels):
                levels.append({})
            levels[depth].setdefault(name, (make, []))[1].append(k)
    return levels


def build_variants(
    items: DataFrame,
    degradations: Sequence[str] | None = None,
    severities: Sequence[float] = SEVERITIES,
    seed: int = SEED,
    sample_seed: int | None = None,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Every item x kind of damage x severity, as variant rows with their audit trail.

    With ``sample_seed`` only those that :func:`balanced_sample` of that seed draws: a draw needs no text. Columns of
    ``beside`` join every item by ``item_id`` before its variants are made, and come last.
    """
    kinds = list(degradations or DEGRADATIONS)
    turned = [DEGRADATIONS[k].instead[0] for k in kinds if DEGRADATIONS[k].instead]
    built = list(dict.fromkeys([*kinds, *turned]))
    source = items.withColumn("said", F.transform("facts", sentence))
    carried = ["item_id", "reference", "facts", "said"]
    if any(DEGRADATIONS[k].needs_donors for k in kinds):
        source = with_donors(source)
    if beside is not None:
        source = source.drop(*[c for c in beside.columns if c != "item_id"]).join(beside, "item_id")
    added = [c for c in (beside.columns if beside is not None else []) if c != "item_id"]
    owners: dict[str, list[str]] = {}
    for level in _levels(built, lambda d: d.prepared):
        source = source.withColumns({n: make(seed) for n, (make, _) in level.items()})
        owners.update({n: own for n, (_, own) in level.items()})

    def kind_of(k: str) -> Column:
        other = DEGRADATIONS[k].instead
        return F.when(other[1](), other[0]).otherwise(k) if other else F.lit(k)

    def cell(k: str, s: float) -> Column:
        label = F.lit(f"{s:g}")
        parts = [F.lit(k).alias("requested"), kind_of(k).alias("kind"), F.lit(float(s)).alias("severity"), label.alias("severity_label")]
        if sample_seed is not None:
            parts.append(draw(F.col("item_id"), "sample", sample_seed, F.concat_ws("@", kind_of(k), label)).alias("rank"))
        return F.struct(*parts)

    def chosen(group: list[str]) -> Column:
        cells = F.array(*[cell(k, s) for k in group for s in severities])
        if sample_seed is None:
            return cells
        lowest = lambda all_: F.array_min(F.transform(all_, lambda c: c["rank"]))
        return let(cells, lambda all_: let(lowest(all_), lambda low: F.filter(all_, lambda c: c["rank"] == low)))

    groups = [g for g in ([k for k in kinds if DEGRADATIONS[k].introduces_error is e] for e in (True, False)) if g]
    grid = F.concat(*[chosen(g) for g in groups])
    kept = [*carried, *added, *owners]
    cells = source.select(*kept, F.explode(grid).alias("g"))

    def only(own: list[str], value: Column) -> Column:
        return value if len(own) == len(built) else F.when(F.col("kind").isin(own), value)

    cells = cells.select(
        *carried, *added, *[F.col("g")[c].alias(c) for c in ("requested", "kind", "severity", "severity_label")],
        *[(F.col(n) if len(own) == len(built) else F.when(F.col("g")["kind"].isin(own), F.col(n))).alias(n) for n, own in owners.items()],
    )
    for level in _levels(built, lambda d: d.draws):
        cells = cells.withColumns({n: only(own, make(seed)) for n, (make, own) in level.items()})
    damages = {k: DEGRADATIONS[k].build(seed) for k in built}

    def made(name: str) -> Column:
        out = None
        for k, damage in damages.items():
            out = damage[name] if len(built) == 1 else (F if out is None else out).when(F.col("kind") == k, damage[name])
        return out

    fields = list(next(iter(damages.values())))
    rows = cells.select("item_id", "reference", "requested", "severity", "severity_label", *[made(f).alias(f) for f in fields], *added)
    variant_id = F.concat_ws("@", F.col("degradation"), F.col("severity_label"))
    rows = rows.withColumn("_ratio", F.length("text") / F.greatest(F.length("reference"), F.lit(1)))
    return rows.select(
        "item_id",
        variant_id.alias("variant_id"),
        F.concat_ws(":", F.col("item_id"), variant_id).alias("uid"),
        "requested",
        "severity",
        *fields,
        fixed4(F.col("_ratio")).cast("double").alias("len_ratio"),
        *added,
    )


def references(items: DataFrame) -> DataFrame:
    """What :func:`gold_pairs` puts beside a variant."""
    return items.select("item_id", "context", "question", F.col("reference").alias("better"))


def gold_pairs(items: DataFrame, variants: DataFrame) -> DataFrame:
    """Each error variant beside its item's reference: the reference is better by construction.

    Variants built with :func:`references` of the items beside them are not joined again.
    """
    beside = references(items)
    errors = variants.where("introduces_error")
    return (
        (errors if set(beside.columns) <= set(errors.columns) else errors.join(beside, "item_id"))
        .select(
            "uid",
            "item_id",
            "context",
            "question",
            "better",
            F.col("text").alias("worse"),
            "degradation",
            "severity",
            "len_ratio",
        )
    )


def balanced_sample(
    items: DataFrame, variants: DataFrame, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """One reference and one drawn error variant per item, and one drawn probe held aside."""
    rank = draw(F.col("item_id"), "sample", seed, F.col("variant_id"))
    row = F.struct(rank.alias("rank"), *[F.col(c) for c in variants.columns])
    drawn = (
        variants.groupBy("item_id", "introduces_error")
        .agg(F.min(row).alias("row"))
        .select("row.*")
        .drop("rank")
    )
    references = items.select(
        "item_id",
        F.concat("item_id", F.lit(":reference")).alias("uid"),
        F.col("reference").alias("text"),
        F.lit("reference").alias("degradation"),
        F.lit(0.0).alias("severity"),
        F.lit(1).alias("truth"),
    )
    columns = references.columns

    def shaped(df: DataFrame) -> DataFrame:
        return df.withColumn("truth", (~F.col("introduces_error")).cast("int")).select(*columns)

    errors = shaped(drawn.where("introduces_error"))
    return references.unionByName(errors), shaped(drawn.where(~F.col("introduces_error")))


def profile_items(items: DataFrame) -> DataFrame:
    """Size of an item table: items, domains, facts per item and reference length in words."""
    words = F.size(
        F.filter(F.split(F.trim("reference"), r"\s+"), lambda w: w != "")
    )
    return items.withColumn("_words", words).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_set("domain")).alias("domains"),
        F.min(F.size("facts")).alias("min_facts"),
        F.max(F.size("facts")).alias("max_facts"),
        F.avg("_words").alias("mean_reference_words"),
        F.min("_words").alias("min_reference_words"),
        F.max("_words").alias("max_reference_words"),
    )
