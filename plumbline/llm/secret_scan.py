"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (``assign``, ``access``, ``hex``) are findings by themselves. Weak ones (``user``, ``short``,
``opaque``, ``endpoint``) say little alone: a weak part is a finding only where complementary parts co-occur. Each text's scopes are its
paragraphs; an interval join puts every part into the scope that holds it, and inside a scope parts within ``REACH`` characters
are linked: a login with a secret, a secret with an access or login name, an endpoint with both.

Texts are read where they lie and not moved: what is shuffled is the parts, some numbers each. Positions are running sums over
the lengths between and of the matches; the interval join meets in cells of ``CELL`` characters, so its work is
linear in parts and text, and the window of the links holds one scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import field, packed, stored, text_or_empty, unpacked

REACH = 400
CELL = 4096
LEAST_SECRET = 6


def either_case(pattern: str) -> str:
    """The pattern with its ASCII letters in either case, and no other letters that fold to them."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


# What the contract calls assign, access and hex. A run of fewer letters fails and holds no other match of its kind.
_IS = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = either_case("(?:password|passwd|secret|token|api_?key)") + _IS + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

USER = either_case("(?:username|user|login|account|client_?id)") + _IS + "[A-Za-z0-9._@+-]{2,}"
OPAQUE = "[A-Za-z0-9+/]{32,}"
ENDPOINT = "[A-Za-z]{2,12}://[A-Za-z0-9._~:/?#@%&=+-]+"
SCOPE_END = r"\n[\x20\t\r]*\n"

STRONG = ("assign", "access", "hex")
KINDS = (*STRONG, "user", "short", "opaque", "endpoint")
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "user": USER, "opaque": OPAQUE, "endpoint": ENDPOINT}
# A text without any of these has no match of the kind, which is quicker to see than the pattern.
HINTS = {"access": "AKIA", "endpoint": "://"}

IDENTIFIERS = ("access", "user")
SECRETS = ("assign", "hex", "short", "opaque")


def _gaps(text: Column, pattern: str) -> Column:
    """How many characters lie before, between and behind the matches."""
    return F.transform(F.split(text, pattern), lambda piece: F.length(piece))


def _matches(text: Column, kind: str) -> Column:
    """Per match (``gap`` before it, ``size``, ``weak``: too short for a secret); null without a match."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, lambda m: F.length(m))
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        weak = F.transform(values, lambda v: F.length(v) < LEAST_SECRET)
    else:
        weak = F.transform(found, lambda m: F.lit(False))
    zipped = F.arrays_zip(_gaps(text, pattern).alias("gap"), sizes.alias("size"), weak.alias("weak"))
    has = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    return F.when(has & F.rlike(text, F.lit(pattern)), F.filter(zipped, lambda m: m["size"].isNotNull()))


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """Rows with a number, their matches by kind and, where a weak kind occurs, the lengths of scopes."""
    rows = packed(docs).select("row", text_or_empty(field(text)).alias("said"))
    said = F.col("said")
    rows = rows.select("row", "said", *[_matches(said, kind).alias(kind) for kind in PATTERNS])
    short = F.exists("assign", lambda m: m["weak"])
    linkable = F.coalesce(short, F.lit(False)) | F.coalesce("user", "opaque", "endpoint").isNotNull()
    ends = F.regexp_extract_all(said, F.lit(SCOPE_END), F.lit(0))
    scopes = F.arrays_zip(_gaps(said, SCOPE_END).alias("gap"), F.transform(ends, lambda e: F.length(e)).alias("size"))
    return rows.select(
        F.monotonically_increasing_id().alias("number"), "row", *PATTERNS, F.when(linkable, scopes).alias("scopes")
    )


def _spread(scanned: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """``number``, ``kind``, ``weak``, ``start``, ``end`` of the entries of the named lists."""
    entry = "struct<kind:string,at:int,gap:int,size:int,weak:boolean>"

    def entries(kind: str, values: Column) -> Column:
        tagged = F.transform(
            values,
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("at"),
                m["gap"].alias("gap"),
                F.coalesce(m["size"], F.lit(0)).alias("size"),
                (m["weak"] if kind != "scope" else F.lit(False)).alias("weak"),
            ),
        )
        return F.coalesce(tagged.cast(f"array<{entry}>"), F.array().cast(f"array<{entry}>"))

    flat = scanned.select("number", F.inline(F.concat(*[entries(k, v) for k, v in lists.items()])))
    before = Window.partitionBy("number", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(before)
    return flat.select(
        "number", "kind", "at", "weak", (upto - F.col("size")).alias("start"), upto.alias("end"), (upto - F.col("size") - F.col("gap")).alias("opens")
    )


def _uncovered(parts: DataFrame) -> DataFrame:
    """Without the weak parts that overlap a strong one."""
    order = Window.partitionBy("number").orderBy("start")
    strong = F.col("kind").isin(*STRONG)
    reached = F.max(F.when(strong, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(strong, F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    clear = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end"))
    return parts.withColumn("clear", strong | clear).where("clear").drop("clear")


def _linked(parts: DataFrame, scopes: DataFrame) -> DataFrame:
    """The weak parts that complementary parts stand beside, in one scope (``scope`` is its number from 0)."""
    cells = F.sequence(F.floor(F.col("opens") / CELL), F.floor(F.col("start") / CELL))
    spans = scopes.select("number", F.col("at").alias("scope"), "opens", F.col("start").alias("closes"), F.explode(cells).alias("cell"))
    placed = parts.withColumn("cell", F.floor(F.col("start") / CELL)).join(spans, ["number", "cell"])
    placed = placed.where((F.col("opens") <= F.col("start")) & (F.col("start") < F.col("closes")))
    near = Window.partitionBy("number", "scope").orderBy("start").rangeBetween(-REACH, REACH)
    identifier = F.max(F.col("kind").isin(*IDENTIFIERS)).over(near)
    secret = F.max(F.col("kind").isin(*SECRETS)).over(near)
    told = placed.withColumn("identifier", identifier).withColumn("secret", secret)
    needs = (
        F.when(F.col("kind").isin(*IDENTIFIERS), F.col("secret"))
        .when(F.col("kind").isin(*SECRETS), F.col("identifier"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return told.where(~F.col("kind").isin(*STRONG) & needs).select("number", "kind", "start", "end", "scope")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every input row with ``spans``, its findings: array of ``start``, ``end`` (code points, end exclusive), ``kind``, ``scope``.

    Spans are ordered by start, then kind (:data:`KINDS`). Of each kind the leftmost matches that do not overlap count. ``assign``
    is a named secret of at least six characters, ``access`` an access key id, ``hex`` a run of hex digits; these are always
    reported, with a null scope. Weak parts: ``user`` (a named login), ``short`` (a named secret of fewer than six characters),
    ``opaque`` (32 or more letters and digits in a row), ``endpoint`` (an address with a scheme). One that overlaps a strong part is none.
    A login needs a secret (strong or weak) beside it, a secret an access key id or login, an endpoint both: in the same
    paragraph, starting at most 400 characters away. ``scope`` is the paragraph's number from 0.

    Null and empty texts have no spans; repeated rows are separate; an empty table gives no rows. Texts of any length are
    read whole. An input column called ``spans`` is kept as ``spans_in``.
    """
    scanned = stored(_scanned(docs, text), "scanned-secrets")
    parts = _spread(scanned, {kind: F.col(kind) for kind in PATTERNS})
    parts = parts.select(
        "number", F.when(F.col("weak"), "short").otherwise(F.col("kind")).alias("kind"), "start", "end"
    )
    scopes = _spread(scanned, {"scope": F.col("scopes")})
    parts = stored(_uncovered(parts), "secret-parts")
    strong = parts.where(F.col("kind").isin(*STRONG)).select("number", "kind", "start", "end", F.lit(None).cast("int").alias("scope"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind", "scope")
    found = strong.unionByName(_linked(parts, scopes)).groupBy("number").agg(F.array_sort(F.collect_list(span)).alias("found"))
    told = scanned.select("number", "row").join(found, "number", "left")
    shape = "array<struct<start:bigint,end:bigint,kind:string,scope:int>>"
    spans = F.transform("found", lambda s: F.struct(s["start"], s["end"], s["kind"], s["scope"])).cast(shape)
    told = told.withColumn("spans", F.coalesce(spans, F.array().cast(shape)))
    return told.select(*unpacked(told, docs.columns, ["spans"]))


def span_names(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
