"""Chat formatting: conversations of typed content parts as one training text each.

A message holds text or a list of typed parts. A visitor turns every part into a piece of text: text
parts into escaped text, image, audio and document parts into ordered placeholders. It records the
attachment each placeholder stands for and how many tokens a model will expand it to. Everything is
a column expression; a conversation is brought together once, by one shuffle.

The template of a turn is::

    ### <role>: <content></turn>\\n

Control strings are ``### ``, ``</turn>`` and the placeholder openings. Inside texts, a first
character of a control string, any backslashes and the rest of a control string get one more
backslash in between (``</turn>`` becomes ``<\\/turn>``, ``<\\/turn>`` becomes ``<\\\\/turn>``), so no
control string is left in a text and removing one backslash restores it. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import text_or_empty

TURN_OPEN, ROLE_END, TURN_CLOSE = "### ", ": ", "</turn>\n"
KINDS = ("image", "audio", "document")

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)

# A control string is one of these heads and its tail.
_TAILS = r"(/turn>|image>|audio>|document>|other>)"


def escape(text: Column) -> Column:
    """One backslash more inside everything that reads like a control string."""
    text = F.regexp_replace(text, r"<(\\*)" + _TAILS, r"<$1\\$2")
    return F.regexp_replace(text, r"#(\\*)## ", r"#$1\\## ")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    text = F.regexp_replace(text, r"#\\(\\*)## ", r"#$1## ")
    return F.regexp_replace(text, r"<\\(\\*)" + _TAILS, r"<$1$2")


def text_part(text: Column) -> Column:
    """A single text part with the schema of :data:`PART`."""
    values = {"kind": F.lit("text"), "text": text}
    return F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields]
    )


class PartVisitor:
    """What each kind of part becomes; override a method to change one kind.

    Sizes that are null or negative count as 0. A part of unknown or null kind keeps its place as
    ``<other>`` and expands to no tokens; a null part is empty text.
    """

    def __init__(self, patch: int = 14, audio_tokens_per_second: float = 25.0, tokens_per_page: int = 1024):
        self.patch = patch
        self.audio_rate = audio_tokens_per_second
        self.per_page = tokens_per_page

    def text(self, part: Column) -> Column:
        return escape(text_or_empty(part["text"]))

    def image_tokens(self, part: Column) -> Column:
        rows, cols = (F.ceil(_size(part[c]) / self.patch) for c in ("height", "width"))
        return (rows * cols).cast("long")

    def audio_tokens(self, part: Column) -> Column:
        return F.ceil(_size(part["seconds"]) * self.audio_rate).cast("long")

    def document_tokens(self, part: Column) -> Column:
        return (_size(part["pages"]) * self.per_page).cast("long")

    def visit(self, part: Column) -> Column:
        """struct(piece, kind, ref, tokens); ``kind`` is null for text."""
        is_text = part.isNull() | (part["kind"].eqNullSafe("text"))
        kind = F.when(is_text, F.lit(None).cast("string")).when(
            part["kind"].isin(*KINDS), part["kind"]
        ).otherwise("other")
        tokens = (
            F.when(kind == "image", self.image_tokens(part))
            .when(kind == "audio", self.audio_tokens(part))
            .when(kind == "document", self.document_tokens(part))
            .otherwise(F.lit(0).cast("long"))
        )
        return F.struct(
            F.when(is_text, self.text(part)).otherwise(F.concat(F.lit("<"), kind, F.lit(">"))).alias("piece"),
            kind.alias("kind"),
            F.when(kind.isNotNull(), part["ref"]).alias("ref"),
            tokens.alias("tokens"),
        )


def _size(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def format_chats(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str | None = "text",
    parts: str | None = None,
    loss_roles: tuple[str, ...] = ("assistant",),
    visitor: PartVisitor | None = None,
) -> DataFrame:
    """One row per conversation: the formatted text and what a trainer needs beside it.

    ``messages`` has one row per message, with a ``text`` column or a ``parts`` column (an array of
    :data:`PART`). Other columns are ignored. Columns of the result:

    ``conv_id``; ``formatted``; ``turns``: per turn ``role``, ``start`` and ``length`` in the formatted
    text, ``body_start`` and ``body_length`` of its content, ``loss`` (is the content trained on);
    ``attachments``: per placeholder, in order, ``ordinal`` from 1, ``kind``, ``ref``, ``position`` in the
    formatted text and ``tokens``; ``expanded_tokens``: their sum. Offsets count code points from 0.

    Rows are ordered by turn (null first), then role, then content; equal rows are all kept. A null
    conversation id is a conversation of its own; a null role is the empty role; null text or parts
    are empty content; an empty table gives no rows. A conversation is one training text and so has to
    fit one row; nothing larger is ever gathered.
    """
    visitor = visitor or PartVisitor()
    if parts is not None:
        raw_parts = F.coalesce(F.col(parts), F.array().cast(T.ArrayType(PART)))
    else:
        raw_parts = F.array(text_part(F.col(text)))
    rows = messages.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.transform(raw_parts, visitor.visit).alias("visited"),
    )
    rows = rows.select(
        "conv",
        "turn",
        "role",
        "visited",
        F.concat(F.lit(TURN_OPEN), F.url_encode("role"), F.lit(ROLE_END)).alias("head"),
        F.array_join(F.col("visited.piece"), "").alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(TURN_CLOSE)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "visited")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv",
        "piece",
        "visited",
        F.row_number().over(order).alias("n"),
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("start"),
        F.length("head").cast("long").alias("head_length"),
        F.length("body").cast("long").alias("body_length"),
        "role",
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<kind:string,ref:string,position:bigint,tokens:bigint>>").alias("found"))

    def walk(state: Column, part: Column) -> Column:
        entry = F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), state["at"].alias("position"), part["tokens"].alias("tokens"))
        return F.struct(
            (state["at"] + F.length(part["piece"])).alias("at"),
            F.when(part["kind"].isNull(), state["found"]).otherwise(F.array_append(state["found"], entry)).alias("found"),
        )

    holds_any = F.exists("visited", lambda p: p["kind"].isNotNull())
    body_start = F.col("start") + F.col("head_length")
    found = F.when(holds_any, F.aggregate("visited", start, walk)["found"]).otherwise(start["found"])
    turns = F.struct(
        F.col("n"),
        F.col("piece"),
        F.struct(
            F.col("role"),
            F.col("start"),
            F.length("piece").cast("long").alias("length"),
            body_start.alias("body_start"),
            F.col("body_length"),
            F.col("role").isin(*loss_roles).alias("loss"),
        ).alias("turn"),
        F.transform(
            found,
            lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), (a["position"] + body_start).alias("position"), a["tokens"].alias("tokens")),
        ).alias("found"),
    )
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turns)).alias("all"))
    attachments = F.transform(
        F.flatten(F.col("all.found")),
        lambda a, i: F.struct((i + 1).alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["position"].alias("position"), a["tokens"].alias("tokens")),
    )
    return whole.select(
        F.col("conv").alias("conv_id"),
        F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.col("all.turn").alias("turns"),
        attachments.alias("attachments"),
    ).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Roles and texts read back from the formatted text alone; the inverse of formatting plain texts.

    Adds ``parsed``: per turn ``role`` and ``text``. Placeholders stay as they are.
    """
    pieces = F.filter(F.split("formatted", TURN_CLOSE), lambda p: p != "")
    return formatted.withColumn(
        "parsed",
        F.transform(
            pieces,
            lambda p: F.struct(
                F.url_decode(F.substring(F.substring_index(p, ROLE_END, 1), F.lit(len(TURN_OPEN) + 1), F.length(p))).alias("role"),
                unescape(
                    F.substring(p, F.length(F.substring_index(p, ROLE_END, 1)) + F.lit(len(ROLE_END) + 1), F.length(p))
                ).alias("text"),
            ),
        ),
    )


def masked_texts(formatted: DataFrame) -> Column:
    """The unescaped contents under the loss mask, in order, cut by the recorded offsets.

    The text is cut into turns once, so the work grows with the text, not with text times turns.
    """
    pieces = F.split("formatted", f"(?<={TURN_CLOSE})")
    cut = F.zip_with(
        pieces,
        "turns",
        lambda p, t: F.when(
            t["loss"],
            unescape(F.substring(p, (t["body_start"] - t["start"] + 1).cast("int"), t["body_length"].cast("int"))),
        ),
    )
    return F.filter(cut, lambda x: x.isNotNull())
