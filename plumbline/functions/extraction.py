"""Scores and verdicts read out of free judge text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasoning tags, then the score and verdict formats in order of priority.
REASONING_CLOSED = r"(?is)<(think|thinking|reasoning)>.*?</\1>"
REASONING_OPEN = r"(?is)<(?:think|thinking|reasoning)>.*"
SCORE_FORMATS = [
    r"(?i)SCORE\s*[:=]\s*\**\s*(-?\d+(?:\.\d+)?)",
    r"(?i)\b(?:rating|score)\b\D{0,12}(-?\d+(?:\.\d+)?)\s*/\s*10",
    r"(?m)^\s*(-?\d+(?:\.\d+)?)\s*(?:/\s*10)?\s*$",
    r"(?i)(-?\d+(?:\.\d+)?)\s*(?:out of|/)\s*10",
]
VERDICT_FORMATS = [
    r"(?i)VERDICT\s*[:=]\s*\**\s*(A|B|TIE)\b",
    r"(?i)\b(?:answer|trajectory|option)\s+(A|B)\s+is\s+better",
    r"(?im)^\s*(A|B|tie)\s*$",
]


def without_reasoning(text: Column) -> Column:
    """Text after its thinking blocks; an unfinished block hides everything behind it."""
    closed = F.regexp_replace(text, F.lit(REASONING_CLOSED), F.lit(""))
    opened = F.regexp_replace(closed, F.lit(REASONING_OPEN), F.lit(""))
    kept = F.when(F.contains(text, F.lit("<")), opened).otherwise(text)
    return F.btrim(kept, F.lit(" \t\n\r\x0b\x0c"))


def score_of(text: Column, low: float = 1.0, high: float = 10.0) -> Column:
    """The first value in range of the first format that has one, else null."""
    cleaned = without_reasoning(text)
    slack = 1e-9

    def first_in_range(pattern: str) -> Column:
        found = F.transform(
            F.regexp_extract_all(cleaned, F.lit(pattern), F.lit(1)), lambda s: s.cast("double")
        )
        fitting = F.filter(found, lambda v: (v >= low - slack) & (v <= high + slack))
        return F.get(fitting, F.lit(0))

    return F.coalesce(*[first_in_range(p) for p in SCORE_FORMATS])


def verdict_of(text: Column) -> Column:
    """'A', 'B', 'tie' or null."""
    cleaned = without_reasoning(text)
    hits = [
        F.get(F.regexp_extract_all(cleaned, F.lit(p), F.lit(1)), F.lit(0)) for p in VERDICT_FORMATS
    ]
    return F.replace(F.upper(F.coalesce(*hits)), F.lit("TIE"), F.lit("tie"))
