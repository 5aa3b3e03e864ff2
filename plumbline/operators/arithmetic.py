"""Replay of recorded arithmetic: numbers, + - * / // % ** with signs and brackets, nothing else.

Spark has no operator that evaluates an expression held in a column, so this is a vectorised
helper. Equal expressions of a batch are evaluated once.
"""

from __future__ import annotations

import math
import operator
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Longest expression and largest exponent.
MAX_LENGTH = 200
MAX_EXPONENT = 8

DIGITS = r"\d(?:_?\d)*"
TOKEN = re.compile(
    rf"\s*(?:(0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    rf"|(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?)|(\*\*|//|[-+*/%()]))"
)
# operator -> (precedence, function)
BINARY = {
    "+": (1, operator.add),
    "-": (1, operator.sub),
    "*": (2, operator.mul),
    "/": (2, operator.truediv),
    "//": (2, operator.floordiv),
    "%": (2, operator.mod),
}
SIGN, POWER = 3, 4


def _tokens(text: str) -> list[float | str]:
    out: list[float | str] = []
    at, end = 0, len(text.rstrip())
    while at < end:
        found = TOKEN.match(text, at)
        if not found:
            raise ValueError("not arithmetic")
        number = found[1]
        if number is None:
            out.append(found[2])
        elif number[:2].lower() in ("0x", "0o", "0b") or number.replace("_", "").isdigit():
            out.append(float(int(number, 0)))
        else:
            out.append(float(number))
        at = found.end()
    return out


def _power(base: float, exponent: float) -> float:
    if abs(exponent) > MAX_EXPONENT:
        raise ValueError("exponent too large")
    result = base**exponent
    if isinstance(result, complex):
        raise ValueError("not a real number")
    return result


def _value(tokens: list[float | str]) -> float:
    """Value of the tokens, with a stack of waiting operators, so that any nesting is read."""
    values: list[float] = []
    waiting: list[tuple[int, str]] = []  # (precedence, operator); an open bracket has 0

    def apply(floor: int) -> None:
        while waiting and waiting[-1][0] >= floor:
            level, name = waiting.pop()
            right = values.pop()
            if level == SIGN:
                values.append(-right if name == "-" else right)
            elif level == POWER:
                values.append(_power(values.pop(), right))
            else:
                values.append(BINARY[name][1](values.pop(), right))

    operand_next = True
    for token in tokens:
        if operand_next:
            if isinstance(token, float):
                values.append(token)
                operand_next = False
            elif token in ("+", "-"):
                waiting.append((SIGN, token))
            elif token == "(":
                waiting.append((0, token))
            else:
                raise ValueError("operand expected")
        elif token == "**":
            # binds tighter than a sign on its left and groups to the right
            waiting.append((POWER, token))
            operand_next = True
        elif token in BINARY:
            apply(BINARY[token][0])
            waiting.append((BINARY[token][0], token))
            operand_next = True
        elif token == ")":
            apply(1)
            if not waiting:
                raise ValueError("bracket not opened")
            waiting.pop()
        else:
            raise ValueError("operator expected")
    if operand_next:
        raise ValueError("incomplete")
    apply(1)
    if waiting:
        raise ValueError("bracket not closed")
    return values[0]


def evaluate(text: str | None) -> str | None:
    """The printed value: an integer if whole, else four decimals without trailing zeros. None for
    anything that is not finite arithmetic."""
    if text is None or len(text) > MAX_LENGTH or text[:1] in (" ", "\t"):
        return None
    try:
        value = _value(_tokens(text))
        if not math.isfinite(value):
            return None
        if value % 1:
            return f"{value:.4f}".rstrip("0").rstrip(".")
        return str(int(value))
    except (ValueError, ArithmeticError):
        return None


@F.pandas_udf(StringType())
def replay_arithmetic(expressions: pd.Series) -> pd.Series:
    known = {e: evaluate(e) for e in expressions.dropna().unique()}
    return expressions.map(known, na_action="ignore").astype(object).where(expressions.notna(), None)
