"""Number to text, with the rounding of the exact binary value.

The JVM formatter rounds the shortest decimal that reads back as the double, so 0.00015 printed to
four places comes out as 0.0002 although the stored value lies below the tie. Replay compares
printed results character by character, so the exact value has to decide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10000.0
SPLITTER = 134217729.0  # 2^27 + 1: halves a double into two parts with exact products


def fixed4(x: Column) -> Column:
    """x with four decimals, ties on the exact binary value to even. Exact below 2^63."""
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole.cast("double")
    guess = F.floor(part * SCALE).cast("double")
    lifted = part * SPLITTER
    high = lifted - (lifted - part)
    low = part - high
    rest = (high * SCALE - guess) + low * SCALE
    odd = F.pmod(guess, F.lit(2.0)) == 1
    up = (rest > 0.5) | ((rest == 0.5) & odd)
    digits = (guess + F.when(up, 1.0).otherwise(0.0)).cast("bigint")
    carried = whole + F.when(digits >= 10000, 1).otherwise(0)
    digits = F.when(digits >= 10000, digits - 10000).otherwise(digits)
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(
        sign, carried.cast("string"), F.lit("."), F.lpad(digits.cast("string"), 4, "0")
    )


def strip_zeros(text: Column) -> Column:
    """Trailing zeros of a printed decimal, then a bare point, removed."""
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def short4(x: Column) -> Column:
    """Four decimals without trailing zeros."""
    return strip_zeros(fixed4(x))


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros; powers of ten outside 1e-4..1e6."""
    parts = F.split(F.format_string("%.5e", x), "e")
    power = F.get(parts, F.lit(1)).cast("int")
    plain = F.call_function(
        "format_string",
        F.concat(F.lit("%."), F.greatest(F.lit(5) - power, F.lit(0)).cast("string"), F.lit("f")),
        x,
    )
    plain = F.when(F.instr(plain, ".") > 0, strip_zeros(plain)).otherwise(plain)
    scientific = F.concat(strip_zeros(F.get(parts, F.lit(0))), F.lit("e"), F.get(parts, F.lit(1)))
    return (
        F.when(x == 0, F.lit("0"))
        .when((power >= -4) & (power < 6), plain)
        .otherwise(scientific)
    )


def decimals(x: Column, places: Column) -> Column:
    """x printed with a per-row number of decimals; with none, rounded half to even."""
    fraction = F.call_function(
        "format_string", F.concat(F.lit("%."), places.cast("string"), F.lit("f")), x
    )
    return F.when(places > 0, fraction).otherwise(F.bround(x, 0).cast("bigint").cast("string"))
