"""Canonical forms of output values: text, number and date, as the comparison operators see them.

Null stays null and NaN becomes null. Unparseable dates are compared as text.
"""

from __future__ import annotations

import math
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared types of view outputs, by how their values compare.
NUMERIC = frozenset({"decimal", "float", "int", "numeric", "number", "integer"})
TEMPORAL = frozenset({"date", "datetime", "time"})

_EDGES = r"(?U)^\s+|\s+$"


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Canonical composition, one Arrow batch at a time."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def composed(c: Column) -> Column:
    """NFC; only texts with combining marks or unusual letters leave the JVM."""
    stable = c.isNull() | ~c.rlike(r"[^\x00-˿Ḁ-ỿ‐-‧₫ぁ-ゖァ-ヺ一-鿿가-힣]")
    return F.when(stable, c).otherwise(nfc(F.when(~stable, c)))


def text(c: Column) -> Column:
    """NFC, trimmed, lower case, inner white space as one blank."""
    return F.regexp_replace(F.lower(F.regexp_replace(composed(c), _EDGES, "")), r"(?U)\s+", " ")


def decimals(tolerance: float) -> int:
    """Decimal places a tolerance stands for: 0.01 is 2, 1 and more (or none) is 0."""
    return max(0, round(-math.log10(tolerance))) if tolerance > 0 else 0


def number(c: Column, tolerance: float = 0.01) -> Column:
    """Rounded half to even at the tolerance's decimals; NaN and text that is no number are null."""
    x = c.try_cast("double")
    scale = float(10 ** decimals(tolerance))
    return F.when(~F.isnan(x), F.rint(x * scale) / scale + F.lit(0.0))


def number_half_up(c: Column, tolerance: float = 0.01) -> Column:
    """Rounded half up on the decimal text, as ordered comparison does."""
    return F.round(c.cast("string").try_cast("decimal(38,10)"), decimals(tolerance)).cast("double")


def date(c: Column) -> Column:
    """Text of a date: zero padded, without a time of midnight; other texts as `text`."""
    s = F.regexp_replace(F.regexp_replace(c.cast("string"), _EDGES, ""), r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})[ T]00:00(:00(\.0+)?)?$", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"^([0-9]{4})-([0-9])-", "$1-0$2-"), r"^([0-9]{4}-[0-9]{2})-([0-9])($|[ T])", "$1-0$2$3")
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), s).otherwise(F.lower(s))


def date_column(df: DataFrame, column: str) -> Column:
    """One format for the whole column: dates only if every value is at midnight and none is null.

    Needs one aggregate over the column, joined back as a single row.
    """
    stamp = F.to_timestamp_ntz(F.col(column).cast("string"))
    plain = F.coalesce(F.bool_and((F.date_format(stamp, "HH:mm:ss") == "00:00:00") & stamp.isNotNull()), F.lit(False))
    only_dates = df.select(plain).scalar()
    return F.when(only_dates, F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))


def by_type(c: Column, declared: str, tolerance: float = 0.01, number_as_text: bool = False, half_up: bool = False) -> Column:
    """The canonical form for a declared type. `number_as_text` keeps the old reading of number and integer as text; `half_up` is for ordered outputs."""
    declared = declared.lower()
    if declared in NUMERIC and not (number_as_text and declared in ("number", "integer")):
        return (number_half_up if half_up else number)(c, 1.0 if declared == "int" else tolerance)
    if declared in TEMPORAL:
        return date(c)
    return text(c.cast("string"))


def align(df: DataFrame, expected: list[tuple[str, str]], names: dict[str, str], tolerance: float = 0.01, number_as_text: bool = False) -> DataFrame:
    """Rename by `names` (physical to canonical), keep the expected columns in order, add missing ones as null, canonicalize.

    An empty frame keeps the schema. Extra columns are dropped before renaming, so clashing names do no harm.
    """
    by_name = {canonical: physical for physical, canonical in names.items() if physical in df.columns}
    out = []
    for column, declared in expected:
        kind = T.DoubleType() if declared.lower() in NUMERIC and not (number_as_text and declared.lower() in ("number", "integer")) else T.StringType()
        physical = by_name.get(column, column if column in df.columns else None)
        value = F.lit(None).cast(kind) if physical is None else by_type(df[f"`{physical}`"], declared, tolerance, number_as_text)
        out.append(value.cast(kind).alias(column))
    return df.select(*out)
