"""Text functions on names and identifiers: Column expressions that stay in the JVM, but for the Arrow-batched common subsequence."""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space at either end, as Unicode sees it.
EDGES = r"(?U)^\s+|\s+$"

# Parts of a column name that give it a role, in the order in which they are tried.
ROLES = (
    ("ma", ("ma", "id", "code", "key")),
    ("ten", ("ten", "name")),
    ("ngay", ("ngay", "date", "time")),
    ("soluong", ("soluong", "qty", "quantity")),
    ("dongia", ("dongia", "price")),
    ("tongtien", ("tongtien", "amount", "thanhtien")),
)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _accent_table() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their base letters."""
    pairs = [("đ", "d"), ("Đ", "D")]
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def base_letters(name: str) -> str:
    """The letters `remove_accents` leaves, on the driver."""
    plain = name.translate(str.maketrans(*_accent_table()))
    return "".join(c for c in plain if unicodedata.category(c)[0] != "M")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    return F.regexp_replace(column(c), EDGES, "")


def remove_accents(c: Column | str) -> Column:
    """Base letters without accents; works on composed and decomposed text."""
    return F.regexp_replace(F.translate(column(c), *_accent_table()), r"\p{M}+", "")


def _without_prefixes(c: Column, question: str) -> Column:
    """Lower case without accents, a leading number and a leading question mark ('câu 3. ')."""
    plain = strip(F.lower(remove_accents(c)))
    plain = strip(F.regexp_replace(plain, r"(?U)^\d+[.\s_–-]*", ""))
    return strip(F.regexp_replace(plain, question, ""))


def clean_name(c: Column | str) -> Column:
    """Name without accents and numbering; separators stay."""
    return _without_prefixes(column(c), r"(?U)^cau\s*\d+[.\s_–-]*")


def normalize_key(c: Column | str) -> Column:
    """Compact key of a name: no accents, numbering, punctuation or separators. Null gives the empty key."""
    bare = _without_prefixes(column(c), r"(?U)^cau\s*\d*[.\s_–-]*")
    return F.coalesce(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", ""), r"(?U)[\s_–-]+", ""), F.lit(""))


def expand_abbreviations(cleaned: Column, abbreviations: dict[str, str]) -> Column:
    """Abbreviations spelled out, in their given order, then separators dropped.

    The detail mark 'ct' counts as a word of its own or in front of letters at the beginning; any other
    abbreviation counts as a whole word, at the end or at the beginning of the name.
    """
    out = F.regexp_replace(cleaned, r"\bct(?:[_\s]+|\b)|^ct(?=[a-z])", "chitiet")
    for short, full in abbreviations.items():
        out = let(out, _speller(short.lower(), full.lower()))
    return F.regexp_replace(out, r"[_\s-]+", "")


def _speller(short: str, full: str):
    """Looks a name's words up, then its end and its beginning."""
    n = len(short)

    def words(name: Column) -> Column:
        return F.array_join(F.transform(F.split(name, r"\b"), lambda w: F.when(w == short, full).otherwise(w)), "")

    def end(name: Column) -> Column:
        return F.when(name.endswith(short), F.concat(F.left(name, F.length(name) - n), F.lit(full))).otherwise(name)

    def beginning(name: Column) -> Column:
        return F.when(name.startswith(short), F.concat(F.lit(full), F.substring(name, F.lit(n + 1), F.length(name)))).otherwise(name)

    return lambda name: F.when(name == short, full).otherwise(let(let(words(name), end), beginning))


def column_role(c: Column | str) -> Column:
    """What a column holds, by its name; null if nothing tells."""
    name = F.lower(column(c))
    out = F.lit(None).cast("string")
    for role, marks in reversed(ROLES):
        hit = name.rlike("|".join(marks))
        out = F.when(hit & ~name.contains("tongtien") if role == "dongia" else hit, role).otherwise(out)
    return out


def roles_compatible(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(True))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in the bits of one integer."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _lcs(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def indel_similarity(a: Column | str, b: Column | str) -> Column:
    """Similarity 0 to 100 by insertions and deletions alone: 200 LCS / (length a + length b); two empty texts are alike."""
    a, b = column(a), column(b)
    whole = F.length(a) + F.length(b)
    return F.when(whole == 0, 100.0).otherwise(200.0 * lcs_length(a, b) / whole)


def most_similar(a: Column, b: Column) -> Column:
    """What `indel_similarity` can be at most, from the lengths alone."""
    return F.coalesce(200.0 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(100.0))


def fingerprint(c: Column | str) -> Column:
    """SHA-256 of the lower-case text with white space collapsed; empty for null and blank text."""
    plain = F.lower(strip(F.regexp_replace(F.coalesce(column(c), F.lit("")), r"(?U)\s+", " ")))
    return F.when(plain == "", "").otherwise(F.sha2(plain, 256))


def parse_value(c: Column | str) -> Column:
    """Seed value: blank and NULL texts are null, others are trimmed."""
    s = strip(c)
    return F.when((s != "") & (F.upper(s) != "NULL"), s)


def safe_int(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(strip(column(c).cast("string")).try_cast("double").try_cast("bigint"), F.lit(default))


def safe_double(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(strip(column(c).cast("string")).try_cast("double"), F.lit(default))


def split_identifiers(c: Column | str) -> Column:
    """Parts of a text between semicolons, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(column(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def view_key(c: Column | str) -> Column:
    """Lower-case letters and digits of a view's name."""
    return F.regexp_replace(F.lower(column(c)), "[^a-z0-9]", "")


def submission_id(stem: Column | str) -> Column:
    """First run of eight digits in a file's stem, else the stem in safe characters, else 'unknown'."""
    stem = column(stem)
    digits = F.regexp_extract(stem, r"\d{8}", 0)
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_-]+", "_"), r"^_+|_+$", "")
    return F.when(digits != "", digits).when(safe != "", safe).otherwise("unknown")


def is_safe_name(c: Column | str) -> Column:
    """Whether a database name is made of letters, digits and underscores and does not start with a digit."""
    return F.coalesce(column(c).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))
