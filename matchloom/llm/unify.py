"""One consistent form for texts that look the same but consist of different characters.

A transducer over grapheme clusters, compiled once from a mapping that is derived from the Unicode
data and checked for conflicts, rewrites each text in one pass: width forms, ligatures and number
letters become plain ones, any spelling of an accented letter becomes its NFC letter, every space
becomes U+0020, invisible characters vanish, and look-alike letters become letters of the text's own
script. A trie gives the longest match inside each cluster.

Defined results: null stays null; the empty text stays empty; a text wholly in one script keeps its
letters; a word wholly in another script that has letters no look-alike exists for keeps its letters;
symbols (superscripts, fractions, number and trade mark signs, emoji sequences) and proper accents are
kept; repeated rows each get their result; texts of any length are rewritten whole.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections import Counter
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import table

# Letters of other scripts that are drawn like a Latin letter, by script.
LOOK_ALIKES = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜавеѕіјкмнорстухүԛԝһӏԁ", "ABESIJKMHOPCTYXYQWaBesijkMHopcTyxyqwhld")),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικυ", "ABEZHIKMNOPTYXavopiku")),
}
# Small Cyrillic letters that are drawn like small capitals only; they are no look-alikes of the letters above.
for _letter in "вкмнт":
    LOOK_ALIKES["Cyrillic"].pop(_letter)
# Of these, the letters that no text written in that script today is full of; Latin letters never become these.
RARE = frozenset("ЅҮԚԜѕүԛԝһӏԁ")
# Latin letters drawn like another Latin letter.
LATIN_TWINS = {"Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g"}
# Letters whose texts use the capital eth as a letter of its own.
NORDIC = regex.compile("[ÞþðÆæØø]")
SCRIPTS = ("Latin", "Cyrillic", "Greek")
#: Kinds of compatibility mapping that only change a letter's form, not what it says.
FORMS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Blocks of ligatures and number letters, whose mapping is spelled out although its kind is <compat>.
SPELLED = (range(0x2160, 0x2180), range(0xFB00, 0xFB07), range(0x1C4, 0x1CD), range(0x132, 0x134))
#: A text of these characters only is consistent already (checked in the JVM, where $ would let a final line separator pass).
PLAIN = r"^[\x20-\x7eÀ-ÏÑ-ıĴ-žƠơƯưẠ-ỹ]*(?![\s\S])"

#: Control characters that part words like a blank; the others are invisible.
BREAKS = "\t\n\x0b\x0c\r\x85"

_CLUSTER = regex.compile(r"\X")
_EMOJI = regex.compile(r"\p{Extended_Pictographic}")
_JOINED = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Sinhala}\p{Malayalam}\p{Mongolian}]")
_OF = {s: regex.compile(rf"\p{{{s}}}") for s in SCRIPTS}


class Conflict(ValueError):
    """Two rules give one source different results, or a result is a source again."""


def _add(rules: dict[str, str], source: str, target: str) -> None:
    if rules.setdefault(source, target) != target:
        raise Conflict(f"{source!r} would become both {rules[source]!r} and {target!r}")


@cache
def letter_rules() -> dict[str, str]:
    """Single characters: widths, forms, spaces, invisible characters."""
    rules: dict[str, str] = {"\u2010": "-", "\u2011": "-"}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c in rules:
            continue
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind in ("Zs", "Zl", "Zp") or c in BREAKS:
            if c != " ":
                _add(rules, c, " ")
        elif kind in ("Cf", "Cc") or c in "\u034f\u3164" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x115F <= code <= 0x1160:
            _add(rules, c, "")
        else:
            parts = unicodedata.decomposition(c).split(" ")
            if parts[0] in FORMS or any(code in block for block in SPELLED):
                _add(rules, c, unicodedata.normalize("NFKC", c))
            elif (plain := unicodedata.normalize("NFC", c)) != c and len(plain) == 1:
                _add(rules, c, plain)
    return rules


@cache
def accent_rules() -> dict[str, str]:
    """Every order of base letter and marks, and every half-composed spelling, of each accented letter."""
    rules: dict[str, str] = {}
    for code in itertools.chain(range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000)):
        c = chr(code)
        full = unicodedata.normalize("NFD", c)
        if unicodedata.normalize("NFC", c) != c or len(full) < 2:
            continue
        base, marks = full[0], full[1:]
        for n in range(len(marks)):
            for first in itertools.combinations(range(len(marks)), n):
                start = unicodedata.normalize("NFC", base + "".join(marks[i] for i in first))
                rest = [m for i, m in enumerate(marks) if i not in first]
                if len(start) == 1:
                    for order in itertools.permutations(rest):
                        spelled = start + "".join(order)
                        # marks of one class stack: another order is another text
                        if unicodedata.normalize("NFC", spelled) == c:
                            _add(rules, spelled, c)
    return rules


@cache
def twin_rules(script: str) -> dict[str, str]:
    """Look-alike letters, into the letters of `script`."""
    rules: dict[str, str] = {}
    for other, letters in LOOK_ALIKES.items():
        for letter, latin in letters.items():
            if script == "Latin":
                _add(rules, letter, latin)
            elif script == other and letter not in RARE and latin not in rules:
                rules[latin] = letter
    for c in map(chr, range(0x370, 0x530)) if script == "Latin" else ():
        base, marks = unicodedata.normalize("NFD", c)[:1], unicodedata.normalize("NFD", c)[1:]
        if marks and base in rules and len(letter := unicodedata.normalize("NFC", rules[base] + marks)) == 1:
            _add(rules, c, letter)
    if script == "Latin":
        for a, b in LATIN_TWINS.items():
            _add(rules, a, b)
    return rules


def check(rules: dict[str, str]) -> dict[str, str]:
    """No result may hold a source: then one pass is enough and the form is stable."""
    for source, target in rules.items():
        if any(c in rules for c in target):
            raise Conflict(f"the result of {source!r}, {target!r}, is a source again")
    return rules


class Transducer:
    """Longest-match rewriting inside a cluster: characters are folded, accents composed along a trie."""

    def __init__(self, script: str | None, nordic: bool = False):
        fold = dict(letter_rules())
        for source, target in (twin_rules(script) if script else {}).items():
            if not (nordic and source == "Ð"):
                _add(fold, source, target)
        # a width or form variant of a look-alike goes all the way
        self.fold = check({s: "".join(fold.get(c, c) for c in t) for s, t in fold.items()})
        self.trie: dict = {}
        for spelled, letter in accent_rules().items():
            node = self.trie
            for c in spelled:
                node = node.setdefault(c, {})
            node[""] = letter
        self.seen: dict[str, str] = {}

    def cluster(self, cluster: str) -> str:
        known = self.seen.get(cluster)
        if known is None:
            if _EMOJI.search(cluster) or _JOINED.search(cluster):
                known = unicodedata.normalize("NFC", cluster)
            else:
                known = self.compose("".join(self.fold.get(c, c) for c in cluster))
            if len(self.seen) < 65536:
                self.seen[cluster] = known
        return known

    def compose(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            node, j, best, end = self.trie, i, None, i
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    best, end = node[""], j
            out.append(best or text[i])
            i = end if best else i + 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        return "".join(map(self.cluster, _CLUSTER.findall(text)))


@cache
def transducer(script: str | None, nordic: bool = False) -> Transducer:
    return Transducer(script, nordic)


@cache
def _script(c: str) -> str | None:
    return next((s for s in SCRIPTS if _OF[s].match(c)), None)


def _twin(c: str, into: str) -> bool:
    """Whether `into` has a letter drawn like c, accents included."""
    full, twins = unicodedata.normalize("NFD", c), twin_rules(into)
    return c in twins or (full[0] in twins and len(unicodedata.normalize("NFC", twins[full[0]] + full[1:])) == 1)


@cache
def _forms() -> dict[int, str]:
    return {ord(c): t for c, t in letter_rules().items()}


def own_script(text: str) -> str | None:
    """The script with most letters that have no look-alike in another; then the one with most letters."""
    letters = Counter(c for c in text.translate(_forms()) if _script(c))
    count: Counter = Counter()
    alone: Counter = Counter()
    for c, n in letters.items():
        s = _script(c)
        count[s] += n
        if not any(_twin(c, other) for other in SCRIPTS if other != s):
            alone[s] += n
    if not count:
        return None
    if len(count) == 1:
        return next(iter(count))
    return max(SCRIPTS, key=lambda s: (alone[s], count[s], s == "Latin"))


def unify_text(text: str) -> str:
    """The consistent form of one text."""
    script = own_script(text)
    nordic = bool(NORDIC.search(text))
    plain, own = transducer(None), transducer(script, nordic)

    def word(m: regex.Match) -> str:
        w = m.group()
        if script:
            found = {(c, _script(c)) for c in w.translate(_forms()) if _script(c)}
            if found and all(s != script for _, s in found) and not all(_twin(c, script) for c, s in found):
                return plain(w)
        return own(w)

    out = regex.sub(rf"[^\p{{Z}}{BREAKS}]+|[\p{{Z}}{BREAKS}]+", word, text)
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


def unified(c: Column) -> Column:
    """The consistent form of a text column; texts of plain characters stay in the JVM."""

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(unify_text, na_action="ignore")

    return F.when(c.isNull() | c.rlike(PLAIN), c).otherwise(rewrite(F.when(~c.rlike(PLAIN), c)))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields of this data as (field_name, row_id, value)."""
    names = table(spark, sf_dir, "khachhang").select(F.lit("khachhang.tenkh").alias("field_name"), "row_id", F.col("tenkh").alias("value"))
    tables = table(spark, sf_dir, "table_mapping_report").select(
        F.lit("table_mapping_report.normalized_student_table").alias("field_name"), F.col("map_id").alias("row_id"), F.col("normalized_student_table").alias("value")
    )
    return names.unionByName(tables)


def odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: values that are not in the consistent form."""
    odd = fields(spark, sf_dir).where(F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN))
    return odd.where(~unified(F.col("value")).eqNullSafe(F.col("value"))).select("field_name", "row_id")


def unified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its consistent form."""
    return fields(spark, sf_dir).withColumn("unified", unified(F.col("value")))


def equal_looking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent forms that more than one spelling stands for: spellings and rows of each."""
    forms = unified_values(spark, sf_dir).where("unified IS NOT NULL").groupBy("field_name", "unified", "value").agg(F.count(F.lit(1)).alias("n"))
    return forms.groupBy("field_name", "unified").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows")).where("spellings > 1")
