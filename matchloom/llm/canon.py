"""Freely typed names mapped to the entries of a reference list, or reported as unmatched.

Every entry is spelled out in all the ways its names are usually typed (name, labels, aliases, Telex
keystrokes, other word orders, shortened and skeleton forms). A symmetric-delete dictionary of these forms
finds all within a bounded weighted distance of a typed value, also where doubled letters, which cost less, make
more edits of it; forms of more than LONG_FORM letters are compared one by one. Candidates are ranked by a weighted
Damerau-Levenshtein distance (neighbouring keys, doubled letters and swaps cost less), then by how often the
entry is used by the assignment and overall. Typed values are reduced to distinct ones before the lookup.

The list is sent to the executors in blocks of BLOCK_ENTRIES entries, so its size is bounded whatever the
list's length. Defined results: null and empty values are left out; a value no form of which is near enough
is reported with a null entry_id; ties of distance and frequency go to the smallest entry_id; repeated
entries count once each; values of any length are read whole (a value longer than every form by more than
the bound is unmatched).
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import keep, table

#: The weighted distance each length allows.
ALLOWED = ((4, 0.6), (6, 1.0), (7, 1.45), (1_000_000, 2.0))
#: Weights of a doubled letter and of a swap or a neighbouring key; any other edit costs 1.
DOUBLED, SLIP = 0.6, 0.8
#: Letters up to which a form is looked up by deletions, and words up to which a label's words are shortened in all combinations.
LONG_FORM, MIXED_WORDS = 64, 5
#: Entries per block of the dictionary.
BLOCK_ENTRIES = 5_000
#: Cost of a candidate, penalties included, up to which it counts as named.
NEAR = 2.45

# Telex keystrokes of Vietnamese marks (breve, circumflex, horn) and tones.
_TELEX_TONES = {"̀": "f", "́": "s", "̉": "r", "̃": "x", "̣": "j"}
_TELEX_MARKS = {"̆": "w", "̛": "w"}
# Rows of the keyboard.
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
# Words in front of a typed name that do not belong to it.
_LEAD = regex.compile(r"^(?:map(?:\s+to)?|chắc\s+là|xem|cột|bảng|column|table|maybe|tên\s+cột|tên\s+bảng|=+>?|-+>|→|#)\s+", regex.I)
_NOTE = regex.compile(r"\([^()]*\)|^\s*\[|\]\s*$|[?!…]+\s*$")
_NUMBER = regex.compile(r"^\s*\d{1,3}\s*[.)\-_:]?\s*(?=\p{L})")
_COUNTER = regex.compile(r"(?:[_\s]\d{1,2}|(?<=\p{Ll})\d)$")
_PART = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?[\p{Ll}\p{M}]+|\p{Lu}+|\d+")


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.lower()).replace("đ", "d")
    return "".join(c for c in plain if not unicodedata.combining(c))


def parts(name: str) -> list[str]:
    """Words of a name, also inside CamelCase."""
    return [w for w in _PART.findall(unicodedata.normalize("NFC", name))]


def squeezed(name: str) -> str:
    return regex.sub(r"[^a-z0-9]+", "", fold(name))


def telex(word: str, at_end: bool) -> str:
    """Keystrokes of a word; the tone's key follows its vowel or stands at the word's end."""
    out, tone = [], ""
    for c in unicodedata.normalize("NFC", word.lower()):
        full = unicodedata.normalize("NFD", c)
        key = "dd" if c == "đ" else full[0]
        for m in full[1:]:
            if m in _TELEX_TONES:
                tone = _TELEX_TONES[m]
            else:
                key += _TELEX_MARKS.get(m, full[0])
        if tone and not at_end:
            key, tone = key + tone, ""
        out.append(key)
    return "".join(out) + tone


def skeleton(word: str) -> str:
    return word[0] + regex.sub("[aeiou]", "", word[1:])


def forms(names: list[str], labels: list[str], foreign: list[str]) -> dict[str, tuple[float, int]]:
    """Spelling to (penalty, edits allowed at most) of an entry. names: CamelCase; labels: with accents; foreign: plain words."""
    out: dict[str, tuple[float, int]] = {}

    def add(key: str, penalty: float, edits: int) -> None:
        if len(key) >= 2 and (key not in out or out[key] > (penalty, -edits)):
            out[key] = (penalty, edits)

    readings = [[fold(w) for w in parts(n)] for n in names]
    readings += [[squeezed(w) for w in label.split()] for label in [*labels, *foreign]]
    for label in labels:
        for at_end in (False, True):
            words = [telex(w, at_end) for w in label.split()]
            readings.append(words)
    for words in readings:
        words = [w for w in words if w]
        whole = "".join(words)
        add(whole, 0.0, 2)
        n = len(words)
        if n < 2:
            continue
        orders = itertools.permutations(words) if n == 2 else [words[k:] + words[:k] for k in range(1, n)] + [words[:-2] + words[:-3:-1], words[1::-1] + words[2:]]
        for order in orders:
            add("".join(order), 0.3, 1)
        for k in range(1, len(words[-1])):
            add("".join(words[:-1]) + words[-1][:k], 0.4 + 0.1 * (len(words[-1]) - k > 2), 0)
        for k in range(1, n):
            if n - k >= 2:
                add("".join(words[:k]) + "".join(w[0] for w in words[k:]), 0.5, 0)
        if n >= 3:
            add("".join(w[0] for w in words), 0.7, 0)
            add("".join(words[:-1]), 0.9, 0)
    for label in foreign:
        words = [w for w in map(squeezed, label.split()) if w]
        ways = [(w, skeleton(w)) if len(w) > 3 else (w,) for w in words]
        if len(words) <= MIXED_WORDS:
            picks = [list(p) for p in itertools.product(*ways)]
        else:  # all words, the skeletons of the first or last k, or of one
            short = [w[-1] for w in ways]
            picks = [p for k in range(len(words) + 1) for p in (short[:k] + words[k:], words[:k] + short[k:])]
            picks += [words[:k] + [short[k]] + words[k + 1 :] for k in range(len(words))]
        for pick in picks:
            add("".join(pick), 0.4, 1 if pick != words else 2)
    return out


def allowed(length: int) -> float:
    """The weighted distance a length allows; it ascends with the length."""
    return next(cost for most, cost in ALLOWED if length <= most)


def deletions(key: str, n: int) -> set[str]:
    """The key and everything left when up to n letters are deleted."""
    out = level = {key}
    for _ in range(n):
        level = {k[:i] + k[i + 1 :] for k in level for i in range(len(k))}
        out = out | level
    return out


def lookup_keys(key: str, cost: float) -> set[str]:
    """What is left of a key by the deletions that edits up to a cost of 2 can ask of it.

    At most cost / SLIP of the edits are others than doubled letters. Edits of that number and one doubled letter
    more, as many as the cost allows, take the doubled letters from either side: the keys of both sides always meet.
    """
    whole = int(cost / SLIP + 1e-9)
    doubled = {key[:i] + key[i + 1 :] for i in range(1, len(key)) if key[i] == key[i - 1]}
    return set().union(*(deletions(k, whole) for k in {key} | doubled))


_NEAR_KEYS = {frozenset(p) for row in _KEYS for p in zip(row, row[1:])} | {
    frozenset((a, b)) for up, low in zip(_KEYS, _KEYS[1:]) for i, b in enumerate(low) for a in up[i : i + 2]
}


def weighted_distance(a: str, b: str, limit: float) -> float:
    """Damerau-Levenshtein with weights: SLIP for a swap or a neighbouring key, DOUBLED for a doubled letter, else 1. Above the limit: infinite."""
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gap = lambda s, i: DOUBLED if i > 0 and s[i] == s[i - 1] else 1.0
    for i in range(1, len(a) + 1):
        rows[i][0] = rows[i - 1][0] + gap(a, i - 1)
    for j in range(1, len(b) + 1):
        rows[0][j] = rows[0][j - 1] + gap(b, j - 1)
    for i in range(1, len(a) + 1):
        row, above, x = rows[i], rows[i - 1], a[i - 1]
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            best = above[j - 1] + (0.0 if x == y else SLIP if frozenset((x, y)) in _NEAR_KEYS else 1.0)
            best = min(best, above[j] + gap(a, i - 1), row[j - 1] + gap(b, j - 1))
            if i > 1 and j > 1 and x != y and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[i - 2][j - 2] + SLIP)
            row[j] = best
        if min(row) > limit:
            return float("inf")
    return rows[-1][-1]


class Dictionary:
    """Symmetric-delete index over the forms of the entries of one kind."""

    def __init__(self, entries: list[tuple]):
        """entries: (entry_id, canonical_name, label_vi, label_en, known_aliases)"""
        self.forms: dict[str, list[tuple[int, float, int]]] = defaultdict(list)
        for entry_id, name, vi, en, aliases in entries:
            listed = [a.strip() for a in (aliases or "").split(";") if a.strip()]
            accented = [vi] if vi else []
            plain = [x for x in ([en] if en else []) + listed]
            for form, (penalty, edits) in forms([name] if name else [], accented, plain).items():
                self.forms[form].append((entry_id, penalty, edits))
        self.index: dict[str, set[str]] = defaultdict(set)
        self.long = [f for f in self.forms if len(f) > LONG_FORM]
        for form, own in self.forms.items():
            if len(form) <= LONG_FORM:
                for key in lookup_keys(form, min(allowed(len(form)), max(e for *_, e in own))):
                    self.index[key].add(form)

    def near(self, key: str) -> dict[int, float]:
        """Entries within the bounded distance of a key, with their cost."""
        found: dict[int, float] = {}
        if not key:
            return found
        most, slack = allowed(len(key) + 1), int(ALLOWED[-1][1] / DOUBLED)
        seen = set(self.forms.keys() & {key})
        if len(key) <= LONG_FORM + slack:
            for reduced in lookup_keys(key, most):
                seen |= self.index.get(reduced, set())
        seen.update(f for f in self.long if abs(len(f) - len(key)) <= slack)
        for form in seen:
            limit = min(most, allowed(len(form))) + 1e-9
            distance = weighted_distance(key, form, limit)
            for entry, penalty, edits in self.forms[form]:
                if distance <= min(limit, edits):
                    found[entry] = min(found.get(entry, 9.0), distance + penalty)
        return found


def readings(value: str) -> list[tuple[str, float]]:
    """Keys a typed value may stand for, with a penalty: without lead words, notes and counters."""
    bare = unicodedata.normalize("NFC", value).strip()
    while True:
        shorter = _LEAD.sub("", _NOTE.sub("", _NUMBER.sub("", bare))).strip()
        if shorter == bare:
            break
        bare = shorter
    out = {squeezed(bare): 0.0}
    cut = _COUNTER.sub("", bare)
    out.setdefault(squeezed(cut), 0.05)
    pieces = regex.split(r"_|\.|\s-\s", cut)
    if len(pieces) == 2:
        out.setdefault(squeezed(pieces[0]), 0.6)
        out.setdefault(squeezed(pieces[1]), 0.7)
    return [(k, p) for k, p in out.items() if k]


def pieces(keys: list[tuple[str, float]]) -> list[str]:
    """The two parts of a value written as one name beside another; each counts only if the other one names something."""
    return [k for k, p in keys if p >= 0.6]


class Matcher:
    """Dictionary of one kind, with the names that may be written beside one of its entries."""

    def __init__(self, entries: list[tuple], beside: list[tuple] = ()):
        self.dictionary = Dictionary(entries)
        self.beside = Dictionary(list(beside)) if beside else self.dictionary

    def names(self, value: str) -> list[str]:
        """The parts of a value that name an entry of the other kind."""
        return [k for k in pieces(readings(value)) if min(self.beside.near(k).values(), default=9.0) <= 0.5]

    def candidates(self, value: str, named: list[str] | None = None) -> dict[int, float]:
        """Entries a typed value may name, with their cost; a part of a value counts if the rest names an entry of the other kind."""
        keys = readings(value)
        named = self.names(value) if named is None else named
        out: dict[int, float] = {}
        for key, penalty in keys:
            if penalty >= 0.6 and not any(k in named for k in pieces(keys)[:2] if k != key):
                continue
            for entry, cost in self.dictionary.near(key).items():
                out[entry] = min(out.get(entry, 9.0), cost + penalty)
        return {e: c for e, c in out.items() if c <= NEAR}


_COLUMNS = ["entry_id", "canonical_name", "label_vi", "label_en", "known_aliases"]


def blocks_of(entries: DataFrame) -> Iterator[list[tuple]]:
    """Entries in blocks of about BLOCK_ENTRIES; the driver holds what one dictionary may hold at a time."""
    n = max(1, -(-entries.count() // BLOCK_ENTRIES))
    take = lambda b: [tuple(r) for r in entries.where(F.pmod(F.xxhash64("entry_id"), F.lit(n)) == b).select(*_COLUMNS).distinct().orderBy("entry_id").collect()]
    return (take(b) for b in range(n))


def nominate(values: DataFrame, entries: DataFrame, kind: str, beside: str) -> DataFrame:
    """(value, entry_id, cost) of all entries of `kind` near each value of the column ``value``.

    One pass over the distinct values per block of names that may stand beside, and one per block of entries.
    """
    spark = values.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a lookup costs far more than moving its value, so the values are not joined into few tasks
    values = keep(values.select("value").distinct().repartition(tasks, "value"), "typed")
    named = []
    for block in blocks_of(entries.where(F.col("kind") == beside)):
        matcher = spark.sparkContext.broadcast(Matcher(block))

        def look_beside(frames: Iterator[pd.DataFrame], matcher=matcher) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(v, k) for v in frame["value"] for k in matcher.value.names(v)]
                yield pd.DataFrame(rows, columns=["value", "named"])

        two = values.where(F.col("value").rlike(r"[_.]|(?U)\s-\s"))
        named.append(two.mapInPandas(look_beside, "value string, named string"))
    parts = reduce(DataFrame.unionByName, named).groupBy("value").agg(F.collect_set("named").alias("named"))
    values = keep(values.join(parts, "value", "left"), "beside").repartition(tasks)
    found = []
    for block in blocks_of(entries.where(F.col("kind") == kind)):
        matcher = spark.sparkContext.broadcast(Matcher(block))

        def look_up(frames: Iterator[pd.DataFrame], matcher=matcher) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(v, e, c) for v, own in zip(frame["value"], frame["named"]) for e, c in matcher.value.candidates(v, [] if own is None else list(own)).items()]
                yield pd.DataFrame(rows, columns=["value", "entry_id", "cost"])

        found.append(values.mapInPandas(look_up, "value string, entry_id bigint, cost double"))
    return reduce(DataFrame.unionByName, found)


def map_values(typed: DataFrame, entries: DataFrame, used: DataFrame, kind: str, beside: str) -> DataFrame:
    """`typed` (field_name, map_id, context, value) with entry_id and cost; null where no entry is named.

    used: (context, name, n), how often a context uses an entry's canonical name; it decides between equal costs.
    """
    distinct = typed.groupBy("context", "value").agg(F.count(F.lit(1)).alias("n"))
    near = nominate(distinct, entries, kind, beside)
    named = entries.where(F.col("kind") == kind).select("entry_id", F.lower("canonical_name").alias("name"))
    by_context = used.groupBy("context", F.lower("name").alias("name")).agg(F.sum("n").alias("here"))
    overall = by_context.groupBy("name").agg(F.sum("here").alias("anywhere"))
    ranked = (
        distinct.select("context", "value")
        .join(near.groupBy("value", "entry_id").agg(F.min("cost").alias("cost")), "value")
        .join(named, "entry_id")
        .join(by_context, ["context", "name"], "left")
        .join(overall, "name", "left")
    )
    # an entry the context itself uses is preferred up to half an edit
    cost = F.col("cost") - F.when(F.col("here") > 0, 0.5).otherwise(0.0)
    rank = F.struct(cost, -F.coalesce("here", F.lit(0)), -F.coalesce("anywhere", F.lit(0)), F.col("entry_id"))
    best = ranked.groupBy(F.col("context").alias("in_context"), F.col("value").alias("named")).agg(F.min_by(F.struct("entry_id", "cost"), rank).alias("best"))
    keys = F.col("context").eqNullSafe(F.col("in_context")) & (F.col("value") == F.col("named"))
    return typed.join(best, keys, "left").select("field_name", "map_id", "value", F.col("best.entry_id").alias("entry_id"), F.col("best.cost").alias("cost"))


def _filled(c: str):
    return F.col(c).isNotNull() & (F.trim(c) != "")


def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value of the three fields with its entry, or null."""
    columns = table(spark, sf_dir, "column_mapping_report", "map_id", "assignment_code", "raw_student_column", "answer_column", "suggested_alias_entry")
    tables = table(spark, sf_dir, "table_mapping_report", "map_id", "assignment_code", "raw_student_table", "answer_table")
    entries = table(spark, sf_dir, "canonical_names")
    take = lambda df, c: df.where(_filled(c)).select(F.lit(c).alias("field_name"), "map_id", F.col("assignment_code").alias("context"), F.col(c).alias("value"))
    use = lambda df, c: df.where(_filled(c)).groupBy(F.col("assignment_code").alias("context"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    typed = take(columns.where(~F.coalesce(_filled("answer_column"), F.lit(False))), "raw_student_column").unionByName(take(columns, "suggested_alias_entry"))
    named = take(tables.where(~F.coalesce(_filled("answer_table"), F.lit(False))), "raw_student_table")
    return map_values(typed, entries, use(columns, "answer_column"), "column", "table").unionByName(
        map_values(named, entries, use(tables, "answer_table"), "table", "table")
    )


def named_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: field_name, map_id, entry_id."""
    return typed_fields(spark, sf_dir).where("entry_id IS NOT NULL").select("field_name", "map_id", "entry_id")


def unmatched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that name no entry, with their number of rows."""
    return typed_fields(spark, sf_dir).where("entry_id IS NULL").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("rows"))
