"""Matching records of two sources without a common key, with a confidence for each match.

A graph joins records, attributes and tokens (words, letter trigrams and consonant skeletons of names, types,
tables). Records that show both sides at once, and the reference list's entries, tie the two sources' tokens
together. Random walks over the graph of all records, those of one side among them, train skip-gram vectors; a
record's vector is the weighted mean of its tokens' vectors. In each pass the records are dealt into blocks, which are
walked and trained side by side from the same vectors; a token's step is the mean of its steps in the blocks by its
visits there, and the next pass deals anew.

Blocking: records of a group with equal attributes are one variant. A group of up to LEAF variants a side is one
block. A larger one is cut by random hyperplanes in several hash tables; a student's side visits its own bucket
and those across one hyperplane, and the number of tables grows with the bits so that pairs of cosine REACHED meet
with a chance of RECALL at any size. Names that mean one entry of the reference list, or differ by an edit, meet by
keys of their own, whatever their vectors. Candidate pairs of variants are judged once, wherever they occur
(cosine, name, table, type), and only position and counts are added per pair of records. A logistic model fitted on
pairs known from two-sided records turns the comparison into a confidence, and objects (a name in a table) that are
each other's best above the threshold are matches with all their records above it.

Nothing is sampled or capped: the walks start from every distinct record, all records count for the tokens' weights, all
two-sided records and all their pairs within a group are what the calibration is fitted on, and all one-sided records
are indexed and compared. Random are the steps of the walks and the negatives of the skip-grams. A record's walks stay
among the records of its block, about BLOCK_RECORDS of them; the pairs of a group of more than KNOWN_BLOCK two-sided
records are those within blocks of about that many, in which every record has its place. Defined
results: null and empty both mean that a side is missing; rows with both sides or none are no candidates; copies
of a row count one by one; a group with one side only gives nothing; ties of confidence are all kept; missing
tables, types and counts are neutral.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm import canon
from matchloom.session import keep, table

#: Records of a block of the walked graph, and two-sided records of a block of a group, on average; what a record's other answers weigh at most, in records.
BLOCK_RECORDS, KNOWN_BLOCK, OTHERS = 4096, 64, 6
#: Groups for which the penalty of the calibration is given; it grows with them, so that more of the same data gives the same weights.
PENALTY_GROUPS = 300
#: Nodes whose steps are added up together, and the unit of the weights of pairs, which are counted in whole numbers.
SLICE, UNIT = 1024, 1 << 20
#: Hashed tokens, vector length, walks per record, steps per walk, window, passes, negatives per batch and their weight.
TOKENS, DIM, WALKS, STEPS, WINDOW, EPOCHS, NEGATIVES, NEGATIVE_WEIGHT = 1 << 15, 48, 4, 8, 3, 2, 64, 5.0
#: Least confidence of a match, the cosine a pair needs whose names have nothing in common, and the cost from which they have nothing in common.
CONFIDENT, ALIKE, FOREIGN = 0.3, 0.7, 3.5
#: Variants of a side up to which a group is one block, and of a bucket on average in larger groups; bits of a hash table at most.
LEAF, BITS = 64, 20
#: The cosine of the pairs that the hash tables are to bring together, and their chance to meet.
REACHED, RECALL = ALIKE, 0.93
#: Cost up to which names written alike meet by keys of their own: an edit, and a doubled letter more.
KEYED = 1.45

REPORTS = ("table_mapping_report", "column_mapping_report")
ATTRIBUTES = ("name", "type", "table")
RECORD = "report string, map_id bigint, submission_id string, side string, context string, name string, answer_table string, student_table string, kind string, n1 int, n2 int, partner string"


def _id(text: str) -> int:
    return zlib.crc32(text.encode()) % TOKENS


def bits_of(n: int) -> int:
    """Bits of the hash tables of a group with n variants on its larger side."""
    return 0 if n <= LEAF else min(BITS, math.ceil(math.log2(n / LEAF)))


def tables_of(bits: int) -> int:
    """Hash tables in which pairs of cosine REACHED meet with a chance of RECALL, when one bit may differ."""
    same = 1 - math.acos(REACHED) / math.pi
    meet = same**bits + bits * (1 - same) * same ** max(0, bits - 1)
    return 1 if meet > RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def name_tokens(name: str | None) -> list[str]:
    """Words, trigrams and skeletons of a typed or given name."""
    out: list[str] = []
    for key, penalty in canon.readings(name or ""):
        if penalty == 0.0:
            words = [w for w in map(canon.squeezed, canon.parts(name)) if w and not w.isdigit()]
            out += [f"w:{w}" for w in words] + [f"k:{canon.skeleton(w)}" for w in words]
            edged = f"^{key}$"
            out += [f"g:{edged[i : i + 3]}" for i in range(max(1, len(edged) - 2))]
    return out


def side_tokens(name: str | None, kind: str | None, table_name: str | None) -> list[tuple[str, int]]:
    """Tokens of one side of a record with their attribute."""
    out = [(t, 0) for t in name_tokens(name)]
    if kind:
        out.append((f"y:{kind.split('(')[0].strip().lower()}", 1))
    if table_name:
        out.append((f"t:{canon.squeezed(table_name)}", 2))
    return out


def hashed(tokens: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """The tokens' ids with their attribute."""
    return [(_id(t), a) for t, a in tokens]


class Graph:
    """Bipartite graph of records and hashed tokens; attributes are linked to their tokens."""

    def __init__(self, records: list[list[tuple[int, int]]]):
        pairs = sorted({(r, t) for r, tokens in enumerate(records) for t, _ in tokens})
        own = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.records = len(records)
        self.attribute = np.zeros(TOKENS, dtype=np.int64)
        for tokens in records:
            for t, a in tokens:
                self.attribute[t] = a
        self.of_record, self.record_start = self._lists(own[:, 0], own[:, 1], len(records))
        self.of_token, self.token_start = self._lists(own[:, 1], own[:, 0], TOKENS)
        present = np.flatnonzero(np.diff(self.token_start))
        self.of_attribute, self.attribute_start = self._lists(self.attribute[present], present, len(ATTRIBUTES))

    @staticmethod
    def _lists(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(left, kind="stable")
        return right[order], np.r_[0, np.cumsum(np.bincount(left, minlength=n))]

    def _step(self, rng, lists: np.ndarray, start: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        size = start[nodes + 1] - start[nodes]
        return lists[start[nodes] + (rng.random(len(nodes)) * size).astype(np.int64)]

    def walks(self, rng: np.random.Generator) -> np.ndarray:
        """Node ids of all walks: tokens first, then attributes, then records."""
        begin = np.repeat(np.flatnonzero(np.diff(self.record_start)), WALKS)
        tokens = self._step(rng, self.of_record, self.record_start, begin)
        path = [TOKENS + len(ATTRIBUTES) + begin, tokens]
        for _ in range(STEPS):
            records = self._step(rng, self.of_token, self.token_start, tokens)
            middle = TOKENS + len(ATTRIBUTES) + records
            onward = self._step(rng, self.of_record, self.record_start, records)
            by_attribute = np.flatnonzero(rng.random(len(tokens)) < 0.05)
            attributes = self.attribute[tokens[by_attribute]]
            middle[by_attribute] = TOKENS + attributes
            onward[by_attribute] = self._step(rng, self.of_attribute, self.attribute_start, attributes)
            tokens = onward
            path += [middle, tokens]
        return np.stack([p.astype(np.int32) for p in path], axis=1)


def _add_rows(matrix: np.ndarray, rows: np.ndarray, step: np.ndarray) -> None:
    """matrix[rows] += step, where rows repeat; a row's sum is damped by the root of its repeats."""
    order = np.argsort(rows, kind="stable")
    rows, step = rows[order], step[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    n = np.diff(np.r_[starts, len(rows)])
    matrix[rows[starts]] += np.add.reduceat(step, starts, axis=0) / np.sqrt(n)[:, None]


def skip_gram(walks: np.ndarray, nodes: int, seed: int = 5, rate: float = 0.15, batch: int = 8192, passes: int = EPOCHS, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all nodes, as centre and as context, trained with negatives shared by a batch; start: those of the first nodes so far."""
    rng = np.random.default_rng(seed)
    into = ((rng.random((nodes, DIM)) - 0.5) / DIM).astype(np.float32)
    out = np.zeros((nodes, DIM), dtype=np.float32)
    if start is not None:
        into[: len(start[0])], out[: len(start[1])] = start
    if not walks.size:
        return into, out
    walks = walks.astype(np.int32)
    chance = np.bincount(walks.ravel(), minlength=nodes) ** 0.75
    steps = np.cumsum(chance / chance.sum())
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -15, 15)))
    turns = [(k, swap) for _ in range(passes) for k in range(1, WINDOW + 1) for swap in (False, True)]
    for k, swap in turns:
        left, right = walks[:, :-k].ravel(), walks[:, k:].ravel()
        centre, context = (right, left) if swap else (left, right)
        order = rng.permutation(len(centre))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            c, o = centre[rows], context[rows]
            negative = np.searchsorted(steps, rng.random(NEGATIVES)).clip(0, nodes - 1)
            vc, vo, vn = into[c], out[o], out[negative]
            pull = (sigmoid((vc * vo).sum(axis=1)) - 1)[:, None]
            push = sigmoid(vc @ vn.T) * (NEGATIVE_WEIGHT / NEGATIVES)
            _add_rows(into, c, -rate * (pull * vo + push @ vn))
            _add_rows(out, o, -rate * pull * vc)
            _add_rows(out, negative, -rate * (push.T @ vc) / np.sqrt(len(rows)))
    return into, out


class Space:
    """Token vectors with their weights, and the hyperplanes: records become unit vectors, and these cells of hash tables."""

    def __init__(self, records: list[list[tuple[str, int]]]):
        graph = Graph([hashed(tokens) for tokens in records])
        rng = np.random.default_rng(11)
        into, _ = skip_gram(graph.walks(rng), TOKENS + len(ATTRIBUTES) + graph.records)
        self._take(into[:TOKENS], np.diff(graph.token_start), rng)

    @classmethod
    def trained(cls, vectors: np.ndarray, seen: np.ndarray) -> Space:
        """Of vectors trained elsewhere and the number of records with each token."""
        space = cls.__new__(cls)
        space._take(vectors, seen, np.random.default_rng(11))
        return space

    def _take(self, vectors: np.ndarray, seen: np.ndarray, rng: np.random.Generator) -> None:
        # a token never walked through gets a fixed random direction, so equal unseen tokens still agree
        unseen = rng.normal(size=vectors.shape).astype(np.float32)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        centre = vectors[seen > 0].mean(axis=0) if (seen > 0).any() else 0.0
        trained = vectors - centre
        size = np.maximum(np.linalg.norm(trained, axis=1, keepdims=True), 1e-9)
        self.vectors = np.where((seen > 0)[:, None] & (norm > 1e-6), trained / size, unseen / np.linalg.norm(unseen, axis=1, keepdims=True))
        self.weights = (1.0 / np.sqrt(1.0 + seen)).astype(np.float32)
        self.planes = rng.normal(size=(tables_of(BITS), BITS, DIM)).astype(np.float32)

    def vector(self, tokens: list[tuple[str, int]]) -> np.ndarray:
        if not tokens:
            return np.zeros(DIM, dtype=np.float32)
        ids = [_id(t) for t, _ in tokens]
        weight = self.weights[ids] * np.array([1.0 if a == 0 else 0.2 for _, a in tokens], dtype=np.float32)
        v = weight @ self.vectors[ids]
        return (v / max(float(np.linalg.norm(v)), 1e-9)).astype(np.float32)

    def cells(self, vectors: np.ndarray, bits: int, neighbours: bool) -> np.ndarray:
        """Cells (table and bucket in one number) of each vector, a row each; with those across one hyperplane if asked."""
        tables = tables_of(bits)
        planes = self.planes[:tables, :bits].reshape(tables * bits, DIM)
        own = (vectors @ planes.T > 0).reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
        flips = np.r_[0, 1 << np.arange(bits, dtype=np.int64)] if neighbours else np.zeros(1, dtype=np.int64)
        buckets = own.astype(np.int64)[:, :, None] ^ flips
        return ((np.arange(tables, dtype=np.int64) << BITS)[None, :, None] | buckets).reshape(len(vectors), -1)


def _filled(c: str):
    return F.coalesce(F.trim(c) != "", F.lit(False))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sides of both reports in the layout RECORD; a two-sided row gives two records of side 'both-s' and 'both-a'."""
    parts = []
    for report, student, answer, kinds, n1, n2 in (
        ("table_mapping_report", "raw_student_table", "raw_answer_table", (None, None), "column_count", "row_count"),
        ("column_mapping_report", "raw_student_column", "answer_column", ("student_type_raw", "answer_type_raw"), "ordinal_position", "is_nullable"),
    ):
        is_table = report.startswith("table")
        rows = table(spark, sf_dir, report)
        s, a = _filled(student), _filled(answer)
        blank = lambda c: F.when(_filled(c), F.col(c))
        for own, other, column, kind, mark in ((s, a, student, kinds[0], "s"), (a, s, answer, kinds[1], "a")):
            partner = answer if mark == "s" else student
            parts.append(
                rows.where(own).select(
                    F.lit(report).alias("report"),
                    "map_id",
                    "submission_id",
                    F.when(other, f"both-{mark}").otherwise(mark).alias("side"),
                    F.col("assignment_code").alias("context"),
                    F.col(column).alias("name"),
                    (F.lit(None).cast("string") if is_table else blank("answer_table")).alias("answer_table"),
                    (F.lit(None).cast("string") if is_table else blank("student_table")).alias("student_table"),
                    (F.lit(None).cast("string") if kind is None else blank(kind)).alias("kind"),
                    F.col(n1).cast("int").alias("n1"),
                    F.col(n2).cast("int").alias("n2"),
                    F.col(partner).alias("partner"),
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def known_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, student_table, known_table): what rows of either report say; the most frequent wins."""
    t = table(spark, sf_dir, "table_mapping_report").select("submission_id", F.col("raw_student_table").alias("student_table"), F.col("raw_answer_table").alias("known_table"))
    c = table(spark, sf_dir, "column_mapping_report").select("submission_id", "student_table", F.col("answer_table").alias("known_table"))
    both = t.unionByName(c).where(_filled("student_table") & _filled("known_table"))
    n = both.groupBy("submission_id", "student_table", "known_table").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("submission_id", "student_table").agg(F.max_by("known_table", F.struct("n", "known_table")).alias("known_table"))


class Names:
    """How far a typed name is from a given one, by the reference list's forms or letter by letter."""

    def __init__(self, entries: list[tuple]):
        """entries: (kind, entry_id, canonical_name, label_vi, label_en, known_aliases)"""
        of = lambda kind: [e[1:] for e in entries if e[0] == kind]
        self.matchers = {k: canon.Matcher(of(k), of("table")) for k in ("table", "column")}
        self.ids = {(e[0], canon.squeezed(e[2] or "")): e[1] for e in entries}
        self.cache: dict[tuple[str, str], dict[int, float]] = {}

    def costs(self, kind: str, typed: str) -> dict[int, float]:
        key = (kind, typed)
        if key not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[key] = self.matchers[kind].candidates(typed)
        return self.cache[key]

    def compare(self, kind: str, typed: str, given: str) -> tuple[float, float]:
        """Cost of the pair, at most 4, and how much better the typed name fits another entry."""
        costs = self.costs(kind, typed)
        entry = self.ids.get((kind, canon.squeezed(given)))
        if entry is not None and entry in costs:
            return costs[entry], costs[entry] - min(costs.values())
        left, right = canon.squeezed(typed), canon.squeezed(given)
        distance = canon.weighted_distance(left, right, 3.5) if left and right else 4.0
        scaled = min(4.0, 0.5 + distance * 12 / max(6, min(len(left), len(right)))) if distance < 3.5 else 4.0
        return scaled, min(2.0, max(0.0, scaled - min(costs.values()))) if costs else 0.0

    def keys(self, kind: str, side: str, name: str) -> list[int]:
        """Keys at which names meet: the entries they may mean, and what an edit leaves of them."""
        plain = canon.squeezed(name)
        entries = self.costs(kind, name) if side == "s" else {self.ids.get((kind, plain))} - {None}
        left = [""] if not plain else canon.lookup_keys(plain, KEYED) if len(plain) <= canon.LONG_FORM else [plain]
        texts = [f"e{e}" for e in entries] + [f"d{t}" for t in left if t]
        return [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True) for t in texts]

    def table_of(self, student_table: str | None) -> str | None:
        """Squeezed canonical name of the table a typed name means, if it names one clearly."""
        costs = self.costs("table", student_table) if student_table else {}
        best = [e for e, c in costs.items() if c <= min(costs.values()) + 0.2]
        if len(best) != 1:
            return None
        return next(n for (k, n), e in self.ids.items() if k == "table" and e == best[0])


def features(kind: str, names: Names, s: dict, a: dict, cosine: float) -> list[float]:
    """Comparison of a student side with an answer side; neutral where something is missing."""
    cost, other = names.compare(kind, s["name"], a["name"])
    same = lambda x, y: 0.0 if x is None or y is None or x != x or y != y else (1.0 if x == y else -1.0)
    near = 0.0 if s["n1"] is None or a["n1"] is None or s["n1"] != s["n1"] or a["n1"] != a["n1"] else 1.0 - min(3.0, abs(s["n1"] - a["n1"]))
    base = lambda t: t.split("(")[0].strip().lower() if isinstance(t, str) else None
    left, right = s["own_table"], a["own_table"]
    tables = 0.0 if not left or not right else (1.0 if canon.squeezed(left) == canon.squeezed(right) else -1.0)
    if kind == "table":  # row counts; for columns n2 is a flag
        known = s["n2"] is not None and a["n2"] is not None and s["n2"] == s["n2"] and a["n2"] == a["n2"]
        second = 1.0 - min(2.0, abs(s["n2"] - a["n2"]) / max(2.0, 0.1 * max(s["n2"], a["n2"]))) if known else 0.0
    else:
        second = same(s["n2"], a["n2"])
    return [1.0, cosine, cost, min(cost, 1.0), float(cost >= FOREIGN), other, near, second, same(base(s["kind"]), base(a["kind"])), tables]


def slopes(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the loss of a logistic model at w; row k counts n[k] times."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (n * (p - y)), (x * (n * p * (1 - p))[:, None]).T @ x


def newton_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return np.linalg.solve(h + l2 * np.eye(len(w)), g + l2 * w)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton's method; few features."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        step = newton_step(w, *slopes(x, y, np.ones(len(y)), w), l2)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def newton_by(pairs: DataFrame, l2: float = 1e-2, rounds: int = 60) -> dict[str, np.ndarray]:
    """`fit_logistic` per report of pairs in the layout KNOWN, of any number: each step adds up their slopes where they are."""
    weights = {r: np.zeros(10) for r in REPORTS}

    def slope(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {r: np.zeros(112) for r in at}
        for frame in frames:
            for report, f in frame.groupby("report"):
                if report in at:
                    cost, one = f["cost"].to_numpy(), np.ones(len(f))
                    x = np.column_stack([one, f["cosine"], cost, np.minimum(cost, 1.0), cost >= FOREIGN, f["other"], f["near"], f["second"], f["kinds"], f["tables"]])
                    y, n = f["y"].to_numpy(), f["n"].to_numpy()
                    g, h = slopes(x, y, n, at[report])
                    sums[report] += np.r_[n @ y, n @ (1 - y), g, h.ravel()]
        yield pd.DataFrame({"report": list(sums), "sums": [v.tolist() for v in sums.values()]})

    done: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        at = {r: w for r, w in weights.items() if r not in done}
        parts = sorted(map(tuple, pairs.mapInPandas(slope, "report string, sums array<double>").collect()))
        for report, w in at.items():
            total = np.sum([np.zeros(112), *(p for r, p in parts if r == report)], axis=0)
            if not (total[0] > 0 and total[1] > 0):
                del weights[report]
                continue
            step = newton_step(w, total[2:12], total[12:].reshape(10, 10), l2)
            weights[report] = w - step
            if np.abs(step).max() < 1e-6:
                done[report] = weights[report]
        if len(done) == len(weights):
            break
    # sums in another order differ in their last digits
    return {r: np.round(w, 9) for r, w in weights.items()}


class Model:
    """Everything the executors need: space, names, calibration per report."""

    def __init__(self, space: Space, names: Names):
        self.space, self.names = space, names
        self.weights: dict[str, np.ndarray] = {}

    @staticmethod
    def kind(report: str) -> str:
        return "table" if report.startswith("table") else "column"

    def tokens(self, r: dict) -> list[tuple[str, int]]:
        return side_tokens(r["name"], r["kind"], r["own_table"])

    def calibrate(self, pairs: DataFrame, groups: int) -> None:
        """Weights per report from `known_pairs` of so many groups."""
        fitted = newton_by(pairs, 1e-2 * max(1.0, groups / PENALTY_GROUPS))
        for report in REPORTS:  # nothing known: judged by name and table alone
            self.weights[report] = fitted.get(report, np.array([2.0, 2.0, -2.0, 0.0, -2.0, -2.0, 0.2, 0.2, 0.2, 1.5]))

    def confidence(self, report: str, x: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[report], x), -30, 30))))

    def log_odds(self, report: str, s: dict, a: dict, cosine: float) -> float | None:
        """Log odds of two variants, to which position and counts are yet to be added; None if no pair of their records can match.

        That is: their tables are known to differ, or their names share nothing while the vectors do not agree either,
        or what is yet to be added cannot lift them to CONFIDENT.
        """
        x = features(self.kind(report), self.names, {**s, "n1": None, "n2": None}, {**a, "n1": None, "n2": None}, cosine)
        if x[-1] < 0 or (x[4] > 0 and cosine < ALIKE):
            return None
        w = self.weights[report]
        odds = float(np.dot(w, x))
        most = odds + max(w[6], -2 * w[6]) + abs(w[7])
        return odds if most >= math.log(CONFIDENT / (1 - CONFIDENT)) - 1e-9 else None


def reliability(pairs: list[tuple[float, float]], bins: int = 10) -> list[tuple[float, float, int]]:
    """(mean confidence, share of true pairs, pairs) per bin of (confidence, truth): equal where the confidence is calibrated."""
    out = []
    for k in range(bins):
        own = [(p, y) for p, y in pairs if min(int(p * bins), bins - 1) == k]
        if own:
            out.append((sum(p for p, _ in own) / len(own), sum(y for _, y in own) / len(own), len(own)))
    return out


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _key(*columns: str) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


KNOWN = "report string, cosine double, cost double, other double, near double, second double, kinds double, tables double, y double, n double"


def known_pairs(both: DataFrame, tables: DataFrame, model: Model) -> DataFrame:
    """KNOWN: features and truth of all pairs of two-sided records of a group, and how often (n) they occur.

    Both sides of a row are a pair; sides of different rows with another answer are none, and those of one student's
    side weigh as much as OTHERS rows together, or as there are. both: `records` of two sides. A group of more than
    KNOWN_BLOCK rows is dealt into blocks of about that many by the hash of their ids.
    """
    spark = both.sparkSession
    rows = with_table(both, tables).withColumns({"group": _key("report", "submission_id"), "variant": _key("report", "side", "name", "kind", "own_table")})
    rows = keep(rows.select("group", "report", "side", "map_id", "variant", "name", "kind", "own_table", "partner", "n1", "n2"), "known")
    blocks = rows.where("side = 'both-a'").groupBy("group").agg(F.ceil(F.count(F.lit(1)) / KNOWN_BLOCK).alias("blocks"))
    dealt = rows.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("map_id"), "blocks"))
    size = dealt.where("side = 'both-a'").groupBy("group", "block").agg(F.count(F.lit(1)).alias("size"))
    of = lambda m, *more: dealt.where(F.col("side") == f"both-{m}").select("group", "block", *more, *[F.col(c).alias(f"{m}_{c}") for c in ("map_id", "variant", "name", "own_table", "partner", "n1", "n2")])
    own = F.col("s_map_id").eqNullSafe(F.col("a_map_id"))
    equal = F.col("a_name").eqNullSafe(F.col("s_partner")) & F.col("a_own_table").eqNullSafe(F.col("s_own_table"))
    pairs = of("s", "report").join(of("a"), ["group", "block"]).where(own | ~equal).join(size, ["group", "block"])
    near, second = record_features()
    pairs = pairs.select("report", F.col("s_variant").alias("s"), F.col("a_variant").alias("a"), near.alias("near"), second.alias("second"), own.cast("double").alias("y"), F.when(own, UNIT).otherwise(F.round(UNIT * F.least(F.lit(OTHERS), "size") / F.col("size"))).cast("bigint").alias("n"))
    counted = pairs.groupBy("report", "s", "a", "near", "second", "y").agg((F.sum("n") / UNIT).alias("n"))
    variants = rows.groupBy("variant").agg(*[F.first(c).alias(c) for c in ("name", "kind", "own_table")])
    about = lambda m: variants.select(F.col("variant").alias(m), *[F.col(c).alias(f"{m}_{c}") for c in ("name", "kind", "own_table")])
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, vectors, last, found = shared.value, {}, None, None
        side = lambda name, kind, own_table: {"name": name, "kind": kind, "own_table": own_table, "n1": None, "n2": None}

        def vector(variant: int, r: dict) -> np.ndarray:
            if variant not in vectors:
                if len(vectors) > 50_000:
                    vectors.clear()
                vectors[variant] = m.space.vector(m.tokens(r))
            return vectors[variant]

        for frame in frames:
            out = []
            for report, s, a, near, second, y, n, *sides in frame.itertuples(index=False, name=None):
                if (s, a) != last:
                    left, right = side(*sides[:3]), side(*sides[3:])
                    last, found = (s, a), features(m.kind(report), m.names, left, right, float(vector(s, left) @ vector(a, right)))
                out.append((report, found[1], found[2], found[5], near, second, found[8], found[9], y, n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in KNOWN.split(", ")])

    told = counted.join(about("s"), "s").join(about("a"), "a").select("report", "s", "a", "near", "second", "y", "n", *[f"{m}_{c}" for m in "sa" for c in ("name", "kind", "own_table")])
    # a name typed alike is looked up in one task
    return keep(told.repartition(_tasks(spark), "s_name").sortWithinPartitions("s_name", "s", "a", "near", "second", "y").mapInPandas(run, KNOWN), "calibration")


def graph_records(rows: DataFrame) -> DataFrame:
    """(id, tokens): the distinct records of the walked graph; a token's id and attribute are one number. rows: `records`."""
    none = F.lit(None).cast("string")
    both = rows.where("side = 'both-s'").select("report", none.alias("side"), "name", "partner", "kind", "answer_table")
    # without their table, whose columns have nothing else in common
    single = rows.where("side IN ('s', 'a')").select("report", "side", "name", none.alias("partner"), "kind", none.alias("answer_table"))
    distinct = both.unionByName(single).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            of = lambda r: side_tokens(r["name"], r["kind"], r["answer_table"]) + side_tokens(r["partner"], None, None)
            tokens = [[t * len(ATTRIBUTES) + a for t, a in hashed(of(r))] for r in frame.to_dict("records")]
            yield pd.DataFrame({"id": frame["id"], "tokens": tokens})

    return distinct.withColumn("id", F.xxhash64(*distinct.columns)).repartition(_tasks(rows.sparkSession)).mapInPandas(run, "id bigint, tokens array<int>")


STEP = "slice int, block int, nodes binary, visits binary, seen binary, into binary, out binary"


def trained_space(rows: DataFrame, entries: list[tuple]) -> Space:
    """Vectors and weights from the walks of all records and of the reference list, which is in every block."""
    spark, shared = rows.sparkSession, TOKENS + len(ATTRIBUTES)
    given = []
    for _, _, name, vi, en, aliases in entries:
        labels = [name, vi, en, *(aliases or "").split(";")]
        given.append(hashed([(t, 0) for label in labels if label for t in name_tokens(label)] + [(f"w:{canon.telex(w, False)}", 0) for w in (vi or "").split()]))
    graph = keep(graph_records(rows), "graph")
    blocks = max(1, math.ceil(graph.count() / BLOCK_RECORDS))
    into, out = skip_gram(np.zeros((0, 0), dtype=np.int32), shared)
    degree = lambda records, n: np.bincount(np.array([t for tokens in records for t in {t for t, _ in tokens}], dtype=np.int64), minlength=n)
    seen = degree(given, TOKENS)
    totals = np.zeros(shared, dtype=np.int64)

    def train_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([pd.DataFrame({"id": [], "tokens": [], "block": []}), *frames]).sort_values("id")
        if frame.empty and blocks > 1:
            return
        block, start = (int(frame["block"].iloc[0]) if len(frame) else 0), state.value
        own = [[divmod(int(t), len(ATTRIBUTES)) for t in tokens] for tokens in frame["tokens"]]
        graph = Graph(own + given)
        rng = np.random.default_rng([11, turn, block])
        walks = graph.walks(rng)
        ends = skip_gram(walks, shared + graph.records, seed=[5, turn, block], passes=1, start=start)
        visits = np.bincount(walks.ravel(), minlength=shared)[:shared]
        records = degree(own, shared)
        steps = [(e[:shared] - s) for e, s in zip(ends, start)]
        for at in range(0, shared, SLICE):
            nodes = at + np.flatnonzero((visits + records)[at : at + SLICE])  # what no walk met keeps its vector, but counts
            parts = (nodes.astype("<i4"), visits[nodes].astype("<i8"), records[nodes].astype("<i8"), *(d[nodes].astype("<f2") for d in steps))
            yield pd.DataFrame([(at // SLICE, block, *(p.tobytes() for p in parts))], columns=[c.split()[0] for c in STEP.split(", ")])

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        first = int(frame["slice"].iloc[0]) * SLICE
        n, records, moved = np.zeros(SLICE, dtype=np.int64), np.zeros(SLICE, dtype=np.int64), np.zeros((2, SLICE, DIM))
        for r in frame.sort_values("block").to_dict("records"):
            nodes, visits = np.frombuffer(r["nodes"], "<i4") - first, np.frombuffer(r["visits"], "<i8")
            n[nodes] += visits
            records[nodes] += np.frombuffer(r["seen"], "<i8")
            for k, c in enumerate(("into", "out")):
                moved[k, nodes] += visits[:, None] * np.frombuffer(r[c], "<f2").astype(np.float64).reshape(-1, DIM)
        nodes = np.flatnonzero(n + records)
        mean = (moved[:, nodes] / np.maximum(n[nodes, None], 1)).astype("<f4")
        parts = ((first + nodes).astype("<i4"), n[nodes], records[nodes], mean[0], mean[1])
        return pd.DataFrame([(first // SLICE, 0, *(p.tobytes() for p in parts))], columns=[c.split()[0] for c in STEP.split(", ")])

    for turn in range(EPOCHS):
        state = spark.sparkContext.broadcast((into, out))
        dealt = graph.withColumn("block", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
        for r in dealt.mapInPandas(train_block, STEP).groupBy("slice").applyInPandas(add_up, STEP).collect():
            nodes = np.frombuffer(r["nodes"], "<i4")
            into[nodes] += np.frombuffer(r["into"], "<f4").reshape(-1, DIM)
            out[nodes] += np.frombuffer(r["out"], "<f4").reshape(-1, DIM)
            totals[nodes] = np.frombuffer(r["seen"], "<i8")
        state.unpersist()
    return Space.trained(into[:TOKENS], seen + totals[:TOKENS])


def train(rows: DataFrame, tables: DataFrame, entries: list[tuple]) -> Model:
    """Vectors from all records and the reference list; calibration from all two-sided records. rows: `records`."""
    model = Model(trained_space(rows, entries), Names(entries))
    both = rows.where("side LIKE 'both-%'")
    model.calibrate(known_pairs(both, tables, model), both.select("submission_id").distinct().count())
    return model


def with_table(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds own_table, the reference table a row is about, where its group says so."""
    joined = rows.join(tables, ["submission_id", "student_table"], "left")
    return joined.withColumn("own_table", F.coalesce("answer_table", "known_table")).drop("known_table")


PLACED = "variant bigint, report string, name string, kind string, own_table string, vector binary, keys array<bigint>"


def place(variants: DataFrame, model, tasks: int) -> DataFrame:
    """PLACED: each variant with its vector, its table and its keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                own = r["own_table"] or (m.names.table_of(r["student_table"]) if r["student_table"] else None)
                vector = m.space.vector(m.tokens({**r, "own_table": own})).astype("<f2").tobytes()
                out.append((r["variant"], r["report"], r["name"], r["kind"], own, vector, m.names.keys(m.kind(r["report"]), r["side"], r["name"])))
            yield pd.DataFrame(out, columns=["variant", "report", "name", "kind", "own_table", "vector", "keys"])

    return variants.repartition(tasks).mapInPandas(run, PLACED)


def candidates(members: DataFrame, placed: DataFrame, model, leaf: int) -> DataFrame:
    """(group, s, a): pairs of variants of a group that meet in a block. members: group, side, variant, n (the larger side's variants)."""
    side = lambda df, m: df.where(F.col("side") == m).withColumnRenamed("variant", m).drop("side")
    few = members.where(F.col("n") <= leaf).select("group", "side", "variant")
    whole = side(few, "s").join(side(few, "a"), "group").select("group", "s", "a")

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = model.value.space
        for frame in frames:
            bits = frame["n"].map(bits_of)
            for (b, m), own in frame.groupby([bits, frame["side"]]):
                vectors = np.stack([np.frombuffer(v, "<f2").astype(np.float32) for v in own["vector"]])
                met = [np.r_[c, np.array(k, dtype=np.int64)] for c, k in zip(space.cells(vectors, int(b), m == "s"), own["keys"])]
                n = [len(x) for x in met]
                yield pd.DataFrame({"group": np.repeat(own["group"].to_numpy(), n), "side": m, "variant": np.repeat(own["variant"].to_numpy(), n), "cell": np.concatenate(met)})

    many = members.where(F.col("n") > leaf).join(placed.select("variant", "vector", "keys"), "variant")
    cut = many.select("group", "side", "variant", "n", "vector", "keys").mapInPandas(cells, "group bigint, side string, variant bigint, cell bigint")
    # the ids alone go through the join; a pair that meets more than once is one
    met = side(cut, "s").join(side(cut, "a"), ["group", "cell"]).select("group", "s", "a").distinct()
    return whole.unionByName(met)


def judged(pairs: DataFrame, placed: DataFrame, model, tasks: int) -> DataFrame:
    """(s, a, odds) of the distinct pairs of variants that can match, judged once however many groups they occur in."""
    of = lambda m: placed.select(F.col("variant").alias(m), F.struct("report", "name", "kind", "own_table", "vector").alias(f"of_{m}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for frame in frames:
            vectors = [np.stack([np.frombuffer(r["vector"], "<f2") for r in frame[c]]).astype(np.float32) if len(frame) else np.zeros((0, DIM)) for c in ("of_s", "of_a")]
            cosine = (vectors[0] * vectors[1]).sum(axis=1)
            odds = [m.log_odds(s["report"], s, a, float(c)) for s, a, c in zip(frame["of_s"], frame["of_a"], cosine)]
            out = pd.DataFrame({"s": frame["s"], "a": frame["a"], "odds": np.array(odds, dtype=np.float64)})
            yield out[out["odds"].notna()]

    single = pairs.select("s", "a").distinct()
    return single.join(of("s"), "s").join(of("a"), "a").repartition(tasks).mapInPandas(run, "s bigint, a bigint, odds double")


def record_features() -> tuple[Column, Column]:
    """`features` 6 and 7 of positions and counts of two records (n1, n2 on either side)."""
    n1, m1, n2, m2 = (F.col(c).cast("double") for c in ("s_n1", "a_n1", "s_n2", "a_n2"))
    # least and greatest pass over nulls, so what is missing is asked for first
    known = lambda x, y, value: F.when(x.isNotNull() & y.isNotNull(), value).otherwise(0.0)
    near = known(n1, m1, 1 - F.least(F.lit(3.0), F.abs(n1 - m1)))
    counts = known(n2, m2, 1 - F.least(F.lit(2.0), F.abs(n2 - m2) / F.greatest(F.lit(2.0), 0.1 * F.greatest(n2, m2))))
    flags = F.coalesce(F.when(n2 == m2, 1.0).when(n2 != m2, -1.0), F.lit(0.0))
    return near, F.when(F.col("report") == REPORTS[0], counts).otherwise(flags)


def record_odds(weights: dict[str, np.ndarray]) -> Column:
    """What positions and counts of two records add to the log odds."""
    near, second = record_features()
    t, c = (weights[r] for r in REPORTS)
    of = lambda k: F.when(F.col("report") == REPORTS[0], float(t[k])).otherwise(float(c[k]))
    return of(6) * near + of(7) * second


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, submission_id, student_id, answer_id, confidence) of all matched pairs, copies included."""
    rows, tables = records(spark, sf_dir), known_tables(spark, sf_dir)
    entries = [tuple(r) for r in table(spark, sf_dir, "canonical_names").select("kind", "entry_id", "canonical_name", "label_vi", "label_en", "known_aliases").orderBy("entry_id").collect()]
    trained = train(rows, tables, entries)
    model = spark.sparkContext.broadcast(trained)
    tasks = _tasks(spark)

    plain = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("\0"))
    attributes = ["report", "side", "name", "own_table", "student_table", "kind"]
    sides = with_table(rows.where("side IN ('s', 'a')").drop("partner"), tables)
    # records of one object may differ in type, position or counts
    coded = sides.withColumns({"group": _key("report", "submission_id"), "variant": _key(*attributes), "object": F.xxhash64(plain("name"), plain("own_table"), plain("student_table"))})
    single = keep(coded.select("group", "submission_id", "variant", "object", "map_id", "n1", "n2", *attributes), "single")

    members = single.select("group", "side", "variant").distinct()
    of = lambda m: F.count(F.when(F.col("side") == m, 1)).alias(f"n_{m}")
    size = members.groupBy("group").agg(of("s"), of("a")).where("n_s > 0 AND n_a > 0").select("group", F.greatest("n_s", "n_a").alias("n"))
    members = keep(members.join(size, "group"), "members")
    variants = single.join(members.select("variant").distinct(), "variant", "left_semi").groupBy("variant").agg(*[F.first(c).alias(c) for c in attributes])
    placed = keep(place(variants, model, tasks), "placed")
    pairs = keep(candidates(members, placed, model, LEAF), "pairs")
    scored = pairs.join(keep(judged(pairs, placed, model, tasks), "judged"), ["s", "a"])

    # equal records of a group are compared once
    contents = single.groupBy("group", "report", "submission_id", "side", "variant", "object", "n1", "n2").agg(F.count(F.lit(1)).alias("copies"))
    part = lambda m: contents.where(F.col("side") == m).select("group", "report", "submission_id", F.col("variant").alias(m), *[F.col(c).alias(f"{m}_{c}") for c in ("object", "n1", "n2")])
    where = ["group", "report", "submission_id"]
    both = scored.join(part("s"), ["group", "s"]).join(part("a"), [*where, "a"])
    odds = F.col("odds") + record_odds(trained.weights)
    sure = keep(both.withColumn("confidence", 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))).where(F.col("confidence") >= CONFIDENT), "sure")
    objects = sure.groupBy(*where, "s_object", "a_object").agg(F.max("confidence").alias("of_pair"))
    best = lambda c: F.max("of_pair").over(Window.partitionBy(*where, c))
    chosen = objects.withColumns({"of_s": best("s_object"), "of_a": best("a_object")}).where("of_pair = of_s AND of_pair = of_a").select(*where, "s_object", "a_object")
    kept = sure.join(chosen, [*where, "s_object", "a_object"], "left_semi")
    copies = lambda m, name: single.where(F.col("side") == m).select(*where, F.col("variant").alias(m), *[F.struct("n1", "n2").alias(f"{m}_counts")], F.col("map_id").alias(name))
    kept = kept.select(*where, "s", "a", F.struct(F.col("s_n1").alias("n1"), F.col("s_n2").alias("n2")).alias("s_counts"), F.struct(F.col("a_n1").alias("n1"), F.col("a_n2").alias("n2")).alias("a_counts"), "confidence")
    out = kept.join(copies("s", "student_id"), [*where, "s", "s_counts"]).join(copies("a", "answer_id"), [*where, "a", "a_counts"])
    return out.select("report", "submission_id", "student_id", "answer_id", "confidence")


def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: report, map_id_1, map_id_2."""
    return matches(spark, sf_dir).select("report", F.least("student_id", "answer_id").alias("map_id_1"), F.greatest("student_id", "answer_id").alias("map_id_2"))
