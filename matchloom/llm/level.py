"""Reading level of each document: sentences are classified, documents are judged by their sentences.

Two softmax models with an L2 penalty, one over hashed character n-grams and one over hashed words and word
pairs, give each sentence a distribution over the levels; a third, small one turns the mean distribution,
its spread and the shares of the sentences' levels into the document's calibrated distribution. Both
halves of the labelled documents judge each other, so that the last model sees honest predictions.

Labelled rows are a bounded sample (LABELLED documents, by hash of their id); everything else covers all
documents. A document with fewer than three sentences of running prose has no level. Defined results: null
and empty texts have no level; documents without labels, with null labels or labels outside the scale train
nothing; several graders of a document are averaged; if nothing is labelled at all, the result is empty.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import spread, table

#: Labelled documents the models are fitted on at most, and levels of the scale.
LABELLED, LEVELS = 6_000, 4
#: Sentences of running prose a document needs, and words a sentence needs with and without a full stop.
LEAST, STOPPED, OPEN = 3, 3, 5
#: Hashed features per model, character n-gram lengths, passes over the sample, penalty, sentences a step.
WIDTH, GRAMS, EPOCHS, L2, STEP = 1 << 16, (3, 4, 5), 5, 1e-5, 256
#: Documents scored at once in a task.
CHUNK = 200

_SPLIT = regex.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_MARKUP = regex.compile(r"<[^<>]{0,40}>|&[a-z]{2,8};|\[[a-z ]{2,20}\]|^\s*(?:[-*•>]+|\(?\d{1,3}[.)])\s+")
_CODE = regex.compile(r"^(?:SELECT|FROM|WHERE|ORDER BY|GROUP BY|HAVING|CREATE|INSERT|UPDATE|DELETE|ALTER|DROP|DECLARE|EXEC|WITH|GO|SET|USE|ON|AND|OR|(?:LEFT |RIGHT |INNER |FULL |CROSS )?JOIN|VALUES|RETURN|BEGIN|END|--)\b|;$|^--|^\d{4}-\d\d-\d\d|\w+=\S+.*\w+=\S+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}'_]*")


def sentences(text: str) -> list[str]:
    """Sentences of running prose, without markup, list marks, code, log lines, salutations and headings."""
    out = []
    for part in _SPLIT.split(text):
        s = _MARKUP.sub(" ", part).strip()
        if not s or _CODE.search(s) or s[-1] in ",:":
            continue
        if len(_WORD.findall(s)) >= (STOPPED if s[-1] in ".!?…)" else OPEN):
            out.append(s)
    return out


def plain(s: str) -> str:
    """Lower case without accents; digits all alike."""
    s = unicodedata.normalize("NFD", s.lower())
    if not s.isascii():
        s = "".join(c for c in s if not unicodedata.combining(c)).replace("đ", "d")
    return regex.sub(r"\d+", "0", s)


def char_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after the other, and how many each text has."""
    joined = np.frombuffer("".join(f"\1{t}\1" for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
    index, owners = [], []
    for n in GRAMS:
        m = len(joined) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + joined[k : k + m]
        inside = owner[:m] == owner[n - 1 :]
        index.append((h >> np.uint64(40))[inside] % np.uint64(WIDTH))
        owners.append(owner[:m][inside])
    if not index:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    index, owners = np.concatenate(index), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return index[order].astype(np.int32), np.bincount(owners, minlength=len(texts))


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of neighbouring words, and marks of the sentence's length and commas."""
    index, sizes = [], []
    for t in texts:
        ws = t.split()
        hs = [zlib.crc32(w.encode()) for w in ws]
        own = [h % WIDTH for h in hs] + [(a * 31 + b) % WIDTH for a, b in zip(hs, hs[1:])]
        own += [zlib.crc32(f"\1length {min(12, len(ws) // 4)}".encode()) % WIDTH, zlib.crc32(f"\1commas {min(4, t.count(','))}".encode()) % WIDTH]
        index += own
        sizes.append(len(own))
    return np.array(index, dtype=np.int32), np.array(sizes, dtype=np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Linear:
    """Softmax regression over the mean of a text's hashed features, fitted by Adagrad with an L2 penalty."""

    def __init__(self) -> None:
        self.w = np.zeros((WIDTH, LEVELS), dtype=np.float32)
        self.b = np.zeros(LEVELS, dtype=np.float32)

    def logits(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.cumsum(sizes) - sizes
        sums = np.zeros((len(sizes), LEVELS), dtype=np.float32)
        some = sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(self.w[index], starts[some], axis=0)
        return self.b + sums / np.sqrt(np.maximum(sizes, 1))[:, None]

    def fit(self, index: np.ndarray, sizes: np.ndarray, target: np.ndarray, seed: int) -> Linear:
        rng, starts = np.random.default_rng(seed), np.cumsum(sizes) - sizes
        seen_w, seen_b = np.full_like(self.w, 1e-6), np.full_like(self.b, 1e-6)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), STEP):
                rows = order[at : at + STEP]
                n = sizes[rows]
                place = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own = index[place]
                error = (softmax(self.logits(own, n)) - target[rows]).astype(np.float32)
                spread = np.repeat(error / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
                g = np.stack([np.bincount(own, spread[:, k], WIDTH) for k in range(LEVELS)], axis=1).astype(np.float32) / len(rows) + L2 * self.w
                seen_w += g * g
                self.w -= 0.1 * g / np.sqrt(seen_w)
                gb = error.mean(axis=0)
                seen_b += gb * gb
                self.b -= 0.1 * gb / np.sqrt(seen_b)
        return self


class SentenceModel:
    """Character and word model together."""

    def __init__(self) -> None:
        self.parts = (Linear(), Linear())

    def fit(self, texts: list[str], target: np.ndarray, seed: int) -> SentenceModel:
        for part, features in zip(self.parts, (char_features, word_features)):
            part.fit(*features(texts), target, seed)
        return self

    def logits(self, texts: list[str]) -> np.ndarray:
        return sum(part.logits(*features(texts)) for part, features in zip(self.parts, (char_features, word_features)))


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document, from its sentences' distributions: mean, spread, shares of the levels, mean and summed log odds."""
    starts = np.cumsum(sizes) - sizes
    mean = np.add.reduceat(p, starts, axis=0) / sizes[:, None]
    share = np.add.reduceat(np.eye(LEVELS)[p.argmax(axis=1)], starts, axis=0) / sizes[:, None]
    sums = np.add.reduceat(np.log(p + 1e-3), starts, axis=0)
    logs = sums / sizes[:, None]
    sums = sums - sums.max(axis=1, keepdims=True)
    level = p @ np.arange(1, LEVELS + 1)
    first = np.add.reduceat(level, starts) / sizes
    spread = np.sqrt(np.maximum(0, np.add.reduceat(level**2, starts) / sizes - first**2))
    return np.column_stack([mean, share, logs / 4, np.maximum(sums, -30) / 10, first / LEVELS, spread, np.ones(len(sizes))])


def fit_dense(x: np.ndarray, target: np.ndarray, l2: float = 1e-3, steps: int = 600) -> np.ndarray:
    """Softmax regression on few dense features by gradient descent with momentum."""
    w = np.zeros((x.shape[1], target.shape[1]))
    speed = np.zeros_like(w)
    for _ in range(steps):
        g = x.T @ (softmax(x @ w) - target) / len(x) + l2 * w
        speed = 0.9 * speed - 0.5 * g
        w += speed
    return w


class LevelModel:
    """Levels of documents, given as lists of their prose sentences."""

    @classmethod
    def fit(cls, documents: list[list[str]], target: np.ndarray) -> LevelModel:
        self = cls()
        texts = [[plain(s) for s in d] for d in documents]
        half = np.arange(len(texts)) % 2
        self.halves = []
        for h in (0, 1):
            own = np.flatnonzero(half == h)
            flat = [s for i in own for s in texts[i]]
            self.halves.append(SentenceModel().fit(flat, np.repeat(target[own], [len(texts[i]) for i in own], axis=0), seed=h + 1))
        x = np.zeros((len(texts), 4 * LEVELS + 3))
        for h in (0, 1):
            other = np.flatnonzero(half != h)
            if len(other):
                sizes = np.array([len(texts[i]) for i in other])
                x[other] = document_features(softmax(self.halves[h].logits([s for i in other for s in texts[i]])), sizes)
        self.top = fit_dense(x, target)
        return self

    def distribution(self, documents: list[list[str]]) -> np.ndarray:
        """Calibrated distribution over the levels; every document has sentences."""
        sizes = np.array([len(d) for d in documents])
        flat = [plain(s) for d in documents for s in d]
        p = softmax(sum(m.logits(flat) for m in self.halves) / 2)
        return softmax(document_features(p, sizes) @ self.top)


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[list[list[str]], np.ndarray]:
    """Sentences and mean label distribution of at most `bound` labelled documents, chosen by the hash of their id."""
    shares = [F.avg((F.col("level_given") == k + 1).cast("double")).alias(f"s{k}") for k in range(LEVELS)]
    given = labels.where(F.col("level_given").between(1, LEVELS)).groupBy("doc_id").agg(*shares)
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    pairs = [(sentences(r["text"] or ""), [r[f"s{k}"] for k in range(LEVELS)]) for r in rows]
    pairs = [(s, t) for s, t in pairs if len(s) >= LEAST]
    return [s for s, _ in pairs], np.array([t for _, t in pairs], dtype=np.float64).reshape(-1, LEVELS)


def reading_levels(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, reading_level, confidence, sentences) for every document of (doc_id, text) with enough prose."""
    spark = documents.sparkSession
    schema = "doc_id bigint, reading_level bigint, confidence double, sentences int"
    known, target = labelled_sample(documents, labels, bound)
    if len(known) < 2:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(LevelModel.fit(known, target))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                found = [(i, s) for i, t in zip(part["doc_id"], part["text"]) if t and len(s := sentences(t)) >= LEAST]
                if found:
                    p = model.value.distribution([s for _, s in found])
                    yield pd.DataFrame({"doc_id": [i for i, _ in found], "reading_level": p.argmax(axis=1) + 1, "confidence": p.max(axis=1), "sentences": [len(s) for _, s in found]})

    return spread(documents.select("doc_id", "text")).mapInPandas(judge, schema)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "reading_labels", "doc_id", "level_given"))


def document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: doc_id, reading_level."""
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def level_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, sentences and mean confidence per source and level."""
    sources = table(spark, sf_dir, "documents", "doc_id", "source")
    return _levels(spark, sf_dir).join(sources, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"), F.round(F.avg("confidence"), 3).alias("confidence"))
