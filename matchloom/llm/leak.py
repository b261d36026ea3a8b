"""Evaluation passages in a training corpus, by greedy string tiling.

Texts become words without case, accents, punctuation and layout. Words of an item that belong to a stock
instruction (a first or last sentence that several different items share, counted over all items) are barred. Seeds, runs of three words
that a document and an item share, are found with rolling Karp-Rabin hashes; from the seeds of a pair the
longest matches are marked first and never overlap (tiles). Tiles that follow each other in both texts
with few words between form a passage.

A document leaks an item when the tiles of one passage hold enough words, or when tiles close together
cover most of the item, in whatever order. Defined results: null and empty texts leak nothing; an item
without unbarred words is never leaked; an item with fewer unbarred words than the passage threshold must
stand there wholly, in one passage; repeated documents and items are reported one by one, and items of equal
text count once for stock instructions; texts are processed whole.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import keep, spread, table

#: Words of a seed, words the tiles of a passage must hold, words a passage may skip at once.
SEED, PASSAGE, SKIP = 3, 13, 3
#: Share of an item's words that tiles close together must cover if they are not in order, and the least tile then.
COVER, LONG_TILE = 0.6, 5
#: Items that share a first or last sentence from which on it is a stock instruction.
STOCK_ITEMS = 3
#: Items and characters of items searched for in one pass over the corpus; their index is what a pass sends to the
#: executors. A single item above the characters is a block of its own.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000

_MASK = (1 << 61) - 1
_BASE = 1_000_003
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str) -> list[str]:
    """Words without case, accents and punctuation."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    if not plain.isascii():
        plain = "".join(c for c in plain if not unicodedata.combining(c)).replace("đ", "d")
    return _WORD.findall(plain)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of an item."""
    return [words(s) for s in _SENTENCE.split(text or "")]


def end_keys(parts: list[list[str]]) -> tuple[str | None, str | None]:
    """Keys of an item's first and last sentence; None for one without words."""
    key = lambda s: hashlib.blake2b(" ".join(s).encode(), digest_size=16).hexdigest() if s else None
    return key(parts[0]), key(parts[-1])


@dataclass
class Index:
    """The items of one block: their word codes, what is barred, and where each seed stands."""

    ids: list[int]
    codes: list[np.ndarray]
    free: list[int]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    places: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, str, bool, bool]]) -> Index:
        """items: id, text, whether the first and the last sentence are stock instructions."""
        vocabulary: dict[str, int] = {}
        ids, codes, free, seeds, places = [], [], [], [], []
        for item, text, first, last in items:
            parts = sentences(text)
            row: list[int] = []
            for k, s in enumerate(parts):
                barred = (first and k == 0) or (last and k == len(parts) - 1)
                row += [-1] * len(s) if barred else [vocabulary.setdefault(w, len(vocabulary)) for w in s]
            ids.append(item)
            codes.append(np.array(row, dtype=np.int64))
            free.append(sum(c >= 0 for c in row))
            runs = rolling(codes[-1])
            at = np.flatnonzero(runs >= 0)
            seeds.append(runs[at])
            places.append(np.stack([np.full(len(at), len(ids) - 1), at], axis=1))
        all_seeds = np.concatenate([np.zeros(0, dtype=np.int64), *seeds])
        all_places = np.concatenate([np.zeros((0, 2), dtype=np.int64), *places])
        order = np.argsort(all_seeds, kind="stable")
        return cls(ids, codes, free, vocabulary, all_seeds[order], all_places[order])

    def encode(self, text: str) -> np.ndarray:
        """Word codes of a document; -2 for words no item has."""
        return np.array([self.vocabulary.get(w, -2) for w in words(text)], dtype=np.int64)


def rolling(codes: np.ndarray) -> np.ndarray:
    """Karp-Rabin value of each run of SEED known words; -1 where a word is barred or unknown."""
    n = len(codes) - SEED + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(SEED):
        part = codes[k : k + n]
        known &= part >= 0
        out = (out * _BASE + part + 1) & _MASK
    return np.where(known, out, -1)


def tiles(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds at document places `d` and item places `i`: (document start, item start, length)."""
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    breaks = np.flatnonzero((np.diff(d - i) != 0) | (np.diff(d) != 1)) + 1
    first, last = np.r_[0, breaks], np.r_[breaks, len(d)] - 1
    queue = list(zip((first - last - SEED).tolist(), d[first].tolist(), i[first].tolist()))
    heapq.heapify(queue)  # the longest first, then by place
    doc_marked, item_marked = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    out = []
    while queue:
        n, at, of = heapq.heappop(queue)
        n = -n
        blocked = np.flatnonzero(doc_marked[at : at + n] | item_marked[of : of + n])
        if not len(blocked):
            doc_marked[at : at + n] = True
            item_marked[of : of + n] = True
            out.append((at, of, n))
            continue
        # what is left between marked words goes back into the queue
        edges = np.r_[-1, blocked, n]
        gaps = np.diff(edges) - 1
        for k in np.flatnonzero(gaps >= SEED):
            heapq.heappush(queue, (-int(gaps[k]), at + int(edges[k]) + 1, of + int(edges[k]) + 1))
    return sorted(out)


def longest_passage(found: list[tuple[int, int, int]]) -> int:
    """Most words in a chain of tiles that follow each other in both texts, with at most SKIP words between."""
    best: list[int] = []
    for k, (d, i, n) in enumerate(found):
        before, j = 0, k - 1
        # tiles do not overlap, so their ends ascend as their starts do
        while j >= 0 and d - (found[j][0] + found[j][2]) <= SKIP:
            if 0 <= i - (found[j][1] + found[j][2]) <= SKIP:
                before = max(before, best[j])
            j -= 1
        best.append(n + before)
    return max(best, default=0)


def covered(found: list[tuple[int, int, int]], width: int) -> int:
    """Most words of long tiles inside any stretch of the document of the given width."""
    most = inside = end = 0
    long = [(d, n) for d, _, n in found if n >= LONG_TILE]
    for d, n in long:
        while end < len(long) and long[end][0] + long[end][1] <= d + width:
            inside += long[end][1]
            end += 1
        most = max(most, inside)
        inside -= n
    return most


def leaked(index: Index, text: str) -> list[tuple[int, int, float]]:
    """(item, words of the longest passage, covered share) for the items a document leaks."""
    if not text or not len(index.seeds):
        return []
    doc = index.encode(text)
    runs = rolling(doc)
    at = np.flatnonzero(runs >= 0)
    left, right = np.searchsorted(index.seeds, runs[at], "left"), np.searchsorted(index.seeds, runs[at], "right")
    n = right - left
    if not n.any():
        return []
    d = np.repeat(at, n)
    item, place = index.places[np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())].T
    order = np.argsort(item, kind="stable")
    d, item, place = d[order], item[order], place[order]
    edges = np.r_[np.flatnonzero(np.r_[True, item[1:] != item[:-1]]), len(item)]
    out = []
    for a, b in zip(edges, edges[1:]):
        k = int(item[a])
        free, codes = index.free[k], index.codes[k]
        least = min(PASSAGE, free)
        # every tile of n words has n - SEED + 1 seeds
        if (b - a) * SEED < least:
            continue
        # seeds agree in their words, not in their hashes alone
        same = np.logical_and.reduce([doc[d[a:b] + j] == codes[place[a:b] + j] for j in range(SEED)])
        found = tiles(doc, codes, d[a:b][same], place[a:b][same]) if same.any() else []
        passage, share = longest_passage(found), covered(found, 2 * len(codes)) / free
        if passage >= least or (free >= PASSAGE and share >= COVER):
            out.append((index.ids[k], passage, share))
    return out


def with_stock(items: DataFrame) -> DataFrame:
    """(item_id, text, first, last): whether the ends of each item are stock sentences, counted over all items of different text."""

    @F.pandas_udf("first string, last string, whole string")
    def keys(texts: pd.Series) -> pd.DataFrame:
        parts = [sentences(t) for t in texts]
        whole = [hashlib.blake2b(" ".join(w for s in p for w in s).encode(), digest_size=16).hexdigest() for p in parts]
        return pd.DataFrame([(*end_keys(p), h) for p, h in zip(parts, whole)], columns=["first", "last", "whole"])

    keyed = keep(items.select("item_id", "text", keys("text").alias("k")).select("item_id", "text", "k.*"), "items")
    ends = keyed.select("whole", F.explode(F.array("first", "last")).alias("key")).where("key IS NOT NULL")
    stock = ends.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= STOCK_ITEMS)
    mark = lambda end: stock.select(F.col("key").alias(end), F.lit(True).alias(f"{end}_stock"))
    marked = keyed.join(mark("first"), "first", "left").join(mark("last"), "last", "left")
    flag = lambda end: F.coalesce(F.col(f"{end}_stock"), F.lit(False)).alias(end)
    return marked.select("item_id", "text", flag("first"), flag("last"))


def item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with a `block`, and the number of blocks: none above BLOCK_ITEMS items or, unless it is one item, BLOCK_CHARS characters."""
    sized = keep(items.select("*", F.xxhash64("item_id", "text").alias("_h"), F.coalesce(F.length("text"), F.lit(0)).alias("_n")), "stock")
    total = sized.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("_n"), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-total["items"] // BLOCK_ITEMS), -(-total["chars"] // BLOCK_CHARS))
    while True:
        placed = sized.withColumn("block", F.pmod("_h", F.lit(blocks)))
        of = placed.groupBy("block").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("_h").alias("different"), F.sum("_n").alias("chars"))
        if of.where((F.col("different") > 1) & ((F.col("items") > BLOCK_ITEMS) | (F.col("chars") > BLOCK_CHARS))).isEmpty():
            return placed.drop("_h", "_n"), blocks
        blocks *= 2


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage_words, covered) for documents (doc_id, text) and items (item_id, text).

    The items are the query set; they are searched for in blocks, one pass over the corpus each, so that
    what is sent to the executors is bounded by BLOCK_ITEMS and BLOCK_CHARS whatever their number.
    """
    spark = documents.sparkSession
    placed, blocks = item_blocks(with_stock(items))
    passes = []
    for b in range(blocks):
        block = placed.where(F.col("block") == b).select("item_id", "text", "first", "last").orderBy("item_id", "text").collect()
        if not block and blocks > 1:
            continue
        index = spark.sparkContext.broadcast(Index.build([tuple(r) for r in block]))

        def search(frames: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(d, *hit) for d, t in zip(frame["doc_id"], frame["text"]) if t for hit in leaked(index.value, t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "passage_words", "covered"])

        passes.append(spread(documents.select("doc_id", "text")).mapInPandas(search, "doc_id bigint, item_id bigint, passage_words int, covered double"))
    return reduce(DataFrame.unionByName, passes)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def leaking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: doc_id, item_id."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents that leak it, its longest passage and the largest share covered; zeros where none does."""
    found = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("passage_words").alias("p"), F.max("covered").alias("c"))
    items = table(spark, sf_dir, "eval_items", "item_id", "suite")
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return items.join(found, "item_id", "left").select("item_id", "suite", zero("n", "documents"), zero("p", "passage_words"), zero("c", "covered"))
