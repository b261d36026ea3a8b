import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import leak as L

rng = random.Random(5)
WORDS = ["".join(rng.choice("bcdfghklmnprstvx") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
ITEMS = [(i, "Read the whole task first. " + " ".join(rng.choice(WORDS) for _ in range(25)) + ". " + " ".join(rng.choice(WORDS) for _ in range(25)) + ".") for i in range(12)]
FILLER = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


def body(i):
    return ITEMS[i][1].split(". ", 1)[1]


@pytest.fixture(scope="module")
def index():
    return built(ITEMS)


def built(items):
    """An index whose stock sentences are counted by hand."""
    ends = [{tuple(L.sentences(t)[k]) for k in (0, -1)} for _, t in items]
    stock = lambda s: bool(s) and sum(tuple(s) in e for e in ends) >= L.STOCK_ITEMS
    return L.Index.build([(i, t, stock(L.sentences(t)[0]), stock(L.sentences(t)[-1])) for i, t in items])


def ids(index, text):
    return [i for i, *_ in L.leaked(index, text)]


def test_whole_and_part(index):
    w = body(3).split()
    assert ids(index, FILLER(40) + " " + body(3) + " " + FILLER(40)) == [3]
    assert ids(index, FILLER(30) + " " + " ".join(w[5:22]) + " " + FILLER(30)) == [3]
    assert ids(index, FILLER(30) + " " + " ".join(w[5:13]) + " " + FILLER(30)) == []


def test_layout_case_accents_and_changes(index):
    w = body(4).upper().replace("A", "Á").split()
    w[7], w[14] = "changed", "-"
    assert ids(index, "\n\t".join(w[:24])) == [4]


def test_stock_alone(index):
    assert ids(index, "Read the whole task first. " * 20 + FILLER(50)) == []


def test_reordered_sentences(index):
    first, second = body(5).rstrip(".").split(". ")
    chunks = [" ".join(x.split()[k : k + 9]) for x in (second, first) for k in (18, 9, 0)]
    assert ids(index, " zzz yyy xxx qqq www ".join(chunks)) == [5]


def test_edge_texts(index):
    assert ids(index, "") == [] and ids(index, "!!!") == [] and ids(index, "a b") == []
    assert ids(index, FILLER(30000) + " " + body(6) + " " + FILLER(30000)) == [6]
    empty = built([(1, None), (2, ""), (3, "one two")])
    assert ids(empty, "one two three") == []
    assert ids(built([(9, "alpha beta gamma delta")]), "x alpha beta gamma delta y") == [9]


def brute(doc, item, barred):
    """Longest in-order run of equal words that skips at most SKIP words at once: by exhaustive search over tiles."""
    d, i = L.words(doc), L.words(item)
    best = 0
    for a in range(len(d)):
        for b in range(len(i)):
            n = 0
            while a + n < len(d) and b + n < len(i) and d[a + n] == i[b + n] and (b + n) not in barred:
                n += 1
            best = max(best, n)
    return best


def test_against_exhaustive_search(index):
    barred = set(range(5))
    for k in range(40):
        w = L.words(ITEMS[k % 12][1])
        at, n = rng.randrange(5, 30), rng.randrange(4, 22)
        text = FILLER(20) + " " + " ".join(w[at : at + n]) + " " + FILLER(20)
        longest = max(brute(text, ITEMS[k % 12][1], barred), 0)
        hit = k % 12 in ids(index, text)
        if longest >= L.PASSAGE:
            assert hit
        if longest < L.PASSAGE - 8:
            assert not hit


def test_dataframes(spark):
    docs = spark.createDataFrame([(1, body(2)), (1, body(2)), (2, None), (3, ""), (4, FILLER(60))], "doc_id bigint, text string").withColumns({"item_id": F.lit(-1), "covered": F.lit("x")})
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc_id", F.lit(-2))
    assert sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, items).collect()) == [(1, 2), (1, 2)]
    assert L.find_leaks(docs, items.limit(0)).count() == 0
    assert L.find_leaks(docs.limit(0), items).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ITEMS", 5)
    docs = spark.createDataFrame([(i, body(i)) for i in range(12)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, items).collect()) == [(i, i) for i in range(12)]


def test_short_items_are_covered_wholly():
    short = built([(9, "alpha beta gamma delta epsilon zeta eta theta")])
    assert ids(short, "x alpha beta gamma delta epsilon y") == []
    assert ids(short, "x alpha beta gamma delta epsilon zeta eta theta y") == [9]


def test_repetitive_texts():
    """A text of one word over and over: the queue of matches stays a heap, and tiles do not overlap."""
    many = built([(1, "ha " * 300), (2, "ha ho " * 150)])
    assert ids(many, "ha " * 6000) == [1]
    found = L.tiles(*(many.encode(t) for t in ("ha " * 400, "ha " * 300)), *np.nonzero(np.ones((398, 298), dtype=bool)))
    assert sum(n for *_, n in found) == 300


def slow_tiles(doc, item):
    """Greedy string tiling by its definition."""
    doc_free, item_free, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and doc_free[d + n] and item_free[i + n]:
                    n += 1
                best = max(best, (n, -d, -i))
        n, d, i = best[0], -best[1], -best[2]
        if n < L.SEED:
            return sorted(out)
        out.append((d, i, n))
        for k in range(n):
            doc_free[d + k] = item_free[i + k] = False


def test_tiles_against_definition():
    r = random.Random(3)
    for _ in range(60):
        doc, item = (np.array([r.randrange(3) for _ in range(r.randrange(3, 30))]) for _ in range(2))
        seeds = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if (doc[d : d + 3] == item[i : i + 3]).all()]
        if seeds:
            assert L.tiles(doc, item, *np.array(seeds).T) == slow_tiles(doc.tolist(), item.tolist())


def test_stock_is_counted_over_all_items(spark, monkeypatch):
    """A stock opening bars the same words whatever the blocks; equal items count once."""
    opening = " ".join(WORDS[:17])
    items = spark.createDataFrame([(i, f"{opening}. {FILLER(30)}.") for i in range(6)] + [(100 + i, FILLER(25) if i == 0 else "same words here " + " ".join(WORDS[40:60])) for i in range(4)], "item_id bigint, text string")
    items.cache()
    docs = spark.createDataFrame([(1, opening), (2, " ".join(WORDS[40:60]))], "doc_id bigint, text string")
    for size in (L.BLOCK_ITEMS, 5):
        monkeypatch.setattr(L, "BLOCK_ITEMS", size)
        assert sorted((r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, items).collect()) == [(2, 101), (2, 102), (2, 103)]
    monkeypatch.setattr(L, "BLOCK_CHARS", 600)
    placed, blocks = L.item_blocks(L.with_stock(items))
    assert blocks > 2 and placed.count() == 10
