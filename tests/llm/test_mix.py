import math
import os

import pytest
from pyspark.sql import functions as F

from matchloom.llm import mix as M

SIZED = "doc_id bigint, source string, tokens bigint, draw double, bin int"
TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, rows, bins=4):
    """rows: doc_id, source, tokens"""
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    draw = M.exponential_key(F.col("doc_id"), F.lit(1.0))
    return df.withColumn("draw", draw).withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("draw") / 2)) * bins), F.lit(bins - 1)).cast("int"))


def test_budgets():
    stock = {"a": 100, "b": 1000, "c": 50}
    b = M.budgets(stock, [("a", 0.5, 2), ("b", 0.5, 1), ("gone", 0.2, 3)])
    assert b == {"a": 200.0, "b": 200.0}
    b = M.budgets(stock, [("a", 0.5, 2), ("b", 0.5, 1)], total_tokens=1000)
    assert b == {"a": 200.0, "b": 500.0}
    assert M.budgets({}, [("a", 1.0, 1)]) == {} and M.budgets(stock, [("a", None, 1), ("b", 0.0, 2), ("c", 1.0, None)]) == {}


def reference(rows, draws, budget, stock):
    """Complete epochs, then the prefix in the order of the keys whose sum is nearest to the rest."""
    out = {}
    for s, b in budget.items():
        epochs, rest = int(b // stock[s]), b - (b // stock[s]) * stock[s]
        below = 0
        for d, src, n in sorted((r for r in rows if r[1] == s), key=lambda r: (draws[r[0]], r[0])):
            k = epochs + (1 if n > 0 and rest > 0 and below + n / 2 <= rest else 0)
            below += n
            if k:
                out[d] = k
    return out


@pytest.mark.parametrize("bins", [1, 4, 50])
def test_against_a_sorted_loop(spark, bins):
    rows = [(i, "abc"[i % 3] if i % 10 else None, (i * 37) % 90) for i in range(600)]
    df = sized(spark, rows, bins)
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("none", 0.1, 3)], TARGETS).withColumn("tokens", F.lit(-1))
    got = {r["doc_id"]: r["repeats"] for r in M.mixture(df, targets).collect()}
    stock = {s: sum(n for _, src, n in rows if src == s) for s in "ab"}
    draws = {r["doc_id"]: r["draw"] for r in df.collect()}
    assert got == reference(rows, draws, M.budgets(stock, [("a", 0.6, 2), ("b", 0.3, 1), ("none", 0.1, 3)]), stock)
    report = {r["source"]: r for r in M.shares(df, targets, M.mixture(df, targets)).collect()}
    assert abs(report["a"]["actual_share"] - 2 / 3) < 0.01 and abs(report["b"]["actual_share"] - 1 / 3) < 0.01
    assert report["none"]["mixed_tokens"] == 0 and report["c"]["actual_share"] == 0 and None in report
    assert report["a"]["most_repeats"] <= 2 and report["b"]["most_repeats"] <= 1


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert M.mixture(sized(spark, []), targets).count() == 0
    assert M.mixture(sized(spark, [(1, "a", 5)]), targets.limit(0)).count() == 0
    assert M.mixture(sized(spark, [(1, "a", 0), (2, "a", 0)]), targets).count() == 0


def test_heavier_documents_come_first(spark):
    df = spark.range(20000).select(M.exponential_key(F.col("id"), F.lit(1.0)).alias("light"), M.exponential_key(F.col("id"), F.lit(4.0)).alias("heavy"))
    r = df.agg(F.avg("light"), F.avg("heavy")).first()
    assert math.isclose(r[0], 1.0, rel_tol=0.05) and math.isclose(r[1], 0.25, rel_tol=0.05)


@pytest.mark.skipif(not os.path.exists(f"{M.TOKENIZERS}/{M.VOCABULARY}"), reason="no vocabulary files")
def test_tokens_and_measure(spark):
    texts = [(1, "s", "The same text."), (2, "s", None), (3, None, ""), (4, "t", "x " * 30000), (4, "t", "<|endoftext|>")]
    docs = spark.createDataFrame(texts, "doc_id bigint, source string, text string").withColumns({"tokens": F.lit("clash"), "quality": F.lit(0)})
    out = {}
    for r in M.measured(docs).collect():
        out.setdefault(r["doc_id"], []).append(r["tokens"])
    encode = M.encoding(f"{M.TOKENIZERS}/{M.VOCABULARY}").encode_ordinary
    assert out[1] == [len(encode("The same text."))] and out[2] == [0] and out[3] == [0]
    assert sorted(out[4]) == sorted([len(encode("x " * 30000)), len(encode("<|endoftext|>"))])
