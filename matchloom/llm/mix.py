"""Mixing sources to target weights, by weighted sampling without replacement.

A source's part of the total is first filled with complete epochs; what is left of its budget is drawn
with exponential keys, -ln(u) / quality: sorted by key within the source, documents are taken while the
sum of their tokens stays nearest to the budget. The sort is spread over bins of the key, whose token
sums are added up first; bins below the budget are taken whole and only the bin that crosses it is sorted,
so no source is ever sorted in one task.

Without `total_tokens` the mixture is the largest in which every source that has text reaches its share
under its cap on repeats; shares of targets without any text are spread over the others in proportion.
With a larger total, capped sources give what they may and the shortfall is reported.

Defined results: null texts have no tokens; documents of sources without a target, or of no source, are
left out and reported with share 0; null or non-positive shares and caps count as 0; a document without
tokens is mixed only with its complete epochs; empty tables give empty mixtures; keys depend on doc_id and
the seed alone, so a repeated run draws the same.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from matchloom.session import keep, spread, table

#: Folder of the public tokenizers' vocabulary files, and the file used.
TOKENIZERS = os.environ.get("MATCHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a bin on average.
BIN_ROWS = 50_000
SEED = 7


@cache
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> Column:
    """Number of tokens of each whole text."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(vocabulary).encode_ordinary
        return texts.map(lambda t: len(encode(t)), na_action="ignore").fillna(0).astype("int64")

    return count(text)


def quality(text: Column) -> Column:
    """Weight of a document in (0.05, 1]: the share of letters and blanks, less for texts of few words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    n_words = F.size(F.split(F.trim(text), r"\s+"))
    return F.coalesce(0.05 + 0.95 * letters * F.least(F.lit(1.0), n_words / 40.0), F.lit(0.05))


def exponential_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the hash of doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def budgets(stock: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, float]:
    """Tokens each source gives. stock: tokens by source; targets: source, share, cap on repeats."""
    wanted = {s: (share, cap) for s, share, cap in targets if share and share > 0 and cap and cap > 0 and stock.get(s, 0) > 0}
    whole = sum(share for share, _ in wanted.values())
    if not wanted:
        return {}
    if total_tokens is None:
        total_tokens = min(cap * stock[s] * whole / share for s, (share, cap) in wanted.items())
    return {s: min(float(cap * stock[s]), share / whole * total_tokens) for s, (share, cap) in wanted.items()}


def measured(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, draw, bin) of (doc_id, source, text): one pass over the texts, kept."""
    bins = max(1, documents.count() // BIN_ROWS)
    draw = exponential_key(F.col("doc_id"), F.col("quality"), seed)
    sized = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens"), quality(F.col("text")).alias("quality"))
    keyed = sized.select("doc_id", "source", "tokens", draw.alias("draw"))
    return keep(keyed.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("draw") / 2)) * bins), F.lit(bins - 1)).cast("int")), "tokens")


def mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the documents in the mixture. sized: `measured`."""
    spark = sized.sparkSession
    goals = [tuple(r) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").collect()]
    bins = keep(sized.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens")), "bins")
    stock = bins.where(F.col("source").isin([s for s, *_ in goals])).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    stock = {r["source"]: int(r["n"]) for r in stock}
    plan = [(s, int(b // stock[s]), float(b - (b // stock[s]) * stock[s])) for s, b in budgets(stock, goals, total_tokens).items()]
    part = spark.createDataFrame(plan, "source string, epochs int, rest double")
    below = F.sum("tokens").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    placed = bins.select("source", "bin", F.col("tokens").alias("bin_tokens"), F.coalesce(below, F.lit(0)).alias("before")).join(F.broadcast(part), "source")
    rows = sized.join(placed, ["source", "bin"])
    whole = F.col("before") + F.col("bin_tokens") <= F.col("rest")
    crossed = ~whole & (F.col("before") < F.col("rest"))
    order = Window.partitionBy("source", "bin").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("tokens").over(order) - F.col("tokens") / 2
    taken = [
        rows.where(~crossed).withColumn("drawn", whole & (F.col("rest") > 0) & (F.col("tokens") > 0)),
        rows.where(crossed).withColumn("drawn", (middle <= F.col("rest")) & (F.col("tokens") > 0)),
    ]
    repeats = F.col("epochs") + F.col("drawn").cast("int")
    return taken[0].unionByName(taken[1]).select("doc_id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(sized: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source on either side: target and actual share, tokens available and mixed, largest number of repeats."""
    available = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    out = available.join(targets.select("source", "target_share", "max_repeats"), "source", "full").join(used, "source", "left")
    zero = {"documents": 0, "available_tokens": 0, "target_share": 0.0, "mixed_tokens": 0, "most_repeats": 0}
    out = out.fillna(zero)
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    return out.select(*out.columns, F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0).alias("actual_share"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return measured(table(spark, sf_dir, "documents", "doc_id", "source", "text")), table(spark, sf_dir, "mix_targets")


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mixture with how often it is repeated."""
    return mixture(*_tables(spark, sf_dir))


def mixed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, per source."""
    sized, targets = _tables(spark, sf_dir)
    return shares(sized, targets, mixture(sized, targets))
