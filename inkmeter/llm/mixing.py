"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets weight p^a / Σ p^a. The exponent a is searched so that the mix reaches a
target entropy, or no source is repeated more often than a limit; the larger exponent, the more cautious,
holds. Each source's token budget is then spent epoch by epoch on a permutation of its documents: blocks
in random order, documents in random order within a block. Whole epochs need no order, and of the last,
partial one only the block in which the budget ends is sorted, so a hot source never meets in one task.
What the documents meet is one rule a source: its epochs, and the place in its order where the budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, load, stage, text_or_empty, whole_row

#: Rows of a block, about; beyond MOST_BLOCKS blocks they grow instead.
BLOCK_ROWS = 4_096
MOST_BLOCKS = 1 << 20
SEED = 7
#: Entropy of the mix as a part of the largest possible, and epochs of the most repeated source, at most.
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0
_GRID = 32
_PASSES = 6


@dataclass
class Mix:
    exponent: float
    norm: float
    budget: float


def tokens_of(text: str) -> Column:
    """White-space separated words of the whole text."""
    return F.regexp_count(text_or_empty(text), F.lit(r"\S+")).cast("long")


def _bisect(totals: DataFrame, value, target: float) -> float:
    """Least exponent in 0..1 at which ``value(exponent column)`` is at most ``target``; 1 if none.

    ``value`` falls as the exponent grows. Each pass tries a grid of exponents in one aggregation over the
    sources, which divides the interval by the grid's size.
    """
    low, high = 0.0, 1.0
    for _ in range(_PASSES):
        grid = [low + (high - low) * i / _GRID for i in range(_GRID + 1)]
        found = totals.agg(*[value(a).alias(f"v{i}") for i, a in enumerate(grid)]).first()
        at = next((i for i, v in enumerate(found) if v is not None and v <= target), _GRID)
        if at == 0:
            return grid[0]
        low, high = grid[at - 1], grid[at]
    return high


def solve(totals: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> Mix:
    """The mix over ``(source, tokens)``. ``budget`` None: as much as lets every document appear at least once."""
    n, whole = totals.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return Mix(1.0, 1.0, 0.0)
    p = F.col("tokens") / F.lit(float(whole))

    def entropy(a: float) -> Column:
        z = F.sum(F.pow(p, F.lit(a)))
        return F.log(z) - F.lit(a) * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / z

    def repeats(a: float) -> Column:
        epochs = F.pow(p, F.lit(a - 1))  # up to the factor budget / (whole · z)
        most = F.max(epochs)
        return most / F.min(epochs) if budget is None else most * F.lit(budget / whole) / F.sum(F.pow(p, F.lit(a)))

    exponent = 0.0
    if target_entropy is not None:
        exponent = max(exponent, _bisect(totals, entropy, target_entropy * math.log(n)))
    if max_repeats is not None:
        exponent = max(exponent, _bisect(totals, repeats, max_repeats))
    z, most = totals.agg(F.sum(F.pow(p, F.lit(exponent))), F.max(F.pow(p, F.lit(1 - exponent)))).first()
    return Mix(exponent, z * whole**exponent, float(whole) * z * most if budget is None else float(budget))


def _placed(docs: DataFrame, budget_share: float | None = 1.0, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(row, tokens, weight, copies)`` of every row of ``docs``.

    ``budget_share`` times the corpus' tokens are spent; None spends as much as lets every document
    appear at least once. Null sources are one source, null texts have no tokens, a source without any
    token gets weight 0 and one copy of each document if the budget is None, else none. Rows that
    repeat an id share their fate. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    place = F.xxhash64(F.lit(seed), F.col(id_col))
    slim = stage(docs.select(source.alias("source"), F.col(id_col).cast("long").alias("id"), place.alias("place"), tokens_of(text_col).alias("tokens")), "source-tokens")
    n_blocks = min(MOST_BLOCKS, max(1, math.ceil(slim.count() / block_rows)))
    block = lambda c: F.pmod(F.shiftright(c, 8), F.lit(n_blocks))
    slim = slim.withColumn("block", block(F.col("place")))
    blocks = stage(slim.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    totals = stage(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    mix = solve(totals.filter("tokens > 0"), None if budget_share is None else budget_share * whole, target_entropy, max_repeats)
    least = 1 if budget_share is None else 0
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(mix.exponent)) / F.lit(mix.norm)).otherwise(0.0)
    budgets = totals.withColumn("weight", share).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.greatest(F.lit(least), F.floor(F.col("weight") * mix.budget / F.col("tokens") + 1e-9))).otherwise(least)
    ).withColumn("rest", F.greatest(F.lit(0.0), F.floor(F.col("weight") * mix.budget + 1e-6) - F.col("epochs") * F.col("tokens"))).select("source", "weight", "epochs", "rest")
    turn_of = lambda source, epochs, block: F.xxhash64(F.lit(seed), source, epochs, block)
    ordered = blocks.join(budgets, "source").withColumn("turn", turn_of(F.col("source"), F.col("epochs"), F.col("block")))
    end = F.sum("tokens").over(W.partitionBy("source").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, 0))
    placed = ordered.withColumn("end", end).withColumn("start", F.col("end") - F.col("tokens"))
    cut = stage(placed.filter("rest > 0 AND start <= rest AND rest < end").select("source", "block", "turn", "start", "rest"), "mix-cuts")  # one block a source
    running = F.sum("tokens").over(W.partitionBy("source", "block").orderBy("place", "id"))  # a range frame: equal ids together
    last = slim.join(broadcast_if_small(cut), ["source", "block"]).withColumn("upto", F.col("start") + running).filter("upto <= rest").groupBy("source").agg(
        F.max(F.struct("place", "id")).alias("last"))
    rules = budgets.join(cut.select("source", "turn", "block"), "source", "left").join(last, "source", "left")
    rules = stage(rules.select(F.col("source").alias("of"), F.struct("weight", "epochs", "turn", "block", "last").alias("rule")), "mix-rules")
    id_ = F.col(id_col).cast("long")
    own = docs.select(whole_row(docs).alias("row"), F.struct(source.alias("source"), id_.alias("id"), block(place).alias("block"), place.alias("place"), tokens_of(text_col).alias("tokens")).alias("own"))
    joined = own.join(broadcast_if_small(rules), F.col("own.source") == F.col("of"))
    rule, mine = (lambda c: F.col(f"rule.{c}")), (lambda c: F.col(f"own.{c}"))
    turn = turn_of(mine("source"), rule("epochs"), mine("block"))
    at_cut = (turn == rule("turn")) & (mine("block") == rule("block"))
    before = (turn < rule("turn")) | ((turn == rule("turn")) & (mine("block") < rule("block")))
    within = at_cut & (F.struct(mine("place").alias("place"), mine("id").alias("id")) <= rule("last"))
    extra = F.coalesce(before | within, F.lit(False)).cast("long")
    return joined.select("row", mine("tokens").alias("tokens"), rule("weight").alias("weight"), (rule("epochs") + extra).cast("long").alias("copies"))


def copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``_tokens``, ``_weight`` (of its source) and ``_copies`` added; columns of these names are replaced.

    Takes the settings of ``mix``.
    """
    added = {"_tokens": "tokens", "_weight": "weight", "_copies": "copies"}
    return _placed(docs, **how).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *[F.col(c).alias(name) for name, c in added.items()])


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix wants it; the columns stay, whatever their names."""
    placed = _placed(docs, **how).filter("copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(load(spark, sf_dir, "documents")).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("_tokens").alias("tokens"), F.round("_weight", 9).alias("weight"), F.col("_copies").alias("copies"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLE_SQL: dict[str, str] = {}
