"""Mixing sources to target weights by temperature (operator 5); DataFrame functions only.

A source with the token share p gets the weight p**alpha / sum(p**alpha). alpha is bisected
until the weights have a target entropy, or until no source is repeated more often than a
limit. The weights become token budgets, and budgets become whole passes over a source's
blocks plus a last pass over as many blocks of its permutation as fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only_read, written

WORD = r"[^\x20\x09-\x0D]+"
#: Levels of bisection; BATCH of them share one job, which tries all their 2**BATCH - 1 midpoints.
LEVELS, BATCH = 40, 4
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Temperature:
    alpha: float
    entropy: float
    repeats: float


def _try(shares: DataFrame, alphas: list[float], budget: float | None, total: int) -> dict[float, Temperature]:
    """Entropy (nats) and most passes over a source for each alpha; shares: (log_share) per source."""
    x, a = F.col("log_share"), F.col("alpha")
    rows = (
        shares.select("log_share", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
        .groupBy("alpha")
        .agg(F.sum(F.exp(a * x)).alias("z"), F.sum(F.exp(a * x) * x).alias("s"), F.max((a - 1) * x).alias("most"), F.min((a - 1) * x).alias("least"))
        .select("alpha", (F.log("z") - a * F.col("s") / F.col("z")).alias("entropy"), (F.exp(F.col("most") - F.col("least")) if budget is None else F.exp("most") / F.col("z") * (budget / total)).alias("repeats"))
        .collect()
    )
    return {r["alpha"]: Temperature(r["alpha"], r["entropy"], r["repeats"]) for r in rows}


def bisect(shares: DataFrame, total: int, target_entropy: float | None, max_repeats: float | None, budget: float | None = None) -> Temperature:
    """The exponent in [0, 1] that meets the target.

    Entropy falls as alpha grows: the result is the largest alpha whose weights still have
    target_entropy. Repeats fall too: it is the smallest alpha within max_repeats. If even
    the ends don't reach the target, the nearer end is taken.
    """
    edge = _try(shares, [0.0, 1.0], budget, total)
    high_enough = (lambda t: t.entropy < target_entropy) if target_entropy is not None else (lambda t: t.repeats <= max_repeats)
    if high_enough(edge[0.0]):
        return edge[0.0]
    if not high_enough(edge[1.0]):
        return edge[1.0]
    lo, hi, steps = 0.0, 1.0, 1 << BATCH
    known = edge[1.0]
    for _ in range(LEVELS // BATCH):
        grid = [lo + (hi - lo) * i / steps for i in range(1, steps)]
        tried = _try(shares, grid, budget, total)
        first = next((g for g in grid if high_enough(tried[g])), hi)
        known = tried.get(first, known)
        lo, hi = first - (hi - lo) / steps, first
    return known


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens (words) of every row; a null text has no tokens."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def source_weights(tokens: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 4.0, budget_tokens: int | None = None, block_tokens: int = 65_536) -> DataFrame:
    """source, tokens, share, alpha, weight, budget, whole (passes), rest (tokens of the last pass), blocks.

    Without budget_tokens the budget is the least that passes over every source once. A null
    source is a source like any other. One without tokens has weight 0 and one pass.
    """
    totals = materialize(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = totals.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(total)).alias("log_share"))
    if total == 0:
        found, z, budget = Temperature(1.0, 0.0, 1.0), 1.0, 0.0
    else:
        found = bisect(shares, total, target_entropy, max_repeats, budget_tokens)
        z, scale = shares.agg(F.sum(F.exp(found.alpha * F.col("log_share"))), F.max((1 - found.alpha) * F.col("log_share"))).first()
        # Passes are weight * budget / tokens = budget / total * exp((alpha - 1) * log_share) / z.
        budget = float(budget_tokens) if budget_tokens is not None else total * z * math.exp(scale)
    log_share = F.log(F.col("tokens") / F.lit(max(total, 1)))
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(found.alpha) * log_share) / F.lit(z)).otherwise(F.lit(0.0))
    planned = F.floor(F.col("weight") * F.lit(budget) + F.lit(1e-6)).cast("long")
    if budget_tokens is None:
        planned = F.greatest(planned, F.col("tokens"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(1)).cast("long")
    return (
        totals.withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
        .withColumn("alpha", F.lit(found.alpha))
        .withColumn("weight", weight)
        .withColumn("budget", planned)
        .withColumn("whole", whole)
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"))
    )


def _key(*parts: Column | str | int) -> Column:
    """60 bits of an MD5: the same number in any engine."""
    text = F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, int) else F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_repeats: float | None = 4.0, budget_tokens: int | None = None, block_tokens: int = 65_536, seed: int = 5) -> DataFrame:
    """The mixture: a row for each time that a document is read.

    doc_id, source, n_tokens, pass (from 0), block (of the source), block_key, doc_key, weight.
    Reading a pass by (block_key, block, doc_key, doc_id) is the permutation: blocks of
    about block_tokens tokens in an order drawn per pass, documents drawn within a block.
    With target_entropy (nats) or else max_repeats the exponent is bisected; budget_tokens
    None means that every document is read at least once (nothing is dropped), otherwise
    sources whose budget is below their size are cut at it, never above it.
    Nulls: a null source is one source, a null text has no tokens, a null id is one id.
    Repeated rows are read each; ties in an order go by doc_id, then n_tokens.
    """
    since = written()
    tokens = materialize(token_table(docs, id_col, text_col, source_col), "tokens")
    weights = materialize(source_weights(tokens, target_entropy, max_repeats, budget_tokens, block_tokens), "weights")
    only_read(tokens.select("source").union(weights.select("source")), since)
    side = weights.withColumnRenamed("source", "of")
    side = F.broadcast(side) if weights.count() <= BROADCAST_SOURCES else side
    placed = tokens.join(side, F.col("source").eqNullSafe(F.col("of")))
    placed = placed.withColumn("block", F.pmod(_key(seed, "doc_id"), F.col("blocks"))).select("doc_id", "source", "n_tokens", "block", "weight", "whole", "rest")

    every = placed.where("whole > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    cut = _last_pass(placed.where("rest > 0").withColumn("pass", F.col("whole")), seed)
    columns = ("doc_id", "source", "n_tokens", "pass", "block", "weight")
    return (
        every.select(*columns)
        .union(cut.select(*columns))
        .withColumn("block_key", _key(seed, "pass", "source", "block"))
        .withColumn("doc_key", _key(seed, "pass", "doc_id"))
        .select("doc_id", "source", "n_tokens", "pass", "block", "block_key", "doc_key", "weight")
    )


def _last_pass(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of the blocks that fit in `rest`, and of the first that doesn't those documents that fit.

    Running sums go over slices of a source (1024 at most), then over a slice's blocks, then
    over the documents of the one cut block: no window holds a whole source.
    """
    blocks = rows.groupBy("source", "block", "pass", "rest").agg(F.sum("n_tokens").alias("size")).withColumn("key", _key(seed, "pass", "source", "block"))
    blocks = blocks.withColumn("slice", F.shiftright("key", 50))
    slices = blocks.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).withColumnsRenamed({"source": "s_source", "slice": "s_slice"})
    within = Window.partitionBy("source", "slice").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("own_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    blocks = blocks.join(slices, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
    blocks = blocks.withColumn("left", F.col("rest") - F.col("slice_start") - F.col("own_start")).where("left > 0")
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "left", (F.col("left") >= F.col("size")).alias("all"))
    inside = rows.join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    running = Window.partitionBy("source", "block").orderBy("doc_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    partly = inside.where("not all").withColumn("doc_key", _key(seed, "pass", "doc_id")).withColumn("so_far", F.sum("n_tokens").over(running)).where("so_far <= left")
    return inside.where("all").drop("left", "all", "b_source", "b_block").unionByName(partly.drop("left", "all", "b_source", "b_block", "doc_key", "so_far"))
