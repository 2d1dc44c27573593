"""Candidates for tables from the boxes of words: sweep lines over the projections of a page.

Boxes that overlap in height are one line, boxes of a line with less than a gap between them one
cell; consecutive lines of two cells or more are a band, one candidate of each strategy. All of
it is windows over a page's sorted boxes: where a box begins beyond everything before it, the
sweep line has met a gap. No two boxes are compared.

Strategies: 'gaps' takes as columns what the projection of all words of the band on the x axis
leaves apart; 'edges' takes the left edges of cells, those within `slack` of each other as one;
'head' takes the cells of the band's first line, each up to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.layout import best_strategy, table_measures

STRATEGIES = ("gaps", "edges", "head")


def _swept(rows: DataFrame, by: list[str], low: str, high: str, tie: list[str], gap: float, name: str) -> DataFrame:
    """rows with `name`: the number, from 1, of the run that a sweep along [low, high] finds them in; runs are `gap` apart."""
    own = Window.partitionBy(*by).orderBy(low, *tie)
    reach = F.max(high).over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col(low) >= reach + F.lit(gap))
    return rows.withColumn("_opens", opens.cast("int")).withColumn(name, F.sum("_opens").over(own)).drop("_opens")


def word_cells(words: DataFrame, gap: float) -> DataFrame:
    """page, line, cell and box of the cells of every line. words: page, n (unique in its page), x0, y0, x1, y1."""
    boxes = words.select("page", "n", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).where("page is not null and x0 <= x1 and y0 <= y1")
    lines = _swept(boxes, ["page"], "y0", "y1", ["n"], 0.0, "line")
    cells = _swept(lines, ["page", "line"], "x0", "x1", ["n"], gap, "cell")
    return cells.groupBy("page", "line", "cell").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def bands(cells: DataFrame, least_lines: int = 2) -> DataFrame:
    """cells of two or more in a line, in runs of least_lines such lines or more, with `band`: the run's first line."""
    counts = cells.groupBy("page", "line").agg(F.count(F.lit(1)).alias("_cells")).where("_cells > 1")
    own = Window.partitionBy("page").orderBy("line")
    runs = counts.withColumn("_run", F.col("line") - F.row_number().over(own))
    run = Window.partitionBy("page", "_run")
    runs = runs.withColumn("band", F.min("line").over(run)).withColumn("_lines", F.count(F.lit(1)).over(run)).where(F.col("_lines") >= least_lines)
    return cells.join(runs.select("page", "line", "band"), ["page", "line"])


def _columns(held: DataFrame, gap: float, slack: float) -> DataFrame:
    """page, band, strategy, column and its range [from_x, to_x)."""
    by = ["page", "band"]
    gaps = _swept(held, by, "x0", "x1", ["line", "cell"], gap, "k").groupBy(*by, "k").agg(F.min("x0").alias("from_x"))
    own = Window.partitionBy(*by).orderBy("x0", "line", "cell")
    apart = F.coalesce(F.col("x0") - F.lag("x0").over(own) > slack, F.lit(True)).cast("int")
    edges = held.withColumn("_apart", apart).withColumn("k", F.sum("_apart").over(own)).groupBy(*by, "k").agg(F.min("x0").alias("from_x"))
    head = held.where("line = band").select(*by, F.col("cell").alias("k"), F.col("x0").alias("from_x"))
    parts = [rows.select(*by, F.lit(name).alias("strategy"), "k", "from_x") for name, rows in zip(STRATEGIES, (gaps, edges, head), strict=True)]
    every = parts[0].union(parts[1]).union(parts[2])
    after = F.lead("from_x").over(Window.partitionBy(*by, "strategy").orderBy("from_x", "k"))
    return every.withColumn("to_x", after)


def table_candidates(words: DataFrame, gap: float = 8.0, slack: float = 3.0, least_lines: int = 2) -> DataFrame:
    """page, table_id, strategy, x0, y0, x1, y1, columns, unnamed: one candidate of each strategy for each band.

    table_id is the band's first line on its page. A column is unnamed if no cell of the first
    line begins in it; cells left of all columns belong to none. Boxes without a page, or turned
    inside out, are left out; equal boxes count once a line.
    """
    held = bands(word_cells(words, gap), least_lines)
    columns = _columns(held, gap, slack)
    box = held.groupBy("page", "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    first = held.where("line = band").groupBy("page", "band").agg(F.collect_set("x0").alias("_heads"))
    known = columns.join(first, ["page", "band"])
    named = F.exists("_heads", lambda x: (x >= F.col("from_x")) & (F.col("to_x").isNull() | (x < F.col("to_x"))))
    counts = known.groupBy("page", "band", "strategy").agg(F.count(F.lit(1)).alias("columns"), F.count(F.when(~named, 1)).alias("unnamed"))
    return counts.join(box, ["page", "band"]).select("page", F.col("band").alias("table_id"), "strategy", "x0", "y0", "x1", "y1", "columns", "unnamed")


def chosen_tables(words: DataFrame, running: Column, gap: float = 8.0, slack: float = 3.0, least_lines: int = 2) -> DataFrame:
    """The candidates of each page's best strategy, with what they cover, clip and swallow; running: whether a word is of a running line."""
    found = table_candidates(words, gap, slack, least_lines)
    measured = table_measures(found, words.withColumn("running", running), "page")
    best = best_strategy(measured, "page").select("page", "strategy")
    return measured.join(best, ["page", "strategy"])
