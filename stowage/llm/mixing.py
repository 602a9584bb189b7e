"""Mixing sources to target weights by Pareto order sampling, on DataFrame functions alone.

A source's weight gives its target of words, at most ``most`` times its size; what it can't take is shared out among
the others again. Whole copies of all of a source's documents that fit below its target are certain. For the words
still missing, its documents are ranked by the odds of a random number over the odds of their inclusion, and taken in
that order until the words are used up; the last one gives only the words still missing, so the sample has exactly its
size.

No source's documents meet in one task: sizes are summed in cells of the random number, a source of n documents having
about sqrt(n) cells; sums over cells tell which cell the sample ends in, and only that cell is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import cut
from stowage.operators.ordered import sums_before

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all words, as a fraction
MOST = 2
BITS = 52
SALTS = 32


def random_number(seed: str, id_col: str, text_col: str) -> Column:
    """A number of 52 bits from the seed, the id and the text; the same in every run, wherever the row is."""
    parts = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source, null being one too.

    Weights go by the code points of the names, null last, and repeat. The targets have share[0] / share[1] of all words
    in sum, as far as ``most`` times every source's size allows. Sources are put in order by two range-partitioned
    passes, first by name for the weights, then by the size a unit of weight, in which those that stop come first.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    named = sums_before(sizes, [F.col("source").asc_nulls_last()], {"_place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("long")
    weighed = named.select("source", "source_size", weight.alias("_w"))
    whole = weighed.agg(F.sum(wide("source_size")).alias("n"), F.sum(wide("_w")).alias("w")).first()
    n, w = (F.lit(int(x or 0)).cast("decimal(38,0)") for x in whole)
    # In words times share[1], all of it whole numbers: a cap is most * share[1] * size, the total share[0] * n.
    cap, total = F.lit(most * share[1]) * wide("source_size"), F.lit(share[0]) * n
    common = math.lcm(*weights)
    filled = sums_before(weighed, [wide("source_size") * F.expr(f"{common} div _w"), F.col("source").asc_nulls_last()], {"_caps": cap, "_ws": wide("_w")})
    stops = cap * (w - F.col("_ws")) <= wide("_w") * (total - F.col("_caps"))
    marked = cut(filled.select("source", "source_size", "_w", stops.alias("_stops")))
    stopped = marked.where("_stops").agg(F.sum(cap).alias("c"), F.sum(wide("_w")).alias("w")).first()
    c, rest = int(stopped["c"] or 0), int(whole["w"] or 0) - int(stopped["w"] or 0)
    left = share[0] * int(whole["n"] or 0) - c
    level = (F.col("_w") * F.lit(left).cast("decimal(38,0)")).cast("double") / F.lit(max(rest, 1) * share[1]).cast("decimal(38,0)").cast("double")
    return marked.select("source", "source_size", F.when(F.col("_stops"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): a row for each document, ``taken`` words of it in the mix.

    A null text has no words; null sources are one source; null and repeated ids pass through. A source's ``taken`` sum
    to its target, rounded to a whole word. No document is taken more than ``most`` times. Rows equal in id and text
    share their random number and differ only in which of them comes first. An empty table gives no rows. Documents
    travel without their texts: id, source, size and random number.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), random_number(seed, id_col, text_col).alias("u")))
    grown = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(grown.select("source", "source_size"), weights, share, most)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr("least_goal div source_size")).otherwise(0)
    plan = targets.alias("t").join(grown.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("least_goal", goal)
    plan = plan.withColumn("copies", copies).withColumn("missing", F.col("least_goal") - F.col("copies") * F.col("source_size")).withColumn("cells", F.ceil(F.sqrt("n")).cast("long"))
    plan = cut(plan.select("source", "source_size", "target", "copies", "missing", "cells"))
    # The random number is the salt of a source that many documents share; its plan is repeated for each salt.
    salt = F.pmod(F.col("u"), F.lit(SALTS))
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_s")
    rows = slim.withColumn("_k", salt).join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_salt"))).drop("_s", "_k", "_salt")
    u = (F.col("u") + 0.5) / F.lit(float(1 << BITS))
    inclusion = F.col("missing") / F.col("source_size")
    odds = lambda p: p / (1 - p)
    # Documents of a source have one inclusion, so their rank rises with the random number, and cells cut that evenly.
    rows = rows.withColumns({"cell": F.least(F.floor(u * F.col("cells")), F.col("cells") - 1), "rank": F.when(F.col("missing") > 0, odds(u) / odds(inclusion))})
    ranked = rows.where("missing > 0")
    cells = ranked.groupBy("source", "missing", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = cut(cells.where((F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing"))).select(F.col("source").alias("_s"), F.col("cell").alias("last_cell"), "before"))
    salted_last = last.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("_k", salt).join(salted_last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_salt")), "left").drop("_s", "_k", "_salt")
    edge = F.col("cell") == F.col("last_cell")
    here = Window.partitionBy("source").orderBy("rank", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = F.least(F.greatest(F.col("missing") - F.col("before") - F.coalesce(F.sum("size").over(here), F.lit(0)), F.lit(0)), F.col("size"))
    out = lambda sampled: ("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + sampled).alias("taken"))
    whole = placed.where(~F.coalesce(edge, F.lit(False))).select(*out(F.when(F.col("cell") < F.col("last_cell"), F.col("size")).otherwise(0)))
    return whole.unionByName(placed.where(edge).select(*out(within)))
