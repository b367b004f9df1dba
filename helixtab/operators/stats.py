"""Statistics of alignments, summaries of them, and comparisons with and without template switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = ["cost", "cost_per_base", "duration_seconds", "opened_nodes", "closed_nodes", "suboptimal_opened_nodes", "suboptimal_opened_nodes_ratio", "template_switch_amount", "runtime", "memory"]


def alignment_stats(ops: DataFrame, costs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: type, status, cost, cost per base of the whole sequences, number of template switches, offsets."""
    n = ops.groupBy("pair_id").agg(F.count_if(F.col("kind") == "TemplateSwitchExit").cast("double").alias("template_switch_amount"))
    have = set(pairs.columns)
    offset = lambda s: (F.coalesce(F.col(f"{s}_start"), F.lit(0)) if f"{s}_start" in have else F.lit(0)).cast("int")
    own = pairs.select("pair_id", (F.length("r_seq") + F.length("q_seq")).alias("_n"), offset("r").alias("reference_offset"), offset("q").alias("query_offset"))
    rows = own.join(costs.select("pair_id", F.col("cost").cast("double")), "pair_id", "left").join(n, "pair_id", "left")
    found = F.col("cost").isNotNull()
    return rows.select("pair_id", F.when(found, "WithTarget").otherwise("WithoutTarget").alias("type"), F.when(found, "FoundTarget").otherwise("NoTarget").alias("status"), "cost", (2 * F.col("cost") / F.nullif("_n", F.lit(0))).alias("cost_per_base"), F.coalesce("template_switch_amount", F.lit(0.0)).alias("template_switch_amount"), "reference_offset", "query_offset")


def summarise(results: DataFrame, by: tuple[str, ...] = (), numbers: list[str] | None = None) -> DataFrame:
    """min, max, sum and mean of each number."""
    own = numbers or [c for c in NUMBERS if c in results.columns]
    return results.groupBy(*by).agg(*[f(c).alias(f"{c}_{name}") for c in own for name, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("mean", F.avg))])


def summarise_percentile(results: DataFrame, p: float, by: tuple[str, ...] = (), numbers: list[str] | None = None, ranges: int = 256) -> DataFrame:
    """Of each number the element at floor(p * n) of its sorted values, the last if p is 1. Nulls don't count; NaN is the
    largest; a null group is a group; a number without values is null, a group without any is left out.

    Equal values are combined first. A group's distinct values are cut into `ranges` of about as many by a sketch of their
    quantiles; counts of ranges tell exactly which one holds the element, and only that one is sorted. So a task gets
    about one in `ranges` of a group's distinct values, however large it is, and the sketch can't change the result."""
    own = numbers or [c for c in NUMBERS if c in results.columns]
    number = F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("v")) for c in own]))
    long = results.select(F.struct(*by).alias("key") if by else F.lit(0).alias("key"), number.alias("x")).select(F.struct("key", "x._name").alias("g"), "x.v").where("v is not null")
    counts = long.groupBy("g", "v").agg(F.count("*").alias("n"))
    cuts = counts.groupBy("g").agg(F.percentile_approx("v", [i / ranges for i in range(ranges)]).alias("cuts"), F.sum("n").alias("total"))
    placed = counts.join(cuts, "g").select("g", "v", "n", "total", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    at = F.least(F.floor(F.lit(p) * F.col("total")), F.col("total") - 1)

    def holding(rows: DataFrame, order: str, before: Column) -> DataFrame:
        upto = rows.withColumn("upto", before + F.sum("n").over(Window.partitionBy("g").orderBy(order)))
        return upto.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at))

    parts = holding(placed.groupBy("g", "part").agg(F.sum("n").alias("n"), F.first("total").alias("total")), "part", F.lit(0)).select("g", "part", (F.col("upto") - F.col("n")).alias("before"))
    hit = holding(placed.join(parts, ["g", "part"]), "v", F.col("before"))
    wide = hit.select("g.key", "g._name", "v").groupBy("key").pivot("_name", own).agg(F.first("v"))
    return wide.select(*(["key.*"] if by else []), *own)


def compare_no_ts(results: DataFrame, no_ts: DataFrame) -> DataFrame:
    """Per pair: cost, no_ts_cost, saving, cheaper (ts, no_ts, equal), and flags for what is missing."""
    a, b = results.select("pair_id", F.col("cost").alias("cost"), F.lit(True).alias("_a")), no_ts.select("pair_id", F.col("cost").alias("no_ts_cost"), F.lit(True).alias("_b"))
    rows = a.join(b, "pair_id", "full_outer")
    cheaper = F.when(F.col("cost") < F.col("no_ts_cost"), "ts").when(F.col("cost") > F.col("no_ts_cost"), "no_ts").when(F.col("cost") == F.col("no_ts_cost"), "equal")
    return rows.select("pair_id", "cost", "no_ts_cost", (F.col("no_ts_cost") - F.col("cost")).alias("saving"), cheaper.alias("cheaper"), F.col("_a").isNull().alias("ts_missing"), F.col("_b").isNull().alias("no_ts_missing"), (F.col("_b").isNotNull() & F.col("no_ts_cost").isNull()).alias("no_ts_without_target"))


def reject_impure(no_ts_ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations of pairs without a template switch, and those of pairs that have one."""
    bad = no_ts_ops.where("kind = 'TemplateSwitchEntrance'").select("pair_id").distinct()
    return no_ts_ops.join(bad, "pair_id", "left_anti"), no_ts_ops.join(bad, "pair_id", "left_semi")


def best_per_pair(cands: DataFrame, tie: str = "maximise", key: tuple[str, ...] = ("sp1_r", "sp1_q", "sp2", "p", "s")) -> DataFrame:
    """The cheapest candidate of each pair; of equal ones that with the longest template switches (maximise), then the
    first by the key."""
    order: list[Column] = [F.col("cost").asc_nulls_last()] + ([F.col("ts_length").desc()] if tie == "maximise" else [])
    by = Window.partitionBy("pair_id").orderBy(*order, *[c for c in key if c in cands.columns])
    return cands.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def apply_cost_limit(results: DataFrame, limit: int) -> DataFrame:
    """Results over the limit become WithoutTarget, with the limit as cost."""
    over = F.col("cost") > limit
    return results.withColumns({"type": F.when(over, "WithoutTarget").otherwise(F.col("type")), "status": F.when(over, "ExceededCostLimit").otherwise(F.col("status")), "cost": F.when(over, F.lit(float(limit))).otherwise(F.col("cost"))})
