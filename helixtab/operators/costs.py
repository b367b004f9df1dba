"""Lookups in cost tables, and summaries and checks of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The functions that must be V-shaped around zero.
V_SHAPED = ["RQQROffset", "RRQQOffset", "LengthDifference"]


def eval_step(df: DataFrame, x: str, step_fn: DataFrame, name: str, out: str) -> DataFrame:
    """df with the function's cost at x: that of the last breakpoint at or before x; NULL is infinite. Rows before the
    first breakpoint have no value and are an error when the plan runs."""
    own = F.broadcast(step_fn.where(F.col("name") == name).groupBy().agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "cost"))).alias("_fn")))
    hit = F.get(F.filter("_fn", lambda p: (p["lo"] <= F.col(x)) & (F.col(x) < p["hi"])), F.lit(0))
    value = F.when(F.col(x).isNull() | hit.isNotNull(), hit["cost"]).otherwise(F.raise_error(F.lit(f"{name} has no value there")).cast("bigint"))
    return df.join(own).withColumn(out, value).drop("_fn")


def eval_edit(df: DataFrame, subst: DataFrame, gaps: DataFrame, table: str) -> DataFrame:
    """df (kind M, I or D; c1, c2: reference and query character; first: first of its gap) with cost. I charges
    the query character, D the reference one."""
    s = F.broadcast(subst.where(F.col("tbl") == table).select("c1", "c2", F.col("cost").alias("_s")))
    g = F.broadcast(gaps.where(F.col("tbl") == table).select(F.col("c").alias("_c"), "open", "extend"))
    char = F.when(F.col("kind") == "I", F.col("c2")).when(F.col("kind") == "D", F.col("c1"))
    got = df.join(s, ["c1", "c2"], "left").join(g, char == F.col("_c"), "left")
    cost = F.when(F.col("kind").isin("I", "D"), F.when(F.col("first"), F.col("open")).otherwise(F.col("extend"))).otherwise(F.col("_s"))
    return got.withColumn("cost", cost).select(*df.columns, "cost")


def ts_costs(switches: DataFrame, base_cost: DataFrame, step_fn: DataFrame) -> DataFrame:
    """switches (p, s, dir, first_offset, length, gap) with base, offset, gap, length and difference costs and their
    sum (NULL if any is infinite)."""
    df = switches.join(F.broadcast(base_cost.withColumnRenamed("cost", "base_c")), ["p", "s", "dir"], "left")
    df = df.withColumn("_d", F.col("gap") - F.col("length"))
    for x, name, out in (("first_offset", "RRQQOffset", "_same"), ("first_offset", "RQQROffset", "_other"), ("gap", "ReverseAntiPrimaryGap", "_rev"), ("gap", "ForwardAntiPrimaryGap", "_fwd"), ("length", "Length", "length_c"), ("_d", "LengthDifference", "difference_c")):
        df = eval_step(df, x, step_fn, name, out)
    df = df.withColumn("offset_c", F.when(F.col("p") == F.col("s"), F.col("_same")).otherwise(F.col("_other"))).withColumn("gap_c", F.when(F.col("dir") == "R", F.col("_rev")).otherwise(F.col("_fwd")))
    parts = ["base_c", "offset_c", "gap_c", "length_c", "difference_c"]
    return df.withColumn("ts_cost", sum((F.col(c) for c in parts[1:]), F.col(parts[0]))).drop("_d", "_same", "_other", "_rev", "_fwd")


def cost_summary(subst: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per cost_set and table: least match, substitution, opening, extension and non-match cost, largest opening, and
    each kind's one value if it has only one. Infinite costs don't count as least; with one, there's no one value."""
    same = F.col("c1") == F.col("c2")
    one = lambda c, when: F.when(F.min(F.when(when, F.col(c))) == F.max(F.when(when, F.col(c))), F.min(F.when(when, F.col(c))))
    s = subst.groupBy("cost_set", "tbl").agg(F.min(F.when(same, F.col("cost"))).alias("min_match"), F.min(F.when(~same, F.col("cost"))).alias("min_subst"), one("cost", same).alias("one_match"), one("cost", ~same).alias("one_subst"))
    g = gaps.groupBy("cost_set", "tbl").agg(F.min("open").alias("min_open"), F.max("open").alias("max_open"), F.min("extend").alias("min_extend"), one("open", F.lit(True)).alias("one_open"), one("extend", F.lit(True)).alias("one_extend"))
    return s.join(g, ["cost_set", "tbl"]).withColumn("min_non_match", F.least("min_subst", "min_open", "min_extend"))


def check_step(step_fn: DataFrame) -> DataFrame:
    """cost_set, name, increasing (strictly), v_shaped (null where it isn't asked for): costs fall up to input 0 and
    rise after it, infinite being largest."""
    by = Window.partitionBy("cost_set", "name").orderBy("lo")
    cost = F.coalesce("cost", F.lit((1 << 62)))
    rows = step_fn.withColumn("next", F.lead("lo").over(by)).withColumn("c", cost).withColumn("before", F.lag(cost).over(by))
    fine = F.when(F.col("lo") <= 0, F.col("c") <= F.col("before")).otherwise(F.col("c") >= F.col("before"))
    out = rows.groupBy("cost_set", "name").agg(F.bool_and(F.coalesce(F.col("next") > F.col("lo"), F.lit(True))).alias("increasing"), F.bool_and(F.coalesce(fine, F.lit(True))).alias("v"))
    return out.select("cost_set", "name", "increasing", F.when(F.col("name").isin(V_SHAPED), F.col("v")).alias("v_shaped"))


def step_min(df: DataFrame, lo: str, hi: str, step_fn: DataFrame, name: str, out: str) -> DataFrame:
    """df with the least cost over [lo, hi)."""
    own = F.broadcast(step_fn.where(F.col("name") == name).groupBy().agg(F.collect_list(F.struct("lo", "hi", "cost")).alias("_fn")))
    inside = F.filter("_fn", lambda p: (p["lo"] < F.col(hi)) & (F.col(lo) < p["hi"]))
    return df.join(own).withColumn(out, F.array_min(F.transform(inside, lambda p: p["cost"]))).drop("_fn")


def step_domain(step_fn: DataFrame) -> DataFrame:
    """cost_set, name, first_finite, last_finite, zero_lo, zero_hi (the range of cost zero, null if there isn't one in
    one piece). first_finite of Length is the shortest template switch."""
    by = Window.partitionBy("cost_set", "name").orderBy("lo")
    rows = step_fn.withColumn("start", (F.col("cost") == 0) & ~F.coalesce(F.lag("cost").over(by) == 0, F.lit(False)))
    finite, zero = F.col("cost").isNotNull(), F.col("cost") == 0
    one = F.count_if("start") == 1
    return rows.groupBy("cost_set", "name").agg(F.min(F.when(finite, F.col("lo"))).alias("first_finite"), (F.max(F.when(finite, F.col("hi"))) - 1).alias("last_finite"), F.when(one, F.min(F.when(zero, F.col("lo")))).alias("zero_lo"), F.when(one, F.max(F.when(zero, F.col("hi")))).alias("zero_hi"))
