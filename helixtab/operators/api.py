"""One call for many pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtab.operators.ops import cigar
from helixtab.operators.relax import _kept
from helixtab.operators.shifts import equal_cost_ranges, with_ranges
from helixtab.operators.stats import alignment_stats, apply_cost_limit
from helixtab.operators.tables import align_with_switch, call_single_ts, gap_affine_align, gap_affine_cost
from helixtab.sources.costs import load_costs, of_set


class AlignJob:
    """Alignments of pairs under a cost set; giving both a set's name and a path is an error. Each pair may have one
    reverse switch whose inner part is error-free, unless no_ts is set; tie: of equally cheap ones the longest switch
    (maximise) or the first (none)."""

    def __init__(self, spark: SparkSession, cost_set: str | None = None, costs_path: str | None = None, no_ts: bool = False, tie: str = "maximise"):
        if cost_set and costs_path:
            raise ValueError("give cost_set or costs_path, not both")
        if tie not in ("maximise", "none"):
            raise ValueError("tie must be maximise or none")
        self.costs = of_set(load_costs(spark), cost_set or "bench") if not costs_path else load_costs(spark, costs_path)
        self.no_ts, self.tie = no_ts, tie

    def run(self, pairs: DataFrame, cost_limit: int | None = None) -> DataFrame:
        """pair_id, type, status, cost; pairs over the limit, and those without a finite cost, are WithoutTarget."""
        if self.no_ts:
            last = gap_affine_cost(pairs, self.costs)
        else:
            last = self.switches(pairs).select("pair_id", F.least("ts_cost", "no_ts_cost").alias("cost"))
        finite = F.col("cost").isNotNull()
        found = last.select("pair_id", F.when(finite, "WithTarget").otherwise("WithoutTarget").alias("type"), F.when(finite, "FoundTarget").otherwise("NoTarget").alias("status"), F.col("cost").cast("double").alias("cost"))
        return found if cost_limit is None else apply_cost_limit(found.where(finite), cost_limit).unionByName(found.where(~finite))

    def alignments(self, pairs: DataFrame) -> DataFrame:
        """Operation rows of an optimal alignment."""
        return gap_affine_align(pairs, self.costs) if self.no_ts else align_with_switch(pairs, self.costs, self.tie)

    def switches(self, pairs: DataFrame) -> DataFrame:
        """The cheapest single switch of each pair, beside the cost without one."""
        return call_single_ts(pairs, self.costs, tie=self.tie)

    def cigar(self, pairs: DataFrame) -> DataFrame:
        """CIGARs, with the ranges in which switches' ends can move at equal cost."""
        ops = self.alignments(pairs) if self.no_ts else _kept(self.alignments(pairs))
        return cigar(ops if self.no_ts else with_ranges(ops, equal_cost_ranges(ops, pairs, self.costs)))

    def stats(self, pairs: DataFrame) -> DataFrame:
        """Statistics of each pair's result and alignment."""
        return alignment_stats(self.alignments(pairs), self.run(pairs), pairs)


def align_pairs(pairs: DataFrame, **options) -> DataFrame:
    """AlignJob's options and run()'s in one call."""
    run = {k: options.pop(k) for k in ("cost_limit",) if k in options}
    return AlignJob(pairs.sparkSession, **options).run(pairs, **run)
