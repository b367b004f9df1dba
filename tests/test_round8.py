"""Findings of round 8: letters of documents are found once, and operations are followed pair by pair."""

from __future__ import annotations

import random

from helixtab import queries
from helixtab.operators import ops
from helixtab.sources.costs import load_costs, of_set
from tests.test_shifts import OPS, as_rows, some_alignment


def test_letters_are_found_once(spark):
    # each use of a sequence found the text's letters anew
    plan = queries.QUERIES["p4_embedded_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 3


def test_letters_anywhere_in_the_text(spark, tmp_path):
    texts = ["1" * 900 + "abcd" * 60, "abcd" * 49 + "!" * 300 + "abcd", "abcd" * 49 + "!" * 300 + "abc", "AbİK" * 80, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pair_id: r.r_seq for r in queries.pairs_of(spark, str(tmp_path)).collect()}
    assert got == {0: "ACGT" * 30, 1: "ACGT" * 30, 3: "ACAG" * 30}


def test_plans_of_costs_are_small(spark):
    # a pair's operations were followed by a window for each thing, and the driver kept all those plans
    for name, most in (("w5_alignment_cost", 150_000), ("t3_best_per_pair", 200_000), ("a1_alignment_stats", 100_000), ("w6_verify_ops", 80_000), ("w12_limit_context", 40_000)):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert len(plan) < most, (name, len(plan))


def test_columns_near_switches(spark):
    """As the columns, and the switches' points, one by one."""
    rng, rows, pairs = random.Random(12), [], []
    for i in range(80):
        r, q, units, at = some_alignment(rng, "RF")
        pairs.append((f"p{i}", r, q, *at))
        rows += as_rows(f"p{i}", units, r, q, dict(zip("RQ", at)))
    p = spark.createDataFrame([*pairs, ("none", "ACGT", "ACGT", 0, 0), ("null", None, "ACGT", 0, 0)], "pair_id string, r_seq string, q_seq string, r_start int, q_start int")
    o = spark.createDataFrame([*rows, ("null", 0, 2, "PrimaryMatch", *[None] * 5)], OPS).cache()
    columns, found = ops.gapped_columns(o, p).cache(), ops.switches(o, ops.starts_of(p)).cache()
    for z in (0, 3):
        want = sorted(map(str, ops.limit_context(columns, found, z).collect()))
        assert sorted(map(str, ops.columns_near_switches(o, p, z).collect())) == want
    assert len(want) > 100
    plain = ops.unit_bases(ops.flatten_ops(o), p).where("kind like 'Primary%'").select("pair_id", "r_before", "q_before", "c1", "c2", "kind").collect()
    bases = [(x.pair_id, x.r_before, x.q_before, "-" if x.kind.endswith("Insertion") else x.c1, "-" if x.kind.endswith("Deletion") else x.c2) for x in plain]
    assert sorted(map(str, bases)) == sorted(str((x.pair_id, x.r_before, x.q_before, x.r_base, x.q_base)) for x in columns.collect())


def test_places_outside_a_sequence_have_no_character(spark):
    """Odd operations: a switch that runs off the sequence's left end, no count, no pair, characters no table has."""
    p = spark.createDataFrame([(1, "ACGT", "ACTT"), (2, "Aé", "Aé"), (3, "", "")], "pair_id long, r_seq string, q_seq string")
    none = [None] * 5
    o = [(1, 0, 2, "PrimaryMatch", *none), (1, 1, 1, ops.ENTRANCE, -2, "Q", "R", "R", None), (1, 2, 2, "SecondaryMatch", *none), (1, 3, 1, ops.EXIT, *none[1:], 2)]
    o += [(2, 0, 2, "PrimaryMatch", *none), (3, 0, 0, "PrimaryMatch", *none), (4, 0, 1, "PrimaryMatch", *none)]
    o = spark.createDataFrame(o, OPS.replace("pair_id string", "pair_id long"))
    wrong = {(r.pair_id, r.op_idx, r.c1, r.c2) for r in ops.verify_ops(ops.flatten_ops(o.where("pair_id < 3")), p).collect()}
    assert wrong == {(1, 3, "", "T"), (1, 4, "", "T")}
    got = {r.pair_id: r.cost for r in ops.alignment_cost(o, p, of_set(load_costs(spark), "bench")).collect()}
    assert got == {1: None, 2: None}
