"""Speed and bounds of steps that many pairs go through, and edges in one pass against those by joins."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from helixtab import queries
from helixtab.functions import seq
from helixtab.operators import anchors, chains, edges, tables
from helixtab.sources.costs import load_costs, of_set


def near_pairs(n, length, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ACGT", k=length)) for _ in range(n)]
    return texts, [t[:20] + rng.choice("ACGT") + t[22:60] + "GT" + t[60:] for t in texts]


def test_many_pairs_in_little_time(spark):
    """Rows of all pairs of a part are one vector that fits a core's cache."""
    c = tables.Costs.of(of_set(load_costs(spark), "bench"))
    a, b = near_pairs(4_000, 100)
    began = time.process_time()
    costs = [x for x, _ in tables.solve(a, b, c)]
    assert time.process_time() - began < 3 and max(costs) < 30
    # costs that don't fit four bytes
    c.subst, c.open, c.extend = (np.where(v < tables.INFINITE, v << 26, v) for v in (c.subst, c.open, c.extend))
    assert [x for x, _ in tables.solve(a[:50], b[:50], c)] == [x << 26 for x in costs[:50]]


def test_edges_in_one_pass(spark):
    """The same as by joins of anchors, without a shuffle, for focus ranges and repetitive pairs, too."""
    rng, texts = random.Random(2), [("", "ACGTACGT"), (None, "ACGT"), ("A" * 40, "T" * 15 + "A" * 20)]
    for n in (30, 60, 90):
        a = "".join(rng.choices("ACGT", k=n))
        texts += [(a, a[: n // 2] + a[:12].translate(str.maketrans("ACGT", "TGCA"))[::-1] + a[n // 2 :]), ("ACGT" * (n // 4), a + "TTAA" * 4)]
    rows = [(f"p{i}", r, q, *((2, len(r) - 1, 1, len(q)) if i % 2 and r and q else (None,) * 4)) for i, (r, q) in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "pair_id string, r_seq string, q_seq string, r_start int, r_limit int, q_start int, q_limit int").cache()
    base, k, gap = of_set(load_costs(spark), "bench")["base_cost"], 4, 3
    own = anchors.all_anchors(pairs, k).cache()
    joined = {"primary": edges.primary_edges(own, k, gap), "secondary": edges.secondary_edges(own, k, gap), "jump12": edges.jump12_edges(own, k, base, gap), "jump34": edges.jump34_edges(own, k, gap), "terminal": edges.terminal_edges(own, pairs.where("r_seq is not null"), k, base, 20)}
    for part, want in joined.items():
        got = edges.pair_edges(pairs, k, gap, (part,), base, known=20)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() > 0
    got = edges.pair_edges(pairs, k, gap, ("primary",), top=2)
    assert sorted(got.collect()) == sorted(edges.top_successors(joined["primary"], 2).select(got.columns).collect())
    want = edges.block_edges(anchors.block_seeds(pairs, 7)[0], 9)
    assert sorted(edges.pair_block_edges(pairs, 7, 9).select(want.columns).collect()) == sorted(want.collect())


def test_spans_that_cannot_matter(spark, monkeypatch):
    """Sequences about as long as the greatest span, with many inverted repeats that are near one another, are no error: no switch
    among them can be longer than the limit."""
    monkeypatch.setattr(chains, "MAX_FIRST", 50)
    rng = random.Random(5)
    r = "".join(rng.choices("ACGT", k=172)) + "A" * 20
    pairs = spark.createDataFrame([(1, r, r[:80] + "T" * 18 + r[98:])], "pair_id int, r_seq string, q_seq string")
    costs = of_set(load_costs(spark), "bench")
    got = chains.chain_pairs(pairs, costs, 10, ts=True).collect()
    assert got == chains.chain_pairs(pairs, costs, 10, ts=True, max_span=10_000).collect()
    assert anchors.pair_anchors(pairs, 10).groupBy("kind").count().agg(F.max("count")).first()[0] > 50


def test_pairs_are_dealt_out_in_parts_that_grow_no_larger(spark):
    """As many parts as the table needs, and no shuffle of a pair's rows after that."""
    rows = seq.dealt(spark.range(100).select(F.col("id").alias("pair_id")), 37)
    assert rows.rdd.getNumPartitions() == 37
    plan = queries.QUERIES["w1_flatten_ops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
