"""Chains, switches and shared columns of many pairs at once."""

import random
import time

import numpy as np

from helixtab.operators import chains, columns, tables
from helixtab.operators.anchors import anchors_of
from helixtab.operators.api import AlignJob
from helixtab.sources.costs import load_costs, of_set


def near_pairs(rng, n, longest=190):
    out = []
    for _ in range(n):
        r = "".join(rng.choices("ACGT", k=rng.randrange(longest)))
        q = "".join(rng.choice(["", c + "T", "G"]) if rng.random() < 0.05 else c for c in r)
        out.append((r, q[: rng.randrange(1, len(q) + 2)] if rng.random() < 0.2 else q))
    return out


def test_plain_chains_are_the_chains():
    rng = random.Random(61)
    for k, costs in ((3, (2, 3, 1)), (10, (2, 3, 1)), (4, (4, 3, 2)), (2, (2, 2, 2))):
        gaps = chains.GapCosts(k, costs)
        pairs = near_pairs(rng, 120, 60 if k < 4 else 190) + [("", ""), ("A" * 40, "A" * 38), ("AC", "")]
        ranges = [(lo := rng.randrange(len(r) // 4 + 1), len(r), 0, max(len(q) - lo // 2, 0)) for r, q in pairs]
        found = [anchors_of(r, q, k, own, ("P",)) for (r, q), own in zip(pairs, ranges)]
        cost, links = chains.plain_chains([f["P"] for f in found], np.array(ranges), k, gaps)
        for i, (anchors, own) in enumerate(zip(found, ranges)):
            c = chains.Chain(anchors, own, k, gaps, None, None, {}, (0, 0))
            assert cost[i] == c.end
            assert [tuple(x.values()) for x in links[i].as_py()] == [(*x, c.end - c.cost_at(x)) for x in c.links()]


def test_plain_chains_in_little_time():
    rng = random.Random(62)
    pairs = [("".join(rng.choices("ACGT", k=190)),) * 2 for _ in range(2000)]
    ranges = np.array([(0, 190, 0, 190)] * len(pairs))
    found = [anchors_of(r, q, 10, (0, 190, 0, 190), ("P",))["P"] for r, q in pairs]
    began = time.process_time()
    cost, _ = chains.plain_chains(found, ranges, 10, chains.GapCosts(10, (2, 3, 1)))
    assert (cost == 0).all() and time.process_time() - began < 2


def test_shared_columns_move_no_bases(spark):
    """Bases are made after the last shuffle: no window or sort of the result's plan is over them."""
    r = "ACGT" * 30
    p = spark.createDataFrame([(f"{h}/{m}", h, r, r[: 20 * m] + "GG" * m + r[20 * m :]) for h in "ab" for m in range(3)], "pair_id string, hub_id string, r_seq string, q_seq string")
    found = columns.merge_columns(tables.gap_affine_align(p, of_set(load_costs(spark), "bench")), p)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 2
    text = {r.pair_id: r.text for r in columns.column_text(found.where("hub_id = 'a'")).collect()}
    assert text[None] == r[:20] + "--" + r[20:40] + "----" + r[40:] and text["a/1"] == r[:20] + "GG" + r[20:40] + "    " + r[40:]


def test_switches_are_searched_once(spark):
    rng = random.Random(63)
    rows = [(i, (r := "".join(rng.choices("ACGT", k=90))), r[:40] + r[10:28][::-1].translate(str.maketrans("ACGT", "TGCA")) + r[58:]) for i in range(6)]
    p = spark.createDataFrame(rows, "pair_id long, r_seq string, q_seq string")
    found = AlignJob(spark, "experiments").cigar(p)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("cigar like '%[TS%'").count() == 6
