"""The near-copy stage's keys are moved once, by a sort that can spill."""

import random

from helixtab.llm import near_text


def test_keys_are_moved_once(spark, monkeypatch):
    """Nearly all keys are of one text, so an aggregation of them before the shuffle holds all and leaves as many."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"x{i // 2}"] if i < 40 else rng.sample(base, 30))) for i in range(80)], "doc_id long, text string")
    tables, whole = {}, near_text.written
    monkeypatch.setattr(near_text, "written", lambda df, name, *a: tables.setdefault(name, df) is None or whole(df, name, *a))
    near_text.near_texts(docs).collect()
    plan = tables["near-members"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Join" not in plan
    at: dict[int, set[int]] = {}
    for r in near_text._entries(tables["near-nodes"]).collect():
        at.setdefault(r.k, set()).add(r.node)
    want = {(k, node, min(nodes)) for k, nodes in at.items() if len(nodes) > 1 for node in nodes}
    assert want and sorted(tables["near-members"].select("k", "node", "leader").collect()) == sorted(want)
