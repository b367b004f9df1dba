"""Crowds at a key of the near-copy stage, and sizes of what the driver holds."""

import random

import numpy as np
from pyspark.sql import functions as F

from helixtab.llm import near_text, pii, toxicity


def test_crowds_lose_no_link(spark, monkeypatch):
    """Far more texts at one key than CROWD, in pairs that are near copies of each other only."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(90)]
    near = [t + " end" for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + near)], "doc_id long, text string")
    monkeypatch.setattr(near_text, "_entries", lambda nodes: nodes.select("node", F.lit(2 * near_text.LANES << 32).cast("long").alias("k")))
    monkeypatch.setattr(near_text, "BLOCK", 50, raising=False)
    got = {r.doc_id: r.component_id for r in near_text.near_texts(docs).collect()}
    assert got == {i: i % 90 for i in range(180)}


def test_crowds_at_balls_of_one_bit(spark):
    """A pair is compared at the union of its texts' values alone, and so at one key for each segment at least."""
    rng = random.Random(5)
    rows = []
    for node in range(300):
        one = rng.choice([0, 1 << rng.randrange(31)])
        rows.append((node, rng.choice([3, 3 | 1 << rng.randrange(2, 31)]) | rng.getrandbits(20) << 32, one, 0, 0, *[node] * len(near_text._SAMPLED)))
    names = ["node", *near_text._FPS, *near_text._SAMPLED]
    nodes = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    entries = near_text._entries(nodes).where(F.col("k") < 1 << 32).collect()
    by_key = {}
    for r in entries:
        by_key.setdefault(r.k, []).append(r.node)
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(rows[a][1:5], rows[b][1:5]))
    want = {(a, b) for own in by_key.values() for a in own for b in own if a < b and apart(a, b) <= near_text.DISTANCE}
    crowds = spark.createDataFrame([(k, node, node, len(own)) for k, own in by_key.items() for node in own], "k long, node long, part long, n long")
    assert {(r.a, r.b) for r in near_text._crossed(crowds, nodes).collect()} == want and len(want) > 1000


def test_unseen_words_cost_little(monkeypatch):
    """A word's first characters are looked up once for all words that start with them, and what is found stays the same."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) for _ in range(60_000)]
    slots = np.unique([toxicity.slot(t, n) for w in words[::50] for t in toxicity.terms_of(w) for n in (1, 2)])
    place = {int(s): i for i, s in enumerate(slots)}
    hashed, digest = [], toxicity.xxhash.xxh32_intdigest
    monkeypatch.setattr(toxicity.xxhash, "xxh32_intdigest", lambda b: hashed.append(b) or digest(b))
    toxicity.Selected(slots).of(" ".join(words))
    assert len(hashed) == len(set(hashed)) and len(hashed) < 2 * len(set(words))
    for known in (place, None):
        find = toxicity.Selected(slots if known else None)
        for i in range(0, len(words), 6000):
            times = {}
            for w in words[i : i + 300]:
                for t in toxicity.terms_of(w):
                    times[t] = times.get(t, 0) + 1
            pairs = {toxicity.slot(t, n) for t, k in times.items() for n in toxicity.LEVELS if k >= n}
            assert find.of(" ".join(words[i : i + 300])) == sorted({known[s] for s in pairs if s in known} if known else pairs)


def test_pii_plans_are_small(spark):
    """No part of a match's expression is repeated in the next: the driver holds the plan in many copies."""
    docs = spark.createDataFrame([(1, "Mr. John Smith wrote to a.b@c.org from 10.1.2.3"), (2, "nothing")], "doc_id long, text string")
    done = pii.pseudonymise(docs, "key")
    assert len(done._jdf.queryExecution().optimizedPlan().toString()) < 150_000
    assert {r.doc_id: r.n_entities for r in done.collect()} == {1: 3, 2: 0}
