"""Crowds at a key of the near-copy stage return links, not pairs; half sweeps read half of the units."""

import random

import numpy as np
from pyspark.sql import functions as F

from helixtab.llm import brown, near_text


def test_crowds_return_no_more_than_their_links(spark, monkeypatch):
    """Texts whose fingerprints are near, but few of which are alike: what a task returns doesn't grow with their square."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        own = [w if rng.random() > 0.12 else f"x{rng.randrange(10**6)}" for w in base]
        texts += [" ".join(own), " ".join([*own, "end"]), " ".join([*own, "other", "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_text.shingle_set(t.encode().split(), near_text.WORDS) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near_text.alike(sets[a], sets[b]) and want[a] != want[b]:
                want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
    monkeypatch.setattr(near_text, "_entries", lambda nodes: nodes.select("node", F.lit(2 * near_text.LANES << 32).cast("long").alias("k")))
    monkeypatch.setattr(near_text, "BLOCK", 50)
    monkeypatch.setattr(near_text, "DISTANCE", 256)
    crossed, whole = [], near_text._crossed
    monkeypatch.setattr(near_text, "_crossed", lambda *a: crossed.append(whole(*a)) or crossed[-1])
    assert {r.doc_id: r.component_id for r in near_text.near_texts(docs).collect()} == dict(enumerate(want))
    assert len(set(want)) > 50 and crossed[0].count() < 4 * len(texts)


def test_half_sweeps_read_their_half(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(40)}" for _ in range(50))) for i in range(40)], "doc_id long, text string")
    bigrams = brown.unit_bigrams(docs, np.sort(np.array([brown.xxhash.xxh64_intdigest(f"w{i}".encode()) for i in range(40)], np.uint64)))
    near = brown.written(brown._neighbours(bigrams), "near", "odd")
    assert all("odd=1" in f for f in near.where("odd = 1").select("unit", F.input_file_name().alias("f")).toPandas()["f"])
    rows = bigrams.collect()
    n_units = 1 + brown.TAIL + 40
    classes = np.arange(n_units) % 5
    want = np.zeros((5, 5))
    for r in rows:
        want[classes[r.a], classes[r.b]] += r.n
    assert (brown._class_bigrams(near, classes, 5) == want).all()
    count = np.zeros(n_units, np.int64)
    for r in rows:
        count[r.b] += r.n
    found = brown.exchange(near, count, 5, 2)
    # by hand, with all units looked at in each half sweep
    rank = np.empty(n_units, np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(n_units)
    now = np.where(rank < 2, 1 + rank % 4, 1 + (np.arange(n_units) * 2654435761 % 4294967296 >> 7) % 4)
    now[0] = 0
    for half in range(4):
        pair, right, left = np.full((5, 5), 0.1), np.zeros((n_units, 5)), np.zeros((n_units, 5))
        for r in rows:
            pair[now[r.a], now[r.b]] += r.n
            right[r.a, now[r.b]] += r.n
            left[r.b, now[r.a]] += r.n
        after = np.log(pair / pair.sum(1, keepdims=True))
        gain = right @ after.T + left @ after - left.sum(1, keepdims=True) * np.log(np.bincount(now, count, 5) + 0.1)
        gain[:, 0] = -np.inf
        moves = np.unique([r.a for r in rows])
        moves = moves[(moves % 2 == half % 2) & (moves > 0)]
        now[moves] = gain.argmax(1)[moves]
    assert (found == now).all()
