"""Small crowds at a key return links, not pairs, too."""

import random

from pyspark.sql import functions as F

from helixtab.llm import near_text


def test_small_crowds_are_no_pairs(spark, monkeypatch):
    """Forty texts at a key, some alike: rows of pairs would be their square."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(30)]
    texts += [t + " end" for t in texts[5:15]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables, whole = {}, near_text.written
    monkeypatch.setattr(near_text, "written", lambda df, name, *parted: tables.setdefault(name, []).append(whole(df, name, *parted)) or tables[name][-1])
    monkeypatch.setattr(near_text, "_entries", lambda nodes: nodes.select("node", F.lit(2 * near_text.LANES << 32).cast("long").alias("k")))
    monkeypatch.setattr(near_text, "DISTANCE", 256)
    got = {r.doc_id: r.component_id for r in near_text.near_texts(docs).collect()}
    assert got == {i: i if i < 30 else i - 25 for i in range(40)}
    assert sum(t.count() for t in tables["near-pairs"]) < 2 * len(texts)
