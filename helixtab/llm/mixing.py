"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's repetition rate is what its target share of the mixture needs over what it has, both in characters. A
document's number of copies is a Poisson variable of that mean, got by inverting the distribution at a uniform number
that comes from a hash of its id, its text and the seed; so the same document gets the same number wherever and
whenever it is drawn. Copies are put into a global order by another hash, a uniform number too, so a copy's partition is
known from it: texts are shuffled once, without a sample of the keys before. Rows without an id are told apart by their texts.

Nulls: a null source is a source, a null text has no characters. Repeated rows get the same number of copies. A source
without characters, or without weight where weights are given, has rate zero. Empty tables give empty results; extra
columns are carried along, also such as `rate`; a column named copy or mix_key, which are added, is an error that says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import join_small, written

#: Rates over this are drawn as a sum of several, as the probability of no copy would be too small for a double.
CHUNK = 500


def uniform(seed: int, salt: str, *columns: str, more: Column | None = None) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the columns (and of more, if it is given)."""
    text = F.concat_ws("|", F.concat(F.lit(f"{seed}:{salt}"), F.lit("") if more is None else more), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column, most: int) -> Column:
    """The smallest k whose cumulated probability is over u; `most` is where the tail of the largest rate ends."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("below"), F.when(F.exp(-rate) > u, 0).alias("k"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["below"] + s["p"] * rate / k).alias("below"), F.coalesce(s["k"], F.when(s["below"] + s["p"] * rate / k > u, k)).alias("k"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["k"], F.lit(most))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """source, rate: for a mixture of budget times the characters there are, with the given shares (alike for all
    sources with text, if none are given)."""
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    if weights is None:
        shares = sizes.withColumn("weight", (F.col("chars") > 0).cast("double"))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        shares = sizes.join(given, "source", "left").withColumn("weight", F.when(F.col("chars") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    total = shares.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    return shares.crossJoin(F.broadcast(total)).select("source", F.coalesce(budget * F.col("all_chars") * F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight")) / F.when(F.col("chars") > 0, F.col("chars")), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """docs, each row as often as drawn, with copy (from 0) and mix_key; sorted by mix_key over all partitions, of
    which there are spark.sql.shuffle.partitions, if shuffle is set."""
    if {"copy", "mix_key"} & set(docs.columns):
        raise ValueError("docs has a column named copy or mix_key")
    rate = written(rates(docs, weights, budget).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate")), "mix-rates")
    top = rate.agg(F.max("_mix_rate")).first()[0] or 0.0
    largest = min(top, CHUNK)
    most = math.ceil(largest + 12 * math.sqrt(largest) + 24)
    # null-safe; the rates have a row for each source
    drawn = join_small(docs, rate, F.col("source").eqNullSafe(F.col("_mix_source")), "left").withColumn("_mix_text", F.md5(F.coalesce("text", F.lit(""))))
    rate_ = F.coalesce("_mix_rate", F.lit(0.0))
    if top > CHUNK:
        parts = F.greatest(F.ceil(rate_ / CHUNK).cast("int"), F.lit(1))
        part = lambda i: poisson(rate_ / parts, uniform(seed, "copies", "doc_id", "_mix_text", more=F.when(i > 1, F.concat(F.lit(":"), i.cast("string"))).otherwise("")), most)
        n = F.aggregate(F.transform(F.sequence(F.lit(1), parts), part), F.lit(0), lambda a, x: a + x)
    else:
        n = poisson(rate_, uniform(seed, "copies", "doc_id", "_mix_text"), most)
    copies = drawn.withColumn("_mix_n", n).where("_mix_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)))
    out = copies.withColumn("mix_key", uniform(seed, "order", "doc_id", "copy", "_mix_text")).select(*docs.columns, "copy", "mix_key")
    if not shuffle:
        return out
    places = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(places, F.floor(F.col("mix_key") * places).cast("int")).sortWithinPartitions("mix_key", "doc_id", "copy")
