"""SimHash fingerprints, their links by multi-index hashing, and the groups the links form.

Nulls: a null text is empty, fingerprint zero. A null doc_id gets a fingerprint
and the group's smallest id, but never names a group (component_id is null if
no row of the group has an id). Repeated rows are rows like others. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import text_bytes, words, written

SEED = 42
#: Table keys under which more fingerprints lie go the other exact way, see links().
BUCKET = 64
_CHUNK = 1 << 16


def fingerprint(data: bytes, shingle: int) -> int:
    """SimHash of a text: bit b is set if over half of the shingles' XXH64 have it set."""
    w = words(data)
    if not w:
        return 0
    text = b" ".join(w)
    n = len(w) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row; words of the whole text, shingles with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints at `distance` or fewer differing bits, as edges that connect
    whatever is linked.

    Multi-index hashing with two 32-bit segments. If two fingerprints differ by at most d bits, either the upper
    segments differ by at most d//2 or the lower ones by at most d - d//2 - 1. So each fingerprint enumerates these
    two small Hamming balls, looks the keys up in the segment's table, and complete distances are verified.
    One bit is flipped from 0 to 1 only: of two keys one bit apart, the one with the 0 finds the other.

    A key under which more than BUCKET fingerprints lie (near copies in thousands) would give their square in
    candidates. All that meet at such a key go another exact way: a and b are at most 2 bits apart just when some
    point is within 1 bit of both, so each emits its 65 points, and those that share a point (65 at most) are
    chained. That way holds for distances up to 2; beyond it, such keys are verified pair by pair.
    """
    upper, lower = distance // 2, distance - distance // 2 - 1
    base = fps.select("fp").where("fp is not null").distinct()
    segments = [(0, F.shiftrightunsigned("fp", 32), upper), (1, F.col("fp").bitwiseAND(0xFFFFFFFF), lower)]

    def ball(key, radius):
        if radius <= 0:
            return F.array(key)
        flips = F.transform(F.array(*[F.lit(m).cast("long") for m in _masks(32, radius)]), lambda m: F.when((F.bit_count(m) != 1) | (key.bitwiseAND(m) == 0), key.bitwiseXOR(m)))
        return F.filter(flips, lambda k: k.isNotNull())

    table = base.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), k.alias("key")) for s, k, _ in segments])).alias("x")).select("fp", "x.seg", "x.key")

    def tagged(seg, keys):
        return F.transform(keys, lambda k: F.struct(F.lit(seg).alias("seg"), k.alias("key")))

    probe = base.select("fp", F.explode(F.concat(*[tagged(s, ball(k, r)) for s, k, r in segments])).alias("x")).select("fp", "x.seg", "x.key")
    size = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    met = written(probe.join(size, ["seg", "key"]).where("n > 1 or key != if(seg = 0, shiftrightunsigned(fp, 32), fp & 4294967295L)"), "simhash-met")
    hot = met.where(F.col("n") > BUCKET) if distance <= 2 else met.limit(0)
    pairs = (
        (met.where(F.col("n") <= BUCKET) if distance <= 2 else met)
        .select("seg", "key", F.col("fp").alias("a"))
        .join(table.withColumnRenamed("fp", "b"), ["seg", "key"])
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    around = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in _masks(64, 1)])
    members = hot.select("fp").union(hot.select("seg", "key").distinct().join(table, ["seg", "key"]).select("fp")).distinct()
    shared = members.select("fp", F.explode(around).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point")).groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("near")).where(F.size("near") > 1)
    chained = shared.select(F.col("near")[0].alias("a"), F.explode("near").alias("b")).where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(chained).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternating large and small stars: each round is two aggregations and joins on edge tables, written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = written(large.join(small, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct(), "cc")
    return spark.createDataFrame([], "node long, root long") if not before else now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, its own included) of every row."""
    own = written(fingerprints(docs, shingle), "simhash-fp")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = components(links(own, distance))
    rooted = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """docs with one row for each group of near copies: that of the group's smallest doc_id. Of repeated rows with
    that id one stays. Rows without an id stay as they are."""
    groups = near_groups(docs, shingle, distance)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.where("doc_id is null"))
