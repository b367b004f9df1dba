"""Exact top-k inner products by MaxScore over postings of integer vectors.

A term is a dimension; its postings hold every vector's value there. For a query, values are shifted so that
contributions are never negative, which gives each term a score bound. Terms in the order of their bounds: the
longest run of small ones whose bounds together stay under the k-th best score so far is non-essential. The
essential postings are traversed; vectors that can still compete are probed in the others, largest bound first.

The k-th best score so far is there from the start: that over a bounded sample of rows, which the driver scores before
the tasks begin. It only says what can be passed over; every row is searched.

Nulls: vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Vectors
shorter than the longest have no postings (zeros) in the terms they lack. Repeated ids: as a query the vector of the
first in order; candidates are rows, each row of another id is one. Ties go to smaller ids. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtab.llm.shared import fresh, written

#: Queries that go to the tasks at once, rows of one posting block, and rows that the first thresholds come from.
QUERY_BLOCK, ROW_BLOCK, SEED_ROWS = 4096, 8192, 4096
_OUT = "query_id long, vec_id long, score long"


def _merge(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate((best[0], ids)), np.concatenate((best[1], scores))
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def search_block(q: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Updates a query's best (ids, scores) with a block. postings: a row for each term; low, high: the least and
    largest value in each; least: a score that k rows are known to reach."""
    size = np.abs(q)
    floor = np.where(q >= 0, q * low, q * high)  # the least contribution of each term
    bound = np.where(q >= 0, q * high, q * low) - floor
    order = np.argsort(-bound, kind="stable")
    order = order[size[order] > 0]
    offset = int(floor.sum())
    rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))  # what terms from here on can add
    known = [x for x in (best[1][-1] if len(best[1]) == k else None, least) if x is not None]
    need = max(known) - offset if known else -1
    first = int(np.searchsorted(-rest, -need, side="left")) if need >= 0 else len(order)
    # from `first` on, the terms together stay under the need: non-essential
    essential = order[:first]
    acc = q[essential].astype(np.float64) @ postings[essential].astype(np.float64) if len(essential) else np.zeros(len(ids))
    part = acc.astype(np.int64) - int(floor[essential].sum())
    alive = np.flatnonzero((part + rest[first] >= need) & (ids != own)) if need >= 0 else np.flatnonzero(ids != own)
    part = part[alive]
    for n, t in enumerate(order[first:], first):
        if not len(alive):
            break
        part = part + q[t] * postings[t, alive].astype(np.int64) - floor[t]
        stay = part + rest[n + 1] >= need
        if not stay.all():
            alive, part = alive[stay], part[stay]
    return _merge(best, ids[alive], part + offset, k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of floor(scale * x) vectors.

    Every task builds postings over blocks of its rows, runs a block of queries on them and returns k rows for each
    query; those are merged by query and written before the next block of queries begins. A block is about QUERY_BLOCK
    queries, a bounded broadcast; all rows are read once for each.
    """
    spark = vectors.sparkSession
    whole = vectors.where(f"{id_col} is not null and {vec_col} is not null").select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    whole = whole.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    dim = whole.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    scaled = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = whole.select("id", F.when(F.size("v") == dim, scaled).otherwise(F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), dim - F.size("v")))).alias("v"), "asks")
    asked = written(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")), "queries")
    seeds = _arrays(rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SEED_ROWS), dim)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    folder = fresh(spark, "topk")
    for i in range(blocks):
        _block(rows.select("id", "v"), _arrays(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), dim), seeds, k).write.parquet(f"{folder}/{i}")
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(f"{folder}/*")


def _arrays(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded number of rows."""
    got = rows.toArrow()
    return got["id"].to_numpy(), got["v"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, dim)


def first_thresholds(qids: np.ndarray, q: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int) -> list[int | None]:
    """For each query, the k-th best score among the seeds of other ids; None if there are fewer."""
    found: list[int | None] = []
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ seeds[1].T
        for own, s in zip(qids[at : at + 256], scores):
            s = s[seeds[0] != own]
            found.append(int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None)
    return found


def _block(rows: DataFrame, asked: tuple[np.ndarray, np.ndarray], seeds: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((*asked, first_thresholds(*asked, seeds, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, least = sent.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(qids)
        for b in batches:
            for at in range(0, b.num_rows, ROW_BLOCK):
                part = b.slice(at, ROW_BLOCK)
                ids = part.column(0).to_numpy()
                postings = np.ascontiguousarray(part.column(1).flatten().to_numpy().reshape(len(ids), -1).T)
                low, high = postings.min(1, initial=0), postings.max(1, initial=0)
                for i in range(len(qids)):
                    best[i] = search_block(q[i], qids[i], ids, postings, low, high, best[i], k, least[i])
        n = [len(x[0]) for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate([x[0] for x in best] or [none])), pa.array(np.concatenate([x[1] for x in best] or [none]))], ["query_id", "vec_id", "score"])

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.mapInArrow(run, _OUT).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
