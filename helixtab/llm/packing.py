"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised, end with an end id, and only longer ones than a sequence are cut, into pieces of full
length; the first piece holds what is left over and may be shorter. Full pieces fill sequences of their own.

The plan for the others is made on the number of pieces of each length, a table no longer than a sequence, so it is
the plan over all documents at once: a bin is filled greedily with the longest piece that still fits; then its
shortest piece is replaced with the two unpacked ones that fill the expanded gap best, if they fill it better. The
same bin is repeated as often as the counts allow. Pieces then find their places by their rank among the
pieces of their length, which is counted in salted slices, so that no length has to go through one task.

Nulls: a null text is empty, one end id. Rows with null or repeated ids are packed like any other. Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer


VOCABULARY = "byte_bpe_50k.json"
LENGTH, END_ID = 1024, 2
#: Slices of the pieces of one length that are ranked apart.
SLICES = 64


#: Where a text can't be cut at its spaces.
_RUNS = re.compile(r"\s\s|\A\s|\s\Z")
#: Parts whose ids a worker remembers.
PARTS = 600_000


class Encoder(dict):
    """text -> its ids as little-endian 32-bit numbers.

    A byte-level BPE merges nothing across a space that stands alone between other characters, so a text is cut
    there and the ids of its parts are remembered. New parts go through the faster of the two libraries that read
    the vocabulary. Texts with runs of white space, or with the name of a special token, go to the other as a whole.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        path = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        lines = Path(path).with_suffix(".tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
        self.parts = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= PARTS:
            self.clear()
        ids = self.parts.encode_ordinary(part)
        self[part] = data = struct.pack(f"<{len(ids)}I", *ids)
        return data

    def encode(self, text: str) -> bytes:
        if _RUNS.search(text) or any(t in text for t in self.special):
            return self.whole(text)
        first, *rest = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        return self[first] + b"".join(map(self.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """One for each worker, so that what it has learnt serves all its tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every document's pieces."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.encode(text) + end if text else end
                n = len(ids) // 4
                first = n % length or length
                for k, (lo, hi) in enumerate([(0, first), *[(x, x + length) for x in range(first, n, length)]]):
                    part = ids[4 * lo : 4 * hi]
                    for col, value in zip(out, (doc_id, k, lo, hi - lo, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32))):
                        col.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths of a bin, longest first; how many such bins), for counts[x] pieces of length x < len(counts)."""
    room, left, bins = len(counts) - 1, counts.astype(np.int64).copy(), []
    while left.any():
        bin_, gap, free = [], room, left.copy()
        while gap > 0 and len(at := np.flatnonzero(free[1 : gap + 1])):
            x = int(at[-1]) + 1
            n = min(int(free[x]), gap // x)
            bin_ += [x] * n
            free[x] -= n
            gap -= n * x
        if gap > 0:
            small = bin_[-1]
            best, pair = small, None
            lengths = np.flatnonzero(free[: small + gap + 1])
            for a in lengths[::-1]:
                rest = min(small + gap - a, a)
                low = lengths[: np.searchsorted(lengths, rest, side="right")]
                b = next((int(x) for x in low[::-1] if x != a or free[a] > 1), 0)
                if b and a + b > best:
                    best, pair = int(a) + b, (int(a), b)
                if best == small + gap or 2 * a < best:
                    break
            if pair:
                bin_[-1:] = pair
        need = np.bincount(bin_, minlength=len(left))
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= times * need
        bins.append((sorted(bin_, reverse=True), times))
    return bins


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts (rows with doc_id, piece and length) with sequence_id and offset. Rows: a written table, as it is read
    several times."""
    keyed = parts.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int"))
    # a row for each length and slice: bounded by length * SLICES
    found = keyed.groupBy("length", "slice").count().orderBy("length", "slice").collect()
    counts = np.zeros(length + 1, np.int64)
    firsts, rows, start = [], [], [0] * (length + 1)
    for r in found:
        firsts.append((r["length"], r["slice"], int(counts[r["length"]])))
        counts[r["length"]] += r["count"]
    sequence, counts[length] = int(counts[length]), 0
    for bin_, times in plan(counts):
        offset = 0
        for x in bin_:
            rows.append((x, start[x], start[x] + times, sequence, offset))
            start[x] += times
            offset += x
        sequence += times
    spark = parts.sparkSession
    before = F.broadcast(spark.createDataFrame(firsts, "length long, slice int, before long"))
    place = F.broadcast(spark.createDataFrame(rows, "length long, lo long, hi long, first_sequence long, offset long").groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "first_sequence", "offset"))).alias("places")))
    rank = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1
    ranked = keyed.withColumn("rank", rank).join(before, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    own = ranked.where(F.col("length") == length).select(*parts.columns, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    put = ranked.where(F.col("length") < length).join(place, "length").withColumn("at", F.expr("filter(places, p -> p.lo <= rank and rank < p.hi)[0]"))
    return own.unionByName(put.select(*parts.columns, (F.col("at.first_sequence") + F.col("rank") - F.col("at.lo")).alias("sequence_id"), F.col("at.offset").alias("offset")))
