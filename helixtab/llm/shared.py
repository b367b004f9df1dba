"""What the corpus operators share: the run's shared folder, written intermediate tables, words and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Entries that a worker's word cache holds before it starts anew.
CACHE_ENTRIES = 400_000
#: Rows of a table up to which join_small broadcasts it.
SMALL_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and there is but one machine (local
    mode, as in tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="helixtab-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/helixtab/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *parted: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in folders by its last columns where they are named: cuts the lineage, and a
    lost executor costs no recomputation."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*parted).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str] | Column, how: str = "inner", rows: int = SMALL_ROWS) -> DataFrame:
    """big joined with small, a written table that is mostly small: it is broadcast if it has at most `rows` rows (a row
    is some hundred bytes at most), and else joined by a shuffle that Spark splits where a key is hot."""
    return big.join(F.broadcast(small) if small.count() <= rows else small, on, how)


def split_of(doc_id: str, folds: int):
    """crc32 of doc_id as text, modulo folds (null ids: as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def words(data: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text, A-Z lower-cased."""
    return data.translate(LOWER).split()


class WordHashes(dict):
    """word -> XXH64, remembered for up to CACHE_ENTRIES words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
