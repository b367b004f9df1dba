"""FASTA in, results in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, rec_idx, id, comment, seq. A record starts with > at the start of a line, which \\r, \\n or both end; its id ends
    at the first white space; the lines after its header are joined. Text before the first record, unless it is blank, is
    an error.

    Records are rows for Spark's reader, so a large file is split over many tasks, and only a single record has to fit into
    one. A record's number is its rank in its split plus the records of the splits before."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    # where lines end with \r alone, a row holds several records
    parts = rows.select("file", "block", "at", F.posexplode(F.split("value", "\r>")).alias("i", "v"))
    first = (F.col("block") == 0) & (F.row_number().over(Window.partitionBy("file", "block").orderBy("at", "i")) == 1)
    parts = parts.withColumn("_first", first)
    lead = F.col("_first") & ~F.col("v").startswith(">")
    fine = F.when(lead & (F.trim(F.translate("v", "\r\n\t", "   ")) != ""), F.raise_error(F.lit("text before the first record")).cast("boolean")).otherwise(~lead)
    records = parts.where(fine).withColumn("rec", F.regexp_replace(F.when(F.col("_first"), F.substr("v", F.lit(2))).otherwise(F.col("v")), "\r\n?", "\n"))
    # numbers: a split's records, and those of all splits of the file before it
    blocks = records.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("at", "i")) - 1
    numbered = records.withColumn("_rank", rank).join(before, ["file", "block"])
    head = F.split_part("rec", F.lit("\n"), F.lit(1))
    return numbered.select("file", (F.col("before") + F.col("_rank")).cast("int").alias("rec_idx"), F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), F.replace(F.substr("rec", F.length(head) + 2), F.lit("\n"), F.lit("")).alias("seq"))


def check_records(seqs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Records of files that have exactly n, and (file, records) of the others."""
    counts = seqs.groupBy("file").agg(F.count("*").alias("records"))
    bad = counts.where(F.col("records") != n)
    return seqs.join(bad, "file", "left_anti"), bad


def make_pairs(seqs: DataFrame, queries: DataFrame | None = None, on: DataFrame | None = None) -> DataFrame:
    """pair_id, r_name, r_seq, q_name, q_seq: records 0 and 1 of each file, or single records of references and queries
    that a manifest (pair_id, r_file, q_file) names."""
    if queries is None:
        side = lambda i, s: seqs.where(F.col("rec_idx") == i).select(F.col("file").alias("pair_id"), F.col("id").alias(f"{s}_name"), F.col("seq").alias(f"{s}_seq"))
        return side(0, "r").join(side(1, "q"), "pair_id")
    side = lambda df, s: df.where("rec_idx = 0").select(F.col("file").alias(f"{s}_file"), F.col("id").alias(f"{s}_name"), F.col("seq").alias(f"{s}_seq"))
    return on.join(side(seqs, "r"), "r_file").join(side(queries, "q"), "q_file").select("pair_id", "r_name", "r_seq", "q_name", "q_seq")


def write_results(df: DataFrame, path: str) -> None:
    """Results with their nested alignments, as Parquet partitioned by type."""
    df.write.partitionBy("type").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results; runtime and memory are 0 where absent."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in ("runtime", "memory")})
