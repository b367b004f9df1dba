"""Scalar work on sequences: normalising, alphabets, complements, focus ranges, word lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of each alphabet and their complements.
ALPHABETS = {
    "dna": ("ACGT", "TGCA"),
    "dna-n": ("ACGTN", "TGCAN"),
    "rna": ("ACGU", "UGCA"),
    "rna-n": ("ACGUN", "UGCAN"),
    "dna-iupac": ("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"),
    "rna-iupac": ("ACGURYSWKMBDHVN", "UGCAYRSWMKVHDBN"),
}


def normalise(seq: Column, skip: str = "") -> Column:
    """Upper case, without the skipped characters."""
    return F.upper(F.translate(seq, skip, "")) if skip else F.upper(seq)


def first_invalid(seq: Column, alphabet: str) -> Column:
    """The first character outside the alphabet, null if there is none."""
    return F.nullif(F.regexp_extract(seq, f"[^{ALPHABETS[alphabet][0]}]", 0), F.lit(""))


def check_alphabet(df: DataFrame, columns: list[str], alphabet: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are valid, and the others with bad_char."""
    bad = F.coalesce(*[first_invalid(F.col(c), alphabet) for c in columns])
    return df.where(bad.isNull()), df.where(bad.isNotNull()).withColumn("bad_char", bad)


def revcomp(seq: Column, alphabet: str = "dna-n") -> Column:
    return F.reverse(F.translate(seq, *ALPHABETS[alphabet]))


def embedded_range(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Focus ranges between the two pipes of each sequence, which are removed; rejected: pairs where a sequence
    doesn't hold exactly two."""
    two = lambda c: F.length(c) - F.length(F.replace(c, F.lit("|"))) == 2
    good = F.coalesce(two(F.col("r_seq")) & two(F.col("q_seq")), F.lit(False))
    out = pairs.where(good)
    for s in "rq":
        seq = F.col(f"{s}_seq")
        start = F.instr(seq, "|") - 1
        out = out.withColumns({f"{s}_start": start, f"{s}_limit": F.length(F.substring_index(seq, "|", 2)) - 1})
    return out.withColumns({f"{s}_seq": F.replace(f"{s}_seq", F.lit("|")) for s in "rq"}), pairs.where(~good)


def explicit_range(pairs: DataFrame, spec_col: str) -> tuple[DataFrame, DataFrame]:
    """Ranges from a text such as R40..75Q41..75 (either part may be missing), else from r_start .. q_limit, else the
    whole sequences. Rejected: both forms for one side, a text of another form, a start after its limit, and ranges that
    leave their sequence."""
    spec = F.coalesce(F.col(spec_col), F.lit(""))
    good = spec.rlike(r"^\s*(?:R\s*\d+\.\.\d+)?\s*(?:Q\s*\d+\.\.\d+)?\s*$")
    new = {}
    for s in "rq":
        part = [F.nullif(F.regexp_extract(spec, rf"{s.upper()}\s*(\d+)\.\.(\d+)", i), F.lit("")).cast("int") for i in (1, 2)]
        own = F.col(f"{s}_start").isNotNull() | F.col(f"{s}_limit").isNotNull()
        good = good & ~(own & part[0].isNotNull())
        new |= {f"{s}_start": F.coalesce(part[0], F.col(f"{s}_start"), F.lit(0)), f"{s}_limit": F.coalesce(part[1], F.col(f"{s}_limit"), F.length(f"{s}_seq"))}
        start, limit = new[f"{s}_start"], new[f"{s}_limit"]
        good = good & F.coalesce((start >= 0) & (start <= limit) & (limit <= F.length(f"{s}_seq")), F.lit(False))
    return pairs.where(good).withColumns(new), pairs.where(~good)


def default_range(pairs: DataFrame) -> DataFrame:
    """Missing ranges become the whole sequences."""
    have = set(pairs.columns)
    of = lambda c: F.col(c) if c in have else F.lit(None).cast("int")
    return pairs.withColumns({c: v for s in "rq" for c, v in ((f"{s}_start", F.coalesce(of(f"{s}_start"), F.lit(0))), (f"{s}_limit", F.coalesce(of(f"{s}_limit"), F.length(f"{s}_seq"))))})


def dealt(pairs: DataFrame, parts: int) -> DataFrame:
    """The pairs by pair_id in at least so many parts. What is made of them keeps that order as long as it keeps pair_id, so
    windows and joins by pair need no further shuffle, and a task holds no more of a larger table."""
    return pairs.repartition(max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), "pair_id")


def bases(pairs: DataFrame) -> DataFrame:
    """pair_id, side (R or Q), pos, base."""
    sides = F.array(*[F.struct(F.lit(s.upper()).alias("side"), F.col(f"{s}_seq").alias("seq")) for s in "rq"])
    rows = pairs.select("pair_id", F.explode(sides).alias("x")).where("length(x.seq) > 0")
    return rows.select("pair_id", "x.side", F.posexplode(F.split("x.seq", "")).alias("pos", "base"))


def _bits(n: Column) -> Column:
    """Bits of n - 1: the exponent of the next power of two."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long"))))


def infer_k(r_len: Column, q_len: Column) -> Column:
    return F.greatest(_bits(r_len + q_len) - 3, F.lit(2))


def length_bucket(r_len: Column, q_len: Column) -> Column:
    """The next power of two from the longer length on."""
    return F.pow(F.lit(2), _bits(F.greatest(r_len, q_len))).cast("long")
