"""The queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtab.llm import brown, divergence, html, maxscore, mixing, packing, periodic, pii, quality, rpforest, simhash, toxicity, warc
from helixtab.llm.shared import split_of, written

#: The threshold of op8's verdict.
TOXIC = 0.7


def pii_key(spark: SparkSession) -> str:
    """The secret key of surrogates: the setting helixtab.pii.key. Without it, one that everybody knows, for trials, with a
    warning: who knows the key can try values out."""
    key = spark.conf.get("helixtab.pii.key", None)
    if not key:
        warnings.warn("helixtab.pii.key is not set: surrogates are made with a key that everybody knows", stacklevel=2)
    return key or "not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities")


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = split_of("doc_id", 7) == 2
    training = docs.where(~out)
    counts = written(brown.word_counts(training), "brown-words")
    model = brown.fit(training, counts)
    scored = brown.score(docs, model, counts)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "mix_key", F.md5("text").alias("text_md5"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_whole(warc.write(_table(spark, sf_dir, "pages")))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(written(packing.pieces(_table(spark, sf_dir, "documents")), "pieces"))


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = split_of("doc_id", 3) == 1
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn=~out)
    scored = toxicity.score(docs, machine, "score")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op9_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "low", "high")


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def planted_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of each tenth document, the words from one place on, over and over up to a period (the query's contract)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.audit(_table(spark, sf_dir, "documents"), planted_repeats)


def op13_rp_forest_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rpforest.near_groups(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii_surrogates, op2_brown_lm, op3_maxscore_topk, op4_simhash_near_dup, op5_poisson_mix, op6_warc_index, op7_best_two_fit, op8_toxicity_fm, op9_template_text, op10_kn_quality, op11_divergence_audit, op12_periodic_runs, op13_rp_forest_near_dup)}

ORACLE_SQL: dict[str, str] = {
    "op3_maxscore_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) as bigint) as score
                   from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op5_poisson_mix": """
        with sizes as (select source, sum(length(coalesce(text, ''))) as chars from documents group by source),
             total as (select sum(chars) as all_chars, sum(cast(chars > 0 as integer)) as all_weight from sizes),
             rates as (select source, case when chars > 0 then 1.0::double * all_chars * 1.0::double / all_weight / chars else 0 end as rate from sizes, total),
             d as (select doc_id, source, md5(text) as text_md5, md5(coalesce(text, '')) as told, rate,
                          cast(concat('0x', substr(md5('42:copies|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))), 1, 13)) as bigint) / 4503599627370496.0::double as u
                   from documents join rates using (source)),
             terms as (select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k) as below
                       from rates, range(0, 200) t(k) where rate > 0),
             n as (select doc_id, source, text_md5, told, u, (select count(*) from terms t where t.source = d.source and t.below <= d.u) as n from d),
             c as (select doc_id, source, text_md5, told, unnest(range(0, n)) as copy from n)
        select doc_id, source, cast(copy as integer) as copy,
               cast(concat('0x', substr(md5('42:order|' || coalesce(cast(doc_id as varchar), '') || '|' || copy || '|' || told), 1, 13)) as bigint) / 4503599627370496.0::double as mix_key, text_md5
        from c""",
    "op6_warc_index": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
             f as (select *, min(page_id) over (partition by digest) as first_id from p)
        select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
               case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when n >= 100 and page_id <> first_id then first_id end as refers_to
        from f""",
    "op11_divergence_audit": r"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
             w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
             c as (select lang, source, term, count(*) as n, count(distinct r) as docs from w group by all),
             k as (select lang, term, sum(n) as n from c group by all having sum(docs) >= 10),
             v as (select lang, count(*) as v, sum(n) as n from k group by all),
             g as (select distinct lang, source from d),
             x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (cast(1000000000 as hugeint) * (k.n + 2)) // (v.n + 2 * v.v) as q, v.v
                   from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
             p as (select *, 1 + (cast(1000000000 as hugeint) * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p from x),
             f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
                   from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
             parts as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
                       from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
                       union all select lang, source, 'term', term, cast(((p - q) * (p - q)) // (p + q) as bigint) from p where n > 0 and p > q),
             ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from parts)
        select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10""",
}
