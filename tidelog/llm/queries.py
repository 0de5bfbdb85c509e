"""The queries of this subpackage: thin digests over its operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import fertility, jaccard_join, license_scan, mixing, packing, secret_scan, sharding, spotsigs, toxicity, weak_labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, counts = F.col("secret_spans"), secret_scan.KINDS[:3]
    base = F.filter(spans, lambda s: s["kind"] < len(counts))
    return found.select(
        "doc_id",
        *[secret_scan.count_of(spans, k).alias(f"n_{k}") for k in counts],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
    )


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs).select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(_table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return weak_labels.score(docs, *weak_labels.fit(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_mixing_sources,
        op3_quality_rules,
        op4_license_scans,
        op5_quality_classifier,
        op6_packing,
        op7_document_fingerprints,
        op8_toxicity,
        op9_ngram_jaccard_join,
        op10_sharding,
    )
}
#: All pairs that share a shingle, and the closure of their links: right, but only for small tables.
_JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then ['|' || array_to_string(ws, ' ')] else [] end) shingle from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
r as (select doc_id a, doc_id b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a doc_id, min(b) component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id from documents d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""
ORACLES: dict[str, str] = {"op2_mixing_sources": mixing.oracle(), "op9_ngram_jaccard_join": _JACCARD}
