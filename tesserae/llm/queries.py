"""Queries opN_* and pipeline over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import documents, labels


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import minhash

    return minhash.edited_fingerprints(documents(spark, sf_dir))


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 1: signature bands joined, Jaccard verified, every document with its class."""
    from tesserae.llm import minhash

    return minhash.membership(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import quality_rules

    return quality_rules.rule_kept(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import warc

    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm import bpe

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm import packing

    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import secrets

    found = secrets.scanned(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["order"] < len(secrets.KINDS))
    return found.select("doc_id", *[count(k) for k, *_ in secrets.KINDS], F.sha2(secrets.joined(own), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import simhash

    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import passages

    return passages.report(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import quality_model

    out = quality_model.classified(documents(spark, sf_dir), labels(spark, sf_dir), train=~quality_model.held_out())
    return out.select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import katz

    return katz.scored(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import fim

    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = fim.transformed(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm import merges

    path = public_tokenizers.path("byte_bpe_50k.json")
    back = merges.decode(merges.encode(documents(spark, sf_dir), path, packed=True), path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import whitening

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(rows)
    share = F.array(*[F.lit(float(x)) for x in (model.explained if model else [])]).cast("array<double>")
    each = whitening.transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    whole = {"n": F.lit(model.n if model else None).cast("long"), "deviation": F.expr("try_cast(deviation AS long)"), "explained": F.get(share, F.col("at")), "identity_error": F.lit(whitening.identity_error(rows, model)).cast("double")}
    return each.select("vec_id", (F.col("at") + 1).alias("component"), whole["n"].alias("n"), whole["deviation"].alias("deviation"), "whitened", whole["explained"].alias("explained"), whole["identity_error"].alias("identity_error"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
r AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM r)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
r AS (SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS h1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM u),
c AS (SELECT *, array_to_string(units[1:least(h1, h2)], '') AS p, array_to_string(units[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(units[greatest(h1, h2) + 1:], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprints": op1_fingerprints, "op2_quality_rules": op2_quality_rules, "op3_warc": op3_warc, "op4_bpe": op4_bpe, "op5_packing": op5_packing, "op6_secrets": op6_secrets, "op7_simhash": op7_simhash, "op8_passages": op8_passages, "op9_quality_classifier": op9_quality_classifier, "op10_katz": op10_katz, "op11_fill_in_middle": op11_fill_in_middle, "op12_merge_rounds": op12_merge_rounds, "op13_whitening": op13_whitening, "pipeline": pipeline, "minhash_classes": minhash_classes}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3, "op11_fill_in_middle": OP11}
