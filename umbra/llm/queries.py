"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import exact_dedup, html_text, lang_id, licenses, mixing, packing, secret_scan, simhash, sketch, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_sketch(spark, sf_dir):
    return sketch.version_sketches(documents(spark, sf_dir))


def op2_simhash(spark, sf_dir):
    return simhash.near_groups(documents(spark, sf_dir)).drop("th", "root")


def op3_lang_id(spark, sf_dir):
    return lang_id.identify(documents(spark, sf_dir))


def op4_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_html_text(spark, sf_dir):
    return html_text.extract(pages(spark, sf_dir))


def op7_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def op8_warc(spark, sf_dir):
    rows = warc.read_bundles(warc.write_bundles(pages(spark, sf_dir)))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op10_secrets(spark, sf_dir):
    return secret_scan.report(secret_scan.scan(documents(spark, sf_dir))[0])


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sketch, op2_simhash, op3_lang_id, op4_mixing, op5_exact_dedup, op6_html_text, op7_licenses, op8_warc, op9_packing, op10_secrets, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The base patterns in the spelling of the SQL side, and the least length of what counts.
_CLASSES = {
    0: r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    1: "AKIA[A-Z0-9]+",
    2: "[0-9a-f]{24,}",
}
_KEEP = {0: "length(regexp_extract(m[i], '{p}', 2)) >= 6", 1: "length(m[i]) >= 20", 2: "true"}


def _sql_spans(kind: int) -> str:
    """start, kind and stop of every match, by sums over what lies before it."""
    p = _CLASSES[kind].replace("'", "''")
    keep = _KEEP[kind].replace("{p}", p)
    return f"""SELECT key, {kind} AS kind, starts[i] AS start, starts[i] + length(m[i]) AS stop FROM (
  SELECT key, m, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)) AS starts, unnest(range(1, len(m) + 1)) AS i
  FROM (SELECT key, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM docs WHERE regexp_matches(text, '{p}'))) WHERE {keep}"""


ORACLES = {
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op7_licenses": licenses.oracle(),
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM p LEFT JOIN g USING (payload_digest)""",
    "op10_secrets": f"""
WITH docs AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(map(_sql_spans, range(3)))}),
each AS (SELECT key, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || cast(start AS bigint) || ':' || cast(stop AS bigint), ',' ORDER BY start, kind, stop) AS spans FROM spans GROUP BY key)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN each USING (key)""",
}
