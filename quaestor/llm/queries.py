"""The named queries of this package: each operator over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import (
    conversation_repair,
    decontaminate,
    kn_classifier,
    language,
    licenses,
    near_dup,
    packing,
    personal_data,
    quality_rules,
    secrets,
    spelling,
    token_files,
    url_rules,
)
from quaestor.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL for the same rows where SQL can express it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_spaced_seeds")
def op1_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, items)


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@query("op2_string_kernel")
def op2_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = docs.filter(docs.doc_id.isNotNull() & ~held_out(docs.doc_id))
    model = language.fit(language.sample_of(labelled))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op3_perplexity_bands")
def op3_perplexity_bands(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def url_sql() -> str:
    """The same rules, each tried on every url."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    sites = ", ".join(
        f"({quoted(verdict)}, {quoted(rule)}, {quoted(rule.partition('/')[0])}, "
        f"{quoted('/' + rule.partition('/')[2])})"
        for verdict, rule in url_rules.SITE_RULES
    )
    patterns = ", ".join(
        f"({i}, {quoted(r.verdict)}, {quoted(r.text)}, {quoted(r.regex)})"
        for i, r in enumerate(url_rules.default_rules())
        if not r.site
    )
    return f"""
WITH sites(verdict, rule, site, prefix) AS (VALUES {sites}),
patterns(n, verdict, pattern, regex) AS (VALUES {patterns}),
cut AS (
  SELECT row_number() OVER () AS row, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s
  FROM pages),
named AS (
  SELECT row, page_id, s, regexp_extract(s, '^[^/?#]*') AS raw,
         regexp_extract(substr(s, length(raw) + 1), '^[^?#]*') AS path,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM cut),
sited AS (
  SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM named JOIN sites
    ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix)
  GROUP BY row),
fitting AS (
  SELECT row, arg_min(pattern, n + 1000 * (verdict = 'block')::INT) AS pattern,
         arg_min(verdict, n + 1000 * (verdict = 'block')::INT) AS verdict
  FROM named JOIN patterns ON regexp_matches(lower(s), regex, 's')
  GROUP BY row)
SELECT page_id, host, path, sited.rule, coalesce(sited.verdict, fitting.verdict, 'allow') AS verdict,
       CASE WHEN sited.rule IS NULL THEN fitting.pattern END AS pattern
FROM named LEFT JOIN sited USING (row) LEFT JOIN fitting USING (row)"""


@query("op4_rarest_token_rules", url_sql())
def op4_rarest_token_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages"))


@query("op5_signature_licenses")
def op5_signature_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op6_vector_packing")
def op6_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


# The same links from all pairs with a common shingle, and who reaches whom.
NEAR_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM split, range(1, greatest(len(w) - 3, 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reached.doc_id, y FROM reached JOIN links ON x = other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id,
       doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


@query("op7_hyperminhash", NEAR_SQL)
def op7_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op8_orc_tokens")
def op8_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, folder, "documents"), path)
    return token_files.digest(token_files.read_tokens(spark, path))


@query("op9_kneser_ney_classifier")
def op9_kneser_ney_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Trusted are the documents that `labels` gives quality 1 and not toxic."""
    labels = table(spark, folder, "labels")
    trusted = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return kn_classifier.classify(table(spark, folder, "documents"), trusted)


@query("op10_trigram_secrets")
def op10_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


@query("op11_offset_transducers")
def op11_offset_transducers(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, folder, "documents"))


@query("op12_idastar_repair")
def op12_idastar_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, folder, "conversations"))


@query("op13_bloom_neighbourhoods")
def op13_bloom_neighbourhoods(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))
