"""Loading, checking, sampling and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.operators import ingest as ig
from quaestor.operators import profile as pf
from quaestor.operators.chunking import chunk_fixed as fixed_windows
from quaestor.operators.scale import running_total
from quaestor.plans.registry import query, table
from quaestor.sources import tables as st

# Documents with the flaws that loading has to handle, taken from the labels:
# toxic ones have half a vector, ones without a vector have null, low-quality
# ones a blank id and chunk id, unlabelled ones no chunk id.
FLAWED_SQL = """flawed AS (
  SELECT d.doc_id AS doc_no, d.text, 0 AS chunk_no,
         CASE WHEN l.quality = 0 THEN '' ELSE 'd' || d.doc_id END AS doc_id,
         CASE WHEN l.quality = 0 THEN '' WHEN l.quality = 1 THEN 'c' || d.doc_id END AS chunk_id,
         CASE WHEN l.toxic = 1 THEN NULL ELSE d.source END AS source,
         CASE WHEN l.toxic = 1 THEN e.embedding[1:32] ELSE e.embedding END AS embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def flawed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "doc_no")
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "doc_no")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_no"), "embedding")
    low, high = F.col("quality") == 0, F.col("quality") == 1
    toxic, number = F.col("toxic") == 1, F.col("doc_no").cast("string")
    return (
        docs.join(labels, "doc_no", "left")
        .join(vectors, "doc_no", "left")
        .select(
            "doc_no",
            "text",
            F.lit(0).alias("chunk_no"),
            F.when(low, "").otherwise(F.concat(F.lit("d"), number)).alias("doc_id"),
            F.when(low, "").when(high, F.concat(F.lit("c"), number)).alias("chunk_id"),
            F.when(~F.coalesce(toxic, F.lit(False)), F.col("source")).alias("source"),
            F.when(toxic, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"),
        )
    )


@query("scan_checked", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_checked(spark: SparkSession, folder: str) -> DataFrame:
    scan = st.scan_checked(
        spark, f"{folder}/documents.parquet", ["doc_id", "lang", "source", "n_chars"]
    )
    return scan.select("doc_id", "lang", "source", "n_chars")


@query(
    "sql_param",
    "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE n_chars >= 500 GROUP BY lang",
)
def sql_param(spark: SparkSession, folder: str) -> DataFrame:
    return st.sql_rows(
        spark,
        "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM {docs} WHERE n_chars >= :least GROUP BY lang",
        {"least": 500},
        docs=table(spark, folder, "documents"),
    )


@query(
    "request_valid",
    """WITH words AS (SELECT conv_id, turn, text AS question,
    CASE WHEN turn > 0 THEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) END AS asked,
    CASE WHEN role = 'user' THEN false END AS use_cache FROM conversations)
SELECT conv_id, turn, coalesce(asked, 5) AS max_documents, coalesce(use_cache, true) AS use_cache,
       CASE WHEN coalesce(asked, 5) BETWEEN 1 AND 20 THEN NULL ELSE 'max_documents not in 1..20' END AS reason,
       coalesce(asked, 5) BETWEEN 1 AND 20 AS accepted FROM words""",
)
def request_valid(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.when(F.col("turn") > 0, tx.word_count(F.col("text"))).alias("max_documents"),
        F.when(F.col("role") == "user", F.lit(False)).alias("use_cache"),
    )
    return st.validate_requests(requests).drop("question")


@query(
    "valid_vectors",
    f"""WITH {FLAWED_SQL},
modal AS (SELECT len(embedding) AS dim FROM flawed WHERE embedding IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT doc_no, len(embedding) AS dim FROM flawed WHERE len(embedding) = (SELECT dim FROM modal)""",
)
def valid_vectors(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = ig.split_valid_vectors(flawed_chunks(spark, folder))
    return valid.select("doc_no", F.size("embedding").cast("long").alias("dim"))


@query(
    "vector_rejects",
    f"""WITH {FLAWED_SQL},
modal AS (SELECT len(embedding) AS dim FROM flawed WHERE embedding IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT doc_no, CASE WHEN embedding IS NULL THEN 'null' ELSE 'dim' END AS reason FROM flawed
WHERE embedding IS NULL OR len(embedding) <> (SELECT dim FROM modal)""",
)
def vector_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, rejects = ig.split_valid_vectors(flawed_chunks(spark, folder))
    return rejects.select("doc_no", "reason")


@query(
    "ingest_admit",
    f"WITH {FLAWED_SQL} SELECT doc_no, doc_id FROM flawed WHERE doc_id <> '' AND embedding IS NOT NULL",
)
def ingest_admit(spark: SparkSession, folder: str) -> DataFrame:
    return ig.admit_rows(flawed_chunks(spark, folder)).select("doc_no", "doc_id")


@query(
    "ingest_defaults",
    f"""WITH {FLAWED_SQL}
SELECT doc_no, coalesce(source, 'N/A') AS source,
       coalesce(nullif(chunk_id, ''), sha256(doc_id || chr(31) || chunk_no || chr(31) || text)) AS chunk_id
FROM flawed""",
)
def ingest_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return ig.with_defaults(flawed_chunks(spark, folder)).select("doc_no", "source", "chunk_id")


# Loading by content: a text's hash is its id, the labelled texts are stored
# already, and a source is a batch.
UPSERT_SQL = """incoming AS (SELECT sha256(text) AS chunk_id, doc_id, source AS batch FROM documents),
stored AS (SELECT sha256(d.text) AS chunk_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
inserted AS (SELECT chunk_id, min(doc_id) AS doc_id, arg_min(batch, doc_id) AS batch FROM incoming
  WHERE chunk_id NOT IN (SELECT chunk_id FROM stored) GROUP BY chunk_id)"""


def _load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    incoming = docs.select(F.sha2("text", 256).alias("chunk_id"), "doc_id", F.col("source").alias("batch"))
    labelled = docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    stored = labelled.select(F.sha2("text", 256).alias("chunk_id"))
    return incoming, ig.insert_ignore(incoming, stored)


@query("upsert_ignore", f"WITH {UPSERT_SQL} SELECT chunk_id, doc_id, batch FROM inserted")
def upsert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    return _load(spark, folder)[1]


INGEST_TOTALS_SQL = (
    UPSERT_SQL
    + """,
totals AS (SELECT batch, grouping(batch) = 1 AS overall, sum(o)::BIGINT AS offered, sum(i)::BIGINT AS inserted, sum(o - i)::BIGINT AS skipped
  FROM (SELECT batch, 1 AS o, 0 AS i FROM incoming UNION ALL SELECT batch, 0, 1 FROM inserted)
  GROUP BY ROLLUP (batch))"""
)


@query("ingest_totals", f"WITH {INGEST_TOTALS_SQL} SELECT * FROM totals")
def ingest_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ig.ingest_totals(*_load(spark, folder))


@query(
    "ingest_stats",
    f"""WITH {INGEST_TOTALS_SQL}
SELECT 'chunks' AS table_name, (SELECT count(*) FROM (SELECT DISTINCT chunk_id FROM stored)) + inserted AS live_rows,
       inserted, skipped FROM totals WHERE overall""",
)
def ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    stored = labelled.select(F.sha2("text", 256).alias("chunk_id"))
    incoming, inserted = _load(spark, folder)
    return ig.ingest_stats("chunks", stored.distinct(), incoming, inserted)


@query(
    "table_counts",
    """SELECT 'documents' AS table_name, count(*) AS rows FROM documents
UNION ALL SELECT 'chunks', count(*) FROM embeddings
UNION ALL SELECT 'embedded', count(*) FROM embeddings WHERE embedding IS NOT NULL
UNION ALL SELECT 'labels', count(*) FROM labels""",
)
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "embeddings")
    return st.table_counts(
        {
            "documents": (table(spark, folder, "documents"), None),
            "chunks": (chunks, None),
            "embedded": (chunks, F.col("embedding").isNotNull()),
            "labels": (table(spark, folder, "labels"), None),
        }
    )


@query(
    "fk_orphans",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    child = table(spark, folder, "documents").select("doc_id", "lang")
    return ig.orphans(child, table(spark, folder, "labels"))


@query(
    "cascade_delete",
    """SELECT vec_id AS doc_id, label FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    child = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return ig.cascade_delete(child, table(spark, folder, "labels").filter("quality = 0"))


@query(
    "batch_done",
    """WITH sample AS (SELECT source AS batch, doc_id FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3)
SELECT batch, count(*) AS sampled, count(l.doc_id) AS found, count(l.doc_id) / count(*) >= 0.8 AS done
FROM sample s LEFT JOIN labels l ON l.doc_id = s.doc_id GROUP BY batch""",
)
def batch_done(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        F.col("source").alias("batch"), F.col("doc_id").alias("chunk_id")
    )
    loaded = table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"))
    return ig.batch_done(rows, loaded)


@query(
    "ingest_progress",
    """WITH counts AS (SELECT d.doc_id // 100 AS batch, count(*) AS rows, count(e.vec_id) AS loaded
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1)
SELECT batch, rows, loaded, rows = loaded AS complete,
       (SELECT max(c.batch) FROM counts c WHERE NOT EXISTS
          (SELECT 1 FROM counts b WHERE b.batch <= c.batch AND b.rows <> b.loaded)) AS resume_after
FROM counts""",
)
def ingest_progress(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        F.expr("doc_id DIV 100").alias("batch"), F.col("doc_id").alias("chunk_id")
    )
    loaded = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return ig.ingest_progress(rows, loaded)


@query(
    "doc_ids_distinct",
    """SELECT doc_id FROM (SELECT doc_id FROM documents UNION SELECT conv_id FROM conversations)
EXCEPT SELECT doc_id FROM labels""",
)
def doc_ids_distinct(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    talks = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"))
    every = docs.unionByName(talks).distinct()
    return every.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "ordered_page",
    "SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS page, doc_id, lang FROM documents",
)
def ordered_page(spark: SparkSession, folder: str) -> DataFrame:
    """Every page of the table at once: dense positions cut into pages of 50."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    numbered = running_total(docs, ["doc_id"], F.lit(1), "pos")
    return numbered.select(F.expr("pos DIV 50").alias("page"), "doc_id", "lang")


@query(
    "stratified_sample",
    """WITH keyed AS (SELECT CASE WHEN doc_id % 10 <> 7 THEN doc_id END AS doc_id, lang FROM documents),
ranked AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n,
  row_number() OVER (PARTITION BY lang ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '|42'), doc_id) AS r FROM keyed)
SELECT doc_id, lang FROM ranked WHERE r <= round_even(n * 0.1::DOUBLE, 0)""",
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of each language; a tenth of the keys is missing."""
    key = F.when(F.col("doc_id") % 10 != 7, F.col("doc_id")).alias("doc_id")
    docs = table(spark, folder, "documents").select(key, "lang")
    return ig.stratified_sample(docs, "lang", "doc_id", 0.1)


@query(
    "profile_nulls",
    """WITH f AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT c AS "column", n AS nulls, total, round(n * 100.0::DOUBLE / total, 2) AS percent FROM (
  SELECT unnest(['doc_id', 'lang', 'source', 'quality', 'toxic']) AS c,
         unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(source),
                 count(*) - count(quality), count(*) - count(toxic)]) AS n,
         unnest([count(*), count(*), count(*), count(*), count(*)]) AS total FROM f)""",
)
def profile_nulls(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return pf.profile_nulls(docs.join(table(spark, folder, "labels"), "doc_id", "left"))


def _describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 4) AS mean,
  round(stddev_samp({column}), 4) AS std, min({column})::DOUBLE AS min, max({column})::DOUBLE AS max,
  round(quantile_cont({column}, 0.25), 4) AS p25, round(quantile_cont({column}, 0.5), 4) AS p50,
  round(quantile_cont({column}, 0.75), 4) AS p75 FROM lineitem"""


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("profile_numeric", " UNION ALL ".join(_describe_sql(c) for c in MEASURES))
def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    profile = pf.profile_numeric(table(spark, folder, "lineitem"), MEASURES)
    rounded = {c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")}
    return profile.withColumns(rounded)


@query(
    "year_histogram",
    """WITH y AS (SELECT year(o_orderdate) AS year FROM orders),
b AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM y)
SELECT b.year, count(y.year) AS n FROM b LEFT JOIN y ON y.year = b.year GROUP BY b.year""",
)
def year_histogram(spark: SparkSession, folder: str) -> DataFrame:
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"))
    return pf.year_histogram(years)


@query(
    "corpus_stats",
    """WITH pieces AS (SELECT doc_id, text[i * 896 + 1 : i * 896 + 1024] AS text
  FROM documents, range(0, greatest(1, ceil((length(text) - 1024) / 896.0)::BIGINT + 1)) AS r(i))
SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, round(avg(length(text)), 4) AS avg_length,
       min(length(text)) AS min_length, max(length(text)) AS max_length,
       round(count(*) / count(DISTINCT doc_id), 1) AS chunks_per_document FROM pieces""",
)
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    chunks = fixed_windows(table(spark, folder, "documents").select("doc_id", "text"))
    return pf.corpus_stats(chunks).withColumn("avg_length", F.round("avg_length", 4))
