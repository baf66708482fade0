"""Text, chunking, search, codec and embedding queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.functions import vectors as vx
from quaestor.functions.embedding import hashed_words
from quaestor.functions.stemming import stems_sql
from quaestor.operators import chunking as ck
from quaestor.operators import search as se
from quaestor.operators import text_store
from quaestor.operators.memo import memoize
from quaestor.plans.registry import documents, query, table
from quaestor.session import shared_folder

WORDS_SQL = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


@query(
    "chunk_fixed",
    """SELECT sha256(doc_id || chr(31) || i || chr(31) || text[i * 896 + 1 : i * 896 + 1024]) AS chunk_id,
       doc_id, lang, i AS chunk_no, length(text[i * 896 + 1 : i * 896 + 1024]) AS chars
FROM documents, range(0, greatest(1, ceil((length(text) - 1024) / 896.0)::BIGINT + 1)) AS r(i)""",
)
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    chunks = ck.chunk_fixed(documents(spark, folder, "text", "lang"))
    return chunks.select("chunk_id", "doc_id", "lang", "chunk_no", F.char_length("text").alias("chars"))


# The splitter in SQL, for texts without blank lines: lines below the size make
# runs, a longer line and a text of one line are runs of words (or characters),
# and a fold over the running lengths of a run finds its windows.
CHUNK_SQL = """WITH line_lists AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
lines AS (SELECT doc_id, lang, i, CASE WHEN i > 1 THEN chr(10) ELSE '' END || l[i] AS piece, len(l) = 1 AS lone
  FROM line_lists, range(1, len(l) + 1) AS r(i) WHERE i > 1 OR l[1] <> ''),
runs AS (SELECT *, lone OR length(piece) >= 1024 AS long,
  2 * sum((lone OR length(piece) >= 1024)::INT) OVER (PARTITION BY doc_id ORDER BY i) - (lone OR length(piece) >= 1024)::INT AS run
  FROM lines),
parts AS (SELECT doc_id, lang, run, i, CASE WHEN NOT long THEN [piece] WHEN contains(piece, ' ')
    THEN list_transform(string_split(piece, ' '), lambda w, n: CASE WHEN n > 1 THEN ' ' ELSE '' END || w)
    ELSE string_split(piece, '') END AS units FROM runs),
units AS (SELECT doc_id, lang, run, i, n, units[n] AS unit FROM parts, range(1, len(units) + 1) AS r(n) WHERE units[n] <> ''),
sums AS (SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id, run ORDER BY i, n)::BIGINT AS upto FROM units),
listed AS (SELECT doc_id, lang, run, list(unit ORDER BY i, n) AS u, list(upto ORDER BY i, n) AS c FROM sums GROUP BY ALL),
packed AS (SELECT *, list_reduce(range(0, len(u)), lambda a, h: CASE
    WHEN h > a.s AND c[h + 1] - coalesce(c[a.s], 0) > 1024
    THEN {'s': list_filter(range(a.s, h + 1), lambda s: c[h] - coalesce(c[s], 0) <= 128
             AND (s = h OR c[h + 1] - coalesce(c[s], 0) <= 1024))[1],
          'o': list_append(a.o, {'f': a.s, 't': h})}
    ELSE a END, {'s': 0::BIGINT, 'o': []::STRUCT(f BIGINT, t BIGINT)[]}) AS p FROM listed),
cut AS (SELECT doc_id, lang, run, u, unnest(list_append(p.o, {'f': p.s, 't': len(u)::BIGINT})) AS w FROM packed),
texts AS (SELECT doc_id, lang, run, w.f AS f, trim(array_to_string(u[w.f + 1 : w.t], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM cut),
numbered AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY doc_id ORDER BY run, f) - 1 AS chunk_no FROM texts WHERE text <> '')
SELECT sha256(doc_id || chr(31) || chunk_no || chr(31) || text) AS chunk_id, text, chunk_no, doc_id, lang FROM numbered"""


@query("chunk_recursive", CHUNK_SQL)
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return ck.chunk_recursive(documents(spark, folder, "text", "lang"))


@query(
    "word_counts", f"SELECT doc_id, len({WORDS_SQL.format('text')}) AS words FROM documents"
)
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", tx.word_count(F.col("text")).alias("words")
    )


@query(
    "context_preview",
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS preview FROM documents",
)
def context_preview(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", tx.preview(F.col("text"), 500).alias("preview")
    )


@query(
    "keyword_filter",
    "SELECT doc_id, lang FROM documents WHERE coalesce(contains(lower(text), 'therble'), false)",
)
def keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.filter(tx.contains_ci(F.col("text"), "TherBle")).select("doc_id", "lang")


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each assistant turn with the turn before it: (conv_id, turn, question, answer)."""
    turns = table(spark, folder, "conversations")
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    return answers.join(asked, ["conv_id", "turn"])


PAIRS_SQL = """turn_pairs AS (
  SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer
  FROM conversations a JOIN conversations q
    ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 AND q.role = 'user'
  WHERE a.role = 'assistant')"""


@query(
    "common_terms",
    f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, array_to_string(list_sort(list_intersect({WORDS_SQL.format('lower(question)')},
  {WORDS_SQL.format('lower(answer)')})), ' ') AS terms FROM turn_pairs""",
)
def common_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = tx.common_terms(F.col("question"), F.col("answer"))
    return turn_pairs(spark, folder).select("conv_id", "turn", F.array_join(terms, " ").alias("terms"))


@query("content_key", "SELECT doc_id, 'embed:' || sha256(text) AS key FROM documents")
def content_key(spark: SparkSession, folder: str) -> DataFrame:
    key = tx.content_key("embed", F.col("text"))
    return table(spark, folder, "documents").select("doc_id", key.alias("key"))


# Vectors of topic 3 arrive malformed and those of topic 4 blank.
@query(
    "vector_parse",
    """SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE, 5) + 0.0::DOUBLE AS value
FROM embeddings, range(1, len(embedding) + 1) AS r(i) WHERE label NOT IN (3, 4)
UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE label IN (3, 4)""",
)
def vector_parse(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    text = (
        F.when(F.col("label") == 3, F.lit("[0.5, oops"))
        .when(F.col("label") == 4, F.lit("  "))
        .otherwise(vx.format_vector(F.col("embedding")))
    )
    parsed = vectors.select("vec_id", vx.parse_vector(text).alias("v"))
    return parsed.select("vec_id", F.posexplode_outer("v").alias("pos", "x")).select(
        "vec_id",
        F.col("pos").cast("long").alias("pos"),
        (F.round(F.col("x").cast("double"), 5) + 0.0).alias("value"),
    )


# The bits of a float32 from its sign, exponent and fraction, lowest byte first.
@query(
    "vector_hex",
    """WITH parts AS (SELECT vec_id, i, x, abs(x) AS a, floor(log2(abs(x)))::INT AS guess
  FROM (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, len(embedding) + 1) AS r(i))),
exact AS (SELECT *, guess + CASE WHEN a / pow(2, guess) >= 2 THEN 1 WHEN a / pow(2, guess) < 1 THEN -1 ELSE 0 END AS e FROM parts),
bits AS (SELECT vec_id, i, format('{:08x}', CASE WHEN x = 0 THEN 0 ELSE (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END)
  + (e + 127) * 8388608 + ((a / pow(2, e) - 1) * 8388608)::BIGINT END) AS h FROM exact)
SELECT vec_id, string_agg(h[7:8] || h[5:6] || h[3:4] || h[1:2], '' ORDER BY i) AS hex, true AS same
FROM bits GROUP BY vec_id""",
)
def vector_hex(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", vx.vector_to_hex("embedding").alias("hex"))
    back = vx.hex_to_vector("hex")
    return vectors.select("vec_id", "hex", (back == F.col("embedding")).alias("same"))


@query(
    "text_index",
    """WITH tokens AS (SELECT doc_id,
  unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS token FROM documents)
SELECT token, doc_id, count(*) AS tf FROM tokens
WHERE token NOT IN ('', %s) GROUP BY token, doc_id"""
    % ", ".join(f"'{w}'" for w in se.STOP_WORDS),
)
def text_index(spark: SparkSession, folder: str) -> DataFrame:
    return se.text_index(documents(spark, folder, "text"), id_col="doc_id")


SEARCH_SQL = """tokens AS (SELECT doc_id,
  unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS token FROM documents),
idx AS (SELECT token, doc_id, count(*) AS tf FROM tokens GROUP BY token, doc_id),
df AS (SELECT token, count(*) AS df FROM idx GROUP BY token),
terms AS (SELECT DISTINCT item_id AS query_id,
  unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS token FROM benchmark),
used AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS wanted FROM terms WHERE token NOT IN ('', %s)),
scored AS (SELECT u.query_id, i.doc_id, count(*) AS matched, any_value(u.wanted) AS wanted,
  round(sum(i.tf * ln((SELECT count(*)::DOUBLE FROM documents) / df.df)), 6) AS score
  FROM used u JOIN idx i ON i.token = u.token JOIN df ON df.token = u.token GROUP BY u.query_id, i.doc_id)
""" % ", ".join(f"'{w}'" for w in se.STOP_WORDS)


@query(
    "text_search",
    f"""WITH {SEARCH_SQL}
SELECT query_id, doc_id, matched, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scored QUALIFY rank <= 10""",
)
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "or")


@query(
    "text_search_all",
    f"""WITH {SEARCH_SQL}
SELECT query_id, doc_id, matched, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scored WHERE matched = wanted QUALIFY rank <= 10""",
)
def text_search_all(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "and")


def _search(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return se.text_search(asked, documents(spark, folder, "text"), mode=mode, id_col="doc_id")


STEMS_SQL = """WITH words AS (SELECT doc_id,
  unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS token FROM documents),
asked AS (SELECT item_id AS query_id,
  unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS token FROM benchmark),
tokens AS (SELECT DISTINCT token FROM (SELECT token FROM words UNION ALL SELECT token FROM asked)
  WHERE token NOT IN ('', %s)),
stems AS (%s),
idx AS (SELECT stem, doc_id, count(*) AS tf FROM words JOIN stems USING (token) GROUP BY stem, doc_id),
df AS (SELECT stem, count(*) AS df FROM idx GROUP BY stem),
terms AS (SELECT DISTINCT query_id, stem FROM asked JOIN stems USING (token)),
scored AS (SELECT query_id, doc_id, count(*) AS matched,
  round(sum(tf * ln((SELECT count(*)::DOUBLE FROM documents) / df)), 6) AS score
  FROM terms JOIN idx USING (stem) JOIN df USING (stem) GROUP BY query_id, doc_id)
""" % (", ".join(f"'{w}'" for w in se.STOP_WORDS), stems_sql("tokens"))


# The index is written once per call and then searched for all questions.
@query(
    "text_search_stemmed",
    f"""{STEMS_SQL}
SELECT query_id, doc_id, matched, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scored QUALIFY rank <= 10""",
)
def text_search_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
    text_store.write_index(documents(spark, folder, "text"), path, id_col="doc_id")
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return text_store.search_index(spark, path, asked, id_col="doc_id")


EMBED_DIM = 16


def hashed(texts: str, key: str) -> str:
    """SQL twin of HashEmbedder: (key, pos, value) of a relation's `text`."""
    return f"""SELECT {key}, pos, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS value FROM (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {EMBED_DIM} AS pos, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest({WORDS_SQL.format('lower(text)')}) AS w FROM {texts}) GROUP BY {key}, pos)"""


def embed(text: Column | str) -> Column:
    return hashed_words(F.col(text) if isinstance(text, str) else text, EMBED_DIM)


# The memo knows the labelled texts, those of low quality only until before
# now; its entries carry a mark (a first value of 2) to show the reuse.
@query(
    "embed_memo",
    f"""WITH live AS (SELECT DISTINCT d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1),
texts AS (SELECT DISTINCT text, text AS body FROM documents WHERE text NOT IN (SELECT text FROM live)),
fresh AS ({hashed('(SELECT body, text FROM texts)', 'body')})
SELECT d.doc_id, 'hit' AS origin, 0 AS pos, 2.0::DOUBLE AS value FROM documents d WHERE text IN (SELECT text FROM live)
UNION ALL
SELECT d.doc_id, 'new', f.pos, round(f.value, 5) FROM documents d JOIN fresh f ON f.body = d.text""",
)
def embed_memo(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "text")
    known = docs.join(table(spark, folder, "labels"), "doc_id")
    now = F.expr("TIMESTAMP'2024-06-01 12:00:00'")
    memo = known.select(
        tx.content_key("embed", F.col("text")).alias("key"),
        F.array(F.lit(2.0).cast("float")).alias("value"),
        F.when(F.col("quality") == 1, now + F.expr("INTERVAL 1 SECOND")).otherwise(now).alias("expires_at"),
    )
    found, _ = memoize(docs, memo, "embed", "text", embed, now)
    return (
        found.select(
            "doc_id",
            F.when(F.col("memo_hit"), "hit").otherwise("new").alias("origin"),
            F.posexplode("value").alias("pos", "value"),
        )
        .filter(F.col("value") != 0)
        .withColumn("value", F.round(F.col("value").cast("double"), 5))
    )


@query(
    "answer_similarity",
    f"""WITH {PAIRS_SQL},
sides AS (SELECT conv_id, turn, 'q' AS side, question AS text FROM turn_pairs
          UNION ALL SELECT conv_id, turn, 'a', answer FROM turn_pairs),
vectors AS ({hashed("(SELECT conv_id || ':' || turn || ':' || side AS k, text FROM sides)", 'k')}),
norms AS (SELECT k, sqrt(sum(value * value)) AS norm FROM vectors GROUP BY k),
dots AS (SELECT left(a.k, length(a.k) - 2) AS pair, sum(a.value * q.value) / any_value(na.norm * nq.norm) AS s
  FROM vectors a JOIN vectors q ON q.k = left(a.k, length(a.k) - 2) || ':q' AND q.pos = a.pos
  JOIN norms na ON na.k = a.k JOIN norms nq ON nq.k = q.k WHERE a.k LIKE '%:a' GROUP BY 1)
SELECT p.conv_id, p.turn, round(coalesce(d.s, 0), 4) AS similarity
FROM turn_pairs p LEFT JOIN dots d ON d.pair = p.conv_id || ':' || p.turn""",
)
def answer_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of each answer to the question before it, as whole texts."""
    pairs = turn_pairs(spark, folder)
    vectors = pairs.select("conv_id", "turn", embed("answer").alias("a"), embed("question").alias("q"))
    return vectors.select(
        "conv_id", "turn", F.round(vx.cosine(F.col("a"), F.col("q")), 4).alias("similarity")
    )
