"""A stored full-text index over English stems, and searches that read little of it.

Postings lie in blocks of up to 128 of a stem, in the order of their ids, with
the largest count of each block beside them. The folder is partitioned by a hash
of the stem. A search first reads the block maxima of the asked stems alone, from
the folders that can hold them; from these follows a score that the k best reach
in any case, and blocks that cannot lift a text above it are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.functions.stemming import with_stems
from quaestor.functions.text import normalized_tokens
from quaestor.operators.scale import top_per_group
from quaestor.operators.search import STOP_WORDS
from quaestor.session import cut_lineage

BLOCK = 128
BUCKETS = 256

#: About how many cells of a question and a text are scored at a time.
CELLS = 1 << 20


def bucket_of(stem: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, tokens): each token of a batch once, with its texts and its counts there."""
    for batch in batches:
        lists = batch.column(1)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy())
        if not len(row):
            continue
        coded = lists.flatten().dictionary_encode()
        both, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lists) + row, return_counts=True)
        cuts = np.flatnonzero(np.diff(both // len(lists), prepend=-1))
        offsets = pa.array(np.append(cuts, len(both)).astype(np.int32))
        ids = batch.column(0).take(pa.array(both % len(lists)))
        columns = [coded.dictionary, pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(tf))]
        yield pa.RecordBatch.from_arrays(columns, ["token", "ids", "tfs"])


def _postings(texts: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str]) -> DataFrame:
    """(stem, id, tf), where a stem and a text may meet in several rows.

    Tokens are counted where the texts lie, and each different token of all texts
    is stemmed once, whatever the number of texts that hold it.
    """
    tokens = texts.select(id_col, normalized_tokens(F.col(text_col)).alias("tokens"))
    id_type = texts.schema[id_col].dataType.simpleString()
    runs = tokens.mapInArrow(_runs, f"token string, ids array<{id_type}>, tfs array<bigint>")
    runs = cut_lineage(runs.filter(~F.col("token").isin(*stop_words)), "runs")
    stems = cut_lineage(with_stems(runs.select("token").distinct()), "stems")
    held = cut_lineage(runs.join(stems, "token").select("stem", "ids", "tfs"), "postings")
    each = held.select("stem", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
    return each.select("stem", F.col("p.ids").alias(id_col), F.col("p.tfs").alias("tf"))


def stemmed_terms(texts: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(id, stem, tf) of each text's tokens that are no stop words."""
    return _postings(texts, id_col, text_col, stop_words).groupBy(id_col, "stem").agg(F.sum("tf").alias("tf"))


def write_index(
    chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", buckets: int = BUCKETS
) -> None:
    """Write the index of (id, text) to `path`, beside it the number of texts.

    Null texts count as texts without a stem. The range sort goes by (bucket,
    stem, id), so a stem that is in every text is spread over many tasks. Rows of
    one stem and id come together there, and their counts are added.
    """
    postings = _postings(chunks, id_col, text_col, STOP_WORDS).select(bucket_of(F.col("stem"), buckets).alias("bucket"), "stem", id_col, "tf")
    dealt = postings.repartitionByRange("bucket", "stem", id_col).sortWithinPartitions("bucket", "stem", id_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            table = added(table.combine_chunks())
            stems = table.column("stem").combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(stems, prepend=-1))
            # The last row may be added to in the next batch, and its stem may go
            # on; the full blocks before it are done.
            open_ = len(stems) - 1 - (len(stems) - 1 - first[-1]) % BLOCK if len(first) else 0
            yield from blocks(table.slice(0, open_))
            rest = table.slice(open_)
        if rest is not None and rest.num_rows:
            yield from blocks(rest.combine_chunks())

    def added(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        stem, ids, tf = (table.column(i).chunk(0) for i in (1, 2, 3))
        new = np.diff(stem.dictionary_encode().indices.to_numpy(), prepend=-1) != 0
        new |= np.diff(ids.dictionary_encode("encode").indices.to_numpy(), prepend=-1) != 0
        first = np.flatnonzero(new)
        return table.take(pa.array(first)).set_column(3, "tf", pa.array(np.add.reduceat(tf.to_numpy(), first))).combine_chunks()

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        bucket, stem, ids, tf = (table.column(i).chunk(0) for i in range(4))
        number = stem.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(number, prepend=-1))
        at = np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))
        cuts = np.flatnonzero(at % BLOCK == 0)
        offsets = pa.array(np.append(cuts, len(number)).astype(np.int32))
        columns = [
            bucket.take(pa.array(cuts)),
            stem.take(pa.array(cuts)),
            pa.array(np.diff(np.append(cuts, len(number)))),
            pa.array(np.maximum.reduceat(tf.to_numpy(), cuts)),
            ids.take(pa.array(cuts)),
            pa.ListArray.from_arrays(offsets, ids),
            pa.ListArray.from_arrays(offsets, tf),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "stem", "n", "max_tf", "first_id", "ids", "tfs"])

    id_type = chunks.schema[id_col].dataType.simpleString()
    schema = f"bucket int, stem string, n bigint, max_tf bigint, first_id {id_type}, ids array<{id_type}>, tfs array<bigint>"
    dealt.mapInArrow(task, schema).write.partitionBy("bucket").parquet(f"{path}/blocks")
    chunks.agg(F.count("*").alias("texts")).write.parquet(f"{path}/size")


def search_index(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    question: str = "question",
    id_col: str = "chunk_id",
    buckets: int = BUCKETS,
    block: int = 1024,
) -> DataFrame:
    """(query_id, id, matched, score, rank): the best `k` texts by the sum of tf * ln(texts / df).

    A block is opened if its largest count, with the largest of each other asked
    stem of a question, reaches what the k-th block maximum of some stem ensures.
    Opened postings move once, to their text, in the order of ids; the asked stems
    ride to the tasks in blocks of `block` questions, and a task gives up only its
    best `k` per question. Scores are rounded to six places, ties go to the smaller
    id. A question without a known stem has no rows.
    """
    asked = stemmed_terms(questions, query_id, question).select(query_id, "stem")
    asked = cut_lineage(asked, "asked")
    total = spark.read.parquet(f"{path}/size").first().texts
    # At most as many values as there are buckets.
    wanted = [r.b for r in asked.select(bucket_of(F.col("stem"), buckets).alias("b")).distinct().collect()]
    held = spark.read.parquet(f"{path}/blocks").filter(F.col("bucket").isin(wanted))
    stems = asked.select("stem").distinct()
    heads = cut_lineage(held.select("bucket", "stem", "first_id", "n", "max_tf").join(stems, "stem", "left_semi"), "heads")

    # Each block's maximum belongs to a text of its own: the k-th largest is reached by k texts.
    largest = top_per_group(heads, ["stem"], [F.col("max_tf").desc(), F.col("first_id")], k, "_nth")
    known = heads.groupBy("stem").agg(F.sum("n").alias("df"), F.max("max_tf").alias("_top"))
    sure = largest.filter(F.col("_nth") == k).select("stem", F.col("max_tf").alias("_sure"))
    known = known.join(sure, "stem", "left").withColumn("idf", F.log(F.lit(float(total)) / F.col("df")))
    of = Window.partitionBy(query_id)
    terms = asked.join(known, "stem").select(
        query_id,
        "stem",
        "idf",
        (F.sum(F.col("_top") * F.col("idf")).over(of) - F.col("_top") * F.col("idf")).alias("_others"),
        F.max(F.coalesce(F.col("_sure") * F.col("idf"), F.lit(0.0))).over(of).alias("_least"),
    )
    # The questions are a stated set: a row per question and known stem.
    terms = terms.select(query_id, "stem", "idf", (F.col("_others") - F.col("_least")).alias("_more")).toArrow().combine_chunks()
    kinds = {query_id: questions.schema[query_id].dataType, id_col: held.schema["first_id"].dataType}
    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds.items()), "matched bigint", "score double"])
    found = spark.createDataFrame([], schema)
    asker = terms.column(0).combine_chunks().dictionary_encode("encode") if terms.num_rows else None
    for at in range(0, len(asker.dictionary) if terms.num_rows else 0, block):
        own = np.flatnonzero(asker.indices.to_numpy() // block == at // block)
        part = terms.take(pa.array(own))
        stem = part.column("stem").combine_chunks().dictionary_encode()
        best = part.append_column("term", stem.indices).group_by("term").aggregate([("stem", "min"), ("idf", "max"), ("_more", "max")])
        best = spark.createDataFrame(best.select(["term", "stem_min", "idf_max", "_more_max"]).rename_columns(["term", "stem", "idf", "_more"]))
        # The margin is wider than the rounding of scores.
        opened = held.join(best, "stem").filter(F.col("max_tf") * F.col("idf") + F.col("_more") >= -1e-5)
        met = opened.select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
        met = met.select(F.col("p.ids").alias(id_col), "term", F.col("p.tfs").alias("tf"))
        dealt = met.repartition(id_col).sortWithinPartitions(id_col, "term")
        names = asker.dictionary.slice(at, block)
        scan = _scorer(names, stem.indices.to_numpy(), asker.indices.to_numpy()[own] - at, part.column("idf").to_numpy(), k)
        found = found.union(dealt.mapInArrow(scan, schema))
    return top_per_group(found, [query_id], [F.col("score").desc(), F.col(id_col)], k)


def _scorer(names: pa.Array, term: np.ndarray, asker: np.ndarray, idf: np.ndarray, k: int):
    """A task over (id, term, tf) in the order of ids: the best `k` of its texts for each question.

    `term`, `asker` and `idf` are the asked stems by number, one row per question that asks.
    """
    order = np.argsort(term, kind="stable")
    asks, weight = asker[order], idf[order]
    begin = np.searchsorted(term[order], np.arange(term.max() + 2))

    def score(batch: pa.Table, text: np.ndarray, best: list) -> list:
        """`text` numbers the texts of the batch's rows from 0, ascending."""
        first = np.flatnonzero(np.diff(text, prepend=-1))
        own, tf = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        n = begin[own + 1] - begin[own]
        stop = np.cumsum(n)
        take = np.repeat(begin[own] - (stop - n), n) + np.arange(stop[-1])
        cell = asks[take] * len(first) + np.repeat(text, n)
        size = len(names) * len(first)
        matched = np.bincount(cell, minlength=size).reshape(len(names), -1)
        sums = np.bincount(cell, np.repeat(tf, n) * weight[take], minlength=size).reshape(len(names), -1)
        sums = np.floor(sums * 1e6 + 0.5) / 1e6
        # Texts come in the order of ids, so a later one must be better than the k-th so far.
        least, (who, points, hits, ids) = best
        who_, text_ = np.nonzero((matched > 0) & (sums > least[:, None]))
        if not len(who_):
            return best
        ids = pa.concat_arrays([ids, batch.column(0).combine_chunks().take(pa.array(first[text_]))])
        who, points = np.append(who, who_), np.append(points, sums[who_, text_])
        hits = np.append(hits, matched[who_, text_])
        order = np.lexsort((np.arange(len(who)), -points, who))
        nth = np.arange(len(who)) - np.searchsorted(who[order], who[order])
        kept = order[nth < k]
        least[who[order[nth == k - 1]]] = points[order[nth == k - 1]]
        return [least, (who[kept], points[kept], hits[kept], ids.take(pa.array(kept)))]

    def pieces(table: pa.Table, text: np.ndarray, best: list) -> list:
        """A number of texts at a time, so that the cells of questions and texts stay few."""
        own = table.column(1).to_numpy()
        cost = np.cumsum(begin[own + 1] - begin[own] + len(names) * (np.diff(text, prepend=-1) != 0))
        first = np.flatnonzero(np.diff(text, prepend=-1))
        cuts = first[np.flatnonzero(np.diff(cost[first] // CELLS, prepend=-1))]
        for a, b in zip(cuts, [*cuts[1:], len(text)]):
            best = score(table.slice(a, b - a), text[a:b] - text[a], best)
        return best

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            code = table.column(0).chunk(0).dictionary_encode("encode").indices.to_numpy()
            if best is None:
                none = np.zeros(0, np.int64)
                best = [np.full(len(names), -np.inf), (none, np.zeros(0), none, table.column(0).chunk(0)[:0])]
            # The last text may go on in the next batch.
            last = int(np.searchsorted(code, code[-1]))
            if last:
                best = pieces(table.slice(0, last), code[:last].astype(np.int64), best)
            rest = table.slice(last)
        if rest is not None:
            _, (who, points, hits, ids) = pieces(rest, np.zeros(rest.num_rows, np.int64), best)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), ids, pa.array(hits), pa.array(points)], ["query_id", "id", "matched", "score"])

    return scan
