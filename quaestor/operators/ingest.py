"""Loading chunks: checks, defaults, insert-ignore, progress and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.chunking import chunk_key
from quaestor.operators.scale import (
    first_per_key,
    join_with_nulls,
    running_total,
    top_per_group,
)
from quaestor.session import cut_lineage


def modal_dimension(df: DataFrame, vector: str = "embedding") -> int:
    """The most frequent vector length; the shorter one on a tie."""
    row = (
        df.filter(F.col(vector).isNotNull())
        .groupBy(F.size(vector).alias("dim"))
        .count()
        .orderBy(F.col("count").desc(), "dim")
        .first()
    )
    if row is None:
        raise ValueError(f"no vector in column {vector}")
    return row["dim"]


def split_valid_vectors(
    df: DataFrame, dim: int | None = None, vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(rows with a vector of `dim` values, the others with a `reason`)."""
    expected = modal_dimension(df, vector) if dim is None else dim
    reason = F.when(F.col(vector).isNull(), "null").when(F.size(vector) != expected, "dim")
    return df.filter(reason.isNull()), df.filter(reason.isNotNull()).withColumn("reason", reason)


def admit_rows(df: DataFrame) -> DataFrame:
    """Rows fit for loading: a document id and a vector."""
    has_id = F.col("doc_id").isNotNull() & (F.col("doc_id").cast("string") != "")
    return df.filter(has_id & F.col("embedding").isNotNull())


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill a missing source and derive a missing chunk id from the content."""
    given = F.when(F.col("chunk_id").cast("string") != "", F.col("chunk_id").cast("string"))
    derived = chunk_key(F.col("doc_id"), F.col("chunk_no"), F.col("text"))
    return df.withColumn("chunk_id", F.coalesce(given, derived)).withColumn(
        "source", F.coalesce("source", F.lit("N/A"))
    )


def insert_ignore(
    incoming: DataFrame,
    target: DataFrame,
    key: str = "chunk_id",
    order: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The incoming rows to append: new keys only, the first row of each by `order`.

    Rows that `order` leaves equal are told apart by their other columns, so the
    choice is the same on every run.

    Copies collapse on the map side, so the anti join meets each key once and
    finds the rows already partitioned by it. Of the target only keys are read.
    """
    rest = [c for c, kind in incoming.dtypes if c not in (key, *order) and "map<" not in kind]
    single = first_per_key(incoming, [key], [*order, *rest])
    return single.join(target.select(key), key, "left_anti")


def ingest_totals(offered: DataFrame, inserted: DataFrame, batch: str = "batch") -> DataFrame:
    """Rows offered, inserted and skipped per batch, and `overall` in a row of its own."""
    both = offered.select(batch, F.lit(1).alias("offered"), F.lit(0).alias("inserted")).unionAll(
        inserted.select(batch, F.lit(0), F.lit(1))
    )
    return (
        both.rollup(batch)
        .agg(
            (F.grouping_id() == 1).alias("overall"),
            F.sum("offered").alias("offered"),
            F.sum("inserted").alias("inserted"),
        )
        .withColumn("skipped", F.col("offered") - F.col("inserted"))
    )


def orphans(child: DataFrame, parent: DataFrame, key: str = "doc_id") -> DataFrame:
    """Child rows whose key is set but has no parent.

    The check runs on distinct keys, so a parent with a third of all children
    costs one row. Missing keys are few as a rule, and then no child row moves.
    """
    keys = child.select(key).filter(F.col(key).isNotNull()).distinct()
    missing = cut_lineage(keys.join(parent.select(key), key, "left_anti"))
    return child.join(missing, key, "left_semi")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Child rows that stay when the `deleted` parents go."""
    return child.join(cut_lineage(deleted.select(key).distinct()), key, "left_anti")


def batch_done(
    rows: DataFrame,
    loaded: DataFrame,
    batch: str = "batch",
    key: str = "chunk_id",
    sample_size: int = 3,
    threshold: float = 0.8,
) -> DataFrame:
    """Whether the first few ids of each batch are loaded already.

    A batch without a usable id counts as not done.
    """
    usable = rows.filter(F.col(key).isNotNull()).select(batch, key)
    sample = top_per_group(usable, [batch], [F.col(key)], sample_size, "_n")
    hits = sample.join(loaded.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    share = hits.groupBy(batch).agg(
        F.count("*").alias("sampled"), F.count("_hit").alias("found")
    )
    # A null batch is one like any other.
    every = rows.select(batch).distinct()
    named = share.withColumnRenamed(batch, "_batch")
    return every.join(named, F.col(batch).eqNullSafe(F.col("_batch")), "left").select(
        batch,
        F.coalesce("sampled", F.lit(0)).alias("sampled"),
        F.coalesce("found", F.lit(0)).alias("found"),
        F.coalesce(F.col("found") / F.col("sampled") >= threshold, F.lit(False)).alias("done"),
    )


def ingest_progress(
    rows: DataFrame, loaded: DataFrame, batch: str = "batch", key: str = "chunk_id"
) -> DataFrame:
    """Exact progress per batch; `resume_after` is the last batch of the loaded prefix."""
    hits = rows.select(batch, key).join(
        loaded.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left"
    )
    counts = cut_lineage(
        hits.groupBy(batch)
        .agg(F.count("*").alias("rows"), F.count("_hit").alias("loaded"))
        .withColumn("complete", F.col("rows") == F.col("loaded"))
    )
    # The prefix ends before the first incomplete batch: two aggregates, a value each.
    first_open = counts.filter(~F.col("complete")).agg(F.min(batch)).first()[0]
    prefix = counts if first_open is None else counts.filter(F.col(batch) < F.lit(first_open))
    last = F.lit(prefix.agg(F.max(batch)).first()[0]).cast(counts.schema[batch].dataType)
    return counts.select(batch, "rows", "loaded", "complete", last.alias("resume_after"))


def stratified_sample(
    df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42, digits: int = 4
) -> DataFrame:
    """Exactly round(fraction * n) rows of each stratum, the same on every run.

    Rows rank by md5(key, seed), a null key as an empty one. Counts per (stratum, leading hex digits of the
    hash) give each stratum's border range: rows in ranges before it are in,
    rows after it out, and only those in it, one in 16**digits, are sorted.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashed = df.withColumn("_hash", F.md5(F.concat(named, F.lit(f"|{seed}"))))
    hashed = hashed.withColumn("_range", F.substring("_hash", 1, digits))
    counts = hashed.groupBy(stratum, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    want = F.bround(F.sum("_n").over(Window.partitionBy(stratum)) * fraction, 0).cast("long")
    borders = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_want", want)
        .filter(F.col("_upto") >= F.col("_want"))
        .groupBy(stratum)
        .agg(F.min_by(F.struct("_range", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_room")), "_range").alias("_b"))
        .select(stratum, F.col("_b._range").alias("_border"), "_b._room")
    )
    # A row per stratum; as a broadcast the table itself need not move.
    marked = join_with_nulls(hashed, cut_lineage(borders), [stratum])
    inside = marked.filter(F.col("_range") < F.col("_border"))
    rank = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_hash", key))
    border = marked.filter(F.col("_range") == F.col("_border")).withColumn("_rank", rank)
    border = border.filter(F.col("_rank") <= F.col("_room"))
    return inside.select(*df.columns).unionByName(border.select(*df.columns))


def vector_positions(
    chunks: DataFrame, id_col: str = "chunk_id", vector: str = "embedding"
) -> DataFrame:
    """(id, pos): rows with a vector numbered densely from 0 in id order.

    Only ids are sorted and written.
    """
    ids = chunks.filter(F.col(vector).isNotNull()).select(id_col)
    return running_total(ids, [id_col], F.lit(1), "pos")


def vector_index(
    chunks: DataFrame, id_col: str = "chunk_id", vector: str = "embedding"
) -> DataFrame:
    """Rows with a vector and their position `pos`; ids should be unique."""
    rows = chunks.filter(F.col(vector).isNotNull())
    return rows.join(vector_positions(chunks, id_col, vector), id_col)


def ordered_page(df: DataFrame, key: str, page: int, page_size: int) -> DataFrame:
    """One page of the table in key order, counted from 0.

    For pages deep inside a big table number the rows with `vector_index`-style
    positions instead; an offset sorts everything before it.
    """
    return df.orderBy(key).offset(page * page_size).limit(page_size)



def ingest_stats(
    table_name: str, stored: DataFrame, offered: DataFrame, inserted: DataFrame
) -> DataFrame:
    """One row for a table: rows after the load, rows inserted, rows skipped."""
    sizes = (
        stored.select(F.lit("stored").alias("part"))
        .unionAll(offered.select(F.lit("offered")))
        .unionAll(inserted.select(F.lit("inserted")))
    )
    counts = sizes.agg(
        *[F.count_if(F.col("part") == p).alias(p) for p in ("stored", "offered", "inserted")]
    )
    return counts.select(
        F.lit(table_name).alias("table_name"),
        (F.col("stored") + F.col("inserted")).alias("live_rows"),
        "inserted",
        (F.col("offered") - F.col("inserted")).alias("skipped"),
    )
