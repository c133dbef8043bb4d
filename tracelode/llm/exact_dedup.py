"""Exact deduplication with stateful streaming (native: DataFrame operations only).

A slim spool of (id, digest, size, locator) rows is read as a stream and
aggregated by digest.  The keyed state lives in RocksDB, has no expiry and
holds, for each digest, the row that stays (size, identifier, locator) and
the row count.  Every hit (a digest held by more than one row) is then checked
byte by byte against the row that stays; rows of a digest collision are
grouped anew by their full text.

Defined results: a null text counts as empty; rows with a null id take part
and sort after all other ids; a repeated row is a member like any other and
counts in ``group_size``; of rows that share the id which stays, all are
``kept``, and ``exact_dedup_filter`` keeps the one with the most code points,
then the least text; very long texts are read whole; an empty table gives an
empty result; other input columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prefix, scratch

#: The white space that equality ignores: code points 0x20 and 0x09 to 0x0D.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no preallocated logs (4 MB and more for each store otherwise)
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def squeezed(text: Column) -> Column:
    """``text`` without white space; byte-level replacement, no regular expression."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank))
    return out


def _stream_state(spool: DataFrame, spool_dir: str, state_dir: str) -> DataFrame:
    """Run the spool through the stateful stream; (digest, best, n) of all digests."""
    spark = spool.sparkSession
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = (
            spark.readStream.schema(spool.schema)
            .parquet(spool_dir)
            .groupBy("digest")
            .agg(F.min("rank").alias("best"), F.count("*").alias("n"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state_dir)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(state_dir)
    best, n = state.schema["value"].dataType.names[:2]
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{best}`").alias("best"),
        F.col(f"value.`{n}`").alias("n"),
    )


def sha256(squeezed_text: Column) -> Column:
    return F.sha2(squeezed_text.cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (the digest).

    Equal texts are those identical after deleting white space; of them the
    row with the most code points in the original, then the smallest id, stays.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = F.length(F.coalesce("text", F.lit("")))
    spool_dir, state_dir = scratch(spark, "dedup-spool"), scratch(spark, "dedup-state")
    # rank: what the state keeps the least of; its id is also the locator of the content
    rows.select(
        digest(squeezed(F.col("text"))).alias("digest"),
        F.struct((-size).alias("neg_size"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")).alias("rank"),
    ).write.parquet(spool_dir)
    spool = spark.read.parquet(spool_dir)
    state = _stream_state(spool, spool_dir, state_dir)
    found = materialize(
        spool.join(state, "digest").select(
            F.col("rank.id").alias("id"), "digest", F.col("best.id").alias("keep_id"), F.col("n").alias("size")
        ),
        "dedup-found",
    )
    # Full bytes on hits.
    hits = found.where("size > 1").select("id", "keep_id", "digest").distinct()
    body = hits.join(rows.select(F.col("id").alias("rid"), "text"), F.expr("id <=> rid")).select(
        "id", "keep_id", "digest", squeezed(F.col("text")).alias("bytes")
    )
    body = body.where(digest(F.col("bytes")) == F.col("digest"))  # an id may repeat with other text
    kept = body.where("id <=> keep_id").select(F.col("digest").alias("kd"), F.col("bytes").alias("kept_bytes"))
    odd = materialize(
        body.join(kept, F.col("digest") == F.col("kd")).where("bytes <> kept_bytes").select("id", "digest", "bytes"),
        "dedup-collisions",
    )
    if not odd.isEmpty():
        found = _regroup(found, odd, rows)
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("size").cast("long").alias("group_size"),
        F.expr("id <=> keep_id").alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _regroup(found: DataFrame, odd: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` with the rows of ``odd`` (same digest, other bytes) in groups of their own."""
    odd = odd.distinct()  # here, not on the join, whose frequent digests could not be split then
    size = F.length(F.coalesce("text", F.lit("")))
    full = odd.join(rows.select(F.col("id").alias("rid"), "text"), F.expr("id <=> rid")).where(squeezed(F.col("text")) == F.col("bytes"))
    groups = full.groupBy("digest", "bytes").agg(
        F.min(F.struct((-size).alias("s"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))).alias("best"),
        F.count("*").alias("n"),
    )
    moved = odd.join(groups, ["digest", "bytes"]).select(
        F.col("id").alias("mid"), F.col("digest").alias("md"), F.col("best.id").alias("mkeep"), F.col("n").alias("mn")
    )
    gone = groups.groupBy(F.col("digest").alias("gd")).agg(F.sum("n").alias("gn"))
    return (
        found.join(moved, F.expr("id <=> mid AND digest = md"), "left")
        .join(gone, F.col("digest") == F.col("gd"), "left")
        .select(
            "id",
            "digest",
            F.when(F.col("md").isNotNull(), F.col("mkeep")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("mn", F.col("size") - F.coalesce("gn", F.lit(0))).alias("size"),
        )
    )


def exact_dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged.

    It is the row of the most code points, then of the least id (null last),
    then of the least text; of rows that are the same in these any one.  Null
    and blank texts are one group; an empty table gives an empty result.
    """
    p = prefix(docs)
    keep = exact_groups(docs, id_col, text_col).where("kept")
    keep = keep.select(F.col("doc_id").alias(p + "id"), F.col("text_sha256").alias(p + "digest")).distinct()
    joined = docs.withColumn(p + "own", sha256(squeezed(docs[text_col]))).join(
        keep, F.expr(f"`{id_col}` <=> {p}id AND {p}own = {p}digest")
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    once = W.partitionBy(p + "id", p + "digest").orderBy(F.length(text).desc(), text)
    return joined.withColumn(p + "n", F.row_number().over(once)).where(F.col(p + "n") == 1).select(*docs.columns)
