"""A change log as a stream: JSON-line segments in, tables kept up to date by key, each change applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGE = "lsn bigint, ts timestamp, table_name string, row_id bigint, operation string, new_values map<string,string>"


def read_changes(spark: SparkSession, path: str, per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_batch).json(path)


def append_changes(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").json(path)


def applied(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state (row_id, lsn, deleted, values) after the changes.

    Changes that the state has seen by their lsn have no effect, so a batch may come again. Deleted rows stay as
    marks: a change from before the deletion must not bring them back.
    """
    seen = state.select("row_id", F.col("lsn").alias("seen"))
    new = changes.join(seen, "row_id", "left").where("seen IS NULL OR lsn > seen").dropDuplicates(["row_id", "lsn"])
    events = new.select("row_id", "lsn", "operation", F.coalesce("new_values", F.create_map().cast("map<string,string>")).alias("values"))
    old = state.select("row_id", "lsn", F.when(F.col("deleted"), "delete").otherwise("insert").alias("operation"), "values")
    both = old.unionByName(events)
    reset = F.max(F.when(F.col("operation") != "update", F.col("lsn"))).over(Window.partitionBy("row_id"))
    live = both.withColumn("reset", reset).where("reset IS NULL OR lsn >= reset")
    cells = live.select("row_id", "lsn", "operation", F.explode_outer("values").alias("k", "v"))
    last = cells.groupBy("row_id", "k").agg(F.max_by(F.struct("v"), "lsn")["v"].alias("v"), F.max("lsn").alias("lsn"), F.max_by("operation", "lsn").alias("operation"))
    entries = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
    out = last.groupBy("row_id").agg(F.max("lsn").alias("lsn"), (F.max_by("operation", "lsn") == "delete").alias("deleted"), F.map_from_entries(entries).alias("values"))
    return out.withColumn("values", F.when(F.col("deleted"), F.create_map().cast("map<string,string>")).otherwise(F.col("values")))


def follow(spark: SparkSession, source: str, target: str, table: str, checkpoint: str, listener: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Applies a table's changes as they come; each batch writes the next version of ``target`` (a folder per batch)."""

    def apply(batch: DataFrame, epoch: int) -> None:
        mine = batch.where(F.col("table_name") == table)
        applied(replica(spark, target, epoch), mine).write.mode("overwrite").parquet(f"{target}/v={epoch}")
        if listener is not None:
            listener(mine, epoch)

    return read_changes(spark, source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replica(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The newest state, or the one before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")) if fs.exists(path) else []
    found = [v for v in found if before is None or v < before]
    schema = "row_id bigint, lsn bigint, deleted boolean, `values` map<string,string>"
    return spark.read.schema(schema).parquet(f"{target}/v={found[-1]}") if found else spark.createDataFrame([], schema)
