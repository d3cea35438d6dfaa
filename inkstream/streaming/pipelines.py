"""Structured Streaming: decoding with rejects, tumbling counts, idempotent upserts, retries and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.session import scratch_path

MESSAGE = "k bigint"


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A file stream over ``<root>/<name>.parquet``, with the table's schema."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8)
    if _is_folder(spark, path):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result table, which is written to the shared folder.

    In complete mode each micro-batch replaces the table, in append mode it adds a folder named by its id; a repeated batch leaves
    the same files."""
    spark, place = stream.sparkSession, scratch_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/part={0 if mode == 'complete' else batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    if not _exists(spark, f"{place}/out"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{place}/out")


def daily_counts(spark: SparkSession, root: str, table: str, at: str, key: str) -> DataFrame:
    """(day, key, n) of a stream in complete mode; event time is cast from timestamp_ntz, which watermarks do not take."""
    rows = table_stream(spark, root, table).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 day")
    counts = rows.groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count("*").alias("n"))
    return drain(counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), key, "n"), "complete")


def decode(rows: DataFrame, payload: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects): the payload parsed by schema; a message without a required field is a reject."""
    parsed = rows.withColumn("message", F.from_json(payload, schema))
    good = F.lit(True)
    for name in required:
        good &= F.col(f"message.{name}").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return parsed.where(good), parsed.where(~good)


def decode_counts(spark: SparkSession, root: str) -> DataFrame:
    """(event_type, decoded, rejected) of the event stream."""
    cut = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).when(F.col("event_id") % 11 == 0, "{}").otherwise(F.col("props"))
    rows = table_stream(spark, root, "events").withColumn("message", F.from_json(cut, MESSAGE))
    good = F.col("message.k").isNotNull()
    return drain(rows.groupBy("event_type").agg(F.count_if(good).alias("decoded"), F.count_if(~good).alias("rejected")), "complete")


def retry_or_reject(failed: DataFrame, now, most: int = 3, delay: int = 30) -> tuple[DataFrame, DataFrame]:
    """(retries, rejects) of failed messages (attempt): below ``most`` attempts due again after attempt * delay seconds."""
    again = F.col("attempt") < most
    wait = F.make_interval(secs=F.col("attempt") * F.lit(delay))
    retries = failed.where(again).withColumn("due_at", now + wait).withColumn("attempt", F.col("attempt") + 1)
    return retries, failed.where(~again).withColumn("failed_at", now)


def replay(rejects: DataFrame) -> DataFrame:
    """Rejects as fresh messages."""
    return rejects.drop("failed_at").withColumn("attempt", F.lit(1))


def due_messages(delayed: DataFrame, now, most: int = 100) -> DataFrame:
    """The delayed messages that are due, the longest due first, ties by the other columns, at most ``most``."""
    return delayed.where(F.col("due_at") <= now).orderBy("due_at", *[c for c in delayed.columns if c != "due_at"]).limit(most)


def upsert_sink(path: str, merge):
    """A foreachBatch function that folds each micro-batch into the table at ``path`` by ``merge(state, batch)``.

    Each batch writes a version of its own, so a repeated batch writes the same version again: the sink is idempotent. Only the two
    latest versions are kept, as a batch reads the one before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/version={batch_id - 1}"
        state = spark.read.parquet(before) if batch_id else batch.limit(0)
        merge(state, batch).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        if batch_id > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch_id - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def fold_table(stream: DataFrame, merge) -> DataFrame:
    """Run a stream over what is there, folding each micro-batch into a state table by ``merge``; the last version is returned."""
    spark = stream.sparkSession
    place = scratch_path(spark, "fold")
    q = stream.writeStream.foreachBatch(upsert_sink(f"{place}/state", merge)).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    if last is None or last["batchId"] < 0 or not _exists(spark, f"{place}/state"):
        return merge(spark.createDataFrame([], stream.schema), spark.createDataFrame([], stream.schema))
    return spark.read.parquet(f"{place}/state/version={_last_version(spark, f'{place}/state')}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _last_version(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return max(int(str(x.getPath().getName()).removeprefix("version=")) for x in found)


def latest_by_key(key: str, at: str, tie: str):
    """A merge that keeps each key's row with the latest ``at``, ties by the larger ``tie``."""

    def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
        rows = state.unionByName(batch)
        best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(at, tie)).alias("x"))
        return best.select("x.*")

    return merge
