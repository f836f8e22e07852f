"""Extension: results and responses as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyquill.operators.latest import keep_last


def first_deliveries(stream: DataFrame, key: str = "resp_id", time: str = "received_at", late: str = "1 hour") -> DataFrame:
    """Rows sent twice within the watermark come out once."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


BUCKETS = 64


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Of each bucket of a table its versions, in order; at most BUCKETS folders
    of a few versions each are listed."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folders = lambda at, prefix: {int(f.getPath().getName()[len(prefix) :]): f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(prefix)}
    return {b: sorted(folders(at, "_version=")) for b, at in folders(root, "_bucket=").items()} if fs.exists(root) else {}


def read_last(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it stands: of each bucket the latest version; None if there
    is none yet."""
    at = [f"{path}/_bucket={b}/_version={vs[-1]}" for b, vs in _versions(spark, path).items() if vs]
    return spark.read.parquet(*at) if at else None


def keep_last_table(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps a table of last rows in buckets by key. A micro-batch reads and
    writes only the buckets its keys fall into, as a new version beside the one
    before; older versions are removed, so a reader has one batch of time. A
    batch done again overwrites its own version."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.hash(*keys), F.lit(buckets))
        rows = keep_last(batch, keys, order).withColumn("_bucket", bucket).persist()
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most `buckets`
        held = {b: [v for v in vs if v < epoch] for b, vs in _versions(spark, path).items() if b in touched}
        old = [f"{path}/_bucket={b}/_version={vs[-1]}" for b, vs in held.items() if vs]
        both = rows.drop("_bucket")
        if old:
            both = keep_last(both.unionByName(spark.read.parquet(*old)), keys, order)
        out = both.withColumn("_bucket", bucket).withColumn("_version", F.lit(epoch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(path)
        rows.unpersist()
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for b, vs in held.items():
            for v in vs[:-1]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_bucket={b}/_version={v}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
