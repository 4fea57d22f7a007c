"""Index jobs: a stream of job files, and the state of each job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOB = "job_id string, repo_path string, commit_sha string, force_full boolean"
EVENT = "job_id string, status string, ts timestamp, message string"
STATES = ("pending", "running", "done", "error")


def job_stream(spark: SparkSession, folder: str, most_files: int = 16) -> DataFrame:
    """Jobs from JSON files that appear in ``folder``; the checkpoint remembers which were read."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", most_files).json(folder)


def run_jobs(jobs: DataFrame, build: Callable[[SparkSession, dict], str], events: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Build an index for each job and append its events to the Parquet table ``events``.

    The build itself is a Spark job, so jobs of a batch run one after the other
    on the driver's thread.  A batch that is run again after a failure appends
    its events again; ``latest_states`` reads the last of each job.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        for job in sorted(rows.collect(), key=lambda r: r["job_id"]):  # requests, a handful a trigger
            out = [(job["job_id"], "running", "")]
            try:
                out.append((job["job_id"], "done", str(build(spark, job.asDict()))))
            except Exception as e:  # a failed build is a result
                out.append((job["job_id"], "error", f"{type(e).__name__}: {e}"[:500]))
            made = spark.createDataFrame([(j, s, m, k) for k, (j, s, m) in enumerate(out)], "job_id string, status string, message string, k int")
            made.select("job_id", "status", (F.current_timestamp() + F.make_dt_interval(secs=F.col("k") * F.lit(0.001))).alias("ts"), "message").write.mode("append").parquet(events)

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def latest_states(events: DataFrame, by: str = "job_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last event of each job."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def after_restart(states: DataFrame) -> DataFrame:
    """Jobs that were under way when the service stopped count as failed."""
    broken = F.col("status").isin("pending", "running")
    return states.withColumn("message", F.when(broken, "interrupted by a restart").otherwise(F.col("message"))).withColumn("status", F.when(broken, "error").otherwise(F.col("status")))


def telemetry(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value per time window and type; for streams, with a watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
