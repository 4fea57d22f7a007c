"""Replays a table of jobs as job files through the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tracefold.streaming.jobs import job_stream, run_jobs


def replay_jobs(rows: DataFrame, base: str) -> DataFrame:
    """The events of jobs whose build is to name their path."""
    spark, root = rows.sparkSession, f"{base}/{uuid.uuid4().hex}"
    rows.write.json(f"{root}/in")
    run_jobs(job_stream(spark, f"{root}/in"), lambda _, job: job["repo_path"], f"{root}/events", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/events")
