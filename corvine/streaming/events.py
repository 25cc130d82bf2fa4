"""Structured Streaming: push events to index requests, and the progress of jobs."""

from __future__ import annotations

import hashlib
import hmac
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.functions import scalars as S
from corvine.operators import dml
from corvine.scratch import shared_dir

PUSH = T.StructType().add("ref", "string").add("deleted", "boolean").add("repository", T.StructType().add("html_url", "string").add("default_branch", "string").add("full_name", "string"))


def signature_ok(secret: str):
    """Pandas UDF (body, signature) -> boolean: HMAC-SHA256 with a constant-time comparison."""

    @F.pandas_udf(T.BooleanType())
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        def one(b, s):
            if not s:
                return False
            made = "sha256=" + hmac.new(secret.encode(), (b or "").encode(), hashlib.sha256).hexdigest()
            return hmac.compare_digest(made.encode(), s.encode())

        return pd.Series([one(b, s) for b, s in zip(body, signature)])

    return check


def index_requests(deliveries: DataFrame, repos: DataFrame, secret: str | None = None) -> DataFrame:
    """(job_id, repo_id, url): verified pushes to the default branch of known repositories.

    ``deliveries`` has id, body and signature, streaming or not; broken bodies, deletions, tags and other
    branches are dropped. Repositories are looked up by their normalized address.
    """
    rows = deliveries if secret is None else deliveries.filter(signature_ok(secret)("body", "signature"))
    rows = rows.select(F.col("id").alias("job_id"), F.from_json("body", PUSH).alias("e"))
    branch = S.branch_of(F.col("e.ref"))
    good = rows.filter((branch != "") & (branch == F.col("e.repository.default_branch")) & ~F.coalesce("e.deleted", F.lit(False)))
    good = good.select("job_id", S.normalize_remote(F.col("e.repository.html_url")).alias("url"))
    known = repos.select(F.col("id").alias("repo_id"), S.normalize_remote(F.col("github_url")).alias("url"))
    return good.join(known, "url").select("job_id", "repo_id", "url")


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, once, into a table of the shared folder, and read the table.

    The checkpoint beside the table makes a rerun after a loss continue where it stopped. In mode
    ``update`` each micro-batch is written as it is and later rows replace earlier ones by ``batch``.
    """
    root = f"{shared_dir(spark)}/corvine/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/rows").outputMode("append").start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/b{number}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    fields = T.StructType([*stream.schema.fields]) if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(fields).option("recursiveFileLookup", mode != "append").parquet(f"{root}/rows")


def job_progress(jobs: DataFrame) -> DataFrame:
    """(repo_id, created_at, status, progress): a streaming latest-per-repository aggregate."""
    at = F.struct("created_at", "id", "status", "progress")
    rows = jobs.filter("repo_id is not null").groupBy("repo_id").agg(F.max(at).alias("j"))
    return rows.select("repo_id", "j.created_at", "j.id", "j.status", S.clamp_progress(F.coalesce("j.progress", F.lit(0))).alias("progress"))


def _run(stream: DataFrame, save, root: str) -> None:
    """Run ``save(batch, number)`` over what is there; the checkpoint lets a rerun continue where it stopped."""
    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def take_once(jobs: DataFrame, spark: SparkSession, root: str | None = None) -> DataFrame:
    """(job_id, repo_id, status): each job of a stream taken once, however often and in whatever batch it comes.

    Jobs without an id or a repository are refused. The table of taken jobs is the only state: a batch
    adds the ids that no other batch added, into a folder of its own, so a batch that runs again after a
    loss writes the same rows again.
    """
    root = root or f"{shared_dir(spark)}/corvine/queue-{uuid.uuid4().hex}"
    rows = jobs.filter("id is not null and repo_id is not null").select(F.col("id").alias("job_id"), "repo_id", "status")
    taken = lambda: spark.read.schema("job_id string, repo_id string, status string, batch long").parquet(f"{root}/taken")

    def save(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["job_id"])
        if number:
            new = new.join(taken().filter(F.col("batch") < number).select("job_id"), "job_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/taken/batch={number}")

    _run(rows, save, root)
    return taken().drop("batch")


def index_changes(files: DataFrame, spark: SparkSession, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, changes): a stream of file rows folded into a snapshot by content hash.

    ``snapshot`` (repo_id, path, id, content_hash, created_at) holds the last row of each path; ``changes``
    (batch, repo_id, path, state) what each batch made of it: new, changed or unchanged. Rows older than
    the snapshot's change nothing. Each batch joins the snapshot of the one before and writes the next,
    so memory does not grow; the last two are kept.
    """
    root = root or f"{shared_dir(spark)}/corvine/index-{uuid.uuid4().hex}"
    rows = files.filter("repo_id is not null and path is not null").select("repo_id", "path", "id", "content_hash", "created_at")
    keys = ["repo_id", "path"]
    at = lambda d: F.struct(F.coalesce(F.unix_micros(F.col(f"{d}.created_at").cast("timestamp")), F.lit(-(2**62))), F.col(f"{d}.id"))
    last = {"number": -1}

    def save(batch: DataFrame, number: int) -> None:
        newest = dml.latest_by(batch, keys)
        old = spark.read.schema(rows.schema).parquet(f"{root}/snapshot/{number - 1}") if number else newest.limit(0)
        both = old.alias("o").join(newest.alias("n"), [F.col("o.repo_id") == F.col("n.repo_id"), F.col("o.path") == F.col("n.path")], "full_outer")
        wins = F.col("o.id").isNull() | (F.col("n.id").isNotNull() & (at("n") > at("o")))
        state = F.when(F.col("o.id").isNull(), "new").when(wins & ~F.col("n.content_hash").eqNullSafe(F.col("o.content_hash")), "changed").otherwise("unchanged")
        both.select(*[F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rows.columns]).write.mode("overwrite").parquet(f"{root}/snapshot/{number}")
        both.filter(F.col("n.path").isNotNull()).select(F.col("n.repo_id").alias("repo_id"), F.col("n.path").alias("path"), state.alias("state")).write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
        if number > 1:
            _drop(spark, f"{root}/snapshot/{number - 2}")
        last["number"] = number

    _run(rows, save, root)
    if last["number"] < 0:
        return spark.createDataFrame([], rows.schema), spark.createDataFrame([], "batch long, repo_id string, path string, state string")
    changes = spark.read.schema("repo_id string, path string, state string, batch long").parquet(f"{root}/changes")
    return spark.read.schema(rows.schema).parquet(f"{root}/snapshot/{last['number']}"), changes.select("batch", "repo_id", "path", "state")
