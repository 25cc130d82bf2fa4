"""Changing tables: diff, upsert, insert-ignore, point updates and cascading deletes as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], at: str = "created_at") -> DataFrame:
    """The last row of each key; ties go to the larger id."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc("id"))
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def file_diff(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(repo_id, path, state): new, changed, unchanged or orphan, by content hash; paths are unique in each."""
    old = existing.select("repo_id", "path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    new = incoming.select("repo_id", "path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("now"))
    both = old.join(new, ["repo_id", "path"], "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "orphan").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return both.select("repo_id", "path", state.alias("state"))


def upsert_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshot after an upsert by (repo_id, path): new language, hash and size; old id and created_at stay."""
    keep = ["id", "created_at"]
    take = ["language", "content_hash", "size_bytes"]
    old = existing.select("repo_id", "path", *[F.col(c).alias(f"old_{c}") for c in keep + take], F.lit(True).alias("was"))
    new = incoming.select("repo_id", "path", *[F.col(c).alias(f"new_{c}") for c in keep + take], F.lit(True).alias("now"))
    both = old.join(new, ["repo_id", "path"], "full_outer")
    pick = [F.coalesce(f"old_{c}", f"new_{c}").alias(c) for c in keep]
    pick += [F.when(F.col("now"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in take]
    return both.select("repo_id", "path", *pick)


def upsert_repo(repos: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Snapshot after an upsert by github_url: status queued and updated_at now; the name is not overwritten."""
    hit = incoming.select("github_url").distinct().withColumn("hit", F.lit(True))
    old = repos.join(hit, "github_url", "left")
    old = old.withColumns({"status": F.when(F.col("hit"), "queued").otherwise(F.col("status")), "updated_at": F.when(F.col("hit"), now).otherwise(F.col("updated_at"))}).drop("hit")
    new = incoming.join(repos.select("github_url"), "github_url", "left_anti").dropDuplicates(["github_url"])
    return old.unionByName(new.withColumns({"status": F.lit("queued"), "updated_at": now}), allowMissingColumns=True)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` that an insert with on-conflict-do-nothing would add: one for each new key."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def insert_rows(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Snapshot after a batch insert: new rows get the table's columns; keys that it holds, or null ones, are left out."""
    new = insert_ignore(existing, incoming.filter(F.col(key).isNotNull()), [key])
    return existing.unionByName(new.select(*[c for c in existing.columns if c in incoming.columns]), allowMissingColumns=True)


def write_back(df: DataFrame, updates: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Snapshot with ``column`` taken from ``updates`` (key, column) where they have a value; unknown keys add nothing."""
    new = updates.select(key, F.col(column).alias("_new")).filter("_new is not null").dropDuplicates([key])
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def delete_repo(tables: dict[str, DataFrame], repos: DataFrame) -> dict[str, DataFrame]:
    """Snapshots of all tables after deleting ``repos`` (repo_id), by chained anti joins along the foreign keys."""
    gone = repos.select("repo_id").distinct()
    files = tables["files"].join(gone, "repo_id", "left_semi").select("id").distinct()
    talks = tables["conversations"].join(gone, "repo_id", "left_semi").select("id").distinct()
    as_ = lambda name, df: df.select(F.col("id").alias(name))
    return {
        "repos": tables["repos"].join(gone.withColumnRenamed("repo_id", "id"), "id", "left_anti"),
        "index_jobs": tables["index_jobs"].join(gone, "repo_id", "left_anti"),
        "files": tables["files"].join(gone, "repo_id", "left_anti"),
        "chunks": tables["chunks"].join(as_("file_id", files), "file_id", "left_anti"),
        "file_edges": tables["file_edges"].join(as_("source_file_id", files), "source_file_id", "left_anti").join(as_("target_file_id", files), "target_file_id", "left_anti"),
        "conversations": tables["conversations"].join(gone, "repo_id", "left_anti"),
        "messages": tables["messages"].join(as_("conversation_id", talks), "conversation_id", "left_anti"),
    }


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Snapshot with the given columns replaced where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def update_jobs(jobs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Jobs after ``updates`` (id, status, progress, error, finished): progress is clamped to 0..100.

    Status cloning stamps started_at, a finished update stamps finished_at; nulls change nothing.
    """
    from corvine.functions.scalars import clamp_progress

    u = updates.select("id", *[F.col(c).alias(f"u_{c}") for c in ("status", "progress", "error", "finished")]).dropDuplicates(["id"])
    rows = jobs.join(u, "id", "left")
    rows = rows.withColumns(
        {
            "status": F.coalesce("u_status", "status"),
            "progress": F.when(F.col("u_progress").isNotNull(), clamp_progress(F.col("u_progress"))).otherwise(F.col("progress")),
            "error": F.coalesce(F.substring("u_error", 1, 2000), F.col("error")),
            "finished_at": F.when(F.coalesce("u_finished", F.lit(False)), now).otherwise(F.col("finished_at")),
            "started_at": F.when(F.col("u_status") == "cloning", now).otherwise(F.col("started_at")),
        }
    )
    return rows.select(*jobs.columns)
