"""Operational reports over repositories, files, jobs and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.config import LIMITS
from corvine.functions import scalars as S
from corvine.operators.dml import latest_by


def count_files(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.countDistinct("id").cast("int").alias("n_files"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """(repo_id, job_id, job_status, progress): each repository's last job."""
    rows = latest_by(jobs, ["repo_id"])
    return rows.select("repo_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"), F.coalesce("progress", F.lit(0)).alias("progress"))


def list_repos(repos: DataFrame, files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Repositories with their number of files, last job, kind and label of their status, and activity."""
    rows = repos.join(count_files(files).withColumnRenamed("repo_id", "id"), "id", "left").join(latest_jobs(jobs).withColumnRenamed("repo_id", "id"), "id", "left")
    shown = F.coalesce("job_status", "status")
    return rows.select(
        "id", "name", "status", F.coalesce("n_files", F.lit(0)).alias("n_files"), "job_status", F.coalesce("progress", F.lit(0)).alias("progress"),
        S.status_kind(shown).alias("kind"), S.status_label(shown).alias("label"), S.is_active(F.col("status"), F.col("job_status")).alias("active"), "updated_at",
    )


def status_counts(repos: DataFrame, jobs: DataFrame) -> DataFrame:
    """(source, status, n) over repositories and jobs."""
    a = repos.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("repo").alias("source"), "status", "n")
    b = jobs.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("job").alias("source"), "status", "n")
    return a.unionByName(b)


def list_files(files: DataFrame, directory: str, language: str | None = None, limit: int = LIMITS.listed_files) -> DataFrame:
    """(repo_id, path, language, total, truncated): each repository's first files in a directory, by path."""
    from pyspark.sql import Window

    prefix = directory.rstrip("/") + "/"
    rows = files.filter(F.col("path").startswith(prefix) | (F.col("path") == directory))
    if language is not None:
        rows = rows.filter(F.col("language") == language)
    totals = rows.groupBy("repo_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("repo_id").orderBy("path", "id")
    first = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    return first.join(totals, "repo_id").select("repo_id", "path", "language", "total", (F.col("total") > limit).alias("truncated"))


def find_files(files: DataFrame, text: str) -> DataFrame:
    """Files with a text in path or language, without case; a blank text finds all."""
    q = text.strip().lower()
    return files.filter(F.lower("path").contains(q) | F.coalesce(F.lower("language").contains(q), F.lit(False)))


def read_lines(chunks: DataFrame, start: int, end: int) -> DataFrame:
    """(chunk_id, first, last, text): a range of lines, at most 400 of them and then 8000 characters."""
    lines = F.split("content", "\n")
    first = F.greatest(F.lit(1), F.lit(start))
    last = F.least(F.size(lines), F.lit(end), first + LIMITS.read_lines - 1)
    part = F.when(last >= first, F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")).otherwise("")
    return chunks.select(F.col("id").alias("chunk_id"), first.alias("first"), last.alias("last"), F.substring(part, 1, LIMITS.read_chars).alias("text"))


def list_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, repo_id, title, n_messages, last_at, updated_at): updated_at is never before the last message."""
    seen = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("n_messages"), F.max("created_at").alias("last_at"))
    rows = conversations.join(seen, "id", "left")
    return rows.select("id", "repo_id", F.substring("title", 1, 200).alias("title"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "last_at", F.greatest("updated_at", "last_at").alias("updated_at"))


def retitled(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, title): default or very short titles give way to the start of the first user message."""
    first = messages.filter((F.lower(F.trim("role")) == "user") & F.col("created_at").isNotNull()).groupBy(F.col("conversation_id").alias("id")).agg(
        F.min_by("content", F.struct("created_at", F.col("id").alias("message_id"))).alias("said")
    )
    poor = (F.col("title") == "New conversation") | (F.length(F.coalesce("title", F.lit(""))) < 8)
    rows = conversations.join(first, "id", "left")
    return rows.select("id", F.when(poor & F.col("said").isNotNull() & (F.col("said") != ""), F.substring("said", 1, 60)).otherwise(F.col("title")).alias("title"))


def language_facets(files: DataFrame) -> DataFrame:
    """(extension, language, files, bytes): facets by detected language."""
    rows = files.select(S.extension(F.col("path")).alias("extension"), S.detect_language(F.col("path")).alias("language"), "size_bytes")
    return rows.groupBy("extension", "language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def repo_sizes(files: DataFrame) -> DataFrame:
    """(repo_id, bytes, megabytes, too_large, truncated) against the limits of size and number of files."""
    rows = files.groupBy("repo_id").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("n"))
    return rows.select("repo_id", "bytes", F.round(F.col("bytes") / 1048576, 3).alias("megabytes"), (F.col("bytes") > LIMITS.repo_bytes).alias("too_large"), (F.col("n") > LIMITS.file_count).alias("truncated"))


def markdown_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, kind, body, items): blocks between blank lines, classified; blank blocks drop out."""
    blocks = rows.select(key, F.posexplode(F.split(text, r"\n{2,}")).alias("block", "body")).withColumn("body", S.wide_trim(F.col("body"))).filter("body <> ''")
    body = F.col("body")
    kind = F.when(body.startswith("### "), "h3").when(body.startswith("## "), "h2").when(body.startswith("# "), "h1").when(body.rlike(r"^\s*[-*]\s"), "ul").otherwise("p")
    items = F.when(kind == "ul", F.size(F.filter(F.split(body, r"\n+"), lambda x: x.rlike(r"^\s*[-*]\s")))).otherwise(0)
    return blocks.select(key, "block", kind.alias("kind"), "body", items.alias("items"))
