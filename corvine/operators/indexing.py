"""One indexing run as one operation: diff, delete, upsert, chunk, imports, edges, embeddings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.operators import chunking, dml, graph, retrieval
from corvine.scratch import cut


class Indexed(NamedTuple):
    """The tables' next snapshots and (repo_id, path, state) of the delivered and the deleted files."""

    files: DataFrame
    chunks: DataFrame
    edges: DataFrame
    states: DataFrame


def index_repositories(files: DataFrame, chunks: DataFrame, edges: DataFrame, incoming: DataFrame, *, dim: int = 64) -> Indexed:
    """Index all repositories of ``incoming`` (id, repo_id, path, language, content_hash, size_bytes, created_at, text) again.

    Paths are unique in ``files`` and in ``incoming``. Files that a delivered repository no longer holds
    are deleted with their chunks and edges; other repositories stay as they are. Files whose hash is
    unchanged keep their chunks and edges; new and changed ones get chunks, imports, edges and embeddings
    anew. A null text has no chunks. Every step is a join or a map over tables; nothing passes through
    the driver, and the shared inputs are written once.
    """
    keys = ["repo_id", "path"]
    incoming = cut(incoming, "incoming")
    repos = incoming.select("repo_id").distinct()
    mine = files.join(repos, "repo_id", "left_semi")
    states = cut(dml.file_diff(mine, incoming), "states")
    orphans = mine.join(states.filter("state = 'orphan'").select(*keys), keys, "left_semi").select("id")
    kept = mine.join(orphans, "id", "left_anti")
    now = cut(dml.upsert_files(kept, incoming), "files")
    todo = now.select("id", *keys).join(states.filter("state in ('new', 'changed')").select(*keys), keys, "left_semi")
    todo = cut(todo.join(incoming.select(*keys, "text"), keys), "todo")

    stale = todo.select("id").unionByName(orphans).distinct()
    docs = todo.select(F.col("id").alias("doc_id"), "path", "text")
    made = chunking.chunk_sources(docs).withColumnRenamed("doc_id", "file_id")
    made = made.withColumn("id", F.sha2(F.concat_ws(":", "file_id", "piece"), 256)).drop("piece")
    made = made.withColumn("embedding", retrieval.hashed_embedding(dim)("content"))
    left = chunks.join(stale.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    next_chunks = left.unionByName(made.select(*[c for c in chunks.columns if c in made.columns]), allowMissingColumns=True)

    owner = now.select(F.col("id").alias("doc_id"), "repo_id")
    refs = chunking.extract_imports(docs).join(owner, "doc_id").select("repo_id", "path", "specifier")
    python = F.col("path").rlike("\\.pyi?$")
    met = graph.resolve_js(refs.filter(~python), now).unionByName(graph.resolve_python(refs.filter(python), now))
    ids = now.select("repo_id", "path", "id")
    found = met.join(ids.select("repo_id", F.col("path").alias("source"), F.col("id").alias("source_file_id")), ["repo_id", "source"])
    found = found.join(ids.select("repo_id", F.col("path").alias("target"), F.col("id").alias("target_file_id")), ["repo_id", "target"])
    ends = ["source_file_id", "target_file_id", "edge_type"]
    old = edges.select(*ends).join(stale.select(F.col("id").alias("source_file_id")), "source_file_id", "left_anti")
    old = old.join(orphans.select(F.col("id").alias("target_file_id")), "target_file_id", "left_anti")
    next_edges = old.select(*ends).unionByName(found.select("source_file_id", "target_file_id", F.lit("import").alias("edge_type")).distinct())
    others = files.join(repos, "repo_id", "left_anti")
    return Indexed(others.select(*now.columns).unionByName(now), next_chunks, next_edges, states)
