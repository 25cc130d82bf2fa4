"""The bounded functions offered to an agent: search, read, list, dependencies, impact, repositories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.config import LIMITS
from corvine.functions import scalars as S
from corvine.operators import graph, reports, retrieval

SEARCH_HITS, SNIPPET_CHARS = 8, 800


def _text(name: str, value: str | None, least: int, most: int) -> str:
    if value is None or not least <= len(value) <= most:
        raise ValueError(f"{name} must have {least} to {most} characters")
    return value


def _number(name: str, value: int, least: int, most: int | None = None) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < least or (most is not None and value > most):
        raise ValueError(f"{name} must be a whole number from {least}" + (f" to {most}" if most is not None else ""))
    return value


def file_lines(files: DataFrame, chunks: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """(file_id, path, first, last, text): a range of lines of every file, put together from its chunks.

    At most 400 lines and then 8000 characters; where chunks overlap, the one with the smaller id wins.
    """
    last = min(end or start + LIMITS.read_lines - 1, start + LIMITS.read_lines - 1)
    rows = chunks.filter("content is not null and start_line is not null").select("file_id", "id", "start_line", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line"))
    rows = rows.withColumn("n", F.col("start_line") + F.col("pos")).filter((F.col("n") >= start) & (F.col("n") <= last))
    rows = rows.groupBy("file_id", "n").agg(F.min_by("line", F.struct("id", "pos")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    shown = rows.groupBy("file_id").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.substring(text, 1, LIMITS.read_chars).alias("text"))
    return shown.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("file_id", "path", "first", "last", "text")


@dataclass(frozen=True)
class Tools:
    """One repository's tables behind bounded functions; out-of-range arguments raise ValueError."""

    repo_id: str
    repos: DataFrame
    files: DataFrame
    chunks: DataFrame
    edges: DataFrame

    def _files(self) -> DataFrame:
        return self.files.filter(F.col("repo_id") == self.repo_id)

    def _chunks(self) -> DataFrame:
        return self.chunks.join(self._files().select(F.col("id").alias("file_id")), "file_id", "left_semi")

    def _root(self, path: str) -> DataFrame:
        return self._files().filter(F.col("path") == _text("path", path, 1, 500)).orderBy("id").limit(1)

    def list_repos(self) -> DataFrame:
        return self.repos.select("id", "name", "status").orderBy("name", "id")

    def search_code(self, query: str, vector: list[float], k: int = SEARCH_HITS) -> DataFrame:
        """(rank, citation, symbol_name, snippet, score, source)."""
        _text("query", query, 1, 500)
        _number("k", k, 1, SEARCH_HITS)
        return cited(retrieval.hybrid_search(self._chunks(), vector, query, k), self.chunks, self.files)

    def read_file(self, path: str, start: int = 1, end: int | None = None) -> DataFrame:
        _number("start", start, 1)
        if end is not None:
            _number("end", end, 1)
        root = self._root(path)
        return file_lines(root, self.chunks.join(root.select(F.col("id").alias("file_id")), "file_id", "left_semi"), start, end)

    def list_files(self, directory: str | None = None, language: str | None = None) -> DataFrame:
        rows = self._files()
        if directory:
            return reports.list_files(rows, _text("directory", directory, 1, 500), language)
        rows = rows if language is None else rows.filter(F.col("language") == _text("language", language, 1, 50))
        return rows.orderBy("path", "id").limit(LIMITS.listed_files).select("repo_id", "path", "language")

    def get_dependencies(self, path: str) -> DataFrame:
        root = self._root(path).select(F.col("id").alias("file_id"))
        return graph.dependencies(self.files, self.edges, only=root)

    def get_impact(self, path: str, depth: int = LIMITS.impact_depth) -> DataFrame:
        """(root, path, language, depth, total): the first 100 affected files and how many there are."""
        _number("depth", depth, 1, LIMITS.impact_max_depth)
        return shown_impact(graph.impact(self.files, self.edges, self._root(path).select(F.col("id").alias("root")), depth))


def shown_impact(reached: DataFrame, limit: int = LIMITS.affected_shown) -> DataFrame:
    """(root, id, path, language, depth, total): the first files of each root by depth and path, and all its files' number."""
    total = reached.groupBy("root").agg(F.count("*").alias("total"))
    order = Window.partitionBy("root").orderBy("depth", "path", "id")
    first = reached.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")
    return first.join(total, "root")


def cited(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(rank, citation, symbol_name, snippet, score, source) of ranked hits."""
    rows = hits.join(chunks.select(F.col("id").alias("chunk_id"), "file_id", "symbol_name", "start_line", "end_line", "content").dropDuplicates(["chunk_id"]), "chunk_id")
    rows = rows.join(files.select(F.col("id").alias("file_id"), "path").dropDuplicates(["file_id"]), "file_id")
    return rows.select("rank", S.citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation"), "symbol_name", S.clipped(F.col("content"), SNIPPET_CHARS).alias("snippet"), "score", "source")
