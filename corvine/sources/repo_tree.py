"""Reading a checked-out repository as a table, with the walk's filters."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.config import LIMITS
from corvine.functions import scalars as S
from corvine.functions import values as V
from corvine.scratch import cut


def ignored_by(lines: list[str]) -> list[tuple[str, bool]]:
    """(regular expression over relative paths, negated) of a root ignore file; blank lines and comments drop out."""
    out = []
    for line in [".git", *lines]:
        rule = line.rstrip("\r\n")
        rule = rule.rstrip() if not rule.endswith("\\ ") else rule
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        rooted = "/" in rule
        body = ""
        for part in re.findall(r"\*\*/|/\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+|\[", rule.lstrip("/")):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part.startswith("[") and len(part) > 1 else re.escape(part))
        out.append((f"^{'' if rooted else '(?:.*/)?'}{body}{'/.+' if folder else '(?:/.*)?'}$", negated))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """True where the last matching rule is not negated."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def _contents(root: str):
    """Batches (path) -> (path, content_hash, nul), read where the task runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    data = f.read()
                out.append((path, hashlib.sha256(data).hexdigest(), b"\0" in data[: LIMITS.sniff_bytes]))
            yield pd.DataFrame(out, columns=["path", "content_hash", "nul"])

    return run


def _below(root: str, skipped: frozenset[str]):
    """Batches (folder) -> (path, size_bytes) of all files below; skipped folders are never opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/") + "/"
        for pdf in batches:
            todo = list(pdf["folder"])
            while todo:
                found = store.get_file_info(fs.FileSelector(base + todo.pop()))
                here = [(x.path.removeprefix(base), x.size) for x in found if x.is_file]
                todo += [x.path.removeprefix(base) for x in found if not x.is_file and x.base_name not in skipped]
                yield pd.DataFrame(here, columns=["path", "size_bytes"])

    return run


def read_tree(spark: SparkSession, root: str, *, file_count: int = LIMITS.file_count) -> DataFrame:
    """(path, language, content_hash, size_bytes, reason) of every file; ``reason`` is null for kept ones.

    Spark's own file source leaves out names that start with a dot or an underscore, so folders are listed
    by path: the driver sees the top level only, what lies below is listed and read inside the tasks.
    Folders that are skipped by name are not opened. Names and sizes are filtered before any content is
    opened. Past the cap of files, in path order, the reason is ``file_count``.
    """
    from pyarrow import fs

    root = root if "://" in root else f"file://{root}"
    store, base = fs.FileSystem.from_uri(root)
    base = base.rstrip("/") + "/"
    top = store.get_file_info(fs.FileSelector(base))
    lines = []
    if any(x.is_file and x.base_name == ".gitignore" for x in top):
        with store.open_input_stream(base + ".gitignore") as f:
            lines = f.read().decode("utf-8", "replace").splitlines()
    skipped = frozenset([".git", *V.SKIP_DIRS])
    folders = [(x.base_name,) for x in top if not x.is_file and x.base_name not in skipped]
    files = spark.createDataFrame([(x.base_name, x.size) for x in top if x.is_file], "path string, size_bytes long")
    if folders:
        listed = spark.createDataFrame(folders, "folder string").repartition(len(folders)).mapInPandas(_below(root, skipped), "path string, size_bytes long")
        files = files.unionByName(cut(listed, "listing"))
    name = S.skip_reason(F.col("path"), F.col("size_bytes"))
    early = F.when(name.isin("skip_dir", "skip_file", "secret"), name)
    files = files.withColumn("named", F.coalesce(early, F.when(ignored(F.col("path"), ignored_by(lines)), "ignored"), name))
    read = files.filter("named is null").select("path").repartition("path").mapInPandas(_contents(root), "path string, content_hash string, nul boolean")
    rows = files.join(read, "path", "left").withColumn("reason", F.coalesce("named", F.when(F.col("nul"), "nul")))
    rows = cut(rows, "tree")
    first = rows.filter("reason is null").orderBy("path").limit(file_count).select("path", F.lit(True).alias("first"))
    rows = rows.join(first, "path", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("first").isNull(), "file_count").otherwise(F.col("reason")))
    return rows.select("path", S.detect_language(F.col("path")).alias("language"), F.when(F.col("reason").isNull(), F.col("content_hash")).alias("content_hash"), "size_bytes", "reason")
