"""Import graph: dependencies, bounded reverse reach, roll-ups, diagrams, and resolution of imports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.config import LIMITS
from corvine.functions import scalars as S
from corvine.scratch import cut

JS_SUFFIXES = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
PY_SUFFIXES = (".py", ".pyi", "/__init__.py", "/__init__.pyi")


def clean_edges(edges: DataFrame) -> DataFrame:
    """(source, target, type) once each, without self-edges and null ends."""
    rows = edges.select(F.col("source_file_id").alias("source"), F.col("target_file_id").alias("target"), F.col("edge_type").alias("type"))
    return rows.filter(F.col("source") != F.col("target")).distinct()


def repo_graph(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, nodes, edges): files of each repository and edges that start in it."""
    nodes = files.groupBy("repo_id").agg(F.countDistinct("id").alias("nodes"))
    owner = files.select(F.col("id").alias("source"), "repo_id").distinct()
    started = clean_edges(edges).join(owner, "source").groupBy("repo_id").agg(F.count("*").alias("edges"))
    return nodes.join(started, "repo_id", "left").select("repo_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def dependencies(files: DataFrame, edges: DataFrame, limit: int = LIMITS.dependencies, only: DataFrame | None = None) -> DataFrame:
    """(file_id, direction, path): up to ``limit`` imports and importers of every file, by path.

    With ``only`` (file_id) just those of the given files, whose edges are picked before anything else.
    The window only keeps the first rows of each group (a group limit runs before the shuffle).
    """
    if only is not None:
        starts = edges.join(only.select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_semi")
        edges = starts.unionByName(edges.join(only.select(F.col("file_id").alias("target_file_id")), "target_file_id", "left_semi"))
    e = clean_edges(edges).select("source", "target").distinct()
    paths = files.select("id", "path").dropDuplicates(["id"])
    out = e.select(F.col("source").alias("file_id"), F.lit("imports").alias("direction"), F.col("target").alias("id"))
    into = e.select(F.col("target").alias("file_id"), F.lit("imported_by").alias("direction"), F.col("source").alias("id"))
    rows = out.unionByName(into).join(paths, "id").join(paths.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    if only is not None:
        rows = rows.join(only.select("file_id"), "file_id", "left_semi")
    order = Window.partitionBy("file_id", "direction").orderBy("path", "id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select("file_id", "direction", "path")


def reverse_reach(edges: DataFrame, roots: DataFrame, depth: int = LIMITS.impact_depth, visited: int = LIMITS.impact_visited) -> DataFrame:
    """(root, id, depth): files that reach a root over reversed edges within ``depth`` (clamped to 1..5).

    Level-synchronous: each level is one join and one anti join against what was seen, for all roots at
    once, and its lineage is cut. The reversed edges are written once and read by every level. A root
    keeps the first ``visited`` files by (depth, id); one that is full takes no further part, so a hot
    library is not walked whole. The root itself is left out. ``roots`` has a column ``root``.
    """
    depth = max(1, min(depth, LIMITS.impact_max_depth))
    back = cut(clean_edges(edges).select(F.col("target").alias("at"), F.col("source").alias("id")).distinct(), "edges")
    seen = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct()
    front, left = seen, roots.select("root", F.lit(visited).cast("long").alias("left")).distinct()
    order = Window.partitionBy("root").orderBy("id")
    for level in range(1, depth + 1):
        step = front.select("root", F.col("id").alias("at")).join(left.filter("left > 0").select("root"), "root", "left_semi").join(back, "at").select("root", "id").distinct()
        step = step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= visited)
        step = step.join(left, "root").filter(F.col("n") <= F.col("left"))
        front = cut(step.select("root", "id", F.lit(level).alias("depth")), "reach")
        seen = seen.unionByName(front)
        got = front.groupBy("root").agg(F.count("*").alias("got"))
        left = left.join(got, "root", "left").select("root", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"))  # a row for each root
    return seen.filter("depth > 0").select("root", "id", "depth")


def impact(files: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = LIMITS.impact_depth) -> DataFrame:
    """(root, id, path, language, depth) of ``reverse_reach`` with paths; unknown files drop out."""
    named = files.select("id", "path", "language").dropDuplicates(["id"])
    return reverse_reach(edges, roots, depth).join(named, "id").select("root", "id", "path", "language", "depth")


def rings(reach: DataFrame) -> DataFrame:
    """(root, depth, files): sizes of the rings around each root."""
    return reach.groupBy("root", "depth").agg(F.count("*").alias("files"))


def reach_summary(reach: DataFrame, roots: DataFrame, visited: int = LIMITS.impact_visited) -> DataFrame:
    """(root, affected, reached_depth, truncated); zero for roots that nothing imports."""
    seen = reach.groupBy("root").agg(F.count("*").alias("affected"), F.max("depth").alias("reached_depth"))
    rows = roots.select("root").distinct().join(seen, "root", "left")
    return rows.select("root", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("reached_depth", F.lit(0)).alias("reached_depth"), (F.coalesce("affected", F.lit(0)) >= visited).alias("truncated"))


def blast_label(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, importers, label): HIGH above five direct importers, LOW up to two, else null."""
    n = clean_edges(edges).select("source", "target").distinct().groupBy(F.col("target").alias("file_id")).agg(F.count("*").alias("importers"))
    rows = files.select(F.col("id").alias("file_id")).distinct().join(n, "file_id", "left").withColumn("importers", F.coalesce("importers", F.lit(0)))
    return rows.withColumn("label", F.when(F.col("importers") > 5, "HIGH").when(F.col("importers") <= 2, "LOW"))


def directory_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, source_dir, target_dir, edges): edges between directories of one repository."""
    nodes = files.select("id", "repo_id", S.directory(F.regexp_replace("path", r"\\", "/")).alias("dir")).dropDuplicates(["id"])
    e = clean_edges(edges).select("source", "target").distinct()
    s = nodes.select(F.col("id").alias("source"), "repo_id", F.col("dir").alias("source_dir"))
    t = nodes.select(F.col("id").alias("target"), F.col("repo_id").alias("target_repo"), F.col("dir").alias("target_dir"))
    rows = e.join(s, "source").join(t, "target").filter((F.col("repo_id") == F.col("target_repo")) & (F.col("source_dir") != F.col("target_dir")))
    return rows.groupBy("repo_id", "source_dir", "target_dir").agg(F.count("*").alias("edges"))


def diagram_lines(files: DataFrame, edges: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """(repo_id, mode, part, dir, kind, path, line): the lines of each repository's flowchart.

    Ordered by (part, dir, kind, path, line) they are its text: a header, the boxes (of directories with
    their files, each closed; or just directories above 80 files), and the arrows. Lines stay rows, so a
    huge repository never becomes one value. Repositories of ``repos`` without files get a placeholder.
    """
    nodes = files.select("id", "repo_id", F.regexp_replace("path", r"\\", "/").alias("path")).dropDuplicates(["id"])
    mode = nodes.groupBy("repo_id").agg(F.when(F.count("*") > LIMITS.diagram_files, "directories").otherwise("files").alias("mode"))
    rows = nodes.join(mode, "repo_id").withColumn("dir", S.directory(F.col("path")))
    no = F.lit("")

    def lines(df: DataFrame, part: int, dir_: Column, kind: int, path: Column, line: Column) -> DataFrame:
        return df.select("repo_id", "mode", F.lit(part).alias("part"), dir_.alias("dir"), F.lit(kind).alias("kind"), path.alias("path"), line.alias("line"))

    named = lambda c: S.diagram_id(F.concat(F.lit("dir_"), c))
    shown = lambda name, label: F.concat(name, F.lit('["'), S.diagram_label(label), F.lit('"]'))
    dirs = rows.select("repo_id", "mode", "dir").distinct()
    in_files, in_dirs = F.col("mode") == "files", F.col("mode") == "directories"
    d = F.col("dir")
    e = clean_edges(edges).select("source", "target").distinct()
    arrow = lambda a, b: F.concat(F.lit("  "), a, F.lit(" --> "), b)
    arrows = e.join(rows.filter(in_files).select(F.col("id").alias("source"), "repo_id", "mode"), "source")
    between = directory_edges(files, edges).join(mode.filter(in_dirs), "repo_id")
    parts = [
        lines(mode, 0, no, 0, no, F.lit("flowchart LR")),
        lines(dirs.filter(in_files), 1, d, 0, no, F.concat(F.lit("  subgraph "), shown(named(d), d))),
        lines(rows.filter(in_files), 1, d, 1, F.col("path"), F.concat(F.lit("    "), shown(S.diagram_id(F.col("id")), S.basename(F.col("path"))))),
        lines(dirs.filter(in_files), 1, d, 2, no, F.lit("  end")),
        lines(dirs.filter(in_dirs), 1, d, 0, no, F.concat(F.lit("  "), shown(named(d), d))),
        lines(arrows, 2, no, 0, no, arrow(S.diagram_id(F.col("source")), S.diagram_id(F.col("target")))),
        lines(between, 2, no, 0, no, arrow(named(F.col("source_dir")), named(F.col("target_dir")))),
    ]
    if repos is not None:
        bare = repos.select(F.col("id").alias("repo_id")).distinct().join(mode, "repo_id", "left_anti").withColumn("mode", F.lit("empty"))
        parts += [lines(bare, 0, no, 0, no, F.lit("flowchart LR")), lines(bare, 1, no, 0, no, F.lit("  empty[No files indexed yet]"))]
    return functools.reduce(DataFrame.unionByName, parts)


def diagram_texts(lines: DataFrame) -> DataFrame:
    """(repo_id, text) of the charts of files and of nothing, which have at most 80 files and the arrows among them."""
    few = lines.filter(F.col("mode") != "directories")
    sorted_ = F.array_sort(F.collect_list(F.struct("part", "dir", "kind", "path", "line")))
    return few.groupBy("repo_id").agg(F.array_join(F.transform(sorted_, lambda x: x["line"]), "\n").alias("text"))


def rebuild_edges(edges: DataFrame, files: DataFrame, repos: DataFrame, found: DataFrame) -> DataFrame:
    """(source_file_id, target_file_id, edge_type): the edges after those of ``repos`` (repo_id) were replaced by ``found``.

    An edge belongs to the repository of its source. New edges count once, self-edges and edges to or
    from unknown files drop out.
    """
    keys = ["source_file_id", "target_file_id", "edge_type"]
    known = files.select(F.col("id").alias("source_file_id"), "repo_id").distinct()
    gone = known.join(repos.select("repo_id").distinct(), "repo_id", "left_semi").select("source_file_id")
    new = found.select(*keys).filter("source_file_id <> target_file_id").distinct()
    new = new.join(gone, "source_file_id", "left_semi").join(known.select(F.col("source_file_id").alias("target_file_id")), "target_file_id", "left_semi")
    return edges.join(gone, "source_file_id", "left_anti").select(*keys).unionByName(new.select(*keys))


def normal_path(path: Column) -> Column:
    """A relative path with ``.`` and ``..`` segments folded; null where it would leave the root."""
    folded = F.aggregate(
        F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit("//")))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(~F.array_contains(folded, "//"), F.array_join(folded, "/"))


def _first_known(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(repo_id, source, target): of the files a reference's base may mean, the first; self-edges dropped.

    Instead of spelling out every candidate of each reference, each file is listed under the few bases
    that lead to it, with the place it takes in the order of candidates.
    """
    met = refs.select("repo_id", F.col("path").alias("source"), "specifier", "base").filter("base is not null").join(keys, ["repo_id", "base"])
    first = met.groupBy("repo_id", "source", "specifier").agg(F.min_by("target", "pos").alias("target"))
    return first.filter(F.col("source") != F.col("target")).select("repo_id", "source", "target").distinct()


def _keys(files: DataFrame, tails: list[str]) -> DataFrame:
    """(repo_id, base, pos, target): bases b with b + tails[pos] == path, of non-empty b."""
    path = F.col("path")
    found = [F.when(path.endswith(x) & (F.length(path) > len(x)), F.struct(F.substring(path, 1, F.length(path) - len(x)).alias("base"), F.lit(i).alias("pos"))) for i, x in enumerate(tails)]
    rows = files.select("repo_id", "path").distinct()
    return rows.select("repo_id", path.alias("target"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("k")).select("repo_id", "k.base", "k.pos", "target")


def _beside(path: Column) -> Column:
    return F.when(S.directory(path) == "(root)", F.lit("")).otherwise(S.directory(path))


def resolve_js(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Relative script imports: the path itself, with eight extensions, and as folders with an index file."""
    refs = refs.filter(F.col("specifier").startswith("."))
    base = normal_path(F.concat(_beside(F.col("path")), F.lit("/"), F.col("specifier")))
    return _first_known(refs.withColumn("base", base), _keys(files, [*JS_SUFFIXES, *(f"/index{x}" for x in JS_SUFFIXES[1:])]))


def resolve_python(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Relative Python imports: n dots go up n - 1 folders, then a module or a package."""
    refs = refs.filter(F.col("specifier").startswith("."))
    dots = F.length(F.regexp_extract("specifier", r"^(\.+)", 1))
    rest = F.replace(F.regexp_extract("specifier", r"^\.+(.*)$", 1), F.lit("."), F.lit("/"))
    base = normal_path(F.concat(_beside(F.col("path")), F.lit("/"), F.repeat(F.lit("../"), dots - 1), rest))
    return _first_known(refs.withColumn("base", base), _keys(files, list(PY_SUFFIXES)))


def relative_specifiers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, path, specifier): for each edge inside a repository the relative path from source to target."""
    nodes = files.select("id", "repo_id", "path").dropDuplicates(["id"])
    s = nodes.select(F.col("id").alias("source"), "repo_id", "path")
    t = nodes.select(F.col("id").alias("target"), F.col("repo_id").alias("target_repo"), F.col("path").alias("to"))
    e = clean_edges(edges).join(s, "source").join(t, "target").filter(F.col("repo_id") == F.col("target_repo"))
    up = F.size(F.split("path", "/")) - 1
    return e.select("repo_id", "path", F.concat(F.when(up > 0, F.repeat(F.lit("../"), up)).otherwise(F.lit("./")), "to").alias("specifier")).distinct()
