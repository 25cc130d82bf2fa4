"""Golden tests of the core operators and a comparison of every registered query with its SQL."""

import datetime as dt
import decimal
import glob
import hashlib
import hmac
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvine.functions import scalars as S
from corvine.functions.stemming import stem
from corvine.operators import chunking, dml, graph, reports, retrieval, services, tools
from corvine.plans import catalog
from corvine.sources.repo_tree import ignored_by, read_tree
from corvine.streaming import events

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def one(spark, expr, **cols):
    """The value of a column expression over one row."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(0).alias("x")]).select(expr).first()[0]


def plain(x):
    if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)) or "int" in type(x).__name__:
        return round(float(x), 6)
    return x


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(repr([plain(x) for x in r]) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.SQL:
        assert len(got.columns)
        return
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize(
    "path, want",
    [("a/b.ts", "typescript"), ("x.PY", "python"), (r"win\main.GO", "go"), ("Dockerfile", "dockerfile"), ("Makefile", "make"), ("Rakefile", "ruby"), ("a.unknown", None), (".hidden", None), (".gitignore", "config")],
)
def test_detect_language(spark, path, want):
    assert one(spark, S.detect_language(F.col("p")), p=path) == want


@pytest.mark.parametrize("name, want", [(".env", True), (".env.local", True), ("SERVER.PEM", True), ("id_rsa.pub", True), (".npmrc", True), ("credentials.json", True), ("environment.ts", False), ("key.ts", False), ("readme.md", False)])
def test_secret_names(spark, name, want):
    assert one(spark, S.is_secret(F.col("p")), p=f"dir/{name}") is want


@pytest.mark.parametrize("path, want", [("a.png", True), ("b.WOFF2", True), ("m.safetensors", True), ("a.ts", False), ("readme.md", False), (".png", False)])
def test_binary_extensions(spark, path, want):
    assert one(spark, S.has_binary_extension(F.col("p")), p=path) is want


@pytest.mark.parametrize("data, want", [(b"abc\0def", True), (b"plain", False), (b"\x10\x01\x00", True), (b"a" * 8192 + b"\0", False)])
def test_nul_bytes(spark, data, want):
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    assert df.select(S.has_nul(F.col("c"))).first()[0] is want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://github.com/owner/repo", "https://github.com/owner/repo"),
        (" https://github.com/owner/repo.git ", "https://github.com/owner/repo"),
        ("https://github.com/owner/repo/tree/main/src", "https://github.com/owner/repo"),
        ("https://www.github.com/owner/repo", "https://github.com/owner/repo"),
        ("https://gitlab.com/owner/repo", None),
        ("https://github.com/owner", None),
        ("https://github.com/-bad/repo", None),
        ("https://github.com/owner/re$po", None),
        ("no address", None),
        (None, None),
    ],
)
def test_repo_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string").select(S.parse_repo_url(F.col("u"))["normalized_url"])
    assert df.first()[0] == want


@pytest.mark.parametrize("url, want", [("https://github.com/o/r/pull/12", 12), ("https://github.com/o/r/pull/12abc", 12), ("https://github.com/o/r/pull/0", None), ("https://github.com/o/r/issues/3", None), ("https://else.com/o/r/pull/3", None), ("x", None)])
def test_pull_urls(spark, url, want):
    assert one(spark, S.parse_pull_url(F.col("u"))["number"], u=url) == want


@pytest.mark.parametrize("url, want", [("git@github.com:O/R.git", "github.com/o/r"), ("https://www.github.com/O/R/", "github.com/o/r"), ("http://git.example/a/b.git", "git.example/a/b")])
def test_remotes(spark, url, want):
    assert one(spark, S.normalize_remote(F.col("u")), u=url) == want


def test_texts(spark):
    assert one(spark, S.token_estimate(F.col("t")), t="a😀") == 1
    assert one(spark, S.token_estimate(F.col("t")), t="a😀bc") == 2
    assert one(spark, S.clipped(F.col("t"), 3), t="abcd") == "abc…"
    assert one(spark, S.citations(F.col("t")), t="see src/a.ts:4-9 and b.py:1.") == ["src/a.ts:4-9", "b.py:1"]
    assert one(spark, S.diagrams(F.col("t")), t="x\n```mermaid\nA-->B\n```\ny ```mermaid\n") == ["A-->B"]
    assert one(spark, S.html_escape(F.col("t")), t="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"
    parts = '[{"type":"text","text":" a"},{"type":"tool","text":"no"},{"type":"text","text":"b\\n"}]'
    assert one(spark, S.preview_text(F.col("p"), F.lit("c")), p=parts) == "a\nb"
    assert one(spark, S.preview_text(F.col("p"), F.lit("c")), p="{broken") == "c"
    assert one(spark, S.help_topic(F.col("t")), t="How do I SEARCH the index?") == "index"
    assert one(spark, S.title_of(F.col("t")), t="﻿  ") == "New conversation"
    assert one(spark, S.diagram_id(F.col("t")), t="a/b-c") == "n_a_b_c"


def test_stemming():
    want = {"running": "run", "hopping": "hop", "relational": "relat", "generously": "generous", "cries": "cri", "ties": "tie", "happily": "happili", "skies": "sky", "hoping": "hope", "agreed": "agre", "consist": "consist", "knightly": "knight"}
    assert {w: stem(w) for w in want} == want
    assert stem("handles") == stem("handle") and stem("queues") == stem("queue")


def test_query_language():
    assert retrieval.parse_query('alpha "beta gamma" -delta OR epsilon') == [[(["alpha"], False), (["beta", "gamma"], False), (["delta"], True)], [(["epsilon"], False)]]
    assert retrieval.parse_query("the of") == [] and retrieval.parse_query('"open -') == [[(["open"], False)]]


def test_cover_density(spark):
    def score(hits, n):
        rows = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(t).alias("term"), F.lit(w).alias("weight")) for a, t, w in hits])
        return spark.range(1).select(rows.alias("hits")).select(retrieval.cover_density(F.col("hits"), n)).first()[0]

    assert score([(0, 0, 0.4), (5, 0, 0.4)], 1) == pytest.approx(0.8)
    assert score([(0, 0, 0.4), (1, 1, 0.4)], 2) == pytest.approx(0.4)
    assert score([(0, 0, 0.4), (3, 1, 0.4)], 2) == pytest.approx(0.4 / 3)
    assert score([(0, 0, 1.0)], 2) == 0


def hits(spark, ids):
    return spark.createDataFrame([(x, 1.0, i + 1) for i, x in enumerate(ids)], "chunk_id string, score double, rank long")


def test_fusion(spark):
    out = {r["chunk_id"]: r for r in retrieval.fuse(hits(spark, "ABC"), hits(spark, "BAD")).collect()}
    assert out["A"]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and out["A"]["source"] == "both"
    assert out["C"]["source"] == "vector" and out["D"]["source"] == "keyword"
    assert [r["chunk_id"] for r in retrieval.fuse(hits(spark, "ABC"), hits(spark, "BAD")).orderBy("rank").collect()][:2] == ["A", "B"]
    same = retrieval.fuse(hits(spark, "X"), hits(spark, "X")).first()
    assert same["score"] == pytest.approx(2 / 61, abs=1e-9)
    late = retrieval.fuse(hits(spark, [*"abcdefghijklmn", "Z"]), hits(spark, "Z"), top_k=30).orderBy("rank").first()
    assert late["chunk_id"] == "Z" and late["score"] == pytest.approx(1 / 75 + 1 / 61, abs=1e-9)
    assert retrieval.fuse(hits(spark, "ABCDEFGHIJ"), hits(spark, "KLMNOPQRST"), top_k=4).count() == 4
    assert retrieval.fuse(hits(spark, "A").limit(0), hits(spark, "A").limit(0)).count() == 0


def test_vector_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 0.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [nan, 1.0]), ("g", [1.0]), ("h", [inf, 1.0]), ("a", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = [(r["chunk_id"], r["score"]) for r in retrieval.vector_search(df, [1.0, 0.0], 5).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    assert retrieval.vector_search(df.limit(0), [1.0, 0.0]).count() == 0


def edges(spark, pairs):
    return spark.createDataFrame([(f"{s}{t}", s, t, "imports") for s, t in pairs], "id string, source_file_id string, target_file_id string, edge_type string")


def reach(spark, pairs, root, depth=3):
    roots = spark.createDataFrame([(root,)], "root string")
    return {r["id"]: r["depth"] for r in graph.reverse_reach(edges(spark, pairs), roots, depth).collect()}


def test_reverse_reach(spark):
    pairs = [("util", "lib"), ("app", "util"), ("app", "lib"), ("entry", "app"), ("lib", "lib")]
    assert reach(spark, pairs, "lib") == {"util": 1, "app": 1, "entry": 2}
    assert reach(spark, pairs, "lib", 1) == {"util": 1, "app": 1}
    assert reach(spark, pairs, "lib", 0) == {"util": 1, "app": 1}
    assert reach(spark, pairs, "entry") == {}
    assert reach(spark, [("a", "b"), ("b", "c"), ("c", "a")], "a", 9) == {"c": 1, "b": 2}
    roots = spark.createDataFrame([("lib",)], "root string")
    capped = graph.reverse_reach(edges(spark, pairs), roots, 3, visited=2)
    assert {r["id"] for r in capped.collect()} == {"app", "util"}
    assert graph.reach_summary(capped, roots, 2).first()["truncated"]


def test_resolution(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/app.ts", "src/util/index.ts", "src/util/format.ts", "src/lib.js", "pkg/util.py", "pkg/sub/__init__.py", "pkg/sub/inner.py")], "repo_id string, path string")

    def js(path, spec):
        refs = spark.createDataFrame([("r", path, spec)], "repo_id string, path string, specifier string")
        return [r["target"] for r in graph.resolve_js(refs, files).collect()]

    def py(path, spec):
        refs = spark.createDataFrame([("r", path, spec)], "repo_id string, path string, specifier string")
        return [r["target"] for r in graph.resolve_python(refs, files).collect()]

    assert js("src/app.ts", "./util/format") == ["src/util/format.ts"]
    assert js("src/app.ts", "./util") == ["src/util/index.ts"]
    assert js("src/app.ts", "./lib.js") == ["src/lib.js"]
    assert js("src/util/index.ts", ".") == [] and js("src/app.ts", "react") == [] and js("src/app.ts", "../../x") == []
    assert py("pkg/sub/inner.py", "..util") == ["pkg/util.py"]
    assert py("pkg/sub/inner.py", ".") == ["pkg/sub/__init__.py"]
    assert py("pkg/sub/inner.py", "os") == []


def test_text_chunks():
    assert chunking.text_chunks("") == []
    assert chunking.text_chunks(" \n\n") == [(None, "module", 1, 3, " \n\n")]
    assert chunking.text_chunks("a\nb") == [(None, "other", 1, 2, "a\nb")]
    big = "\n\n".join("x" * 1600 for _ in range(4))
    out = chunking.text_chunks(big)
    assert len(out) == 2 and out[0][2] == 1 and out[1][2] > 1 and all(p[3] >= p[2] for p in out)
    assert len(chunking.text_chunks("y" * 20_000)) == 1


def test_split_and_merge():
    piece = ("f", "function", 10, 12, "\n".join(["z" * 3000] * 4))
    out = chunking.split_lines(piece)
    assert [p[2] for p in out] == [10, 12] and all(p[0] == "f" for p in out)
    small = [(None, "function", 1, 1, "a"), ("g", "function", 2, 2, "b"), ("K", "class", 3, 3, "c")]
    assert chunking.merge_small(small) == [("g", "function", 1, 2, "a\nb"), ("K", "class", 3, 3, "c")]
    apart = [("f", "function", 1, 1, "a" * 4000), ("g", "function", 2, 2, "b" * 4000)]
    assert chunking.merge_small(apart) == apart


def test_source_chunks():
    src = "import os\n\n@deco\ndef first():\n" + "    x = 1\n" * 60 + "\nclass Box:\n    def get(self):\n        return 2\n"
    out = chunking.source_chunks("a/b.py", src)
    assert [(p[0], p[1]) for p in out] == [("first", "function"), ("Box", "class")] and out[0][2] == 3
    assert chunking.source_chunks("b.py", "X = 1\n")[0][1] == "module"
    assert chunking.source_chunks("b.py", "def broken(:\n")[0][1] == "other"
    assert chunking.source_chunks("c.ts", "") == []
    ts = "export function alpha() {\n  return '}';\n}\nexport class Beta {\n  go() { return 1; }\n}\n"
    assert [(p[0], p[1], p[2]) for p in chunking.source_chunks("c.ts", ts)] == [("alpha", "function", 1), ("Beta", "class", 4)]
    huge = "function long() {\n" + "  step('abcdefghij');\n" * 2000 + "}\n"
    parts = chunking.source_chunks("d.js", huge)
    assert len(parts) > 1 and [p[2] for p in parts] == sorted(p[2] for p in parts)
    assert chunking.source_chunks("e.md", "hello")[0][1] == "other"


def test_imports():
    ts = "import a from './a';\nimport { b } from \"../b\";\nimport './c.css';\nexport * from './d';\nexport { e } from './e';\nconst f = import('./f');\nconst g = require('./g');\n// import h from './h'\nimport type { I } from './i';\n"
    assert sorted(s for s, _ in chunking.imports_of("x.ts", ts)) == ["../b", "./a", "./c.css", "./d", "./e", "./f", "./i"]
    py = "import os, a.b as c\nfrom . import x\nfrom ..pkg import y\nfrom z import w\nfrom __future__ import annotations\n"
    assert sorted(s for s, _ in chunking.imports_of("x.py", py)) == [".", "..pkg", "a.b", "os", "z"]
    assert chunking.imports_of("x.md", ts) == [] and chunking.imports_of("x.py", "def (") == []


def test_changing_tables(spark):
    shape = "id string, repo_id string, path string, language string, content_hash string, size_bytes long, created_at timestamp"
    t0, t1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    old = spark.createDataFrame([("1", "r", "a", "go", "h1", 1, t0), ("2", "r", "b", "go", "h2", 1, t0), ("3", "r", "c", "go", "h3", 1, t0)], shape)
    new = spark.createDataFrame([("7", "r", "a", "go", "h1", 1, t1), ("8", "r", "b", None, "h9", 5, t1), ("9", "r", "d", "go", "h4", 1, t1)], shape)
    assert {r["path"]: r["state"] for r in dml.file_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "orphan", "d": "new"}
    after = {r["path"]: r for r in dml.upsert_files(old, new).collect()}
    assert after["b"]["id"] == "2" and after["b"]["created_at"] == t0 and after["b"]["language"] is None and after["b"]["size_bytes"] == 5
    assert after["c"]["id"] == "3" and after["d"]["id"] == "9"
    jobs = spark.createDataFrame([("j", "queued", 5, None, None, None)], "id string, status string, progress int, error string, started_at timestamp, finished_at timestamp")
    up = spark.createDataFrame([("j", "cloning", 140.2, None, None)], "id string, status string, progress double, error string, finished boolean")
    got = dml.update_jobs(jobs, up, F.lit(t1)).first()
    assert (got["status"], got["progress"], got["started_at"], got["finished_at"]) == ("cloning", 100, t1, None)


def test_signature(spark):
    sign = "sha256=" + hmac.new(b"s", b"body", hashlib.sha256).hexdigest()
    rows = [("body", sign), ("body!", sign), ("body", None), ("body", "sha256=00"), (None, sign)]
    df = spark.createDataFrame(rows, "b string, s string")
    assert [r[0] for r in df.select(events.signature_ok("s")("b", "s")).collect()] == [True, False, False, False, False]


def test_tree(spark, tmp_path):
    for name, data in {
        "real.txt": b"hello", "src/index.ts": b"export {}", "src/util.py": b"x = 1", "node_modules/m/i.js": b"1", ".git/HEAD": b"ref", "logo.png": b"\x89PNG",
        "yarn.lock": b"lock", ".env": b"SECRET=1", "ignored.txt": b"no", ".gitignore": b"ignored.txt\n*.log\n!keep.log\n", "a.log": b"l", "keep.log": b"k", "nul.dat": b"a\0b",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r["path"]: r for r in read_tree(spark, str(tmp_path)).collect()}
    kept = {p for p, r in got.items() if r["reason"] is None}
    assert kept == {"real.txt", "src/index.ts", "src/util.py", ".gitignore", "keep.log"}
    assert got["real.txt"]["content_hash"] == hashlib.sha256(b"hello").hexdigest()
    assert got["nul.dat"]["reason"] == "nul" and got["src/index.ts"]["language"] == "typescript"
    assert len(ignored_by(["build/", "# note", "", "/top"])) == 3


def test_reports_edges(spark):
    chunks = spark.createDataFrame([("a", "1\n2\n3"), ("b", "")], "id string, content string")
    got = {r["chunk_id"]: (r["first"], r["last"], r["text"]) for r in reports.read_lines(chunks, 2, 9).collect()}
    assert got == {"a": (2, 3, "2\n3"), "b": (2, 1, "")}


def small_corpus(spark):
    repos = spark.createDataFrame([("r", "https://git.example/o/r", "o/r", "queued", "main", None, None)], "id string, github_url string, name string, status string, default_branch string, last_indexed_at timestamp, updated_at timestamp")
    files = spark.createDataFrame([(x, "r", f"src/{x}.ts", "typescript") for x in "abc"], "id string, repo_id string, path string, language string")
    chunks = spark.createDataFrame([("k1", "a", "alpha", 1, 2, "one\ntwo", [1.0, 0.0]), ("k2", "a", None, 3, 3, "three", [0.0, 1.0]), ("k3", "b", None, 1, 1, "alpha", [1.0, 1.0])], "id string, file_id string, symbol_name string, start_line int, end_line int, content string, embedding array<float>")
    return tools.Tools("r", repos, files, chunks, edges(spark, [("b", "a"), ("c", "b")]))


def test_tools(spark):
    t = small_corpus(spark)
    assert [r["citation"] for r in t.search_code("alpha", [1.0, 0.0]).orderBy("rank").collect()][0] == "src/a.ts:1-2"
    assert [tuple(r)[2:] for r in t.read_file("src/a.ts", 2, 3).collect()] == [(2, 3, "two\nthree")]
    assert t.read_file("src/none.ts").count() == 0 and t.list_files("src/").count() == 3 and t.list_files(language="go").count() == 0
    assert {(r["direction"], r["path"]) for r in t.get_dependencies("src/b.ts").collect()} == {("imports", "src/a.ts"), ("imported_by", "src/c.ts")}
    assert {(r["path"], r["depth"], r["total"]) for r in t.get_impact("src/a.ts").collect()} == {("src/b.ts", 1, 2), ("src/c.ts", 2, 2)}
    for bad in (lambda: t.search_code("", [1.0]), lambda: t.search_code("x", [1.0], 0), lambda: t.search_code("x", [1.0], 999), lambda: t.read_file("x", 0), lambda: t.get_impact("x", 6), lambda: t.get_impact("")):
        with pytest.raises(ValueError):
            bad()


def test_services(spark):
    t = small_corpus(spark)
    now = F.lit(dt.datetime(2026, 1, 1))
    ready = services.mark_repo(t.repos, "r", "ready", now).first()
    assert ready["status"] == "ready" and ready["last_indexed_at"] == ready["updated_at"] == dt.datetime(2026, 1, 1)
    with pytest.raises(ValueError):
        services.mark_repo(t.repos, "r", "odd", now)
    assert services.repo_by_url(t.repos, "git@git.example:O/R.git").count() == 1
    pulls = spark.createDataFrame([("p", "a.ts", "modified", 1, 2, "x" * 1600), ("p", "b.png", "added", 0, 0, None)], "pull_id string, filename string, status string, additions int, deletions int, patch string")
    row = services.pull_request_files(pulls).first()
    assert row["n_files"] == 2 and "… (patch truncated)" in row["sections"] and row["sections"].endswith("*(binary file or patch unavailable)*")
    assert one(spark, services.ask_with_context(F.col("q"), F.lit("a.ts"), F.lit(None).cast("string")), q="Why?") == "Why?"
    queue = spark.createDataFrame([("1",)], "job_id string")
    assert [r[0] for r in services.enqueue(queue, spark.createDataFrame([("1",), ("2",), ("2",)], "job_id string")).collect()] == ["2"]


def test_hybrid_search_is_stemmed_for_a_query(spark):
    rows = [("k1", None, "it handles opened files", [1.0, 0.0]), ("k2", None, "the open door of widgets", [0.0, 1.0]), ("k3", None, "nothing", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, symbol_name string, content string, embedding array<float>")

    def found(terms):
        return {r["chunk_id"] for r in retrieval.hybrid_search(df, [1.0, 0.0], terms).collect() if r["keyword_rank"]}

    assert found("handle open") == {"k1"} and found("open -widget") == {"k1"} and found('"handle open" OR widget') == {"k1", "k2"}
    assert found(["handle", "open"]) == {"k2"}
    t = small_corpus(spark)
    assert t.search_code('"alphas"', [0.0, 1.0]).filter("source = 'both'").count() == 2


def test_full_text(spark):
    rows = [("a", "handleQueue", "it handles one queue and another queue"), ("b", None, "handling the queues"), ("c", None, "a widget handles it"), ("d", None, "nothing here"), ("e", None, None), ("f", None, "the shard queue"), ("g", None, "shard of queue")]
    df = spark.createDataFrame(rows, "id string, symbol_name string, content string")

    def found(query):
        return {r["chunk_id"]: r["score"] for r in retrieval.full_text_search(df, query).collect()}

    assert set(found("handles")) == {"a", "b", "c"} and set(found("handle -widget")) == {"a", "b"}
    assert set(found('"shard queue"')) == {"f"} and set(found("shard OR widgets")) == {"c", "f", "g"}
    assert found("queue")["a"] == pytest.approx(0.8) and found("handled queue")["b"] == pytest.approx(0.4 / 2)
    assert found("the of") == {} and found("") == {}


def test_segments_and_server(spark):
    cases = {
        "plain": [("text", "plain")], "a\n```mermaid\nx --> y\n```\nb": [("text", "a\n"), ("mermaid", "x --> y"), ("text", "\nb")], "```mermaid\nq\n```": [("mermaid", "q")],
        "```mermaid\n \n```": [], "see ```mermaid\nopen": [("text", "see ```mermaid\nopen")], "": [], "```mermaid\r\na\r\n``````mermaid\nb\n```": [("mermaid", "a"), ("mermaid", "b")],
    }
    for text, want in cases.items():
        assert [tuple(r) for r in one(spark, S.segments(F.col("t")), t=text)] == want
    assert one(spark, S.trimmed_server(F.col("t")), t="http://a.example:3000//") == "http://a.example:3000"


def test_review_message(spark):
    files = spark.createDataFrame([(1, "a.py", "modified", 3, 1, "+x"), (1, "b.png", "added", 0, 0, None)], "pull_id long, filename string, status string, additions long, deletions long, patch string")
    pulls = spark.createDataFrame([(1, "Fix it", "o/r", "dev", "main", 3, 1, 2, "open", False, "b" * 900), (2, "None", "o/r", "dev", "main", 0, 0, 1, "closed", True, "  ")], "pull_id long, title string, repo string, head string, base string, additions long, deletions long, changed long, state string, merged boolean, body string")
    got = {r["pull_id"]: r["message"] for r in services.pull_request_message(pulls, services.pull_request_files(files)).collect()}
    assert "- **Stats:** +3 / -1 across 2 files\n- **Status:** open\n**Description:**\n" + "b" * 800 + "\n\n\n## Diff (2 files shown)\n\n**a.py** (modified, +3/-1)\n```diff\n+x\n```\n\n**b.png**" in got[1]
    assert "across 1 file\n- **Status:** Merged\n\n## Diff (0 files shown)" in got[2]


def test_diagram_texts(spark):
    files = spark.createDataFrame([("a", "r", "src/a.ts"), ("b", "r", 'src/b"x.ts'), ("c", "r", "main.ts")], "id string, repo_id string, path string")
    edges = spark.createDataFrame([("a", "b", "import"), ("c", "a", "import"), ("a", "b", "import"), ("a", "a", "import")], "source_file_id string, target_file_id string, edge_type string")
    repos = spark.createDataFrame([("r",), ("bare",)], "id string")
    got = {r["repo_id"]: r["text"] for r in graph.diagram_texts(graph.diagram_lines(files, edges, repos)).collect()}
    assert got["bare"] == "flowchart LR\n  empty[No files indexed yet]"
    assert got["r"].split("\n") == [
        "flowchart LR", '  subgraph n_dir__root_["(root)"]', '    n_c["main.ts"]', "  end", '  subgraph n_dir_src["src"]', '    n_a["a.ts"]', '    n_b["b&quot;x.ts"]', "  end", "  n_a --> n_b", "  n_c --> n_a",
    ]


def test_resolution_takes_the_first_candidate(spark):
    files = [(p,) for p in ("src/a.ts", "src/b.js", "src/b.tsx", "src/c/index.js", "src/c/index.ts", "src/d", "src/d.ts", "lib/e.mjs", "src/main.ts", "src/f.ts")]
    files = spark.createDataFrame([("r", p) for (p,) in files], "repo_id string, path string")
    want = {"./a": "src/a.ts", "./b": "src/b.tsx", "./c": "src/c/index.ts", "./d": "src/d", "../lib/e": "lib/e.mjs", "./f.ts": "src/f.ts", "react": None, "./gone": None, "../../up": None, "./main": None}
    refs = spark.createDataFrame([("r", "src/main.ts", s) for s in want], "repo_id string, path string, specifier string")
    assert {r["target"] for r in graph.resolve_js(refs, files).collect()} == {t for t in want.values() if t}
    python = spark.createDataFrame([("r", p) for p in ("pkg/a.py", "pkg/b/__init__.py", "pkg/b.pyi", "pkg/sub/m.py", "top.py")], "repo_id string, path string")
    refs = spark.createDataFrame([("r", "pkg/sub/m.py", s) for s in ("..a", "..b", "...top", "....far", "os")], "repo_id string, path string, specifier string")
    assert {r["target"] for r in graph.resolve_python(refs, python).collect()} == {"pkg/a.py", "pkg/b.pyi", "top.py"}


def test_reach_stops_where_a_root_is_full(spark):
    edges = [(f"m{i:02d}", "root", "import") for i in range(30)] + [(f"n{i:02d}", f"m{i:02d}", "import") for i in range(30)]
    edges = spark.createDataFrame(edges, "source_file_id string, target_file_id string, edge_type string")
    roots = spark.createDataFrame([("root",), ("m03",)], "root string")
    got = {}
    for r in graph.reverse_reach(edges, roots, depth=3, visited=20).collect():
        got.setdefault(r["root"], []).append((r["depth"], r["id"]))
    assert sorted(got["root"]) == [(1, f"m{i:02d}") for i in range(20)] and got["m03"] == [(1, "n03")]
    more = [tuple(r) for r in graph.reverse_reach(edges, roots, depth=3, visited=40).filter("root = 'root'").orderBy("depth", "id").collect()]
    assert len(more) == 40 and more[-1] == ("root", "n09", 2)


def test_scalar_queries_shuffle_no_texts(spark):
    chunks = spark.createDataFrame([("a", "text")], "id string, content string")
    for name in ("token_estimate", "content_hash"):
        assert name in catalog.QUERIES
    plan = chunks.select("id", S.token_estimate(F.col("content")).alias("tokens")).dropDuplicates(["id"])._jdf.queryExecution().executedPlan().toString()
    exchange = next(x for x in plan.split("\n") if "Exchange" in x)
    assert "content" not in exchange


def test_jobs_are_taken_once_over_batches(spark, tmp_path):
    shape = "id string, repo_id string, status string"
    rows = [[("a", "r", "queued"), ("b", "r", "queued"), ("a", "r", "queued")], [("b", "r", "queued"), ("c", "r", "failed"), (None, "r", "x"), ("d", None, "x")], [("a", "r", "queued")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = events.take_once(stream, spark, f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "r", "queued"), ("b", "r", "queued"), ("c", "r", "failed")]
    # a second run over the same checkpoint finds nothing new
    assert events.take_once(stream, spark, f"file://{tmp_path}/out").count() == 3


def test_index_changes_over_batches(spark, tmp_path):
    import time

    shape = "id string, repo_id string, path string, content_hash string, created_at timestamp"
    day = lambda d: dt.datetime(2025, 1, d)
    batches = [[("1", "r", "a", "h1", day(1)), ("2", "r", "b", "h2", day(1))], [("3", "r", "a", "h3", day(2)), ("4", "r", "c", "h4", day(2))], [("5", "r", "a", "h0", day(1)), ("6", "r", "b", "h2", day(3)), (None, None, "x", None, None)]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)  # files are taken in the order of their time
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    snapshot, changes = events.index_changes(stream, spark, f"file://{tmp_path}/out")
    assert sorted((r["path"], r["id"], r["content_hash"]) for r in snapshot.collect()) == [("a", "3", "h3"), ("b", "6", "h2"), ("c", "4", "h4")]
    assert sorted((r["batch"], r["path"], r["state"]) for r in changes.collect()) == [(0, "a", "new"), (0, "b", "new"), (1, "a", "changed"), (1, "c", "new"), (2, "a", "unchanged"), (2, "b", "unchanged")]
    assert sorted(p.name for p in (tmp_path / "out/snapshot").iterdir()) == ["1", "2"]


def test_indexing_run(spark):
    from corvine.operators import indexing

    now = dt.datetime(2025, 1, 1)
    shape = "id string, repo_id string, path string, language string, content_hash string, size_bytes long, created_at timestamp"
    files = spark.createDataFrame([("a", "r", "src/a.ts", "typescript", "h1", 1, now), ("b", "r", "src/b.ts", "typescript", "h2", 1, now), ("old", "r", "src/old.ts", None, "h3", 1, now), ("z", "s", "z.py", "python", "h9", 1, now)], shape)
    chunks = spark.createDataFrame([(f"k{x}", x, f"text of {x}", [1.0]) for x in ("a", "b", "old", "z")], "id string, file_id string, content string, embedding array<float>")
    edges = spark.createDataFrame([("a", "b", "import"), ("a", "old", "import"), ("b", "a", "import"), ("z", "z2", "import")], "source_file_id string, target_file_id string, edge_type string")
    incoming = spark.createDataFrame(
        [("n1", "r", "src/a.ts", "typescript", "h1", 1, now, "unchanged"), ("n2", "r", "src/b.ts", "typescript", "new", 2, now, "import { c } from './c';\nimport x from 'react';\nexport function b() {\n  return c;\n}\n"), ("n3", "r", "src/c.ts", "typescript", "hc", 1, now, "export const c = 1;\n"), ("n4", "r", "empty.md", None, "he", 0, now, None)],
        shape + ", text string",
    )
    done = indexing.index_repositories(files, chunks, edges, incoming)
    assert {(r["id"], r["path"], r["content_hash"]) for r in done.files.collect()} == {("a", "src/a.ts", "h1"), ("b", "src/b.ts", "new"), ("n3", "src/c.ts", "hc"), ("n4", "empty.md", "he"), ("z", "z.py", "h9")}
    assert {(r["path"], r["state"]) for r in done.states.collect()} == {("src/a.ts", "unchanged"), ("src/b.ts", "changed"), ("src/c.ts", "new"), ("empty.md", "new"), ("src/old.ts", "orphan")}
    assert {tuple(r) for r in done.edges.collect()} == {("a", "b", "import"), ("b", "n3", "import"), ("z", "z2", "import")}
    got = {(r["file_id"], r["content"]) for r in done.chunks.collect()}
    assert {("a", "text of a"), ("z", "text of z")} < got and {f for f, _ in got} == {"a", "b", "n3", "z"} and ("b", "text of b") not in got
    assert done.chunks.filter("embedding is null").count() == 0


def test_table_changes(spark):
    held = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, n int, note string")
    more = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3), (None, 4)], "id string, n int")
    assert sorted(tuple(r) for r in dml.insert_rows(held, more).collect()) == [("a", 1, "x"), ("b", 2, None), ("c", 3, None)]
    new = spark.createDataFrame([("b", "y"), ("b", "y"), ("z", "q"), ("a", None)], "id string, note string")
    assert sorted(tuple(r) for r in dml.write_back(held, new, "note").collect()) == [("a", 1, "x"), ("b", 2, "y")]


def test_split_lines_is_whole_and_linear():
    text = "\n".join(f"line {i} " + "😀" * (i % 5) for i in range(2000))
    pieces = chunking.split_lines(("f", "function", 10, 2009, text), most=50)
    assert "\n".join(p[4] for p in pieces) == text and all(chunking.tokens(p[4]) >= 50 for p in pieces[:-1])
    assert all(p[2] + p[4].count("\n") == p[3] for p in pieces) and pieces[0][2] == 10 and pieces[-1][3] == 2009
    assert all(chunking.tokens(p[4].rsplit("\n", 1)[0]) < 50 for p in pieces if "\n" in p[4])


def test_tree_cap_and_skipped_folders(spark, tmp_path):
    for name in ("b.txt", "a.txt", "sub/c.txt", "sub/deep/d.txt", "node_modules/x/e.js", "sub/node_modules/f.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r["path"]: r["reason"] for r in read_tree(spark, str(tmp_path), file_count=3).collect()}
    assert {p for p, r in got.items() if r is None} == {"a.txt", "b.txt", "sub/c.txt"} and got["sub/deep/d.txt"] == "file_count"


def test_cut_tables_are_swept(tmp_path, spark):
    from pathlib import Path

    from corvine import scratch

    df = scratch.cut(spark.range(3), "numbers")
    folder = Path(scratch._own(spark).removeprefix("file://"))
    assert df.count() == 3 and folder.is_dir()
    scratch.sweep(spark)
    assert not folder.exists()
    assert scratch.cut(spark.range(2), "numbers").count() == 2
