"""Registered queries of the core operators and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.config import LIMITS
from corvine.functions import scalars as S
from corvine.functions import values as V
from corvine.operators import chunking, dml, graph, indexing, reports, retrieval, services, tools
from corvine.schemas import SCHEMAS
from corvine.scratch import cut
from corvine.sources.tables import rows_once, table
from corvine.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Host of the repositories in the tables, and the day that splits files into two indexing runs.
HOSTS = ("git.example",)
SPLIT = "2025-07-01 00:00:00"
TERMS = ["handle", "queue"]
DIM = 64

def _with(sql: str, *names: str) -> str:
    """SQL over tables in which each id counts once, as r, j, f, c, e, v and m."""
    short = {"repos": "r", "index_jobs": "j", "files": "f", "chunks": "c", "file_edges": "e", "conversations": "v", "messages": "m"}
    head = ", ".join(f"{short[n]} AS (SELECT DISTINCT ON (id) * FROM {n} WHERE id IS NOT NULL)" for n in names)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    sql = sql.replace("RECURSIVE", "").strip()
    return f"WITH {recursive}{head}{', ' + sql[5:].strip() if sql.startswith('WITH ') else ' ' + sql}"


def query(sql: str | None, *names: str, raw: bool = False, after: str | None = None):
    """Register a query over the named tables, each id once, with its SQL.

    ``raw`` queries get the tables as they are: their operators merge repeated rows themselves, where
    only ids and scores are left to shuffle. With ``after`` the first table stays as it is and repeated
    rows are merged by that column of the result, so what is shuffled is the small result.
    """

    def add(f):
        def run(spark: SparkSession, root: str) -> DataFrame:
            out = f(*[table(spark, root, n) if raw or after and not i else rows_once(table(spark, root, n)) for i, n in enumerate(names)])
            return rows_once(out, after) if after else out

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = _with(sql, *names)
        return f

    return add


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


# Scalars over paths, addresses and texts ------------------------------------------------------------

_BASE = r"regexp_extract(path, '[^/\\]*$', 0)"
_EXT = rf"nullif(regexp_extract(lower({_BASE}), '^.+\.([^.]*)$', 1), '')"
_DIR = r"CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '(root)' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"


def _case(pairs: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_LANG = f"coalesce({_case(V.NAME_LANGUAGE, f'lower({_BASE})')}, {_case(V.EXTENSION_LANGUAGE, _EXT)})"


@query(f"SELECT id, path, {_LANG} AS detected, coalesce(lower(language) = {_LANG}, false) AS agrees FROM f", "files")
def detect_language(f):
    found = S.detect_language(F.col("path"))
    return f.select("id", "path", found.alias("detected"), F.coalesce(F.lower("language") == found, F.lit(False)).alias("agrees"))


_SECRET = "|".join(V.SECRET_NAMES)
_REASON = f"""CASE WHEN list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), [{_names(V.SKIP_DIRS)}]) THEN 'skip_dir'
 WHEN {_BASE} IN ({_names(V.SKIP_FILES)}) THEN 'skip_file' WHEN regexp_matches(lower({_BASE}), '{_SECRET}') THEN 'secret'
 WHEN coalesce({_EXT} IN ({_names(V.BINARY_EXTENSIONS)}), false) THEN 'binary' WHEN size_bytes > 1048576 THEN 'too_large' END"""


@query(f"SELECT id, path, {_REASON} AS reason FROM f", "files")
def walk_filters(f):
    return f.select("id", "path", S.skip_reason(F.col("path"), F.col("size_bytes")).alias("reason"))


@query(f"SELECT repo_id, coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM f GROUP BY 1, 2", "files")
def skip_reason_counts(f):
    reason = F.coalesce(S.skip_reason(F.col("path"), F.col("size_bytes")), F.lit("kept"))
    return f.groupBy("repo_id", reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT {_EXT} AS extension, {_LANG} AS language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM f GROUP BY 1, 2", "files")
def language_facets(f):
    return reports.language_facets(f)


@query("SELECT id, CAST(ceil(len(content) / 4.0) AS BIGINT) AS tokens FROM c WHERE content IS NOT NULL", "chunks", after="id")
def token_estimate(c):
    # contents are in the basic plane, where UTF-16 units and characters are the same
    return c.filter("content is not null").select("id", S.token_estimate(F.col("content")).alias("tokens"))


@query("SELECT id, sha256(content) AS hash FROM c WHERE content IS NOT NULL", "chunks", after="id")
def content_hash(c):
    return c.filter("content is not null").select("id", F.sha2("content", 256).alias("hash"))


@query("SELECT id, CASE WHEN len(content) > 1200 THEN concat(substring(content, 1, 1200), '…') ELSE content END AS shown FROM c", "chunks", after="id")
def snippet_truncate(c):
    return c.select("id", S.clipped(F.col("content"), 1200).alias("shown"))


@query(
    r"""SELECT id, regexp_extract(github_url, '^https?://[^/]+/([^/]+)/([^/?#]+)', 1) AS owner, regexp_extract(github_url, '^https?://[^/]+/([^/]+)/([^/?#]+)', 2) AS repo,
 concat('https://git.example/', regexp_extract(github_url, '^https?://[^/]+/([^/?#]+/[^/?#]+)', 1)) AS normalized_url FROM r""",
    "repos",
)
def parse_repo_url(r):
    p = S.parse_repo_url(F.col("github_url"), HOSTS)
    return r.select("id", p["owner"].alias("owner"), p["repo"].alias("repo"), p["normalized_url"].alias("normalized_url"))


@query(r"SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(trim(github_url), '^https?://', ''), '^www\.', ''), '(\.git)?/*$', '')) AS remote FROM r", "repos")
def normalize_remote(r):
    return r.select("id", S.normalize_remote(F.col("github_url")).alias("remote"))


_CITE = r"[a-zA-Z0-9_./-]+\.[a-zA-Z]{1,6}:\d+(?:-\d+)?"


@query(f"SELECT id, unnest(regexp_extract_all(content, '{_CITE}')) AS citation FROM m WHERE content IS NOT NULL", "messages", raw=True)
def citations(m):
    # the citations, not the texts, are what is shuffled
    rows = rows_once(m.filter("content is not null").select("id", S.citations(F.col("content")).alias("found")))
    return rows.select("id", F.explode("found").alias("citation"))


@query("SELECT id, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM m", "messages", after="id")
def html_escape(m):
    return m.select("id", S.html_escape(F.col("content")).alias("html"))


_TRIM = r"'^[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$'"


@query(
    f"""SELECT id, CASE WHEN json_valid(parts) AND json_type(parts) = 'ARRAY' THEN regexp_replace(array_to_string(list_transform(list_filter(CAST(parts AS JSON[]),
  lambda x: json_extract_string(x, '$.type') = 'text' AND json_type(x, '$.text') = 'VARCHAR'), lambda x: json_extract_string(x, '$.text')), chr(10)), {_TRIM}, '', 'g') ELSE coalesce(content, '') END AS preview FROM m""",
    "messages",
    after="id",
)
def preview_text(m):
    return m.select("id", S.preview_text(F.col("parts"), F.col("content")).alias("preview"))


@query("SELECT id, concat('flowchart LR', chr(10), '  ', path) AS diagram FROM f", "files")
def diagram_fences(f):
    # a note with a closed and an open fence for each file: only the closed one is a diagram
    note = F.concat(F.lit("Graph:\n```mermaid\nflowchart LR\n  "), "path", F.lit("\n```\nand an open one\n```mermaid\nflowchart TD"))
    return f.select("id", F.explode(S.diagrams(note)).alias("diagram"))


_HELP = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + f" THEN '{topic}'" for topic, words in V.HELP_RULES
) + " ELSE 'unknown' END"


@query(f"SELECT {_HELP} AS topic, count(*) AS n FROM m WHERE content IS NOT NULL GROUP BY 1", "messages")
def help_topics(m):
    return m.filter("content is not null").groupBy(S.help_topic(F.col("content")).alias("topic")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT id, {_case(V.STATUS_KIND, "coalesce(status, 'queued')")} AS kind, {_case(V.STATUS_LABEL, "coalesce(status, 'queued')")} AS label FROM r""",
    "repos",
)
def status_badges(r):
    return r.select("id", S.status_kind(F.col("status")).alias("kind"), S.status_label(F.col("status")).alias("label"))


@query("SELECT id, CAST(greatest(0, least(100, progress)) AS INTEGER) AS progress, substring(error, 1, 2000) AS error FROM j", "index_jobs")
def clamp_progress(j):
    return j.select("id", S.clamp_progress(F.col("progress")).alias("progress"), F.substring("error", 1, 2000).alias("error"))


@query("SELECT path, start_line, c.id, concat(path, ':', start_line, '-', end_line) AS citation FROM c JOIN f ON c.file_id = f.id", "chunks", "files")
def chunk_citations(c, f):
    rows = c.join(f.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.select("path", "start_line", "id", S.citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation"))


@query(
    r"""WITH b AS (SELECT id, unnest(string_split_regex(onboarding_guide, '\n{2,}')) AS raw, generate_subscripts(string_split_regex(onboarding_guide, '\n{2,}'), 1) - 1 AS block FROM r WHERE onboarding_guide IS NOT NULL),
 t AS (SELECT id, block, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM b)
 SELECT id, CAST(block AS INTEGER) AS block, CASE WHEN starts_with(body, '### ') THEN 'h3' WHEN starts_with(body, '## ') THEN 'h2' WHEN starts_with(body, '# ') THEN 'h1' WHEN regexp_matches(body, '^\s*[-*]\s') THEN 'ul' ELSE 'p' END AS kind, body,
 CAST(CASE WHEN regexp_matches(body, '^\s*[-*]\s') THEN len(list_filter(string_split_regex(body, '\n+'), lambda x: regexp_matches(x, '^\s*[-*]\s'))) ELSE 0 END AS INTEGER) AS items FROM t WHERE body <> ''""",
    "repos",
)
def guide_blocks(r):
    return reports.markdown_blocks(r.filter("onboarding_guide is not null"), "id", "onboarding_guide")


# Filters and listings ---------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT * FROM f WHERE starts_with(path, 'src/') OR path = 'src'), l AS (SELECT * FROM g WHERE language = 'typescript'),
 n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, id) AS k, count(*) OVER (PARTITION BY repo_id) AS total FROM l)
 SELECT repo_id, path, language, total, total > 200 AS truncated FROM n WHERE k <= 200""",
    "files",
)
def list_files(f):
    return reports.list_files(f, "src", "typescript")


@query("SELECT id, path FROM f WHERE contains(lower(path), 'router') OR coalesce(contains(lower(language), 'router'), false)", "files")
def find_files(f):
    return reports.find_files(f, " Router ").select("id", "path")


@query("SELECT id, file_id FROM c WHERE embedding IS NULL", "chunks")
def unembedded_chunks(c):
    return c.filter(F.col("embedding").isNull()).select("id", "file_id")


@query(
    """SELECT c.id AS chunk_id, greatest(1, 3) AS first, CAST(least(len(string_split(content, chr(10))), 12, 3 + 399) AS INTEGER) AS last,
 substring(CASE WHEN least(len(string_split(content, chr(10))), 12) >= 3 THEN array_to_string(list_slice(string_split(content, chr(10)), 3, least(len(string_split(content, chr(10))), 12)), chr(10)) ELSE '' END, 1, 8000) AS text
 FROM c WHERE content IS NOT NULL""",
    "chunks",
    after="chunk_id",
)
def read_lines(c):
    return reports.read_lines(c.filter("content is not null"), 3, 12)


@query("SELECT repo_id, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(sum(size_bytes) / 1048576.0, 3) AS megabytes, sum(size_bytes) > 104857600 AS too_large, count(*) > 10000 AS truncated FROM f GROUP BY 1", "files")
def repo_sizes(f):
    return reports.repo_sizes(f)


# Services ---------------------------------------------------------------------------------------------


@query("SELECT repo_id, CAST(count(*) AS INTEGER) AS n_files FROM f GROUP BY 1", "files")
def count_files(f):
    return reports.count_files(f)


_LATEST = "SELECT repo_id, id AS job_id, status AS job_status, coalesce(progress, 0) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM j) WHERE k = 1"


@query(_LATEST, "index_jobs")
def latest_job(j):
    return reports.latest_jobs(j)


_ACTIVE = "'queued', 'cloning', 'parsing', 'embedding', 'indexing'"


@query(
    f"""WITH l AS ({_LATEST}), n AS (SELECT repo_id, count(*) AS n_files FROM f GROUP BY 1)
 SELECT r.id, name, status, CAST(coalesce(n_files, 0) AS INTEGER) AS n_files, job_status, coalesce(progress, 0) AS progress,
 coalesce({_case(V.STATUS_KIND, "coalesce(job_status, status, 'queued')")}, 'default') AS kind, coalesce({_case(V.STATUS_LABEL, "coalesce(job_status, status, 'queued')")}, coalesce(job_status, status, 'queued')) AS label,
 coalesce(status IN ({_ACTIVE}), false) OR coalesce(job_status IN ({_ACTIVE}), false) AS active, epoch_us(updated_at) AS updated_at
 FROM r LEFT JOIN n ON r.id = n.repo_id LEFT JOIN l ON r.id = l.repo_id""",
    "repos", "files", "index_jobs",
)
def list_repos(r, f, j):
    return reports.list_repos(r, f, j).withColumn("updated_at", _micros("updated_at"))


@query("SELECT 'repo' AS source, status, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'job', status, count(*) FROM j GROUP BY 2", "repos", "index_jobs")
def status_counts(r, j):
    return reports.status_counts(r, j)


@query(
    """WITH s AS (SELECT conversation_id AS id, count(*) AS n_messages, max(created_at) AS last_at FROM m GROUP BY 1)
 SELECT v.id, repo_id, substring(title, 1, 200) AS title, coalesce(n_messages, 0) AS n_messages, CAST(epoch_us(last_at) AS VARCHAR) AS last_at, CAST(epoch_us(greatest(updated_at, last_at)) AS VARCHAR) AS updated_at FROM v LEFT JOIN s ON v.id = s.id""",
    "conversations", "messages",
)
def list_conversations(v, m):
    return reports.list_conversations(v, m).withColumns({"last_at": _micros("last_at").cast("string"), "updated_at": _micros("updated_at").cast("string")})


@query(
    """WITH s AS (SELECT conversation_id AS id, arg_min(content, (created_at, id)) FILTER (WHERE content IS NOT NULL OR true) AS said
  FROM (SELECT * FROM m WHERE lower(trim(role, ' ')) = 'user' AND created_at IS NOT NULL) GROUP BY 1)
 SELECT v.id, CASE WHEN (title = 'New conversation' OR len(coalesce(title, '')) < 8) AND said IS NOT NULL AND said <> '' THEN substring(said, 1, 60) ELSE title END AS title FROM v LEFT JOIN s ON v.id = s.id""",
    "conversations", "messages",
)
def retitled(v, m):
    # the twin's arg_min skips null contents, so they are left out here as well
    return reports.retitled(v, m.filter("content is not null"))


@query("SELECT id, conversation_id, lower(trim(role, ' ')) AS role, CAST(epoch_us(created_at) AS VARCHAR) AS created_at FROM m WHERE conversation_id IS NOT NULL", "messages")
def list_messages(m):
    return m.filter("conversation_id is not null").select("id", "conversation_id", F.lower(F.trim("role")).alias("role"), _micros("created_at").cast("string").alias("created_at"))


@query("SELECT id, regexp_replace(concat(github_url, '//'), '/+$', '') AS server FROM r", "repos")
def trim_server(r):
    return r.select("id", S.trimmed_server(F.concat("github_url", F.lit("//"))).alias("server"))


@query("SELECT id, name, status FROM r", "repos")
def list_repos_tool(r):
    return r.select("id", "name", "status")


_URL = r"lower(regexp_replace(regexp_replace(regexp_replace(trim(github_url), '^https?://', ''), '^www\.', ''), '(\.git)?/*$', ''))"


@query(
    f"""WITH u AS (SELECT {_URL} AS url FROM r ORDER BY id DESC LIMIT 1), h AS (SELECT id, updated_at, coalesce({_URL} = (SELECT url FROM u), false) AS matched FROM r)
 SELECT CAST(row_number() OVER (ORDER BY matched DESC, updated_at DESC NULLS LAST, id) AS INTEGER) AS place, id, matched FROM h QUALIFY place <= 50""",
    "repos",
)
def repos_for_page(r):
    # the page is that of the last repository, in another spelling
    page = r.orderBy(F.desc("id")).select(F.concat(F.regexp_replace("github_url", r"(\.git)?/*$", ""), F.lit(".git")).alias("url")).first()
    return services.repos_for_page(r, page["url"] if page else "")


@query("SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY updated_at DESC NULLS LAST, id) AS INTEGER) AS place, id FROM v QUALIFY place <= 20", "conversations")
def recent_conversations(v):
    return services.recent_conversations(v)


@query("SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY created_at ASC NULLS LAST, id) AS INTEGER) AS place, id FROM m WHERE conversation_id IS NOT NULL QUALIFY place <= 50", "messages")
def first_messages(m):
    return services.first_messages(m)


@query("SELECT id, repo_id, title FROM v UNION ALL SELECT sha256(r.id), r.id, CASE WHEN r.status = 'ready' THEN substring(repeat(r.name, 40), 1, 200) ELSE 'New conversation' END FROM r WHERE r.id NOT IN (SELECT repo_id FROM v WHERE repo_id IS NOT NULL)", "conversations", "repos")
def create_conversations(v, r):
    new = r.join(v.select(F.col("repo_id").alias("id")), "id", "left_anti")
    asked = new.select(F.sha2("id", 256).alias("id"), F.col("id").alias("repo_id"), F.when(F.col("status") == "ready", F.repeat("name", F.lit(40))).alias("title"))
    return services.create_conversations(v, asked, F.to_timestamp(F.lit(SPLIT))).select("id", "repo_id", "title")


@query(
    """SELECT id, CASE WHEN status = 'queued' THEN 'cloning' WHEN status = 'cloning' THEN 'failed' ELSE status END AS status,
 CAST(CASE WHEN status = 'queued' THEN 100 WHEN status = 'cloning' THEN 0 ELSE progress END AS INTEGER) AS progress, CASE WHEN status = 'cloning' THEN repeat('x', 2000) ELSE error END AS error,
 CAST(epoch_us(CASE WHEN status = 'queued' THEN TIMESTAMPTZ '2026-01-01 00:00:00+00' ELSE started_at END) AS VARCHAR) AS started_at, CAST(epoch_us(CASE WHEN status = 'cloning' THEN TIMESTAMPTZ '2026-01-01 00:00:00+00' ELSE finished_at END) AS VARCHAR) AS finished_at FROM j""",
    "index_jobs",
)
def update_jobs(j):
    # queued jobs begin, with a progress that is out of range; those that clone fail with a long message
    begun, failing = F.col("status") == "queued", F.col("status") == "cloning"
    updates = j.filter(begun | failing).select(
        "id", F.when(begun, "cloning").otherwise("failed").alias("status"), F.when(begun, 250).otherwise(-5).alias("progress"),
        F.when(failing, F.repeat(F.lit("x"), 3000)).alias("error"), failing.alias("finished"),
    )
    out = dml.update_jobs(j, updates, F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return out.select("id", "status", "progress", "error", _micros("started_at").cast("string").alias("started_at"), _micros("finished_at").cast("string").alias("finished_at"))


# Changing tables ---------------------------------------------------------------------------------------

_RUNS = f"""old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM f WHERE created_at < TIMESTAMPTZ '{SPLIT}+00') WHERE k = 1),
 new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM f WHERE created_at >= TIMESTAMPTZ '{SPLIT}+00') WHERE k = 1)"""


def _runs(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files as two indexing runs saw them: the last row of each path before and from the split day on."""
    at = F.to_timestamp(F.lit(SPLIT))
    keys = ["repo_id", "path"]
    return dml.latest_by(f.filter(F.col("created_at") < at), keys), dml.latest_by(f.filter(F.col("created_at") >= at), keys)


@query(
    f"""WITH {_RUNS} SELECT coalesce(old.repo_id, new.repo_id) AS repo_id, coalesce(old.path, new.path) AS path,
 CASE WHEN old.id IS NULL THEN 'new' WHEN new.id IS NULL THEN 'orphan' WHEN old.content_hash IS NOT DISTINCT FROM new.content_hash THEN 'unchanged' ELSE 'changed' END AS state
 FROM old FULL JOIN new ON old.repo_id = new.repo_id AND old.path = new.path""",
    "files",
)
def file_diff(f):
    return dml.file_diff(*_runs(f))


@query(
    f"""WITH {_RUNS} SELECT coalesce(old.repo_id, new.repo_id) AS repo_id, coalesce(old.path, new.path) AS path, coalesce(old.id, new.id) AS id, epoch_us(coalesce(old.created_at, new.created_at)) AS created_at,
 CASE WHEN new.id IS NOT NULL THEN new.language ELSE old.language END AS language, CASE WHEN new.id IS NOT NULL THEN new.content_hash ELSE old.content_hash END AS content_hash, CASE WHEN new.id IS NOT NULL THEN new.size_bytes ELSE old.size_bytes END AS size_bytes
 FROM old FULL JOIN new ON old.repo_id = new.repo_id AND old.path = new.path""",
    "files",
)
def upsert_files(f):
    return dml.upsert_files(*_runs(f)).withColumn("created_at", _micros("created_at"))


@query(f"WITH {_RUNS} SELECT old.id FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.repo_id = old.repo_id AND new.path = old.path)", "files")
def orphan_files(f):
    old, new = _runs(f)
    return old.join(new.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select("id")


@query("SELECT DISTINCT source_file_id, target_file_id, edge_type FROM e WHERE source_file_id <> target_file_id EXCEPT SELECT source_file_id, target_file_id, edge_type FROM e WHERE edge_type = 'import'", "file_edges")
def insert_edges(e):
    # the table holds the imports already
    keys = ["source_file_id", "target_file_id", "edge_type"]
    return dml.insert_ignore(e.filter("edge_type = 'import'"), e.filter("source_file_id <> target_file_id"), keys).select(*keys)


@query(f"SELECT id, file_id, created_at < TIMESTAMPTZ '{SPLIT}+00' AS was FROM c", "chunks")
def insert_chunks(c):
    # the later run delivers all chunks again; only the new ones are added
    rows = c.select("id", "file_id", (F.col("created_at") < F.to_timestamp(F.lit(SPLIT))).alias("was"))
    return dml.insert_rows(rows.filter("was"), rows)


@query("SELECT id, CASE WHEN embedding IS NOT NULL THEN len(embedding) WHEN regexp_matches(content, '[\\p{L}\\p{N}_]') THEN 64 END AS numbers FROM c", "chunks")
def write_embeddings(c):
    made = retrieval.embed_missing(c, DIM).withColumnRenamed("chunk_id", "id")
    return dml.write_back(c, made, "embedding").select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("numbers"))


@query(
    """WITH g AS (SELECT id FROM r WHERE status = 'failed'), gf AS (SELECT id FROM f WHERE repo_id IN (SELECT id FROM g)), gv AS (SELECT id FROM v WHERE repo_id IN (SELECT id FROM g))
 SELECT 'repos' AS name, id FROM r WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'files', id FROM f WHERE NOT coalesce(repo_id IN (SELECT id FROM g), false)
 UNION ALL SELECT 'chunks', id FROM c WHERE NOT coalesce(file_id IN (SELECT id FROM gf), false) UNION ALL SELECT 'file_edges', id FROM e WHERE NOT coalesce(source_file_id IN (SELECT id FROM gf), false) AND NOT coalesce(target_file_id IN (SELECT id FROM gf), false)
 UNION ALL SELECT 'index_jobs', id FROM j WHERE NOT coalesce(repo_id IN (SELECT id FROM g), false) UNION ALL SELECT 'conversations', id FROM v WHERE NOT coalesce(repo_id IN (SELECT id FROM g), false)
 UNION ALL SELECT 'messages', id FROM m WHERE NOT coalesce(conversation_id IN (SELECT id FROM gv), false)""",
    "repos", "index_jobs", "files", "chunks", "file_edges", "conversations", "messages",
)
def delete_cascade(r, j, f, c, e, v, m):
    tables = dict(repos=r, index_jobs=j, files=f, chunks=c, file_edges=e, conversations=v, messages=m)
    left = dml.delete_repo(tables, r.filter("status = 'failed'").select(F.col("id").alias("repo_id")))
    rows = [df.select(F.lit(name).alias("name"), "id") for name, df in left.items()]
    return functools.reduce(DataFrame.unionByName, rows)


@query("SELECT id, CASE WHEN status IN ('queued', 'indexing') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'indexing') THEN 'main' ELSE default_branch END AS default_branch FROM r", "repos")
def mark_failed(r):
    return dml.update_where(r, F.col("status").isin("queued", "indexing"), {"status": F.lit("failed"), "default_branch": F.lit("main")}).select("id", "status", "default_branch")


@query(
    """WITH u AS (SELECT github_url FROM r WHERE status = 'failed') SELECT id, github_url, CASE WHEN github_url IN (SELECT github_url FROM u) THEN 'queued' ELSE status END AS status,
 CASE WHEN github_url IN (SELECT github_url FROM u) THEN epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') ELSE epoch_us(updated_at) END AS updated_at FROM r""",
    "repos",
)
def upsert_repos(r):
    out = dml.upsert_repo(r, r.filter("status = 'failed'").select("github_url", "name"), F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return out.select("id", "github_url", "status", _micros("updated_at").alias("updated_at"))


@query(
    """WITH d AS (SELECT id FROM v WHERE title = 'New conversation') SELECT 'conversations' AS name, count(*) AS n FROM v WHERE id NOT IN (SELECT id FROM d)
 UNION ALL SELECT 'messages', count(*) FROM m WHERE NOT coalesce(conversation_id IN (SELECT id FROM d), false)""",
    "conversations", "messages",
)
def delete_conversations(v, m):
    left = services.delete_conversations(v, m, v.filter("title = 'New conversation'"))
    one, two = (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in zip(("conversations", "messages"), left))
    return one.unionByName(two)


@query(
    "SELECT v.id, epoch_us(CASE WHEN s.id IS NULL THEN updated_at ELSE TIMESTAMPTZ '2026-06-01 00:00:00+00' END) AS updated_at FROM v LEFT JOIN (SELECT DISTINCT conversation_id AS id FROM m WHERE role = 'user') s ON v.id = s.id",
    "conversations", "messages",
)
def append_messages(v, m):
    # every user row is said once more: its conversation moves to the top of the list
    bumped, _ = services.append_messages(v, m, m.filter("role = 'user'"), F.to_timestamp(F.lit("2026-06-01 00:00:00")))
    return bumped.select("id", _micros("updated_at").alias("updated_at"))


@query("SELECT c.id, concat('Explain it.', chr(10), chr(10), 'The user is looking at this code in `', path, '`:', chr(10), '```', chr(10), content, chr(10), '```') AS asked FROM c JOIN f ON c.file_id = f.id WHERE content IS NOT NULL", "chunks", "files", after="id")
def ask_with_context(c, f):
    rows = c.filter("content is not null").join(f.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.select("id", services.ask_with_context(F.lit("Explain it."), F.col("path"), F.col("content")).alias("asked"))


# Retrieval ----------------------------------------------------------------------------------------------

_OK = f"len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_USABLE = f"u AS (SELECT id, file_id, start_line, CAST(embedding AS DOUBLE[{DIM}]) AS v FROM c WHERE {_OK}), q AS (SELECT v FROM u ORDER BY id LIMIT 1)"


def _vectors(k: int) -> str:
    return f"""vec AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT u.id AS chunk_id, round(array_cosine_similarity(u.v, (SELECT v FROM q)), 6) AS score FROM u ORDER BY score DESC, chunk_id LIMIT {k}))"""


def _count(col: str, term: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = '{term}'))"


def _words(terms: list[str], k: int, op: str = "OR") -> str:
    total = " + ".join(f"(1.0 * {_count('symbol_name', t)} + 0.4 * {_count('content', t)})" for t in terms)
    met = f" {op} ".join(f"({_count('symbol_name', t)} + {_count('content', t)}) > 0" for t in terms)
    return f"""kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT id AS chunk_id, CAST(round({total}, 6) AS DOUBLE) AS score FROM c WHERE {met} ORDER BY score DESC, chunk_id LIMIT {k}))"""


_FUSED = """fu AS (SELECT *, row_number() OVER (ORDER BY score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST) AS rank FROM (
  SELECT coalesce(vec.chunk_id, kw.chunk_id) AS chunk_id, CAST(round(coalesce(1.0::DOUBLE / (60 + vec.rank), 0) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0), 9) AS DOUBLE) AS score,
   CASE WHEN kw.rank IS NULL THEN 'vector' WHEN vec.rank IS NULL THEN 'keyword' ELSE 'both' END AS source, vec.rank AS vector_rank, kw.rank AS keyword_rank
  FROM vec FULL JOIN kw ON vec.chunk_id = kw.chunk_id ORDER BY score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST LIMIT 10))"""
_HYBRID = f"WITH {_USABLE}, {_vectors(30)}, {_words(TERMS, 30)}, {_FUSED}"


def _query_vector(c: DataFrame) -> list[float]:
    """The vector of the first usable chunk: one row to the driver."""
    row = c.filter(retrieval.usable(F.col("embedding"), DIM)).orderBy("id").select("embedding").first()
    return list(row["embedding"]) if row else [1.0] + [0.0] * (DIM - 1)


@query(f"WITH {_USABLE}, {_vectors(10)} SELECT chunk_id, score, rank FROM vec", "chunks", raw=True)
def vector_topk(c):
    return retrieval.vector_search(c, _query_vector(c))


@query(f"WITH {_words(['handle'], 10)} SELECT chunk_id, score, rank FROM kw", "chunks", raw=True)
def keyword_topk_single(c):
    return retrieval.keyword_search(c, ["handle"])


@query(f"WITH {_words(TERMS, 10)} SELECT chunk_id, score, rank FROM kw", "chunks", raw=True)
def keyword_topk_or(c):
    return retrieval.keyword_search(c, TERMS)


@query(f"WITH {_words(TERMS, 10, 'AND')} SELECT chunk_id, score, rank FROM kw", "chunks", raw=True)
def keyword_topk_and(c):
    return retrieval.keyword_search(c, TERMS, mode="and")


# the words that stem to handl and queue
def _forms(col: str, forms: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '{forms}')))"


_BOTH = [_forms(c, w) for w in ("handl(e|es|ed|ing)", "queues?") for c in ("symbol_name", "content")]


@query(f"SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT id AS chunk_id, CAST(round(1.0 * {_BOTH[0]} + 0.4 * {_BOTH[1]} + 1.0 * {_BOTH[2]} + 0.4 * {_BOTH[3]}, 6) AS DOUBLE) AS score FROM c WHERE {' + '.join(_BOTH)} > 0 ORDER BY score DESC, chunk_id LIMIT 10)", "chunks", raw=True)
def full_text_or(c):
    return retrieval.full_text_search(c, "handles OR queues")


_NEG = [_forms(c, w) for w in ("handl(e|es|ed|ing)", "widgets?", "queues?", "locales?") for c in ("symbol_name", "content")]
_SUMS = [f"(1.0 * {_NEG[i]} + 0.4 * {_NEG[i + 1]})" for i in (0, 2, 4, 6)]


@query(
    f"""SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT id AS chunk_id, CAST(round((CASE WHEN {_SUMS[1]} = 0 THEN {_SUMS[0]} ELSE 0 END) + (CASE WHEN {_SUMS[3]} = 0 THEN {_SUMS[2]} ELSE 0 END), 6) AS DOUBLE) AS score
 FROM c WHERE ({_SUMS[0]} > 0 AND {_SUMS[1]} = 0) OR ({_SUMS[2]} > 0 AND {_SUMS[3]} = 0) ORDER BY score DESC, chunk_id LIMIT 10)""",
    "chunks", raw=True,
)
def full_text_negation(c):
    return retrieval.full_text_search(c, "handles -widget OR queues -locale")


@query(None, "chunks", raw=True)
def full_text_cover(c):
    return retrieval.full_text_search(c, 'handles -widget OR "shard queue"')


@query(f"{_HYBRID} SELECT chunk_id, score, source, coalesce(vector_rank, 0) AS vector_rank, coalesce(keyword_rank, 0) AS keyword_rank, rank FROM fu", "chunks", raw=True)
def hybrid_search(c):
    # ranks of 0 stand for none
    return retrieval.hybrid_search(c, _query_vector(c), TERMS).fillna(0, ["vector_rank", "keyword_rank"])


@query(None, "chunks", raw=True)
def hybrid_full_text(c):
    return retrieval.hybrid_search(c, _query_vector(c), 'handles -widget OR "shard queue"').fillna(0, ["vector_rank", "keyword_rank"])


_SIDE = """hf AS (SELECT DISTINCT file_id FROM c WHERE id IN (SELECT chunk_id FROM fu) AND file_id IS NOT NULL),
 sib AS (SELECT * FROM (SELECT id AS chunk_id, file_id, start_line, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS LAST, id) AS k FROM c WHERE file_id IN (SELECT file_id FROM hf) AND id NOT IN (SELECT chunk_id FROM fu)) WHERE k <= 3),
 nf AS (SELECT DISTINCT x AS file_id FROM (SELECT target_file_id AS x FROM e WHERE source_file_id IN (SELECT file_id FROM hf) UNION SELECT source_file_id FROM e WHERE target_file_id IN (SELECT file_id FROM hf)) WHERE x NOT IN (SELECT file_id FROM hf)),
 nei AS (SELECT * FROM (SELECT id AS chunk_id, file_id, start_line, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS LAST, id) AS k FROM c WHERE file_id IN (SELECT file_id FROM nf)) WHERE k <= 3)"""


def _hits(c: DataFrame) -> DataFrame:
    """The ten hits, written once, because several branches read them."""
    return cut(retrieval.hybrid_search(c, _query_vector(c), TERMS), "hits")


@query(f"{_HYBRID}, {_SIDE} SELECT chunk_id, file_id, start_line FROM sib", "chunks", "file_edges", raw=True)
def expand_siblings(c, e):
    return retrieval.siblings(c, _hits(c))


@query(f"{_HYBRID}, {_SIDE} SELECT chunk_id, file_id, start_line FROM nei", "chunks", "file_edges", raw=True)
def expand_neighbours(c, e):
    return retrieval.neighbours(c, e, _hits(c))


@query(
    f"{_HYBRID}, {_SIDE} SELECT 'primary' AS section, id AS chunk_id, file_id FROM c WHERE id IN (SELECT chunk_id FROM fu) UNION ALL SELECT 'sibling', chunk_id, file_id FROM sib UNION ALL SELECT 'neighbour', chunk_id, file_id FROM nei",
    "chunks", "file_edges", raw=True,
)
def expand_hits(c, e):
    return retrieval.expand(c, e, _hits(c))


@query(f"{_HYBRID} SELECT {_EXT} AS extension, count(*) AS hits FROM fu JOIN c ON fu.chunk_id = c.id JOIN f ON c.file_id = f.id GROUP BY 1", "chunks", "files")
def hit_facets(c, f):
    hits = retrieval.hybrid_search(c, _query_vector(c), TERMS)
    rows = hits.join(c.select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id").join(f.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.groupBy(S.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("hits"))


@query(
    f"{_HYBRID}, h AS (SELECT fu.chunk_id, rank, {_EXT} AS extension FROM fu JOIN c ON fu.chunk_id = c.id JOIN f ON c.file_id = f.id) SELECT chunk_id, rank, extension FROM h WHERE extension IS NOT DISTINCT FROM (SELECT arg_min(extension, rank) FROM h)",
    "chunks", "files", raw=True,
)
def hits_of_extension(c, f):
    return retrieval.of_extension(_hits(c), c, f).select("chunk_id", "rank", "extension")


@query(
    f"{_HYBRID} SELECT rank, concat(path, ':', start_line, '-', end_line) AS citation, symbol_name, CASE WHEN len(content) > 800 THEN concat(substring(content, 1, 800), '…') ELSE content END AS snippet, score, source FROM fu JOIN c ON fu.chunk_id = c.id JOIN f ON c.file_id = f.id",
    "chunks", "files", raw=True,
)
def search_code(c, f):
    return tools.cited(_hits(c), c, f)


@query(
    r"""WITH l AS (SELECT file_id, id, start_line, unnest(string_split_regex(content, '\r?\n')) AS line, generate_subscripts(string_split_regex(content, '\r?\n'), 1) - 1 AS pos FROM c WHERE content IS NOT NULL AND start_line IS NOT NULL),
 n AS (SELECT file_id, start_line + pos AS n, arg_min(line, (id, pos)) AS line FROM l WHERE start_line + pos BETWEEN 1 AND 400 GROUP BY 1, 2)
 SELECT file_id, any_value(path) AS path, CAST(min(n) AS INTEGER) AS first, CAST(max(n) AS INTEGER) AS last, substring(string_agg(line, chr(10) ORDER BY n), 1, 8000) AS text FROM n JOIN f ON n.file_id = f.id GROUP BY 1""",
    "files", "chunks",
)
def read_files(f, c):
    return tools.file_lines(f, c)


@query("SELECT repo_id, count(*) AS total, count(embedding) AS embedded, count(embedding) > 0 AS search_ready FROM c JOIN f ON c.file_id = f.id GROUP BY 1", "chunks", "files")
def embedding_coverage(c, f):
    return retrieval.embedding_coverage(c, f)


@query(None, "chunks")
def embed_missing(c):
    return retrieval.embed_missing(c, DIM)


# Graph --------------------------------------------------------------------------------------------------

_EDGES = "g AS (SELECT DISTINCT source_file_id AS s, target_file_id AS t FROM e WHERE source_file_id <> target_file_id)"
_TOP = "roots AS (SELECT t AS root FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)"
_REACH = f"""WITH RECURSIVE {_EDGES}, {_TOP}, w AS (SELECT root, root AS id, 0 AS depth FROM roots UNION SELECT w.root, g.s, w.depth + 1 FROM w JOIN g ON g.t = w.id WHERE w.depth < 3),
 b AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0), reach AS (SELECT root, id, depth FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, id) AS k FROM b) WHERE k <= 2000)"""


def _roots(e: DataFrame) -> DataFrame:
    """The ten files with the most importers."""
    g = graph.clean_edges(e).select("source", "target").distinct()
    return g.groupBy(F.col("target").alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(10).select("root")


@query(f"{_REACH} SELECT root, reach.id, path, language, depth FROM reach JOIN f ON reach.id = f.id", "file_edges", "files")
def impact_reach(e, f):
    return graph.impact(f, e, _roots(e))


@query(
    f"{_REACH}, p AS (SELECT root, reach.id, path, language, depth, row_number() OVER (PARTITION BY root ORDER BY depth, path, reach.id) AS k, count(*) OVER (PARTITION BY root) AS total FROM reach JOIN f ON reach.id = f.id) SELECT root, id, path, language, depth, total FROM p WHERE k <= 100",
    "file_edges", "files",
)
def impact_shown(e, f):
    return tools.shown_impact(graph.impact(f, e, _roots(e)))


@query(f"{_REACH} SELECT root, depth, count(*) AS files FROM reach GROUP BY 1, 2", "file_edges")
def impact_rings(e):
    return graph.rings(graph.reverse_reach(e, _roots(e)))


@query(f"{_REACH} SELECT root, count(reach.id) AS affected, coalesce(max(depth), 0) AS reached_depth, count(reach.id) >= 2000 AS truncated FROM roots LEFT JOIN reach USING (root) GROUP BY 1", "file_edges")
def impact_summary(e):
    roots = _roots(e)
    return graph.reach_summary(graph.reverse_reach(e, roots), roots)


@query(
    f"""WITH {_EDGES}, b AS (SELECT s AS file_id, 'imports' AS direction, t AS id FROM g UNION ALL SELECT t, 'imported_by', s FROM g),
 n AS (SELECT b.file_id, direction, path, row_number() OVER (PARTITION BY b.file_id, direction ORDER BY path, f.id) AS k FROM b JOIN f ON b.id = f.id WHERE b.file_id IN (SELECT id FROM f))
 SELECT file_id, direction, path FROM n WHERE k <= 50""",
    "files", "file_edges",
)
def file_dependencies(f, e):
    return graph.dependencies(f, e)


@query(f"WITH g AS (SELECT DISTINCT source_file_id AS s, target_file_id AS t, edge_type FROM e WHERE source_file_id <> target_file_id), n AS (SELECT repo_id, count(*) AS nodes FROM f GROUP BY 1), x AS (SELECT repo_id, count(*) AS edges FROM g JOIN f ON g.s = f.id GROUP BY 1) SELECT n.repo_id, nodes, coalesce(edges, 0) AS edges FROM n LEFT JOIN x ON n.repo_id = x.repo_id", "files", "file_edges")
def repo_graph(f, e):
    return graph.repo_graph(f, e)


_SLASH = _DIR.replace("path", r"replace(path, '\', '/')")


@query(
    f"WITH {_EDGES}, d AS (SELECT id, repo_id, {_SLASH} AS dir FROM f) SELECT a.repo_id, a.dir AS source_dir, b.dir AS target_dir, count(*) AS edges FROM g JOIN d a ON g.s = a.id JOIN d b ON g.t = b.id WHERE a.repo_id = b.repo_id AND a.dir <> b.dir GROUP BY 1, 2, 3",
    "files", "file_edges",
)
def directory_rollup(f, e):
    return graph.directory_edges(f, e)


@query(f"WITH {_EDGES}, n AS (SELECT t, count(*) AS k FROM g GROUP BY 1) SELECT id AS file_id, coalesce(k, 0) AS importers, CASE WHEN coalesce(k, 0) > 5 THEN 'HIGH' WHEN coalesce(k, 0) <= 2 THEN 'LOW' END AS label FROM f LEFT JOIN n ON f.id = n.t", "files", "file_edges")
def blast_labels(f, e):
    return graph.blast_label(f, e)


_ID = "concat('n_', regexp_replace({}, '[^A-Za-z0-9_]', '_', 'g'))"
_LABEL = "replace(replace({}, '\"', '&quot;'), chr(10), ' ')"


_CHART = f"""WITH {_EDGES}, n AS (SELECT id, repo_id, replace(path, '\\', '/') AS path FROM f), k AS (SELECT repo_id, CASE WHEN count(*) > 80 THEN 'directories' ELSE 'files' END AS mode FROM n GROUP BY 1),
 d AS (SELECT n.*, mode, {_DIR} AS dir FROM n JOIN k USING (repo_id)), p AS (SELECT DISTINCT a.repo_id, a.dir AS sd, b.dir AS td FROM g JOIN d a ON g.s = a.id JOIN d b ON g.t = b.id WHERE a.repo_id = b.repo_id AND a.dir <> b.dir AND a.mode = 'directories'),
 x AS (SELECT repo_id, mode, 0 AS part, '' AS dir, 0 AS kind, '' AS path, 'flowchart LR' AS line FROM k
 UNION ALL SELECT id, 'empty', unnest([0, 1]), '', 0, '', unnest(['flowchart LR', '  empty[No files indexed yet]']) FROM r WHERE id NOT IN (SELECT repo_id FROM k WHERE repo_id IS NOT NULL)
 UNION ALL SELECT DISTINCT repo_id, mode, 1, dir, 0, '', concat(CASE WHEN mode = 'files' THEN '  subgraph ' ELSE '  ' END, {_ID.format("concat('dir_', dir)")}, '["', {_LABEL.format("dir")}, '"]') FROM d
 UNION ALL SELECT repo_id, mode, 1, dir, 1, path, concat('    ', {_ID.format("id")}, '["', {_LABEL.format(_BASE)}, '"]') FROM d WHERE mode = 'files'
 UNION ALL SELECT DISTINCT repo_id, mode, 1, dir, 2, '', '  end' FROM d WHERE mode = 'files'
 UNION ALL SELECT repo_id, mode, 2, '', 0, '', concat('  ', {_ID.format("s")}, ' --> ', {_ID.format("t")}) FROM g JOIN d ON g.s = d.id WHERE mode = 'files'
 UNION ALL SELECT repo_id, 'directories', 2, '', 0, '', concat('  ', {_ID.format("concat('dir_', sd)")}, ' --> ', {_ID.format("concat('dir_', td)")}) FROM p)"""


@query(f"{_CHART} SELECT * FROM x", "files", "file_edges", "repos")
def diagram_text(f, e, r):
    return graph.diagram_lines(f, e, r)


@query(f"{_CHART} SELECT repo_id, string_agg(line, chr(10) ORDER BY part, dir, kind, path, line) AS text FROM x WHERE mode <> 'directories' GROUP BY 1", "files", "file_edges", "repos")
def diagram_file_texts(f, e, r):
    return graph.diagram_texts(graph.diagram_lines(f, e, r))


@query(
    """WITH q AS (SELECT id FROM r WHERE status = 'ready'), g AS (SELECT id FROM f WHERE repo_id IN (SELECT id FROM q))
 SELECT source_file_id, target_file_id, edge_type FROM e WHERE NOT coalesce(source_file_id IN (SELECT id FROM g), false)
 UNION ALL SELECT DISTINCT target_file_id, source_file_id, 'reverse' FROM e WHERE source_file_id <> target_file_id AND target_file_id IN (SELECT id FROM g) AND source_file_id IN (SELECT id FROM f)""",
    "file_edges", "files", "repos",
)
def rebuild_edges(e, f, r):
    # the edges of ready repositories are replaced by those that point the other way
    found = e.select(F.col("target_file_id").alias("source_file_id"), F.col("source_file_id").alias("target_file_id"), F.lit("reverse").alias("edge_type"))
    return graph.rebuild_edges(e, f, r.filter("status = 'ready'").select(F.col("id").alias("repo_id")), found)


_SPELLED = r"regexp_replace(replace(path, '\', '/'), '^\./', '')"


def _spelled(f: DataFrame) -> DataFrame:
    """Files under one spelling of their paths."""
    return f.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", ""))


@query(
    f"""WITH {_EDGES}, n AS (SELECT id, repo_id, {_SPELLED} AS path FROM f) SELECT DISTINCT a.repo_id, a.path AS source, b.path AS target FROM g JOIN n a ON g.s = a.id JOIN n b ON g.t = b.id WHERE a.repo_id = b.repo_id AND a.path <> b.path""",
    "files", "file_edges",
)
def resolve_script_imports(f, e):
    # each edge is spelled as a relative import and resolved again: what comes back are the edges
    rows = _spelled(f)
    return graph.resolve_js(graph.relative_specifiers(rows, e), rows)


@query(
    f"""WITH {_EDGES}, n AS (SELECT id, repo_id, {_SPELLED} AS path FROM f), x AS (SELECT a.repo_id, a.path AS source, regexp_replace(b.path, '(/__init__)?\\.py$', '') AS module, b.path AS p FROM g JOIN n a ON g.s = a.id JOIN n b ON g.t = b.id
  WHERE a.repo_id = b.repo_id AND a.path <> b.path AND ends_with(b.path, '.py') AND NOT contains(regexp_replace(b.path, '\\.py$', ''), '.')),
 y AS (SELECT repo_id, source, module, unnest([1, 2, 3, 4]) AS pos, unnest(['.py', '.pyi', '/__init__.py', '/__init__.pyi']) AS tail FROM x)
 SELECT DISTINCT repo_id, source, target FROM (SELECT y.repo_id, source, arg_min(concat(module, tail), pos) AS target FROM y JOIN n ON n.repo_id = y.repo_id AND n.path = concat(module, tail) GROUP BY 1, 2, module) WHERE source <> target""",
    "files", "file_edges",
)
def resolve_python_imports(f, e):
    rows = _spelled(f)
    refs = graph.relative_specifiers(rows, e).filter(F.col("specifier").endswith(".py"))
    inner = F.regexp_replace(F.regexp_replace("specifier", r"^(\.\./)+|^\./", ""), r"(/__init__)?\.py$", "")
    up = F.length(F.regexp_extract("specifier", r"^((?:\.\./)*)", 1)) / 3
    refs = refs.filter(~inner.contains(".")).withColumn("specifier", F.concat(F.repeat(F.lit("."), (up + 1).cast("int")), F.replace(inner, F.lit("/"), F.lit("."))))
    return graph.resolve_python(refs, rows)


# Chunking -----------------------------------------------------------------------------------------------


def _sources(c: DataFrame, f: DataFrame) -> DataFrame:
    return c.join(f.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("doc_id"), "path", F.col("content").alias("text"))


@query(None, "chunks", "files")
def chunk_sources(c, f):
    return chunking.chunk_sources(_sources(c, f))


_SCRIPTS = r"\.(ts|tsx|js|jsx|mjs)$"


@query(
    f"""WITH {_EDGES}, n AS (SELECT id, repo_id, {_SPELLED} AS path FROM f), x AS (SELECT DISTINCT a.repo_id, a.path, concat(CASE WHEN len(string_split(a.path, '/')) > 1 THEN repeat('../', len(string_split(a.path, '/')) - 1) ELSE './' END, b.path) AS specifier
  FROM g JOIN n a ON g.s = a.id JOIN n b ON g.t = b.id WHERE a.repo_id = b.repo_id AND regexp_matches(a.path, '{_SCRIPTS}'))
 SELECT concat(repo_id, ':', path) AS doc_id, path, specifier, CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY specifier) AS INTEGER) AS line FROM x""",
    "files", "file_edges",
)
def extract_imports(f, e):
    # sources written from the edges: an import statement a line, sorted by specifier
    refs = graph.relative_specifiers(_spelled(f), e).filter(F.col("path").rlike(_SCRIPTS))
    line = F.concat(F.lit("import { x } from '"), "specifier", F.lit("';"))
    docs = refs.groupBy("repo_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("specifier", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return chunking.extract_imports(docs.select(F.concat_ws(":", "repo_id", "path").alias("doc_id"), "path", "text"))


def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("path"), "text")
    return chunking.chunk_texts(docs)


def pull_review_patches(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").filter("source = 'pr_review' and text is not null")
    return docs.select("doc_id", S.clipped(F.col("text"), 1500, "\n… (patch truncated)").alias("patch"))


@query(
    f"""WITH {_RUNS} SELECT repo_id, path, content_hash, state FROM (SELECT repo_id, path, content_hash, 'kept' AS state FROM old WHERE repo_id NOT IN (SELECT repo_id FROM new)
 UNION ALL SELECT new.repo_id, new.path, new.content_hash, CASE WHEN old.id IS NULL THEN 'new' WHEN new.content_hash IS NOT DISTINCT FROM old.content_hash THEN 'unchanged' ELSE 'changed' END FROM new LEFT JOIN old ON old.repo_id = new.repo_id AND old.path = new.path)""",
    "files", "chunks", "file_edges",
)
def index_run(f, c, e):
    # the files as they were are indexed again from what came later; their texts are those of their chunks
    old, new = (df.filter("repo_id is not null and path is not null") for df in _runs(f))
    said = c.filter("content is not null").select(F.col("file_id").alias("id"), "start_line", F.col("id").alias("chunk_id"), "content")
    # files beyond the walk's cap are never indexed, so no text that is put together is larger
    small = said.groupBy("id").agg(F.sum(F.length("content") + 1).alias("n")).filter(F.col("n") <= LIMITS.file_bytes).select("id")
    texts = said.join(small, "id", "left_semi").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "content"))), lambda x: x["content"]), "\n").alias("text"))
    done = indexing.index_repositories(old, c, e, new.join(texts, "id", "left"))
    return done.files.join(done.states, ["repo_id", "path"], "left").select("repo_id", "path", "content_hash", F.coalesce("state", F.lit("kept")).alias("state"))


# Streaming ----------------------------------------------------------------------------------------------


def push_requests(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries made of the repositories' own rows, streamed and joined with the repositories."""
    repos = rows_once(table(spark, root, "repos"))
    stream = spark.readStream.schema(SCHEMAS["repos"]).parquet(f"{root}/repos.parquet*")
    body = F.to_json(F.struct(F.concat(F.lit("refs/heads/"), "default_branch").alias("ref"), (F.col("status") == "failed").alias("deleted"), F.struct(F.col("github_url").alias("html_url"), "default_branch", F.col("name").alias("full_name")).alias("repository")))
    sent = stream.select(F.concat(F.lit("push-"), "id").alias("id"), body.alias("body"))
    return events.drain(events.index_requests(sent, repos), spark, "requests").distinct()


def job_progress(spark: SparkSession, root: str) -> DataFrame:
    """Latest job of each repository as a streaming aggregate in update mode."""
    stream = spark.readStream.schema(SCHEMAS["index_jobs"]).parquet(f"{root}/index_jobs.parquet*")
    rows = events.drain(events.job_progress(stream), spark, "progress", "update")
    last = rows.groupBy("repo_id").agg(F.max_by(F.struct("created_at", "id", "status", "progress"), F.struct("batch", "created_at", "id")).alias("j"))
    return last.select("repo_id", F.unix_micros("j.created_at").alias("created_at"), "j.id", "j.status", "j.progress")


def queue_once(spark: SparkSession, root: str) -> DataFrame:
    """Jobs taken from a stream of their rows: each id once, however often it is delivered."""
    stream = spark.readStream.schema(SCHEMAS["index_jobs"]).option("maxFilesPerTrigger", 4).parquet(f"{root}/index_jobs.parquet*")
    return events.take_once(stream, spark)


def incremental_files(spark: SparkSession, root: str) -> DataFrame:
    """The files as a stream of indexing runs leaves them: the last row of each path."""
    stream = spark.readStream.schema(SCHEMAS["files"]).option("maxFilesPerTrigger", 4).parquet(f"{root}/files.parquet*")
    return events.index_changes(stream.filter("id is not null"), spark)[0].select("repo_id", "path", "id", "content_hash")


_WIDE = r"[\s\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNITS = "CAST(ceil((len({0}) + len(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) / 4.0) AS BIGINT)"
_NL = "len({0}) - len(replace({0}, chr(10), ''))"

#: Paragraphs folded one after the other: a held piece, and what is emitted at each step.
_TEXT_CHUNKS = f"""WITH RECURSIVE t AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
 z AS (SELECT *, NOT regexp_full_match(line, '{_WIDE}*') AS said FROM l),
 g AS (SELECT *, sum(CASE WHEN said THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM z),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, min(pos) AS spot, string_agg(line, chr(10) ORDER BY pos) AS body FROM g WHERE said GROUP BY doc_id, para)),
 f AS (SELECT doc_id, k, n, spot AS held_at, body AS held, CAST(NULL AS BIGINT) AS out_at, CAST(NULL AS VARCHAR) AS out FROM b WHERE k = 1
  UNION ALL SELECT doc_id, k, n, CASE WHEN step = 'grow' THEN held_at WHEN step = 'close' THEN NULL ELSE spot END, CASE WHEN step = 'grow' THEN both_ WHEN step = 'close' THEN NULL ELSE body END,
   CASE WHEN step IN ('full', 'close') THEN held_at END, CASE WHEN step = 'full' THEN held WHEN step = 'close' THEN both_ END
  FROM (SELECT b.doc_id, b.k, b.n, b.spot, b.body, f.held_at, f.held, concat(f.held, chr(10), chr(10), b.body) AS both_,
   CASE WHEN f.held IS NULL THEN 'begin' WHEN {_UNITS.format("concat(f.held, chr(10), chr(10), b.body)")} > {LIMITS.max_chunk_tokens} THEN 'full' WHEN {_UNITS.format("concat(f.held, chr(10), chr(10), b.body)")} >= {LIMITS.min_chunk_tokens} THEN 'close' ELSE 'grow' END AS step
   FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1)),
 e AS (SELECT doc_id, k * 2 AS o, out_at AS spot, out AS body FROM f WHERE out IS NOT NULL UNION ALL SELECT doc_id, k * 2 + 1, held_at, held FROM f WHERE k = n AND held IS NOT NULL)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS piece, CAST(NULL AS VARCHAR) AS symbol_name, 'other' AS symbol_type, CAST(spot AS INTEGER) AS start_line, CAST(spot + {_NL.format("body")} AS INTEGER) AS end_line, body AS content FROM e
 UNION ALL SELECT doc_id, 0, NULL, 'module', 1, CAST({_NL.format("text")} + 1 AS INTEGER), text FROM t WHERE doc_id NOT IN (SELECT doc_id FROM b)"""

QUERIES |= {f.__name__: f for f in (chunk_documents, pull_review_patches, push_requests, job_progress, queue_once, incremental_files)}
SQL |= {
    "chunk_documents": _TEXT_CHUNKS,
    "pull_review_patches": "SELECT doc_id, CASE WHEN len(text) > 1500 THEN concat(substring(text, 1, 1500), chr(10), '… (patch truncated)') ELSE text END AS patch FROM documents WHERE source = 'pr_review' AND text IS NOT NULL",
    "queue_once": "SELECT DISTINCT id AS job_id, repo_id, status FROM index_jobs WHERE id IS NOT NULL AND repo_id IS NOT NULL",
    "incremental_files": "SELECT repo_id, path, id, content_hash FROM (SELECT DISTINCT ON (id) * FROM files WHERE id IS NOT NULL AND repo_id IS NOT NULL AND path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY created_at DESC NULLS LAST, id DESC) = 1",
    "push_requests": r"""WITH r AS (SELECT DISTINCT ON (id) *, lower(regexp_replace(regexp_replace(trim(github_url), '^https?://', ''), '(\.git)?/*$', '')) AS url FROM repos)
 SELECT concat('push-', a.id) AS job_id, b.id AS repo_id, a.url AS url FROM r a JOIN r b ON a.url = b.url WHERE a.default_branch <> '' AND NOT coalesce(a.status = 'failed', false)""",
    "job_progress": "SELECT repo_id, epoch_us(created_at) AS created_at, id, status, CAST(greatest(0, least(100, coalesce(progress, 0))) AS INTEGER) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC NULLS LAST, id DESC) AS k FROM (SELECT DISTINCT ON (id) * FROM index_jobs WHERE repo_id IS NOT NULL)) WHERE k = 1",
}
