"""Scalar functions as Column expressions; all stay inside the JVM unless noted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.config import ACTIVE_STATUS, LIMITS
from corvine.functions import values as V

# Java's \s is ASCII; a script's trim also strips Unicode spaces and the byte order mark.
_SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
# Fixed pattern: a path with an extension, a line and perhaps a last line.
CITATION = r"([a-zA-Z0-9_./-]+\.[a-zA-Z]{1,6}):(\d+)(?:-(\d+))?"


def mapped(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def wide_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def directory(path: Column) -> Column:
    """What precedes the last slash; (root) where there is none."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", "(root)").otherwise(found)


def extension(path: Column) -> Column:
    """Lower-cased extension of the base name; null for names without one and for dot files."""
    found = F.regexp_extract(F.lower(basename(path)), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def detect_language(path: Column) -> Column:
    by_name = mapped(V.NAME_LANGUAGE, F.lower(basename(path)))
    return F.coalesce(by_name, mapped(V.EXTENSION_LANGUAGE, extension(path)))


def is_secret(path: Column) -> Column:
    return F.lower(basename(path)).rlike("|".join(V.SECRET_NAMES))


def has_binary_extension(path: Column) -> Column:
    return F.coalesce(extension(path).isin(V.BINARY_EXTENSIONS), F.lit(False))


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, V.SKIP_DIRS)))


def skip_reason(path: Column, size: Column) -> Column:
    """First filter that keeps a path out of the index, in the walk's order; null if none does."""
    return (
        F.when(in_skipped_dir(path), "skip_dir")
        .when(basename(path).isin(V.SKIP_FILES), "skip_file")
        .when(is_secret(path), "secret")
        .when(has_binary_extension(path), "binary")
        .when(size > LIMITS.file_bytes, "too_large")
    )


def has_nul(content: Column) -> Column:
    """A zero byte within the first bytes of a binary column."""
    return F.hex(F.substring(content, 1, LIMITS.sniff_bytes)).rlike("^(..)*?00")


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_units(text) / 4).cast("long")


def clipped(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def citations(text: Column) -> Column:
    """Array of every path:line or path:line-line in a text."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))


def diagrams(text: Column) -> Column:
    """Array of the bodies of closed diagram fences."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"```mermaid\s*\r?\n([\s\S]*?)\r?\n```"), F.lit(1)), lambda x: F.trim(x) != "")


def segments(text: Column) -> Column:
    """Array of struct(type, text): texts and the diagrams between them in order; empty ones drop out."""
    fence = r"```mermaid\s*\r?\n([\s\S]*?)\r?\n```"
    between = F.split(text, fence, -1)
    drawn = F.regexp_extract_all(text, F.lit(fence), F.lit(1))
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    both = F.transform(between, lambda x, i: F.array(part("text", x), part("mermaid", wide_trim(F.coalesce(F.get(drawn, i), F.lit(""))))))
    return F.filter(F.flatten(both), lambda x: x["text"] != "")


def trimmed_server(url: Column) -> Column:
    """An address without slashes at its end, so that a path can follow."""
    return F.regexp_replace(url, "/+$", "")


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def parse_repo_url(url: Column, hosts: tuple[str, ...] = ("github.com", "www.github.com")) -> Column:
    """struct(owner, repo, normalized_url, name, clone_url) or null; deep links and .git are accepted."""
    url = wide_trim(url)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    owner, repo = F.get(parts, 0), F.regexp_replace(F.get(parts, 1), r"\.git$", "")
    good = host.isin(*hosts) & owner.rlike("^[a-zA-Z0-9][a-zA-Z0-9-]{0,38}$") & repo.rlike("^[a-zA-Z0-9._-]{1,100}$")
    base = F.concat(F.lit(f"https://{hosts[0]}/"), owner, F.lit("/"), repo)
    made = F.struct(
        owner.alias("owner"), repo.alias("repo"), base.alias("normalized_url"),
        F.concat(owner, F.lit("/"), repo).alias("name"), F.concat(base, F.lit(".git")).alias("clone_url"),
    )
    return F.when(good, made)


def parse_pull_url(url: Column, hosts: tuple[str, ...] = ("github.com", "www.github.com")) -> Column:
    """struct(owner, repo, number) of /owner/repo/pull/N with N above zero, or null."""
    url = wide_trim(url)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    shape = r"^/([^/]+)/([^/]+)/pull/\s*\+?(\d+)"
    number = F.regexp_extract(path, shape, 3).try_cast("long")
    made = F.struct(F.regexp_extract(path, shape, 1).alias("owner"), F.regexp_extract(path, shape, 2).alias("repo"), number.alias("number"))
    return F.when(host.isin(*hosts) & (number > 0), made)


def normalize_remote(url: Column) -> Column:
    """host/owner/repo of an ssh or https remote, lower-cased."""
    out = wide_trim(url)
    for pattern, by in ((r"^git@([^:/]+):", "$1/"), (r"^https?://", ""), (r"^www\.", ""), (r"\.git$", ""), (r"/+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return F.lower(out)


def status_kind(status: Column) -> Column:
    return F.coalesce(mapped(V.STATUS_KIND, F.coalesce(status, F.lit("queued"))), F.lit("default"))


def status_label(status: Column) -> Column:
    key = F.coalesce(status, F.lit("queued"))
    return F.coalesce(mapped(V.STATUS_LABEL, key), key)


def is_active(repo_status: Column, job_status: Column) -> Column:
    return F.coalesce(repo_status.isin(*ACTIVE_STATUS), F.lit(False)) | F.coalesce(job_status.isin(*ACTIVE_STATUS), F.lit(False))


def help_topic(text: Column) -> Column:
    low = F.lower(text)
    rules = [(topic, reduce(lambda a, b: a | b, [low.contains(w) for w in words])) for topic, words in V.HELP_RULES]
    out = F.when(rules[0][1], rules[0][0])
    for topic, hit in rules[1:]:
        out = out.when(hit, topic)
    return out.otherwise(V.HELP_DEFAULT)


def clamp_progress(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(value))).cast("int")


def preview_text(parts: Column, content: Column) -> Column:
    """Text parts joined by newlines and trimmed; the content where parts is no JSON array."""
    rows = F.from_json(parts, "array<struct<type string, text string>>")
    texts = F.transform(F.filter(rows, lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: x["text"])
    return F.when(rows.isNull() | ~F.coalesce(F.ltrim(parts).startswith("["), F.lit(False)), F.coalesce(content, F.lit(""))).otherwise(wide_trim(F.array_join(texts, "\n")))


def title_of(text: Column, n: int = 80) -> Column:
    return F.when(F.length(wide_trim(text)) > 0, F.substring(wide_trim(text), 1, n)).otherwise("New conversation")


def diagram_id(raw: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(raw, "[^A-Za-z0-9_]", "_"))


def diagram_label(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit(" "))


def branch_of(ref: Column) -> Column:
    return F.regexp_extract(ref, "^refs/heads/(.+)$", 1)
