"""Files that are not hand-written: generated, minified, vendored, or data saved as code.

1. Token rules on the path, the language and the size name the plain cases.
2. Every content hash of a vendored file marks its copies, wherever they lie.
3. Edited copies: lines of the indexed chunks form an inverted index. A line is rare if files of few
   names hold it; versions and copies of a file share a name, so a popular library does not make its own
   lines common. A file of which nearly all rare lines stand in one vendored file (in any of its
   versions) of other repositories is a copy; common lines (licence heads, boilerplate) count neither for
   nor against it. Each line first carries only whether any vendored file of another repository holds it:
   containment in all of them together is necessary, costs one aggregation over the postings, and leaves
   few files, for which the lines held by each single source are then counted. No pair of files is formed
   for any other.
4. The composition of what is left tells minified code (its characters stand in very long lines without
   blanks), generated code (its head says so) and data (nearly all of it is literals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.scratch import cut

#: Bytes from which a file with the extension of a programming language is bulk data.
DATA_BYTES = 200 * 1024
#: Below this size, where standard files are alike by chance, a content is third-party if most of its holders are.
TINY_BYTES = 2 * 1024
#: Shortest line of the index; most names of files that hold a rare line; least lines and share of a copy.
LINE_CHARS, RARE_NAMES, COPY_LINES, COPY_SHARE = 20, 500, 5, 0.8
#: Least share of a copy's bytes that the held lines make up: a snippet in a long file makes no copy of it.
COPY_BYTES_SHARE = 0.5
#: Characters of a very long line; least share of a minified file's characters in such lines, and most of blanks.
LONG_LINE, LONG_SHARE, BLANK_SHARE = 500, 0.6, 0.08
#: Least share of a data file's characters in numbers, strings and what separates them, and least characters of it.
LITERAL_SHARE, LITERAL_CHARS = 0.9, 4_000

# Names by which tools, package managers and bundlers mark what they write.
_CODE_EXTENSIONS = "c cc cpp cs cxx dart ex go h hpp java jl js jsx kt lua m mjs cjs mm php pl py r rb rs scala sh sql swift ts tsx vb zig"
_VENDOR_DIRS = "node_modules|bower_components|jspm_packages|web_modules|vendor|vendored|third[-_]?party|3rd[-_]?party|external|externals|deps|site-packages|dist-packages|pods|carthage|godeps|_vendor"
_GENERATED_DIRS = "__generated__|generated|autogen|autogenerated|auto-generated|gen|codegen-output|generated-sources|generated-src|gensrc|src-gen"
_ASSET_DIRS = "assets|static|public|web|site|dist|build|www|htdocs|js|scripts|plugins"
_GENERATED_BASES = (
    r"[._-]generated\.",
    r"[._-]autogenerated\.",
    r"^zz_generated",
    r"_gen\.go$",
    r"\.gen\.\w+$",
    r"\.pb(?:\.gw|\.validate|_grpc)?\.(?:go|cc|h|c|py|rb|dart|swift|ts|js)$",
    r"_(?:grpc_)?pb2?\.(?:py|pyi|js|ts|d\.ts)$",
    r"_pb2(?:_grpc)?\.pyi?$",
    r"\.g\.(?:cs|dart)$",
    r"\.g\.i\.cs$",
    r"\.designer\.cs$",
    r"\.freezed\.dart$",
    r"^lex\.[^.]+\.(?:c|cc|cpp)$",
    r"\.(?:tab|yy)\.(?:c|h|cc|cpp|hpp)$",
    r"^mock_\w+\.go$",
    r"_mock_gen\.go$",
    r"_string\.go$",
    r"^(?:package-lock|npm-shrinkwrap)\.json$",
    r"^(?:yarn|poetry|cargo|composer|gemfile|pipfile)\.lock$",
    r"^pnpm-lock\.yaml$",
    r"^go\.sum$",
)


def plain_path(path: Column) -> Column:
    """One spelling of a path: forward slashes, no leading ``./`` or ``/``, no doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"[\\/]+", "/"), r"^(?:\./|/)+", "")


def plain_name(path: Column) -> Column:
    """The file's name in lower case, without a version or a mark of minified code; versions of a file share it."""
    base = F.lower(F.element_at(F.split(plain_path(path), "/"), -1))
    return F.regexp_replace(F.regexp_replace(base, r"[-_.@]?v?\d+(?:\.\d+)+", ""), r"[._-]min(?=\.)", "")


def plain_source(path: Column) -> Column:
    """The last folder and the plain name: which file of which library, in any version."""
    folder = F.element_at(F.split(F.lower(plain_path(path)), "/"), -2)
    return F.concat_ws("/", F.regexp_replace(folder, r"[-_.@]?v?\d+(?:\.\d+)+", ""), plain_name(path))


def token_rule(path: Column, language: Column, size: Column) -> Column:
    """vendored, minified, generated, data, or null where no rule fits; null paths and sizes fit none."""
    spelled = plain_path(path)
    p = F.lower(spelled)
    base = F.element_at(F.split(p, "/"), -1)
    script = r"\.(?:js|mjs|cjs|css)$"
    vendored = (
        p.rlike(rf"(?:^|/)(?:{_VENDOR_DIRS})/")
        | p.rlike(r"(?:^|/)[a-z][a-z0-9_.]*[-@]v?\d+\.\d+(?:\.\d+)+[^/]*/")
        | base.rlike(r"^[a-z][\w.]*(?:-[a-z]\w*)*-v?\d+\.\d+\.\d+(?:[.-]min)?\.(?:\w+)$") & ~base.rlike(r"\.(?:md|txt|ya?ml|json|rst|html?)$")
    )
    # a bundler's hash: hexadecimal anywhere, or eight mixed characters in a folder of assets
    minified = base.rlike(script) & (
        base.rlike(r"[._-](?:min|bundle|packed|umd|iife)\.\w+$")
        | base.rlike(r"\.(?:min|bundle|packed|prod|chunk)\.(?:[0-9a-f]{6,}\.)?\w+$")
        | base.rlike(r"\.[0-9a-f]{8,40}\.\w+$")
        | base.rlike(r"-(?=[0-9a-f]*\d)[0-9a-f]{8,20}\.\w+$")
        | p.rlike(rf"(?:^|/)(?:{_ASSET_DIRS})/(?:.*/)?(?:index|chunk|main|app|vendor|runtime)-[\w-]{{8}}\.\w+$")
    )
    generated = p.rlike(rf"(?:^|/)(?:{_GENERATED_DIRS})/") | p.rlike(r"(?:^|/)drizzle/meta/[^/]+\.json$|(?:^|/)migrations/meta/[^/]+\.json$")
    for pattern in _GENERATED_BASES:
        generated = generated | base.rlike(pattern)
    code = F.regexp_extract(base, r"\.([a-z0-9]+)$", 1).isin(_CODE_EXTENSIONS.split())
    prose = F.coalesce(F.lower(language).isin("markdown", "text", "json", "yaml"), F.lit(False))
    data = code & ~prose & (size >= DATA_BYTES)
    return F.when(vendored, "vendored").when(minified, "minified").when(generated, "generated").when(data, "data")


# What generators write into the comment at the head of a file.
_COMMENT = r"[ \t]*(?://|#|--|;|/?\*+|<!--|\"\"\")"
_GENERATED_HEAD = rf"(?i)\A\s*(?:{_COMMENT}.*\r?\n)*?{_COMMENT}.*(?:@generated|\bauto-?generated\b|\bgenerated (?:by|from|code|file)\b|\bdo not edit\b)"
_LITERAL = r"\"[^\"\n]*\"|'[^'\n]*'|\b0[xX][0-9a-fA-F]+\b|\b[0-9][0-9._eE+-]*\b|[\s,;:{}\[\]()]"


def composition(chunks: DataFrame) -> DataFrame:
    """(file_id, composed): minified, generated or data by what the file's chunks are made of, else null."""
    text = F.col("content")
    n = F.length(text)
    rest = lambda pattern: n - F.length(F.regexp_replace(text, pattern, ""))
    rows = chunks.filter("file_id is not null and content is not null").select(
        "file_id", n.alias("n"), rest(rf"(?m)^.{{{LONG_LINE},}}$").alias("long"), rest(r"\s+").alias("blank"),
        rest(_LITERAL).alias("literal"), text.rlike(_GENERATED_HEAD).alias("marked"),
    )
    sums = rows.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("n", "long", "blank", "literal")], F.max("marked").alias("marked"))
    kind = (
        F.when(F.col("marked"), "generated")
        .when((F.col("long") >= LONG_SHARE * F.col("n")) & (F.col("blank") <= BLANK_SHARE * F.col("n")) & (F.col("literal") < LITERAL_SHARE * F.col("n")), "minified")
        .when((F.col("n") >= LITERAL_CHARS) & (F.col("literal") >= LITERAL_SHARE * F.col("n")), "data")
    )
    return sums.select("file_id", kind.alias("composed"))


def classified(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, kind, by, n_lines, n_held): each file id once; kind is null for hand-written files.

    ``by`` is rule, copy, lines or tokens; ``n_lines`` counts the distinct lines of a file that are long
    enough, ``n_held`` the rare ones that vendored files of other repositories hold (of edited copies,
    those that one source holds). Null paths, languages, sizes or hashes never match a rule; rows with
    equal id count once; chunks of unknown files, null or empty contents are ignored, and so are further
    columns. Empty tables give an empty result.
    """
    once = files.select("id", "repo_id", "path", "language", "content_hash", "size_bytes").filter("id is not null").dropDuplicates(["id"])
    once = once.withColumns({"rule": token_rule(F.col("path"), F.col("language"), F.col("size_bytes")), "name": plain_name(F.col("path"))})
    # copies by content: one row for each hash, so the join never multiplies
    third = F.coalesce(F.col("rule") == "vendored", F.lit(False))
    tiny = F.max(F.coalesce(F.col("size_bytes"), F.lit(0))) < TINY_BYTES
    hashes = once.filter("content_hash is not null").groupBy("content_hash").agg(
        (F.max(third) & (~tiny | (2 * F.count_if(third) > F.count("*")))).alias("copied"), F.min("name").alias("shared_name")
    )
    known = once.join(hashes, "content_hash", "left").select(
        F.col("id").alias("file_id"), "repo_id", "rule", "size_bytes", F.coalesce("rule", F.when(F.col("copied"), "vendored")).alias("kind"),
        F.xxhash64(F.coalesce("shared_name", "name", "id")).alias("name"), F.xxhash64(F.coalesce(plain_source(F.col("path")), "id")).alias("source"),
    )
    known = cut(known, "files")

    lines = chunks.filter("file_id is not null and content is not null").select("file_id", F.explode(F.split("content", "\r?\n")).alias("line"))
    lines = lines.select("file_id", F.trim("line").alias("line")).filter(F.length("line") >= LINE_CHARS)
    lines = lines.select("file_id", F.xxhash64("line").alias("line"), F.length("line").alias("size")).distinct()
    mine = F.coalesce("repo_id", F.lit(""))
    vendored = F.coalesce(F.col("kind") == "vendored", F.lit(False))
    owner = known.select("file_id", "name", "source", mine.alias("repo"), vendored.alias("vendored"), F.col("kind").isNull().alias("open"))
    postings = cut(lines.join(owner, "file_id"), "postings")
    from_repo = F.when(F.col("vendored"), F.col("repo"))
    index = postings.groupBy("line", "name").agg(F.count("*").alias("n"), F.min(from_repo).alias("lo"), F.max(from_repo).alias("hi"))
    index = index.groupBy("line").agg(F.sum("n").alias("n"), (F.count("*") > RARE_NAMES).alias("common"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    index = index.filter((F.col("n") > 1) & (F.col("common") | F.col("lo").isNotNull())).drop("n")
    elsewhere = (F.col("lo") != F.col("repo")) | (F.col("hi") != F.col("repo"))
    shared = cut(postings.filter("open").select("line", "file_id", "repo", "size").join(index, "line").filter(F.col("common") | elsewhere), "shared")
    held = shared.groupBy("file_id").agg(F.count_if(~F.col("common")).alias("n_held"), F.count_if("common").alias("n_common"))
    sizes = postings.groupBy("file_id").agg(F.count("*").alias("n_lines")).join(held, "file_id", "left")
    enough = lambda h: (h >= COPY_LINES) & (h >= COPY_SHARE * (F.col("n_lines") - F.col("n_common")))
    likely = sizes.filter(enough(F.col("n_held"))).join(known.select("file_id", "size_bytes"), "file_id").select("file_id", "n_lines", "n_common", "size_bytes")
    asked = shared.filter(~F.col("common")).select("line", "file_id", "repo", "size").join(likely, "file_id")
    sources = postings.filter("vendored").groupBy("line", "source").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"))
    single = asked.join(sources, "line").filter(elsewhere).groupBy("file_id", "source", "n_lines", "n_common", "size_bytes").agg(F.count("*").alias("n_one"), F.sum("size").alias("size"))
    covered = F.col("size") >= COPY_BYTES_SHARE * F.coalesce("size_bytes", F.lit(0))
    single = single.filter(enough(F.col("n_one")) & covered).groupBy("file_id").agg(F.max("n_one").alias("n_one"))
    out = known.join(sizes, "file_id", "left").join(single, "file_id", "left").join(composition(chunks), "file_id", "left")
    edited = F.col("n_one").isNotNull()
    return out.select(
        "file_id",
        F.coalesce("kind", F.when(edited, "vendored"), "composed").alias("kind"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("kind").isNotNull(), "copy").when(edited, "lines").when(F.col("composed").isNotNull(), "tokens").alias("by"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_one", "n_held", F.lit(0)).cast("long").alias("n_held"),
    )


def not_hand_written(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id) of every file that is generated, minified, vendored or data."""
    return classified(files, chunks).filter("kind is not null").select("file_id")
