"""Vector and keyword ranking, rank fusion, and expansion of hits."""

from __future__ import annotations

import functools
import math
import operator
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.config import LIMITS
from corvine.functions import scalars as S
from corvine.functions.stemming import stem

#: Weight of a term in a symbol name (A) and in a content (B).
WEIGHT_A, WEIGHT_B = 1.0, 0.4
TOKEN = "[\\p{L}\\p{N}_]+"

# Fixed value: English function words that carry no meaning in a query.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def usable(vector, dim: int):
    """A vector of ``dim`` finite numbers that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine_to(query: list[float]):
    """Pandas UDF: cosine similarity of each vector with ``query``; one product for each Arrow batch."""
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q)

    @F.pandas_udf(T.DoubleType())
    def similarity(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, len(q)))
        return pd.Series(x @ q / np.linalg.norm(x, axis=1))

    return similarity


def _top(rows: DataFrame, k: int) -> DataFrame:
    """(chunk_id, score, rank): the k best ids of (chunk_id, score); ties go to the smaller id.

    Rows without a score drop out. Repeated rows share a dense rank, and Spark applies the limit on it inside each task (up to its
    ``windowGroupLimitThreshold`` of 1000), so about k rows of each task are shuffled, not all of them.
    """
    order = Window.orderBy(F.desc("score"), "chunk_id")
    few = rows.withColumn("n", F.dense_rank().over(order)).filter((F.col("n") <= k) & F.col("score").isNotNull())
    best = few.groupBy("chunk_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(order).cast("long"))


def vector_search(chunks: DataFrame, query: list[float], k: int = 10, digits: int = 6) -> DataFrame:
    """(chunk_id, score, rank): exact cosine top k; ties go to the smaller id.

    Null, short or unusable vectors are left out. A scan and a top-k of k rows for each task.
    """
    if not 1 <= k:
        raise ValueError("k must be at least 1")
    rows = chunks.select(F.col("id").alias("chunk_id"), "embedding").filter(usable(F.col("embedding"), len(query)))
    rows = rows.select("chunk_id", F.round(cosine_to(query)("embedding"), digits).alias("score"))
    return _top(rows, k)


def parse_query(text: str) -> list[list[tuple[list[str], bool]]]:
    """Alternatives of (words of a phrase, negated): bare words, "phrases", OR and -words; never fails."""
    out: list[list[tuple[list[str], bool]]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', text):
        word = m.group(3)
        if word and word.lower() == "or" and m.group(2) is None:
            out.append([])
            continue
        negated = m.group(1) == "-" or bool(word and word.startswith("-"))
        words = [w for w in re.findall(r"[^\W]+", (m.group(2) if m.group(2) is not None else word).lower()) if w not in STOP_WORDS]
        if words:
            out[-1].append((words, negated))
    return [a for a in out if a]


def keyword_search(chunks: DataFrame, terms: list[str], k: int = 10, mode: str = "or") -> DataFrame:
    """(chunk_id, score, rank) by unstemmed weighted term counts; ``mode`` is or, or and.

    A term counts 1 in the symbol name and 0.4 in the content. Null names and contents have no terms;
    no terms match nothing. Rows are filtered before ranking and only k leave each task.
    """
    terms = [t.lower() for t in terms]
    if not terms:
        return chunks.select(F.col("id").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)

    def count(col, t):
        return F.size(F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda x: x == t))

    named = chunks.columns
    weight = lambda t: (WEIGHT_A * count("symbol_name", t) if "symbol_name" in named else F.lit(0.0)) + WEIGHT_B * count("content", t)
    low = F.lower(F.concat_ws(" ", *[c for c in ("symbol_name", "content") if c in named]))
    near = [low.contains(t) for t in terms]  # cheap, before any token is cut
    some = near[0]
    for x in near[1:]:
        some = (some | x) if mode == "or" else (some & x)
    scores = [weight(t) for t in terms]
    total = scores[0]
    for x in scores[1:]:
        total = total + x
    met = [x > 0 for x in scores]
    full = met[0]
    for x in met[1:]:
        full = (full | x) if mode == "or" else (full & x)
    rows = chunks.filter(some).filter(full).select(F.col("id").alias("chunk_id"), F.round(total, 6).alias("score"))
    return _top(rows, k)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    """The stem of each word of each array."""
    return pd.Series([[stem(w) for w in row] for row in words])


def cover_density(hits: Column, n_terms: int) -> Column:
    """Sum over minimal covers of the number of terms' mean weight, damped by the noise inside.

    ``hits`` are structs (at, term, weight) by position. A cover from hit b to hit e holds every term and
    no shorter one ends at e; it scores ((e-b+1) / sum of 1/weight) / (1 + (span - hits)). One pass: the
    state is the last hit of each term, the start of the last cover, and the score so far.
    """
    start = F.struct(F.array_repeat(F.lit(-1), n_terms).alias("last"), F.lit(-1).alias("done"), F.lit(0).alias("e"), F.lit(0.0).alias("score"))

    def step(acc: Column, hit: Column) -> Column:
        last = F.transform(acc["last"], lambda x, t: F.when(t == hit["term"], acc["e"]).otherwise(x))
        b = F.array_min(last)
        size = acc["e"] - b + 1
        inside = F.aggregate(F.slice(hits, b + 1, size), F.lit(0.0), lambda sum_, h: sum_ + 1 / h["weight"])
        noise = F.greatest(F.lit(0), hit["at"] - F.element_at(hits, b + 1)["at"] - (size - 1))
        new = b > acc["done"]
        return F.struct(
            last.alias("last"), F.when(new, b).otherwise(acc["done"]).alias("done"), (acc["e"] + 1).alias("e"),
            F.when(new, acc["score"] + size / inside / (1 + noise)).otherwise(acc["score"]).alias("score"),
        )

    return F.aggregate(hits, start, step, lambda acc: acc["score"])


def full_text_search(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(chunk_id, score, rank): stemmed matches of a web-style query, ranked by cover density.

    Words are lower-cased and stemmed, function words keep their position but never match; names come
    before contents and weigh more. A query without words matches nothing. Tokens, phrases and covers
    are Spark expressions over one row's arrays; Python only stems the words that begin like one asked for.
    """
    parsed = [[([stem(w) for w in words], neg) for words, neg in alt] for alt in parse_query(query)]

    def starts(negated: bool) -> list[str]:
        """Beginnings of the words that may match: stemming changes the last two letters of a stem at most."""
        return sorted({p[: max(1, len(p) - 2)] for alt in parsed for words, neg in alt if negated or not neg for p in words})

    nothing = chunks.select(F.col("id").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    if not starts(False):
        return nothing
    any_of = lambda flags: functools.reduce(operator.or_, flags)
    all_of = lambda flags: functools.reduce(operator.and_, flags)
    low = F.lower(F.concat_ws(" ", "symbol_name", "content"))
    rows = chunks.filter(any_of([low.contains(x) for x in starts(False)])).select("id", "symbol_name", "content")

    def cut(name: str) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(TOKEN), F.lit(0))

    rows = rows.withColumn("names", cut("symbol_name"))
    placed = lambda words, offset, weight: F.transform(words, lambda w, i: F.struct((i + offset).alias("at"), w.alias("word"), F.lit(weight).alias("weight")))
    words = F.concat(placed(F.col("names"), F.lit(0), WEIGHT_A), placed(cut("content"), F.size("names"), WEIGHT_B))
    may = lambda x: any_of([x["word"].startswith(p) for p in starts(True)]) & ~x["word"].isin(*sorted(STOP_WORDS))
    rows = rows.select("id", F.filter(words, may).alias("near"))
    rows = rows.withColumn("stems", _stems(F.transform("near", lambda x: x["word"])))
    hits = F.zip_with("near", "stems", lambda x, s: F.struct(x["at"].alias("at"), s.alias("stem"), x["weight"].alias("weight")))
    rows = rows.select("id", hits.alias("hits"))

    def stands(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.exists("hits", lambda h: h["stem"] == phrase[0])
        follows = lambda h, d, p: F.exists("hits", lambda g: (g["at"] == h["at"] + d) & (g["stem"] == p))
        return F.exists("hits", lambda h: (h["stem"] == phrase[0]) & all_of([follows(h, d, p) for d, p in enumerate(phrase) if d]))

    scores, flags = [], []
    for n, alt in enumerate(parsed):
        terms = list(dict.fromkeys(w for phrase, neg in alt if not neg for w in phrase))
        if not terms:
            continue
        ok = all_of([~stands(phrase) if neg else stands(phrase) for phrase, neg in alt])
        made = F.transform(F.filter("hits", lambda h: h["stem"].isin(*terms)), _with_term(terms))
        rows = rows.withColumn(f"alt{n}", F.when(ok, F.array_sort(made)))
        flags.append(ok)
        scores.append(F.coalesce(cover_density(F.col(f"alt{n}"), len(terms)), F.lit(0.0)))
    if not scores:
        return nothing
    # no filter here: Spark would move it below and cut and stem every text twice
    total = F.when(any_of(flags), F.round(functools.reduce(operator.add, scores), 6))
    return _top(rows.select(F.col("id").alias("chunk_id"), total.alias("score")), k)


def _with_term(terms: list[str]):
    known = F.array(*[F.lit(t) for t in terms])
    return lambda h: F.struct(h["at"].alias("at"), (F.array_position(known, h["stem"]).cast("int") - 1).alias("term"), h["weight"].alias("weight"))


def fuse(vector: DataFrame, keyword: DataFrame, top_k: int = 10, rrf_k: int = LIMITS.rrf_k) -> DataFrame:
    """(chunk_id, score, source, vector_rank, keyword_rank, rank): reciprocal rank fusion of two rankings."""
    v = vector.select("chunk_id", F.col("rank").alias("vector_rank"))
    w = keyword.select("chunk_id", F.col("rank").alias("keyword_rank"))
    both = v.join(w, "chunk_id", "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    source = F.when(F.col("keyword_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "keyword").otherwise("both")
    order = [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank")]
    rows = both.select("chunk_id", F.round(part("vector_rank") + part("keyword_rank"), 9).alias("score"), source.alias("source"), "vector_rank", "keyword_rank")
    rows = rows.orderBy(*order).limit(top_k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def hybrid_search(chunks: DataFrame, query: list[float], terms: str | list[str], top_k: int = 10) -> DataFrame:
    """Both rankings to a depth of max(3 * top_k, 20), fused.

    A string is a web-style query of the stemmed full-text search; a list holds unstemmed terms.
    """
    depth = max(3 * top_k, 20)
    ranked = full_text_search(chunks, terms, depth) if isinstance(terms, str) else keyword_search(chunks, terms, depth)
    return fuse(vector_search(chunks, query, depth), ranked, top_k)


def of_extension(hits: DataFrame, chunks: DataFrame, files: DataFrame, extension: str | None = None) -> DataFrame:
    """``hits`` in files of one extension, by default that of the best hit; ranks stay as they were."""
    paths = chunks.select(F.col("id").alias("chunk_id"), "file_id").join(hits.select("chunk_id"), "chunk_id", "left_semi").distinct()
    paths = paths.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("chunk_id", S.extension(F.col("path")).alias("extension")).distinct()
    rows = hits.join(paths, "chunk_id")
    if extension is not None:
        return rows.filter(F.col("extension") == extension)
    best = rows.agg(F.min_by("extension", "rank").alias("wanted"))  # one row
    return rows.join(F.broadcast(best), F.col("extension").eqNullSafe(F.col("wanted"))).drop("wanted")


def siblings(chunks: DataFrame, hits: DataFrame, per_hit: int = 3) -> DataFrame:
    """(chunk_id, file_id, start_line): the first chunks of every hit file that are no hits themselves."""
    hit_files = chunks.join(hits.select(F.col("chunk_id").alias("id")), "id", "left_semi").select("file_id").distinct()
    rows = chunks.select(F.col("id").alias("chunk_id"), "file_id", "start_line").distinct()
    rows = rows.join(hit_files, "file_id", "left_semi").join(hits.select("chunk_id"), "chunk_id", "left_anti")
    order = Window.partitionBy("file_id").orderBy(F.asc_nulls_last("start_line"), "chunk_id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_hit).select("chunk_id", "file_id", "start_line")


def neighbours(chunks: DataFrame, edges: DataFrame, hits: DataFrame, per_hit: int = 3) -> DataFrame:
    """(chunk_id, file_id, start_line): first chunks of files one edge away from a hit file, in either direction."""
    hit_files = chunks.join(hits.select(F.col("chunk_id").alias("id")), "id", "left_semi").select("file_id").distinct()
    out = edges.join(hit_files.select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_semi").select(F.col("target_file_id").alias("file_id"))
    into = edges.join(hit_files.select(F.col("file_id").alias("target_file_id")), "target_file_id", "left_semi").select(F.col("source_file_id").alias("file_id"))
    near = out.unionByName(into).distinct().join(hit_files, "file_id", "left_anti")
    rows = chunks.select(F.col("id").alias("chunk_id"), "file_id", "start_line").distinct().join(near, "file_id", "left_semi")
    order = Window.partitionBy("file_id").orderBy(F.asc_nulls_last("start_line"), "chunk_id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_hit).select("chunk_id", "file_id", "start_line")


def expand(chunks: DataFrame, edges: DataFrame, hits: DataFrame, per_hit: int = 3) -> DataFrame:
    """(section, chunk_id, file_id): hits, then their siblings, then their neighbours."""
    first = chunks.select(F.col("id").alias("chunk_id"), "file_id").distinct().join(hits.select("chunk_id"), "chunk_id", "left_semi")
    parts = [
        first.select(F.lit("primary").alias("section"), "chunk_id", "file_id"),
        siblings(chunks, hits, per_hit).select(F.lit("sibling").alias("section"), "chunk_id", "file_id"),
        neighbours(chunks, edges, hits, per_hit).select(F.lit("neighbour").alias("section"), "chunk_id", "file_id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def embedding_coverage(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, total, embedded, search_ready) by repository."""
    rows = chunks.join(files.select(F.col("id").alias("file_id"), "repo_id"), "file_id")
    return rows.groupBy("repo_id").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded")).withColumn("search_ready", F.col("embedded") > 0)


def hashed_embedding(dim: int = 64):
    """Pandas UDF: deterministic embedding by feature hashing of words, L2-normalised; null for no words."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for text in texts:
            v = np.zeros(dim)
            for w in re.findall(r"[^\W]+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            n = math.sqrt(float(v @ v))
            out.append((v / n).astype(np.float32) if n else None)
        return pd.Series(out)

    return embed


def embed_missing(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_id, embedding): vectors for the chunks that have none; a second run finds nothing to do."""
    todo = chunks.filter(F.col("embedding").isNull()).select("id", "content").dropDuplicates(["id"])
    return todo.select(F.col("id").alias("chunk_id"), hashed_embedding(dim)("content").alias("embedding"))
