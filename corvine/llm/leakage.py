"""Evaluation passages in training documents, by Wu-Manber multi-pattern search over words.

A leak is a run of at least ``min_words`` consecutive words of an item's question or answer. Of each
item text every ``stride``-th run of ``m = min_words - stride + 1`` words is a pattern, so any leaked
run holds a whole pattern. The patterns' blocks of two words give the shift table: a block that is in
no pattern lets the search skip ``m - 1`` words, one inside a pattern as many as it takes to bring it
to a pattern's end. Where the shift is zero, the bucket of patterns that end in this block is compared
word by word, and a match is extended both ways to the whole run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of item text searched for in one pass; more items are searched in further shards.
WORDS_PER_SHARD = 400_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case."""
    return _WORD.findall(text.lower()) if text else []


class WuManber:
    """Shift table, suffix buckets and direct comparison over the words of the item texts."""

    def __init__(self, texts: list[tuple[int, str, list[str]]], min_words: int) -> None:
        self.min_words = min_words
        stride = max(1, min_words // 2)
        self.m = m = min_words - stride + 1
        self.texts = texts
        self.skip = m - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for number, (_, _, words) in enumerate(texts):
            if len(words) < min_words:
                continue
            for at in sorted({*range(0, len(words) - m + 1, stride)}):
                for j in range(m - 1):
                    block = (words[at + j], words[at + j + 1])
                    self.shift[block] = min(self.shift.get(block, self.skip), m - 2 - j)
                end = (words[at + m - 2], words[at + m - 1])
                self.bucket.setdefault(end, {}).setdefault(tuple(words[at : at + m]), []).append((number, at))

    def search(self, words: list[str]) -> dict[tuple[int, str], tuple[int, int]]:
        """(item, field) -> (longest leaked run in words, its first word) in a document."""
        found: dict[tuple[int, str], tuple[int, int]] = {}
        shift, skip, m, n = self.shift.get, self.skip, self.m, len(words)
        if n < self.min_words:
            return found
        i = m - 1
        while i < n:
            block = (words[i - 1], words[i])
            step = shift(block, skip)
            if step:
                i += step
                continue
            start = i - m + 1
            for number, at in self.bucket[block].get(tuple(words[start : i + 1]), ()):
                item, field, text = self.texts[number]
                lo, hi = 0, m
                while lo < at and lo < start and text[at - lo - 1] == words[start - lo - 1]:
                    lo += 1
                while at + hi < len(text) and start + hi < n and text[at + hi] == words[start + hi]:
                    hi += 1
                if lo + hi >= self.min_words and lo + hi > found.get((item, field), (0, 0))[0]:
                    found[item, field] = (lo + hi, start - lo)
            i += 1
        return found


def leaks(documents: DataFrame, items: DataFrame, *, min_words: int = 12, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """(doc_id, item_id, field, n_words, first_word): the longest leaked run of each item text in a document.

    Null ids or texts, and texts shorter than ``min_words`` words, leak nothing; ids are not required to
    be unique, and repeated results are merged. Empty tables give an empty result. Other columns are
    ignored. The item table is collected in shards of at most ``words_per_shard`` words (held-out sets do
    not grow with the corpus); each shard is one pass over the documents, which are never shuffled.
    """
    spark = documents.sparkSession
    fields = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("question", "answer")])).alias("x"),
    ).select("item_id", "x.field", "x.text").filter("item_id is not null and text is not null").distinct()
    shards: list[list[tuple[int, str, list[str]]]] = [[]]
    size = 0
    for row in fields.toLocalIterator():
        words = words_of(row["text"])
        if size + len(words) > words_per_shard and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append((row["item_id"], row["field"], words))
        size += len(words)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")

    def one(texts) -> DataFrame:
        shared = spark.sparkContext.broadcast(WuManber(sorted(texts), min_words))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            search = shared.value.search
            for pdf in batches:
                out = []
                for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                    for (item, field), (n, at) in search(words_of(text)).items():
                        out.append((doc, item, field, n, at))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "field", "n_words", "first_word"])

        return source.mapInPandas(run, "doc_id long, item_id long, field string, n_words int, first_word int")

    hits = one(shards[0])
    for texts in shards[1:]:
        hits = hits.unionByName(one(texts))
    best = F.max_by(F.struct("n_words", "first_word"), F.struct("n_words", -F.col("first_word")))
    return hits.groupBy("doc_id", "item_id", "field").agg(best.alias("b")).select("doc_id", "item_id", "field", "b.n_words", "b.first_word")
