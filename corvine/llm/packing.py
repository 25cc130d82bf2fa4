"""Filling containers of fixed capacity with texts, by sum-of-squares packing.

Sizes are tokens of a public tokenizer. A text longer than a container gives whole containers and one
remainder; everything else is never split. Items are spread over shards by hash; in a shard each item
goes to the open container, or a new one, that makes the sum of the squared numbers of open
containers per gap smallest. Containers that stay open with a wide gap are packed once more, across
shards, as items of their own; their number gives the number of tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.scratch import cut

CAPACITY = 2048
#: Rank file of a public byte-level tokenizer, and the public pattern that splits text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed by one task.
SHARD_ITEMS = 25_000
#: Containers with a wider gap, as a share of the capacity, are packed again across shards.
OPEN_SHARE = 1 / 16


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as rows:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rows)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): each text's tokens cut at the capacity; ``piece`` from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                n = len(encode(text))
                out += [(doc, i, at, min(capacity, n - at)) for i, at in enumerate(range(0, max(1, n), capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "first_token", "n_tokens"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return source.mapInPandas(run, "doc_id long, piece int, first_token long, n_tokens int")


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item, packed in the given order; items of size 0 fit anywhere."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; full ones are not counted
    open_at: dict[int, list[int]] = {}
    out, made = [], 0
    for s in sizes:
        if s == 0:
            if not made:
                made, open_at[capacity] = 1, [0]
            out.append(made - 1)
            continue
        if open_at.get(capacity):  # an empty container left by items of size 0
            best = capacity
        else:
            gaps = np.arange(s, capacity)
            old = count[s:capacity]
            # moving one container from gap g to gap g - s changes the sum of squares by this much
            change = np.where(old > 0, -2 * old + 1, 2**40)
            change[1:] += np.where(old[1:] > 0, 2 * count[1 : capacity - s] + 1, 0)
            new = 2 * count[capacity - s] + 1 if s < capacity else 0
            i = int(np.argmin(change)) if len(gaps) else -1
            best = int(gaps[i]) if i >= 0 and change[i] <= new else -1
        if best < 0:
            number, left = made, capacity - s
            made += 1
        else:
            number = open_at[best].pop()
            if best < capacity:
                count[best] -= 1
            left = best - s
        if left:
            count[left] += 1
            open_at.setdefault(left, []).append(number)
        out.append(number)
    return out


def packed(documents: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container, doc_id, piece, first_token, n_tokens): every text's pieces, each in one container.

    Null texts are no texts; an empty text is an item of no tokens. Rows with equal doc_id count once.
    An empty table gives an empty result. Other columns are ignored. Containers are named ``shard-number``.
    """
    items = cut(sized(documents, capacity=capacity, vocabulary=vocabulary).dropDuplicates(["doc_id", "piece"]), "items")
    full, rest = items.filter(F.col("n_tokens") == capacity), items.filter(F.col("n_tokens") < capacity)
    shards = max(1, -(-rest.count() // shard_items))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "piece"], ignore_index=True)
        shard = int(pdf["shard"].iloc[0])
        pdf["container"] = [f"{shard}-{n}" for n in sum_of_squares(pdf["n_tokens"].tolist(), capacity)]
        return pdf[["container", "doc_id", "piece", "first_token", "n_tokens"]]

    shape = "container string, doc_id long, piece int, first_token long, n_tokens int"
    spread = rest.withColumn("order", F.xxhash64("doc_id", "piece")).withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    first = cut(spread.groupBy("shard").applyInPandas(pack, shape), "packed")
    filled = first.groupBy("container").agg(F.sum("n_tokens").cast("int").alias("n_tokens"))
    loose = filled.filter(F.col("n_tokens") <= capacity * (1 - OPEN_SHARE))

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "container"], ascending=[False, True], ignore_index=True)
        group = int(pdf["shard"].iloc[0])
        pdf["joined"] = [f"again-{group}-{n}" for n in sum_of_squares(pdf["n_tokens"].tolist(), capacity)]
        return pdf[["container", "joined"]]

    # mostly a shard leaves some dozens, but where few small texts fill gaps it may leave them all
    groups = max(1, -(-loose.count() // shard_items))
    again = loose.withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(groups)).cast("int")).groupBy("shard").applyInPandas(repack, "container string, joined string")
    final = first.join(again, "container", "left").withColumn("container", F.coalesce("joined", "container")).drop("joined")
    alone = full.select(F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", "first_token", "n_tokens")
    return final.unionByName(alone)


def fill(documents: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """(containers, texts, tokens, least, fullest): how well ``packed`` fills; one row.

    ``least`` is the number of containers that so many tokens need at least, ``fullest`` the most tokens
    in one container. An empty table gives zeros.
    """
    by = packed(documents, capacity=capacity, **options).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count_if(F.col("piece") == 0).alias("texts"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return by.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), n.alias("tokens"),
        F.ceil(n / capacity).cast("long").alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"),
    )
