"""Long exact spans shared between records, by recurring-phrase automata.

1. Winnowing: of every ``min_chars - k + 1`` consecutive k-grams of a text (k a third of
   ``min_chars``) the one with the least hash is kept, so two texts that share a run of ``min_chars``
   characters keep a common k-gram inside it. Kept k-grams seen in two records are the phrases.
2. Phrases are confirmed by their text, not their hash, and compiled into Aho-Corasick automata, one
   for each shard. The phrases of a passage lie in one shard mostly: that of the least record which keeps
   them. A record is streamed through the automata of the shards in which it keeps a phrase (all others
   cannot match it inside a run), which locate every occurrence.
3. Occurrences carry the text around them up to the reach of a run. Equal surroundings form one class.
   Classes of a phrase are compared with each other; a phrase with very many classes is instead split
   by the exact windows of ``min_chars`` around it, so no phrase is compared in all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.scratch import cut

#: Kept phrases in an automaton, about.
PHRASES_PER_SHARD = 20_000
#: Characters streamed through an automaton in one task, about; larger shards are salted.
CHARS_PER_TASK = 16_000_000
#: Up to so many classes of a phrase are compared pairwise; beyond, exact windows are used. Both find the
#: same; a window costs a row for each of its places, a pair one for each other class.
PAIRWISE_CLASSES = 32

_MULT, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sliding(values: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op over values[i : i + w] for each i, in linear time."""
    n = len(values)
    blocks = -(-n // w) + 1
    padded = np.full(blocks * w, fill, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, w)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def kept_grams(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the k-grams that winnowing with windows of w keeps."""
    sizes = np.array([len(t) for t in texts])
    n = int(sizes.sum())
    none = np.zeros(0, np.int64)
    if n < k + w - 1:
        return none, none, none
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(0x51ED)) * _powers(_MULT, n), out=sums[1:])
    m = n - k + 1
    h = (sums[k:] - sums[:m]) * _powers(pow(_MULT, -1, 2**64), m)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(texts)), sizes)[:m]
    left = (ends[number] - np.arange(m)).astype(np.int64)  # characters from here to the text's end
    least = _sliding(np.where(left >= k, h, np.uint64(2**64 - 1)), w, np.minimum, np.uint64(2**64 - 1))
    least[left < k + w - 1] = 0  # a window must lie in one text
    top = _sliding(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((top == h) & (left >= k))
    return number[at], at - (ends - sizes)[number[at]], h[at].view(np.int64)


def _keep(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [i for i, t in enumerate(texts) if t is not None and ids[i] is not None and len(t) >= k + w - 1]
            lo = 0
            while lo < len(rows):  # blocks of a few million characters at most, or one text
                hi, total = lo, 0
                while hi < len(rows) and (hi == lo or total + len(texts[rows[hi]]) <= 2_000_000):
                    total += len(texts[rows[hi]])
                    hi += 1
                part = rows[lo:hi]
                lo = hi
                number, at, h = kept_grams([texts[i] for i in part], k, w)
                order = np.lexsort((at, h, number))
                number, at, h = number[order], at[order], h[order]
                if len(h):
                    new = np.r_[True, (h[1:] != h[:-1]) | (number[1:] != number[:-1])]
                    number, at, h = number[new], at[new], h[new]
                who = pa.array([ids[i] for i in part]).take(pa.array(number, pa.int64()))
                yield pa.RecordBatch.from_arrays([who, pa.array(h, pa.int64()), pa.array(at, pa.int32())], ["id", "gram", "at"])

    return run


def _locate(k: int, reach: int):
    """Occurrences of a shard's phrases in the documents routed to it."""

    def run(docs: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        out: list[tuple] = []
        if len(docs) and len(phrases):
            automaton = ahocorasick.Automaton()
            for gram, phrase in zip(phrases["gram"].tolist(), phrases["phrase"].tolist()):
                automaton.add_word(phrase, gram)
            automaton.make_automaton()
            for who, text in zip(docs["id"].tolist(), docs["content"].tolist()):
                runs: dict[tuple, list] = {}
                for end, gram in automaton.iter(text):
                    at = end - k + 1
                    key = (gram, text[max(0, at - reach) : at], text[end + 1 : end + 1 + reach])
                    spans = runs.setdefault(key, [])
                    if spans and spans[-1][1] == at - 1:
                        spans[-1][1] = at
                    else:
                        spans.append([at, at])
                out += [(who, *key, spans) for key, spans in runs.items()]
        return pd.DataFrame(out, columns=["id", "gram", "before", "after", "spans"])

    return run


@F.pandas_udf(T.StructType().add("before", "integer").add("after", "integer"))
def _extent(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Lengths of the common end of a and b and of the common start of c and d."""
    return pd.DataFrame(
        {
            "before": [len(commonprefix([x[::-1], y[::-1]])) for x, y in zip(a, b)],
            "after": [len(commonprefix([x, y])) for x, y in zip(c, d)],
        }
    )


class SharedSpans:
    """Classes of equal surroundings and the links between them; see ``pairs`` and ``coverage``.

    ``df`` needs a string id and a text column; further columns are ignored, whatever their names.
    Rows with a null id or text, or shorter than ``min_chars``, share nothing. Rows with equal id count
    once. White space and letter case count. An empty table gives empty results.
    """

    def __init__(self, df: DataFrame, *, id_col: str = "id", text_col: str = "content", min_chars: int = 150, pairwise_classes: int = PAIRWISE_CLASSES) -> None:
        self.min_chars, self.k, self.pairwise = min_chars, max(1, min_chars // 3), pairwise_classes
        self.reach = min_chars - self.k
        k, w = self.k, min_chars - self.k + 1
        self.source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
        kept = cut(self.source.mapInArrow(_keep(k, w), "id string, gram long, at int"), "grams")
        who = F.xxhash64("id")
        again = kept.groupBy("gram").agg(F.min(who).alias("home"), F.max(who).alias("hi")).filter("home <> hi").select("gram", "home")
        hits = kept.join(again, "gram").groupBy("id").agg(F.collect_set(F.struct("gram", "at", "home")).alias("hits"))
        long = self.source.filter(F.length("content") >= min_chars)
        self.docs = cut(long.join(hits, "id").dropDuplicates(["id"]), "records")
        self.occurrences = cut(self._occurrences(), "occurrences")
        self._link()

    def _occurrences(self) -> DataFrame:
        k, docs = self.k, self.docs
        grams = docs.select("id", "content", F.explode("hits").alias("hit"))
        phrases = (
            grams.select("id", F.col("hit.gram").alias("gram"), F.col("hit.home").alias("home"), F.substring("content", F.col("hit.at") + 1, F.lit(k)).alias("phrase"))
            .groupBy("gram", "home", "phrase")
            .agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
            .filter("lo <> hi")
        )
        total = docs.agg(F.sum(F.size("hits"))).first()[0] or 0
        shards = max(1, -(-total // PHRASES_PER_SHARD))
        shard = lambda home: F.pmod(home, F.lit(shards)).cast("int")
        to = F.explode(F.array_distinct(F.transform("hits", lambda x: shard(x["home"])))).alias("shard")
        # a row for each shard; joined as any table is, so nothing that grows with the data passes through the driver
        sizes = docs.select(F.length("content").alias("n"), to).groupBy("shard").agg(F.ceil(F.sum("n") / CHARS_PER_TASK).cast("int").alias("many"))
        sent = docs.select("id", "content", to).join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
        words = phrases.select("gram", "phrase", shard(F.col("home")).alias("shard")).join(sizes, "shard")
        words = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        return (
            sent.select("id", "content", "shard", "salt").groupBy("shard", "salt")
            .cogroup(words.select("gram", "phrase", "shard", "salt").groupBy("shard", "salt"))
            .applyInPandas(_locate(k, self.reach), "id string, gram long, before string, after string, spans array<array<int>>")
        )

    def _link(self) -> None:
        """members(class, id, spans), links(a, b, before, after) of classes, windows(win, class, before, after)."""
        need = self.min_chars - self.k
        occ = self.occurrences.withColumn("class", F.xxhash64("gram", "before", "after"))
        self.members = occ.select("class", "id", "spans")
        classes = occ.groupBy("class", "gram").agg(
            F.first("before").alias("before"), F.first("after").alias("after"), F.min("id").alias("lo"), F.max("id").alias("hi")
        )
        counted = classes = cut(self._counted(classes), "classes")
        few = counted.filter(F.col("n") <= self.pairwise)
        a, b = few.alias("a"), few.alias("b")
        pair = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.class") < F.col("b.class")))
        pair = pair.filter((F.col("a.lo") != F.col("b.hi")) | (F.col("a.hi") != F.col("b.lo")))
        pair = pair.select(
            F.col("a.class").alias("a"), F.col("b.class").alias("b"), _extent("a.before", "b.before", "a.after", "b.after").alias("x")
        )
        across = pair.filter(F.col("x.before") + F.col("x.after") >= need).select("a", "b", "x.before", "x.after")
        within = classes.filter((F.length("before") + F.length("after") >= need) & (F.col("lo") != F.col("hi"))).select(
            F.col("class").alias("a"), F.col("class").alias("b"), F.length("before").alias("before"), F.length("after").alias("after")
        )
        self.links = across.unionByName(within)
        whole = F.concat("before", F.substring(F.lit(" " * self.k), 1, self.k), "after")
        starts = F.sequence(F.lit(0), F.length("before") + F.length("after") - need)
        cutting = counted.filter((F.col("n") > self.pairwise) & (F.length("before") + F.length("after") >= need))
        windows = cutting.select("class", "gram", "lo", "hi", "before", whole.alias("whole"), F.explode(starts).alias("from"))
        self.windows = windows.select(
            F.md5(F.concat_ws(":", "gram", F.length("before") - F.col("from"), F.substring("whole", F.col("from") + 1, F.lit(self.min_chars)))).alias("win"),
            "class", "lo", "hi", (F.length("before") - F.col("from")).alias("before"),
        ).withColumn("after", F.lit(need) - F.col("before"))

    @staticmethod
    def _counted(classes: DataFrame) -> DataFrame:
        """With n, the number of classes of the phrase."""
        return classes.join(classes.groupBy("gram").agg(F.count("*").alias("n")), "gram")

    def pairs(self) -> DataFrame:
        """(chunk_a, chunk_b), chunk_a < chunk_b: records that share a run; distinct."""
        # classes with the same members say the same, and most do where whole texts are copies: one stands for all
        m = cut(self.members.select("class", "id").distinct(), "members")
        h = F.xxhash64("id")
        sets = m.groupBy("class").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("t"))
        stands = sets.join(sets.groupBy("n", "s", "t").agg(F.min("class").alias("rep")), ["n", "s", "t"]).select("class", "rep")
        as_ = lambda c, r: stands.select(F.col("class").alias(c), F.col("rep").alias(r))
        linked = self.links.select("a", "b").distinct().join(as_("a", "ra"), "a").join(as_("b", "rb"), "b")
        linked = linked.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        one = linked.join(m.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(
            m.select(F.col("class").alias("b"), F.col("id").alias("y")), "b"
        )
        one = one.filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
        # so it is with windows
        held = self.windows.select("win", "class").join(stands, "class").select("win", F.col("rep").alias("class")).distinct()
        sets = held.groupBy("win").agg(F.count("*").alias("n"), F.sum(F.col("class").cast("decimal(38,0)")).alias("s"), F.bit_xor("class").alias("t"))
        few = sets.groupBy("n", "s", "t").agg(F.min("win").alias("win")).select("win")
        inside = held.join(few, "win", "left_semi").join(m, "class").select("win", "id").distinct()
        two = inside.select("win", F.col("id").alias("x")).join(inside.select("win", F.col("id").alias("y")), "win").filter("x < y")
        both = one.select("x", "y").unionByName(two.select("x", "y")).filter("x <> y")
        return both.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()

    def coverage(self) -> DataFrame:
        """(id, n_chars, shared_chars, shared_share, n_runs) of every record with text; ids once."""
        sides = self.links.select(F.explode(F.array("a", "b")).alias("class"), "before", "after")
        met = self.windows.groupBy("win").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("win")
        sides = sides.unionByName(self.windows.join(met, "win", "left_semi").select("class", "before", "after"))
        reach = sides.groupBy("class").agg(F.max("before").alias("before"), F.max("after").alias("after"))
        runs = self.members.join(reach, "class").select("id", "before", "after", F.explode("spans").alias("s"))
        runs = runs.select("id", (F.col("s")[0] - F.col("before")).alias("lo"), (F.col("s")[1] + self.k + F.col("after")).alias("hi"))
        order = Window.partitionBy("id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.withColumn("past", F.coalesce(F.max("hi").over(order), F.lit(-1)))
        gain = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "past"))
        shared = runs.groupBy("id").agg(F.sum(gain).alias("shared_chars"), F.sum((F.col("lo") > F.col("past")).cast("int")).alias("n_runs"))
        sizes = self.source.filter("id is not null and content is not null").select("id", F.length("content").alias("n_chars")).dropDuplicates(["id"])
        n = F.coalesce(F.col("shared_chars"), F.lit(0))
        return sizes.join(shared, "id", "left").select(
            "id", "n_chars", n.cast("long").alias("shared_chars"),
            F.round(F.coalesce(F.try_divide(n, F.col("n_chars")), F.lit(0.0)), 6).alias("shared_share"),
            F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
        )
