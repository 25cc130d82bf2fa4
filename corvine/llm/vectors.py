"""Most similar vectors for every vector, by vantage-point trees in shards.

A routing tree of vantage points, fitted on a bounded sample, cuts the unit sphere into shards. Every
vector is stored in the one shard it falls into and searched for there first; the k-th best found, or
the least similarity asked for, gives its search radius, and it is sent to each further shard that its
ball may reach. Inside a shard a
vantage-point tree is walked by all queries at once. Both levels prune by the triangle inequality: with
``d`` the distance of query and vantage point, ``mu`` the median radius of the node and ``tau`` the
search radius, a side is skipped if it lies further than ``relax * tau`` from the query's shell.
``relax=1`` is exact; smaller factors trade recall for work, because in many dimensions two close
vectors differ far less in their distance to a third than the inequality allows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.scratch import cut

#: Documented bound of the sample on which the routing tree is fitted (every row is indexed).
SAMPLE_ROWS = 65_536
#: Vectors stored in a shard, about; a task holds at most about twice as many of them and of queries.
SHARD_ROWS = 32_768
#: Points in a leaf of a shard's tree.
LEAF_ROWS = 96
#: Neighbours kept beyond k while similarities are in single precision; they are ranked in double.
SPARE = 3
#: Pruning factor: 1 is exact.
RELAX = 0.15
#: Without a least similarity: points in a leaf, and what single precision may take from a distance.
OPEN_LEAF_ROWS, SLACK = 512, 2e-3
#: Steps of the grid on which normed vectors are told apart: copies of different length fall together, and
#: similarities change by less than 1e-10.
GRID = 2.0**20

_OUT = "id string, neighbour_id string, similarity double, rank int"


def _unit_batches(dim: int, keep: int):
    """Arrow batches (id, vector) -> (key, vec, ids): usable vectors only, copies of any length within a batch merged.

    Keys of which one batch holds ``keep`` copies are merged over the whole partition, so a vector that
    fills a third of the table leaves each partition as one row. There are few of them: each takes
    ``keep`` rows of a batch.
    """

    def table(keys, vecs, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(ids, pa.list_(pa.string()))], ["key", "vec", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[bytes, list]] = {}
        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(lists.value_lengths().fill_null(0))
            pick = np.flatnonzero((size == dim) & np.asarray(batch.column(0).is_valid()))
            if not len(pick):
                continue
            taken = lists.take(pa.array(pick))
            flat = np.asarray(taken.flatten().cast(pa.float32()).fill_null(float("nan")), dtype=np.float32)
            x = flat.reshape(len(pick), dim) + np.float32(0.0)  # -0.0 becomes 0.0
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, pick = x[ok], pick[ok]
            if not len(pick):
                continue
            ids = batch.column(0).take(pa.array(pick)).to_pylist()
            wide = x.astype(np.float64)
            wide /= np.abs(wide).max(axis=1, keepdims=True)
            wide /= np.linalg.norm(wide, axis=1, keepdims=True)
            unit = wide.astype(np.float32)
            merged: dict[bytes, list] = {}
            for i, row in enumerate(np.rint(wide * GRID).astype(np.int32)):
                merged.setdefault(hashlib.md5(row.tobytes()).digest(), [i]).append(ids[i])
            keys, vecs, lists_ = [], [], []
            for key, (first, *found) in merged.items():
                found = sorted(set(found))[:keep]
                if key in held or len(found) == keep:
                    vec, old = held.get(key, (unit[first].tobytes(), []))
                    held[key] = (vec, sorted({*old, *found})[:keep])
                else:
                    keys.append(key), vecs.append(unit[first].tobytes()), lists_.append(found)
            yield table(keys, vecs, lists_)
        yield table(list(held), [v for v, _ in held.values()], [i for _, i in held.values()])

    return run


class RoutingTree:
    """Vantage points and median radii of a binary tree; its leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.points: list[np.ndarray] = []
        self.nodes: list[tuple[float, int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaves)
        self.matrix = np.stack(self.points) if self.points else np.zeros((0, sample.shape[1]), np.float32)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        """Index of a node, or minus (shard + 1)."""
        if leaves <= 1 or len(x) < 8:
            return self._leaf()
        point = _spread_point(x)
        d = _distances(x @ point)
        mu = float(np.median(d))
        near = d <= mu
        if near.all():
            return self._leaf()
        at = len(self.nodes)
        self.nodes.append((mu, 0, 0))
        self.points.append(point)
        inner = self._grow(x[near], leaves // 2)
        outer = self._grow(x[~near], leaves - leaves // 2)
        self.nodes[at] = (mu, inner, outer)
        return at

    def route(self, x: np.ndarray, margin: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, owned): the shards each row must search; ``owned`` where it is stored."""
        margin = np.broadcast_to(margin, len(x))
        dots = x @ self.matrix.T if len(self.matrix) else None
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        stack = [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while stack:
            node, rows, owned = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, -node - 1, owned))
                continue
            mu, inner, outer = self.nodes[node]
            off = _distances(dots[rows, node]) - mu
            go = off <= margin[rows]
            stack.append((inner, rows[go], owned[go] & (off[go] <= 0)))
            go = off >= -margin[rows]
            stack.append((outer, rows[go], owned[go] & (off[go] > 0)))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return (
            np.concatenate([r for r, _, _ in out]),
            np.concatenate([np.full(len(r), s) for r, s, _ in out]),
            np.concatenate([o for _, _, o in out]),
        )


def _distances(dots: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors from their dot products."""
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


def _spread_point(x: np.ndarray) -> np.ndarray:
    """Of a few evenly picked candidates, the one whose distances to a few others vary most."""
    tries = x[np.linspace(0, len(x) - 1, min(8, len(x))).astype(int)]
    probe = x[np.linspace(0, len(x) - 1, min(256, len(x))).astype(int)]
    return tries[int(np.argmax(_distances(tries @ probe.T).std(axis=1)))]


class _Best:
    """The k best stored points of each query, kept while the tree is walked."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.sim = np.full((queries, k), -2.0, np.float32)
        self.at = np.full((queries, k), -1, np.int64)

    def offer(self, rows: np.ndarray, points: np.ndarray, sims: np.ndarray) -> None:
        both = np.concatenate([self.sim[rows], sims], axis=1)
        where = np.concatenate([self.at[rows], np.broadcast_to(points, sims.shape)], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, : self.k]
        self.sim[rows] = np.take_along_axis(both, order, axis=1)
        self.at[rows] = np.take_along_axis(where, order, axis=1)


def search_shard(stored: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, relax: float, leaf: int = OPEN_LEAF_ROWS) -> _Best:
    """Walk a vantage-point tree over ``stored`` with all queries; ``own[i]`` is query i's place in stored or -1.

    Each query's radius is that of its k-th best so far, or of its ``floor`` if that is nearer. With a
    floor and ``relax`` below 1 it stays that of the floor: the factor counts on what the directions of a
    whole ball look like, and would lose neighbours of dense places if the ball shrank.
    """
    floor = floor.astype(np.float32)
    shrink = relax >= 1 or bool((floor <= -2.0).any())
    if (floor <= -2.0).any():
        # the leaf a query falls into gives a first radius
        seed = _walk(stored, queries, own, k, floor, 0.0, 0.0, leaf, True)
        floor = np.maximum(floor, seed.sim[:, -1] - np.float32(1e-5))
    return _walk(stored, queries, own, k, floor, relax, SLACK, leaf, shrink)


def _walk(stored, queries, own, k, floor, relax, slack, leaf, shrink) -> _Best:
    best = _Best(len(queries), k)
    column = np.full(len(stored) + 1, -1)  # the last one stands for queries that are not stored
    stack = [(np.arange(len(stored)), np.arange(len(queries)), np.zeros(len(queries)))]
    while stack:
        points, rows, gap = stack.pop()
        radius = _distances(np.maximum(best.sim[rows, -1], floor[rows]) if shrink else floor[rows])
        rows = rows[gap <= relax * radius + slack]
        if not len(points) or not len(rows):
            continue
        near = None
        if len(points) > leaf:
            vantage = _spread_point(stored[points])
            d = _distances(stored[points] @ vantage)
            mu = np.median(d)
            near = d <= mu
        if near is None or near.all():
            for lo in range(0, len(points), 512):
                part = points[lo : lo + 512]
                column[part] = np.arange(len(part))
                for at in range(0, len(rows), 4096):
                    block = rows[at : at + 4096]
                    sims = queries[block] @ stored[part].T
                    self_at = column[own[block]]
                    sims[np.flatnonzero(self_at >= 0), self_at[self_at >= 0]] = -2.0
                    _offer(best, block, part, sims, np.maximum(best.sim[block, -1], floor[block]))
                column[part] = -1
            continue
        off = _distances(queries[rows] @ vantage) - mu
        stack.append((points[near], rows, off))
        stack.append((points[~near], rows, -off))
    return best


def _offer(best: _Best, block: np.ndarray, part: np.ndarray, sims: np.ndarray, least: np.ndarray) -> None:
    """Offer the similarities that reach ``least`` of their row; few do, so they are moved to the left first."""
    q, j = np.nonzero(sims >= least[:, None])
    if not len(q):
        return
    hit, first, count = np.unique(q, return_index=True, return_counts=True)
    if count.max() > 4 * best.k:
        some = sims[hit]
        top = np.argpartition(-some, best.k - 1, axis=1)[:, : best.k]
        found = np.take_along_axis(some, top, axis=1)
        best.offer(block[hit], part[top], np.where(found >= least[hit, None], found, np.float32(-2.0)))
        return
    slot = np.arange(len(q)) - np.repeat(first, count)
    row = np.repeat(np.arange(len(hit)), count)
    found = np.full((len(hit), count.max()), -2.0, np.float32)
    where = np.full(found.shape, -1, np.int64)
    found[row, slot] = sims[q, j]
    where[row, slot] = part[j]
    best.offer(block[hit], where, found)


def _matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float32).reshape(len(vecs), dim)


def nearest_vectors(
    df: DataFrame,
    *,
    id_col: str = "id",
    vector_col: str = "embedding",
    dim: int = 64,
    k: int = 5,
    min_similarity: float | None = 0.9,
    relax: float = RELAX,
    shard_rows: int = SHARD_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id, neighbour_id, similarity, rank): up to ``k`` most similar other rows of every row.

    Cosine similarity of at least ``min_similarity``, or whatever it is if that is None: then every
    usable row gets its ``k`` neighbours (fewer only if there are fewer rows), and the search radius is
    the distance of the k-th best found so far. Ties go to the smaller id. Every usable row is
    indexed and queried. A vector is usable if it has ``dim`` finite numbers that are not all zero;
    rows with a null id, a null, short or unusable vector take no part. A repeated row (same id and
    vector) counts once; different ids with one vector are neighbours of similarity 1. An empty
    table gives an empty result. Other columns are ignored, whatever their names.

    Work: shuffles of the distinct vectors, of their home shards, and of their routed copies; the routing
    tree (at most ``sample_rows`` / 16 vantage points) is the only thing that passes through the driver.
    Shards that hold more than ``shard_rows`` vectors are salted and the queries of a shard are cut into
    blocks, so that no task grows with a crowded region. The copies of a query grow with the number of
    shards its ball reaches; README gives measured figures.
    """
    keep = k + 2
    source = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    spark = df.sparkSession
    unit = source.mapInArrow(_unit_batches(dim, keep), "key binary, vec binary, ids array<string>")
    groups = cut(
        unit.groupBy("key").agg(
            F.first("vec").alias("vec"),
            F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"),
        ),
        "vectors",
    )
    total = groups.count()
    if total == 0:
        return spark.createDataFrame([], _OUT)
    # md5 keys are evenly spread: the smallest ones are a random and repeatable sample
    share = min(1.0, 1.3 * sample_rows / total)
    edge = bytearray(int(share * (2**32 - 1)).to_bytes(4, "big"))
    sample = groups.filter(F.col("key") <= F.lit(edge)).select("vec").limit(sample_rows).toPandas()
    leaves = max(1, min(-(-total // shard_rows), max(1, len(sample) // 16)))
    tree = RoutingTree(_matrix(sample["vec"], dim) if len(sample) else np.zeros((0, dim), np.float32), leaves)
    both = _search(spark, groups, tree, dim, k, min_similarity, relax, shard_rows)
    pairs = both.filter(F.size("ids") < keep).select(F.explode("ids").alias("id"), "near", "sim")
    pairs = pairs.select("id", F.explode("near").alias("neighbour_id"), "sim")
    copies = groups.filter(F.size("ids") > 1).select("ids", "key")
    small = copies.filter(F.size("ids") < keep).select(F.explode("ids").alias("id"), F.col("ids").alias("near"))
    pairs = pairs.unionByName(small.select("id", F.explode("near").alias("neighbour_id"), F.lit(1.0).alias("sim")))
    large = copies.filter(F.size("ids") == keep)
    if not large.isEmpty():
        # more copies than the list holds: each member meets the first ones, by a join on the key
        members = source.mapInArrow(_unit_batches(dim, 2**31), "key binary, vec binary, ids array<string>")
        members = members.select("key", F.explode("ids").alias("id")).distinct()
        met = members.join(large.select("key", F.col("ids").alias("near")), "key")
        pairs = pairs.unionByName(met.select("id", F.explode("near").alias("neighbour_id"), F.lit(1.0).alias("sim")))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour_id")
    best = pairs.filter(F.col("id") != F.col("neighbour_id")).groupBy("id", "neighbour_id").agg(F.max("sim").alias("sim"))
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("id", "neighbour_id", F.col("sim").alias("similarity"), "rank")
    )


def _search(spark, groups, tree, dim, k, least, relax, shard_rows) -> DataFrame:
    """(ids, near, sim): the best links of every group, of a similarity of ``least`` if that is given.

    First every group is searched for in the shard that stores it, which gives it a radius; then it is
    sent to the further shards that its ball reaches. Crowded shards are salted, and the queries of a
    shard are cut into blocks, so no task holds more than about 2 * shard_rows of either.
    """
    start, leaf = (-2.0, OPEN_LEAF_ROWS) if least is None else (least, LEAF_ROWS)
    shrink = least is None or relax >= 1  # see search_shard
    shared = spark.sparkContext.broadcast(tree)  # at most sample_rows / 16 points
    width = k + SPARE

    def homes(batches):
        for batch in batches:
            row, shard, owned = shared.value.route(_matrix(batch.column(1).to_pylist(), dim), 0.0)
            home = np.zeros(batch.num_rows, np.int32)
            home[row[owned]] = shard[owned]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home, pa.int32())], ["key", "vec", "shard"])

    placed = cut(groups.select("key", "vec").mapInArrow(homes, "key binary, vec binary, shard int"), "placed")
    salts = {r["shard"]: -(-r["count"] // (2 * shard_rows)) for r in placed.groupBy("shard").count().collect()}

    def salt_of(key: bytes, shard: int) -> int:
        return int.from_bytes(key[:4], "big") % salts[shard]

    def ranked(x: np.ndarray, stored: np.ndarray, best: _Best, rows: np.ndarray, keys: np.ndarray) -> dict:
        """Neighbours and double-precision similarities of the queries ``rows``, best first."""
        near, sims = [], []
        for q, r in enumerate(rows.tolist()):
            at = stored[best.at[q][best.sim[q] > -2.0]]
            found = x[at].astype(np.float64) @ x[r].astype(np.float64)
            order = np.argsort(-found, kind="stable")
            near.append(keys[at[order]].tolist()), sims.append(found[order].tolist())
        return {"near": pd.Series(near, dtype=object), "sims": pd.Series(sims, dtype=object)}

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
        x = _matrix(pdf["vec"], dim)
        every = np.arange(len(x))
        best = search_shard(x, x, every, width, np.full(len(x), max(-2.0, start - 1e-5)), relax, leaf)
        out = ranked(x, every, best, every, pdf["key"].to_numpy())
        radius = [max(start, s[k - 1]) if shrink and len(s) >= k else start for s in out["sims"]]
        return pd.DataFrame({"key": pdf["key"], "vec": pdf["vec"], "shard": pdf["shard"], "radius": radius, **out})

    many = spark.createDataFrame(list(salts.items()), "shard int, many int")  # a row for each leaf of the tree
    salt = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % F.col("many")
    home = placed.join(F.broadcast(many), "shard").withColumn("salt", salt.cast("int")).drop("many").groupBy("shard", "salt")
    home = cut(home.applyInPandas(at_home, "key binary, vec binary, shard int, radius double, near array<binary>, sims array<double>"), "home")

    def further(batch) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of the shards that the rows' balls reach; their own counts only if it is salted."""
        reach = relax * _distances(batch.column(3).to_numpy()) + SLACK
        row, shard, _ = shared.value.route(_matrix(batch.column(1).to_pylist(), dim), reach)
        own = batch.column(2).to_numpy()[row] == shard
        many = np.isin(shard, [s for s, m in salts.items() if m > 1])
        go = np.isin(shard, list(salts)) & (~own | many)
        return row[go], shard[go]

    def asked(batches):
        for batch in batches:
            shard, count = np.unique(further(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(count, pa.int64())], ["shard", "n"])

    routes = home.select("key", "vec", "shard", "radius")
    counts = routes.mapInArrow(asked, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    blocks = {r["shard"]: -(-r["n"] // (2 * shard_rows)) for r in counts}

    def routed(batches):
        for batch in batches:
            keys, homes_ = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            take, to, salt_, block, stored = [], [], [], [], []
            for r, s in enumerate(homes_):
                for b in range(blocks.get(s, 0)):
                    take.append(r), to.append(s), salt_.append(salt_of(keys[r], s)), block.append(b), stored.append(True)
            for r, s in zip(*(a.tolist() for a in further(batch))):
                b = int.from_bytes(keys[r][4:8], "big") % blocks[s]
                for j in range(salts[s]):
                    if s != homes_[r] or j != salt_of(keys[r], s):
                        take.append(r), to.append(s), salt_.append(j), block.append(b), stored.append(False)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(salt_, pa.int32()), pa.array(block, pa.int32()), pa.array(stored, pa.bool_()), *(batch.column(c).take(at) for c in (0, 1, 3))],
                ["shard", "salt", "block", "stored", "key", "vec", "radius"],
            )

    def away(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
        x = _matrix(pdf["vec"], dim)
        inside = pdf["stored"].to_numpy(bool)
        stored, rows = np.flatnonzero(inside), np.flatnonzero(~inside)
        floor = np.maximum(pdf["radius"].to_numpy()[rows] - 1e-5, -2.0)
        best = search_shard(x[stored], x[rows], np.full(len(rows), -1), width, floor, relax, leaf)
        found = (best.sim > -2.0).any(axis=1)
        best.sim, best.at, rows = best.sim[found], best.at[found], rows[found]
        keys = pdf["key"].to_numpy()
        return pd.DataFrame({"key": keys[rows], **ranked(x, stored, best, rows, keys)})

    sent = routes.mapInArrow(routed, "shard int, salt int, block int, stored boolean, key binary, vec binary, radius double")
    outside = sent.groupBy("shard", "salt", "block").applyInPandas(away, "key binary, near array<binary>, sims array<double>")
    lists = home.select("key", "near", "sims").unionByName(outside)
    lists = lists.select("key", F.zip_with("sims", "near", lambda s, n: F.struct(s.alias("sim"), n.alias("near"))).alias("list"))
    lists = lists.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("list")), asc=False), 1, width).alias("list"))
    links = lists.select("key", F.inline("list"))
    if least is not None:
        links = links.filter(F.col("sim") >= least)
    if relax < 1:
        # a link that was found from one side only holds from both
        links = links.unionByName(links.select(F.col("near").alias("key"), F.col("key").alias("near"), "sim")).distinct()
    ids = groups.select("key", "ids")
    links = links.join(ids.select(F.col("key").alias("near"), F.col("ids").alias("near_ids")), "near").join(ids, "key")
    return links.select("ids", F.col("near_ids").alias("near"), "sim")


def similar_pairs(df: DataFrame, **options) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: pairs in which one row is among the other's most similar."""
    near = nearest_vectors(df, **options)
    return near.select(
        F.least("id", "neighbour_id").alias("chunk_a"), F.greatest("id", "neighbour_id").alias("chunk_b")
    ).distinct()
