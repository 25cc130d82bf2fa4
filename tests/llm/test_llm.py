"""The training-data operators against brute force, exact round trips and their defined edge cases."""

import datetime as dt
import os
import random
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvine.llm import defects, leakage, packing, provenance, spans, stuffing, threads, vectors
from corvine.llm.common import in_blocks, is_blank

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# Vectors ------------------------------------------------------------------------------------------------


def brute_neighbours(rows, k, least):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    out = set()
    for i, a in enumerate(ids):
        near = sorted((-round(sims[i, j], 12), ids[j]) for j in range(len(ids)) if j != i and sims[i, j] >= least)
        out |= {(a, b) for _, b in near[:k]}
    return out


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(n // 3):
        base[n - 1 - i] = base[i % 40] + rng.normal(size=dim) * 0.25
    return [(f"v{i:05d}", v.astype(np.float32).tolist()) for i, v in enumerate(base)]


@pytest.mark.parametrize("relax, recall", [(1.0, 1.0), (vectors.RELAX, 0.97)])
def test_neighbours_against_brute_force(spark, relax, recall):
    rows = clustered(900, 16)
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    # many small shards, so that routing, salting and the trees inside all take part
    near = vectors.nearest_vectors(df, dim=16, k=3, min_similarity=0.9, relax=relax, shard_rows=40, sample_rows=400)
    got = {(r["id"], r["neighbour_id"]) for r in near.collect()}
    want = brute_neighbours(rows, 3, 0.9)
    assert len(want) > 200
    assert len(got & want) / len(want) >= recall and len(got - want) <= (1 - recall) * len(want) + 1e-9


def test_every_vector_has_neighbours_without_a_least_similarity(spark):
    rows = clustered(900, 16)
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    for shard_rows in (40, 2000):
        near = vectors.nearest_vectors(df, dim=16, k=3, min_similarity=None, relax=1.0, shard_rows=shard_rows, sample_rows=400)
        assert {(r["id"], r["neighbour_id"]) for r in near.collect()} == brute_neighbours(rows, 3, -2.0)
    # one crowded shard, so that salts and blocks of queries take part
    near = vectors.nearest_vectors(df, dim=16, k=3, min_similarity=None, relax=1.0, shard_rows=60, sample_rows=16)
    assert {(r["id"], r["neighbour_id"]) for r in near.collect()} == brute_neighbours(rows, 3, -2.0)


@needs_data
def test_p1_neighbours_lists_five_of_every_usable_chunk(spark):
    from corvine.llm.catalog import p1_neighbours

    rows = {r["id"]: r["embedding"] for r in read(spark, "chunks").select("id", "embedding").filter("id is not null").collect()}
    rows = {i: np.array(v, float) for i, v in rows.items() if v is not None and len(v) == 64 and None not in v}
    rows = [(i, v) for i, v in rows.items() if np.isfinite(v).all() and v.any()]
    got = {(r["id"], r["neighbour_id"]) for r in p1_neighbours(spark, DATA).collect()}
    assert len(got) == 5 * len(rows) and got == brute_neighbours(rows, 5, -2.0)


def test_crowded_region_is_salted(spark):
    rng = np.random.default_rng(3)
    center = rng.normal(size=8)
    rows = [(f"c{i:04d}", (center + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    near = vectors.nearest_vectors(df, dim=8, k=4, relax=1.0, shard_rows=20, sample_rows=320)
    assert {(r["id"], r["neighbour_id"]) for r in near.collect()} == brute_neighbours(rows, 4, 0.9)


def test_copies_of_any_length_are_one_vector(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64).astype(np.float32)
    rows = [(f"h{i:03d}", (base * np.float32(0.1 + 0.01 * i)).tolist()) for i in range(300)] + clustered(200, 64)
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    unit = df.mapInArrow(vectors._unit_batches(64, 7), "key binary, vec binary, ids array<string>")
    assert unit.select("key").distinct().count() < 200 + 10
    got = {}
    for r in vectors.nearest_vectors(df, relax=1.0, shard_rows=30).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"], round(r["similarity"], 6)))
    for i in range(300):
        near = sorted(got[f"h{i:03d}"])
        assert len(near) == 5 and all(n.startswith("h") and s == 1.0 for _, n, s in near)


@pytest.mark.parametrize("leaves", [64, 256])
def test_relaxed_routing_finds_close_pairs_over_many_shards(leaves):
    rng = np.random.default_rng(0)
    norm = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    tree = vectors.RoutingTree(norm(rng.normal(size=(16_384, 64))), leaves)
    q = norm(rng.normal(size=(2000, 64)))
    side = rng.normal(size=q.shape)
    side = norm(side - (side * q).sum(axis=1, keepdims=True) * q)
    p = (0.91 * q + np.sqrt(1 - 0.91**2) * side).astype(np.float32)
    margin = vectors.RELAX * np.sqrt(2 - 2 * 0.91)

    def homes(x):
        row, shard, owned = tree.route(x, 0.0)
        return dict(zip(row[owned].tolist(), shard[owned].tolist()))

    reach = [set(zip(*(a.tolist() for a in tree.route(x, margin)[:2]))) for x in (q, p)]
    hq, hp = homes(q), homes(p)
    found = sum((i, hp[i]) in reach[0] or (i, hq[i]) in reach[1] for i in range(len(q)))
    assert tree.leaves == leaves and found >= 0.97 * len(q) and len(reach[0]) < leaves / 4 * len(q)


def test_copies_and_unusable_vectors(spark):
    nan = float("nan")
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(f"s{i}", same) for i in range(12)] + [("t", [2.0, 4.0, 6.0, 8.0]), ("s0", same), (None, same)]
    rows += [("n1", None), ("n2", []), ("n3", [1.0]), ("n4", [0.0] * 4), ("n5", [nan, 1.0, 1.0, 1.0]), ("n6", [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, embedding array<float>, ids string").withColumnRenamed("ids", "key")
    got = {}
    for r in vectors.nearest_vectors(df, dim=4, k=5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    ids = sorted(f"s{i}" for i in range(12))
    assert set(got) == {*ids, "t"}
    for i in ids:
        assert [b for _, b in sorted(got[i])] == [x for x in ids if x != i][:5]
    assert [b for _, b in sorted(got["t"])] == ids[:5]
    assert vectors.nearest_vectors(df.limit(0), dim=4).count() == 0
    assert vectors.similar_pairs(df.filter("id like 'n%'"), dim=4).count() == 0


# Conversations ------------------------------------------------------------------------------------------

T0 = dt.datetime(2025, 5, 1, 12)
MESSAGE = "id string, conversation_id string, role string, content string, parts string, created_at timestamp"


def talk(cid, *turns, start=0):
    return [(f"{cid}-{i}", cid, role, content, "[]", None if minute is None else T0 + dt.timedelta(minutes=minute)) for i, (role, content, minute) in enumerate(turns, start)]


def verdict_rows(spark):
    rows = talk("ok", ("user", "q", 1), (" Assistant ", "a", 2))
    rows += talk("ties", ("assistant", "a", 1), ("user", "q", 1))
    rows += talk("again", ("user", "q", 1), ("user", "q", 2), ("assistant", "a", 3), ("user", "​ ", 4))
    rows += talk("twice", ("user", "q", 1), ("user", "other", 2), ("assistant", "a", 3))
    rows += talk("tail", ("user", "q", 1), ("assistant", "a", 2), ("user", "more", 3))
    rows += talk("role", ("user", "q", 1), ("tool", "x", 2), ("assistant", "a", 3))
    rows += talk("norole", (None, "q", 1), ("assistant", "a", 2))
    rows += talk("notime", ("user", "q", 1), ("assistant", "a", 2), ("user", "q", None))
    rows += talk("blank", ("user", "  ", 1), ("assistant", None, 2))
    rows += talk("first", ("assistant", "a", 1), ("user", "q", 2), ("assistant", "b", 3))
    rows += talk("lost", ("user", "q", 1), ("assistant", "a", 2))
    rows += [("x", None, "user", "q", "[]", T0), (None, "ok", "user", "q", "[]", T0)]
    rows += talk("ok", ("user", "q", 1))  # the same row again
    known = ["ok", "ties", "again", "twice", "tail", "role", "norole", "notime", "blank", "first", "none", "ok", None]
    conversations = spark.createDataFrame([(k, "t") for k in known], "id string, known string")
    return conversations, spark.createDataFrame(rows, MESSAGE)


def test_verdicts(spark):
    conversations, messages = verdict_rows(spark)
    got = {r["conversation_id"]: r["reason"] for r in threads.verdicts(conversations, messages).collect()}
    assert got == {
        "ok": None, "ties": None, "again": None, "twice": "entangled", "tail": "no reply", "role": "broken", "norole": "broken",
        "notime": "broken", "blank": "empty", "first": "entangled", "none": "empty", "lost": "unknown",
    }
    turns = threads.rebuilt(conversations, messages).orderBy("conversation_id", "turn").collect()
    assert [(r["conversation_id"], r["turn"], r["role"], r["depth"]) for r in turns if r["conversation_id"] == "ok"] == [("ok", 1, "user", 0), ("ok", 2, "assistant", 1)]
    assert threads.verdicts(conversations.limit(0), messages.limit(0)).count() == 0


def test_links_prefer_mentions_and_overlap(spark):
    rows = talk("c", ("user", "why is load_cache_index slow", 0), ("user", "unrelated gardening question", 1), ("assistant", "load_cache_index is slow, the index is why", 2))
    got = {r["id"]: r["parent_id"] for r in threads.linked_turns(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == {"c-0": None, "c-1": None, "c-2": "c-0"}
    plain = talk("d", ("user", "alpha", 0), ("user", "beta", 1), ("assistant", "gamma", 2))
    got = {r["id"]: r["parent_id"] for r in threads.linked_turns(spark.createDataFrame(plain, MESSAGE)).collect()}
    assert got["d-2"] == "d-1"


def test_interleaved_threads_are_linked_apart(spark):
    # speakers take turns until two threads mix; then mentions lead each answer back to its own question
    rows = talk(
        "mix", ("user", "hello there", 0), ("assistant", "good day", 1), ("user", "why does load_cache_index stall", 2), ("user", "where is parse_queue_row defined", 3),
        ("assistant", "load_cache_index waits for the lock", 4), ("assistant", "parse_queue_row is in the reader", 5),
    )
    rows += talk("plain", ("user", "why is load_cache_index slow", 0), ("assistant", "it is large", 1), ("user", "and the other one", 2), ("assistant", "load_cache_index, why slow again", 3))
    messages = spark.createDataFrame(rows, MESSAGE)
    got = {r["id"]: r["parent_id"] for r in threads.linked_turns(messages).collect()}
    assert got["mix-4"] == "mix-2" and got["mix-5"] == "mix-3" and got["mix-2"] == "mix-1"
    assert [got[f"plain-{i}"] for i in range(4)] == [None, "plain-0", "plain-1", "plain-2"]
    known = spark.createDataFrame([("mix",), ("plain",)], "id string")
    seen = {r["conversation_id"]: (r["reason"], r["n_roots"], r["n_branches"], r["n_unanswered"]) for r in threads.verdicts(known, messages).collect()}
    assert seen["plain"] == (None, 1, 0, 0) and seen["mix"][0] == "entangled"


@pytest.mark.parametrize("seed", range(3))
def test_trees_find_alternation_exactly(spark, seed):
    rng = random.Random(seed)
    texts = ["load_cache_index", "what is it", "a b c load_cache_index", "src/app.py", "nothing to see"]
    rows, want = [], set()
    for c in range(120):
        roles = [rng.choice(("user", "assistant")) if rng.random() < 0.15 else ("user", "assistant")[i % 2] for i in range(rng.randint(1, 9))]
        told = [(r, rng.choice(texts), i * rng.choice((1, 1, 400))) for i, r in enumerate(roles)]
        rows += talk(f"c{c}", *told)
        turns = []
        for _, _, r, t in sorted((m, r != "user", r, t) for r, t, m in told):
            if not turns or turns[-1] != (r, t):
                turns.append((r, t))
        if len(turns) > 1 and len(turns) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, (r, _) in enumerate(turns)):
            want.add(f"c{c}")
    known = spark.createDataFrame([(f"c{c}",) for c in range(120)], "id string")
    got = threads.verdicts(known, spark.createDataFrame(rows, MESSAGE)).filter("keep")
    assert 8 < len(want) < 110 and {r["conversation_id"] for r in got.collect()} == want


def test_repetitions_over_many_blocks_count_once(spark):
    rows = talk("hot", ("user", "q", 0), *[("assistant", "same words", i) for i in range(1, 400)], ("user", "next", 401), ("assistant", "done", 402))
    messages = spark.createDataFrame(rows, MESSAGE)
    known = spark.createDataFrame([("hot",)], "id string")
    old = threads.lay_blocks
    threads.lay_blocks = lambda df, group, by: old(df, group, by, block_rows=20)
    try:
        turns = threads.rebuilt(known, messages).orderBy("turn").collect()
    finally:
        threads.lay_blocks = old
    assert [(r["turn"], r["role"], r["depth"]) for r in turns] == [(1, "user", 0), (2, "assistant", 1), (3, "user", 2), (4, "assistant", 3)]


def test_blocks_look_back_over_their_edges(spark):
    from pyspark.sql import Window

    rows = [("hot", i) for i in range(2000)] + [(f"g{i % 50}", i) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, n int")
        laid = in_blocks(df, "g", ["n"], 3)
        seen = laid.withColumn("back", F.lag("n", 3).over(Window.partitionBy("g", "_block").orderBy("n"))).filter(~F.col("_context"))
        assert laid.filter("g = 'hot'").select("_block").distinct().count() > 1
        plain = df.withColumn("back", F.lag("n", 3).over(Window.partitionBy("g").orderBy("n")))
        assert sorted(map(tuple, seen.select("g", "n", F.coalesce("back", F.lit(-1))).collect())) == sorted(map(tuple, plain.select("g", "n", F.coalesce("back", F.lit(-1))).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@needs_data
def test_verdicts_against_brute_force(spark):
    m = pd.read_parquet(f"{DATA}/messages.parquet").drop_duplicates("id")
    known = set(pd.read_parquet(f"{DATA}/conversations.parquet").id)
    keep = set()
    for cid, g in m[m.conversation_id.notna()].groupby("conversation_id"):
        role = g.role.fillna("").str.strip().str.lower()
        if cid not in known or g.created_at.isna().any() or not role.isin(["user", "assistant"]).all():
            continue
        seq = []
        for _, _, _, r, c in sorted(zip(g.created_at, role != "user", g.id, role, g.content)):
            if not is_blank(c) and (not seq or seq[-1] != (r, c)):
                seq.append((r, c))
        if len(seq) >= 2 and len(seq) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, (r, _) in enumerate(seq)):
            keep.add(cid)
    got = threads.verdicts(read(spark, "conversations"), read(spark, "messages"))
    assert {r[0] for r in got.filter("keep").select("conversation_id").collect()} == keep


LATE = "I cannot help with that request."


@pytest.mark.parametrize(
    "answer, refuses",
    [
        ("You ask how the queue is drained by the worker. The worker reads one shard after another. " + LATE, True),
        ("The request is about the keys of the shards " + "and of the tables that belong to them " * 12 + "as far as I see. " + LATE, True),
        ("Der Dienst liest die Tabelle. Danach kommt die nächste. Eine Prüfung gibt es auch. Dabei kann ich leider nicht helfen.", True),
        ("The worker reads a shard. It then writes the row. The bot says \"" + LATE + "\" if it fails.", False),
        ("The worker reads a shard. " * 12 + LATE, False),
        ("The worker reads a shard. Then it runs this. " + LATE + "\n```\nrun()\n```", False),
        ("The worker reads a shard. It then writes the row. Nothing else happens.", False),
    ],
)
def test_refusals_anywhere_in_the_answer(answer, refuses):
    assert (defects.votes("How is the queue drained?", answer, "[]")["refusal"] & 1 > 0) is refuses


# Files --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "path, size, want",
    [
        ("node_modules/x/index.js", 10, "vendored"), (r".\Src\Vendor\lib\a.go", 10, "vendored"), ("web/thing-1.2.3/thing.js", 10, "vendored"), ("public/js/thing-1.2.3.js", 10, "vendored"),
        ("src/third_party@2.0.1/x.js", 10, "vendored"), ("docs/v1.2.3/readme.md", 10, None), ("notes-1.2.3.md", 10, None), ("app/vendors/list.ts", 10, None), ("app/vendor_list.py", 10, None),
        ("web/a.min.js", 10, "minified"), ("web/a-min.css", 10, "minified"), ("static/x.bundle.js", 10, "minified"), ("web/q.b7a5be0baf45.js", 10, "minified"), ("assets/a/index-iJGNiXQQ.js", 10, "minified"),
        ("assets/chunk-7d967aae.js", 10, "minified"), ("src/minify_all.js", 10, None), ("src/bundler/open.ts", 10, None), ("ops/deploy-905de2-x.yaml", 10, None), ("src/index-handler.js", 10, None),
        ("api/x.pb.go", 10, "generated"), ("x_pb2_grpc.py", 10, "generated"), ("a/__generated__/Q.graphql.ts", 10, "generated"), ("A.Designer.cs", 10, "generated"), ("lex.yy.c", 10, "generated"),
        ("p.tab.c", 10, "generated"), ("mock_store.go", 10, "generated"), ("mockingbird_store.go", 10, None), ("src/codegen/emit.rs", 10, None), ("generate_code.py", 10, None), ("src/mocks/a.ts", 10, None),
        ("data/table.c", 300_000, "data"), ("data/table.json", 300_000, None), ("src/long.test.ts", 150_020, None), ("__init__.py", 0, None), (None, 10, None), ("src/a.py", None, None),
    ],
)
def test_token_rules(spark, path, size, want):
    df = spark.createDataFrame([(path, None, size)], "p string, l string, s long")
    assert df.select(provenance.token_rule(F.col("p"), F.col("l"), F.col("s"))).first()[0] == want


def test_copies_and_edited_copies(spark):
    shape = "id string, repo_id string, path string, language string, content_hash string, size_bytes long, note string"
    files = [
        ("v", "r1", "vendor/lib/lib.js", "javascript", "h1", 9000, ""), ("copy", "r2", "src/other.js", None, "h1", 9000, ""), ("tiny", "r2", "src/tiny.js", None, "h5", 10, ""), ("tinier", "r1", "vendor/lib/tiny.js", None, "h5", 10, ""), ("tiniest", "r4", "src/tiny.js", None, "h5", 10, ""),
        ("edit", "r2", "src/edited.js", "javascript", "h2", 900, ""), ("same", "r1", "src/mine.js", "javascript", "h3", 9100, ""), ("own", "r3", "src/own.js", "javascript", "h4", 500, ""),
        ("null", None, None, None, None, None, ""), (None, "r3", "x.js", None, "h9", 1, ""), ("own", "r3", "src/own.js", "javascript", "h4", 500, ""),
    ]
    lines = [f"const vendored_line_number_{i} = compute({i});" for i in range(20)]
    own = [f"let handwritten_statement_{i} = other({i});" for i in range(20)]
    chunks = [("c1", "v", "\n".join(lines)), ("c2", "edit", "\r\n".join(lines[:18] + own[:2])), ("c3", "own", "\n".join(own)), ("c4", "same", "\n".join(lines)), ("c5", "gone", "x"), ("c6", "own", None)]
    got = provenance.classified(spark.createDataFrame(files, shape), spark.createDataFrame(chunks, "id string, file_id string, content string"))
    kinds = {r["file_id"]: (r["kind"], r["by"]) for r in got.collect()}
    # a repository's own lines are no evidence against it, and tiny files say nothing
    assert kinds == {"v": ("vendored", "rule"), "copy": ("vendored", "copy"), "tiny": (None, None), "tinier": ("vendored", "rule"), "tiniest": (None, None), "edit": ("vendored", "lines"), "same": (None, None), "own": (None, None), "null": (None, None)}
    assert provenance.not_hand_written(spark.createDataFrame([], shape), spark.createDataFrame([], "id string, file_id string, content string")).count() == 0


def test_edited_copies_of_popular_libraries(spark):
    shape = "id string, repo_id string, path string, language string, content_hash string, size_bytes long"
    lib = [f"const popular_library_line_{i} = compute({i});" for i in range(18)]
    head = [f"// licence text that is held everywhere, line {i}" for i in range(8)]
    files, chunks = [], []
    for i in range(600):  # edited and vendored by many, and boilerplate in files of many names
        files += [(f"v{i}", f"r{i}", f"vendor/lib/lib-1.{i}.0.js", "javascript", f"h{i}", 9000), (f"o{i}", f"r{i}", f"src/own_{chr(97 + i % 26)}{i}.js", "javascript", f"w{i}", 900)]
        chunks += [(f"v{i}", "\n".join([*head, *lib, f"let vendored_edit_of_number_{i} = 1;"])), (f"o{i}", "\n".join([*head, *(f"let own_line_of_file_{i}_{j} = {j};" for j in range(6))]))]
    files += [("edit", "x", "src/edited.js", "javascript", "e", 1400), ("heads", "x", "src/heads.js", "javascript", "f", 900)]
    chunks += [("edit", "\n".join([*head, *lib, "let something_else_of_mine = 1;"])), ("heads", "\n".join(head))]
    got = provenance.classified(spark.createDataFrame(files, shape), spark.createDataFrame([(f"c{f}", f, t) for f, t in chunks], "id string, file_id string, content string"))
    kinds = {r["file_id"]: (r["kind"], r["by"], r["n_lines"], r["n_held"]) for r in got.collect()}
    assert kinds["edit"] == ("vendored", "lines", 27, 18)
    assert kinds["heads"] == (None, None, 8, 0)
    assert all(kinds[f"o{i}"][0] is None and kinds[f"v{i}"][1] == "rule" for i in range(600))


def test_files_are_judged_by_one_source_and_by_their_tokens(spark):
    shape = "id string, repo_id string, path string, language string, content_hash string, size_bytes long"
    lib = {a: [f"const library_{a}_line_number_{i} = compute({i});" for i in range(12)] for a in "ab"}
    head = "/*\n * Code generated by a tool. DO NOT EDIT.\n */\n"
    texts = {
        "va": ("vendor/a-1.2.0/a.js", "\n".join(lib["a"][:8])), "vb": ("vendor/b/b.js", "\n".join(lib["b"])), "va2": ("vendor/a-1.3.0/a.js", "\n".join(lib["a"][4:])),
        "versions": ("src/x.js", "\n".join(lib["a"])), "mixed": ("src/mixed.js", "\n".join(lib["a"][:6] + lib["b"][:6])),
        "packed": ("src/packed.js", "function(a,b){return a+b};" * 200), "wide": ("src/wide.py", "\n".join(["x = call(first, second)  # one of many lines"] * 90)),
        "made": ("src/made.go", head + "func f() {}\n" * 3), "maker": ("src/maker.go", 'func write() { emit("// Code generated by x. DO NOT EDIT.") }'),
        "table": ("src/table.c", "static int t[] = {" + ", ".join(map(str, range(2000))) + "};"), "long": ("src/long.md", "A sentence of prose that is never wrapped. " * 60),
    }
    files = [(i, f"r-{i}", path, None, f"h-{i}", len(text)) for i, (path, text) in texts.items()] + [("snippet", "r", "src/snippet.js", None, "h", 90_000)]
    texts["snippet"] = texts["versions"]
    # tiny contents: one that stands in vendored places mostly, and a standard file
    files += [(f"t{i}", f"q{i}", "vendor/z/z.js" if i < 3 else "src/own.js", None, "tiny", 90) for i in range(4)] + [(f"e{i}", f"q{i}", "vendor/z/__init__.py" if i < 1 else "src/__init__.py", None, "empty", 0) for i in range(4)]
    chunks = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "file_id string, content string")
    got = {r["file_id"]: (r["kind"], r["by"]) for r in provenance.classified(spark.createDataFrame(files, shape), chunks).collect()}
    want = dict.fromkeys(("va", "vb", "va2", "t0", "t1", "t2", "e0"), ("vendored", "rule")) | {"versions": ("vendored", "lines"), "t3": ("vendored", "copy")}
    want |= {"packed": ("minified", "tokens"), "made": ("generated", "tokens"), "table": ("data", "tokens")} | dict.fromkeys(("snippet", "mixed", "wide", "maker", "long", "e1", "e2", "e3"), (None, None))
    assert got == want


# Shared spans -------------------------------------------------------------------------------------------


def brute_pairs(rows, n):
    seen = {}
    for i, t in rows:
        if i is not None and t is not None:
            for p in range(len(t) - n + 1):
                seen.setdefault(t[p : p + n], set()).add(i)
    return {(a, b) for ids in seen.values() for a in ids for b in ids if a < b}


def brute_coverage(rows, n):
    texts = {i: t for i, t in rows if i is not None and t is not None}
    seen = {}
    for i, t in texts.items():
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p : p + n], set()).add(i)
    out = {}
    for i, t in texts.items():
        hit = set()
        for p in range(len(t) - n + 1):
            if len(seen[t[p : p + n]]) > 1:
                hit |= set(range(p, p + n))
        out[i] = len(hit)
    return out


def span_rows(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase + " é😀\n") for _ in range(n))
    shared = [word(rng.randint(25, 90)) for _ in range(12)]
    rows = []
    for i in range(60):
        text = word(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, 6)
            text += s[cut:] + word(rng.randint(0, 40))
        rows.append((f"r{i:02d}", text))
    rows += [("r00", rows[0][1]), (None, shared[0]), ("nul", None), ("emp", ""), ("rep", "=" * 400), ("rep2", "=" * 130), ("crlf", shared[1].replace("\n", "\r\n"))]
    return rows


@pytest.mark.parametrize("seed, few", [(1, 32), (2, 0), (3, 1)])
def test_shared_spans_against_brute_force(spark, monkeypatch, seed, few):
    monkeypatch.setattr(spans, "CHARS_PER_TASK", 900)
    monkeypatch.setattr(spans, "PHRASES_PER_SHARD", 40)
    rows = span_rows(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, content string, gram int")
    found = spans.SharedSpans(df, min_chars=30, pairwise_classes=few)
    assert {tuple(r) for r in found.pairs().collect()} == brute_pairs(rows, 30)
    got = {r["id"]: r["shared_chars"] for r in found.coverage().collect()}
    assert got == brute_coverage(rows, 30)


def test_shared_spans_of_nothing(spark):
    empty = spans.SharedSpans(spark.createDataFrame([], "id string, content string"))
    assert empty.pairs().count() == 0 and empty.coverage().count() == 0


# Answers ------------------------------------------------------------------------------------------------

OK = "The loader keeps a sorted queue until the parser has finished with it."


@pytest.mark.parametrize(
    "q, a, parts, want",
    [
        ("Why is it slow?", None, None, "empty"), ("Why is it slow?", " ​\n", "[]", "empty"), (None, "﻿", "broken", "empty"),
        ("Why is load_x slow?", "> why is LOAD_X slow?", "[]", "copy"), ("Where does it start?", "You asked: Where does it start?", None, "copy"), ("Where does it start?", f"You asked: Where does it start?\n\n{OK} {OK}", None, None),
        ("How?", "I'm sorry, but I can't help with that request.", "[]", "refusal"), ("¿Cómo?", "Lo siento, no puedo ayudar con esa petición.", "[]", "refusal"), ("Wie?", "Diese Anfrage muss ich ablehnen.", "[]", "refusal"),
        ("How does it work?", "Je préfère ne pas parler de load_x.", "[]", "refusal"), ("How?", f"You are not allowed to pass a null here. {OK}", "[]", None), ("How?", f"I can't find a second loader, but the first one is clear. {OK}", "[]", None),
        ("How?", f"Sorry for the long listing above. {OK}", "[]", None),
        ("How does it work?", "The loader keeps a sorted queue until the par", "[]", "truncated"), ("How does it work?", f"{OK}\n```py\nx = 1", "[]", "truncated"), ("How does it work?", f"{OK} See `load_in", "[]", "truncated"),
        ("How does it work?", OK, '[{"type":"text","text":"x","state":"streaming"}]', "truncated"), ("How does it work?", OK, '[{"type":"data-finish","data":{"reason":"length"}}]', "truncated"),
        ("How does it work?", OK, '[{"type":"data-finish","data":{"reason":"stop"}}]', None), ("How does it work?", f"{OK}\n```py\nx = 1\n```", "[]", None), ("How does it work?", f"{OK}\n\n- `src/a.ts:1-2`\n- `src/b.ts:3`", "[]", None),
        ("How does it work?", f"{OK} (src/a.ts:1-2)", "not json", None), ("How does it work?", "See src/a.ts:14", "[]", None),
        ("How does the loader work?", "Der Lader hält die Liste sortiert, bis der Parser damit fertig ist und nicht mehr wartet.", "[]", "language"),
        ("Wie arbeitet der Lader und warum ist er so langsam?", OK, "[]", "language"), ("How does it work?", f'{OK} "Der Lader ist nicht mehr da und wartet auf die Liste."', "[]", None),
    ],
)
def test_votes(q, a, parts, want):
    # the first function of each sign is the precise one; the others may fire on sound answers too
    got = {defects.TELLS[s] for s, v in defects.votes(q, a, parts).items() if v & 1}
    assert (next(d for d in defects.DEFECTS if d in got) if got else None) == want


def test_label_model_learns_which_functions_are_noisy():
    rng = random.Random(5)
    hit, noise = (0.9, 0.7, 0.6, 0.5, 0.6), (0.0005, 0.01, 0.0005, 0.5, 0.2)
    draw = lambda rates: sum((rng.random() < r) << j for j, r in enumerate(rates))
    counts, truth = {}, {}
    for _ in range(40_000):
        bad = rng.random() < 0.03
        p = draw(hit if bad else noise)
        counts[p] = counts.get(p, 0) + 1
        truth[p] = truth.get(p, 0) + bad
    cases = [{}, {}]
    for i in range(2000):
        p = draw(hit)
        cases[i % 2][p] = cases[i % 2].get(p, 0) + 1
    model = defects.LabelModel(5, counts, cases[0])
    least = model.cutoff(cases[1], counts)
    kept = {p for p in counts if model.posterior(p) >= least}
    right, size = sum(truth[p] for p in kept), sum(counts[p] for p in kept)
    assert right / size > 0.9 and right / sum(truth.values()) > 0.9
    # one that fires on half of all answers, and one that fires on a hundredth of the sound ones, say nothing alone
    assert 0.8 < model.hit[3] / model.noise[3] < 1.25 and model.posterior(8) < 0.01 and model.posterior(2) < least and model.posterior(16) < 0.01
    assert abs(model.noise[1] - 0.01) < 0.003 and abs(model.noise[4] - 0.2) < 0.01


def test_made_cases_hold_their_defect():
    pairs = [("How does the loader work and why is it so slow?", f"{OK} {OK}\n```py\n" + "x = load(1)\ny = 2\n" * 4 + "```", "[]"), ("Wie arbeitet der Lader und warum ist er so langsam?", "Der Lader hält die Liste sortiert, bis der Parser damit fertig ist und nicht mehr wartet.", "[]")] * 8
    seen = {}
    for _, sign, case in defects.made_cases(pairs):
        seen.setdefault(sign, []).append(defects.votes(*case)[sign] & 1)
    assert set(seen) == set(defects.SIGNS) and all(sum(v) >= 0.9 * len(v) for v in seen.values())
    assert list(defects.made_cases([(None, "x", None), ("q", None, None)])) == []


def test_labelled_cases_are_made_of_every_answer(spark, monkeypatch):
    n, models, cutoffs = 3000, [], []

    class Spied(defects.LabelModel):
        def __init__(self, n_functions, counts, cases=None, **more):
            models.append((sum(counts.values()), sum((cases or {}).values())))
            super().__init__(n_functions, counts, cases, **more)

    def spied(posteriors, judged):
        cutoffs.append([(sum(cases.values()), sum(others.values())) for _, cases, others in judged])
        return best(posteriors, judged)

    best = getattr(defects, "best_cutoff", None)
    monkeypatch.setattr(defects, "LabelModel", Spied)
    monkeypatch.setattr(defects, "best_cutoff", spied, raising=False)
    rows = spark.range(2 * n).selectExpr(
        "concat('m', id) as id", "concat('c', id div 2) as conversation_id", "if(id % 2 = 0, 'user', 'assistant') as role",
        f"case when id % 2 = 0 then 'How does the loader work and why is it so slow?' when id >= {2 * n - 10} then '' else '{OK}' end as content",
        "'[]' as parts", "timestamp_seconds(id) as created_at",
    )
    assert {tuple(r) for r in defects.one_label(rows).collect()} == {(f"m{i}", "empty") for i in range(2 * n - 9, 2 * n, 2)}
    # blank answers count, but no case can be made of them; each sign has a model of all cases and one of either half's
    assert {every for every, _ in models} == {n} and models[0] == (n, n - 5)
    assert models[1][1] > 0 and models[2][1] > 0 and models[1][1] + models[2][1] == n - 5
    # every case is held out once
    assert sorted(x for x, _ in cutoffs[0]) == sorted(x for _, x in models[1:3]) and sum(x for _, x in cutoffs[0]) == n


def test_votes_of_cases_are_those_of_their_texts():
    fenced = f"{OK} {OK}\n```py\n" + "x = load(1)\ny = 2\n" * 4 + "```"
    pairs = [("How does the loader work and why is it so slow?", fenced, "[]"), ("How does it run?", " \u200b".join("word" * 9), None), ("Why \u0130s it slow?", "I'M \u017forry, but I CAN'T help w\u0131th that. " * 2, "broken"), (None, OK, "[]"), ("How is it?", None, '[{"text": ""}]')]
    pairs = pairs * 4 + [("Wie arbeitet der Lader und warum ist er so langsam?", "Der Lader hält die Liste sortiert, bis der Parser damit fertig ist und nicht mehr wartet. " * 9, '[{"state": "done"}]')]
    texts = lambda x: x if x is None else "".join(x)
    made = list(defects.made_cases(pairs))
    for _, sign, (q, a, parts) in made:
        assert defects.vote(sign, q, a, parts) == defects.votes(texts(q), texts(a), defects.json.dumps(parts))[sign]
    # the only other language is lent at any distance
    assert {i for i, sign, _ in made if sign == "language"} >= {0, 5, 10, 15, 20}
    assert defects._lenders(["en", None, "en", "de", "fr", "en"]) == [3, None, 3, 4, 5, 3] and defects._lenders(["en", None, "en"]) == [None] * 3


@needs_data
def test_votes_are_more_than_labels(spark):
    messages = read(spark, "messages")
    pairs = defects.answer_pairs(messages).collect()
    voted = {(r["message_id"], defects.TELLS[s]) for r in pairs for s, v in defects.votes(r["question"], r["answer"], r["parts"]).items() if v}
    sure = {(r["message_id"], defects.TELLS[s]) for r in pairs for s, v in defects.votes(r["question"], r["answer"], r["parts"]).items() if v & 1}
    got = {(r["message_id"], r["defect"]) for r in defects.labels(messages).collect()}
    assert got < voted and len(got) < len(voted) / 3 and len(got & sure) >= 0.95 * max(len(got), len(sure))


def test_answer_pairs_and_labels(spark):
    rows = talk("a", ("user", "Why is it so slow and what does it do?", 1), ("assistant", None, 2), ("assistant", "second.", 3))
    rows += talk("b", ("assistant", OK, 1), ("user", "How does it work?", 1))  # equal times: the user first
    rows += talk("c", ("user", "x", 1), ("tool", "y", 2), ("assistant", OK, 3)) + talk("d", ("user", "x", None), ("assistant", OK, 1))
    rows += [("z", None, "assistant", "", "[]", T0)] + rows[:1]
    df = spark.createDataFrame(rows, MESSAGE)
    assert {r["message_id"] for r in defects.answer_pairs(df).collect()} == {"a-1", "b-0"}
    assert [tuple(r) for r in defects.one_label(df).collect()] == [("a-1", "empty")]
    assert defects.labels(df.limit(0)).count() == 0 and defects.one_label(df.limit(0)).count() == 0


# Packing ------------------------------------------------------------------------------------------------


def test_sum_of_squares():
    rng = random.Random(2)
    sizes = [rng.randint(1, 60) for _ in range(3000)] + [0, 100]
    where = packing.sum_of_squares(sizes, 100)
    load = {}
    for s, c in zip(sizes, where):
        load[c] = load.get(c, 0) + s
    assert max(load.values()) <= 100 and sum(sizes) / (100 * len(load)) > 0.97
    assert packing.sum_of_squares([0, 0, 5, 0], 10) == [0, 0, 0, 0] and packing.sum_of_squares([], 10) == []


def naive_sum_of_squares(sizes, capacity):
    """The rule as stated: try every open gap and a new container, take the least sum of squares."""
    bins, out = [], []
    for s in sizes:
        best = None
        for g in sorted({capacity - b for b in bins if capacity - b >= s and b < capacity} | {capacity}):
            trial = sorted(bins)
            if g == capacity:
                trial = trial + [s]
            else:
                trial.remove(capacity - g)
                trial.append(capacity - g + s)
            count = {}
            for b in trial:
                if b < capacity:
                    count[capacity - b] = count.get(capacity - b, 0) + 1
            cost = sum(v * v for v in count.values())
            if best is None or cost < best[0]:
                best = (cost, trial)
        bins = best[1]
        out.append(sorted(b for b in bins))
    return out[-1] if out else []


def test_sum_of_squares_is_the_stated_rule():
    rng = random.Random(9)
    for _ in range(5):
        sizes = [rng.randint(1, 12) for _ in range(60)]
        load = {}
        for s, c in zip(sizes, packing.sum_of_squares(sizes, 12)):
            load[c] = load.get(c, 0) + s
        assert sorted(load.values()) == naive_sum_of_squares(sizes, 12)


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no tokenizer")
def test_packing_is_whole(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "naïve", "日本"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, "word " * 700), (1001, ""), (1002, None), (None, "x"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = packing.packed(df, capacity=64, shard_items=40).toPandas()
    encode = packing._encoding(packing.VOCABULARY).encode_ordinary
    load = got.groupby("container").n_tokens.sum()
    assert load.max() <= 64 and load.sum() / (64 * len(load)) > 0.9
    texts = {i: t for i, t in rows if i is not None and t is not None}
    assert set(got.doc_id) == set(texts) and not got.duplicated(["doc_id", "piece"]).any()
    for doc, g in got.sort_values("piece").groupby("doc_id"):
        n = len(encode(texts[doc]))
        assert g.n_tokens.sum() == n and g.first_token.tolist() == [0, *g.n_tokens.cumsum().tolist()[:-1]]
        assert len(g) == max(1, -(-n // 64))  # split only where a container is too small, and then no finer
    assert packing.packed(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no tokenizer")
def test_loose_containers_are_packed_again_in_bounded_groups(spark):
    # every text leaves a gap that no other fills, so all containers stay loose
    df = spark.createDataFrame([(i, "word " * (36 + i % 9)) for i in range(600)], "doc_id long, text string")
    got = packing.packed(df, capacity=64, shard_items=50).toPandas()
    again = got[got.container.str.startswith("again-")]
    groups = again.groupby(again.container.str.split("-").str[1]).size()
    assert len(again) == 600 and len(groups) >= 12 and groups.max() < 150
    row = packing.fill(df, capacity=64, shard_items=50).collect()[0]
    assert (row["containers"], row["texts"], row["tokens"]) == (600, 600, int(got.n_tokens.sum())) and row["fullest"] <= 64
    assert tuple(packing.fill(df.limit(0)).collect()[0]) == (0, 0, 0, 0, 0)


# Leaks --------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, n):
    out = set()
    grams = {}
    for item, q, a in items:
        for t in (q, a):
            w = leakage.words_of(t)
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    for doc, t in docs:
        w = leakage.words_of(t)
        for i in range(len(w) - n + 1):
            out |= {(doc, x) for x in grams.get(tuple(w[i : i + n]), ())}
    return out


@pytest.mark.parametrize("per_shard", [10**6, 60])
def test_leaks_against_brute_force(spark, per_shard):
    rng = random.Random(8)
    pool = "alpha beta gamma delta epsilon zeta Éta 42 7".split()
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.randint(0, 30)), say(rng.randint(5, 30)) if i % 5 else None) for i in range(12)]
    docs = [(i, say(rng.randint(0, 200))) for i in range(40)]
    for i in range(40, 80):
        q = rng.choice(items)[1].split()
        cut = rng.randint(0, 3)
        docs.append((i, f"{say(5)} {' - '.join(q[cut:]).upper()}, {say(9)}"))
    docs += [(90, None), (91, ""), (None, items[3][1]), (92, items[4][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, words int")
    e = spark.createDataFrame([(*r, "test") for r in items], "item_id long, question string, answer string, split string")
    got = leakage.leaks(d, e, min_words=6, words_per_shard=per_shard)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found == brute_leaks([x for x in docs if x[0] is not None], items, 6) and len(found) > 20
    assert all(r["n_words"] >= 6 for r in got.collect())
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


@needs_data
def test_leaks_of_the_tables(spark):
    d, e = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/eval_items.parquet")
    want = brute_leaks(list(zip(d.doc_id, d.text)), list(zip(e.item_id, e.question, e.answer)), 12)
    got = leakage.leaks(read(spark, "documents"), read(spark, "eval_items"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


# Stuffed pages ------------------------------------------------------------------------------------------

PROSE = "The parser keeps a sorted queue until the loader has finished with it, and nobody calls it directly because of that."


@pytest.mark.parametrize(
    "text, stuffed",
    [
        ("#CheapHosting #CodeSearch #CheapHosting #Deal #CodeSearch #CheapHosting", True), ("code search, cheap hosting, code search, deal, cheap hosting, code search, deal, code search", True),
        ("cheap hosting 2024 | deal online | cheap hosting pro | deal 2025 | cheap hosting | deal pro | cheap hosting online", True), ("\n".join(f"* [deal {i}](http://a.example/{i})" for i in range(20)), True),
        ('<a href="http://a.example/x">cheap hosting</a> <a href="https://b.example/">deal</a> ' * 6, True), ("\n".join(f"SKU-1{i}; tag: deal; tag: hosting; cheap hosting" for i in range(9)), True),
        ("deal cheap hosting deal deal! Cheap hosting cheap hosting - Deal cheap hosting. Deal deal cheap hosting deal.", True), ("\n".join(f"https://a.example/p{i}" for i in range(9)), True),
        (PROSE * 3, False), ("\n".join(f"* [Link {i}](http://a.example/{i}) {PROSE}" for i in range(8)), False), (f"{PROSE}\nTags: deal, cheap hosting, code search, deal, deal", False),
        ("```\n" + "call(x); call(y); call(x);\n" * 20 + "```\n" + PROSE, False), ("\n".join(f"2025-01-0{i} 12:0{i}:11 ERROR worker worker queue queue stopped stopped {i}" for i in range(9)), False), ("", False), ("   ", False), ("one two", False),
    ],
)
def test_page_shares(text, stuffed):
    assert (stuffing.page_features(text)[0][0] > 0.5) is stuffed


LINK_TEXTS = ["Home", "About us", "Contact", "Pricing plans", "Free download", "Partner sites", "Best hosting", "Cheap domains", "Latest offers", "Site map", "Login page", "Top reviews"]
ACROSS_LINES = [
    "\n".join(["cheap hosting fast server discount domains deal"] * 100),
    "\n".join(["cheap hosting", "fast server", "cheap hosting", "discount"] * 20),
    "\n".join(["hosting"] * 40),
    "\n".join(LINK_TEXTS),
]


@pytest.mark.parametrize("text", ACROSS_LINES)
def test_stuffing_across_lines(text):
    assert stuffing.page_features(text)[0][0] > 0.5


def test_wrapped_pages_and_short_lists():
    spam = "cheap hosting discount server deal " * 30
    words = spam.split()
    for width in (1, 3, 5, 7, 150):
        assert stuffing.page_features("\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width)))[0][0] > 0.5
    # code, sentences and a few items are no stuffing
    for page in ("\n".join(["x = f(1);", "return x;"] * 20), "\n".join(["It works now.", "Nothing else changed."] * 20), "Setup\nUsage\nLicense", "\n".join(["12 40 7"] * 30)):
        assert stuffing.page_features(page)[0][0] == 0


def test_stuffed_pages_across_lines(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["#Deal", "#CheapHosting", "#CodeSearch"]) for _ in range(60)) if i % 4 == 0 else PROSE * rng.randint(2, 5), f"r{i % 3}") for i in range(400)]
    rows += [(1000 + i, t, "r1") for i, t in enumerate(ACROSS_LINES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo_id string")
    assert {r[0] for r in stuffing.stuffed_pages(df).collect()} == {i for i in range(0, 400, 4)} | {1000 + i for i in range(len(ACROSS_LINES))}


def test_trees_and_hosts_decide(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    code = "\n".join(f"x{i} = load({i}); store(x{i});" for i in range(30))
    odd = lambda: " ".join(rng.choice(words) for _ in range(60))  # noqa: E731  neither a sentence nor a known kind of stuffing
    spam = lambda: " ".join(rng.choice(["#Deal", "#CheapHosting", "#CodeSearch"]) for _ in range(60))
    rows = [(i, spam() if i % 4 == 0 else code if i % 4 == 1 else PROSE * rng.randint(2, 5), "mixed") for i in range(400)]
    rows += [(1000 + i, spam(), "farm") for i in range(200)] + [(2000, odd(), "farm"), (2001, PROSE * 3, "farm")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo_id string")
    got = {r["doc_id"]: r for r in stuffing.scored(df).collect()}
    assert all(got[i]["score"] < 0.5 for i in range(400) if i % 4) and all(got[i]["score"] > 0.5 for i in range(0, 400, 4))
    assert got[2001]["smoothed"] < 0.5 and got[2000]["smoothed"] > got[2000]["score"]
    found = {r[0] for r in stuffing.stuffed_pages(df).collect()}
    assert found == {i for i, r in got.items() if r["smoothed"] >= stuffing.DECIDED}


def test_stuffed_pages(spark):
    rng = random.Random(6)
    spam = lambda: " ".join(rng.choice(["#Deal", "#CheapHosting", "#CodeSearch"]) for _ in range(60))
    rows = [(i, spam() if i % 4 == 0 else PROSE * rng.randint(2, 5), f"r{i % 3}" if i % 5 else None) for i in range(400)]
    rows += [(900, None, "r1"), (901, "", "r1"), (None, spam(), "r1"), (902, PROSE * 2000, "r2")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, repo_id string, score double")
    assert {r[0] for r in stuffing.stuffed_pages(df).collect()} == {i for i in range(0, 400, 4)}
    # without labels of both kinds the share itself decides
    assert {r[0] for r in stuffing.stuffed_pages(df.filter("doc_id in (0, 4, 901)")).collect()} == {0, 4}
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


# SQL ----------------------------------------------------------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", ["p2_found", "p6_texts", "p7_found"])
def test_sql(spark, name):
    import duckdb

    from corvine.llm import catalog

    con = duckdb.connect()
    for t in ("conversations", "messages", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    key = sorted(want.columns)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))


