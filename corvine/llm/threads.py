"""Rebuilding conversations from message rows, by scored reply links and link trees.

Turns are ordered by time and direct repetitions are left out. Each turn's candidate parents are the
earlier turns of the other role. A candidate scores by closeness in time, by mentions (identifiers and
paths that both use), by the overlap of their words, and loses for every turn in between. The turn just
before scores more while speakers take turns; where two threads interleave (somebody spoke twice
running) that bonus is gone and the other cues disentangle them. The likeliest candidate above zero
becomes the parent; turns without one are roots, and the links form trees. A conversation is whole if
its turns form one tree that never branches, from a user's root to an assistant's leaf.

The score of a candidate ``d`` > 1 turns back is at most ``1 + MENTION + OVERLAP - STEP * (d - 1)``,
which is not above zero from ``d = 7`` on, so looking at the six turns before is exact, not a cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.common import blank, lay_blocks, plain_role, with_context
from corvine.scratch import cut

#: Weights of a candidate link. Closeness is 1 for no delay and falls with the hours between.
MENTION, OVERLAP, STEP = 0.3, 0.5, 0.35
#: For the turn just before while speakers take turns. It exceeds what mentions and overlap can give an
#: older candidate, so a conversation that alternates throughout is always read as one thread.
TURN = 1.0
_REACH = 6

_WORD = "[\\p{L}\\p{N}]{3,}"
_MARK = "@\\w+|\\w+_\\w+|[a-z]+[A-Z]\\w*|[\\w-]+(?:/[\\w.-]+)+"


def _clean(messages: DataFrame) -> DataFrame:
    rows = messages.select("id", "conversation_id", plain_role(F.col("role")).alias("role"), "content", "created_at")
    return rows.filter("id is not null and conversation_id is not null").dropDuplicates(["id"])


def linked_turns(messages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conversation_id, id, role, content, created_at, block, parent_id, link_score): the turns and their links.

    A row for each message that has a conversation, a time, and something visible to read, without direct
    repetitions (role and content of the row before). ``parent_id`` is null for roots. At equal times
    the user comes first, then the smaller id. Rows with equal id count once. Rows with any other role
    stay in order but are never linked. ``block`` numbers the sorted blocks in which a conversation lies.
    Further columns are ignored. ``rows`` are the messages as ``_clean`` gives them, if they are at hand.
    """
    rows = cut(_clean(messages), "messages") if rows is None else rows
    rows = rows.filter(F.col("created_at").isNotNull() & ~blank(F.col("content")))
    rows = rows.withColumn("side", F.when(F.col("role") == "user", 0).otherwise(1))
    by = ["created_at", "side", "id"]
    order = Window.partitionBy("conversation_id", "_block").orderBy(*by)
    said = with_context(lay_blocks(rows, "conversation_id", by), "conversation_id", by, 1)
    said = said.withColumn("repeated", (F.lag("role").over(order) == F.col("role")) & (F.lag("content").over(order) == F.col("content")))
    turns = cut(said.filter(~F.col("_context") & ~F.coalesce("repeated", F.lit(False))).drop("_context", "repeated"), "said")
    laid = with_context(turns, "conversation_id", by, _REACH)
    laid = laid.withColumns(
        {
            "words": F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(_WORD), F.lit(0))),
            "marks": F.array_distinct(F.regexp_extract_all("content", F.lit(_MARK), F.lit(0))),
            # false where this speaker also spoke just before
            "taken": F.coalesce(F.lag("role").over(order) != F.col("role"), F.lag("id").over(order).isNull()),
        }
    )
    laid = laid.withColumn("past", F.collect_list(F.struct("id", "role", "created_at", "words", "marks", "taken")).over(order.rowsBetween(-_REACH, -1)))

    def score(c, i):
        far = F.size("past") - i
        hours = (F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(c["created_at"].cast("timestamp"))) / 3.6e9
        both = F.size(F.array_intersect(F.col("words"), c["words"]))
        either = F.size("words") + F.size(c["words"]) - both
        value = (
            1 / (1 + hours)
            + F.when(F.arrays_overlap("marks", c["marks"]), MENTION).otherwise(0.0)
            + OVERLAP * F.coalesce(F.try_divide(both, either), F.lit(0.0))
            + F.when((far == 1) & c["taken"], TURN).otherwise(0.0)
            - STEP * (far - 1)
        )
        known = c["role"].isin("user", "assistant") & F.col("role").isin("user", "assistant") & (c["role"] != F.col("role"))
        return F.when(known & (value > 0), F.struct(value.alias("score"), (-far).alias("near"), c["id"].alias("id")))

    best = F.array_max(F.filter(F.transform("past", score), lambda x: x.isNotNull()))
    return laid.withColumn("best", best).filter(~F.col("_context")).select(
        "conversation_id", "id", "role", "content", "created_at", F.col("_block").alias("block"),
        F.col("best.id").alias("parent_id"), F.round("best.score", 9).alias("link_score"),
    )


def verdicts(conversations: DataFrame, messages: DataFrame, turns: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(conversation_id, keep, known, n_turns, n_roots, n_branches, n_unanswered, reason) of every id in either table.

    A conversation is kept if it is in ``conversations``, all its message rows have a time and the role
    user or assistant, and its turns form one link tree without branches from a user's root to an
    assistant's leaf. Links join earlier and later turns of different roles, so such a tree has its
    turns go user, assistant, user, assistant, ... in the order of time; and turns that do so are linked
    in this way. ``n_branches`` counts turns with more than one reply, ``n_unanswered`` user turns
    without one. ``reason`` names the first rule that fails. All null columns, empty tables and
    conversations without messages are defined: such a conversation is dropped as ``empty``.
    """
    rows = cut(_clean(messages), "messages") if rows is None else rows  # each id once, read by all that follows
    turns = cut(linked_turns(messages, rows), "turns") if turns is None else turns
    replies = turns.filter("parent_id is not null").groupBy("conversation_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("n_replies"))
    root, user = F.col("parent_id").isNull(), F.coalesce(F.col("role") == "user", F.lit(False))
    seen = turns.join(replies, ["conversation_id", "id"], "left").groupBy("conversation_id").agg(
        F.count("*").alias("n_turns"),
        F.count_if(root).alias("n_roots"),
        F.count_if(root & ~user).alias("n_odd_roots"),
        F.count_if(F.col("n_replies") > 1).alias("n_branches"),
        F.count_if(user & F.col("n_replies").isNull()).alias("n_unanswered"),
    )
    bad = F.col("created_at").isNull() | ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    rows = rows.groupBy("conversation_id").agg(F.count_if(bad).alias("n_bad"))
    known = conversations.select(F.col("id").alias("conversation_id"), F.lit(True).alias("known")).filter("conversation_id is not null").distinct()
    both = known.join(rows, "conversation_id", "full_outer").join(seen, "conversation_id", "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown")
        .when(F.coalesce("n_bad", F.lit(0)) > 0, "broken")
        .when(F.coalesce("n_turns", F.lit(0)) == 0, "empty")
        .when((F.col("n_roots") > 1) | (F.col("n_odd_roots") > 0) | (F.col("n_branches") > 0), "entangled")
        .when(F.col("n_unanswered") > 0, "no reply")
    )
    return both.select(
        "conversation_id", reason.isNull().alias("keep"), F.coalesce("known", F.lit(False)).alias("known"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_turns", "n_roots", "n_branches", "n_unanswered")],
        reason.alias("reason"),
    )


def link_trees(turns: DataFrame) -> DataFrame:
    """``turns`` with ``root_id`` and ``depth`` (0 for roots) of each turn's link tree.

    Pointer doubling: each round halves the links left to the root, so a tree of depth n takes log2(n)
    joins on the message id, whatever the size of a conversation.
    """
    at = turns.select("id", F.coalesce("parent_id", "id").alias("root_id"), F.col("parent_id").isNotNull().cast("int").alias("depth"))
    at = cut(at, "trees")
    while True:
        up = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"), F.col("depth").alias("more"))
        at = cut(at.join(up, "root_id").select("id", F.col("next").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "trees")
        if at.filter("moved").isEmpty():
            return turns.join(at.drop("moved"), "id")
        at = at.drop("moved")


def rebuilt(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, turn, id, role, content, created_at, parent_id, root_id, depth) of the kept ones.

    ``turn`` counts from 1: a running count inside each block, after the turns of the blocks before.
    """
    rows = cut(_clean(messages), "messages")
    turns = cut(linked_turns(messages, rows), "turns")
    keep = verdicts(conversations, messages, turns, rows).filter("keep").select("conversation_id")
    kept = link_trees(turns).join(keep, "conversation_id", "left_semi")
    sizes = kept.groupBy("conversation_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conversation_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sizes = sizes.select("conversation_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("conversation_id", "block").orderBy("created_at", F.when(F.col("role") == "user", 0).otherwise(1), "id")
    numbers = kept.withColumn("n", F.row_number().over(order)).join(sizes, ["conversation_id", "block"])
    return numbers.select("conversation_id", (F.col("offset") + F.col("n")).alias("turn"), "id", "role", "content", "created_at", "parent_id", "root_id", "depth")
