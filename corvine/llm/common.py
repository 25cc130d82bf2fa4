"""Pieces shared by the training-data operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.scratch import cut

#: Characters that are drawn as nothing although Unicode counts them as letters or marks.
INVISIBLE = "͏ᅟᅠ឴឵᠎⠀ㅤ︎️ﾠ"

#: Rows of a sorted block, about.
BLOCK_ROWS = 200_000

_VISIBLE = "[^\\s\\p{Z}\\p{C}" + INVISIBLE + "]"


def blank(text: Column) -> Column:
    """True where a text is null or has nothing but white space and invisible characters."""
    return ~F.coalesce(text.rlike(_VISIBLE), F.lit(False))


def is_blank(text: str | None) -> bool:
    """The same for a Python string."""
    return text is None or all(c.isspace() or c in INVISIBLE or unicodedata.category(c)[0] in "ZC" for c in text)


def plain_role(role: Column) -> Column:
    """A role trimmed of all white space and lower-cased."""
    return F.lower(F.regexp_replace(role, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))


def lay_blocks(df: DataFrame, group: str, order: list[str], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` in sorted blocks of about ``block_rows`` rows, numbered by ``_block``, as a written table.

    Blocks come from a range partitioning by (group, order), so one group may fill many of them and no
    task holds a whole group. Their number follows from the number of rows. ``df`` should be cheap to
    read, as it is counted and sampled before it is laid.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-df.count() // block_rows))
    return cut(df.repartitionByRange(parts, F.col(group), *map(F.col, order)).withColumn("_block", F.spark_partition_id()), "blocks")


def with_context(laid: DataFrame, group: str, order: list[str], before: int) -> DataFrame:
    """A table of ``lay_blocks``, or rows of it, for windows that look back at most ``before`` rows.

    Adds ``_context``. A window partitioned by (group, _block) and ordered by ``order`` sees for each row
    that is not ``_context`` the same preceding ``before`` rows as one over the whole group. Only groups
    that straddle a block's edge need context rows; each edge cuts at most one group, which bounds what
    is broadcast by the number of blocks.
    """
    cols = [c for c in laid.columns if c != "_block"]
    wide = laid.groupBy(group).agg(F.min("_block").alias("lo"), F.max("_block").alias("hi")).filter("lo < hi").select(group)
    cut_rows = laid.join(F.broadcast(wide), group, "left_semi")
    late = Window.partitionBy(group, "_block").orderBy(*[F.desc(c) for c in order])
    tails = cut_rows.withColumn("_n", F.row_number().over(late)).filter(F.col("_n") <= before)
    blocks = cut_rows.select(group, "_block").distinct()
    blocks = blocks.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy("_block")))
    # each block of the group holds a row at least, so the last rows lie in the `before` blocks before
    reach = tails.join(blocks, [group, "_block"]).withColumn("_at", F.explode(F.array(*[F.col("_at") + i for i in range(1, before + 1)])))
    reach = reach.drop("_block", "_n").join(blocks, [group, "_at"])
    last = Window.partitionBy(group, "_block").orderBy(*[F.desc(c) for c in order])
    context = reach.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= before)
    own = laid.select(*cols, "_block", F.lit(False).alias("_context"))
    return own.unionByName(context.select(*cols, "_block", F.lit(True).alias("_context")))


def in_blocks(df: DataFrame, group: str, order: list[str], before: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``lay_blocks`` and ``with_context`` in one."""
    return with_context(lay_blocks(df, group, order, block_rows=block_rows), group, order, before)
