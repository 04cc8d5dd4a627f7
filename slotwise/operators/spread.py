"""Aggregates over ordered groups that stay spread out when one group is very large.

A plain ``Window.partitionBy(key)`` puts a whole group in one task. Here all rows are cut into blocks of about
equal size along (key, order): a block holds many small groups or a part of a large one. Blocks are summed first
(the up-sweep), a window over the few blocks of a key carries the sums forward (the down-sweep), and rows are
summed only inside their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import cut_lineage

# Parts that the rows of one key are split into where they meet a row of that key.
SALTS = 16

_BLOCK = "__block"
_CARRY = "__carry"


def in_blocks(df: DataFrame, key: str, moment: str, tiebreak: str, blocks: int | None = None) -> DataFrame:
    """``df`` with ``__block``: numbers of ranges of (``key``, ``moment``, ``tiebreak``) with about equally many rows.

    A moment that many rows share is cut, too, since the tiebreak is part of the range. The ranges come from a sample
    and would differ if they were drawn again, so the rows are written with their numbers and read from there.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(blocks, F.col(key), F.col(moment).asc_nulls_first(), F.col(tiebreak))
    return cut_lineage(ranged.withColumn(_BLOCK, F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    key: str,
    moment: str,
    tiebreak: str,
    totals: dict[str, Column],
    finals: dict[str, str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Add running sums of ``totals`` per ``key`` in the order (``moment``, ``tiebreak``).

    Rows with a NULL ``moment`` come first, and a NULL ``key`` is a group. ``(moment, tiebreak)`` must be unique per
    key. ``finals`` names columns for the last value that a running sum reaches. Writes the rows once, in ``blocks``.
    """
    finals = finals or {}
    # Sums and rows must see the same blocks, whatever is lost or read again in between.
    blocked = in_blocks(df.withColumns(totals), key, moment, tiebreak, blocks)
    per_block = blocked.groupBy(key, _BLOCK).agg(*[F.sum(name).alias(name) for name in totals])
    before = Window.partitionBy(key).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        F.col(key).alias("__key"),
        F.col(_BLOCK).alias("__in"),
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(_CARRY + name) for name in totals],
        *[F.sum(name).over(Window.partitionBy(key)).alias(final) for final, name in finals.items()],
    )
    within = Window.partitionBy(key, _BLOCK).orderBy(
        F.col(moment).asc_nulls_first(), F.col(tiebreak)
    ).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.select(
        *df.columns, _BLOCK, *[F.sum(name).over(within).alias(name) for name in totals]
    )
    joined = summed.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col(_BLOCK) == F.col("__in")))
    return joined.select(
        *df.columns,
        *[(F.col(name) + F.col(_CARRY + name)).cast("long").alias(name) for name in totals],
        *finals,
    )


def first_come(rows: DataFrame, key: str, moment: str, tiebreak: str, room: str) -> DataFrame:
    """(``tiebreak``, wins) of the rows whose key has more rows than ``room``, and any room at all.

    ``room`` is a column with the same number on all rows of a key; ``wins`` tells the first ``room`` rows of a key
    by (``moment``, ``tiebreak``). Keys with room for all their rows, or for none, need no order and are left out.
    """
    asking = rows.filter(F.col(room) > 0).select(key, moment, tiebreak, room)
    short = asking.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(room).alias("__room")).filter("__n > __room")
    contested = asking.join(short.select(key), key)
    turns = running_totals(contested, key, moment, tiebreak, {"__turn": F.lit(1)})
    return turns.select(tiebreak, (F.col("__turn") <= F.col(room)).alias("wins"))


def dense_ranks(counts: DataFrame, group: str, value: str, rank: str) -> DataFrame:
    """Dense rank of ``value`` (largest first) within ``group``.

    Ranks the distinct values only, then hands the ranks back, so the window never holds
    more rows than a group has different values.
    """
    order = Window.partitionBy(group).orderBy(F.desc(value))
    ranks = counts.select(group, value).distinct().withColumn(rank, F.dense_rank().over(order))
    return counts.join(ranks, [group, value])


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``. The limit is applied before the shuffle too."""
    position = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", position).filter(F.col("__n") == 1).drop("__n")


def first_valid(requests: DataFrame, valid: Column, key: str, seq: str) -> DataFrame:
    """Mark requests with ``accepted``: of the valid ones for a key only the earliest is.

    This is what running the requests one by one would give, where the first success changes
    the state that the later ones need. ``seq`` must be unique over all requests.
    """
    marked = requests.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    winners = (
        marked.filter("__valid").groupBy(key).agg(F.min(seq).alias("__won")).select("__won")
    )
    return (
        marked.join(winners, F.col(seq) == F.col("__won"), "left")
        .withColumn("accepted", F.col("__won").isNotNull())
        .drop("__won")
    )


def join_per_key(df: DataFrame, per_key: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Join many rows with the one row of their key, without gathering a large key in one task.

    Rows are salted by ``spread_by`` and the single rows are repeated once per salt. Unlike the
    run-time split of skewed joins this also works where an aggregate follows.
    """
    salted = df.withColumn("__salt", F.pmod(F.hash(spread_by), F.lit(SALTS)))
    repeated = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
