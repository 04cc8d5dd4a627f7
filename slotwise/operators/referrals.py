"""Referral programme: counters, influencer status, earnings and codes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import at, in_days
from ..functions.masking import mask_id
from .durable import cut_lineage
from .spread import running_totals

# Referrals and paying referrals an influencer needs, alphabet of codes.
INFLUENCER_REFERRALS = 50
CODE_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CODE_LENGTH = 8
# Steps of the network that mixes numbers into codes.
FEISTEL_STEPS = 6


def referral_counters(tables) -> DataFrame:
    """Per user: people referred, and those of them with a finished payment.

    Counting happens by code before the join, so a code used by very many people is combined
    on the map side and joins as one row.
    """
    people = tables["users"]
    payers = (
        tables["payments"].filter(F.col("payment_status") == "fully_paid")
        .select(F.col("user_id").alias("id")).distinct()
        .withColumn("paid", F.lit(1))
    )
    by_code = (
        people.filter(F.col("referred_by_code").isNotNull())
        .select("id", "referred_by_code")
        .join(payers, "id", "left")
        .groupBy(F.col("referred_by_code").alias("referral_code"))
        .agg(
            F.count(F.lit(1)).alias("total_referrals"),
            F.count("paid").alias("successful_referrals"),
        )
    )
    return (
        people.select(F.col("id").alias("user_id"), "name", "referral_code", "is_influencer", "user_role")
        .join(by_code, "referral_code", "left")
        .na.fill(0, ["total_referrals", "successful_referrals"])
    )


def influencer_status(tables, as_of: dt.datetime, needed: int = INFLUENCER_REFERRALS) -> DataFrame:
    """Who qualifies, and whose flag, role and date change by that."""
    qualifies = (F.col("total_referrals") >= needed) & (F.col("successful_referrals") >= needed)
    flips = qualifies & ~F.col("is_influencer")
    return referral_counters(tables).select(
        "user_id",
        F.col("total_referrals").alias("referral_count"),
        F.col("successful_referrals").alias("paid_referral_count"),
        qualifies.alias("qualifies"),
        flips.alias("flips"),
        F.when(flips, "influencer").otherwise(F.col("user_role")).alias("user_role"),
        F.when(flips, at(as_of)).alias("influencer_qualified_at"),
    )


def referral_leaderboard(tables, needed: int = INFLUENCER_REFERRALS) -> DataFrame:
    """Users who referred anyone, most referrals first, with progress towards influencer."""
    progress = F.least(F.col("total_referrals"), F.col("successful_referrals"), F.lit(needed))
    return (
        referral_counters(tables).filter(F.col("total_referrals") > 0)
        .select(
            "user_id", "name", "total_referrals", "successful_referrals", "is_influencer",
            F.floor(progress * 100 / needed).cast("long").alias("progress_percent"),
        )
        .orderBy(F.desc("total_referrals"), F.desc("successful_referrals"), "user_id")
    )


def _rewards(tables, first: dt.date, last: dt.date, zone: str | None) -> DataFrame:
    return tables["point_transactions"].filter(
        F.col("transaction_type").isin("earned_referral", "influencer_bonus")
        & in_days(F.col("created_at"), first, last, zone)
    )


def _friend(tables) -> DataFrame:
    return tables["users"].select(
        F.col("id").alias("friend_id"), mask_id(F.substring_index("email", "@", 1)).alias("friend")
    )


def referral_earnings(tables, first: dt.date, last: dt.date, zone: str | None = None) -> DataFrame:
    """Points per referrer and friend in a period, and per referrer in all (``is_total``)."""
    pairs = (
        _rewards(tables, first, last, zone)
        .groupBy(F.col("user_id").alias("referrer_id"), F.col("related_user_id").alias("friend_id"))
        .agg(F.sum("amount").alias("points"), F.count(F.lit(1)).alias("rewards"))
        .join(_friend(tables), "friend_id", "left")
    )
    grouped = pairs.groupingSets(
        [["referrer_id", "friend_id", "friend"], ["referrer_id"]], "referrer_id", "friend_id", "friend"
    )
    return grouped.agg(
        F.sum("points").alias("points"),
        F.sum("rewards").alias("rewards"),
        F.count(F.lit(1)).alias("friends"),
        (F.grouping("friend_id") == 1).alias("is_total"),
    )


def referral_earning_rows(tables, first: dt.date, last: dt.date, zone: str | None = None) -> DataFrame:
    """The single rewards behind ``referral_earnings``: day, friend, points."""
    return (
        _rewards(tables, first, last, zone)
        .select(
            F.col("user_id").alias("referrer_id"), F.col("related_user_id").alias("friend_id"),
            F.date_format("created_at", "yy/MM/dd").alias("day"), "amount",
        )
        .join(_friend(tables), "friend_id", "left")
    )


def _halves(length: int) -> tuple[int, int]:
    """How many values the upper and the lower half of a code's number have."""
    size = len(CODE_ALPHABET)
    return size ** (length // 2), size ** (length - length // 2)


def _mixed(number: Column, length: int, back: bool = False) -> Column:
    """One Feistel network over the halves of ``number``, or the way back through it.

    In turn each half is moved on by a digest of the other one, which the way back knows, too, so different numbers
    stay different. The halves are whole characters, so every result is a number of a code. The steps are a fold:
    written out, each would hold the one before it twice.
    """
    upper, lower = _halves(length)
    low = F.pmod(number, F.lit(lower))

    def digest(step: Column, by: Column) -> Column:
        value = F.conv(F.substring(F.md5(F.concat_ws(":", step.cast("string"), by.cast("string"))), 1, 8), 16, 10).cast("long")
        return -value if back else value

    def move(halves: Column, step: Column) -> Column:
        return F.when(
            step % 2 == 0,
            F.struct(F.pmod(halves["u"] + digest(step, halves["l"]), F.lit(upper)).alias("u"), halves["l"].alias("l")),
        ).otherwise(F.struct(halves["u"].alias("u"), F.pmod(halves["l"] + digest(step, halves["u"]), F.lit(lower)).alias("l")))

    steps = F.array(*[F.lit(i) for i in sorted(range(FEISTEL_STEPS), reverse=back)])
    first = F.struct(((number - low) / lower).cast("long").alias("u"), low.cast("long").alias("l"))
    return F.aggregate(steps, first, move, lambda halves: halves["u"] * lower + halves["l"])


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out a single time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def with_codes(df: DataFrame, number: str, code: str, length: int = CODE_LENGTH) -> DataFrame:
    """``df`` with the code of a number below 36 ** ``length``; different numbers have different codes."""
    size = len(CODE_ALPHABET)
    powers = F.array(*[F.lit(size**i) for i in range(length)])
    letter = lambda whole, p: F.substring(F.lit(CODE_ALPHABET), (F.floor(whole / p) % size + 1).cast("int"), F.lit(1))
    spelled = _once(_mixed(F.col(number).cast("long"), length), lambda w: F.array_join(F.transform(powers, lambda p: letter(w, p)), ""))
    return df.withColumn(code, spelled)


def with_numbers(df: DataFrame, code: str, number: str, length: int = CODE_LENGTH) -> DataFrame:
    """``df`` with the number that :func:`with_codes` gives ``code``, NULL for a text that is no such code."""
    size = len(CODE_ALPHABET)
    digit = lambda i: (F.instr(F.lit(CODE_ALPHABET), F.substring(F.col(code), i + 1, 1)) - 1).cast("long") * size**i
    whole = sum((digit(i) for i in range(length)), F.lit(0).cast("long"))
    is_code = F.col(code).rlike(f"^[{CODE_ALPHABET}]{{{length}}}\\z")
    return df.withColumn(number, F.when(is_code, _once(whole, lambda w: _mixed(w, length, back=True))))


def numbered(df: DataFrame, by: str, number: str) -> DataFrame:
    """``df`` with numbers from 0 without a gap, by the unique column ``by``, without sorting all rows.

    Rows are dealt into 4096 parts by a digest and numbered inside; the parts' counts say where each one starts.
    """
    dealt = df.withColumn("__part", F.substring(F.md5(F.col(by).cast("string")), 1, 3))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return dealt.withColumn("__inside", inside).join(starts, "__part").withColumn(
        number, F.col("__start") + F.col("__inside") - 1
    ).drop("__part", "__inside", "__start")


def referral_codes(users: DataFrame, length: int = CODE_LENGTH) -> DataFrame:
    """Give every user without a code one that nobody has: (id, code).

    Codes are those of a permutation of all numbers: users are numbered, and different numbers have different codes. Only codes
    that are held already could clash. They are turned back into numbers, which are passed over in the numbering: of
    the numbers that nobody holds, the r-th user gets the r-th. The same users get the same codes in every run.
    Where more users ask than codes are left, it fails.
    """
    # Codes may be costly to come by, and all of this is read several times. No filter goes below a written table.
    own = cut_lineage(users.select("id", F.col("referral_code").alias("code")))
    codes = own.filter(F.col("code").isNotNull()).select("code").distinct()
    held = cut_lineage(with_numbers(codes, "code", "held", length).filter(F.col("held").isNotNull()).select("held"))
    asking = own.filter(F.col("code").isNull()).select("id")
    n_held, n_asking = held.count(), asking.count()
    left = len(CODE_ALPHABET) ** length - n_held
    if n_asking > left:
        raise ValueError(f"only {left} codes of {length} characters are left")
    # With so many numbers there is one for everybody; held ones beyond do not matter.
    near = held.filter(F.col("held") < n_held + n_asking).withColumn("all", F.lit(0))
    # A held number that has j held ones below it is passed over by every user from number (held - j) on.
    passed = running_totals(near, "all", "held", "held", {"upto": F.lit(1)}).select(
        F.lit(None).cast(asking.schema["id"].dataType).alias("id"), (F.col("held") - F.col("upto") + 1).alias("at"), F.lit(1).alias("skip"), "held"
    )
    users_at = numbered(asking, "id", "at").select("id", "at", F.lit(0).alias("skip"), F.lit(None).cast("long").alias("held"))
    line = passed.unionByName(users_at).select(
        F.lit(0).alias("all"), "id", "at", (F.col("at") * 2 + 1 - F.col("skip")).alias("place"), "skip", F.coalesce("held", "at").alias("tie")
    )
    placed = running_totals(line, "all", "place", "tie", {"over": F.col("skip")}).filter("skip = 0")
    return with_codes(placed.select("id", (F.col("at") + F.col("over")).alias("number")), "number", "code", length).select("id", "code")
