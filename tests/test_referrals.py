from __future__ import annotations

import datetime as dt

import pytest

from slotwise.operators import referrals
from tests.conftest import rows

NOW = dt.datetime(2001, 7, 15, 12)
USERS = "id LONG, name STRING, referral_code STRING, referred_by_code STRING, is_influencer BOOLEAN, user_role STRING"


def friends(first, code, count):
    return [(first + i, "f", f"X{first + i}", code, False, "user") for i in range(count)]


def test_influencer_needs_fifty_of_both(tables):
    people = [(1, "a", "A", None, False, "user"), (2, "b", "B", None, False, "user"), (3, "c", "C", None, False, "user"),
              (4, "d", "D", None, True, "user")]
    people += friends(1000, "A", 49) + friends(2000, "B", 50) + friends(3000, "C", 50) + friends(4000, "D", 50)
    paid = [(1000 + i, "fully_paid") for i in range(49)] + [(2000 + i, "fully_paid") for i in range(49)]
    paid += [(3000 + i, "fully_paid") for i in range(50)] + [(4000 + i, "fully_paid") for i in range(50)]
    # Repeated and unfinished payments of one friend do not count again.
    paid += [(2000, "fully_paid")] * 5 + [(2049, "deposit_paid")]
    t = tables(users=(people, USERS), payments=(paid, "user_id LONG, payment_status STRING"))
    got = referrals.influencer_status(t, NOW).filter("user_id < 10")
    assert rows(got.select("user_id", "referral_count", "paid_referral_count", "qualifies", "flips", "user_role")) == [
        (1, 49, 49, False, False, "user"), (2, 50, 49, False, False, "user"),
        (3, 50, 50, True, True, "influencer"), (4, 50, 50, True, False, "user"),
    ]


def test_codes_are_unique_even_when_short(spark):
    # 36 codes of one letter, 6 of them taken, 25 users: clashes are certain.
    people = spark.createDataFrame(
        [(i, "ABCDEF"[i] if i < 6 else None) for i in range(31)], "id LONG, referral_code STRING"
    )
    got = referrals.referral_codes(people, length=1)
    codes = [r.code for r in got.collect()]
    assert len(codes) == len(set(codes)) == 25 and not set(codes) & set("ABCDEF")
    assert rows(referrals.referral_codes(people, length=1)) == rows(got)
    with pytest.raises(ValueError, match="codes"):
        referrals.referral_codes(people.unionByName(spark.range(100, 110).selectExpr("id", "CAST(NULL AS STRING) AS referral_code")), length=1)


def test_long_codes_are_all_assigned(spark):
    people = spark.range(5000).selectExpr("id", "CAST(NULL AS STRING) AS referral_code")
    got = referrals.referral_codes(people)
    assert got.select("code").distinct().count() == got.count() == 5000
    assert got.filter("NOT code RLIKE '^[A-Z0-9]{8}$'").isEmpty()


@pytest.mark.parametrize("length", [1, 2, 3])
def test_codes_are_a_permutation_that_can_be_turned_back(spark, length):
    numbers = spark.range(36**length)
    coded = referrals.with_codes(numbers, "id", "code", length)
    assert coded.select("code").distinct().count() == 36**length
    assert referrals.with_numbers(coded, "code", "back", length).filter("back IS DISTINCT FROM id").isEmpty()
    assert coded.filter(f"code RLIKE '^[A-Z0-9]{{{length}}}$'").count() == 36**length


def test_texts_that_are_no_codes_have_no_number(spark):
    texts = ["", "ABC", "ABCDEFGHI", "abcdefgh", "ABCDEFG ", "ABCDEFGH\n", None, "ÄBCDEFGH"]
    found = referrals.with_numbers(spark.createDataFrame([(t,) for t in texts], "code STRING"), "code", "n")
    assert [r.n for r in found.collect()] == [None] * len(texts)


def test_numbers_have_no_gap(spark):
    got = referrals.numbered(spark.range(5000).selectExpr("CAST(id * 7 AS STRING) AS id"), "id", "n")
    assert sorted(r.n for r in got.collect()) == list(range(5000))


def test_codes_given_before_are_passed_over(spark):
    """Three runs one after the other, with holes between held codes, use up all codes of two letters."""
    holders = referrals.with_codes(spark.range(0, 1296, 5), "id", "code", 2).selectExpr("id + 100000 AS id", "code AS referral_code")
    people = holders.unionByName(spark.createDataFrame([(-1, "?"), (-2, "toolong")], "id LONG, referral_code STRING"))
    for first, count in ((0, 400), (1000, 600), (2000, 36)):
        new = spark.range(first, first + count).selectExpr("id", "CAST(NULL AS STRING) AS referral_code")
        given = referrals.referral_codes(people.unionByName(new), length=2).selectExpr("id", "code AS referral_code")
        assert given.count() == count
        people = spark.createDataFrame(people.unionByName(given).collect(), "id LONG, referral_code STRING")
    codes = [r.referral_code for r in people.collect()]
    assert len(codes) == len(set(codes)) == 1296 + 2
    one = people.unionByName(spark.createDataFrame([(9999, None)], "id LONG, referral_code STRING"))
    with pytest.raises(ValueError, match="only 0 codes"):
        referrals.referral_codes(one, length=2)
