from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from slotwise.llm import quality_rules as Q
from tests.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_signals(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def test_signals_against_brute_force(documents):
    r = random.Random(3)
    texts = [
        None, "", " \n\t", "a b c d", "a b c d e", "a a a a a a", "a b c d e a b c d e", "x\n x\nx\n\n \nx", "\x0b#\x0c*\r$%&|<>",
        "é😀 \xa0 ü v", "one two three four five six\none two three four five six\n", "ab c d e f a bc d e f",
        " ".join(["w"] * 30_000), "v" * 100_000, " ".join(str(i) for i in range(30_000)),
    ]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(100)]
    texts += ["\n".join(r.choice(("p q", "r", "", " ")) for _ in range(r.randint(0, 9))) for _ in range(50)]
    got = Q.signals(documents(*texts, (7, texts[7]), clash=True)).drop("lang_key", "source_key")
    want = [(i, *brute_signals(t)) for i, t in enumerate(texts)] + [(7, *brute_signals(texts[7]))]
    assert rows(got) == sorted(want, key=lambda x: [str(v) for v in x])


def test_buckets_are_narrow_ordered_and_hold_their_middle(spark):
    values = [*range(3000), *(3**k for k in range(8, 39)), 2**62, 2**63 - 1]
    frame = spark.createDataFrame([(v,) for v in values], "v long").select("v", Q.bucket_of(F.col("v")).alias("b"))
    found = sorted(tuple(r) for r in frame.select("v", "b", Q.middle_of(F.col("b").cast("long"))).collect())
    assert [b for _, b, _ in found] == sorted(b for _, b, _ in found)
    assert all(abs(middle - v) * 2 ** (Q.PRECISION + 1) <= v for v, _, middle in found)
    assert all(middle == v for v, _, middle in found if v < 2 ** (Q.PRECISION + 1))


def test_sketches_merge_to_the_sketch_of_the_whole(spark):
    r = random.Random(5)
    data = [(r.choice("ab"), int(r.lognormvariate(6, 2)) if r.random() < 0.95 else None) for _ in range(4000)]
    frame = spark.createDataFrame(data, "g string, v long").repartition(7)
    whole = Q.sketch(frame, ["g"], ("v",))
    parts = [Q.sketch(frame.filter(F.col("v").isNull() | (F.col("v") % 3 == k)), ["g"], ("v",)) for k in range(3)]
    merged = Q.merge(parts[0].unionByName(parts[1]).unionByName(parts[2].filter("n > 0")), ["g"])
    nulls_once = whole.filter("bucket IS NOT NULL")
    assert rows(merged) == rows(nulls_once)
    for g, _, n, low, high in rows(Q.quantiles(whole, ["g"], {"low": (1, 4), "high": (99, 100)})):
        exact = sorted(v for k, v in data if k == g and v is not None)
        assert n == len(exact)
        for got, (a, b) in ((low, (1, 4)), (high, (99, 100))):
            true = exact[-(-n * a // b) - 1]
            assert abs(got - true) * 2 ** (Q.PRECISION + 1) <= true


def test_limits_follow_the_source_then_the_language_then_the_corpus(spark):
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    code = "if<a> b|c d&e f<g> h|i j&k l<m> n|o p&q"
    schema = "doc_id long, text string, lang string, source string"
    table = [(i, f"{plain} {i}", "en", "news") for i in range(20)]
    table += [(100 + i, f"{code} {i}", "en", "code") for i in range(20)]
    table += [(200, code, "en", "news"), (201, plain, "en", "code"), (202, code, "en", "rare"), (203, code, None, None), (203, code, None, None)]
    judged = {r.id: r for r in Q.quality_rules(spark.createDataFrame(table, schema), least_rows=15).collect()}
    # Symbols are usual where half of a source's texts have them, and an outlier elsewhere.
    assert judged[100].kept and judged[100].scope == "source"
    assert not judged[200].kept and judged[200].reasons == "symbols"
    assert judged[201].kept
    assert judged[202].scope == "language" and judged[203].scope == "corpus"
    assert len(judged) == 44


def test_rules_on_odd_tables(documents, no_documents):
    assert Q.quality_rules(no_documents).collect() == []
    empty = Q.quality_rules(documents(None, "", " ", clash=True)).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in empty] == [(0, True, False)] * 3
    same = "the quick brown fox jumps over the lazy dog again and on"
    got = Q.quality_rules(documents((1, same), (1, same), (None, same), clash=True)).collect()
    assert sorted(str((r.id, r.kept)) for r in got) == ["(1, True)", "(1, True)", "(None, True)"]
