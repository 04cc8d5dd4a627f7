from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import fill_in_middle as M

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", text, None, None
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return doc_id, len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_fenwick_against_running_sums():
    r = random.Random(1)
    for size in (0, 1, 2, 3, 7, 8, 9, 100):
        first = [r.choice((0, 0, 1, 5)) for _ in range(size)]
        second = [r.randint(0, 9) for _ in range(size)]
        tree = M.Fenwick(np.array(first, np.int64), np.array(second, np.int64))
        for wanted in range(sum(first) + 2):
            place = next((i for i in range(size) if sum(first[: i + 1]) > wanted), size)
            assert tree.descend(wanted) == (place, sum(first[:place]), sum(second[:place]))


@pytest.mark.parametrize("block", [1, 2, 3, 64, 4096])
def test_cuts_at_every_unit_with_blocks_of_any_size(block):
    text = "Ab c\n\n" + "é" * 5 + "xyz😀zz9" + "q" * 50 + "…<P"
    units = UNIT.findall(text)
    found = M.Units(text.encode(), block)
    assert (found.n_units, found.n_points) == (len(units), len(text))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert found.cut_after(k) == (len(head.encode()), len(head))


def test_transformation_against_brute_force(documents):
    r = random.Random(2)
    texts = [
        None, "", "a", " ", "one word", "<P> in text", "x<S>", "<M>", "<P", "P><S", "<<S><", "é😀\x00 \r\n\t", "a" * 300_000,
        "é" * 100_000, "word " * 40_000, "<" * 999, "S>" * 99,
    ]
    texts += ["".join(r.choice("ab <>PSM\né😀") for _ in range(r.randint(0, 80))) for _ in range(300)]
    pairs = [*enumerate(texts), (5, "again"), (5, "again"), (None, "no id here"), (-3, "a negative id"), (2**62, "a large one")]
    cut = M.fill_in_middle(documents(*pairs, clash=True))
    got = cut.withColumn("restored", M.restore(F.col("output"), F.col("form"))).collect()
    order = lambda x: [str(v) for v in x]
    assert sorted((tuple(g)[:6] for g in got), key=order) == sorted((brute(*p) for p in pairs), key=order)
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    want = {i: t or "" for i, t in pairs}
    assert all(g.restored == want[g.id] for g in got if g.id != 5)


def test_transformation_of_nothing(no_documents):
    assert M.fill_in_middle(no_documents).collect() == []
