from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from slotwise.llm import conversation_repair as C
from slotwise.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def brute_script(codes):
    """Least (cost, script) over all scripts, by whole strings: one best script per state and row."""
    best = {0: (0, "")}
    for code in [*codes, None]:
        for _ in range(2):
            for q, (c, s) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (1 << 30, "")), (c + 2, s + "I"))
        if code is None:
            break
        after = {}
        role, extra = code.lower(), int(code.isupper())
        for q, (c, s) in best.items():
            fill = 3 if q == 2 else 2
            steps = [("D", 3, q)]
            if code != "D":
                steps.append(("R", 2 + extra, fill))
                if role == "s" and q == 0:
                    steps.append(("K", extra, 1))
                if role == "u" and q != 2 or role == "a" and q == 2:
                    steps.append(("K", extra, fill))
            for edit, cost, to in steps:
                way = (c + cost, s + edit)
                after[to] = min(after.get(to, way), way)
        best = after
    # Behind the last row inserts are in already; an accepted state without them is cheaper or equal.
    return min(best[q] for q in (0, 3) if q in best)


def test_search_and_joined_blocks_against_brute_force(monkeypatch):
    r = random.Random(4)
    for trial in range(600):
        codes = "".join(r.choice("uaUAsxSXD" if trial % 3 else "uuaaD") for _ in range(r.randint(0, 14)))
        want = brute_script(codes)
        assert C.search(codes, C.EMPTY, None) == want, codes
        for size in (1, 2, 5):
            parts = [codes[i : i + size] for i in range(0, len(codes), size)] or [""]
            found = [C.ways(p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)]
            assert C.join_blocks(found) == want, (codes, size)


def test_estimates_never_exceed_what_is_needed():
    r = random.Random(9)
    for _ in range(200):
        codes = "".join(r.choice("uaUAsxSXD") for _ in range(r.randint(1, 12)))
        assert C.estimates(codes)[0] <= brute_script(codes)[0]


@pytest.mark.parametrize("codes", ["u" * 64, "s" * 64, "uua" * 21, "aU" * 32, "auuaasx" * 9, "D" * 64, "AsuUxD" * 10])
def test_a_block_of_bad_rows_is_searched_through(codes):
    assert C.search(codes, C.EMPTY, None) == brute_script(codes)


def brute(table):
    """The query's rows by plain loops."""
    rows = {}
    for conv, turn, role, text in table:
        rows.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        rows[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, found in rows.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, codes, faults, illegal = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        for k, (_, role, text) in enumerate(found):
            body = text.rstrip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            code = role[:1] if role[:1] and role[:1] in "sua" else "x"
            codes += "D" if fault in ("blank", "duplicate") else code.upper() if fault else code
            illegal += k > 0 and found[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit = brute_script(codes)
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        lines, before, rest = [], "", iter(found)
        for edit in audit:
            fill = "assistant" if before == "u" else "user"
            if edit == "I":
                lines.append(f"{fill}:")
            else:
                _, role, text = next(rest)
                if edit == "D":
                    continue
                lines.append(f"{role if edit == 'K' else fill}:{text}")
            before = lines[-1][0]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, tmp_path, table):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(table, SCHEMA)
    for name in ("id", "n", "conv", "first", "audit", "kind", "block"):
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_conversation_repair(spark, str(tmp_path)).select(*COLUMNS)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    texts = ["Yes.", "No!", "Why?", "so", "", " \n", "A b.\t", "\xa0", "é😀?", None, "x" * 100_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", None, "s", "übel"]
    table = [
        (conv, r.choice((None, *range(-2, 12))), r.choice(roles[: r.choice((2, 5, 11))]), r.choice(texts))
        for conv in (*range(60), None)
        for _ in range(r.randint(1, 12))
    ]
    table += [(100, t, "user", "same.") for t in range(300)] + [(101, 1, "user", "same.")] * 300
    table += [(102, t, r.choice(roles), f"{t}" + r.choice(".?,")) for t in range(700)]
    # A conversation whose only row is dropped.
    lost = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table += [(lost, 0, "user", "gone.")]
    assert run(spark, tmp_path, table) == sorted(brute(table), key=str)


def test_query_on_nothing(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_repaired_rows_alternate_and_keep_their_texts(spark):
    table = [(1, 0, "assistant", "Hi."), (1, 1, "user", "One"), (1, 2, "user", "Two."), (1, 3, "user", ""), (2, 0, "user", " ")]
    frame = spark.createDataFrame(table, SCHEMA)
    plans = C.plan_repairs(frame)
    assert {r.conv: (r.cost, r.audit) for r in plans.collect()} == {"=1": (8, "IKKRD"), "=2": (3, "D")}
    got = sorted(tuple(r) for r in C.repaired_turns(frame, plans).collect())
    assert got == [
        ("=1", 0, "I", "user", ""), ("=1", 1, "K", "assistant", "Hi."), ("=1", 2, "K", "user", "One"), ("=1", 3, "R", "assistant", "Two."),
    ]
