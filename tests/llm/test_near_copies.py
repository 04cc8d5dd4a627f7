from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from slotwise.llm import graph, jaccard_join, nn_descent, queries
from tests.conftest import rows


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 9), (9, 8), (8, 7), (3, 3)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert dict(rows(got)) == smallest_reachable(linked, [e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    words = [w for w in (text or "").encode().split()]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute_join(docs):
    sets = [shingles(t) for _, t in docs]
    links, edges = Counter(), []
    for i, j in itertools.combinations(range(len(docs)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            links[i] += 1
            links[j] += 1
            edges.append((i, j))
    roots, least = smallest_reachable(range(len(docs)), edges), defaultdict(list)
    for i, root in roots.items():
        least[root].append(docs[i][0])
    return sorted((docs[i][0], min(least[roots[i]]), links[i]) for i in range(len(docs)))


def near_texts(r, n):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([3, 5, 6, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            copy = base[:]
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = word()
            texts.append(r.choice([" ", "\n", "  "]).join(copy))
    return texts


def test_jaccard_join_against_brute_force(documents):
    r = random.Random(8)
    texts = [*near_texts(r, 60), "", None, " \n ", "one", "one", "two words", "long " * 30_000, "long " * 30_001]
    docs = [(r.randrange(10**6) * 1000 + i, t) for i, t in enumerate(texts)]
    docs += [docs[5], docs[5]]
    got = jaccard_join.jaccard_join(documents(*docs, clash=True))
    assert sorted((r.id, r.class_id, r.n_links) for r in got.collect()) == brute_join(docs)
    assert all(r.kept == (r.id == r.class_id) for r in got.collect())


def test_large_group_of_near_copies_is_counted_in_blocks(documents):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(600):
        copy = base[:]
        copy[r.randrange(120)] = f"own{i}"
        texts.append(" ".join(copy))
    docs = list(enumerate(texts))
    got = jaccard_join.jaccard_join(documents(*docs))
    assert sorted((r.id, r.class_id, r.n_links) for r in got.collect()) == brute_join(docs)


def test_null_ids_give_way(documents):
    got = jaccard_join.jaccard_join(documents((None, "a b c d e f"), (4, "a b c d e f"), (None, "quite another text")))
    assert rows(got.select("id", "class_id", "n_links", "kept")) == [(4, 4, 1, True), (None, 4, 1, False), (None, None, 0, True)]


def test_join_of_nothing(no_documents):
    assert jaccard_join.jaccard_join(no_documents).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    tests = jaccard_join.least_agreements()
    r = np.random.default_rng(1)
    alive = 0
    for _ in range(2000):
        agree = r.random(jaccard_join.VALUES) < 0.8
        alive += all(agree[:n].sum() >= least for n, least in tests)
    assert alive >= 1998
    assert tests[0][1] >= 4  # and yet drops pairs that hardly agree, early


SCHEMA = "vec_id long, embedding array<float>, label int, id string, node string"


def brute_links(data, threshold=0.98):
    usable = {}
    for i, v, label in data:
        if label is None or not v or any(x is None for x in v):
            continue
        a = np.array(v, dtype=np.float32).astype(float)
        if np.isfinite(a).all() and a.any():
            usable[i] = (label, a / np.linalg.norm(a))
    links, edges = Counter(), []
    for (i, (la, a)), (j, (lb, b)) in itertools.combinations(usable.items(), 2):
        if la == lb and len(a) == len(b) and a @ b >= threshold:
            links[i] += 1
            links[j] += 1
            edges.append((i, j))
    roots = smallest_reachable([d[0] for d in data], edges)
    return sorted((i, links[i], roots[i], roots[i] == i) for i, _, _ in data)


def test_nn_descent_against_brute_force(spark):
    r = np.random.default_rng(10)
    data, centre = [], r.normal(size=16)
    for i in range(700):
        kind = r.integers(0, 4)
        v = centre + 0.16 * r.normal(size=16) if kind == 0 else r.normal(size=16)
        data.append([i, v.astype(np.float32).tolist(), int(r.integers(0, 2))])
    for i in range(700, 760):
        source = data[r.integers(0, 700)]
        data.append([i, (np.array(source[1]) * 3 + 0.05 * r.normal(size=16)).astype(np.float32).tolist(), source[2]])
    data += [[760, data[0][1], data[0][2]], [761, None, 0], [762, [0.0] * 16, 0], [763, [float("nan")] * 16, 0], [764, data[0][1], None],
             [765, [None] + data[0][1][1:], 0], [766, [float("inf")] + [0.0] * 15, 1], [767, [], 0], [768, [1e-30] * 16, 0], [769, [1e30] * 16, 0]]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in data], SCHEMA)
    got, recall = nn_descent.near_links(df)
    assert recall >= 0.95
    got, want = sorted(map(tuple, got.collect())), brute_links(data)
    wrong = sum(a != b for a, b in zip(got, want, strict=True))
    assert wrong <= 0.05 * len(want)
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # never a link below the threshold


def tight_groups(r, sizes, dimension=32, across=0.985):
    """Unit vectors in groups with cosines of about 0.999 inside and ``across`` between any two groups."""
    axes = np.linalg.qr(r.normal(size=(dimension, dimension)))[0]
    data = []
    for g, size in enumerate(sizes):
        centre = np.sqrt(across) * axes[0] + np.sqrt(1 - across) * axes[g + 1]
        data += [centre + 0.02 / np.sqrt(dimension) * r.normal(size=dimension) for _ in range(size)]
    return [v.astype(np.float32).tolist() for v in data]


def test_lists_full_of_own_members_do_not_hide_links_to_other_groups(spark):
    data = [(i, v, 0) for i, v in enumerate(tight_groups(np.random.default_rng(21), [20, 20, 12]))]
    want = brute_links(data)
    assert {w[2] for w in want} == {0} and min(w[1] for w in want) == 51  # one component, by links across
    got, _ = nn_descent.near_links(spark.createDataFrame([(*d, "clash", "clash") for d in data], SCHEMA))
    assert sorted(map(tuple, got.collect())) == want


def test_audit_sees_rare_pairs_and_adds_what_the_trees_miss(spark, monkeypatch):
    r = np.random.default_rng(23)
    alone = r.normal(size=(2400, 64))
    other = alone[:40] / np.linalg.norm(alone[:40], axis=1)[:, None]
    other += 0.19 / np.sqrt(64) * r.normal(size=other.shape)
    data = [(i, v.astype(np.float32).tolist(), 0, "clash", "clash") for i, v in enumerate([*alone, *other])]
    monkeypatch.setattr(nn_descent, "TREES", 1)
    got, recall = nn_descent.near_links(spark.createDataFrame(data, SCHEMA), most_rounds=1)
    unit = np.array([d[1] for d in data])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    assert 40 <= near.sum() <= 80
    assert {row.id: row.n_links for row in got.collect()} == dict(enumerate(near.sum(axis=1).tolist()))
    assert recall == 1.0


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "near_links", lambda vectors: (vectors, 0.5))
    with pytest.raises(RuntimeError, match="recall"):
        queries.op3_nn_descent(spark, "/root/testdata/sf0.01")


def test_a_block_gives_out_a_forest_of_all_its_links():
    unit = np.array(tight_groups(np.random.default_rng(22), [20, 20]), dtype=float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    found = list(nn_descent._nearest(list(range(40)), unit, 0.98))
    lists, links = ([f[:2] for f in found if f[3] == kind] for kind in (0, 1))
    assert len(set(smallest_reachable(range(40), lists).values())) > 1
    assert set(smallest_reachable(range(40), links).values()) == {0} and len(links) == 39


def test_nn_descent_of_nothing(spark):
    got, _ = nn_descent.near_links(spark.createDataFrame([], SCHEMA))
    assert got.collect() == []
