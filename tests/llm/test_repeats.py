from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from slotwise.llm import repeats as R
from slotwise.llm.suffix_array import permuted_lcp, suffix_array


def test_induced_sorting_and_common_prefixes_against_sorted_suffixes():
    r = random.Random(1)
    for _ in range(300):
        body = [r.randint(1, r.choice([1, 2, 3, 5])) for _ in range(r.randint(1, 60))]
        if r.random() < 0.3:
            body *= 2
        body.append(0)
        t = np.array(body, dtype=np.uint16)
        order = suffix_array(t)
        want = sorted(range(len(body)), key=lambda i: body[i:])
        assert order.tolist() == want
        common = permuted_lcp(t, order)
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(body) and body[a + n] == body[b + n]:
                n += 1
            assert common[b] == n


def brute(bodies, length):
    starts = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        rest = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def odd_texts():
    r = random.Random(3)
    base = "".join(r.choice("abcdéfgh ") for _ in range(1500))
    texts = ["a" * 3000, "ab" * 700, base, base[:900] + "X" + base[900:], base[300:520], "", None, "x" * 199, "y" * 200, "y" * 200, "z" * 201, base * 3]
    for _ in range(30):
        at = r.randrange(900)
        texts.append(base[at : at + r.randrange(150, 600)] + "".join(r.choice("xyz") for _ in range(r.randrange(300))))
    return texts


def test_cut_repeats_against_brute_force(documents):
    texts = odd_texts()
    docs = documents(*texts, (2, texts[2]), (None, texts[7]), clash=True)
    texts += [texts[2], texts[7]]
    ids = [*range(len(texts) - 2), 2, None]
    got = R.cut_repeats(docs, filter_bits=14, keep_bytes=True)
    want = sorted((str(i), *b) for i, b in zip(ids, brute([(t or "").encode() for t in texts], 200)))
    rows = got.collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert all(sum(r.stops) - sum(r.starts) == r.n_removed for r in rows)


def test_shards_that_outgrow_memory_give_the_same_windows(monkeypatch):
    rows = [(0, bytes([i]), 0, t.encode(), 1) for i, t in enumerate(odd_texts()) if t and len(t.encode()) >= 200]
    windows = lambda found: sorted((k, o) for k, at, a, b in found for s, e in zip(a, b) for o in range(at + s, at + e))
    whole = windows(R._array_batches(iter(rows), 200))
    monkeypatch.setattr(R, "SHARD_BYTES", 2000)
    monkeypatch.setattr(R, "ARRAY_BYTES", 3000)
    assert windows(R._array_batches(iter(rows), 200)) == whole != []


def test_no_documents(no_documents):
    assert R.cut_repeats(no_documents).collect() == []
