"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two link when their Jaccard similarity is 0.8 or more.

* MinHash: 96 values a text. Texts that agree in one of 24 bands of four values are candidates; a
  pair at the threshold misses every band with probability 3e-6.
* Pruning: the values of a candidate pair are compared 16 at a time. With a uniform prior, m
  agreements in n make the similarity Beta(m + 1, n - m + 1) distributed; once the probability of
  reaching the threshold is below ``TOLERANCE``, the pair is dropped.
* Exact check: surviving pairs are compared by their shingles.

Nothing grows with the square of a group. Buckets are cut into blocks of bounded size, block pairs
are compared inside tasks, and only a spanning forest of the survivors leaves them. All true pairs
that survived lie within the survivors' components; these are compared exactly, again in pairs of
blocks, which give out each text's number of links and a spanning forest of the true links.
"""

from __future__ import annotations

from itertools import groupby
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut_lineage
from .common import mapped, parts_of, whole_text
from .graph import components

WORDS = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, so that the exact check stays in whole numbers
VALUES, ROWS, STEP = 96, 4, 16
TOLERANCE = 1e-6
BLOCK = 256

_SEEDS = np.random.default_rng(20240229).integers(0, 1 << 32, (2, VALUES), dtype=np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_hashes(body: bytes) -> np.ndarray:
    """32-bit hashes of the shingles of a text; words are what ASCII white space parts, as in bytes.split().

    A text of one to four words is one shingle, one without words has none.
    """
    raw = np.frombuffer(body.strip(b" \t\n\v\f\r"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint32)
    inner = ~_SPACE[raw]
    starts = np.flatnonzero(inner & np.concatenate([[True], ~inner[:-1]]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    powers = _powers(int(place.max()) + 1)
    words = np.add.reduceat(np.where(inner, (raw.astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0)), starts)
    words ^= words >> np.uint64(31)
    words *= np.uint64(0x9E3779B97F4A7C15)
    n = min(WORDS, len(words))
    hashes = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
        hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 64), 0x100000001B3, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The least of each of VALUES permutations over the shingles."""
    best = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None]
        mixed = (part ^ _SEEDS[0][None, :]) * (_SEEDS[1] | np.uint32(1))[None, :]
        mixed ^= mixed >> np.uint32(15)
        np.minimum(best, mixed.min(axis=0), out=best)
    return best


def band_keys(values: np.ndarray) -> list[int]:
    keys = np.zeros(VALUES // ROWS, dtype=np.uint64)
    for column in values.reshape(-1, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return (keys + np.arange(len(keys), dtype=np.uint64)).view(np.int64).tolist()


def least_agreements(tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, fewest agreements among the first n values that a pair may have to go on)."""
    t = THRESHOLD[0] / THRESHOLD[1]
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail = 0.0  # P(similarity >= t) for Beta(m + 1, n - m + 1) is a binomial sum up to m
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                out.append((n, m))
                break
    return out


def surviving(left: np.ndarray, right: np.ndarray, tests: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs (row of left, row of right) survive the incremental comparison."""
    n, least = tests[0]
    agree = (left[:, None, :n] == right[None, :, :n]).sum(axis=2, dtype=np.int16)
    alive = agree >= least
    i, j = np.nonzero(alive)
    seen = agree[i, j]
    for more, least in tests[1:]:
        if not len(i):
            break
        seen = seen + (left[i, n:more] == right[j, n:more]).sum(axis=1, dtype=np.int16)
        keep = seen >= least
        i, j, seen, n = i[keep], j[keep], seen[keep], more
    alive[:] = False
    alive[i, j] = True
    return alive


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency matrix the first node of its component."""
    label = np.arange(len(linked))
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _square(across: np.ndarray, split: int, size: int) -> np.ndarray:
    """Adjacency of both blocks together from that of one side to the other (or of one block)."""
    if split == size:
        return across | across.T
    whole = np.zeros((size, size), dtype=bool)
    whole[:split, split:] = across
    return whole | whole.T


def in_block_pairs(rows: DataFrame, group: str, size: Column, member: str) -> DataFrame:
    """Deal the rows of each group to pairs of blocks: adds low, high (the pair) and ``side``.

    A group of n rows has n / BLOCK blocks, told apart by a hash of the member; each row goes to
    every pair that its block is in, so each two rows of a group meet in exactly one pair.
    """
    blocks = F.ceil(size / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(member, group), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).withColumn(
        "side", F.when(F.col("own") == F.col("low"), 0).otherwise(1)
    )


def shared_shingles(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's shingle set, matrix of common shingles), exact: words get numbers, and
    numbers of ever longer runs of words are made from pairs of numbers."""
    names: dict[bytes, int] = {}
    texts = [np.array([names.setdefault(w, len(names)) for w in b.split()], dtype=np.int64) for b in bodies]
    lengths = [min(WORDS, len(t)) for t in texts]
    owner = np.concatenate([np.full(max(len(t) - n + 1, 0) if n else 0, i) for i, (t, n) in enumerate(zip(texts, lengths))])
    # Texts under five words are filled up with a word that no text has.
    runs = np.concatenate([
        np.stack([t[k : len(t) - n + 1 + k] if k < n else np.full(len(t) - n + 1, -1) for k in range(WORDS)])
        if n else np.empty((WORDS, 0), dtype=np.int64) for t, n in zip(texts, lengths)
    ], axis=1)
    number = runs[0] + 1
    for k in range(1, WORDS):
        number = np.unique(number * (len(names) + 2) + runs[k] + 1, return_inverse=True)[1].reshape(-1)
    pairs = np.unique(number * len(bodies) + owner)
    number, owner = pairs // len(bodies), pairs % len(bodies)
    sizes = np.bincount(owner, minlength=len(bodies))
    common = np.zeros((len(bodies), len(bodies)), dtype=np.float64)
    several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, dtype=bool)
    number, owner = np.unique(number[several], return_inverse=True)[1].reshape(-1), owner[several]
    for at in range(0, int(number.max()) + 1 if len(number) else 0, 4096):
        part = (number >= at) & (number < at + 4096)
        dense = np.zeros((len(bodies), 4096), dtype=np.float32)
        dense[owner[part], number[part] - at] = 1
        common += dense @ dense.T
    return sizes, common.astype(np.int64)


def text_key(text_col: str) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(whole_text(text_col), 256)), 1, 16)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_links, kept, group_key, text_key.

    ``n_links`` counts the other rows whose text has similarity 0.8 or more, copies included;
    ``class_id`` is the smallest id reachable over links; ``kept`` marks rows whose id it is. Rows of
    one class have one ``group_key``, and ``text_key`` stands for the row's own text.
    Null texts count as empty; texts without words have no shingle and link with nothing, not even
    with each other, so they stay in classes of their own. Repeated rows are copies of each other
    and share a class, and ids that are null give way to others (a class of nulls has a null
    class_id and keeps its rows). An empty table gives an empty result.
    """
    parts = parts_of(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), whole_text(text_col).alias("text"))

    def sketch(stream):
        sent = set()
        for id_, key, text in stream:
            if key in sent:
                yield id_, key, None, None
                continue
            if len(sent) < 300_000:  # it only saves work on copies
                sent.add(key)
            hashes = shingle_hashes(text.encode())
            values = minhash(hashes) if len(hashes) else None
            yield id_, key, None if values is None else values.tobytes(), [] if values is None else band_keys(values)

    sketched = cut_lineage(mapped(rows, "id long, key binary, sketch binary, bands array<long>", sketch))
    distinct = sketched.filter("bands is not null").groupBy("key").agg(
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    distinct = distinct.filter("sketch is not null")
    bands = distinct.select("key", F.explode("bands").alias("bucket"))
    crowded = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = bands.join(crowded, "bucket").join(distinct.select("key", "sketch"), "key")
    paired = in_block_pairs(met, "bucket", F.col("n"), "key").select("bucket", "low", "high", "side", "key", "sketch")
    tests = least_agreements()

    def prune(stream):
        for _, members in groupby(stream, key=lambda row: row[:3]):
            members = list(members)
            keys = [row[4] for row in members]
            values = np.frombuffer(b"".join(row[5] for row in members), dtype=np.uint32).reshape(len(keys), VALUES)
            split = sum(row[3] == 0 for row in members)
            across = surviving(values[:split], values[split:] if split < len(keys) else values, tests)
            if split == len(keys):
                np.fill_diagonal(across, False)
            for i, root in enumerate(forest(_square(across, split, len(keys))).tolist()):
                if root != i:
                    yield keys[root], keys[i]

    # Every pair has its own part of the key, so a crowded bucket is spread over as many tasks.
    survivors = mapped(
        paired.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "side"),
        "a binary, b binary", prune, 65536,
    )
    groups = cut_lineage(components(survivors))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    copies = sketched.groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), F.max(F.col("sketch").isNotNull()).alias("worded")
    )
    members = groups.join(sizes, "component").join(copies, F.col("id") == F.col("key")).select(
        "key", "component", "n", "copies"
    )
    texts = rows.select("key", "text").join(members, "key").dropDuplicates(["key"])
    checked = in_block_pairs(texts, "component", F.col("n"), "key").select(
        "component", "low", "high", "side", "key", "copies", "text"
    )

    def verify(stream):
        over, under = THRESHOLD
        for _, members in groupby(stream, key=lambda row: row[:3]):
            members = list(members)
            keys, weights = [row[4] for row in members], np.array([row[5] for row in members], dtype=np.int64)
            split = sum(row[3] == 0 for row in members)
            sizes, common = shared_shingles([row[6].encode() for row in members])
            linked = under * common >= over * (sizes[:, None] + sizes[None, :] - common)
            np.fill_diagonal(linked, False)
            if split < len(keys):  # only pairs across the two blocks are this task's
                linked[:split, :split] = False
                linked[split:, split:] = False
            links = linked @ weights
            for i, root in enumerate(forest(linked).tolist()):
                if links[i]:
                    yield keys[i], int(links[i]), keys[root]

    verified = cut_lineage(mapped(
        checked.repartition(parts, "component", "low", "high").sortWithinPartitions("component", "low", "high", "side"),
        "key binary, links long, root binary", verify, 65536,
    ))
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("root").alias("a"), F.col("key").alias("b")))
    # The smallest id of a class, and every member's class.
    named = (
        classes.join(copies, F.col("id") == F.col("key")).groupBy("component").agg(F.min("least_id").alias("class_id"))
    )
    joined = (
        classes.join(named, "component").join(links, F.col("id") == F.col("key"))
        .select(F.col("key").alias("linked_key"), "class_id", "links", "component")
    )
    # Only texts with a link or a copy need an answer from elsewhere.
    answers = copies.join(joined, F.col("key") == F.col("linked_key"), "left").filter(
        F.col("worded") & ((F.col("copies") > 1) | (F.col("links") > 0))
    ).select(F.col("key").alias("own_key"), "copies", "least_id", "class_id", "links", "component")
    return (
        sketched.select("id", "key").join(answers, F.col("key") == F.col("own_key"), "left")
        .select(
            "id",
            F.when(F.col("own_key").isNull(), F.col("id")).when(F.col("component").isNull(), F.col("least_id"))
            .otherwise(F.col("class_id")).alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("component", "key").alias("group_key"),
            F.col("key").alias("text_key"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))
    )
