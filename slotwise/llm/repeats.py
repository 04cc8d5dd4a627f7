"""Suffix-array dedup: remove every byte inside a string of 200 bytes that starts anywhere else too.

Shards. Every window of 200 bytes belongs to the shard of its minimiser, the least hash among its
grams of ``GRAM`` bytes. Equal windows have equal minimisers, so windows of different shards are
never equal. Neighbouring windows mostly share their minimiser and travel together, as one stretch
of text. A window whose minimiser stands in no other place cannot repeat; such stretches never
leave their task.

Arrays. The stretches of some shards are written one after the other, sorted by induction into a
suffix array, and their permuted common prefixes tell which windows are equal. Equal stretches are
counted before they travel, so a passage that a third of all documents hold comes once per task.

Cuts. Documents learn which of their stretches' windows repeat, and drop what these cover. Everything
is judged on the input; an equal text has equal answers, so texts stand for their copies.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut_lineage
from .bpe import FILTER_BITS, rolling_hashes, shared_filter
from .common import mapped, parts_of, whole_text
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 32
#: Bytes of text in one suffix array, and of one shard before it is cut further by other minimisers.
ARRAY_BYTES = 1_000_000
SHARD_BYTES = 8_000_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _minimisers(bodies: list[bytes], length: int, seed: int):
    """(sizes, ends, hashes of all grams, least hash of each window, which windows lie inside a text)."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    ends = np.cumsum(sizes)
    whole = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    if len(whole) < length:
        nothing = np.empty(0, dtype=np.uint64)
        return sizes, ends, nothing, nothing, np.empty(0, dtype=bool)
    hashes = rolling_hashes(whole, GRAM, np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(29)
    least = _sliding_least(hashes, length - GRAM + 1)
    inside = np.arange(len(least)) <= np.repeat(ends - length, sizes)[: len(least)]
    return sizes, ends, hashes, least, inside


def minimiser_places(bodies: list[bytes], length: int = LENGTH, seed: int = 0) -> np.ndarray:
    """The hash at every place that is the minimiser of some window, once for each place.

    Two equal windows, be it within one periodic stretch, have their minimisers at two places.
    """
    _, _, hashes, least, inside = _minimisers(bodies, length, seed)
    if not len(least):
        return hashes.view(np.int64)
    width = length - GRAM + 1
    # A place is one if the largest of the least hashes of the windows around it is its own hash.
    edge = np.full(width - 1, ~np.uint64(0), dtype=np.uint64)
    turned = np.concatenate([edge, np.where(inside, ~least, ~np.uint64(0)), edge])
    return hashes[~_sliding_least(turned, width) == hashes].view(np.int64)


def window_stretches(bodies: list[bytes], length: int = LENGTH, seed: int = 0):
    """(number of the text, first window, end of windows, minimiser) of all stretches of some texts."""
    sizes, ends, _, least, inside = _minimisers(bodies, length, seed)
    if not len(least):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    fresh = np.empty(len(least), dtype=bool)
    fresh[0] = True
    fresh[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    begins = ends - sizes
    fresh[begins[begins < len(least)]] = True
    first = np.flatnonzero(fresh)
    stop = np.append(first[1:], len(least))
    keep = inside[first]
    first, stop = first[keep], stop[keep]
    text = np.searchsorted(ends, first, side="right")
    return text, first - begins[text], stop - begins[text], least[first].view(np.int64)


def repeated_windows(stretches: list[tuple[bytes, int]], length: int = LENGTH) -> list[tuple[list[int], list[int]]]:
    """For each (stretch, times it occurs) the ranges of windows that start somewhere else too."""
    sizes = np.array([len(s) for s, _ in stretches], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    # Bytes are symbols 1 to 256; 257 ends a stretch and 0 the whole.
    t = np.frombuffer(b"\0".join(s for s, _ in stretches) + b"\0", dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    t[begins + sizes] = 257
    t = np.append(t, np.uint16(0))
    order = suffix_array(t)
    common = permuted_lcp(t, order)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    owner = np.append(owner, len(sizes) - 1)
    valid = np.arange(len(t)) <= begins[owner] + sizes[owner] - length
    group = np.cumsum(common[order] < length) - 1
    times = np.array([n for _, n in stretches], dtype=np.int64)[owner] * valid
    total = np.bincount(group, weights=times[order])
    repeated = np.zeros(len(t) + 1, dtype=bool)
    repeated[order] = total[group] >= 2
    repeated[:-1] &= valid
    change = np.flatnonzero(np.diff(np.concatenate([[False], repeated])))
    starts, stops = change[::2], change[1::2]
    by = owner[starts]
    return [
        ((starts[by == k] - begins[k]).tolist(), (stops[by == k] - begins[k]).tolist())
        if k in some else ([], []) for some in [set(by.tolist())] for k in range(len(sizes))
    ]


def _array_batches(shards: Iterator[tuple], length: int, depth: int = 1) -> Iterator[tuple]:
    """(label, offset, range starts, range stops) of rows (shard, label, offset, stretch, times) that come by shard."""
    batch: list[tuple] = []
    size = 0

    def finish():
        found = repeated_windows([(row[3], row[4]) for row in batch], length)
        return [(row[1], row[2], a, b) for row, (a, b) in zip(batch, found, strict=True) if a]

    for _, rows in groupby(shards, key=lambda row: row[0]):
        own, bytes_, files = [], 0, None
        for row in rows:
            if files is not None:
                _cut_further(row, files, length, depth)
                continue
            own.append(row)
            bytes_ += len(row[3])
            if bytes_ > SHARD_BYTES and depth < 8:
                # A shard that outgrows its memory: its windows are dealt to files by another minimiser.
                files = [tempfile.TemporaryFile() for _ in range(32)]  # noqa: SIM115 - closed below
                for held in own:
                    _cut_further(held, files, length, depth)
                own = []
        if files is not None:
            for file in files:
                with file:
                    file.seek(0)
                    held = sorted(_unpickled(file), key=lambda row: row[0])
                    yield from _array_batches(iter(held), length, depth + 1)
            continue
        batch += own
        size += bytes_
        if size > ARRAY_BYTES:
            yield from finish()
            batch, size = [], 0
    if batch:
        yield from finish()


def _cut_further(row: tuple, files: list, length: int, depth: int) -> None:
    _, label, offset, stretch, times = row
    _, firsts, stops, keys = window_stretches([stretch], length, depth)
    for first, stop, key in zip(firsts.tolist(), stops.tolist(), keys.tolist(), strict=True):
        pickle.dump((key, label, offset + first, stretch[first : stop + length - 1], times), files[key % len(files)])


def _unpickled(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _together(stream: Iterator[tuple], at: int, size: int = 400_000) -> Iterator[list[tuple]]:
    batch, n = [], 0
    for row in stream:
        batch.append(row)
        n += len(row[at])
        if n > size:
            yield batch
            batch, n = [], 0
    if batch:
        yield batch


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                filter_bits: int = FILTER_BITS, keep_bytes: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and stops of
    the removed runs of bytes) and, where asked for, the kept bytes.

    Null texts count as empty; repeated rows and rows with equal texts count as several, so such a
    text of ``length`` bytes or more loses them all. Null ids are kept, an empty table gives an empty
    result, other columns are ignored. Long texts are read whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).cast("binary").alias("body"))
    bodies = rows.select("body").filter(F.length("body") >= length)

    def minimisers(stream):
        for batch in _together(stream, 0):
            yield (minimiser_places([body for (body,) in batch], length).tolist(),)

    counted = mapped(bodies, "keys array<long>", minimisers).select(F.explode("keys").alias("h"), F.lit(1).alias("n"))
    bitmap = spark.sparkContext.broadcast(shared_filter(counted, filter_bits))

    def stretches(stream):
        """Distinct stretches of the task with how often they occur, and where each distinct text has which."""
        shared, mask = bitmap.value, np.int64((1 << filter_bits) - 1)
        found: dict[bytes, list] = {}
        size, sent = 0, set()
        for batch in _together(stream, 0):
            own = [body for (body,) in batch]
            text, first, stop, keys = window_stretches(own, length)
            hit = (shared[(keys & mask) >> np.int64(6)] >> (keys & np.int64(63))) & np.int64(1) == 1
            places: dict[int, tuple[list, list]] = {}
            for k, a, b, key in zip(*(x[hit].tolist() for x in (text, first, stop, keys)), strict=True):
                stretch = own[k][a : b + length - 1]
                label = blake2b(stretch, digest_size=16).digest()
                if label in found:
                    found[label][2] += 1
                else:
                    found[label] = [key, stretch, 1]
                    size += len(stretch)
                starts, labels = places.setdefault(k, ([], []))
                starts.append(a)
                labels.append(label)
            for k, (starts, labels) in places.items():
                text_key = sha256(own[k]).digest()
                if text_key not in sent:
                    if len(sent) < 300_000:  # it only saves sending the places of a copy twice
                        sent.add(text_key)
                    yield None, None, None, None, text_key, starts, labels
            if size > 16_000_000:
                yield from ((key, label, s, n, None, None, None) for label, (key, s, n) in found.items())
                found, size = {}, 0
        yield from ((key, label, s, n, None, None, None) for label, (key, s, n) in found.items())

    cut = cut_lineage(mapped(
        bodies,
        "shard long, label binary, stretch binary, times long, text_key binary, starts array<long>, labels array<binary>",
        stretches,
    ))

    def sort_shards(stream):
        def merged():
            for (shard, label), same in groupby(stream, key=lambda row: (row[0], row[1])):
                first = next(same)
                yield shard, label, 0, first[2], first[3] + sum(row[3] for row in same)

        for label, offset, starts, stops in _array_batches(merged(), length):
            yield label, [offset + s for s in starts], [offset + s for s in stops]

    dealt = cut.filter("label is not null").select("shard", "label", "stretch", "times")
    dealt = dealt.repartition(parts_of(spark), "shard").sortWithinPartitions("shard", "label")
    repeated = mapped(dealt, "found_label binary, froms array<long>, tos array<long>", sort_shards)
    places = (
        cut.filter("text_key is not null").select("text_key", F.explode(F.arrays_zip("starts", "labels")).alias("p"))
        .select("text_key", F.col("p.starts").alias("start"), F.col("p.labels").alias("place_label"))
        .dropDuplicates(["text_key", "start"])
    )
    spans = (
        places.join(repeated, F.col("place_label") == F.col("found_label"))
        .select("text_key", F.explode(F.arrays_zip("froms", "tos")).alias("r"), "start")
        .select("text_key", (F.col("start") + F.col("r.froms")).alias("a"), (F.col("start") + F.col("r.tos") - 1 + length).alias("b"))
        # A text has no more spans than stretches and windows, so this group is bounded by its length.
        .groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
        .select(F.col("text_key").alias("cut_key"), F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))
    )

    def remove(stream):
        for id_, body, starts, stops in stream:
            runs: list[list[int]] = []
            for a, b in zip(starts or [], stops or [], strict=True):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = [], 0
            for a, b in runs:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            rest = b"".join(kept)
            yield (id_, len(body), len(body) - len(rest), len(runs), sha256(rest).hexdigest(),
                   [a for a, _ in runs], [b for _, b in runs], rest if keep_bytes else None)

    keyed = rows.withColumn("own_key", F.unhex(F.sha2("body", 256)))
    return mapped(
        keyed.join(spans, F.col("own_key") == F.col("cut_key"), "left").select("id", "body", "a", "b"),
        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>, "
        "kept binary",
        remove,
    )
