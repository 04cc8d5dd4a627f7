"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Documents become pieces of at most ``capacity`` tokens; full ones are a sequence of their own. The
others are dealt evenly to partitions of a bounded number of pieces, and each partition packs its
own by best-fit decreasing. Dual feasible functions of the lengths bound from below how many bins a
partition needs. Where the packing meets its bound it is certified optimal. Where a gap is left, the
partition gives up its bins that are not full; the pieces of all such partitions are exchanged,
dealt to fewer partitions and packed anew, as long as that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut_lineage
from . import bpe
from .common import mapped, parts_of, whole_text

#: Pieces that one partition packs; bounds the memory of a task.
PIECES = 16384
END = 2

PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, ids binary"
PACKED_COLUMNS = PIECE_COLUMNS + ", group long, bin long, offset long, fill long, gap long"


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full ones, a shorter one before them."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END, keep_ids: bool = False,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. Null texts are empty and give one piece with the end id alone; null ids stay null.

    ``uid`` numbers pieces by task, so repeated rows keep apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))

    def pieces(stream):
        from pyspark import TaskContext

        encode, uid = bpe.encoder(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4")
        for id_, text in stream:
            ids = np.concatenate([encode(text), end])
            for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                own = ids[start : start + length].tobytes()
                yield id_, k, start, length, zlib.crc32(own), uid, own if keep_ids else None
                uid += 1

    return mapped(rows, PIECE_COLUMNS, pieces)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin.

    Bins are kept by what is left in them, and one big integer tells which rests occur, so the
    tightest fit is its lowest set bit from the length on.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    rests: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = present >> length
        if fitting:
            rest = length + (fitting & -fitting).bit_length() - 1
            b = rests[rest].pop()
            if not rests[rest]:
                present &= ~(1 << rest)
        else:
            rest, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += length
        rests[rest - length].append(b)
        present |= 1 << (rest - length)
    return bins, offsets, np.array(fills, dtype=np.int64)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """The best lower bound on bins of two families of dual feasible functions.

    Both map lengths so that whatever fits one bin still does; the mapped total over the capacity is
    then a bound. The first takes large lengths as whole bins and drops small ones, for each
    threshold; the second rounds lengths down in k+1-ths of a bin and counts them in k-ths.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    many, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(total[-1]) // capacity)
    for threshold in range(1, capacity // 2 + 1):
        large = int(many[-1] - many[capacity - threshold])
        middle = int(total[capacity - threshold] - total[threshold - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        # Twice the unit keeps both cases whole: exact multiples stay, others round down in k-ths.
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _groups(n: int, group_size: int) -> int:
    return max(1, -(-n // group_size))


def _pack(pieces: DataFrame, n: int, capacity: int, group_size: int, salt: int) -> DataFrame:
    groups = _groups(n, group_size)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(groups)))
    columns = [field.strip().split(" ")[0] for field in PIECE_COLUMNS.split(",")]
    dealt = dealt.select(*columns, "group").repartition(min(groups, parts_of(pieces.sparkSession)), "group")

    def pack(stream):
        for group, members in groupby(stream, key=lambda row: row[7]):
            rows = list(members)
            lengths = np.array([row[3] for row in rows], dtype=np.int64)
            bins, offsets, fills = best_fit_decreasing(lengths, capacity)
            gap = len(fills) - least_bins(lengths, capacity)
            for row, b, offset in zip(rows, bins.tolist(), offsets.tolist(), strict=True):
                yield *row, b, offset, int(fills[b]), gap

    # Sorted by uid as well, so that a task that runs again packs the same.
    return mapped(dealt.sortWithinPartitions("group", "uid"), PACKED_COLUMNS, pack)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = END, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text", group_size: int = PIECES, rounds: int | None = None) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, ids,
    sequence_id, offset, fill (tokens of the sequence), certified.

    ``certified`` says that the group of partitions which packed the piece met its lower bound.
    An empty table gives an empty result; see :func:`document_pieces` for nulls and repeated rows.
    Exchanges go on while they save bins, so they end; ``rounds``, where given, ends them sooner.
    """
    # Tokenising is the dear part: it is written, and all that follows reads the narrow rows.
    pieces = cut_lineage(document_pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col))
    full = pieces.filter(F.col("length") == capacity)
    partial = pieces.filter(F.col("length") < capacity)
    placed, base, n = [], 0, partial.count()
    current = cut_lineage(_pack(partial, n, capacity, group_size, 0))
    for salt in count(1):
        if rounds is not None and salt >= rounds:
            break
        dealt = _groups(n, group_size)
        loose = (F.col("gap") > 0) & (F.col("fill") < capacity)
        pool = current.filter(loose)
        n, bins, groups = pool.agg(
            F.count(F.lit(1)), F.sum((F.col("offset") == 0).cast("long")), F.count_distinct("group")
        ).first()
        if not n or groups < 2:
            break
        again = cut_lineage(_pack(pool, n, capacity, group_size, salt))
        if again.filter("offset = 0").count() >= bins:
            break
        placed.append(_numbered(current.filter(~loose), base))
        current, base = again, base + dealt
    placed.append(_numbered(current, base))
    own = full.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (-F.col("uid") - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("fill"), F.lit(True).alias("certified"),
    )
    for part in placed:
        own = own.unionByName(part)
    return own


def _numbered(packed: DataFrame, base: int) -> DataFrame:
    """Sequences numbered by group (43 bits), after the ``base`` groups of the turns before, and bin (20 bits)."""
    number = F.shiftleft(F.col("group").cast("long") + F.lit(base), 20).bitwiseOR(F.col("bin"))
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", number.alias("sequence_id"), "offset", "fill",
        (F.col("gap") == 0).alias("certified"),
    )
