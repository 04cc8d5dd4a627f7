"""Fill-in-the-middle transformation: texts cut at two units and put in another order between marks.

A unit is a run of ASCII letters or any other single code point. Both cuts are drawn as numbers of
units from a hash of the document's id, so every run and every retry cuts alike.

A text is read as UTF-8 in blocks of fixed size. A Fenwick tree over the blocks keeps how many units
and how many code points start in each; the block of a cut is found by one binary-lifting descent,
and only that block is looked at again to find the cut's byte. Memory beside the text itself is two
numbers a block and the masks of one slab of blocks, so the text is never split into its units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, whole_text

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block, and blocks whose counts are taken together.
BLOCK = 4096
SLAB = 256
#: Shares, in percent, of documents that are transformed, and of these in which the suffix comes first.
TRANSFORMED = 90
SUFFIX_FIRST = 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Fenwick:
    """Counts of two kinds over places 0 to n-1: prefix sums of both, found by a sum of the first kind."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.size = len(first)
        self.trees = []
        for counts in (first, second):
            # A node holds the sum of the last (i & -i) places; running sums give all nodes at once.
            upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            at = np.arange(self.size + 1)
            self.trees.append((upto - upto[at - (at & -at)]).tolist())

    def descend(self, wanted: int) -> tuple[int, int, int]:
        """(place, sums of both kinds before it) of the place in which the first kind's sum passes ``wanted``.

        The place is n if the whole sum does not pass it.
        """
        at = first = second = 0
        step = 1 << self.size.bit_length()
        while step:
            if at + step <= self.size and first + self.trees[0][at + step] <= wanted:
                at += step
                first += self.trees[0][at]
                second += self.trees[1][at]
            step >>= 1
        return at, first, second


def _starts(text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of ``text[low:high]`` start a unit, and which a code point."""
    part = text[low:high]
    points = (part & 0xC0) != 0x80
    letters = _LETTER[text[max(low - 1, 0) : high]]
    if low == 0:
        letters = np.concatenate(([False], letters))
    return points & ~(letters[1:] & letters[:-1]), points


class Units:
    """Places of units in one UTF-8 text."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.text = np.frombuffer(text, np.uint8)
        self.block = block
        units, points = [], []
        for low in range(0, len(self.text), block * SLAB):
            for kind, starts in zip((units, points), _starts(self.text, low, low + block * SLAB)):
                kind.append(np.add.reduceat(starts, np.arange(0, len(starts), block), dtype=np.int64))
        none = np.zeros(0, np.int64)
        units, points = np.concatenate([none, *units]), np.concatenate([none, *points])
        self.n_units, self.n_points = int(units.sum()), int(points.sum())
        self.tree = Fenwick(units, points)

    def cut_after(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the text's first ``units`` units."""
        if units >= self.n_units:
            return len(self.text), self.n_points
        place, before, points_before = self.tree.descend(units)
        low = place * self.block
        starts, points = _starts(self.text, low, low + self.block)
        inside = int(np.flatnonzero(starts)[units - before])
        return low + inside, points_before + int(points[:inside].sum())


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: bytes, draw: tuple[int, int, int, int], block: int = BLOCK) -> tuple:
    """(n, form, output, prefix_chars, middle_chars) of one text; the last two are None for a plain one."""
    units = Units(text, block)
    n = units.n_units
    marked = any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or draw[2] % 100 >= TRANSFORMED:
        return n, "plain", text, None, None
    (low, low_points), (high, high_points) = (units.cut_after(k) for k in sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if draw[3] % 100 < SUFFIX_FIRST:
        return n, "spm", b"".join((s, suffix, p, prefix, m, middle)), low_points, high_points - low_points
    return n, "psm", b"".join((p, prefix, s, suffix, m, middle)), low_points, high_points - low_points


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row per input row: id, n (units), form (plain, psm or spm), output, prefix_chars, middle_chars.

    A text stays plain if it is null or empty, if it holds a mark already (its output could not be taken
    apart), or if it is among those that are not transformed. Rows with equal ids are cut by equal
    draws, each by its own text; a null id draws as an empty one. An empty table gives an empty
    result. Other columns are ignored. Each row is worked on by itself: nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).cast("binary").alias("body"))

    def cut(stream: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, body in stream:
            yield doc_id, *transform(body, draws(doc_id, seed))

    return mapped(rows, "id long, n long, form string, output string, prefix_chars long, middle_chars long", cut)


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from.

    No text with a mark of its own is transformed, and no mark can arise where two parts meet, so the
    marks of an output are exactly the three that were set.
    """
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )
