"""Exact dedup: Patricia tries own the texts of a partition.

Texts are dealt to partitions by the length and a hash of their normalised bytes. Each partition
inserts the full byte strings into a compressed radix trie; the terminal node of a string keeps the
best copy seen (most code points in the original, then smallest id) and how many there were. Since
whole strings are compared edge by edge, hashes only deal rows out and never decide equality.

Copies meet twice: every map task first inserts its own rows into a local trie and sends each
distinct text once, so a group that holds a third of all rows reaches its owner as one row per task.

A trie that outgrows its memory spills by subtree: from then on, rows are written to one file per
branch of the root edge (by the first bytes where strings part), the tries built so far with them,
and the branches are finished one after the other. The files belong to the task and vanish with it,
as Spark's own spill does; a lost task starts anew from its input.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, parts_of, whole_text

#: Bytes of edge labels that a task's trie may hold before it spills.
TRIE_BYTES = 64 << 20
#: Files of a spill besides those of the next byte.
ENDED, OTHER = -1, -2


class Node:
    __slots__ = ("label", "children", "best")

    def __init__(self, label: bytes, best=None):
        self.label, self.children, self.best = label, {}, best


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


def better(a: tuple, b: tuple) -> tuple:
    """The sum of two terminals (code points, id, count): the copy that stays, and all counted.

    More code points win, then the smaller id; a row without an id stays only where no other has one.
    """
    first = min(a, b, key=lambda t: (-t[0], t[1] is None, t[1] or 0))
    return (first[0], first[1], a[2] + b[2])


class PatriciaTrie:
    """A compressed radix trie over byte strings with a terminal (code points, id, count) each."""

    def __init__(self):
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, terminal: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], terminal)
                self.bytes += len(key) - at + 200
                return
            n = _common(child.label, key, at)
            if n < len(child.label):  # the edge parts here
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = child = upper
                self.bytes += 200
            node, at = child, at + n
        node.best = terminal if node.best is None else better(node.best, terminal)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            here = prefix + node.label
            if node.best is not None:
                yield here, node.best
            stack.extend((child, here) for child in node.children.values())


def own(pairs: Iterator[tuple[bytes, tuple]], limit: int = TRIE_BYTES, depth: int = 0) -> Iterator[tuple[bytes, tuple]]:
    """Each distinct key once with the sum of its terminals, in bounded memory.

    Past ``limit`` bytes the trie's contents and all further rows go to files, one per branch below
    the prefix that all its keys share, and every file is owned in turn from there on. Rows that
    leave the shared prefix earlier go to a file of their own.
    """
    trie = PatriciaTrie()
    for key, terminal in pairs:
        trie.insert(key, terminal)
        if trie.bytes > limit:
            break
    else:
        yield from trie.items()
        return
    shared = b""
    if trie.root.best is None and len(trie.root.children) == 1:
        shared = next(iter(trie.root.children.values())).label[depth:]
    end = depth + len(shared)
    files: dict[int, object] = {}

    def spill(key: bytes, terminal: tuple) -> None:
        branch = OTHER if key[depth:end] != shared else key[end] if end < len(key) else ENDED
        if branch not in files:
            files[branch] = tempfile.TemporaryFile()  # noqa: SIM115 - closed below
        pickle.dump((key, terminal), files[branch])

    for key, terminal in trie.items():
        spill(key, terminal)
    del trie
    for key, terminal in pairs:
        spill(key, terminal)

    def read(file) -> Iterator[tuple[bytes, tuple]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return

    for branch, file in files.items():
        with file:
            if branch == ENDED:  # keys that end here are all the same
                rows = read(file)
                key, terminal = next(rows)
                for _, other in rows:
                    terminal = better(terminal, other)
                yield key, terminal
            else:
                yield from own(read(file), limit, depth if branch == OTHER else end + 1)


def normalised(text_col: str):
    """Fixed by the contract: the text without tab, line feed, vertical tab, form feed, return and space."""
    return F.translate(whole_text(text_col), " \t\n\x0b\x0c\r", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size.

    Null texts count as empty, and all empty texts are one group. Among equal texts the row with the
    most code points in its original text stays, then the one with the smallest id; a null id stays
    only where its group has no other. Repeated rows count each.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        normalised(text_col).cast("binary").alias("body"),
        F.length(whole_text(text_col)).cast("long").alias("points"),
    )

    def local(stream: Iterator[tuple]) -> Iterator[tuple]:
        for body, (points, id_, count) in own(((b, (p, i, 1)) for i, b, p in stream), trie_bytes):
            yield body, points, id_, count

    def owners(stream: Iterator[tuple]) -> Iterator[tuple]:
        from hashlib import sha256

        pairs = ((body, (points, id_, count)) for body, points, id_, count in stream)
        for body, (_, id_, count) in own(pairs, trie_bytes):
            yield sha256(body).hexdigest(), id_, count

    distinct = mapped(rows, "body binary, points long, id long, n long", local)
    dealt = distinct.repartition(parts_of(docs.sparkSession), F.length("body"), F.xxhash64("body"))
    return mapped(dealt, "text_sha256 string, keep_id long, group_size long", owners)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    See :func:`exact_groups` for nulls and ties. ``kept`` marks rows whose id is the group's keep_id,
    so of rows repeated with their id each is marked. An empty table gives an empty result.
    """
    groups = exact_groups(docs, id_col, text_col)
    members = docs.select(
        F.col(id_col).cast("long").alias("id"), F.sha2(normalised(text_col), 256).alias("text_sha256")
    )
    return members.join(groups, "text_sha256").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
