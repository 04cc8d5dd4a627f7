"""Embedding near-dedup by NN-descent: links between vectors whose cosine reaches a threshold.

* Equal vectors of a label are one node with a count.
* First lists: a few random-hyperplane trees cut each label into leaves of bounded size; every node
  takes the nearest nodes of its leaves as neighbours.
* Refinement: neighbours of a node, forward and backward, are compared with each other, and every
  one keeps the best it meets. Hubs are cut into chunks that change from round to round.
* Audit: one node in AUDIT is compared with all others, in blocks, whatever the size of the table. Of each of these queries that has links, the share that its component holds is measured; the
  recall is their mean, so a query in a large group weighs no more than one of a pair. While it is
  too low, another round with new trees follows. Links that an audit finds missing are added.
* Saturated lists: where a node's whole list reaches the threshold, it may have more links than the
  list holds. So links are not read off the lists: every leaf and every chunk around a node gives out
  a spanning forest of all its pairs that reach the threshold. The members of each component over
  these links are then compared in pairs of blocks inside tasks, so no list of that length is written.

Links are only counted and never listed: what leaves a task are counts and spanning forests.
"""

from __future__ import annotations

from functools import cache
from itertools import groupby, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import cut_lineage
from .common import mapped, parts_of
from .graph import components
from .jaccard_join import forest, in_block_pairs

THRESHOLD = 0.98
LIST = 8
LEAF = 256
TREES = 6
LEVELS = 40
CHUNK = 48
#: One node in so many is audited; so many are sent to the tasks at a time.
AUDIT = 50
AUDITED = 4096
RECALL = 0.97
#: Refinement goes on while more than this share of the list entries that reach the threshold are new.
CHANGED = 0.01


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Unit rows in double precision."""
    return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, unit) of all rows: unit is the vector over its length, as bytes of doubles.

    It is null where a row links with nothing: vectors that are null, empty or zero or hold null or
    non-finite components, and rows without a label.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )

    def unit(stream):
        for id_, label, vector in stream:
            usable = label is not None and vector and not any(x is None for x in vector)
            v = np.array(vector if usable else [0.0], dtype=np.float64)
            top = np.abs(v).max()
            if not np.isfinite(top) or top == 0:
                yield id_, None, None
                continue
            v = v / top  # so that neither tiny nor huge components lose their length
            # Vectors of another dimension are of another kind, like those of another label.
            yield id_, f"{len(v)}:{label}", (v / np.sqrt(v @ v)).tobytes()

    return mapped(rows, "id long, label string, unit binary", unit)


@cache
def _normals(dimension: int, trees: range) -> np.ndarray:
    """Random normals of the hyperplanes of some trees, side by side."""
    return np.concatenate(
        [np.random.default_rng([tree, dimension]).normal(size=(dimension, LEVELS)) for tree in trees], axis=1
    )


def _leaves(nodes: DataFrame, sizes: DataFrame, trees: range, salt: int) -> DataFrame:
    """(label, tree, leaf, chunk, node, unit): crowded leaves are cut into chunks of about LEAF rows."""
    rows = nodes.join(sizes, "label").select("label", "n", "node", "unit")

    def deal(stream):
        for label, n, node, unit in stream:
            v = np.frombuffer(unit, dtype=np.float64)[None, :]
            levels = max(0, min(LEVELS, int(np.ceil(np.log2(max(n, 1) / (LEAF // 2))))))
            sides = (v @ _normals(v.shape[1], trees) > 0).reshape(len(trees), LEVELS)[:, :levels]
            codes = sides @ (1 << np.arange(levels, dtype=np.int64))
            for tree, code in zip(trees, codes.tolist(), strict=True):
                yield label, tree, code, node, unit

    dealt = mapped(rows, "label string, tree int, leaf long, node long, unit binary", deal)
    crowds = dealt.groupBy("label", "tree", "leaf").agg(F.count(F.lit(1)).alias("m"))
    chunk = F.pmod(F.xxhash64("node", "tree", F.lit(salt)), F.ceil(F.col("m") / LEAF))
    return dealt.join(crowds, ["label", "tree", "leaf"]).withColumn("chunk", chunk)


def _best(found: DataFrame) -> DataFrame:
    """The LIST nearest neighbours of each node; Spark limits them before they are exchanged, so hubs do no harm."""
    once = found.groupBy("node", "near").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "near"))
    return once.withColumn("place", place).filter(F.col("place") <= LIST).drop("place")


def _nearest(nodes: list[int], unit: np.ndarray, threshold: float):
    """Each node's best LIST of a group, near ties by number, and a spanning forest of all its links, as rows.

    The last column is 1 for rows of the forest, which hold the first node of a component as near.
    """
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -2)
    linked = cosines >= threshold - 1e-9
    if linked.any():
        for i, root in enumerate(forest(linked).tolist()):
            if root != i:
                yield nodes[i], nodes[root], float(cosines[i, root]), 1
    k = min(LIST, len(nodes) - 1)
    if k < 1:
        return
    picked = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    for i, near in enumerate(picked.tolist()):
        for j in near:
            yield nodes[i], nodes[j], float(cosines[i, j]), 0


def near_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
               threshold: float = THRESHOLD, rounds: int = 1, most_rounds: int = 6) -> tuple[DataFrame, float]:
    """(one row per input row, audited recall): id, n_links, component_id, kept.

    The recall can stay below RECALL after ``most_rounds``; the caller has to look at it. ``rounds``
    is the least number of refinements; they go on while lists change, see CHANGED.

    ``n_links`` counts the other rows of the same label with a cosine of at least ``threshold``, copies
    included; ``component_id`` is the smallest id reachable over links. Rows that cannot link, see
    :func:`nodes_of`, have none and are their own component; a null id gives way to others and keeps
    a null component where it is alone. Rows repeated with their id are copies of each other. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = parts_of(spark)
    rows = cut_lineage(nodes_of(vectors, id_col, vector_col, label_col))
    copies = rows.filter("unit is not null").groupBy("label", "unit").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"))
    # A node's number is a hash of what it is; two that share one would only be compared less.
    nodes = cut_lineage(copies.withColumn("node", F.xxhash64("label", "unit")).dropDuplicates(["node"]))
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    units = nodes.select("node", "unit", "label")

    def leaf_lists(stream):
        for _, members in groupby(stream, key=lambda row: row[:4]):
            members = list(members)
            yield from _nearest([row[4] for row in members], _matrix([row[5] for row in members]), threshold)

    def local_join(stream):
        for _, members in groupby(stream, key=lambda row: row[:2]):
            members = {row[2]: row[3] for row in members}
            if len(members) > 1:
                yield from _nearest(list(members), _matrix(list(members.values())), threshold)

    def start(turn: int) -> DataFrame:
        leaves = _leaves(units, sizes, range(turn * TREES, (turn + 1) * TREES), turn)
        dealt = leaves.select("label", "tree", "leaf", "chunk", "node", "unit").repartition(parts, "label", "tree", "leaf", "chunk")
        return mapped(
            dealt.sortWithinPartitions("label", "tree", "leaf", "chunk"), "node long, near long, cosine double, link int", leaf_lists, 65536
        )

    def refine(lists: DataFrame, turn: int) -> DataFrame:
        both = lists.select(F.col("near").alias("pivot"), "node").unionByName(
            lists.select(F.col("node").alias("pivot"), F.col("near").alias("node"))
        ).unionByName(lists.select(F.col("node").alias("pivot"), "node")).distinct()
        degree = both.groupBy("pivot").agg(F.count(F.lit(1)).alias("d"))
        chunk = F.pmod(F.xxhash64("node", "pivot", F.lit(turn)), F.ceil(F.col("d") / CHUNK))
        around = both.join(degree, "pivot").withColumn("chunk", chunk).join(units.drop("label"), "node")
        met = around.select("pivot", "chunk", "node", "unit").repartition(parts, "pivot", "chunk")
        return mapped(met.sortWithinPartitions("pivot", "chunk"), "node long, near long, cosine double, link int", local_join, 65536)

    def audited(links: DataFrame) -> tuple[float, DataFrame]:
        """(mean share of the queries' true links inside their component, all links with the ones found missing)."""
        ends = components(links.select(F.col("node").alias("a"), F.col("near").alias("b"))).withColumnRenamed("id", "node")
        placed = units.join(ends, "node", "left").select("node", "unit", "label", F.coalesce("component", "node").alias("c"))
        placed = cut_lineage(placed)
        queries = placed.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(AUDIT)) == 0)
        groups = max(1, -(-n_nodes // AUDIT // AUDITED))
        total, held, missed = 0, 0.0, links
        for group in range(groups):
            asked = queries.filter(F.pmod(F.xxhash64("node", F.lit(6)), F.lit(groups)) == group).collect()
            by_label: dict[str, list] = {}
            for row in asked:
                by_label.setdefault(row.label, []).append(row)
            shared = spark.sparkContext.broadcast({
                label: (np.array([q.node for q in own]), np.array([q.c for q in own]), _matrix([bytes(q.unit) for q in own]))
                for label, own in by_label.items()
            })

            def compare(stream, shared=shared):
                """Each query's links and those inside its component; components that links join, as a forest."""
                counts: dict[int, list[int]] = {}
                parent: dict[int, int] = {}

                def find(x):
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for label, members in groupby(stream, key=lambda row: row[2]):
                    if label not in shared.value:
                        continue
                    asked, own, wanted = shared.value[label]
                    while block := list(islice(members, 1024)):
                        keys, ends = np.array([row[0] for row in block]), np.array([row[3] for row in block])
                        near = (wanted @ _matrix([row[1] for row in block]).T >= threshold) & (asked[:, None] != keys)
                        inside = own[:, None] == ends
                        for i in np.flatnonzero(near.any(axis=1)).tolist():
                            seen = counts.setdefault(int(asked[i]), [0, 0])
                            seen[0] += int(near[i].sum())
                            seen[1] += int((near[i] & inside[i]).sum())
                        i, j = np.nonzero(near & ~inside)
                        for a, b in np.unique(np.stack([own[i], ends[j]], axis=1), axis=0).tolist():
                            x, y = find(a), find(b)
                            if x != y:
                                parent[y] = x
                                yield None, None, None, a, b
                for query, (n, same) in counts.items():
                    yield query, n, same, None, None

            met = cut_lineage(mapped(placed, "query long, n long, held long, node long, near long", compare, 65536))
            each = met.filter("query is not null").groupBy("query").agg((F.sum("held") / F.sum("n")).alias("share"))
            n, share = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
            total, held = total + n, held + share
            missed = missed.unionByName(met.filter("node is not null").select("node", "near"))
            shared.unpersist()
        return (held / total if total else 1.0), missed

    n_nodes = nodes.count()
    # Links of any round stay, whatever the lists go on to hold.
    lists = links = None
    recall = 0.0
    for turn in range(most_rounds):
        found = start(turn)
        step = 0
        while True:
            found = cut_lineage(found)
            near = found.filter("link = 1").select("node", "near")
            links = near if links is None else links.unionByName(near)
            met, before = found.filter("link = 0").drop("link"), lists
            lists = cut_lineage(_best(met if lists is None else met.unionByName(lists)))
            if step >= max(rounds, 1):
                close = lists.filter(F.col("cosine") >= threshold - 1e-9)
                if close.join(before, ["node", "near"], "left_anti").count() <= CHANGED * close.count():
                    break
            found = refine(lists, turn << 16 | step)
            step += 1
        recall, links = audited(links)
        if recall >= RECALL:
            break
    linked = cut_lineage(components(links.select(F.col("node").alias("a"), F.col("near").alias("b"))))
    groups = linked.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = linked.join(groups, "component").join(nodes, F.col("id") == F.col("node")).select(
        "component", "n", "node", "unit", "copies"
    )
    paired = in_block_pairs(members, "component", F.col("n"), "node").select(
        "component", "low", "high", "side", "node", "copies", "unit"
    )

    def count(stream):
        for _, members in groupby(stream, key=lambda row: row[:3]):
            members = list(members)
            keys, weights = [row[4] for row in members], np.array([row[5] for row in members], dtype=np.int64)
            unit, split = _matrix([row[6] for row in members]), sum(row[3] == 0 for row in members)
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            if split < len(keys):
                near[:split, :split] = False
                near[split:, split:] = False
            counts = near @ weights
            for i, root in enumerate(forest(near).tolist()):
                if counts[i]:
                    yield keys[i], int(counts[i]), keys[root]

    counted = cut_lineage(mapped(
        paired.repartition(parts, "component", "low", "high").sortWithinPartitions("component", "low", "high", "side"),
        "node long, links long, root long", count, 65536,
    ))
    links_of = counted.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(counted.select(F.col("root").alias("a"), F.col("node").alias("b")))
    least = classes.join(nodes, F.col("id") == F.col("node")).groupBy("component").agg(F.min("least_id").alias("component_id"))
    joined = classes.join(least, "component").select(F.col("id").alias("node"), "component_id").join(links_of, "node")
    answers = nodes.join(joined, "node", "left").select(
        "label", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id"),
    ).filter("n_links > 0")
    own = answers.select(F.col("label").alias("own_label"), F.col("unit").alias("own_unit"), "n_links", "component_id")
    same = (F.col("label") == F.col("own_label")) & (F.col("unit") == F.col("own_unit"))
    result = rows.join(own, same, "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return result.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), recall
