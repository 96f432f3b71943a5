"""Clusters of mutually similar entries (problem 1).

Grid density clustering.  Unit vectors are quantised on randomly rotated axes:
an entry lies in the cells of its strongest signed coordinates (``cells``).
Cells in which entries meet that are similar enough are dense; they are adjacent
where they share such an entry, and the smallest entry id is propagated over
cells and entries to convergence.  What comes out is then held against the exact
definition, and each cluster is described by the members of its densest cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.cells import BLOCK, CellSearch, by_key, rows_at_once, unpacked
from sightline.session import Scratch


# cells of an entry (more with the rotations) and width of the error bounds: a link that no cell shows, inside a
# cluster or to an entry outside, would make a wrong cluster
CELLS, EPS = 12, 3.0


def _groups_of_cell(dim: int, floor: float) -> Callable:
    """``(key, id, first)``: the smallest id that an entry is connected to inside a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for key, parts in by_key(batches):
            ids = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts])
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], unpacked(parts, 2, dim)[order]
            n = len(ids)
            label, alone, step = np.arange(n), np.ones(n, bool), rows_at_once(n)
            while True:
                new = label.copy()
                for lo in range(0, n, step):
                    s = v[lo:lo + step] @ v.T >= floor
                    s[np.arange(len(s)), np.arange(lo, lo + len(s))] = False
                    alone[lo:lo + len(s)] = ~s.any(1)
                    least = np.where(s, label[None, :], n).min(1)
                    new[lo:lo + len(s)] = np.minimum(new[lo:lo + len(s)], least)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            if (~alone).any():
                m = int((~alone).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, key)), pa.array(ids[~alone]), pa.array(ids[label[~alone]])], names=["key", "id", "first"])

    return run


def _sums(dim: int) -> Callable:
    """``(label, pos, total, n)``: sums of the unit vectors of a label, per task, from ``(label, vec)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            labels, v = batch.column(0).to_numpy(zero_copy_only=False), unpacked([batch], 1, dim).astype(np.float64)
            order = np.argsort(labels, kind="stable")
            cut = np.flatnonzero(np.diff(labels[order], prepend=labels[order][0] - 1))
            total = np.add.reduceat(v[order], cut, axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(labels[order][cut], dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(cut))), pa.array(total.reshape(-1))],
                names=["label", "pos", "total"])

    return run


def _angles(dim: int) -> Callable:
    """``(label, id, angle)`` of members to their label's centre, from ``(label, id, vec, centre)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.array(batch.column(3).to_pylist(), np.float64)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            s = np.einsum("ij,ij->i", unpacked([batch], 2, dim).astype(np.float64), c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.arccos(np.clip(s, -1, 1)))], names=["label", "id", "angle"])

    return run


def _dissimilar(dim: int, floor: float) -> Callable:
    """``(label)``: labels with two members (of the two blocks of a tile) that are not similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for _, parts in by_key(batches):
            col = lambda i: np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts])  # noqa: B023,E731
            labels, blocks, v = col(1), col(2), unpacked(parts, 3, dim)
            order = np.lexsort((blocks, labels))
            labels, blocks, v = labels[order], blocks[order], v[order]
            bad = []
            cut = np.append(np.flatnonzero(np.diff(labels, prepend=labels[0] - 1)), len(labels))
            for a, b in zip(cut[:-1], cut[1:]):
                step = rows_at_once(b - a)
                if any((v[lo:min(lo + step, b)] @ v[a:b].T).min() < floor for lo in range(a, b, step)):
                    bad.append(labels[a])
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(bad, np.int64))], names=["label"])

    return run


def _rim(known: DataFrame, search: CellSearch, floor: float) -> DataFrame:
    """``(label, id, vectors)``: the members of large labels that have to be compared in pairs.

    Two members whose angles to the label's centre add up to no more than the
    angle of ``floor`` are similar for certain.  A member that passes so with
    the farthest one passes with all: only the others, the rim, are compared,
    and they only among themselves.  A centre costs one pass over the members.
    """
    scratch, dim = search.scratch, search.dim
    large = known.where(F.col("vectors") > BLOCK).select("label", F.col("rep").alias("id"))
    placed = scratch.write(search.packed().join(large, "id").select("label", "id", "vec"), "large")
    sums = placed.select("label", "vec").mapInArrow(_sums(dim), "label long, pos int, total double")
    per = sums.groupBy("label", "pos").agg(F.sum("total").alias("total"))
    centre = per.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"]).alias("centre"))
    angles = scratch.write(placed.join(centre, "label").select("label", "id", "vec", "centre").mapInArrow(_angles(dim), "label long, id long, angle double"), "angles")
    # a little less than the angle, for rounding
    enough = F.acos(F.lit(floor)) - 1e-4
    far = angles.groupBy("label").agg(F.max("angle").alias("most"))
    rim = scratch.write(angles.join(far, "label").where(F.col("angle") + F.col("most") > enough).select("label", "id"), "rim")
    return rim.join(rim.groupBy("label").agg(F.count("*").alias("vectors")), "label")


def _propagated(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest id over ``links(id, first)`` to convergence: ``(id, label)``."""
    pairs = links.distinct()
    both = pairs.select(F.col("id").alias("a"), F.col("first").alias("b")).union(pairs.select(F.col("first").alias("a"), F.col("id").alias("b")))
    both = scratch.write(both.distinct(), "links")
    label = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "label")
    while True:
        seen = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(seen, "a").select("a", "label", F.least("label", "near").alias("nxt"))
        # follow the label's own label: chains of cells halve instead of shrinking by one
        jump = label.select(F.col("a").alias("nxt"), F.col("label").alias("far"))
        step = scratch.write(step.join(jump, "nxt").select("a", "label", F.least("nxt", "far").alias("nxt")), "step")
        changed = not step.where("nxt <> label").isEmpty()
        scratch.drop(label)
        label = scratch.write(step.select("a", F.col("nxt").alias("label")), "label") if changed else step.select("a", "label")
        if not changed:
            return label.withColumnRenamed("a", "id")


def similar_clusters(entries: DataFrame, entry_id: str, column: str, floor: float, dim: int = 128) -> tuple[DataFrame, DataFrame]:
    """``members(cluster_id, entry_id)`` and ``filed(cluster_id, entry_id, cells)``.

    A cluster is three or more entries that are all similar to each other (cosine
    of usable vectors at least ``floor``) and to no entry outside; its id is its
    smallest entry id.  Copies of one vector are compared once and all belong to
    the cluster.  Unusable vectors (null, short, NaN, zero) are in none; an empty
    table gives no rows.  ``filed`` has every member, copies too, with all cells
    that its vector lies in.

    The final check compares the members of a label: all of them, or in a label
    of more than ``BLOCK`` distinct vectors those that lie too far from its
    centre for that to prove anything (``_rim``), in tiles of bounded size.
    """
    search = CellSearch(entries, entry_id, {column: floor}, dim, CELLS, EPS)
    scratch = search.scratch
    dense = scratch.write(search.compared(search.visits(None), _groups_of_cell(dim, floor), "key long, id long, first long"), "dense")
    label = _propagated(dense.select("id", "first"), scratch)

    usable = search.usable()
    reps = usable.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("h", "rep", "n", F.coalesce("label", "rep").alias("label"))
    sizes = reps.groupBy("label").agg(F.sum("n").alias("size"), F.count("*").alias("vectors")).where("size >= 3")
    known = scratch.write(reps.join(sizes, "label"), "known")

    pairs = known.where(F.col("vectors").between(2, BLOCK)).select("label", F.col("rep").alias("id"), "vectors")
    if not known.where(F.col("vectors") > BLOCK).isEmpty():
        pairs = pairs.unionByName(_rim(known, search, floor))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("vectors") / BLOCK).cast("int"))
    spread = (
        pairs.select("label", "id", F.pmod(F.xxhash64("id"), tiles).cast("int").alias("block"), tiles.alias("tiles"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("id", "label", "block", F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other")).alias("key"))
    )
    placed = search.packed().select("id", "vec").join(spread, "id").select("key", "label", "block", "vec")
    bad = placed.repartition("key").sortWithinPartitions("key").mapInArrow(_dissimilar(dim, floor), "label long").distinct()
    good = known.join(scratch.write(bad, "bad"), "label", "left_anti")
    members = usable.join(good.select("h", "label", "rep"), "h").select("label", "id", "rep")
    named = members.groupBy("label").agg(F.min("id").alias("cluster_id"))
    members = members.join(named, "label").select("cluster_id", F.col("id").alias("entry_id"), "rep")
    filed = members.join(search.filed().select(F.col("id").alias("rep"), "cells"), "rep")
    return members.drop("rep"), filed.drop("rep")


def described_clusters(entries: DataFrame, entry_id: str, column: str, floor: float, typical: int = 3, dim: int = 128) -> DataFrame:
    """``(cluster_id, size, rank, entry_id, density)``: the most typical members of each cluster.

    Density: members of the cluster in the fullest of the entry's cells, copies
    counted one by one; ties go to the smaller id.
    """
    _, filed = similar_clusters(entries, entry_id, column, floor, dim)
    filed = Scratch(entries.sparkSession).write(filed, "filed")
    inside = filed.select("cluster_id", "entry_id", F.explode("cells").alias("cell"))
    full = inside.groupBy("cluster_id", "cell").agg(F.count("*").alias("n"))
    density = inside.join(full, ["cluster_id", "cell"]).groupBy("cluster_id", "entry_id").agg(F.max("n").alias("density"))
    size = filed.groupBy("cluster_id").agg(F.count("*").alias("size"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("density"), "entry_id")
    return (
        density.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical)
        .join(size, "cluster_id").select("cluster_id", "size", "rank", "entry_id", "density")
    )
