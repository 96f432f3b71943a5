"""Most similar vectors for every vector (problem 3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.cells import KEY_FIELD, CellSearch, _rotations, _unit_rows, _words, by_key, rows_at_once, unpacked
from sightline.session import Scratch

# queries that go out at once, and standard errors of a scan's bound
QUERY_BLOCK, SCAN_EPS = 2048, 3.0


def _nearest(dim: int, floors: dict[int, float], k: int) -> Callable:
    """``(field, a, b, cosine)``: the ``k`` best partners of each visitor of a cell, by exact cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for key, parts in by_key(batches):
            ids = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts])
            v = unpacked(parts, 2, dim)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            if len(ids) < 2:
                continue
            field = key // KEY_FIELD
            step = rows_at_once(len(ids))
            for lo in range(0, len(ids), step):
                s = v[lo:lo + step] @ v.T
                s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
                least = np.full(len(s), floors[field], np.float32)
                if len(ids) > k:
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - np.float32(1e-6))
                i, j = np.nonzero(s >= least[:, None])
                c = s[i, j]
                best = np.lexsort((j, -c, i))
                i, j, c = i[best], j[best], c[best]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, c = i[rank < k], j[rank < k], c[rank < k]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), field, np.int32)), pa.array(ids[lo + i]), pa.array(ids[j]), pa.array(c.astype(np.float64))],
                        names=["field", "a", "b", "cosine"],
                    )

    return run


def most_similar(entries: DataFrame, entry_id: str, fields: dict[str, float], k: int = 5, dim: int = 128) -> DataFrame:
    """``(field, entry, neighbour, cosine)``: up to ``k`` most similar others of each entry.

    ``fields`` maps a vector column to the least cosine of interest.  A vector is
    usable if it has ``dim`` finite values that are not all zero; its length does
    not matter; others (null, short, NaN) take part in nothing.  Ties go to the
    smaller entry id.  Copies of one vector are compared once and expanded at
    the end to the smallest ids, which is all a top-k can hold.  An empty table
    gives no rows.
    """
    search = CellSearch(entries, entry_id, fields, dim)
    scratch = search.scratch
    visits = search.visits(k)
    near = scratch.write(search.compared(visits, _nearest(dim, search.floors, k), "field int, a long, b long, cosine double"), "near")

    usable = search.usable()
    copies = usable.groupBy("field", "h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = scratch.write(usable.join(copies.select("field", "h", "rep"), ["field", "h"]).select("field", "rep", "id"), "copies")
    first = Window.partitionBy("field", "rep").orderBy("id")
    small = members.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).select("field", "rep", "id")

    best = Window.partitionBy("field", "a").orderBy(F.desc("cosine"), "b")
    # neighbours of distinct vectors: once per pair, then with the copies of the neighbour
    once = near.groupBy("field", "a", "b").agg(F.max("cosine").alias("cosine"))
    once = once.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")
    alike = small.select("field", F.col("rep").alias("b"), F.col("id").alias("c"))
    spread = once.join(alike, ["field", "b"], "left").select("field", "a", F.coalesce("c", "b").alias("b"), "cosine")
    top = spread.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")

    # every copy has the other copies at cosine 1, then its vector's neighbours
    groups = members.select("field", F.col("rep").alias("a"), F.col("id").alias("x"))
    own = small.select("field", F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    mine = groups.join(own.union(top), ["field", "a"]).where("x <> b").select("field", F.col("x").alias("a"), "b", "cosine")
    mine = mine.groupBy("field", "a", "b").agg(F.max("cosine").alias("cosine"))
    mine = mine.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")
    singles = top.join(groups.select("field", F.col("x").alias("a")), ["field", "a"], "left_anti")
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return singles.unionByName(mine).select(name.alias("field"), F.col("a").alias("entry"), F.col("b").alias("neighbour"), "cosine")


def _code(v, turn):
    """Packed signs of rotated unit vectors and the scalar that corrects an estimate: ``(bits, alpha)``."""
    import numpy as np

    c = v @ turn
    return np.packbits(c > 0, axis=1), (np.abs(c).sum(1) / v.shape[1] ** 0.5).astype(np.float32)


# levels of a query's value and, for each, a plane of bits
PLANES = 4
# pairs of a query and a code that are estimated at once
SCANNED = 1_000_000


def _scan(dim: int, qids: list, qvecs: bytes, k: int, eps: float) -> Callable:
    """``(q, id, cosine)``: of each Arrow batch, the ``k`` best for every query, chosen by the codes' bounds.

    A query is rotated and rounded to ``PLANES`` bits a value; its product with a
    code is the sum of the popcounts of the code with each plane.  Divided by
    the code's ``alpha`` it estimates the cosine; the bound is ``eps`` standard
    errors.  A vector is reranked exactly if its upper bound reaches the k-th
    best lower bound of the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        turn = _rotations(dim, 1)
        ids, q = np.asarray(qids, np.int64), np.frombuffer(qvecs, "<f4").reshape(-1, dim)
        rotated = q @ turn
        low = rotated.min(1, keepdims=True)
        step = np.maximum(rotated.max(1, keepdims=True) - low, 1e-9) / (2**PLANES - 1)
        level = np.rint((rotated - low) / step).astype(np.uint8)
        planes = [_words(np.packbits(level >> b & 1, axis=1)) for b in range(PLANES)]
        total = rotated.sum(1)
        for batch in batches:
            at, v = _unit_rows(batch.column(1), dim)
            if not len(at):
                continue
            mine = batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            bits, alpha = _code(v, turn)
            words = _words(bits)
            ones = sum(np.bitwise_count(w).astype(np.float32) for w in words)
            slack = eps * np.sqrt(np.maximum(1 - alpha**2, 0)) / alpha / (dim - 1) ** 0.5
            out = []
            some = max(1, SCANNED // len(v))
            for a in range(0, len(q), some):
                part = slice(a, min(a + some, len(q)))
                met = np.zeros((part.stop - a, len(v)), np.float32)
                for b, plane in enumerate(planes):
                    for x, w in zip(plane, words):
                        met += np.bitwise_count(x[part, None] & w[None, :]) * np.float32(1 << b)
                # the code is +1 or -1 over root(dim): twice the sum over its ones, less the sum over all
                inner = (2 * (step[part] * met + low[part] * ones[None, :]) - total[part, None]) / dim**0.5
                e = inner / alpha[None, :]
                e[ids[part, None] == mine[None, :]] = -9
                least = np.full(len(e), -2, np.float32)
                if len(v) > k:
                    least = np.partition(e - slack[None, :], -k, axis=1)[:, -k]
                i, j = np.nonzero((e + slack[None, :] >= least[:, None]) & (e > -9))
                c = np.einsum("ij,ij->i", q[a + i], v[j], dtype=np.float64)
                best = np.lexsort((mine[j], -np.round(c, 6), i))
                i, j, c = i[best], j[best], c[best]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                out.append((ids[a + i[rank < k]], mine[j[rank < k]], c[rank < k]))
            q_, j_, c_ = (np.concatenate(x) for x in zip(*out))
            if len(q_):
                yield pa.RecordBatch.from_arrays([pa.array(q_), pa.array(j_), pa.array(c_)], names=["q", "id", "cosine"])

    return run


def nearest_to(queries: DataFrame, entries: DataFrame, entry_id: str, column: str, k: int = 5, dim: int = 128, eps: float = SCAN_EPS) -> DataFrame:
    """``(entry, neighbour, cosine)``: the ``k`` most similar others of each query, whatever their cosine.

    ``queries`` and ``entries`` have ``entry_id`` and ``column``; a query is not its own
    neighbour.  The stated query set goes out in blocks of ``QUERY_BLOCK``
    vectors, every entry is coded and streams past, unshuffled; each Arrow batch
    passes on ``k`` rows a query.  Unusable vectors take part in nothing; ties go
    to the smaller id; an empty table gives no rows.
    """
    import numpy as np

    spark, scratch = entries.sparkSession, Scratch(entries.sparkSession)
    pick = lambda df: df.select(F.col(entry_id).cast("bigint").alias("id"), F.col(column).cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    asked = scratch.write(pick(queries).dropDuplicates(["id"]), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows:
            at, v = _unit_rows(rows.column("vec"), dim)
            ids = rows.column("id").to_numpy()[at].tolist()
            near = pick(entries).mapInArrow(_scan(dim, ids, v.astype("<f4").tobytes(), k, eps), "q long, id long, cosine double")
            # written block by block: one block's vectors are held at a time
            found.append(scratch.write(near, "near"))
    if not found:
        return spark.createDataFrame([], "entry long, neighbour long, cosine double")
    once = reduce(DataFrame.union, found).groupBy("q", "id").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 6)), "id")
    return once.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).select(F.col("q").alias("entry"), F.col("id").alias("neighbour"), "cosine")


def similar_pairs(entries: DataFrame, entry_id: str, fields: dict[str, float], names: dict[str, str], k: int = 5, dim: int = 128) -> DataFrame:
    """``(field, entry_a, entry_b)``: pairs in which one is among the ``k`` most similar of the other."""
    found = most_similar(entries, entry_id, fields, k, dim)
    called = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return found.select(
        called[F.col("field")].alias("field"), F.least("entry", "neighbour").alias("entry_a"), F.greatest("entry", "neighbour").alias("entry_b")
    ).distinct()
