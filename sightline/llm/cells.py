"""Cells of rotated vectors: the shared ground of neighbour search and clustering.

A vector is made unit length and rotated at random several times.  Its cells are
the rotated coordinates that are strongest, with their sign: vectors of a small
angle share some of them.  Within a cell vectors are compared by one-bit codes
of the first rotation: the packed bits are compared by XOR and popcount, pairs
that this cannot rule out by their estimated inner product with correction
scalars.  Only entries with a partner that the error bound cannot rule out
"visit" the cell with their vector, and only there exact cosines are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import Scratch

# strongest rotated coordinates that a vector is filed under with one rotation, unless the caller asks for
# more, and how many more for every doubling of the rotations: that keeps the share of pairs that meet
CELLS_PER_VECTOR, CELLS_PER_DOUBLING = 8, 2
# rotations grow with the square root of the entries: a cell's entries grow no faster
ENTRIES_PER_SQUARED_ROTATION = 6000
# entries of a cell that one task compares; larger cells are cut into pairs of blocks
BLOCK = 16384
# cell loads are estimated on about this many entries (they only set the number of blocks)
LOAD_SAMPLE = 20_000
# values of a matrix that a worker holds at once
MATRIX_VALUES = 4_000_000
# error bounds are so many times the code's standard error
EPS = 2.5
# the finer code of a value that is normal: where it is cut, and what stands for the values above and below
CUT, LARGE, SMALL = 0.9816, 1.510, 0.4528
# pairs of packed codes that are compared at once: they stay in the processor's cache
CODES_AT_ONCE = 131_072
SEED = 20_24


def rows_at_once(width: int) -> int:
    """Rows of a matrix of ``width`` columns that are computed together: bounds a worker's memory."""
    return max(32, min(1024, MATRIX_VALUES // max(1, width)))


def rotations_for(entries: int) -> int:
    return max(1, round((entries / ENTRIES_PER_SQUARED_ROTATION) ** 0.5))


def cells_for(entries: int, least: int, dim: int) -> int:
    """Cells that a vector is filed under: more with the rotations, of which each has a smaller share."""
    return min(dim, least + round(CELLS_PER_DOUBLING * (rotations_for(entries) - 1).bit_length()))


def _rotations(dim: int, count: int):
    import numpy as np

    draw = np.random.default_rng([SEED, dim])
    return np.concatenate([np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(count)], 1).astype(np.float32)


def _unit_rows(column: pa.Array, dim: int):
    """Positions and unit vectors (float32) of the usable values of a list column."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(valid & (sizes == dim))
    values = column.values.to_numpy(zero_copy_only=False)  # null elements become NaN
    v = values[offsets[:-1][at][:, None] + np.arange(dim)].astype(np.float64)
    with np.errstate(all="ignore"):
        scale = np.abs(v).max(1, initial=0.0)
        good = np.isfinite(v).all(1) & (scale > 0)
        v = v[good] / scale[good][:, None]
    return at[good], (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _record(dim: int, filed: int, count: int):
    """Layout of a code record; cell numbers are as wide as ``count`` rotations need."""
    import numpy as np

    return np.dtype([
        ("id", "<i8"), ("h", "<i8"), ("sign", "u1", dim // 8), ("large", "u1", dim // 8),
        ("alpha", "<f2"), ("beta", "<f2"), ("block", "<u4"), ("cells", "<u2" if 2 * dim * count <= 65536 else "<u4", filed),
    ])


def _records(ids, hashes, v, turn, filed: int):
    """Code records of unit vectors; cells are numbered within the field, ascending."""
    import numpy as np

    dim = v.shape[1]
    take = min(filed, dim)
    cells, first = np.empty((len(v), take), np.int64), np.empty((len(v), dim), np.float32)
    step = rows_at_once(turn.shape[1])
    for lo in range(0, len(v), step):
        c = v[lo:lo + step] @ turn
        strong = np.argpartition(-np.abs(c), take - 1, axis=1)[:, :take]
        cells[lo:lo + step] = np.sort(strong * 2 + (np.take_along_axis(c, strong, 1) > 0), axis=1)
        first[lo:lo + step] = c[:, :dim]
    r = np.zeros(len(v), _record(dim, filed, turn.shape[1] // dim))
    sign, large = first > 0, np.abs(first) > CUT / dim**0.5
    r["id"], r["h"] = ids, hashes
    r["sign"], r["large"] = np.packbits(sign, axis=1), np.packbits(large, axis=1)
    r["alpha"] = np.abs(first).sum(1) / dim**0.5
    r["beta"] = (np.abs(first) * np.where(large, LARGE, SMALL)).sum(1) / dim**0.5
    r["cells"][:, :take] = cells
    if take < filed:
        r["cells"][:, take:] = cells[:, -1:]
    return r


def _cells_of(dim: int, count: int, filed: int) -> Callable:
    """``(field, id, cells)``: all cells of a vector, whether or not it meets another one there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        turn = _rotations(dim, count)
        for batch in batches:
            at, v = _unit_rows(batch.column(3), dim)
            if not len(at):
                continue
            none = np.zeros(len(at), np.int64)
            cells = _records(none, none, v, turn, filed)["cells"].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, filed, dtype=np.int32), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), lists], names=["field", "id", "cells"])

    return run


# a key: 4 bits of field, 27 of cell, 32 of the pair of blocks
KEY_FIELD, KEY_CELL = 1 << 59, 1 << 32
MOST_CELLS = 1 << 27


def _pair_key(a, b):
    """Number of an unordered pair of blocks, and back in ``_pair_of``."""
    import numpy as np

    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return hi * (hi + 1) // 2 + lo


def _pair_of(number: int) -> tuple[int, int]:
    from math import isqrt

    hi = (isqrt(8 * number + 1) - 1) // 2
    return number - hi * (hi + 1) // 2, hi


def _by_cell(key, r) -> pa.RecordBatch:
    """Rows ``(key, n, payload)`` from code records and their keys."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    key, out = key[order], np.ascontiguousarray(r[order])
    cut = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    ends = np.append(cut[1:], len(key))
    raw, size = out.view(np.uint8).reshape(-1), r.dtype.itemsize
    return pa.RecordBatch.from_arrays(
        [pa.array(key[cut]), pa.array((ends - cut).astype(np.int32)),
         pa.array([raw[a * size:b * size].tobytes() for a, b in zip(cut, ends)], pa.binary())],
        names=["key", "n", "payload"],
    )


def _file_cells(dim: int, count: int, filed: int) -> Callable:
    """Rows ``(key, n, payload)``: the code records of a batch, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        turn = _rotations(dim, count)
        for batch in batches:
            at, v = _unit_rows(batch.column(3), dim)
            if not len(at):
                continue
            field, ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False)[at].astype(np.int64) for i in range(3))
            # copies of a vector in the batch are one entry, its smallest id
            order = np.lexsort((ids, hashes, field))
            keep = np.ones(len(order), bool)
            keep[1:] = (hashes[order][1:] != hashes[order][:-1]) | (field[order][1:] != field[order][:-1])
            order = order[keep]
            r = _records(ids[order], hashes[order], v[order], turn, filed)
            distinct = np.ones((len(r), filed), bool)
            distinct[:, 1:] = r["cells"][:, 1:] != r["cells"][:, :-1]
            who, which = np.nonzero(distinct)
            yield _by_cell(field[order][who] * KEY_FIELD + r["cells"][who, which].astype(np.int64) * KEY_CELL, r[who])

    return run


def _cut_cells(dim: int, count: int, filed: int) -> Callable:
    """Rows ``(key, n, payload, blocks)`` of hot cells become rows of their pairs of blocks; others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kind = _record(dim, filed, count)
        for batch in batches:
            blocks = batch.column(3).fill_null(1).to_numpy(zero_copy_only=False)
            cold = np.flatnonzero(blocks <= 1)
            if len(cold):
                yield batch.select([0, 1, 2]).take(pa.array(cold))
            for i in np.flatnonzero(blocks > 1):
                r, n = np.frombuffer(batch.column(2)[int(i)].as_py(), kind).copy(), int(blocks[i])
                mine = (r["h"].astype(np.uint64) % np.uint64(n)).astype(np.int64)
                r["block"] = mine
                key = batch.column(0)[int(i)].as_py()
                for other in range(n):
                    yield _by_cell(key + _pair_key(mine, np.full(len(r), other)), r)

    return run


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Groups of a stream that is sorted by its first column, one at a time."""
    import numpy as np

    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys))
        for a, b in zip(cut[:-1], cut[1:]):
            if keys[a] != key and parts:
                yield key, parts
                parts = []
            key = int(keys[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, parts


def _words(bits):
    """Packed bits as columns of 64-bit words."""
    import numpy as np

    pad = -bits.shape[1] % 8
    whole = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad))) if pad else bits).view(np.uint64)
    return [np.ascontiguousarray(whole[:, i]) for i in range(whole.shape[1])]


def _near_codes(words: list, lo: int, hi: int, most: int):
    """Pairs ``(i, j)`` with ``lo <= i < hi``, sorted, whose codes differ in at most ``most`` bits."""
    import numpy as np

    n = len(words[0])
    bits, step = np.uint8 if len(words) <= 3 else np.uint16, max(1, CODES_AT_ONCE // n)
    rows, cols = [], []
    for a in range(lo, hi, step):
        b = min(a + step, hi)
        apart = np.zeros((b - a, n), bits)
        for w in words:
            apart += np.bitwise_count(w[a:b, None] ^ w[None, :])
        i, j = np.nonzero(apart <= most)
        rows.append(i + a)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def _bits_apart(cosine: float, dim: int, eps: float) -> int:
    """Differing bits of two codes of that cosine: the mean and ``eps`` deviations."""
    from math import acos, pi

    p = acos(max(-1.0, min(1.0, cosine))) / pi
    return int(dim * p + eps * (dim * p * (1 - p)) ** 0.5)


# bits that mark the cells of a record
MARKS = 1024


def _cell_marks(cells, cell: int):
    """Per record, as 64-bit words: the cells before ``cell`` that it is filed under, by number or its remainder."""
    import numpy as np

    marks = np.zeros((len(cells), MARKS), bool)
    who, which = np.nonzero(cells < cell)
    marks[who, cells[who, which] % MARKS] = True
    return np.packbits(marks, axis=1).view(np.uint64)


def _shared_before(cells, marks, cell: int, i, j):
    """Which pairs share a cell before ``cell``."""
    import numpy as np

    part = max(1, MATRIX_VALUES // marks.shape[1])
    shared = np.concatenate([(marks[i[a:a + part]] & marks[j[a:a + part]]).any(1) for a in range(0, len(i), part)])
    if cell > MARKS and shared.any():
        # numbers with one remainder may differ: these pairs are looked at cell by cell
        at = np.flatnonzero(shared)
        a, b = cells[i[at]], cells[j[at]]
        same = np.zeros(len(at), bool)
        for p in range(a.shape[1]):
            low = a[:, p] < cell
            if low.any():
                for q in range(b.shape[1]):
                    same |= low & (a[:, p] == b[:, q])
        shared[at] = same
    return shared


def _visiting(r, cell: int, crossed: bool, floor: float, k: int | None, dim: int, eps: float):
    """Which records of a cell have a partner that the bounds cannot rule out."""
    import numpy as np

    n = len(r)
    alpha, beta = r["alpha"].astype(np.float32), r["beta"].astype(np.float32)
    bound = eps * np.sqrt(np.maximum(1 - alpha**2, 0)) / alpha / (dim - 1) ** 0.5
    words, large, most = _words(r["sign"]), _words(r["large"]), _bits_apart(floor, dim, eps)
    wide = sum(np.bitwise_count(w).astype(np.float32) for w in large)
    marks = _cell_marks(r["cells"], cell)
    visits = np.zeros(n, bool)
    step = rows_at_once(n)
    for lo in range(0, n, step):
        i, j = _near_codes(words, lo, min(lo + step, n), most)
        go = i != j
        if crossed:
            go &= r["block"][i] != r["block"][j]
        i, j = i[go], j[go]
        upper, lower = np.empty(len(i), np.float32), np.empty(len(i), np.float32)
        part = MATRIX_VALUES // 16
        for a in range(0, len(i), part):
            x, y = i[a:a + part], j[a:a + part]
            # one-bit code against the finer code, both ways round: both estimate the inner product
            apart, x_wide, y_wide = (np.zeros(len(x), np.float32) for _ in range(3))
            for w, big in zip(words, large):
                differ = w[x] ^ w[y]
                apart += np.bitwise_count(differ)
                x_wide += np.bitwise_count(differ & big[x])
                y_wide += np.bitwise_count(differ & big[y])
            common = np.float32(SMALL) * (dim - 2 * apart)
            e = ((common + np.float32(LARGE - SMALL) * (wide[y] - 2 * y_wide)) / (alpha[x] * beta[y])
                 + (common + np.float32(LARGE - SMALL) * (wide[x] - 2 * x_wide)) / (alpha[y] * beta[x])) / (2 * dim)
            slack = np.maximum(bound[x], bound[y])
            upper[a:a + part], lower[a:a + part] = e + slack, e - slack
        go = upper >= floor
        if k is not None and go.any():
            i, j, upper, lower = i[go], j[go], upper[go], lower[go]
            # a query's partner must be able to reach the k-th best lower bound
            best = np.lexsort((-lower, i))
            first = np.searchsorted(i, np.arange(lo, min(lo + step, n) + 1))
            least = np.full(len(first) - 1, -2, np.float32)
            many = np.flatnonzero(np.diff(first) > k)
            least[many] = lower[best][first[many] + k - 1]
            go = upper >= least[i - lo]
        i, j = i[go], j[go]
        if not len(i):
            continue
        # a pair belongs to the first of the cells it shares
        first = ~_shared_before(r["cells"], marks, cell, i, j)
        visits[i[first]] = True
        visits[j[first]] = True
    return visits


def _visits(dim: int, floor: dict[int, float], k: int | None, filed: int, count: int, eps: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kind = _record(dim, filed, count)
        for key, parts in by_key(batches):
            r = np.frombuffer(b"".join(x for p in parts for x in p.column(2).to_pylist()), kind)
            order = np.lexsort((r["id"], r["h"]))
            r = r[order]
            r = r[np.diff(r["h"], prepend=r["h"][0] - 1) != 0]
            if len(r) < 2:
                continue
            one, other = _pair_of(key % KEY_CELL)
            go = _visiting(r, key % KEY_FIELD // KEY_CELL, one != other, floor[key // KEY_FIELD], k, dim, eps)
            n = int(go.sum())
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key // KEY_FIELD, np.int32)), pa.array(r["id"][go]), pa.array(np.full(n, key))],
                    names=["field", "id", "key"],
                )

    return run


def _packed(dim: int) -> Callable:
    """``(field, id, vec)``: unit vectors as 16-bit integers with a scale (error below 1e-5 in a cosine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            at, v = _unit_rows(batch.column(3), dim)
            if not len(at):
                continue
            scale = np.abs(v).max(1) / 32767
            raw = np.concatenate([np.rint(v / scale[:, None]).astype("<i2").view(np.uint8), scale.astype("<f4")[:, None].view(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([x.tobytes() for x in raw], pa.binary())],
                names=["field", "id", "vec"],
            )

    return run


def unpacked(parts: list[pa.RecordBatch], column: int, dim: int):
    import numpy as np

    raw = np.frombuffer(b"".join(x for p in parts for x in p.column(column).to_pylist()), np.uint8).reshape(-1, 2 * dim + 4)
    scale = raw[:, 2 * dim:].copy().view("<f4")
    v = raw[:, :2 * dim].copy().view("<i2").astype(np.float32) * scale
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class CellSearch:
    """Search over the usable vectors of ``fields`` (column name -> floor cosine)."""

    def __init__(self, entries: DataFrame, entry_id: str, fields: dict[str, float], dim: int, cells: int = CELLS_PER_VECTOR,
                 eps: float = EPS, scratch: Scratch | None = None):
        self.dim, self.fields, self.eps = dim, list(fields), eps
        self.floors = dict(enumerate(fields.values()))
        self.scratch = scratch or Scratch(entries.sparkSession)
        parts = [
            entries.select(F.lit(i).alias("field"), F.col(entry_id).cast("bigint").alias("id"),
                           F.xxhash64(c).alias("h"), F.col(c).cast("array<float>").alias("vec"))
            .where("id is not null and vec is not null")
            for i, c in enumerate(fields)
        ]
        self.vectors = parts[0]
        for p in parts[1:]:
            self.vectors = self.vectors.union(p)
        self.entries = entries.count()
        self.count, self.cells = rotations_for(self.entries), cells_for(self.entries, cells, dim)
        if 2 * dim * self.count > MOST_CELLS or len(fields) > 16:
            raise ValueError("more cells or fields than a key can hold")

    def usable(self) -> DataFrame:
        """``(field, id, h)`` of the usable vectors; equal ``h``: copies of one vector."""
        dim = self.dim
        nums = F.filter("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        good = (F.size("vec") == dim) & (F.size(nums) == dim) & F.exists("vec", lambda x: x != 0)
        return self.vectors.where(good).select("field", "id", "h")

    def visits(self, k: int | None) -> DataFrame:
        """``(field, id, key)``: distinct vectors (smallest id) and the cells they must be compared in."""
        file = _file_cells(self.dim, self.count, self.cells)
        schema = "key long, n int, payload binary"
        filed = self.vectors.mapInArrow(file, schema)
        if self.entries > BLOCK:
            share = max(1, self.entries // LOAD_SAMPLE)
            part = self.vectors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
            loads = part.mapInArrow(file, schema).groupBy("key").agg((F.sum("n") * share).alias("n")).where(F.col("n") > BLOCK)
            # how many blocks a hot cell is cut into: a table, as it grows with the entries
            hot = self.scratch.write(loads.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "hot")
            if not hot.isEmpty():
                filed = filed.join(hot, "key", "left").select("key", "n", "payload", "blocks").mapInArrow(_cut_cells(self.dim, self.count, self.cells), schema)
        found = filed.repartition("key").sortWithinPartitions("key").mapInArrow(
            _visits(self.dim, self.floors, k, self.cells, self.count, self.eps), "field int, id long, key long")
        return self.scratch.write(found, "visits")

    def filed(self) -> DataFrame:
        """``(field, id, cells)``: every usable vector with all cells that it is filed under."""
        found = self.vectors.mapInArrow(_cells_of(self.dim, self.count, self.cells), "field int, id long, cells array<int>")
        return found.withColumn("cells", F.array_distinct("cells"))

    def packed(self) -> DataFrame:
        return self.vectors.mapInArrow(_packed(self.dim), "field int, id long, vec binary")

    def compared(self, visits: DataFrame, work: Callable, schema: str) -> DataFrame:
        """Run ``work`` over the visitors of every cell: streams of ``(key, id, vec)`` sorted by key."""
        met = self.packed().join(visits, ["field", "id"]).select("key", "id", "vec")
        return met.repartition("key").sortWithinPartitions("key").mapInArrow(work, schema)
