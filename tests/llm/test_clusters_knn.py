import numpy as np
import pytest

from sightline.llm import cells, clusters, knn

SCHEMA = "entry_id long, dino array<float>, sscd array<float>, id long, key string, h string, vec string, label int, cells int"


def entries(spark, vectors, other=None):
    rows = [(i, v, (other or {}).get(i), -1, "k", "h", "v", 0, 1) for i, v in vectors.items()]
    return spark.createDataFrame(rows, SCHEMA)


def planted(rng, sizes, spread, dim=128):
    out, at = {}, 1
    for size in sizes:
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            e = rng.standard_normal(dim)
            v = c + spread * e / np.linalg.norm(e)
            out[at] = (v * rng.uniform(0.1, 9)).astype("float32").tolist()
            at += 1
    return out


def unit(vectors):
    ids = sorted(i for i, v in vectors.items() if usable(v))
    m = np.array([vectors[i] for i in ids], dtype="float64")
    return ids, m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(v):
    return v is not None and len(v) == 128 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_top(vectors, floor, k=5):
    ids, m = unit(vectors)
    s = np.round(m @ m.T, 6)
    found = set()
    for r, i in enumerate(ids):
        best = sorted((-s[r, c], j) for c, j in enumerate(ids) if j != i and s[r, c] >= floor)[:k]
        found |= {(min(i, j), max(i, j)) for _, j in best}
    return found


def brute_clusters(vectors, floor):
    ids, m = unit(vectors)
    s = m @ m.T >= floor
    found = set()
    for r in range(len(ids)):
        group = np.flatnonzero(s[r])
        if len(group) >= 3 and s[np.ix_(group, group)].all() and all((s[g] == s[r]).all() for g in group):
            found |= {(ids[group.min()], ids[g]) for g in group}
    return found


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    v = planted(rng, [2, 3, 4, 9, 40] + [1] * 60, 0.55)
    top = max(v)
    v[top + 1], v[top + 2], v[top + 3] = v[5], v[5], v[20]  # copies
    v[top + 4], v[top + 5], v[top + 6], v[top + 7] = None, [0.0] * 128, v[1][:48], [float("nan")] * 128
    v[top + 8] = [None] + v[1][1:]
    v[top + 9] = (np.array(v[5]) * 3).tolist()  # the same direction, another length
    return v


def test_clusters_equal_brute_force(spark, vectors):
    members, _ = clusters.similar_clusters(entries(spark, vectors), "entry_id", "dino", 0.65)
    got = [tuple(r) for r in members.select("cluster_id", "entry_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_clusters(vectors, 0.65)


def test_chain_is_no_cluster(spark):
    angle = np.deg2rad([0, 30, 60, 90])
    v = {i + 1: [float(np.cos(a)), float(np.sin(a))] + [0.0] * 126 for i, a in enumerate(angle)}
    members, _ = clusters.similar_clusters(entries(spark, v), "entry_id", "dino", 0.65)
    assert members.count() == 0


def test_three_copies_are_a_cluster(spark):
    v = {i: [1.0] + [0.5] * 127 for i in (4, 7, 9)}
    members, _ = clusters.similar_clusters(entries(spark, v), "entry_id", "dino", 0.65)
    assert {tuple(r) for r in members.collect()} == {(4, 4), (4, 7), (4, 9)}


def test_described_clusters(spark, vectors):
    rows = clusters.described_clusters(entries(spark, vectors), "entry_id", "dino", 0.65).collect()
    sizes = {}
    for c, _ in brute_clusters(vectors, 0.65):
        sizes[c] = sizes.get(c, 0) + 1
    assert {r["cluster_id"]: r["size"] for r in rows} == sizes
    assert all(r["rank"] <= 3 for r in rows)


def test_density_counts_all_members_of_a_cell(spark, vectors):
    v = vectors | {i: [1.0] + [0.5] * 127 for i in (904, 907, 909)}  # a cluster of copies only
    ids, m = unit(v)
    c = m.astype("float32") @ cells._rotations(128, 1)
    filed = {i: {(int(a), bool(r[a] > 0)) for a in np.argsort(-np.abs(r))[:clusters.CELLS]} for i, r in zip(ids, c)}
    groups = {}
    for cluster, i in brute_clusters(v, 0.65):
        groups.setdefault(cluster, []).append(i)
    want = set()
    for cluster, members in groups.items():
        density = {i: max(sum(cell in filed[j] for j in members) for cell in filed[i]) for i in members}
        best = sorted(members, key=lambda i: (-density[i], i))[:3]
        want |= {(cluster, rank, i, density[i]) for rank, i in enumerate(best, 1)}
    rows = clusters.described_clusters(entries(spark, v), "entry_id", "dino", 0.65).collect()
    assert {(r["cluster_id"], r["rank"], r["entry_id"], r["density"]) for r in rows} == want
    assert (904, 3, 909, 3) in want


def test_neighbours_against_brute_force(spark, vectors):
    got = knn.similar_pairs(entries(spark, vectors, vectors), "entry_id", {"dino": 0.65, "sscd": 0.75}, {"dino": "dino", "sscd": "sscd"})
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    for name, floor in (("dino", 0.65), ("sscd", 0.75)):
        want = brute_top(vectors, floor)
        have = {(a, b) for f, a, b in rows if f == name}
        assert len(want & have) >= 0.95 * len(want)
        assert len(have - want) <= 0.05 * len(want)


def test_many_copies_keep_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    v = {i: [1.0] + [0.25] * 127 for i in range(1, 41)}
    v |= {i + 40: x for i, x in planted(rng, [1] * 20, 0.1).items()}
    rows = knn.most_similar(entries(spark, v), "entry_id", {"dino": 0.65}).collect()
    mine = {r["entry"]: [] for r in rows}
    for r in rows:
        mine[r["entry"]].append(r["neighbour"])
    assert sorted(mine[1]) == [2, 3, 4, 5, 6]
    assert sorted(mine[40]) == [1, 2, 3, 4, 5]
    assert sorted(mine[3]) == [1, 2, 4, 5, 6]


def test_nearest_of_a_query_set(spark, vectors, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "SCANNED", 300)
    table = entries(spark, vectors).repartition(5)
    rows = knn.nearest_to(table.where("entry_id % 4 = 0"), table, "entry_id", "dino").collect()
    ids, m = unit(vectors)
    s = m @ m.T
    want, got = set(), {(r["entry"], r["neighbour"]) for r in rows}
    for r, i in enumerate(ids):
        if i % 4 == 0:
            want |= {(i, j) for _, j in sorted((-round(s[r, c], 6), j) for c, j in enumerate(ids) if j != i)[:5]}
    assert len(rows) == len(got) == len(want) and len(got & want) >= 0.97 * len(want)
    cosine = {(ids[a], ids[b]): s[a, b] for a in range(len(ids)) for b in range(len(ids))}
    assert all(abs(r["cosine"] - cosine[r["entry"], r["neighbour"]]) < 1e-5 for r in rows)
    assert knn.nearest_to(table.limit(0), table, "entry_id", "dino").count() == 0
    assert knn.nearest_to(table, table.limit(0), "entry_id", "dino").count() == 0


def test_codes_and_keys():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 256, (50, 16), dtype=np.uint8)
    i, j = cells._near_codes(cells._words(bits), 10, 30, 55)
    apart = np.unpackbits(bits[10:30, None] ^ bits[None], axis=2).sum(2)
    assert set(zip(i.tolist(), j.tolist())) == {(a + 10, b) for a, b in zip(*np.nonzero(apart <= 55))}
    for pair in ((0, 0), (3, 70_000), (90_000, 90_001)):
        key = int(cells._pair_key(np.array(pair[0]), np.array(pair[1])))
        assert cells._pair_of(key) == pair and key < cells.KEY_CELL
    assert cells.cells_for(1000, 8, 128) == 8 and cells.cells_for(96_000, 8, 128) == 12
    wide = cells._record(128, 8, 300)
    assert wide["cells"].base == np.dtype("<u4") and cells._record(128, 8, 256)["cells"].base == np.dtype("<u2")


def test_shared_cells():
    rng = np.random.default_rng(4)
    for top in (400, 5000):
        c = np.sort(rng.integers(0, top, (60, 8)), axis=1).astype(np.uint32)
        c[:30, 2] = c[30:, 3]
        for cell in (top // 3, top):
            i, j = np.divmod(np.arange(3600), 60)
            got = cells._shared_before(c, cells._cell_marks(c, cell), cell, i, j)
            assert got.tolist() == [bool({x for x in c[a] if x < cell} & set(c[b])) for a, b in zip(i, j)]


def test_hot_cell_is_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = planted(rng, [150, 30], 0.5)
    monkeypatch.setattr(cells, "BLOCK", 40)
    monkeypatch.setattr(clusters, "BLOCK", 40)
    members, _ = clusters.similar_clusters(entries(spark, v), "entry_id", "dino", 0.65)
    assert {tuple(r) for r in members.collect()} == brute_clusters(v, 0.65)


def test_empty_tables(spark):
    empty = entries(spark, {}).limit(0)
    assert clusters.similar_clusters(empty, "entry_id", "dino", 0.65)[0].count() == 0
    assert knn.most_similar(empty, "entry_id", {"dino": 0.65}).count() == 0
