import random

import pytest

from sightline.llm import batch_dedup, components, topn

FRAME = "match_id long, video_hash string, timecode_ms long, scores map<string,double>, grp string, id string, rank_1 int, score int"
HIT = "hit_id long, query_path string, query_hash string, path string, image_hash string, scores map<string,double>, a int, b int, v int, label int, digest string, good int"
FILE = "record_id long, batch_no int, path string, md5 string, sha256 string, id int, hi int, lo int, first int, files int, loc string, sha int"
LIMITS = {"exact": 1.0, "altered": 0.75, "semantic": 0.55}


def test_best_frames_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        video = None if rng.random() < 0.02 else ("hot" if rng.random() < 0.4 else f"v{rng.randrange(60)}")
        if video and rng.random() < 0.3:
            video = f" {video.upper()}\n"
        score = rng.choice([0.5, 0.7, 0.9, 0.9, float("nan"), None])
        rows.append((i, video, rng.choice([None, 0, 5, 9]), rng.choice([None, {}, {"a": score}, {"a": score, "b": 0.6}]), "g", "x", 1, 2))
    rows += rows[:500]
    got = topn.best_frames(spark.createDataFrame(rows, FRAME)).collect()
    best = {}
    for i, video, tc, scores, *_ in {r[0]: r for r in rows}.values():
        numbers = [s for s in (scores or {}).values() if s is not None and s == s]
        if video and numbers:
            best.setdefault(video.strip().lower(), []).append((-max(numbers), tc or 0, i))
    want = {(v, x[2]) for v, xs in best.items() for x in sorted(xs)[:3]}
    assert {(r["video_hash"], r["match_id"]) for r in got} == want
    assert len(got) == len(want)


def test_best_frames_of_nothing(spark):
    assert topn.best_frames(spark.createDataFrame([], FRAME)).count() == 0
    assert topn.best_frames(spark.createDataFrame([(1, "  ", 1, {"a": 0.5}, "", "", 0, 0)], FRAME)).count() == 0


def groups(spark, rows):
    rows = [(i, *r, 0, 0, 0, 0, "d", 0) for i, r in enumerate(rows)]
    found = components.match_groups(spark.createDataFrame(rows, HIT), LIMITS).collect()
    assert len(found) == len({r["path"] for r in found})
    return {r["path"]: r["group_path"] for r in found}


def test_match_groups(spark):
    d = "ab" * 32
    rows = [
        ("a", None, "b", None, {"altered": 0.75}), ("b", None, "c", None, {"semantic": 0.55, "altered": 0.1}), ("c", None, "b", None, {"exact": 1.0}),
        ("d", None, "e", None, {"altered": 0.74}), ("f", None, "f", None, {"exact": 1.0}), ("g", d, "h", None, {}), ("x", None, "i", " SHA256:" + d.upper(), None),
        ("j", "0" * 64, "k", "0" * 64, None), (None, None, "l", None, {"exact": 1.0}), ("m", None, "n", None, {"exact": float("nan"), "other": 1.0}),
    ]
    assert groups(spark, rows) == {"a": "a", "b": "a", "c": "a", "g": "g", "i": "g"}


def test_long_chain_and_hub(spark):
    chain = [(f"c{i:04}", None, f"c{i + 1:04}", None, {"exact": 1.0}) for i in range(300)]
    hub = [("hub", None, f"s{i:03}", None, {"exact": 1.0}) for i in range(200)]
    tail = [(f"s000{'x' * i}", None, f"s000{'x' * (i + 1)}", None, {"exact": 1.0}) for i in range(12)]
    found = groups(spark, chain + hub + tail)
    assert {found[f"c{i:04}"] for i in range(301)} == {"c0000"}
    assert {v for k, v in found.items() if not k.startswith("c")} == {"hub"}
    assert len(found) == 301 + 1 + 200 + 12


def test_shared_hashes_are_told_apart(spark, monkeypatch):
    # a number of 3 bits: nearly all names clash at first
    monkeypatch.setattr(components, "_number", lambda kind, name: components.F.pmod(components.F.xxhash64(kind, name), components.F.lit(8)))
    rows = [(f"a{i}", None, f"b{i}", None, {"exact": 1.0}) for i in range(12)]
    assert groups(spark, rows) == {x: f"a{i}" for i in range(12) for x in (f"a{i}", f"b{i}")}


def test_peel_of_a_deep_component(spark):
    # a tree of 12 levels: the frontier doubles all the way
    rows = [(f"n{i:05}", None, f"n{(i - 1) // 2:05}", None, {"exact": 1.0}) for i in range(1, 2**9)]
    assert set(groups(spark, rows).values()) == {"n00000"}


def test_no_hits(spark):
    assert groups(spark, []) == {}


def sequential(rows):
    """The rule as written, over plain values (sha, md5, place)."""
    accepted, found = [], set()
    for i, _, path, md5, sha in sorted(rows, key=lambda r: (r[1], r[0])):
        hit = None
        for j, p, m, s in accepted:
            if (sha and s == sha) or (md5 and m == md5 and not (sha and s)) or (path and p == path and not (sha and s and sha != s) and not (md5 and m and md5 != m)):
                hit = j
                break
        if hit is None:
            accepted.append((i, path, md5, sha))
        else:
            found.add((hit, i))
    return found


def test_repeats_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1, 801):
        sha = rng.choice([None, "hot", *"abcdefgh"]) if rng.random() < 0.6 else f"{i}"
        md5 = rng.choice([None, *"ijklmn"]) if rng.random() < 0.5 else f"{i}"
        path = rng.choice([None, "/p", "/q", "/r"]) if rng.random() < 0.4 else f"/{i}"
        rows.append((i, i // 100, path, md5, sha))
    import hashlib

    def spelled(kind, value):
        if value is None:
            return rng.choice([None, "", "n/a", "-", "0" * (64 if kind == "sha" else 32), "abc"])
        digest = hashlib.sha256(value.encode()).hexdigest() if kind == "sha" else hashlib.md5(value.encode()).hexdigest()
        return rng.choice([digest, digest.upper(), f"{'sha256' if kind == 'sha' else 'md5'}:{digest}", f" {digest}\t"])

    def walked(path):
        return path and rng.choice([path, "/." + path, "/x/.." + path, "file://" + path, "/" + path, path.replace("/", "\\")])

    written = [(i, b, walked(p), spelled("md5", m), spelled("sha", s), 0, 0, 0, 0, 0, "l", 0) for i, b, p, m, s in rows]
    table = spark.createDataFrame(written, FILE)
    want = sequential(rows)
    found = batch_dedup.repeated_records(table).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)

    # tiny folders and ranges: the runs are cut by leading bits, batches go in pieces, levels are merged
    small = batch_dedup.HashForest(spark, range_rows=200, range_bytes=90_000)
    first = batch_dedup.repeated_records(table.where("batch_no < 5"), small).collect()
    assert small.state["merges"] == 1 and max(r["bits"] for r in small.state["runs"]) > 1
    # a later job opens the forest by its path and reads new batches only
    again = batch_dedup.HashForest(spark, small.root, range_rows=200, range_bytes=90_000)
    assert again.state == small.state
    later = batch_dedup.repeated_records(table.where("batch_no >= 5"), again).collect()
    assert {tuple(r) for r in first + later} == want and len(first + later) == len(want)
    with pytest.raises(ValueError, match="admitted before"):
        batch_dedup.repeated_records(table.where("batch_no = 3"), again)


def test_no_records(spark):
    assert batch_dedup.repeated_records(spark.createDataFrame([], FILE)).count() == 0


def test_record_without_a_batch_comes_last(spark):
    d = "ab" * 32
    rows = [(1, None, None, None, d, *[0] * 5, "l", 0), (2, 3, None, None, d, *[0] * 5, "l", 0), (None, 1, None, None, d, *[0] * 5, "l", 0)]
    assert [tuple(r) for r in batch_dedup.repeated_records(spark.createDataFrame(rows, FILE)).collect()] == [(2, 1)]
