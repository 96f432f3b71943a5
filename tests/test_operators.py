import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import dedup, embed, guard, hits, sampling, search, session_search, stats, triage
from sightline.sources import files, store


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_search_edges(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [float("nan"), 1.0])], "p long, v array<float>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, None)], "q long, v array<float>")
    got = rows(search.top_k(queries, points, "q", "v", "p", "v", 0.5, 2))
    assert [(q, r, p) for q, r, p, _ in sorted(got)] == [(10, 1, 1), (10, 2, 5)]
    assert search.top_k(queries.limit(0), points, "q", "v", "p", "v", 0.5, 2).count() == 0
    assert search.top_k(queries, points.limit(0), "q", "v", "p", "v", 0.5, 2).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8)).astype("float32")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<float>").repartition(3)
    whole = sorted(rows(search.top_k(df, df, "i", "v", "i", "v", None, 3)))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert sorted(rows(search.top_k(df, df, "i", "v", "i", "v", None, 3))) == whole
    monkeypatch.setattr(search, "QUERY_BYTES", 20 * 8 * 8)
    assert sorted(rows(search.top_k(df, df, "i", "v", "i", "v", None, 3))) == whole
    assert all(q == p for q, r, p, _ in whole if r == 1)


@pytest.mark.parametrize("n_pos,n_neg", [(1, 1), (1, 5), (5, 1), (3, 3), (4, 7), (10, 10), (16, 16), (0, 3), (3, 0)])
def test_context_pairs(spark, n_pos, n_neg):
    tags = spark.createDataFrame([(1, list(range(n_pos)), list(range(100, 100 + n_neg)))], "tag_id long, positive_ids array<long>, negative_ids array<long>")
    got = [(r["p"], r["n"]) for r in triage.context_pairs(tags).orderBy("ord").collect()]
    diagonal = [(i, i) for i in range(min(n_pos, n_neg))]
    rest = [(p, n) for p in range(n_pos) for n in range(n_neg) if p != n]
    assert got == (diagonal + rest)[:64]


def test_tag_kinds():
    assert triage.check_tag([1], [2]) == "discover" and triage.check_tag([1], []) == "recommend" and triage.check_tag([], [2], 3) == "recommend"
    for bad in (([], [2], None), ([], [], None)):
        with pytest.raises(ValueError):
            triage.check_tag(*bad)


def test_target_policies(spark):
    tags = spark.createDataFrame([(1, [5, 6], [7], None), (2, [], [7], 9)], "tag_id long, positive_ids array<long>, negative_ids array<long>, target_id long")
    assert [r["target_id"] for r in triage.targeted(tags, "anchor").orderBy("tag_id").collect()] == [5, 9]
    assert [r["positive_ids"] for r in triage.targeted(tags, "positive").orderBy("tag_id").collect()] == [[5, 6], [9]]
    assert [r["target_id"] for r in triage.targeted(tags, "ignore").collect()] == [None, None]
    with pytest.raises(ValueError):
        triage.targeted(tags, "x")


def test_grouping_does_not_depend_on_delivery(spark):
    data = [(1, "v", f"p{i}", f"h{i}", tc, {"altered": a}, ref, i) for i, (tc, a, ref) in enumerate([(30, 0.9, None), (None, 0.9, False), (10, 0.8, True), (20, float("nan"), None)])]
    schema = "q long, video_path string, path string, image_hash string, frame_timecode_ms long, scores map<string,double>, is_reference boolean, ord long"
    for shuffle in range(3):
        random.Random(shuffle).shuffle(data)
        (g,) = hits.group_video_hits(spark.createDataFrame(data, schema), ["q"]).collect()
        assert (g["path"], g["image_hash"], g["frame_timecode_ms"], g["scores"], g["is_reference"]) == ("p0", "h0", 30, {"altered": 0.9}, True)
        assert g["frames"] == 4
        assert sorted(r["timecode_ms"] for r in hits.frames_of(spark.createDataFrame(data, schema), ["q"]).collect()) == [0, 10, 20, 30]


def test_merging(spark):
    schema = "key string, path string, image_hash string, query_timecode_ms long, scores map<string,double>, is_reference boolean, ord long"
    data = [("k", "a", None, 500, {"altered": 0.7}, None, 1), ("k", "b", "h", 100, {"altered": 0.95, "semantic": 0.5}, None, 2), ("k", "c", "g", 500, {"semantic": 0.95}, None, 3)]
    (m,) = hits.merge_hits(spark.createDataFrame(data, schema), ["key"]).collect()
    assert (m["path"], m["image_hash"], m["query_timecodes"], m["best_query_timecode_ms"]) == ("a", "h", [500, 100], 100)
    assert m["scores"] == {"altered": 0.95, "semantic": 0.95}


def test_models_follow_the_best_score(spark):
    schema = "key string, path string, image_hash string, query_timecode_ms long, scores map<string,double>, provenance map<string,struct<name:string,hash:string>>, exif boolean, video_hash string, is_reference boolean, ord long"
    data = [("k", "a", None, 1, {"altered": 0.7, "semantic": 0.9}, {"altered": ("x", "1"), "semantic": ("s", "1")}, True, "v", None, 1),
            ("k", "b", "h", 2, {"altered": 0.9, "semantic": 0.9}, {"altered": ("y", "2"), "semantic": ("t", "2")}, False, "w", None, 2), ("k", "c", "g", 3, {"exact": 1.0}, None, None, None, None, 3)]
    (m,) = hits.merge_hits(spark.createDataFrame(data, schema), ["key"]).collect()
    assert (m["path"], m["exif"], m["video_hash"]) == ("a", True, "v") and m["scores"] == {"altered": 0.9, "semantic": 0.9, "exact": 1.0}
    assert {k: tuple(v) for k, v in m["provenance"].items()} == {"altered": ("y", "2"), "semantic": ("s", "1")}
    schema = schema.replace("key string", "key string, video_path string, frame_timecode_ms long")
    (g,) = hits.group_video_hits(spark.createDataFrame([("k", "/v", o * 10, *d[1:]) for o, d in enumerate(data)], schema), ["key"]).collect()
    assert (g["path"], g["frame_timecode_ms"], g["frames"], {k: v["name"] for k, v in g["provenance"].items()}) == ("c", 20, 3, {"altered": "y", "semantic": "s"})


def test_frames_of_merged_hits(spark):
    schema = "key string, timecode_ms long, frame_hash string, scores map<string,double>, ord long"
    data = [("k", 10, "b", {"altered": 0.7}, 2), ("k", 10, "a", {"altered": 0.9, "semantic": 0.6}, 3), ("k", 10, "c", {"semantic": 0.8}, 1), ("k", None, None, {"exact": 1.0}, 4)]
    got = {(r["timecode_ms"], r["frame_hash"], tuple(sorted(r["scores"].items()))) for r in hits.merge_frames(spark.createDataFrame(data, schema), ["key"]).collect()}
    assert got == {(10, "c", (("altered", 0.9), ("semantic", 0.8))), (0, "", (("exact", 1.0),))}


def test_session_keeps_the_frames_of_video_hits(spark):
    e1, e2 = [1.0] + [0.0] * 127, [0.9, (1 - 0.81) ** 0.5] + [0.0] * 126
    files = spark.createDataFrame([(1, True, None, "vh")], "file_id long, is_video boolean, error string, file_hash string")
    vectors = spark.createDataFrame([(1, 1, "altered", 100, e1), (2, 1, "altered", 200, e2), (3, 1, "semantic", 100, e1)], "q_id long, file_id long, mode string, query_timecode_ms long, vec array<double>")
    point = "point_id long, path string, image_hash string, is_video_frame boolean, video_path string, video_hash string, frame_timecode_ms long, is_reference boolean, dino array<double>, sscd array<double>"
    points = spark.createDataFrame([(1, "/f1", "h1", True, "/v", "vh", 5, False, e1, e1), (2, "/f2", "h2", True, "/v", "vh", 9, False, None, e2), (3, "/i", "h3", False, None, None, None, False, e1, None)], point)
    got = {(r["hit_key"], r["timecode_ms"], r["frame_hash"]): {m: round(x, 6) for m, x in r["scores"].items()} for r in session_search.matched_frames(files, vectors, points).collect()}
    assert got == {("case:/v", 5, "h1"): {"exact": 1.0, "altered": 1.0, "semantic": 1.0}, ("case:/v", 9, "h2"): {"exact": 1.0, "altered": 1.0}}
    flat = session_search.matched_frames(files, vectors, points, unify=False).collect()
    assert sorted((r["mode"], r["query_timecode_ms"] or 0, r["timecode_ms"], round(r["score"], 6)) for r in flat) == [
        ("altered", 100, 5, 1.0), ("altered", 100, 9, 0.9), ("altered", 200, 5, 0.9), ("altered", 200, 9, 1.0), ("exact", 0, 5, 1.0), ("exact", 0, 9, 1.0), ("semantic", 100, 5, 1.0)]


def test_unified_order(spark):
    data = [("q", "b", {"altered": 0.9}, False), ("q", "a", {"altered": 0.9}, False), ("q", "z", {"exact": 1.0}, False), ("q", "y", {"exact": 1.0, "semantic": 0.2}, False)]
    ranked = hits.rank_unified(spark.createDataFrame(data, "q string, path string, scores map<string,double>, is_reference boolean"), ["q"])
    assert [r["path"] for r in ranked.orderBy("rnk").collect()] == ["y", "z", "a", "b"]


def test_winners_and_comparison(spark):
    f = spark.createDataFrame([(1, "x", "/a"), (2, "x", "/b"), (3, None, "/c"), (4, None, "/d")], "id long, sha256 string, path string")
    assert sorted(rows(dedup.elect_winners(f, "sha256", "id").select("id", "is_dup"))) == [(1, False), (2, True), (3, False), (4, False)]
    known = spark.createDataFrame([("x", "/z"), (None, "/c")], "sha256 string, path string")
    left = lambda mode: sorted(r["id"] for r in dedup.not_indexed(f, known, mode).collect())
    assert (left("hash"), left("filepath"), left("both")) == ([3, 4], [1, 2, 4], [4])
    with pytest.raises(ValueError):
        dedup.not_indexed(f, known, "x")


def test_statistics(spark):
    one = spark.createDataFrame([(1, 0.3)], "q long, s double")
    (r,) = stats.distribution(one, ["q"], "s").collect()
    assert r["stdev"] == 0.0 and r["p10"] == r["p90"] == 0.3
    h = {r["bucket"]: r["n"] for r in stats.histogram(spark.createDataFrame([(1, x) for x in (-2.0, -1.0, 0.0, 1.0, 1.5)], "q long, s double"), ["q"], "s").collect()}
    assert len(h) == 20 and h[0] == 2 and h[10] == 1 and h[19] == 2


def test_throughput_filter(spark):
    data = [(1, i, n, s) for i, (n, s) in enumerate([(32, 2.0), (0, 1.0), (32, 1.0), (32, 0.0), (32, 4.0)])]
    x = p = None
    for _, _, n, s in data:
        if n > 0 and s > 0:
            z = n / s
            if x is None:
                x, p = z, 100.0
            else:
                k = (p + 50) / (p + 150)
                x, p = x + k * (z - x), (1 - k) * (p + 50)
    (r,) = stats.throughput_filter(spark.createDataFrame(data, "run long, o long, n long, s double"), ["run"], "o", "n", "s").collect()
    assert (r["updates"], r["rate"], r["variance"]) == (3, pytest.approx(x), pytest.approx(p))


def test_probe_stops(spark):
    runs = {"sat": [10, 20, 20.3], "decay": [50, 100, 60, 55, 50], "settle": [10, 100, 97, 94, 91, 96], "none": [1, 2, 4]}
    df = spark.createDataFrame([(k, i, float(t)) for k, ts in runs.items() for i, t in enumerate(ts)], "run string, ord long, t double")
    assert {r["run"]: (r["ord"], r["reason"]) for r in stats.probe_stops(df, ["run"]).collect()} == {"sat": (2, "saturated"), "decay": (4, "decayed"), "settle": (4, "settled")}


def greedy(frames, step, cap):
    kept, target, seen = [], 0.0, set()
    for t, h in sorted(frames):
        if t < target or (cap and len(kept) >= cap):
            continue
        if h not in seen:
            seen.add(h)
            kept.append((t, len(kept)))
        target = t + step
    return kept


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_sampling(spark, monkeypatch, block):
    # small blocks: a video is cut and its seams are mended
    monkeypatch.setattr(sampling, "BLOCK_MS", block)
    monkeypatch.setattr(sampling, "BLOCK_STEPS", 1)
    rng = random.Random(2)
    videos = {f"v{i}": [(rng.randrange(0, 20_000), rng.choice("abcdefghijkl")) for _ in range(rng.randrange(0, 120))] for i in range(12)}
    df = spark.createDataFrame([(v, t, h) for v, fs in videos.items() for t, h in fs] + [(None, 1, "a"), ("v0", None, "a")], "video string, t long, h string")
    got = {}
    for r in sampling.sample_frames(df, "video", "t", "h", 2.0, 8).collect():
        got.setdefault(r["video"], []).append((r["timecode_ms"], r["frame_index"]))
    assert {v: sorted(x) for v, x in got.items()} == {v: greedy(fs, 500.0, 8) for v, fs in videos.items() if fs}
    for bad in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            sampling.sample_frames(df, "video", "t", "h", *bad)


def test_nearest_frame(spark):
    f = spark.createDataFrame([("a", 966), ("a", 1000), ("a", 1100), ("b", 100), ("b", 5000)], "video string, t long")
    wanted = spark.createDataFrame([("a", 1000), ("b", 3000), ("c", 10)], "video string, target_ms long")
    assert {r["video"]: r["found_ms"] for r in sampling.nearest_frame(f, wanted, "video", "t", 1000 / 30).collect()} == {"a": 1000, "b": 100, "c": None}


def test_guard(spark):
    df = spark.createDataFrame([([1.0], "m1", 224), (None, "m2", 1), ([1.0], None, None)], "dino array<float>, dino_model_hash string, dino_normalize_size int")
    ok = {"dino": {"dino_model_hash": "m1", "dino_normalize_size": 224}}
    assert guard.check_collection(df, ok) == []
    with pytest.raises(ValueError, match="stored m1, current m9"):
        guard.check_collection(df, {"dino": {"dino_model_hash": "m9"}})
    mixed = df.union(spark.createDataFrame([([1.0], "m3", None)], df.schema))
    assert "mixes" in guard.check_collection(mixed, ok, strict=False)[0]
    assert guard.compatibility_errors([("m1", None)], {"h": "m1", "n": 5}, ["h", "n"], "dino") == []
    assert guard.check_reference("case", "ref", True) == "ref"
    for bad in ("case", None):
        with pytest.raises(ValueError):
            guard.check_reference("case", bad, True)


def test_table_versions(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    assert not t.exists() and t.modes() == set()
    df = spark.createDataFrame([(1, "a")], "id long, x string")
    t.write(df)
    t.snapshot("before")
    t.write(t.read().withColumn("x", F.lit("b")))
    assert rows(t.read()) == [(1, "b")]
    t.restore("before")
    assert rows(t.read()) == [(1, "a")]
    t.configure({"dino": 64})
    t.configure({"sscd": 32})
    assert t.modes() == {"exact", "altered", "semantic"}
    with pytest.raises(ValueError):
        t.configure({"dino": 65})


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "p1", [1.0], None), (2, "p2", None, [2.0])], "id long, path string, dino array<double>, sscd array<double>")
    new = spark.createDataFrame([(1, "other", [9.0]), (3, "p3", [3.0]), (3, "p4", [4.0])], "id long, path string, sscd array<double>")
    once = store.merged_points(old, new, "id", ["path"], ["sscd"])
    want = [(1, "p1", [1.0], [9.0]), (2, "p2", None, [2.0]), (3, "p3", None, [3.0])]
    assert sorted(rows(once)) == want
    assert sorted(rows(store.merged_points(once, new, "id", ["path"], ["sscd"]))) == want


def test_marks(spark):
    tags = spark.createDataFrame([(1, [1, 2], [3])], "tag_id long, positive_ids array<long>, negative_ids array<long>")
    assert rows(store.marked(tags, 1, 3, "positive")) == [(1, [1, 2, 3], [])]
    assert rows(store.marked(store.marked(tags, 1, 3, "positive"), 1, 3, "positive")) == [(1, [1, 2, 3], [])]
    assert rows(store.unmarked(tags, 1, 2)) == [(1, [1], [3])]
    with pytest.raises(ValueError):
        store.marked(tags, 1, 3, "x")


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    for name, content in {"a.JPG": b"x", "sub/b.mp4": b"", "c.txt": b"yy"}.items():
        (tmp_path / name).write_bytes(content)
    found = files.scan(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: (r["file_type"], r["size"]) for r in found.collect()} == {"a.JPG": ("image", 1), "b.mp4": ("video", 0), "c.txt": ("unsupported", 2)}
    gone = found.select("path").union(spark.createDataFrame([(str(tmp_path / "gone"),)], "path string"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.hashed(gone).collect()}
    assert got["a.JPG"]["sha256"] == hashlib.sha256(b"x").hexdigest() and got["gone"]["error"] == "FileNotFoundError" and got["gone"]["md5"] is None
    assert {r["sha256"] for r in files.hashed_content(spark, str(tmp_path)).collect()} == {got[n]["sha256"] for n in ("a.JPG", "c.txt")}
    assert files.within_roots(found, "path", [str(tmp_path / "sub")]).count() == 1 and files.within_roots(found, "path", []).count() == 0
    report = dedup.ingest_report(spark.createDataFrame([("b", "indexed", None, "m", "s", False), ("a", "failed", "why", None, None, True)], "path string, status string, reason string, md5 string, sha256 string, is_frame boolean"))
    files.write_report(report, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).select("path", "processed").collect()[0] == ("a", "no")


class Picky(embed.HashEmbedder):
    def embed(self, contents):
        if b"bad" in contents:
            raise RuntimeError("broken picture")
        return super().embed(contents)


def test_embedding_isolates_failures(spark):
    df = spark.createDataFrame([(1, b"a"), (2, b"bad"), (3, None), (4, b"a")], "id long, content binary")
    got = {r["id"]: r for r in embed.embedded(df, "content", lambda: Picky(8)).collect()}
    assert got[1]["vector"] == got[4]["vector"] and len(got[1]["vector"]) == 8
    assert "broken" in got[2]["embed_error"] and got[3]["embed_error"] == "no content" and got[2]["vector"] is None
    with pytest.raises(ValueError):
        embed.embedder("unknown")


def test_streaming(spark, tmp_path):
    from sightline.streaming import ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "sha256 string, id long").withColumn("at", F.lit("2030-01-01").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("sha256 string, id long, at timestamp").parquet(src)
    seen = []
    ingest.ingest(ingest.first_seen(stream, "sha256", "at"), lambda batch, n: seen.extend(r["sha256"] for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["x", "y"]
    counts = ingest.windowed_counts(stream, "at", "sha256")
    sessions = ingest.sessions(stream, "sha256", "at")
    assert counts.isStreaming and sessions.columns == ["sha256", "started", "expires", "n"]


def test_entry_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['sightline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'semantic_topk' in q and not any(k.startswith('p1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_unusable_points_do_not_displace_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0])], "point_id long, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "q long, v array<double>")
    for floor in (None, 0.5):
        assert sorted(r["point_id"] for r in search.top_k(queries, points, "q", "v", "point_id", "vec", floor, 2).collect()) == [1, 2]


def test_exact_videos_skip_malformed_timecodes(spark):
    frames = spark.createDataFrame([("v", "/v", "h3", "30"), ("v", "/v", "h1", "10"), ("v", "/v", "h0", "10"), ("v", "/v", "x", "abc"), ("v", "/v", "x", None), ("v", None, "x", "5"), ("v", "", "x", "6")],
                                   "video_hash string, video_path string, frame_hash string, frame_timecode_ms string")
    queries = spark.createDataFrame([(1, "v"), (2, "w")], "query_id long, video_hash string")
    assert rows(search.exact_videos(queries, frames)) == [(1, "/v", 2, 10, "h0", 30)]
    assert sorted(rows(search.exact_video_frames(queries, frames))) == [(1, "/v", 10), (1, "/v", 30)]


def test_pixel_hash(spark):
    import hashlib
    import struct

    df = spark.createDataFrame([(640, 480, b"rgb")], "w int, h int, rgb binary")
    assert df.select(sampling.pixel_hash("w", "h", "rgb")).first()[0] == hashlib.sha256(struct.pack("<II", 640, 480) + b"rgb").hexdigest()


def test_exported_names_do_not_collide(spark):
    import hashlib

    tags = spark.createDataFrame([(1, "a b", [1, 2, 3], [2])], "tag_id long, name string, positive_ids array<long>, negative_ids array<long>")
    points = spark.createDataFrame([(1, "/x/p.jpg"), (2, "/y/p.jpg"), (3, "/z/q.jpg")], "point_id long, path string")
    got = sorted(rows(store.export_plan(tags, points, "point_id", "path").select("tag", "role", "point", "name")))
    other = f"p_{hashlib.sha256(b'/y/p.jpg').hexdigest()[:8]}.jpg"
    assert got == [("a_b", "negative", 2, "p.jpg"), ("a_b", "positive", 1, "p.jpg"), ("a_b", "positive", 2, other), ("a_b", "positive", 3, "q.jpg")]


def test_example_vectors_fall_back(spark):
    tags = spark.createDataFrame([(1, [1, 9], [2])], "tag_id long, positive_ids array<long>, negative_ids array<long>")
    case = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "point_id long, v array<double>")
    ref = spark.createDataFrame([(1, [7.0]), (9, [9.0])], "point_id long, v array<double>")
    ids = triage.reference_ids(tags)
    got = {r["ref_id"]: r["v"] for r in triage.example_vectors(ids, case, ref, "point_id", "v").collect()}
    assert got == {1: [1.0], 2: [2.0], 9: [9.0]}
    assert {r["ref_id"] for r in triage.example_vectors(ids, case, None, "point_id", "v").collect()} == {1, 2}


def test_scoring_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((50, 6)))] + [(60, None), (61, [float("nan")] * 6)], "point_id long, v array<double>").repartition(3)
    tags = spark.createDataFrame([(1, list(range(9)), [20, 21, 60], None), (2, [3], [], 7), (3, [], [5], None), (4, list(range(10, 19)), [900], 61)], "tag_id long, positive_ids array<long>, negative_ids array<long>, target_id long")
    shape = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    whole = shape(triage.scored(points, tags, points, None, "point_id", "v"))
    m = {r["point_id"]: np.array(r["v"]) for r in points.where("point_id < 60").collect()}
    cos = lambda a, b: float(m[a] @ m[b] / np.linalg.norm(m[a]) / np.linalg.norm(m[b]))
    pairs = [(i, i) for i in range(2)] + [(p, n) for p in range(9) for n in range(2) if p != n]
    got = {(r[0], r[1]): r for r in whole}
    assert len(whole) == 150 and {k[0] for k in got} == {1, 2, 4}
    for c in range(50):
        assert got[1, c][2] == sum(round(cos(c, p), 9) > round(cos(c, 20 + n), 9) for p, n in pairs) and got[1, c][4] == 18
        assert got[2, c][2:] == (None, round(cos(c, 3), 6), None, round(cos(c, 7), 6))
        assert abs(got[4, c][3] - max(cos(c, p) for p in range(10, 19))) < 1e-5
    # many blocks, and tags whose positives are spread over several chunks
    monkeypatch.setattr(triage, "EXAMPLES", 5)
    monkeypatch.setattr(triage, "CHUNK", 3)
    spread = shape(triage.scored(points, tags, points, None, "point_id", "v"))
    assert [r[:5] for r in spread] == [r[:5] for r in whole]
    best = triage.ranked(triage.scored(points, tags, points, None, "point_id", "v", 4), 4)
    assert shape(best.select("tag_id", "cand", "rnk")) == shape(triage.ranked(triage.scored(points, tags, points, None, "point_id", "v"), 4).select("tag_id", "cand", "rnk"))


def test_labelled_copies_count_once(spark):
    case = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.6])], "point_id long, v array<double>")
    tags = spark.createDataFrame([(1, [1], [2], None)], "tag_id long, positive_ids array<long>, negative_ids array<long>, target_id long")
    alone = rows(triage.scored(case, tags, case, None, "point_id", "v").orderBy("cand"))
    copied = rows(triage.scored(case, tags, case, case.withColumn("v", F.reverse("v")), "point_id", "v").orderBy("cand"))
    assert alone == copied and [(r[2], r[4]) for r in alone] == [(1, 1), (0, 1), (1, 1)]


def test_explored_collection(spark):
    case = spark.createDataFrame([(1, [1.0])], "point_id long, v array<double>")
    assert triage.chosen_collection("dataset", case, None) is case
    for bad in ("x", "reference"):
        with pytest.raises(ValueError):
            triage.chosen_collection(bad, case, None)
    tags = spark.createDataFrame([(1, [2, 1], [9]), (2, [9], [])], "tag_id long, positive_ids array<long>, negative_ids array<long>")
    assert sorted(rows(triage.examples_in(tags, case, "point_id"))) == [(1, [1], []), (2, [], [])]


def test_table_refuses_what_does_not_fit(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    t.configure({"dino": 2})
    t.write(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, dino array<float>"))
    with pytest.raises(Exception, match="vector dino has 3 values, not 2"):
        t.write(spark.createDataFrame([(3, [1.0, 2.0, 3.0])], "id long, dino array<float>"))
    assert t.read().count() == 2
    t._put("vectors.json", {"size": 4, "distance": "cosine"})
    with pytest.raises(ValueError, match="older layout"):
        t.modes()


def test_tag_changes(spark):
    tags = spark.createDataFrame([(1, "a", [1], [2], 5), (2, "b", [3], [], None)], "tag_id long, name string, positive_ids array<long>, negative_ids array<long>, target_id long")
    now = F.lit(None)
    assert rows(store.retargeted(tags, 1, None, now).select("tag_id", "target_id")) == [(1, None), (2, None)]
    assert rows(store.retargeted(tags, 2, 7, now).select("tag_id", "target_id")) == [(1, 5), (2, 7)]
    assert rows(store.deleted_tags(tags, spark.createDataFrame([(2,), (2,), (9,)], "tag_id long")).select("tag_id")) == [(1,)]
    concepts = spark.createDataFrame([(True, "c1", "w", ["p"], "x"), (False, "c2", "v", [], "y")], "is_concept boolean, concept_id string, name string, positive_ids array<string>, polarity string")
    assert store.tags_of_concepts(concepts).columns == ["tag_id", "name", "positive_ids"] and rows(store.tags_of_concepts(concepts)) == [("c1", "w", ["p"])]
    points = spark.createDataFrame([(i, f"/a/{i}", "h") for i in range(30)], "point_id long, path string, image_hash string")
    assert store.remap_preview(points, ["path"], "/a", "/b").count() == 10 and store.remap_preview(points, ["path"], "/x", "/b").count() == 0


def test_run_completion(spark):
    f = spark.createDataFrame([(1, "v", "a", False), (2, "v", "a", True), (3, "w", "a", True), (4, "w", "b", False), (5, "v", None, False)], "frame long, video string, digest string, is_dup boolean")
    done = spark.createDataFrame([(1, "dino"), (4, "dino"), (5, "dino"), (1, "sscd")], "frame long, vector string")
    totals = spark.createDataFrame([("v", 3), ("w", 2), ("x", 0)], "video string, total int")
    got = {(r["video"], r["vector"]): (r["indexed"], r["dups"], r["complete"]) for r in dedup.run_completion(f, done, totals, ["dino", "sscd"]).collect()}
    # the repeated frame of w stands for one of v: it never got w's place
    assert got == {("v", "dino"): (2, 1, True), ("v", "sscd"): (1, 1, False), ("w", "dino"): (1, 0, False), ("w", "sscd"): (0, 0, False)}


def test_colliding_digests(spark):
    p = spark.createDataFrame([("m", "s1", "/a"), ("m", "s2", "/b"), ("m", "s2", "/b"), ("n", "s3", "/c"), ("k", None, "/d")], "md5 string, sha256 string, path string")
    q = spark.createDataFrame([(1, "m", "s1"), (2, "n", "s9"), (3, "n", "s3"), (4, "m", "s7"), (5, None, "s1")], "query_id long, md5 string, sha256 string")
    assert sorted(rows(search.md5_collisions(q, p))) == [(1, "/b"), (2, "/c"), (4, "/a"), (4, "/b")]


def test_models_run_once(spark, tmp_path):
    class Counting(embed.HashEmbedder):
        def embed(self, contents):
            with open(tmp_path / "calls", "a") as log:
                log.write("x" * len(contents))
            return super().embed(contents)

    uploads = spark.createDataFrame([(i, bytes([i]), False, None) for i in range(5)], "file_id long, content binary, is_video boolean, query_timecode_ms long")
    f, v = embed.analysed(uploads, {"semantic": lambda: Counting(4)})
    assert f.count() == 5 and v.count() == 5 and (tmp_path / "calls").stat().st_size == 5
    assert embed.picture_kind(b"\x89PNG\r\n") == "image/png" and embed.picture_kind(b"?") == "application/octet-stream"


def test_remote_answers():
    ok = [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]
    assert embed.checked_response(ok, 2, 2) == [[1.0, 2.0], [3.0, 4.0]]
    for bad, count in ((ok[:1], 2), ([ok[0], ok[0]], 2), ([{"index": 0, "embedding": [1]}], 1), ([{"index": 5, "embedding": [1, 2]}], 1), ([{"embedding": [1, 2]}], 1)):
        with pytest.raises(ValueError):
            embed.checked_response(bad, count, 2)
    with pytest.raises(ValueError):
        embed.embedder("remote", url="http://x/", model=" ", dim=2)


def test_analysed_session(spark):
    rows_ = [(1, b"a", False, None, None), (2, b"bad", False, None, None), (3, b"f1", True, 0, "vh"), (3, b"f2", True, 500, "vh")]
    uploads = spark.createDataFrame(rows_, "file_id long, content binary, is_video boolean, query_timecode_ms long, file_hash string")
    f, v = embed.analysed(uploads, {"semantic": lambda: Picky(8), "altered": lambda: Picky(4)})
    got = {r["file_id"]: r for r in f.collect()}
    assert got[2]["error"] and got[1]["error"] is None and got[3]["file_hash"] == "vh" and got[3]["is_video"]
    found = v.collect()
    assert sorted((r["file_id"], r["mode"]) for r in found) == [(1, "altered"), (1, "semantic"), (3, "altered"), (3, "altered"), (3, "semantic"), (3, "semantic")]
    assert len({r["q_id"] for r in found}) == 6


def test_probing_and_caps(spark):
    times = iter([x for b in (1, 2, 4, 8) for x in [b / {1: 10, 2: 19, 4: 30, 8: 30.5}[b]] * 3])
    assert [b for b, _ in embed.probe_batches(lambda b: next(times))] == [1, 2, 4, 8]
    df = spark.createDataFrame([(1, 10), (2, 20)], "id long, size long")
    assert files.checked_upload(df, "size", 30) is df and files.checked_upload(df, "size", 0) is df
    with pytest.raises(ValueError):
        files.checked_upload(df, "size", 29)
    assert files.session_allowed(5, 0) and files.session_allowed(1, 2) and not files.session_allowed(2, 2)
