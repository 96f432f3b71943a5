import hashlib
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import api, settings
from sightline.functions import exif


@pytest.fixture(scope="module")
def collections(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 8))
    v[1] = v[0] + 0.1 * rng.standard_normal(8)
    rows = [(i, f"/p/{i}.jpg", f"{i:064x}", i >= 30, "v" if i >= 30 else None, f"{9:064x}" if i >= 30 else None, i * 10, v[i].tolist(), v[i][:4].tolist(), "m") for i in range(40)]
    case = spark.createDataFrame(rows, "point_id long, path string, image_hash string, is_video_frame boolean, video_path string, video_hash string, frame_timecode_ms long, dino array<float>, sscd array<float>, dino_model_name string")
    reference = case.where("point_id < 3").withColumn("point_id", F.col("point_id") + 100)
    t = datetime(2024, 1, 1)
    tags = spark.createDataFrame([(1, "old", [0, 2], [5, 6], None, t), (2, "new", [0], [], None, t.replace(year=2025)), (3, "none", [], [7], None, t), (4, "gone", [0], [999], None, t)],
                                 "tag_id long, name string, positive_ids array<long>, negative_ids array<long>, target_id long, updated_at timestamp")
    return api.Collections(case, tags, reference)


def test_search_and_lookup(spark, collections):
    files = spark.createDataFrame([(1, False, None, f"{0:064x}", None), (2, False, "broken", f"{0:064x}", None), (3, True, None, f"{9:064x}", None)], "file_id long, is_video boolean, error string, file_hash string, file_hash_md5 string")
    vec = collections.case.where("point_id in (0, 31)").select((F.col("point_id") + 1).alias("q_id"), F.when(F.col("point_id") == 0, 1).otherwise(3).cast("long").alias("file_id"), F.lit("semantic").alias("mode"),
                                                              F.when(F.col("point_id") == 31, F.lit(500)).cast("long").alias("query_timecode_ms"), F.col("dino").alias("vec"))
    found = collections.search(files, vec, include_reference=True).orderBy("file_id", "rnk").collect()
    first = [r for r in found if r["file_id"] == 1]
    assert first[0]["path"] == "/p/0.jpg" and set(first[0]["scores"]) == {"exact", "semantic"}
    assert {r["hit_key"] for r in first} >= {"case:/p/0.jpg", "ref:/p/0.jpg", "case:/p/1.jpg"}
    assert {r["file_id"] for r in found} == {1, 3}
    video = [r for r in found if r["file_id"] == 3 and r["hit_key"] == "case:v"][0]
    assert video["scores"]["exact"] == 1.0 and video["query_timecodes"] == [500]
    with pytest.raises(ValueError):
        collections.search(files, vec, limit=51)
    assert [r[0] for r in collections.timeline(f"{9:064x}").collect()] == [i * 10 for i in range(30, 40)]
    ids = collections.point_ids([f"{1:064x}", f"{1:064x}", f"{77:064x}"]).collect()
    assert [(r["image_hash"], r["point_id"]) for r in ids] == [(f"{1:064x}", 1)]
    assert collections.provenance(f"{2:064x}").collect()[0]["provenance"] == {"dino": {"model_name": "m"}}
    assert collections.point(spark.createDataFrame([(101,), (5,)], "point_id long")).count() == 2
    for bad in (["x"], ["0" * 63], [f"{i:064x}" for i in range(257)]):
        with pytest.raises(ValueError):
            api.checked_hashes(bad)


def test_tags(collections):
    top = collections.triage(1, limit=5).orderBy("rnk").collect()
    assert top and not {r["cand"] for r in top} & {0, 2, 5, 6}
    assert collections.triage(2, floor=0.9).collect()[0]["cand"] == 1
    with pytest.raises(ValueError):
        collections.triage(3)
    with pytest.raises(KeyError):
        collections.triage(77)
    assert collections.explore(1, 4)[1] == "context" and collections.explore(3, 4)[1] == "random"
    got = {r["image_hash"]: r["names"] for r in collections.classify([f"{i:064x}" for i in range(40)], 0.9).collect()}
    assert len(got) == 40 and got[f"{1:064x}"][0] == "new" and "gone" not in got[f"{1:064x}"]
    assert [r["tag_id"] for r in collections.list_tags().collect()][0] == 2
    assert collections.triage_entries(collections.case, 2, 50, 0.9).count() == 2
    assert collections.classify_entries(collections.case, 0.9).where("tag_id = 2").count() == 2


def test_expected_hashes(tmp_path):
    (tmp_path / "w.bin").write_bytes(b"1")
    local = settings.Settings(model_semantic=str(tmp_path), model_copy=str(tmp_path / "gone"))
    assert settings.expected_hashes(local, {"dino", "sscd"}) == {"dino": hashlib.sha256(b"w.bin1").hexdigest()} and settings.expected_hashes(local, {"sscd"}) == {}
    remote = settings.Settings(embedding_endpoint="http://h/", embedding_model="m", embedding_dim=8)
    assert settings.expected_hashes(remote, {"dino", "sscd"}) == dict.fromkeys(("dino", "sscd"), "config:" + hashlib.sha256(b"http://hm8").hexdigest())
    assert settings.expected_hashes(settings.Settings(embedding_endpoint="http://h/"), {"dino"}) == {}
    assert remote.effective_model("x") == "m" and local.effective_model("x") == "x"
    with pytest.raises(ValueError):
        settings.Settings(embedding_endpoint="http://h/").effective_model("x")
    found = settings.library_versions(("pyspark", "no-such-library"))
    assert found["no-such-library"] == "unknown" and found["pyspark"][0].isdigit() and "python" in found


def test_tag_calls(spark, collections):
    assert collections.get_tag(1)["name"] == "old"
    assert [r["target_id"] for r in collections.set_target(1, 9).where("tag_id = 1").collect()] == [9] and collections.set_target(1, "").where("target_id is not null").count() == 0
    left, was = collections.delete_tag(1)
    assert was and left.count() == 3 and collections.delete_tag(99)[1] is False
    for call in (lambda: collections.get_tag(99), lambda: collections.set_target(99, 1), lambda: collections.mark(99, 1, "positive"), lambda: collections.unmark(99, 1)):
        with pytest.raises(KeyError):
            call()
    assert [r["name"] for r in collections.skipped_tags().collect()] == ["gone"]
    only = collections.triage(1, limit=5, where=F.col("point_id") > 20).collect()
    assert only and all(r["cand"] > 20 for r in only)
    for call in (lambda: collections.triage(1, limit=501), lambda: collections.explore(1, limit=0), lambda: collections.explore(1, collection="x")):
        with pytest.raises(ValueError):
            call()
    # the reference collection holds none of the labelled points
    assert collections.explore(1, 3, collection="reference")[1] == "random"
    assert collections.metadata("/p/31.jpg").first()["frame_timecode_ms"] == 310 and collections.frame_metadata(f"{9:064x}", 320).first()["path"] == "/p/32.jpg"


def test_models_present(tmp_path):
    (tmp_path / "w.bin").write_bytes(b"1")
    here, gone = str(tmp_path / "w.bin"), str(tmp_path / "gone")
    assert settings.missing_models(settings.Settings(model_semantic=here, model_copy=gone)) == [gone]
    assert settings.missing_models(settings.Settings(model_copy=gone, embedding_endpoint="http://h", embedding_model="m")) == []
    assert settings.verified_model(here, settings.content_hash(here)) == here
    with pytest.raises(ValueError):
        settings.verified_model(here, "0")


def test_example_cache(spark, collections):
    cache = api.ExampleCache(spark, most=2)
    assert cache.examples(collections, 1).count() == 4 and cache.examples(collections, 1) is cache.examples(collections, 1)
    cache.examples(collections, 2), cache.examples(collections, 3)
    assert len(cache) == 2


def test_probing_is_repeated():
    class Failing:
        def __init__(self, times):
            self.times = times

        def modes(self):
            self.times -= 1
            if self.times >= 0:
                raise OSError("away")
            return {"exact"}

    waits = []
    assert api.probed_modes(Failing(2), sleep=waits.append) == ({"exact"}, False, None) and waits == [1, 2]
    modes, reference, error = api.probed_modes(Failing(9), sleep=waits.append)
    assert modes == set() and not reference and "away" in error and waits == [1, 2, 1, 2, 4]


def test_settings(tmp_path):
    s = settings.Settings.from_env({"SIGHTLINE_MAX_FRAMES": " 7 ", "SIGHTLINE_IGNORE_CONFIG_MISMATCH": "Yes", "SIGHTLINE_COLLECTION": "", "SIGHTLINE_EXTRACTION_FPS": "0.5"})
    assert (s.max_frames, s.ignore_config_mismatch, s.collection, s.extraction_fps) == (7, True, "case", 0.5)
    for bad in ({"SIGHTLINE_MAX_FRAMES": "x"}, {"SIGHTLINE_IGNORE_CONFIG_MISMATCH": "maybe"}, {"SIGHTLINE_DUPLICATE_CHECK": "x"}, {"SIGHTLINE_COPY_CROPS": "3"}):
        with pytest.raises(ValueError):
            settings.Settings.from_env(bad)
    file = str(tmp_path / "c" / "cal.json")
    assert settings.load_calibrations(file) == {}
    settings.save_calibration(file, "a", 32)
    settings.save_calibration(file, "b", 64)
    assert settings.load_calibrations(file) == {"a": 32, "b": 64}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "w.bin").write_bytes(b"1")
    (tmp_path / "m" / "README.md").write_bytes(b"notes do not count")
    one = settings.content_hash(str(tmp_path / "m"))
    assert one == hashlib.sha256(b"w.bin" + b"1").hexdigest() and settings.content_hash(str(tmp_path / "m" / "w.bin")) == hashlib.sha256(b"1").hexdigest()
    (tmp_path / "m" / "w.bin").write_bytes(b"2")
    assert settings.content_hash(str(tmp_path / "m")) != one
    assert settings.checked_tag(" a ", "n", "1, ,2") == ("a", "n", ["1", "2"])
    for bad in (("", ""), ("x" * 201, ""), ("a", "n" * 4001)):
        with pytest.raises(ValueError):
            settings.checked_tag(*bad)


def picture(order, gps=True):
    e = "<" if order == b"II" else ">"
    head = order + struct.pack(e + "HI", 42, 8)
    entries = struct.pack(e + "HHII", exif.GPS_POINTER, 4, 1, 26) if gps else struct.pack(e + "HHII", 0x0112, 3, 1, 1)
    main = struct.pack(e + "H", 1) + entries + struct.pack(e + "I", 0)
    at = 26 + 2 + 4 * 12 + 4
    rational = lambda *x: struct.pack(e + "6I", *x)
    directory = struct.pack(e + "H", 4) + struct.pack(e + "HHI4s", 1, 2, 2, b"S\0") + struct.pack(e + "HHII", 2, 5, 3, at) + struct.pack(e + "HHI4s", 3, 2, 2, b"E\0") + struct.pack(e + "HHII", 4, 5, 3, at + 24) + struct.pack(e + "I", 0)
    tiff = head + main + directory + rational(10, 1, 30, 1, 36, 1) + rational(20, 1, 0, 1, 0, 1)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00\x02"


def test_exif_detail(spark):
    def tiff(*entries):
        body, data, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
        for tag, kind, value in entries:
            raw = value if isinstance(value, bytes) else struct.pack("<H", value).ljust(4, b"\0")
            count = len(raw) if isinstance(value, bytes) else 1
            if len(raw) > 4:
                body += struct.pack("<HHII", tag, kind, count, at + len(data))
                data += raw
            else:
                body += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        return b"II*\0" + struct.pack("<IH", 8, len(entries)) + body + struct.pack("<I", 0) + data

    whole = tiff((256, 3, 640), (257, 3, 480), (271, 2, b"Maker Inc\0"), (exif.ORIENTATION, 3, 6), (306, 2, b"2024:01:02 03:04:05\0"))
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 20) + b"\x03"
    data = [(0, whole), (1, png), (2, jpeg), (3, b"junk"), (4, None), (5, whole[:30]), (6, b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)), (7, b"GIF89a" + struct.pack("<HH", 3, 4))]
    got = {r["i"]: r["d"].asDict() for r in spark.createDataFrame(data, "i int, content binary").select("i", exif.exif_detail("content").alias("d")).collect()}
    shape = lambda i: (got[i]["format"], got[i]["width"], got[i]["height"])
    assert [shape(i) for i in (0, 1, 2, 3, 6, 7)] == [("TIFF", 640, 480), ("PNG", 7, 9), ("JPEG", 20, 30), ("", None, None), ("BMP", 5, 6), ("GIF", 3, 4)]
    assert (got[0]["make"], got[0]["datetime"], got[0]["model"], got[0]["exif"], got[0]["size_bytes"]) == ("Maker Inc", "2024:01:02 03:04:05", None, True, len(whole))
    assert got[4]["size_bytes"] is None and got[5]["make"] is None
    assert exif.orientation(whole) == 6 and exif.orientation(b"junk") == exif.orientation(None) == 1


def test_exif(spark):
    data = [(0, picture(b"II")), (1, picture(b"MM")), (2, picture(b"II", False)), (3, picture(b"II")[:40]), (4, b""), (5, None), (6, b"\xff\xd8junk"), (7, b"\x89PNG\r\n\x1a\n")]
    got = {r["i"]: tuple(r["e"]) for r in spark.createDataFrame(data, "i int, content binary").select("i", exif.exif("content").alias("e")).collect()}
    assert got[0] == got[1] == (True, True, -10.51, 20.0)
    assert got[2] == (True, False, None, None)
    assert all(got[i] == (False, False, None, None) for i in range(3, 8))
