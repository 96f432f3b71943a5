import hashlib
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from sightline.functions import digests, ids, media, paths, vectors


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr).collect()]


def test_digests(spark):
    d = hashlib.sha256(b"x").hexdigest()
    given = [d, d.upper(), f"sha256:{d}", f" {d}\n", f"SHA-256 = {d}", f"{d}\n", d[:-1], d + "0", "0" * 64, "", None, "n/a", d[:10] + "g" + d[11:]]
    assert column(spark, given, digests.clean_digest("x", 64)) == [d] * 6 + [None] * 7


def test_locations(spark):
    nfd = unicodedata.normalize("NFD", "/e/téléphone/a.jpg")
    given = ["/e/a.jpg", "/e//a.jpg", "/e/./a.jpg", "/e/x/../a.jpg", "\\e\\a.jpg", "/e\\a.jpg", "/e/./x/../a.jpg", "/../e/a.jpg", "/e/a.jpg/.", "/e/x/..//a.jpg", "file:///e/a.jpg", " /e/a.jpg\t", "/e/a.jpg/"]
    assert set(column(spark, given, paths.clean_location("x"))) == {"/e/a.jpg"}
    assert column(spark, [nfd, "file:///e/t%C3%A9l%C3%A9phone/a+b.jpg"], paths.clean_location("x")) == ["/e/téléphone/a.jpg", "/e/téléphone/a+b.jpg"]
    assert column(spark, ["/e/A.jpg", "e/a.jpg", "/e/100%.jpg", None, "  "], paths.clean_location("x")) == ["/e/A.jpg", "e/a.jpg", "/e/100%.jpg", None, None]


def test_uuid5(spark):
    names = ["", "a", "é" * 40, "video:" + "f" * 64, "0" * 64]
    assert column(spark, names, ids.uuid5("x")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert column(spark, ["ab"], ids.frame_id("x", F.lit(1500))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "ab:1500"))]
    assert column(spark, ["ab"], ids.video_id("x")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "video:ab"))]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(F.round(vectors.cosine("a", "b"), 9), vectors.dot("a", "b")).collect()]
    assert got[0] == (0.96, 24.0) and got[1] == (0.0, 0.0) and got[2][1] is None and got[3][1] is None
    assert df.select(vectors.unit("a")).first()[0] == pytest.approx([0.6, 0.8])
    crops = spark.createDataFrame([([[2.0, 0.0], [0.0, 5.0]],)], "c array<array<double>>")
    assert crops.select(vectors.mean_of_crops("c", 2)).first()[0] == pytest.approx([0.5**0.5] * 2)


def test_media(spark):
    assert column(spark, ["a/b.JPG", "a.b/c", "x.Mp4", "y.heic", None], media.file_type("x", heif=True)) == ["image", "unsupported", "video", "image", "unsupported"]
    assert column(spark, ["y.heic", "a/.jpg", "a.", "b.psd", "c.vob"], media.file_type("x", heif=False)) == ["unsupported", "unsupported", "unsupported", "image", "unsupported"]
    assert column(spark, [59.9, 60.0, 3725.0], media.duration_text("x"), "double") == ["59s", "1m 00s", "1h 02m 05s"]
    assert column(spark, [0.0, 2.0], media.rate_text(F.lit(5), "x", "img"), "double") == ["\u2014", "2.5 img/s"]
    assert column(spark, [-5.0, 50.0, 200.0], media.bar("x", 4), "double") == ["\u2591" * 4, "\u2588" * 2 + "\u2591" * 2, "\u2588" * 4]
    assert column(spark, [100, 512], media.effective_cap("x"), "int") == [331, 512]
    assert column(spark, ["/a/b/c.jpg", "/a/v.mp4::frame_3", "c"], media.parent_dir("x")) == ["/a/b", "/a", "c"]
    assert column(spark, ["/a/x", "/b/x"], media.move_prefix("x", "/a", "/c/d")) == ["/c/d/x", "/b/x"]
    assert column(spark, [7, 12345678901], media.frame_file("/r", F.lit("h"), "x"), "long") == ["/r/h/0000000007ms.jpg", "/r/h/12345678901ms.jpg"]
    v, t = media.parse_frame_file("x")
    assert column(spark, ["/r/h/0000000007ms.jpg", "/r/h/7.jpg"], F.struct(v, t)) == [("h", 7), (None, None)]
    assert column(spark, [5, 3_661_000], media.clock("x"), "long") == ["0:00:00", "1:01:01"]
    # half to even, as against half up
    w, h = media.short_side_to("x", F.lit(662))
    assert column(spark, [663, 665], F.struct(w, h), "int") == [(332, 331), (332, 331)]
    assert column(spark, [0.0, 12.7, 9999.0], media.expected_frames("x", 1.0, 500), "double") == [1, 12, 500]
    assert column(spark, [10.0], media.dms_degrees("x", F.lit(30), F.lit(36), F.lit("s")), "double") == [-10.51]
    assert column(spark, ["a"], media.data_url(F.col("x").cast("binary"))) == ["data:image/jpeg;base64,YQ=="]
    m = spark.createDataFrame([({"a": 0.5, "b": float("nan"), "c": None},), ({},), (None,)], "m map<string,double>")
    assert [r[0] for r in m.select(media.best_score("m")).collect()] == [0.5, 0.0, 0.0]
    p = spark.createDataFrame([("n", None, "", None)], "dino_model_name string, dino_model_hash string, sscd_model_name string, sscd_model_hash string")
    assert p.select(media.provenance_map({"semantic": "dino", "altered": "sscd"})).first()[0] == {"semantic": ("n", "")}
