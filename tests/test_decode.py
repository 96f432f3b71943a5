import hashlib
import struct

import numpy as np
import pytest

from sightline.operators import decode, embed
from sightline.sources import files


def ppm(w, h, rgb):
    return b"P6\n# made here\n%d %d\n255\n" % (w, h) + rgb


def y4m(path, shades, fps=10, w=4, h=2):
    with open(path, "wb") as file:
        file.write(b"YUV4MPEG2 W%d H%d F%d:1 C420jpeg\n" % (w, h, fps))
        for s in shades:
            file.write(b"FRAME\n" + bytes([s]) * (w * h) + bytes([128]) * (2 * (w // 2) * (h // 2)))
    return str(path)


class Forward(decode.Y4mDecoder):
    def can_seek(self, path):
        return False

    def seek(self, path, target_ms):
        raise AssertionError("cannot seek")


def test_pictures(spark):
    rgb = bytes(range(18))
    data = [(1, ppm(3, 2, rgb)), (2, b"P5 2 1 255\n\x01\x02"), (3, ppm(3, 2, rgb[:5])), (4, b"?"), (5, None), (6, ppm(99, 99, b""))]
    got = {r["id"]: r for r in decode.decoded(spark.createDataFrame(data, "id long, content binary"), "content", max_pixels=1000).collect()}
    assert (got[1]["width"], got[1]["height"], bytes(got[1]["rgb"]), got[1]["decode_error"]) == (3, 2, rgb, None)
    assert bytes(got[2]["rgb"]) == b"\x01\x01\x01\x02\x02\x02"
    assert all(got[i]["rgb"] is None and got[i]["decode_error"] for i in (3, 4, 5, 6)) and "exceed" in got[6]["decode_error"]


def test_orientations():
    a = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    p = decode.Picture(3, 2, a.tobytes())
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.transpose(1, 0, 2), 6: np.rot90(a, -1), 7: np.rot90(a, 2).transpose(1, 0, 2), 8: np.rot90(a)}
    for turn, b in want.items():
        q = decode.upright(p, turn)
        assert (q.height, q.width) == b.shape[:2] and q.rgb == np.ascontiguousarray(b).tobytes(), turn


@pytest.mark.parametrize("make", [decode.Y4mDecoder, Forward])
def test_frames(spark, tmp_path, make):
    shades = [20, 20, 40, 40, 20, 60, 80, 80, 90, 100]
    good, bad = y4m(tmp_path / "a.y4m", shades), str(tmp_path / "gone.y4m")
    videos = spark.createDataFrame([(good,), (bad,)], "path string")
    found = decode.extracted(videos, "path", 5.0, make=make).collect()
    mine = sorted((r["frame_index"], r["timecode_ms"]) for r in found if r["path"] == good)
    # every second frame: 20 40 20 80 90, of which the third was seen before
    assert mine == [(0, 0), (1, 200), (2, 600), (3, 800)]
    assert [r["error"].split(":")[0] for r in found if r["path"] == bad] == ["FileNotFoundError"]
    assert decode.extracted(videos, "path", 5.0, 2, make).where("error is null").count() == 2
    picture = make()._frame(good, 0)
    assert {r["frame_hash"] for r in found if r["frame_index"] == 0} == {hashlib.sha256(struct.pack("<II", 4, 2) + picture.rgb).hexdigest()}
    for wrong in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            decode.extracted(videos, "path", *wrong)
    info = {r["path"]: r for r in decode.video_info(videos, "path", make).collect()}
    assert (info[good]["frame_count"], info[good]["fps"], info[good]["duration_s"], info[good]["width"]) == (10, 10.0, 1.0, 4) and info[bad]["info_error"]


def test_thumbnails(spark, tmp_path):
    pictures = spark.createDataFrame([("ab1", 4, 2, bytes(24)), (None, 4, 2, bytes(24)), ("cd2", 4, 2, None)], "image_hash string, width int, height int, rgb binary")
    assert [tuple(r) for r in decode.write_thumbnails(pictures, str(tmp_path), 2).collect()] == [("ab1", True)]
    assert [tuple(r) for r in decode.write_thumbnails(pictures, str(tmp_path), 2).collect()] == [("ab1", False)]
    assert (tmp_path / "ab" / "ab1.ppm").read_bytes().startswith(b"P6\n2 1\n255\n")


def test_page(spark):
    page = files.scatter_page(spark.createDataFrame([("</script>", 0.5, -0.25, 1.0)], "id string, x double, y double, z double"), "<t>")
    assert "&lt;t&gt;" in page and page.count("</script>") == 1 and "[0.5, -0.25, 1.0]" not in page and "0.5, -0.25, 1.0]" in page


def test_crops():
    rng = np.random.default_rng(0)
    p = decode.Picture(500, 331, rng.integers(0, 256, 331 * 500 * 3, dtype=np.uint8).tobytes())
    a = np.frombuffer(p.rgb, np.uint8).reshape(331, 500, 3)
    five = decode.cropped(p)
    assert [np.frombuffer(c.rgb, np.uint8).reshape(288, 288, 3).tolist() == a[y:y + 288, x:x + 288].tolist() for c, (x, y) in zip(five, [(106, 21), (0, 0), (212, 0), (0, 43), (212, 43)])] == [True] * 5
    assert (decode.resized(p, 10, 7).width, len(decode.cropped(p, 1))) == (10, 1)
    inner = embed.HashEmbedder(8)
    (mean,) = embed.CropEmbedder(inner).embed([decode.netpbm(p)])
    parts = np.array(inner.embed([decode.netpbm(c) for c in five]), np.float64).mean(0)
    assert np.allclose(mean, parts / np.linalg.norm(parts), atol=1e-6)
    assert np.allclose(embed.CropEmbedder(inner, 1).embed([decode.netpbm(p)])[0], inner.embed([decode.netpbm(five[0])])[0], atol=1e-6)
    with pytest.raises(ValueError):
        embed.CropEmbedder(inner, 3)
