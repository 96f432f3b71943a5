"""Pictures and videos as columns: decoders are plug-ins, made once per task.

Codecs are not part of this package.  A decoder for netpbm pictures and one for
uncompressed YUV4MPEG2 videos are here, both plain public formats; others are
passed in.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.exif import orientation
from sightline.functions.media import CROP_SIDE, RESIZE_SIDE


@dataclass
class Picture:
    width: int
    height: int
    rgb: bytes


class PictureDecoder(Protocol):
    def size(self, content: bytes) -> tuple[int, int]: ...

    def decode(self, content: bytes) -> Picture: ...


class VideoDecoder(Protocol):
    """``seek`` gives the first frame at or after a time, or None; a decoder that cannot seek says so."""

    def info(self, path: str) -> dict: ...

    def can_seek(self, path: str) -> bool: ...

    def frames(self, path: str) -> Iterator[tuple[int, Picture]]: ...

    def seek(self, path: str, target_ms: float) -> tuple[int, Picture] | None: ...


class NetpbmDecoder:
    """Binary netpbm pictures, grey (P5) and colour (P6), of one byte a value."""

    def _header(self, content: bytes) -> tuple[str, int, int, int]:
        fields, at = [], 0
        while len(fields) < 4:
            while content[at:at + 1].isspace():
                at += 1
            if content[at:at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while end < len(content) and not content[end:end + 1].isspace():
                end += 1
            if end == at:
                raise ValueError("header cut off")
            fields.append(content[at:end].decode("ascii", "replace"))
            at = end
        if fields[0] not in ("P5", "P6") or fields[3] != "255":
            raise ValueError(f"no binary netpbm picture: {fields[0]}")
        return fields[0], int(fields[1]), int(fields[2]), at + 1

    def size(self, content: bytes) -> tuple[int, int]:
        return self._header(content)[1:3]

    def decode(self, content: bytes) -> Picture:
        kind, width, height, at = self._header(content)
        each = 3 if kind == "P6" else 1
        raw = content[at:at + width * height * each]
        if len(raw) < width * height * each:
            raise ValueError("pixels cut off")
        return Picture(width, height, raw if each == 3 else bytes(x for g in raw for x in (g, g, g)))


class Y4mDecoder:
    """YUV4MPEG2 videos with 4:4:4 or 4:2:0 planes; frames have one size, so any can be reached directly."""

    def _open(self, path: str) -> tuple[dict, int, int]:
        with open(path, "rb") as file:
            line = file.readline()
        if not line.startswith(b"YUV4MPEG2"):
            raise ValueError("no YUV4MPEG2 video")
        fields = {x[:1]: x[1:] for x in line.decode("ascii").split()[1:]}
        a, b = (int(x) for x in fields["F"].split(":"))
        width, height, chroma = int(fields["W"]), int(fields["H"]), fields.get("C", "420")
        planes = width * height * 3 if chroma.startswith("444") else width * height + 2 * ((width + 1) // 2) * ((height + 1) // 2)
        count = (os.path.getsize(path) - len(line)) // (planes + 6)
        return {"codec": "rawvideo", "width": width, "height": height, "fps": a / b, "frame_count": count, "duration_s": count * b / a, "chroma": chroma}, len(line), planes

    def info(self, path: str) -> dict:
        return {k: v for k, v in self._open(path)[0].items() if k != "chroma"}

    def can_seek(self, path: str) -> bool:
        return True

    def _frame(self, path: str, number: int) -> Picture:
        import numpy as np

        info, head, planes = self._open(path)
        w, h = info["width"], info["height"]
        with open(path, "rb") as file:
            file.seek(head + number * (planes + 6) + 6)
            raw = np.frombuffer(file.read(planes), np.uint8).astype(np.float32)
        y = raw[: w * h].reshape(h, w)
        cw, ch = (w, h) if info["chroma"].startswith("444") else ((w + 1) // 2, (h + 1) // 2)
        u, v = (raw[w * h + i * cw * ch:w * h + (i + 1) * cw * ch].reshape(ch, cw) - 128 for i in (0, 1))
        if cw != w:
            u, v = (x.repeat(2, 0).repeat(2, 1)[:h, :w] for x in (u, v))
        y = 1.164 * (y - 16)
        rgb = np.stack([y + 1.596 * v, y - 0.392 * u - 0.813 * v, y + 2.017 * u], 2)
        return Picture(w, h, np.clip(np.rint(rgb), 0, 255).astype(np.uint8).tobytes())

    def frames(self, path: str) -> Iterator[tuple[int, Picture]]:
        info = self._open(path)[0]
        for n in range(info["frame_count"]):
            yield int(n * 1000 / info["fps"]), self._frame(path, n)

    def seek(self, path: str, target_ms: float) -> tuple[int, Picture] | None:
        info = self._open(path)[0]
        n = max(0, int(target_ms * info["fps"] / 1000))
        while n < info["frame_count"] and int(n * 1000 / info["fps"]) < target_ms:
            n += 1
        return (int(n * 1000 / info["fps"]), self._frame(path, n)) if n < info["frame_count"] else None


def upright(picture: Picture, turn: int) -> Picture:
    """The picture as its EXIF orientation (1 to 8) says it is to be seen."""
    import numpy as np

    if turn not in range(2, 9):
        return picture
    a = np.frombuffer(picture.rgb, np.uint8).reshape(picture.height, picture.width, 3)
    a = a.transpose(1, 0, 2) if turn >= 5 else a
    if turn in (2, 3, 6, 7):
        a = a[:, ::-1]
    if turn in (3, 4, 7, 8):
        a = a[::-1]
    return Picture(a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes())


def decoded(files: DataFrame, content: str, make: Callable[[], PictureDecoder] = NetpbmDecoder, max_pixels: int = 178_956_970) -> DataFrame:
    """Adds ``width, height, rgb, decode_error``: upright pictures; one that fails has an error, the others go on.

    A picture of more than ``max_pixels`` (0: no limit) is refused by its header,
    before its pixels are unpacked.
    """

    @F.pandas_udf("struct<width: int, height: int, rgb: binary, decode_error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = make()
        for contents in batches:
            rows = []
            for item in contents:
                try:
                    if item is None:
                        raise ValueError("no content")
                    w, h = decoder.size(item)
                    if max_pixels and w * h > max_pixels:
                        raise ValueError(f"{w} x {h} pixels exceed {max_pixels}")
                    p = upright(decoder.decode(item), orientation(item))
                    rows.append((p.width, p.height, p.rgb, None))
                except Exception as problem:  # one item must not end the batch
                    rows.append((None, None, None, f"{type(problem).__name__}: {problem}"))
            frame = pd.DataFrame(rows, columns=["width", "height", "rgb", "decode_error"])
            yield frame.astype({"width": "Int32", "height": "Int32"})

    return files.withColumn("_p", run(F.col(content))).select(*files.columns, "_p.*")


def video_info(videos: DataFrame, path: str, make: Callable[[], VideoDecoder] = Y4mDecoder) -> DataFrame:
    """Adds ``duration_s, codec, width, height, fps, frame_count, info_error``; nothing is raised."""
    names = ["duration_s", "codec", "width", "height", "fps", "frame_count"]

    @F.pandas_udf("struct<duration_s: double, codec: string, width: int, height: int, fps: double, frame_count: bigint, info_error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = make()
        for paths in batches:
            rows = []
            for p in paths:
                try:
                    found = decoder.info(p)
                    rows.append((*[found.get(n) for n in names], None))
                except Exception as problem:  # best effort
                    rows.append((*[None] * len(names), f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=[*names, "info_error"]).astype({"width": "Int32", "height": "Int32", "frame_count": "Int64", "duration_s": "float64", "fps": "float64"})

    return videos.withColumn("_i", run(F.col(path))).select(*videos.columns, "_i.*")


def picture_digest(picture: Picture) -> str:
    return hashlib.sha256(struct.pack("<II", picture.width, picture.height) + picture.rgb).hexdigest()


def _picks(decoder: VideoDecoder, path: str, step: float) -> Iterator[tuple[int, Picture]]:
    """Frames at or after every target, by seeking where the decoder can, else by reading on."""
    target = 0.0
    if decoder.can_seek(path):
        while (met := decoder.seek(path, target)) is not None:
            yield met
            target = max(target, met[0]) + step
        return
    for at, picture in decoder.frames(path):
        if at >= target:
            yield at, picture
            target = at + step


def extracted(videos: DataFrame, path: str, fps: float, max_frames: int = 0, make: Callable[[], VideoDecoder] = Y4mDecoder) -> DataFrame:
    """Sampled frames ``(path, frame_index, timecode_ms, frame_hash, width, height, rgb, error)``, one row each.

    Pictures repeated within a video are left out and get no index; at most
    ``max_frames`` a video (0: no limit).  A video that fails gives one row with
    its error after the frames before.  Frames stream out one by one: no video
    is held.  Videos are spread evenly over the tasks before they are read.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    if max_frames < 0:
        raise ValueError("max_frames must not be negative")
    columns = ["path", "frame_index", "timecode_ms", "frame_hash", "width", "height", "rgb", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = make()
        for batch in batches:
            for p in batch["path"]:
                seen: set[str] = set()
                try:
                    for at, picture in _picks(decoder, p, 1000.0 / fps):
                        digest = picture_digest(picture)
                        if digest in seen:
                            continue
                        seen.add(digest)
                        yield pd.DataFrame([(p, len(seen) - 1, at, digest, picture.width, picture.height, picture.rgb, None)], columns=columns)
                        if len(seen) == max_frames:
                            break
                except Exception as problem:  # the next videos go on
                    yield pd.DataFrame([(p, None, None, None, None, None, None, f"{type(problem).__name__}: {problem}")], columns=columns)

    schema = "path string, frame_index int, timecode_ms long, frame_hash string, width int, height int, rgb binary, error string"
    return videos.select(F.col(path).alias("path")).repartition("path").mapInPandas(run, schema)


def scaled(picture: Picture, side: int) -> Picture:
    """The picture with its longer side at ``side`` at most."""
    scale = min(1.0, side / max(picture.width, picture.height))
    return resized(picture, max(1, int(picture.width * scale)), max(1, int(picture.height * scale)))


def resized(picture: Picture, width: int, height: int) -> Picture:
    """The picture at another size, by its nearest pixels."""
    import numpy as np

    a = np.frombuffer(picture.rgb, np.uint8).reshape(picture.height, picture.width, 3)
    rows, columns = np.arange(height) * picture.height // height, np.arange(width) * picture.width // width
    return Picture(width, height, np.ascontiguousarray(a[rows[:, None], columns]).tobytes())


def cropped(picture: Picture, crops: int = 5, short: int = RESIZE_SIDE, side: int = CROP_SIDE) -> list[Picture]:
    """The centre square, then the four corners, of the picture with its shorter side at ``short``."""
    import numpy as np

    least = min(picture.width, picture.height)
    # round() takes halves to the even neighbour, as the column expression of this size does
    width, height = (short if x == least else round(x * short / least) for x in (picture.width, picture.height))
    whole = resized(picture, width, height)
    a = np.frombuffer(whole.rgb, np.uint8).reshape(height, width, 3)
    right, low = width - side, height - side
    corners = [(right // 2, low // 2), (0, 0), (right, 0), (0, low), (right, low)][: 1 if crops == 1 else 5]
    return [Picture(side, side, np.ascontiguousarray(a[y:y + side, x:x + side]).tobytes()) for x, y in corners]


def netpbm(picture: Picture) -> bytes:
    return f"P6\n{picture.width} {picture.height}\n255\n".encode() + picture.rgb


def write_thumbnails(pictures: DataFrame, folder: str, side: int = 256, encode: Callable[[Picture], bytes] = netpbm, suffix: str = ".ppm") -> DataFrame:
    """Write a small picture per ``image_hash`` where there is none yet: ``(image_hash, written)``.

    ``pictures(image_hash, width, height, rgb)``; ``folder`` lies where all executors
    see it.  A file appears under its name only when it is whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = Path(folder)
        for batch in batches:
            rows = []
            for digest, w, h, rgb in batch.itertuples(index=False):
                final, new = root / digest[:2] / f"{digest}{suffix}", False
                if not final.exists():
                    final.parent.mkdir(parents=True, exist_ok=True)
                    aside = final.with_name(f".{final.name}-{uuid.uuid4().hex}")
                    aside.write_bytes(encode(scaled(Picture(int(w), int(h), rgb), side)))
                    aside.replace(final)
                    new = True
                rows.append((digest, new))
            yield pd.DataFrame(rows, columns=["image_hash", "written"])

    good = pictures.where("image_hash is not null and rgb is not null").select("image_hash", "width", "height", "rgb")
    return good.mapInPandas(run, "image_hash string, written boolean")
