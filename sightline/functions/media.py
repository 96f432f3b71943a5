"""File, geometry and text-formatting expressions."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions that count as images and videos
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp", "gif", "jp2", "ico", "psd")
HEIF_EXTENSIONS = ("heic", "heif")
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "m4v", "mpg", "mpeg", "3gp", "ts", "mts")

CROP_SIDE, RESIZE_SIDE = 288, 331  # fixed values of the copy-detection preprocessing


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path: Column | str) -> Column:
    """Lower-case suffix; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/\\]\.([^./\\]+)$", 1))


def heif_available() -> bool:
    """Whether a decoder for HEIF pictures is installed."""
    return find_spec("pillow_heif") is not None


def file_type(path: Column | str, heif: bool | None = None) -> Column:
    """``image``, ``video`` or ``unsupported`` by suffix; HEIF counts where its decoder is, unless ``heif`` says otherwise."""
    heif = heif_available() if heif is None else heif
    images = IMAGE_EXTENSIONS + (HEIF_EXTENSIONS if heif else ())
    ext = extension(path)
    return F.when(ext.isin(*images), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("unsupported")


def parent_dir(path: Column | str) -> Column:
    """Directory of a path; a virtual frame path (``video::frame``) counts with its video."""
    return F.regexp_replace(F.split_part(_col(path), F.lit("::"), F.lit(1)), r"/[^/]*$", "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def move_prefix(path: Column | str, old: str, new: str) -> Column:
    """The path with a leading ``old`` replaced; other paths stay."""
    p = _col(path)
    return F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, len(old) + 1, 1 << 30))).otherwise(p)


def frame_file(root: str, video_hash: Column | str, timecode_ms: Column | str) -> Column:
    """Where a frame lies: timecodes are padded to ten digits and never cut."""
    return F.concat_ws("/", F.lit(root), _col(video_hash), F.concat(F.format_string("%010d", _col(timecode_ms)), F.lit("ms.jpg")))


def parse_frame_file(path: Column | str) -> tuple[Column, Column]:
    """``(video_hash, timecode_ms)`` of a frame's file; null if it is none."""
    p, pattern = _col(path), r"([^/]+)/(\d{10,})ms\.jpg$"
    ok = p.rlike(pattern)
    return F.when(ok, F.regexp_extract(p, pattern, 1)), F.when(ok, F.regexp_extract(p, pattern, 2).cast("bigint"))


def capped_size(width: Column | str, height: Column | str, cap: int) -> tuple[Column, Column]:
    """Size after limiting the shorter side; fractions are cut off."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    short = F.least(w, h)
    scale = F.when(short <= cap, F.lit(1.0)).otherwise(F.lit(float(cap)) / short)
    return F.greatest(F.lit(1), (w * scale).cast("int")), F.greatest(F.lit(1), (h * scale).cast("int"))


def short_side_to(width: Column | str, height: Column | str, side: int = RESIZE_SIDE) -> tuple[Column, Column]:
    """Size with the shorter side at ``side``, the other rounded half to even."""
    w, h = _col(width), _col(height)
    wide = w >= h
    ratio = lambda a, b: F.bround(a.cast("double") * side / b.cast("double")).cast("int")
    return F.when(wide, ratio(w, h)).otherwise(F.lit(side)), F.when(wide, F.lit(side)).otherwise(ratio(h, w))


def crop_boxes(width: Column | str, height: Column | str, side: int = CROP_SIDE, crops: int = 5) -> Column:
    """Boxes ``(left, top, right, bottom)``: the centre, then the four corners."""
    w, h = _col(width), _col(height)
    box = lambda x, y: F.struct(x.alias("left"), y.alias("top"), (x + side).alias("right"), (y + side).alias("bottom"))
    zero = F.lit(0)
    cx, cy = F.floor((w - side) / 2).cast("int"), F.floor((h - side) / 2).cast("int")
    rx, ry = (w - side).cast("int"), (h - side).cast("int")
    boxes = [box(cx, cy), box(zero, zero), box(rx, zero), box(zero, ry), box(rx, ry)]
    return F.array(*boxes[: 1 if crops == 1 else 5])


def effective_cap(normalize_size: Column | str) -> Column:
    """Short side that serves both preprocessings: no less than either needs."""
    return F.greatest(F.lit(RESIZE_SIDE), _col(normalize_size).cast("int"))


def centre_preview(width: Column | str, height: Column | str, side: Column | str) -> tuple[Column, Column, Column]:
    """Size with the shorter side at ``side`` and the centre square that the semantic model sees in it."""
    w, h, n = _col(width), _col(height), _col(side).cast("int")
    scale = n.cast("double") / F.least(w, h)
    nw, nh = (F.greatest(n, F.bround(x * scale).cast("int")) for x in (w, h))
    x, y = F.floor((nw - n) / 2).cast("int"), F.floor((nh - n) / 2).cast("int")
    return nw, nh, F.struct(x.alias("left"), y.alias("top"), (x + n).alias("right"), (y + n).alias("bottom"))


def duration_text(seconds: Column | str) -> Column:
    """``7s``, ``3m 07s`` or ``2h 03m 07s``; fractions are cut off."""
    s = _col(seconds).cast("bigint")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.format_string("%ds", s)).when(m < 60, F.format_string("%dm %02ds", m, s % 60))
        .otherwise(F.format_string("%dh %02dm %02ds", h, m % 60, s % 60))
    )


def rate_text(count: Column | str, seconds: Column | str, unit: str) -> Column:
    """Items a second with one digit, a dash where no time has passed."""
    per = _col(count).cast("double") / _col(seconds)
    return F.when(_col(seconds) > 0, F.format_string(f"%.1f {unit}/s", F.bround(per, 1))).otherwise("\u2014")


def megabyte_rate_text(size: Column | str, seconds: Column | str) -> Column:
    return rate_text(_col(size) / 1e6, seconds, "MB")


def bar(percent: Column | str, width: int = 28) -> Column:
    """A bar of ``width`` block characters, filled by percentage."""
    share = F.least(F.greatest(_col(percent).cast("double"), F.lit(0.0)), F.lit(100.0))
    filled = F.bround(F.lit(width) * share / 100).cast("int")
    return F.concat(F.repeat(F.lit("\u2588"), filled), F.repeat(F.lit("\u2591"), F.lit(width) - filled))


def expected_frames(duration_s: Column | str, fps: float, cap: int) -> Column:
    whole = F.floor(_col(duration_s) * fps)
    return F.greatest(F.lit(1).cast("bigint"), F.least(whole, F.lit(cap)) if cap > 0 else whole)


def clock(timecode_ms: Column | str) -> Column:
    """h:mm:ss of a timecode."""
    s = F.floor(_col(timecode_ms) / 1000)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def dms_degrees(degrees: Column | str, minutes: Column | str, seconds: Column | str, side: Column | str) -> Column:
    """Decimal degrees to six places, negative for south and west."""
    plain = F.round(_col(degrees) + _col(minutes) / 60 + _col(seconds) / 3600, 6)
    return F.when(F.upper(_col(side)).isin("S", "W"), -plain).otherwise(plain)


def data_url(content: Column | str, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(_col(content)), r"\s", ""))


def best_score(scores: Column | str) -> Column:
    """Greatest number of a score map, 0 if there is none."""
    numbers = F.filter(F.map_values(_col(scores)), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(F.array_max(numbers), F.lit(0.0))


def remote_model_hash(url: Column | str, model: Column | str, dim: Column | str) -> Column:
    """Identity of a model behind an endpoint: its configuration."""
    plain = F.regexp_replace(_col(url), "/+$", "")
    return F.concat(F.lit("config:"), F.sha2(F.concat(plain, _col(model), _col(dim).cast("string")), 256))


def provenance_map(modes: dict[str, str]) -> Column:
    """Mode -> ``(name, hash)`` from prefixed columns; modes without both are left out."""
    entries = []
    for mode, vector in modes.items():
        name, digest = F.coalesce(F.col(f"{vector}_model_name"), F.lit("")), F.coalesce(F.col(f"{vector}_model_hash"), F.lit(""))
        entries += [F.lit(mode), F.struct(name.alias("name"), digest.alias("hash"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: (v["name"] != "") | (v["hash"] != ""))
