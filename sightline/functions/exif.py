"""EXIF flags and coordinates of image bytes, without an imaging library."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GPS_POINTER = 0x8825  # fixed value: the tag that points at the GPS directory
ORIENTATION = 0x0112  # fixed value: the tag of the orientation
# fixed values: tags of texts about the camera
TEXT_TAGS = {271: "make", 272: "model", 306: "datetime", 305: "software"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}  # fixed values: bytes per field type


def _block(content: bytes) -> bytes | None:
    """The TIFF structure inside a JPEG, PNG or TIFF file."""
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + size]
            if kind == 0xDA or size < 2:
                return None
            at += 2 + size
        return None
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    return content if content[:4] in (b"II*\0", b"MM\0*") else None


def _directory(block: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    (count,) = struct.unpack_from(order + "H", block, at)
    out = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * n
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", block, where)
        out[tag] = (kind, n, block[where : where + size])
    return out


def _degrees(field: tuple[int, int, bytes] | None, side: bytes, order: str) -> float | None:
    if field is None or field[0] != 5 or field[1] < 3:
        return None
    v = struct.unpack_from(order + "6I", field[2])
    if not (v[1] and v[3] and v[5]):
        return None
    plain = round(v[0] / v[1] + v[2] / v[3] / 60 + v[4] / v[5] / 3600, 6)
    return -plain if side[:1].upper() in (b"S", b"W") else plain


def read_exif(content: bytes | None) -> tuple[bool, bool, float | None, float | None]:
    """``(has exif, has gps, latitude, longitude)``; damaged data count as absent, nothing is raised."""
    try:
        block = _block(content or b"")
        if not block:
            return False, False, None, None
        order = "<" if block[:2] == b"II" else ">"
        main = _directory(block, order, struct.unpack_from(order + "I", block, 4)[0])
        if GPS_POINTER not in main:
            return bool(main), False, None, None
        gps = _directory(block, order, struct.unpack(order + "I", main[GPS_POINTER][2][:4])[0])
        place = [_degrees(gps.get(v), gps.get(s, (2, 0, b""))[2], order) for s, v in ((1, 2), (3, 4))]
        return True, bool(gps), *place
    except (struct.error, IndexError):
        return False, False, None, None


def exif(content: Column | str) -> Column:
    """``struct<exif, exif_geo_data, latitude, longitude>`` of image bytes."""

    @F.pandas_udf("struct<exif: boolean, exif_geo_data: boolean, latitude: double, longitude: double>")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = [read_exif(c) for c in contents]
        return pd.DataFrame(rows, columns=["exif", "exif_geo_data", "latitude", "longitude"]).astype({"latitude": "float64", "longitude": "float64"})

    return run(F.col(content) if isinstance(content, str) else content)


def _main(content: bytes | None) -> tuple[str, dict[int, tuple[int, int, bytes]]]:
    block = _block(content or b"")
    if not block:
        return "<", {}
    order = "<" if block[:2] == b"II" else ">"
    return order, _directory(block, order, struct.unpack_from(order + "I", block, 4)[0])


def orientation(content: bytes | None) -> int:
    """How a picture is to be turned, 1 to 8; 1 where nothing is said."""
    try:
        order, main = _main(content)
        value = struct.unpack_from(order + "H", main[ORIENTATION][2])[0] if ORIENTATION in main else 1
        return value if 1 <= value <= 8 else 1
    except (struct.error, IndexError):
        return 1


def picture_header(content: bytes) -> tuple[str, int | None, int | None]:
    """``(format, width, height)`` by the first bytes, without decoding; an empty format is unknown."""
    c = content
    if c[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG", *struct.unpack_from(">II", c, 16)
    if c[:4] in (b"GIF8",):
        return "GIF", *struct.unpack_from("<HH", c, 6)
    if c[:2] == b"BM":
        return "BMP", *(abs(x) for x in struct.unpack_from("<ii", c, 18))
    if c[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(c) and c[at] == 0xFF:
            kind = c[at + 1]
            # the frame headers, of which three numbers mean something else
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", c, at + 5)
                return "JPEG", width, height
            at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD7 else 2 + int.from_bytes(c[at + 2 : at + 4], "big")
        return "JPEG", None, None
    if c[:4] in (b"II*\0", b"MM\0*"):
        order, main = _main(c)
        number = lambda tag: struct.unpack_from(order + ("H" if main[tag][0] == 3 else "I"), main[tag][2])[0] if tag in main else None
        return "TIFF", number(256), number(257)
    return "", None, None


DETAIL = ("exif boolean, exif_geo_data boolean, latitude double, longitude double, width int, height int, format string, size_bytes bigint, "
          + ", ".join(f"{name} string" for name in TEXT_TAGS.values()))


def read_detail(content: bytes | None) -> tuple:
    """What ``DETAIL`` names, of a picture's bytes; what cannot be read is null, nothing is raised."""
    flags = read_exif(content)
    texts: dict[str, str] = {}
    try:
        kind, width, height = picture_header(content or b"")
    except (struct.error, IndexError):
        kind, width, height = "", None, None
    try:
        _, main = _main(content)
        for tag, name in TEXT_TAGS.items():
            text = main[tag][2].decode("utf-8", "replace").strip("\0").strip() if tag in main else ""
            if text:
                texts[name] = text
    except (struct.error, IndexError):
        pass
    return (*flags, width, height, kind, None if content is None else len(content), *[texts.get(n) for n in TEXT_TAGS.values()])


def exif_detail(content: Column | str) -> Column:
    """File and EXIF details of image bytes as a struct."""

    @F.pandas_udf(f"struct<{DETAIL.replace(' ', ': ').replace(',:', ',')}>")
    def run(contents: pd.Series) -> pd.DataFrame:
        names = [field.split()[0] for field in DETAIL.split(", ")]
        frame = pd.DataFrame([read_detail(c) for c in contents], columns=names)
        return frame.astype({"latitude": "float64", "longitude": "float64", "width": "Int32", "height": "Int32", "size_bytes": "Int64"})

    return run(F.col(content) if isinstance(content, str) else content)
