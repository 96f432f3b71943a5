"""Name-based identifiers (UUID version 5) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value of RFC 4122


def uuid5(name: Column | str, namespace: str = NAMESPACE_URL) -> Column:
    """UUID5 of a name; null for null."""
    c = F.col(name) if isinstance(name, str) else name
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def image_id(image_hash: Column | str) -> Column:
    return uuid5(image_hash)


def frame_id(video_hash: Column | str, timecode_ms: Column | str) -> Column:
    v, t = (F.col(x) if isinstance(x, str) else x for x in (video_hash, timecode_ms))
    return uuid5(F.concat(v, F.lit(":"), t.cast("string")))


def video_id(video_hash: Column | str) -> Column:
    v = F.col(video_hash) if isinstance(video_hash, str) else video_hash
    return uuid5(F.concat(F.lit("video:"), v))
