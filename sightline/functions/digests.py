"""Digest clean-up: one written form, or null where there is no digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"^\s+|\s+$"


def clean_digest(col: Column | str, digits: int) -> Column:
    """Lower-case hexadecimal digest of exactly ``digits`` digits, else null.

    Surrounding blanks, letter case and an algorithm prefix (``sha256:``,
    ``md5=``, ``0x``) do not matter.  Null, damaged or shortened values and
    fillers (one digit repeated all along) give null.
    """
    c = F.col(col) if isinstance(col, str) else col
    shape = rf"^[0-9a-f]{{{digits}}}\z"  # a dollar would let a line end pass
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, BLANKS, "")), r"^(?:sha-?256\s*[:=]\s*|md5\s*[:=]\s*|0x)", "")
    # most values are clean already: one look is enough for them
    digest = F.when(c.rlike(shape), c).when(bare.rlike(shape), bare)
    return F.when(~digest.rlike(r"^(.)\1*\z"), digest)
