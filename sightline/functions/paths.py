"""Path expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _composed(paths: pd.Series) -> pd.Series:
    # no built-in composes Unicode; ASCII and composed values pass through untouched
    return paths.map(lambda p: p if p is None or p.isascii() else unicodedata.normalize("NFC", p))


def clean_location(col: Column | str) -> Column:
    """The place a path leads to: one notation per location, letter case kept.

    Drops surrounding blanks and a ``file:`` scheme (whose percent escapes are
    decoded), turns backslashes into slashes, composes accents, and resolves
    repeated slashes, ``.`` and ``..`` steps and a trailing slash.  Null and
    blank paths give null: they name no place.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    local = F.regexp_replace(bare, r"^(?i:file):(?://(?i:localhost)?(?=/))?", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))), local)
    p = F.translate(F.when(bare.rlike(r"^(?i:file):"), decoded).otherwise(bare), "\\", "/")
    steps = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    # a fold only where a parent step occurs: every other path needs none
    walked = F.concat_ws(
        "/",
        F.aggregate(
            steps,
            F.array().cast("array<string>"),
            lambda acc, x: F.when(
                x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            ).otherwise(F.concat(acc, F.array(x))),
        ),
    )
    body = F.when(F.array_contains(steps, ".."), walked).otherwise(F.concat_ws("/", steps))
    root = F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    # most paths are plain already: nothing but a look for oddities is done to them
    odd = c.rlike(r"^\s|\s$|\\|//|(?:^|/)\.\.?(?:/|$)|/$|^(?i:file):") | (c == "")
    return F.pandas_udf(_composed, StringType())(F.when(~odd, c).when(bare != "", F.concat(root, body)))
