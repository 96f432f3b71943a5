"""Scanning and hashing files."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.media import extension, file_type

CHUNK = 1 << 20


def scan(spark: SparkSession, root: str, heif: bool | None = None, with_empty: bool = True) -> DataFrame:
    """``(path, ext, file_type, mtime, size)`` of every file below ``root``; contents are not read.

    The source passes over files of length 0.  ``with_empty`` adds them, without
    a time, from the file listing that the driver makes in any case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = lambda c: F.regexp_replace(c, "^file:(//)?", "")
    found = files.select(plain("path").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    if with_empty:
        listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(plain("path").alias("path"))
        empty = listed.join(found.select("path"), "path", "left_anti")
        found = found.union(empty.select("path", F.lit(None).cast("timestamp"), F.lit(0).cast("bigint")))
    return found.select("path", extension("path").alias("ext"), file_type("path", heif).alias("file_type"), "mtime", "size")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            sha, md5, error = hashlib.sha256(), hashlib.md5(usedforsecurity=False), None
            try:
                with open(path, "rb") as file:
                    while chunk := file.read(CHUNK):
                        sha.update(chunk)
                        md5.update(chunk)
            except OSError as problem:
                error = type(problem).__name__
            rows.append((path, None if error else sha.hexdigest(), None if error else md5.hexdigest(), error))
        yield pd.DataFrame(rows, columns=["path", "sha256", "md5", "error"])


def hashed(files: DataFrame) -> DataFrame:
    """``(path, sha256, md5, error)``: files are read in chunks where all executors see the path;
    one that cannot be read gets an error instead of digests."""
    return files.select("path").mapInPandas(_digests, "path string, sha256 string, md5 string, error string")


def hashed_content(spark: SparkSession, root: str) -> DataFrame:
    """The same from file contents read by Spark, for stores without local paths (files below 2 GiB,
    none of length 0)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def write_report(report: DataFrame, path: str) -> None:
    """One CSV file with a header, in the report's order."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def within_roots(df: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """Rows whose path lies below an allowed root; without roots there are none."""
    ok = F.lit(False)
    for root in roots:
        ok = ok | F.col(path).startswith(root.rstrip("/") + "/")
    return df.where(F.coalesce(ok, F.lit(False)))


def checked_upload(files: DataFrame, size: str, cap: int) -> DataFrame:
    """The files, if their sizes together stay within ``cap`` bytes (0: no cap)."""
    if cap > 0:
        total = files.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        if total > cap:
            raise ValueError(f"upload of {total} bytes exceeds {cap}")
    return files


def session_allowed(active: int, cap: int) -> bool:
    """Whether one more session may start; a cap of 0 is none."""
    return cap <= 0 or active < cap


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><canvas id="c" width="900" height="900"></canvas><script>
const points = {points}, c = document.getElementById("c").getContext("2d"); let a = 0.5, b = 0.3;
function draw() {{ c.clearRect(0, 0, 900, 900); for (const [, x, y, z] of points) {{
  const u = x * Math.cos(a) + z * Math.sin(a), w = z * Math.cos(a) - x * Math.sin(a), v = y * Math.cos(b) - w * Math.sin(b);
  c.fillRect(450 + 400 * u, 450 - 400 * v, 3, 3); }} }}
document.onmousemove = e => {{ if (e.buttons) {{ a += e.movementX / 200; b += e.movementY / 200; draw(); }} }}; draw();
</script>"""


def scatter_page(points: DataFrame, title: str = "points", most: int = 5000) -> str:
    """A page of its own that shows up to ``most`` points ``(id, x, y, z)``, to be turned with the mouse."""
    rows = [[r["id"], *(round(float(r[a]), 5) for a in "xyz")] for r in points.limit(most).toLocalIterator()]
    # a closing tag inside the data must not end the script
    return _PAGE.format(title=html.escape(title), points=json.dumps(rows).replace("<", "\\u003c"))
