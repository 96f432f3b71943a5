"""Embedding as a column: models are plug-ins, loaded once per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import Scratch
from sightline.settings import endpoint_hash


class Embedder(Protocol):
    """What a model must offer; ``embed`` gets whole batches and may raise per batch."""

    name: str
    dim: int

    def identity(self) -> str: ...

    def embed(self, contents: list[bytes]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic stand-in without weights: a unit vector from the content's digest."""

    name = "hash"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def identity(self) -> str:
        return hashlib.sha256(f"{self.name}:{self.dim}".encode()).hexdigest()

    def embed(self, contents: list[bytes]) -> list[list[float]]:
        import numpy as np

        out = []
        for content in contents:
            seed = int.from_bytes(hashlib.sha256(content).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(self.dim)
            out.append((v / np.linalg.norm(v)).astype("float32").tolist())
        return out


FACTORIES: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder}


def embedder(kind: str, **options) -> Embedder:
    if kind not in FACTORIES:
        raise ValueError(f"unknown embedder {kind!r}; known: {', '.join(sorted(FACTORIES))}")
    return FACTORIES[kind](**options)


def embedded(files: DataFrame, content: str, make: Callable[[], Embedder]) -> DataFrame:
    """Adds ``vector`` and ``embed_error``; a failing item has an error and no vector, the others go on."""

    @F.pandas_udf("struct<vector: array<float>, embed_error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        def one(content: bytes | None) -> tuple:
            if content is None:
                return None, "no content"
            try:
                (vector,) = model.embed([content])
                return (vector, None) if len(vector) == model.dim else (None, f"{len(vector)} values, not {model.dim}")
            except Exception as problem:  # one item must not end the batch
                return None, f"{type(problem).__name__}: {problem}"

        for contents in batches:
            items = list(contents)
            try:
                whole = [c for c in items if c is not None]
                vectors = iter(model.embed(whole))
                rows = [(None, "no content") if c is None else (next(vectors), None) for c in items]
                if any(v is not None and len(v) != model.dim for v, _ in rows):
                    raise ValueError("size")
            except Exception:
                rows = [one(c) for c in items]
            yield pd.DataFrame(rows, columns=["vector", "embed_error"])

    return files.withColumn("_e", run(F.col(content))).select(*files.columns, "_e.vector", "_e.embed_error")


class CropEmbedder:
    """Mean of the unit vectors of a picture's crops, at length one: around any model that takes crops.

    A picture is decoded, its shorter side brought to the fixed length, and cut
    into the centre crop or the centre and the corners.
    """

    def __init__(self, inner: Embedder, crops: int = 5, decoder: Callable | None = None):
        if crops not in (1, 5):
            raise ValueError("crops must be 1 or 5")
        from sightline.operators.decode import NetpbmDecoder

        self.inner, self.crops, self.decoder = inner, crops, (decoder or NetpbmDecoder)()
        self.name, self.dim = inner.name, inner.dim

    def identity(self) -> str:
        return self.inner.identity()

    def embed(self, contents: list[bytes]) -> list[list[float]]:
        import numpy as np

        from sightline.operators.decode import cropped, netpbm

        parts = [[netpbm(c) for c in cropped(self.decoder.decode(content), self.crops)] for content in contents]
        vectors = iter(self.inner.embed([c for p in parts for c in p]))
        out = []
        for p in parts:
            v = np.array([next(vectors) for _ in p], np.float64)
            mean = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).mean(0)
            out.append((mean / max(np.linalg.norm(mean), 1e-12)).astype("float32").tolist())
        return out


def checked_response(data: list[dict], count: int, dim: int) -> list[list[float]]:
    """Vectors of a remote answer in request order; a missing, repeated or misshaped item is an error."""
    by_index: dict[int, list[float]] = {}
    for item in data:
        index, vector = item.get("index"), item.get("embedding")
        if not isinstance(index, int) or not 0 <= index < count or index in by_index:
            raise ValueError(f"unexpected index {index!r} in the answer")
        if not isinstance(vector, list) or len(vector) != dim:
            raise ValueError(f"item {index} has no vector of {dim} values")
        by_index[index] = [float(x) for x in vector]
    if len(by_index) != count:
        raise ValueError(f"{len(by_index)} vectors for {count} items")
    return [by_index[i] for i in range(count)]


def picture_kind(content: bytes) -> str:
    """Media type of a picture by its first bytes."""
    for start, kind in ((b"\x89PNG", "image/png"), (b"\xff\xd8", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff")):
        if content.startswith(start):
            return kind
    return "image/webp" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else "application/octet-stream"


class RemoteEmbedder:
    """Vectors from an endpoint that takes ``{model, input: [data URLs]}``; the model must be named.

    Pictures go out as they are, under their own media type.  A refusal is an
    error that carries the answer's text.
    """

    def __init__(self, url: str, model: str, dim: int, timeout: float = 30.0, key: str | None = None):
        if not model.strip():
            raise ValueError("a remote endpoint needs an explicit model name")
        self.url, self.name, self.dim, self.timeout, self.key = url.rstrip("/"), model, dim, timeout, key

    def identity(self) -> str:
        return endpoint_hash(self.url, self.name, self.dim)

    def embed(self, contents: list[bytes]) -> list[list[float]]:
        import base64
        import json
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        if not contents:
            return []
        body = {"model": self.name, "input": [f"data:{picture_kind(c)};base64," + base64.b64encode(c).decode() for c in contents]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urlopen(Request(f"{self.url}/v1/embeddings", json.dumps(body).encode(), head), timeout=self.timeout) as answer:  # noqa: S310
                return checked_response(json.load(answer)["data"], len(contents), self.dim)
        except HTTPError as refusal:
            raise RuntimeError(f"the endpoint answered {refusal.code}: {refusal.read().decode(errors='replace')[:500]}") from refusal


FACTORIES["remote"] = RemoteEmbedder


def analysed(uploads: DataFrame, models: dict[str, Callable[[], Embedder]]) -> tuple[DataFrame, DataFrame]:
    """Files and query vectors of an upload session, ready for the session search.

    ``uploads(file_id, content, is_video, query_timecode_ms)`` has one row per
    image and one per frame of a video (whose ``file_hash`` is then given).  A
    file has an error if all its rows fail in some mode.  Returns
    ``files(file_id, is_video, error, file_hash, file_hash_md5)`` and
    ``vectors(q_id, file_id, mode, query_timecode_ms, vec)``.
    """
    given = F.col("file_hash") if "file_hash" in uploads.columns else F.lit(None).cast("string")
    base = uploads.withColumns({"file_hash": F.coalesce(given, F.sha2("content", 256)), "file_hash_md5": F.md5("content")})
    vectors, errors, scratch = None, None, Scratch(uploads.sparkSession)
    for number, (mode, make) in enumerate(models.items()):
        # written once: vectors and errors both read it, the model runs a single time
        kept = [c for c in base.columns if c != "content"]
        done = scratch.write(embedded(base, "content", make).select(*kept, "vector", "embed_error"), "embedded")
        key = F.xxhash64("file_id", F.coalesce("query_timecode_ms", F.lit(-1).cast("bigint")), F.lit(number))
        v = done.where("vector is not null").select(key.alias("q_id"), "file_id", F.lit(mode).alias("mode"), "query_timecode_ms", F.col("vector").alias("vec"))
        e = done.groupBy("file_id").agg(F.when(F.count("vector") == 0, F.min("embed_error")).alias("error"))
        vectors, errors = (v, e) if vectors is None else (vectors.union(v), errors.union(e))
    failed = errors.groupBy("file_id").agg(F.min("error").alias("error")) if errors is not None else uploads.select("file_id", F.lit(None).cast("string").alias("error")).distinct()
    files = base.groupBy("file_id").agg(F.bool_or("is_video").alias("is_video"), F.min("file_hash").alias("file_hash"), F.min("file_hash_md5").alias("file_hash_md5"))
    return files.join(failed, "file_id").select("file_id", "is_video", "error", "file_hash", "file_hash_md5"), vectors


def probe_batches(run: Callable[[int], float], largest: int = 256) -> list[tuple[int, float]]:
    """Throughput of doubled batch sizes until saturation, decay, a plateau or an error: ``(batch, items per second)``."""
    from statistics import median, pstdev

    from sightline.operators.stats import MIN_GAIN, PEAK_DROPS, PEAK_SHARE, PLATEAU_CV, PLATEAU_WINDOW

    measured: list[tuple[int, float]] = []
    batch = 1
    while batch <= largest:
        try:
            rate = median(batch / max(run(batch), 1e-9) for _ in range(3))
        except (MemoryError, RuntimeError):
            break
        measured.append((batch, rate))
        rates = [t for _, t in measured]
        saturated = len(rates) > 1 and 0 <= (rates[-1] - rates[-2]) / rates[-2] < MIN_GAIN
        decayed = len(rates) >= PEAK_DROPS and all(t < PEAK_SHARE * max(rates) for t in rates[-PEAK_DROPS:])
        window = rates[-PLATEAU_WINDOW:]
        settled = len(rates) > PLATEAU_WINDOW and pstdev(window) / (sum(window) / len(window)) < PLATEAU_CV
        if saturated or decayed or settled:
            break
        batch *= 2
    return measured
