"""Settings from the environment, with defaults and validation."""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass, fields
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

PREFIX = "SIGHTLINE_"


@dataclass(frozen=True)
class Settings:
    collection: str = "case"
    reference_collection: str | None = None
    tag_collection: str = "tags"
    normalize_size: int = 224
    copy_crops: int = 5
    extraction_fps: float = 1.0
    max_frames: int = 500
    duplicate_check: str = "hash"
    session_ttl_seconds: int = 3600
    max_sessions: int = 0
    max_upload_bytes: int = 0
    projection_points: int = 5000
    ignore_config_mismatch: bool = False
    model_semantic: str | None = None
    model_copy: str | None = None
    embedding_endpoint: str | None = None
    embedding_model: str | None = None
    embedding_dim: int = 0
    max_image_pixels: int = 178_956_970

    def __post_init__(self) -> None:
        if self.duplicate_check not in ("hash", "filepath", "both"):
            raise ValueError(f"duplicate_check: {self.duplicate_check!r}")
        if self.copy_crops not in (1, 5):
            raise ValueError("copy_crops must be 1 or 5")
        if self.extraction_fps <= 0 or self.max_frames < 0:
            raise ValueError("extraction_fps must be positive, max_frames not negative")
        if self.max_image_pixels < 0:
            raise ValueError("max_image_pixels must be positive, or 0 for no limit")

    def effective_model(self, local: str | None) -> str | None:
        """The model to load: the named one behind an endpoint, else ``local``."""
        if self.embedding_endpoint and not self.embedding_model:
            raise ValueError("an embedding endpoint needs an explicit embedding_model")
        return self.embedding_model if self.embedding_endpoint else local

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is None or (raw.strip() == "" and f.name != "reference_collection"):
                continue
            kind = str(f.type)
            text = raw.strip()
            if kind == "bool":
                if text.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
                    raise ValueError(f"{PREFIX}{f.name.upper()}: {raw!r} is no truth value")
                values[f.name] = text.lower() in ("1", "true", "yes", "on")
            elif kind == "int":
                values[f.name] = int(text)
            elif kind == "float":
                values[f.name] = float(text)
            else:
                values[f.name] = text or None
        return cls(**values)


# fixed values: files of a model folder that hold weights or configuration
CONTENT_SUFFIXES = (".safetensors", ".bin", ".json")


def content_hash(root: str) -> str:
    """Identity of a local model: a single file's bytes, or the names and bytes of a folder's content files in path order.

    Files of other kinds in the folder (notes, caches, locks) do not count.
    """
    base = Path(root)
    files = [base] if base.is_file() else sorted(p for p in base.rglob("*") if p.is_file() and p.suffix in CONTENT_SUFFIXES)
    if not base.exists():
        raise FileNotFoundError(root)
    digest = hashlib.sha256()
    for file in files:
        if file != base:
            digest.update(file.name.encode())
        with file.open("rb") as stream:
            while chunk := stream.read(1 << 20):
                digest.update(chunk)
    return digest.hexdigest()


def endpoint_hash(url: str, model: str, dim: int) -> str:
    """Identity of a model behind an endpoint: its configuration."""
    return "config:" + hashlib.sha256(f"{url.rstrip('/')}{model}{dim}".encode()).hexdigest()


def expected_hashes(settings: Settings, vectors: set[str]) -> dict[str, str]:
    """Model hashes that the settings would produce for the given vectors.

    Behind an endpoint all vectors share one hash, or have none while model or
    size are not named; a local model that cannot be read has none.
    """
    if settings.embedding_endpoint:
        if not settings.embedding_model or not settings.embedding_dim:
            return {}
        shared = endpoint_hash(settings.embedding_endpoint, settings.embedding_model, settings.embedding_dim)
        return dict.fromkeys(sorted(vectors), shared)
    found = {}
    for vector, path in (("dino", settings.model_semantic), ("sscd", settings.model_copy)):
        if vector in vectors and path:
            try:
                found[vector] = content_hash(path)
            except OSError:
                continue
    return found


def missing_models(settings: Settings) -> list[str]:
    """Local model paths that are set but not there: nothing is ever fetched, so these have to be brought first."""
    if settings.embedding_endpoint:
        return []
    return [p for p in (settings.model_semantic, settings.model_copy) if p and not Path(p).exists()]


def verified_model(path: str, expected: str) -> str:
    """The path, if its content has the expected hash; else an error."""
    found = content_hash(path)
    if found != expected:
        raise ValueError(f"{path} has the hash {found}, not {expected}")
    return path


# libraries whose versions are recorded with results
LIBRARIES = ("pyspark", "pyarrow", "numpy", "pandas", "pillow", "av")


def library_versions(libraries: tuple[str, ...] = LIBRARIES) -> dict[str, str]:
    """Version of Python and of each library, ``unknown`` where it is not installed."""
    found = {"python": sys.version}
    for name in libraries:
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            found[name] = "unknown"
    return found


def save_calibration(path: str, key: str, batch: int) -> None:
    """Remember a probed batch size; the file is replaced as a whole."""
    file = Path(path)
    known = load_calibrations(path) | {key: batch}
    file.parent.mkdir(parents=True, exist_ok=True)
    aside = file.with_suffix(".tmp")
    aside.write_text(json.dumps(known))
    aside.replace(file)


def load_calibrations(path: str) -> dict[str, int]:
    """Known batch sizes; an unreadable file or a value that is no positive integer counts as unknown."""
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in raw.items() if isinstance(v, int) and not isinstance(v, bool) and v > 0} if isinstance(raw, dict) else {}


def checked_tag(name: str, notes: str = "", ids: str = "") -> tuple[str, str, list[str]]:
    """A tag's name (1 to 200 characters), notes (up to 4000) and comma separated ids, stripped."""
    name, notes = name.strip(), notes.strip()
    if not name or len(name) > 200:
        raise ValueError("a tag's name has 1 to 200 characters")
    if len(notes) > 4000:
        raise ValueError("a tag's notes have at most 4000 characters")
    return name, notes, [x.strip() for x in ids.split(",") if x.strip()]
