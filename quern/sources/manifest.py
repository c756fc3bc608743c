"""Manifests that are read strictly: pinned by digest, without repeated keys."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import SparkSession


class ManifestError(ValueError):
    """A manifest that is not there, not the pinned one, or no plain JSON object."""


def canonical_sha256(value: Any) -> str:
    """The digest of a value's compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ManifestError("a key stands twice")
    return out


def parse_manifest(content: bytes, pinned: str | None = None) -> dict[str, Any]:
    """The object in ``content``; ``pinned`` is the SHA-256 that its bytes must have."""
    if pinned is not None and hashlib.sha256(content).hexdigest() != pinned:
        raise ManifestError("the manifest is not the pinned one")
    try:
        out = json.loads(content.decode("utf-8"), object_pairs_hook=_once, parse_constant=lambda c: (_ for _ in ()).throw(ManifestError(f"{c} is no JSON")))
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ManifestError(str(e)) from e
    if not isinstance(out, dict):
        raise ManifestError("a manifest is an object")
    return out


def load_manifest(spark: SparkSession, path: str, pinned: str | None = None, most: int = 16 << 20) -> dict[str, Any]:
    """The manifest in one file of at most ``most`` bytes, read by Spark, so that any store it knows will do."""
    rows = spark.read.format("binaryFile").load(path).where(f"length <= {most}").select("content").take(2)
    if len(rows) != 1:
        raise ManifestError("one file within the limit is needed")
    return parse_manifest(bytes(rows[0].content), pinned)
