"""Stable seeds, keys and fingerprints."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_seed(*parts: object) -> int:
    """A 32-bit seed of the parts: BLAKE2b over their text, joined by ``|``."""
    digest = hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") % 2**32


def stable_seed_column(*parts: Column) -> Column:
    """:func:`stable_seed` of columns. Spark has no BLAKE2b, hence the vectorised UDF."""

    @F.pandas_udf("bigint")
    def seeds(text: pd.Series) -> pd.Series:
        return text.map(stable_seed)

    return seeds(F.concat_ws("|", *[p.cast("string") for p in parts]))


def canonical_hash(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def pixel_sha256(mode: Column, width: Column, height: Column, pixels: Column) -> Column:
    """Digest of mode, size and pixel bytes, so that a reshaped image differs."""
    head = F.concat(mode, F.concat_ws("x", width.cast("string"), height.cast("string")))
    return F.sha2(F.concat(head.cast("binary"), pixels), 256)


def image_key(path: Column) -> Column:
    """A file-name-safe stem, then 16 hex digits of the path's digest."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")
    return F.concat(safe, F.lit("__"), F.substring(F.sha2(path, 256), 1, 16))


def folded(name: Column) -> Column:
    """Names that differ in case only are one name."""
    return F.lower(name)


def threshold_column(t: float) -> str:
    return f"fraction_ge_{t:.2f}".replace(".", "_")
