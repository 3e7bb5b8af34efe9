"""Content keys, fingerprints and request hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the accepted content types.
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/tiff": "tiff"}


def extension(content_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(known, content_type), F.lit("bin"))


def original_key(checksum: Column, content_type: Column) -> Column:
    """K1: originals/aa/bb/<checksum>.<ext>."""
    return F.concat(F.lit("originals/"), F.substring(checksum, 1, 2), F.lit("/"), F.substring(checksum, 3, 2), F.lit("/"), checksum, F.lit("."), extension(content_type))


def derivative_key(asset_id: Column, purpose: str, params: str, content_type: Column) -> Column:
    """K2: derivatives/<last two>/<asset>/<purpose>/<16 of the params hash>.<ext>."""
    return F.concat(F.lit("derivatives/"), F.right(asset_id, F.lit(2)), F.lit("/"), asset_id, F.lit(f"/{purpose}/{params[:16]}."), extension(content_type))


def params_hash(purpose: str, version: str, params: dict[str, object]) -> str:
    """K3: the hash of a derivative's parameters; sorted, so their order does not matter."""
    parts = [purpose, version, *(f"{k}={v!r}" for k, v in sorted(params.items()))]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def fingerprint(owner: Column, checksums: Column) -> Column:
    """What was asked for: owner, number and sorted checksums (an array)."""
    return F.sha2(F.concat_ws("|", owner, F.size(checksums).cast("string"), F.array_join(F.array_sort(checksums), "|")), 256)


def request_hash(*parts: Column) -> Column:
    """K4, K5: the hash of ordered request parts; nulls are left out."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def prompt_checksum(system: str, template: str, schema: str) -> str:
    """K6: twelve hexadecimal digits over three parts, each closed by a NUL."""
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in (system, template, schema))).hexdigest()[:12]
