"""Content hashes and stable identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of name-based UUIDs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def content_hash(chunk: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(chunk, 256), 1, 16)


def name_uuid(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    # The two top bits of the ninth byte carry the variant: 10xxxxxx.
    low_bits = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 64
    variant = F.lower(F.hex(low_bits + 128))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def point_uuid(id_: Column) -> Column:
    """A UUID stays as it is; any other id maps to its name-based UUID."""
    return F.when(id_.rlike(UUID_PATTERN), id_).otherwise(name_uuid(id_))


def content_hex(content: Column) -> Column:
    return F.lower(F.hex(F.encode(content, "UTF-8")))


def document_id(id_: Column, content: Column, style: str = "uuid") -> Column:
    """Fill an empty id from the content, so that retries give the same id."""
    if style not in ("uuid", "hex", "random"):
        raise ValueError(f"unknown id style: {style}")
    made = {"uuid": name_uuid(content), "hex": content_hex(content), "random": F.uuid()}[style]
    return F.coalesce(F.nullif(id_, F.lit("")), made)


def collection_name(project_id: Column) -> Column:
    """``project_`` plus the letters, digits, ``_`` and ``-`` of the id."""
    # ``\w`` is A-Z, a-z, 0-9 and ``_`` here; spelt out, or matched one by one,
    # the same class takes about twenty times as long.
    kept = F.regexp_replace(project_id, r"[^\w-]+", "")
    return F.concat(
        F.lit("project_"),
        F.coalesce(F.nullif(kept, F.lit("")), F.substring(F.sha2(project_id, 256), 1, 16)),
    )


def project_of_collection(name: Column) -> Column:
    """Inverse of the prefix; null for names outside the scheme."""
    return F.when(name.startswith("project_"), F.substr(name, F.lit(9)))
