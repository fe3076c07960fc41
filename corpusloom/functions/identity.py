"""Identifiers and fingerprints: SHA-256 over parts joined by a separator that cannot stand inside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, NUL = "\x1f", "\x00"
#: Prefixes of published identifiers.
PUBLIC_PREFIXES = {
    "assertion": "ast", "citation": "cit", "correction": "cor", "decision": "dec", "edge": "edg", "entity": "ent",
    "grammar-part": "grp", "observation": "obs", "phoneme-segment": "phs", "source": "src", "source-entry": "sen", "slot": "slt",
}


def digest(text: Column) -> Column:
    return F.sha2(text.cast("string").cast("binary"), 256)


def opaque_id(kind: str, *values: Column) -> Column:
    """kind-<16 hex digits> of the values as text, joined by NUL."""
    return F.concat(F.lit(f"{kind}-"), F.substring(digest(F.concat_ws(NUL, *[F.coalesce(v.cast("string"), F.lit("None")) for v in values])), 1, 16))


def public_id(kind: str, value: Column, namespace: str = "public-v1") -> Column:
    """An identifier for publication, from which the private value cannot be read: prefix and 32 hex digits."""
    return F.concat(F.lit(f"{PUBLIC_PREFIXES[kind]}_"), F.substring(digest(F.concat(F.lit(f"{namespace}{NUL}{kind}{NUL}"), value.cast("string"))), 1, 32))


def stable_id(prefix: str, *values: Column, length: int = 24) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(digest(F.concat_ws(UNIT, *values)), 1, length))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of the named columns; give them in order of their names."""
    return digest(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def hash_offset(material: Column, n: Column) -> Column:
    """The first eight bytes of a SHA-256, as an unsigned big-endian number, modulo n: a deterministic draw."""
    number = F.conv(F.substring(digest(material), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, n.cast("decimal(20,0)")).cast("bigint")


def occurrence_key(surface: Column, ordinal: Column, times: Column) -> Column:
    """A part's occurrence: by its surface if that stands once in the word, else by its ordinal."""
    return F.when(times == 1, F.concat(F.lit("span:"), surface)).otherwise(F.concat(F.lit("ordinal:"), ordinal.cast("string")))
