"""Stable digests, pseudonyms and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUL = "\0"


def stable_digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by NUL; plain strings are literals."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(NUL, *columns), 256)


def rank_hash(seed: str, domain: str, value: Column) -> Column:
    """Domain-separated ordering key: uniform, reproducible, unrelated between domains."""
    return stable_digest(domain, seed, value)


def pseudonym(prefix: str, digest: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest, 1, length))


def task_id(manifest_sha256: Column, source_sha256: Column, sample_id: Column, salt: str) -> Column:
    """Labelling-task identifier that reveals nothing about the sample."""
    digest = F.sha2(F.concat_ws(":", manifest_sha256, source_sha256, sample_id, F.lit(salt)), 256)
    return pseudonym("label-", digest, 24)


def packed(text: Column) -> Column:
    """A text as bytes for a shuffle: lower-case hex, as of digests, takes half. `unpacked` gives any text back."""
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.lit(b"\1"), raw)).otherwise(F.concat(F.lit(b"\0"), text.cast("binary")))


def unpacked(raw: Column) -> Column:
    body = F.substring(raw, 2, 1 << 30)
    return F.when(F.substring(raw, 1, 1) == F.lit(b"\1"), F.lower(F.hex(body))).otherwise(body.cast("string"))


def packed_texts(df: DataFrame) -> DataFrame:
    """All columns of text packed, before rows are shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[packed(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in kinds.items()])


def unpacked_texts(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, whose texts were packed in `rows`."""
    kinds = {f.name: f.dataType.simpleString() for f in like.schema.fields}
    return rows.select(*[unpacked(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in kinds.items()])


def canonical_json(**columns: Column) -> Column:
    """Compact JSON with sorted keys that keeps nulls."""
    ordered = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_sha256(**columns: Column) -> Column:
    return F.sha2(canonical_json(**columns), 256)


def hash_uniform(digest: Column, start: int = 1, hex_digits: int = 8) -> Column:
    """A number in [0, 1) read from a slice of a hex digest."""
    number = F.conv(F.substring(digest, start, hex_digits), 16, 10).cast("double")
    return number / F.lit(float(16**hex_digits))
