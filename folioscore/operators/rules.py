"""Rule-driven validation: every rule is a named predicate, failures become an array."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioscore import vocab
from folioscore.functions.text import normalize_slices, strip


class InvalidRows(ValueError):
    """Raised by `require_valid` when at least one row broke a rule."""


@dataclass(frozen=True)
class Rule:
    code: str
    holds: Column


def broken_rules(rules: Sequence[Rule]) -> Column:
    """The sorted codes of the broken rules; a null predicate counts as broken."""
    broken = [F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.code)) for r in rules]
    return F.array_sort(F.array_compact(F.array(*broken)))


def validate(df: DataFrame, rules: Sequence[Rule], errors: str = "errors") -> DataFrame:
    """Adds the sorted codes of the broken rules."""
    return df.withColumn(errors, broken_rules(rules))


def valid_rows(checked: DataFrame, errors: str = "errors") -> DataFrame:
    return checked.filter(F.size(errors) == 0).drop(errors)


def rejected_rows(checked: DataFrame, errors: str = "errors") -> DataFrame:
    return checked.filter(F.size(errors) > 0)


def require_valid(checked: DataFrame, errors: str = "errors") -> DataFrame:
    """Fail closed: raise on the first broken row, else return the checked rows."""
    first = rejected_rows(checked, errors).select(errors).head()
    if first is not None:
        raise InvalidRows(f"rows break rules: {', '.join(first[0])}")
    return valid_rows(checked, errors)


def require_empty(df: DataFrame, message: str) -> None:
    """Raise when a frame of offending rows has any row."""
    if not df.isEmpty():
        raise InvalidRows(message)


def violations(checked: DataFrame, *keys: str, errors: str = "errors") -> DataFrame:
    """One row per broken rule."""
    return checked.select(*keys, F.explode(errors).alias("code"))


# --- predicates -------------------------------------------------------------------------


def required_string(c: Column, allow_empty: bool = False) -> Column:
    return c.isNotNull() if allow_empty else c.isNotNull() & (strip(c) != "")


def is_sha256(c: Column, fold_case: bool = True) -> Column:
    return (F.lower(c) if fold_case else c).rlike(vocab.SHA256_HEX)


def optional_number(c: Column, lo: float = float("-inf"), hi: float = float("inf")) -> Column:
    """Null, or finite and inside the closed bounds."""
    value = c.cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return c.isNull() | (finite & (value >= F.lit(lo)) & (value <= F.lit(hi)))


def clean_slices(c: Column) -> Column:
    """Null, or an array without null or blank tags."""
    return c.isNull() | ~F.exists(c, lambda t: t.isNull() | (strip(t) == ""))


def safe_basename(c: Column) -> Column:
    """A file name without any directory part."""
    return required_string(c) & ~c.contains("/") & ~c.isin("..", ".")


def safe_relative_path(c: Column) -> Column:
    """A relative path that never climbs out of its folder."""
    return required_string(c) & ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..")


def in_vocabulary(c: Column, allowed: Sequence[str]) -> Column:
    return c.isin(*allowed)


def controlled_slices(c: Column, allowed: Sequence[str]) -> Column:
    """Sorted, distinct and inside the vocabulary."""
    known = F.size(F.array_except(c, F.array(*[F.lit(a) for a in allowed]))) == 0
    return known & (c == normalize_slices(c))


def no_boundary_space(c: Column) -> Column:
    return required_string(c) & (c == strip(c))


def https_url(c: Column) -> Column:
    host = F.try_parse_url(c, F.lit("HOST"))
    return (F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & host.isNotNull()


def is_role(c: Column) -> Column:
    return c.rlike(vocab.ROLE) & ~c.isin(*vocab.PLACEHOLDER_ROLES)


def keys_match(raw_json: Column, required: Sequence[str], optional: Sequence[str] = ()) -> Column:
    """Top-level keys of a JSON object: all required, none outside required + optional."""
    keys = F.json_object_keys(raw_json)
    need = F.array(*[F.lit(k) for k in required])
    may = F.array(*[F.lit(k) for k in [*required, *optional]])
    return (F.size(F.array_except(need, keys)) == 0) & (F.size(F.array_except(keys, may)) == 0)


def valid_bbox(box: Column, width: Column | None = None, height: Column | None = None) -> Column:
    left, top, right, bottom = (box[i] for i in range(4))
    ok = (F.size(box) == 4) & (left >= 0) & (top >= 0) & (right > left) & (bottom > top)
    if width is not None:
        ok = ok & (right <= width)
    if height is not None:
        ok = ok & (bottom <= height)
    return ok


# --- rule sets -----------------------------------------------------------------------------


def evaluation_record_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("sample_id", required_string(c("sample_id"))),
        Rule("source_sha256", is_sha256(c("source_sha256"))),
        Rule("reference", required_string(c("reference"), allow_empty=True)),
        Rule("prediction", required_string(c("prediction"), allow_empty=True)),
        Rule("confidence", optional_number(c("confidence"), 0.0, 1.0)),
        Rule("latency_ms", optional_number(c("latency_ms"), 0.0)),
        Rule("cost_per_page_usd", optional_number(c("cost_per_page_usd"), 0.0)),
        Rule("slices", clean_slices(c("slices"))),
    ]


def manifest_record_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("schema_version", c("schema_version") == 2),
        Rule("sample_type", c("sample_type") == "line"),
        *[
            Rule(name, required_string(c(name)))
            for name in ("sample_id", "reference", "writer_id", "image_path")
        ],
        Rule("source_sha256", is_sha256(c("source_sha256"), fold_case=False)),
        Rule("image_path_safe", safe_relative_path(c("image_path"))),
        Rule("split", in_vocabulary(c("split"), vocab.SPLITS)),
        Rule("slices", c("slices").isNotNull() & clean_slices(c("slices"))),
    ]


def protected_label_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("filename", c("filename").rlike(vocab.SAMPLE_FILENAME)),
        Rule("text", no_boundary_space(c("text"))),
        Rule("writer_id", c("writer_id").rlike(vocab.WRITER_ID)),
        Rule("age_band", in_vocabulary(c("age_band"), vocab.AGE_BANDS)),
        Rule("document_type", in_vocabulary(c("document_type"), vocab.DOCUMENT_TYPES)),
        Rule("capture_type", in_vocabulary(c("capture_type"), vocab.CAPTURE_TYPES)),
        Rule("slices", controlled_slices(F.split("slices", r"\|"), vocab.PROTECTED_SLICES)),
    ]


def dataset_identity_rules() -> list[Rule]:
    c = F.col
    return [
        *[Rule(n, required_string(c(n))) for n in ("name", "version", "license_id")],
        Rule("license_url", https_url(c("license_url"))),
        Rule("sample_type", in_vocabulary(c("sample_type"), vocab.SAMPLE_TYPES)),
    ]


# --- whole-table rules -----------------------------------------------------------------------


def optional_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per optional column: filled for all rows, for none, or (not ok) for some."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    fields = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).alias("populated")) for c in columns]
    )
    return counts.select("n", F.explode(fields).alias("f")).select(
        "f.field", "f.populated", "n", F.col("f.populated").isin(0, F.col("n")).alias("complete")
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, counted before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def drift(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Fields whose value differs between two tables of the same keys, one row each."""
    left = expected.select(*keys, F.struct(*fields).alias("_want"))
    right = actual.select(*keys, F.struct(*fields).alias("_got"), F.lit(True).alias("_seen"))
    joined = left.join(right, list(keys), "left")
    entries = [
        F.when(
            F.col("_seen").isNull() | ~F.col(f"_want.{f}").eqNullSafe(F.col(f"_got.{f}")),
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"_want.{f}").cast("string").alias("expected"),
                F.col(f"_got.{f}").cast("string").alias("actual"),
            ),
        )
        for f in fields
    ]
    return joined.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("d")).select(
        *keys, "d.*"
    )
