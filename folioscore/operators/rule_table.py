"""Rules as rows: documents of any shape are checked by a table of (path, kind, bounds).

A document is parsed once into a VARIANT, so nothing about its shape is fixed in code. All rules run
in one expression per document, without a join: the rule table is configuration of bounded size and
every rule becomes a condition of its own, whose path and pattern are constants that are parsed once
and not again for every document. A value must have the JSON type of its rule, so "true" is
not true and 1.0 is not a whole number. Keys that no rule knows are found at any depth.

Defined results: text that is no JSON object breaks `document` alone; a missing or null value breaks
its rule; rules of one path are all reported, under the path, or under `code` if a rule has one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscore.functions.text import utc_timestamp

MOST_RULES = 2_000
RULES = "path string, kind string, text string, low double, high double, options array<string>, code string"


class Row(NamedTuple):
    """One rule; `rule_frame` makes a table of them."""

    path: str
    kind: str
    text: str | None = None
    low: float | None = None
    high: float | None = None
    options: list[str] | None = None
    code: str | None = None


KINDS = {
    "text": "a string equal to `text`", "number": "a number equal to `low`", "true": "true", "false": "false",
    "whole": "a whole number from `low` to `high`", "inside": "a number between `low` and `high`, both excluded",
    "pattern": "a string that matches `text`", "one_of": "a string among `options`", "json": "a value whose JSON is `text`",
    "past": "a time with zone, not in the future", "sum": "the numbers at `options` add up to `low`",
    "any": "any value but null; makes the key known", "optional": "makes the key known",
}


def rule_frame(spark: SparkSession, rules: Sequence[Row]) -> DataFrame:
    number = lambda v: None if v is None else float(v)
    return spark.createDataFrame([tuple(r._replace(low=number(r.low), high=number(r.high))) for r in rules], RULES)


def _holds(document: Column, rule, now: Column) -> Column:
    at = f"$.{rule['path']}"
    value = F.try_variant_get(document, at, "string")
    kind = F.schema_of_variant(F.try_variant_get(document, at, "variant"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), value.try_cast("double"))
    text, low, high = F.lit(rule["text"]).cast("string"), F.lit(rule["low"]).cast("double"), F.lit(rule["high"]).cast("double")
    options = rule["options"] or []
    string, name = kind == "STRING", rule["kind"]
    if name == "text":
        return string & (value == text)
    if name == "number":
        return number == low
    if name in ("true", "false"):
        return (kind == "BOOLEAN") & (value == name)
    if name == "whole":
        return (kind == "BIGINT") & number.between(low, high)
    if name == "inside":
        return (number > low) & (number < high)
    if name == "pattern":
        return string & F.regexp_like(value, text)
    if name == "one_of":
        return string & value.isin(options)
    if name == "json":
        return value == text
    if name == "past":
        return string & (utc_timestamp(value) <= now)
    if name == "sum":
        total = F.lit(0.0)
        for p in options:
            total = total + F.try_variant_get(document, f"$.{p}", "double")
        return F.abs(total - low) <= 1e-9
    return value.isNotNull() if name == "any" else F.lit(True)


def _known(rules: Sequence) -> dict[str, set[str]]:
    """For every object on the way to a rule's value: the names that may be in it."""
    known: dict[str, set[str]] = {"": set()}
    for rule in rules:
        if rule["kind"] == "sum":
            continue
        at = ""
        for name in rule["path"].split("."):
            known.setdefault(at, set()).add(name)
            at = f"{at}.{name}" if at else name
    return known


def _under(at: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(f"{at}." if at else ""), n))


def check_documents(documents: DataFrame, rules: DataFrame, raw: str = "document", now: Column | None = None) -> DataFrame:
    """The other columns of `documents` with `errors` (sorted) and `unknown` (paths, sorted)."""
    listed = rules.limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"a rule table has at most {MOST_RULES} rows")
    wrong = sorted({r["kind"] for r in listed} - set(KINDS))
    if wrong:
        raise ValueError(f"unknown kinds of rules: {', '.join(wrong)}")
    now = F.current_timestamp() if now is None else now
    text = F.col(raw)
    parsed = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(_holds(F.col("_variant"), r, now), F.lit(False)), F.lit(r["code"] or r["path"])) for r in listed
    ]).cast("array<string>"))
    extra = []
    for at, names in _known(listed).items():
        own = F.json_object_keys(F.get_json_object(text, f"$.{at}") if at else text)
        unknown = F.array_except(F.coalesce(own, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in sorted(names)]))
        extra.append(_under(at, unknown))
    keys = [c for c in documents.columns if c != raw]
    prepared = documents.select(*keys, text.alias(raw), F.when(is_object, parsed).alias("_variant"))
    return prepared.select(
        *keys,
        F.when(F.col("_variant").isNull(), F.array(F.lit("document"))).otherwise(
            F.array_sort(F.array_distinct(broken))
        ).alias("errors"),
        F.when(F.col("_variant").isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.flatten(F.array(*extra)))).alias("unknown"),
    )
