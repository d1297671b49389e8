"""Readers for every input file: fixed schemas, strict checks, nothing inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscore import schemas, vocab
from folioscore.functions.text import normalize_reference, parse_slices, strip, utc_timestamp
from folioscore.operators.rules import (
    InvalidRows, Rule, evaluation_record_rules, keys_match, manifest_record_rules, validate,
)

_RAW = "_corrupt_record"


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One column `raw` with the line and the parsed fields; blank lines are skipped.

    Lines that are no JSON object, or hold a value of the wrong type, set `_corrupt_record`.
    """
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = F.from_json(
        "value", f"{schema}, {_RAW} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
    )
    return lines.select(F.col("value").alias("raw"), parsed.alias("d")).select("raw", "d.*")


def _well_formed() -> Rule:
    is_object = F.json_object_keys("raw").isNotNull()
    return Rule("json", F.col(_RAW).isNull() & is_object)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise InvalidRows(f"{what} contains no records")
    return df


def prediction_records(spark: SparkSession, path: str) -> DataFrame:
    """Prediction JSONL with an `errors` column; `require_valid` makes it strict."""
    rows = _json_lines(spark, path, schemas.EVALUATION_RECORD)
    checked = validate(rows, [_well_formed(), *evaluation_record_rules()])
    return checked.drop("raw", _RAW)


def manifest_records(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Manifest JSONL with an `errors` column, or one split of it."""
    rows = _json_lines(spark, path, schemas.MANIFEST)
    checked = validate(rows, [_well_formed(), *manifest_record_rules()]).drop("raw", _RAW)
    return checked.filter(F.col("split") == split) if split else checked


def reference_free_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions without references; any key outside the allow-list is an error."""
    rows = _json_lines(spark, path, schemas.REFERENCE_FREE)
    allowed = keys_match(F.col("raw"), vocab.REFERENCE_FREE_REQUIRED, vocab.REFERENCE_FREE_OPTIONAL)
    return validate(rows, [_well_formed(), Rule("fields", allowed)]).drop("raw", _RAW)


def ledger_events(spark: SparkSession, path: str) -> DataFrame:
    """Lifecycle events with exact keys and UTC timestamps."""
    rows = _json_lines(spark, path, schemas.LEDGER_EVENT)
    return ledger_rows(rows)


def ledger_rows(rows: DataFrame) -> DataFrame:
    occurred, recorded = utc_timestamp(F.col("occurred_at")), utc_timestamp(F.col("recorded_at"))
    checked = validate(
        rows,
        [
            _well_formed(),
            Rule("fields", keys_match(F.col("raw"), vocab.EVENT_COLUMNS)),
            Rule("occurred_at", occurred.isNotNull()),
            Rule("recorded_at", recorded.isNotNull()),
        ],
    ).drop("raw", _RAW)
    return checked.withColumns({"occurred_at": occurred, "recorded_at": recorded})


def _csv(spark: SparkSession, path: str, schema: str, exact_header: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    # With enforceSchema off, Spark compares the header with the schema and fails on a difference.
    return reader.option("enforceSchema", not exact_header).schema(schema).csv(path)


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labels with the tags as an array; the `slices` column may be missing in the file."""
    header = spark.read.option("header", True).csv(path).columns
    missing = {"filename", "text", "writer_id"} - set(header)
    if missing:
        raise InvalidRows(f"labels lack the columns {sorted(missing)}")
    schema = ", ".join(f"{name} string" for name in header)
    rows = _csv(spark, path, schema, exact_header=True)
    tags = parse_slices(F.col("slices")) if "slices" in header else F.array().cast("array<string>")
    return rows.select("filename", "text", "writer_id", tags.alias("slices"))


def protected_label_rows(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.PROTECTED_LABELS, exact_header=True)


def review_rows(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.REVIEWS, exact_header=True)


def with_existing_files(rows: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """Rows whose file exists."""
    return rows.join(files.select(key), key, "left_semi")


def loose_labels(labels: DataFrame, files: DataFrame) -> DataFrame:
    """Labels whose image exists; an absent writer becomes `unknown`."""
    kept = with_existing_files(labels, files)
    return kept.withColumn("writer_id", F.coalesce("writer_id", F.lit("unknown")))


def line_index(lines: DataFrame) -> DataFrame:
    """Rows of a space-separated line index (`value`): accepted lines with text and paths."""
    parts = F.split(strip(F.col("value")), " ")
    rows = (
        lines.filter(~F.col("value").startswith("#"))
        .withColumn("p", parts)
        .filter((F.size("p") >= 9) & (F.col("p")[1] == "ok"))
    )
    ids = F.split(F.col("p")[0], "-")
    text = F.translate(F.array_join(F.slice("p", 9, F.size("p")), " "), "|", " ")
    return rows.select(
        F.col("p")[0].alias("line_id"),
        text.alias("text"),
        ids[0].alias("writer_id"),
        F.concat(
            F.lit("lines/"), ids[0], F.lit("/"), ids[0], F.lit("-"), ids[1], F.lit("/"),
            F.col("p")[0], F.lit(".png"),
        ).alias("image_path"),
    )


def page_words(pages: DataFrame, stem: Column) -> DataFrame:
    """Words of page annotations (`writer_id`, `words`), one row each."""
    return pages.select(stem.alias("stem"), "writer_id", F.explode("words").alias("w")).select(
        F.concat(F.lit("crops/"), "stem", F.lit("_"), F.col("w.id").cast("string"), F.lit(".png")).alias("image_path"),
        F.col("w.text").alias("text"),
        F.coalesce("writer_id", F.lit("unknown")).alias("writer_id"),
    )


def page_word_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from a folder of JSON files, one per page."""
    pages = spark.read.schema(schemas.PAGE_WORDS).option("multiLine", True).json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return page_words(pages, stem)


def corpus_index(lines: DataFrame, pattern: str = vocab.CORPUS_INDEX_LINE) -> DataFrame:
    """Rows of `NNNN-NNN,threshold text` (`value`) with an `errors` column.

    Samples whose normalised reference is empty are kept and marked not usable.
    """
    field = lambda i: F.regexp_extract("value", pattern, i)
    threshold = F.expr("try_cast(threshold_text as int)")
    rows = lines.select(
        "value",
        field(1).alias("sample_id"),
        field(2).alias("threshold_text"),
        field(3).alias("reference"),
    ).withColumns(
        {
            "writer_id": F.substring_index("sample_id", "-", 1),
            "threshold": threshold,
            "marked": F.contains("reference", F.lit("#")),
        }
    )
    rows = rows.withColumn("normalized_reference", normalize_reference(F.col("reference")))
    rules = [
        Rule("syntax", F.col("sample_id") != ""),
        Rule("threshold", F.col("threshold").between(0, 255)),
    ]
    checked = validate(rows, rules).withColumn("usable", F.col("normalized_reference") != "")
    return checked.drop("value", "threshold_text")


def index_drift(index: DataFrame, expected_usable: int, expected_writers: int) -> DataFrame:
    """Usable records and writers against the expected numbers; one row per number."""
    totals = index.agg(
        F.count_if("usable").alias("usable"), F.count_distinct("writer_id").alias("writers")
    )
    entry = lambda n, want: F.struct(
        F.lit(n).alias("number"), F.col(n).alias("actual"), F.lit(want).cast("long").alias("expected")
    )
    rows = totals.select(
        F.explode(F.array(entry("usable", expected_usable), entry("writers", expected_writers))).alias("e")
    )
    return rows.select("e.*", (F.col("e.actual") == F.col("e.expected")).alias("matches"))


def flat_selection(specs: DataFrame) -> DataFrame:
    """Pinned rows of parsed selection specs."""
    return specs.select(F.explode("selection").alias("s")).select("s.*")


def nested_selection(specs: DataFrame) -> DataFrame:
    """Lines of the pinned pages, numbered from 1."""
    pages = specs.select(F.explode("selection").alias("s")).select("s.*")
    return pages.select(
        "page_id", "writer_id", "source_sha256", "width", "height", "prompt",
        F.posexplode("lines").alias("pos", "line"),
    ).select(
        "page_id", "writer_id", "source_sha256", "width", "height", "prompt",
        (F.col("pos") + 1).alias("line_no"), "line.*",
    )


def selection_spec(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    schema = schemas.SELECTION_NESTED if nested else schemas.SELECTION_FLAT
    specs = spark.read.schema(schema).option("multiLine", True).json(path)
    return nested_selection(specs) if nested else flat_selection(specs)


def _streamed_hashes(batches):
    """SHA-256 and MD5 of files read in chunks; an unreadable file fails the task."""
    import hashlib
    from urllib.parse import quote

    import pandas as pd
    from pyarrow import fs

    for frame in batches:
        out = []
        for path in frame["path"]:
            # Spark gives paths, not encoded URIs.
            local = path.startswith("file:")
            system, place = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe=":/"))
            digests = hashlib.sha256(), hashlib.md5()
            with system.open_input_stream(place) as stream:
                while chunk := stream.read(8 << 20):
                    for d in digests:
                        d.update(chunk)
            out.append([d.hexdigest() for d in digests])
        yield frame.assign(sha256=pd.Series([o[0] for o in out], dtype=object), md5=pd.Series([o[1] for o in out], dtype=object))


def file_hashes(spark: SparkSession, path: str, in_memory_bytes: int = 64 << 20) -> DataFrame:
    """Name, size, SHA-256 and MD5 of the files under a folder, of any size.

    Files up to `in_memory_bytes` are hashed by Spark from their content. The content column of
    larger ones is not read: a task streams each of them in chunks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    small = files.filter(F.col("length") <= in_memory_bytes).select(
        "path", name, F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"),
    )
    large = files.filter(F.col("length") > in_memory_bytes).select("path", name, F.col("length").alias("size_bytes"))
    hashed = large.mapInPandas(_streamed_hashes, "path string, filename string, size_bytes long, sha256 string, md5 string")
    return small.unionByName(hashed)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """File hashes with paths relative to the folder, for `inventory_digest`."""
    relative = F.substring_index("path", path.rstrip("/") + "/", -1)
    return file_hashes(spark, path).select(relative.alias("path"), "sha256", "size_bytes")


def failure_instances(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.FAILURE_INSTANCE).json(path)
    return rows.withColumn(
        "category", F.when(F.col("category").isin(*vocab.FAILURE_CATEGORIES), F.col("category"))
    )
