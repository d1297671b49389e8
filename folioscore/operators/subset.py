"""Deterministic, stratified subsets of raw corpora and drift checks of pinned selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.functions.digests import pseudonym, rank_hash
from folioscore.functions.text import normalize_reference
from folioscore.operators.ordering import neighbours
from folioscore.operators.rules import drift


def eligible_writers(
    samples: DataFrame, per_writer: int, clean: int, marked: int
) -> DataFrame:
    """Writers with enough samples, enough clean ones and enough marked ones."""
    return (
        samples.groupBy("writer_id")
        .agg(
            F.count("*").alias("samples"),
            F.count_if(~F.col("marked")).alias("clean"),
            F.count_if("marked").alias("marked"),
        )
        .filter(
            (F.col("samples") >= per_writer) & (F.col("clean") >= clean) & (F.col("marked") >= marked)
        )
    )


def pick_writers(eligible: DataFrame, seed: str, count: int) -> DataFrame:
    """The first `count` eligible writers in hash order."""
    return (
        eligible.withColumn("rank", rank_hash(seed, "writer", F.col("writer_id")))
        .orderBy("rank")
        .limit(count)
    )


def stratified_subset(
    samples: DataFrame,
    seed: str,
    writers: int,
    per_writer: int,
    clean: int,
    marked: int,
) -> DataFrame:
    """Per picked writer: `clean` unmarked and `marked` marked samples, the rest from what is left.

    Every pick is a top-k per group, which Spark prunes in each map task before the shuffle;
    the result has at most writers x per_writer rows, a bound set by the parameters.
    """
    picked = pick_writers(eligible_writers(samples, per_writer, clean, marked), seed, writers)
    pool = samples.join(picked.select("writer_id"), "writer_id", "left_semi")

    def first(rows: DataFrame, domain: str, k: int) -> DataFrame:
        rank = rank_hash(seed, domain, F.col("sample_id"))
        order = W.partitionBy("writer_id").orderBy(rank, "sample_id")
        return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")

    chosen = first(pool.filter(~F.col("marked")), "clean", clean).unionByName(
        first(pool.filter("marked"), "marked", marked)
    )
    fill = per_writer - clean - marked
    if fill < 0:
        raise ValueError("per_writer is below the required clean and marked samples")
    if fill:
        # Of the first per_writer in this order at most clean + marked are taken already.
        candidates = first(pool, "remaining", per_writer)
        rest = candidates.join(chosen.select("sample_id"), "sample_id", "left_anti")
        chosen = chosen.unionByName(first(rest, "remaining", fill))
    return chosen


def anonymised_rows(chosen: DataFrame, seed: str, prefix: str = "line-") -> DataFrame:
    """Opaque file name, normalised text, pseudonymous writer and marker tags."""
    sample_rank = rank_hash(seed, "sample", F.col("sample_id"))
    writer_rank = rank_hash(seed, "writer-pseudonym", F.col("writer_id"))
    return chosen.select(
        F.concat(pseudonym(prefix, sample_rank, 24), F.lit(".pgm")).alias("filename"),
        normalize_reference(F.col("reference")).alias("text"),
        pseudonym("w-", writer_rank, 16).alias("writer_id"),
        marker_slices(F.col("reference")).alias("slices"),
    )


def marker_slices(reference: Column, marker: str = "#") -> Column:
    """Tags that record whether correction markers were in the reference."""
    has = F.contains(reference, F.lit(marker))
    return F.array_sort(
        F.array(
            F.lit("real_handwriting"),
            F.when(has, "reference_hash_marker_removed").otherwise("reference_unchanged"),
            F.when(has, "publisher_hash_marker").otherwise("publisher_no_hash_marker"),
        )
    )


def attribute_slices(source: Column, noise: Column, neatness: Column, color: Column) -> Column:
    """Tags from source, noise flag, neatness band and ink colour."""
    return F.array_sort(
        F.array_distinct(
            F.array(
                F.lit("synthetic"),
                F.concat(F.lit("source_"), F.replace(source, F.lit("-"), F.lit("_"))),
                F.when(noise, "noise_augmented").otherwise("no_noise"),
                F.when(neatness < 70, "neatness_low")
                .when(neatness < 85, "neatness_mid")
                .otherwise("neatness_high"),
                F.concat(F.lit("ink_color_"), F.replace(F.lower(color), F.lit(" "), F.lit("_"))),
            )
        )
    )


def pinned_drift(selection: DataFrame, source: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields of a pinned selection that no longer match the source rows."""
    return drift(selection, source, keys, fields)


def overlapping_lines(lines: DataFrame, band: int = 4096) -> DataFrame:
    """Lines whose top lies above the bottom of the line before; expects `page_id`, `line_no`."""
    near = neighbours(
        lines.withColumns({"_top": F.col("bbox")[1], "_bottom": F.col("bbox")[3]}),
        ["page_id"],
        [F.col("line_no")],
        F.floor(F.col("line_no") / band),
        previous={"previous_bottom": "_bottom"},
    )
    before = F.coalesce("previous_bottom", F.lit(0))
    return near.filter(F.col("_top") < before).select(
        "page_id", "line_no", F.col("_top").alias("top"), before.alias("previous_bottom")
    )


def prompt_mismatch(lines: DataFrame, prompts: DataFrame) -> DataFrame:
    """Pages whose lines, joined by a space in order, do not give the prompt.

    The joined text of a page is one value by definition, as is the prompt it must equal.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "reference")))
    rebuilt = lines.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["reference"]), " ").alias("rebuilt")
    )
    return (
        prompts.join(rebuilt, "page_id", "left")
        .filter(~F.col("prompt").eqNullSafe(F.col("rebuilt")))
        .select("page_id", "prompt", "rebuilt")
    )
