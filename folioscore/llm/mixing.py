"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target number of words: its weight's share of the total, at most
`max_repeat` times what it holds, with the excess shared out again by weight. A source of size
`s` and target `t` wants `t / s` copies of each document. The whole part is certain. The rest is
an inclusion probability `p`, and documents enter by Pareto order sampling: each draws a uniform
number `u` from its id, and the ranks `(u / (1 - u)) / (p / (1 - p))` decide, smallest first,
until the source's missing words are reached. With a `propensity` column the fractions differ
inside a source, which makes the sample one of unequal probabilities and fixed size.

The ranks are cut per source by bucket totals: `r / (1 + r)` puts a rank into [0, 1), a first
pass adds up words per (source, bucket), and rows are ordered only inside the one bucket where a
source's cut falls. So a source with a third of all rows is never sorted in one task.

Defined results: a null text has size 0; null sources are one source, after all others; rows
that repeat an id share its draw and are told apart by their order of size and text hash; an
empty table gives an empty result; a document of size 0 takes 0 words. Extra columns are ignored
by `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.llm.common import cut, own_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
BUCKETS = 4096
DIGITS = 13  # of the md5, 52 bits: exact in a double


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from a key; the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    number = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(16**DIGITS))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = 3.0, total_share: float = 1.0) -> DataFrame:
    """Targets of sources given as (source, source_size), one row per source.

    With caps `max_repeat * size`, sharing the excess again and again ends at the level `v` with
    sum(min(cap, v * weight)) = total. In ascending order of cap / weight the sources below the
    level keep their cap, so `v` follows from running sums. There is one row per source here.
    """
    one = W.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = one.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumns({
        "weight": F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")),
        "cap": F.col("source_size") * F.lit(float(max_repeat)),
    })
    # A tie in cap / weight gives the same level whichever source comes first.
    by_ratio = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    levels = ranked.withColumns({
        "total": F.sum("source_size").over(one) * F.lit(float(total_share)),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # The level is the first one that its own source does not exceed.
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("capped", "level"))).over(one)
    level = F.coalesce(first["level"], F.lit(float("inf")))
    return levels.select(
        "source", "source_size",
        F.least(F.col("cap"), level * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    propensity: str | None = None, weights=WEIGHTS, max_repeat: float = 3.0, total_share: float = 1.0,
    seed: str = "mix", buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken.

    `propensity` names a positive number per row that scales its share inside its source;
    without it all documents of a source are alike. A document gets at most `max_repeat` copies,
    rounded down.
    """
    rows = cut(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        # Orders rows that repeat an id.
        F.coalesce(F.xxhash64(F.col(text_column)), F.lit(0)).alias("tie"),
        (F.greatest(F.col(propensity).cast("double"), F.lit(0.0)) if propensity else F.lit(1.0)).alias("liking"),
    ).withColumn("draw", uniform(F.col("doc_id"), seed)))
    sums = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.coalesce("liking", F.lit(1.0))).alias("liked"),
    )
    targets = source_targets(sums.select("source", "source_size"), weights, max_repeat, total_share)
    per_source = _same(targets, sums.select(F.col("source").alias("key"), "liked")).drop("key")
    joined = _same(rows, per_source.withColumnRenamed("source", "key")).drop("key")
    wanted = F.when(F.col("liked") > 0, F.col("target") * F.coalesce("liking", F.lit(1.0)) / F.col("liked")).otherwise(0.0)
    wanted = F.least(wanted, F.lit(float(max_repeat)))
    ranked = joined.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted")).withColumn(
        "part", F.col("wanted") - F.col("whole")
    ).withColumn(
        "rank",
        F.when(F.col("part") > 0, (F.col("draw") / (1 - F.col("draw"))) / (F.col("part") / (1 - F.col("part")))),
    ).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).cast("int"))
    # Words per (source, bucket): at most `buckets` rows for each source.
    totals = ranked.groupBy("source", "target", "bucket").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain"),
    )
    whole = W.partitionBy("source")
    below = whole.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    sampled = F.when(F.col("bucket").isNull(), F.lit(0)).otherwise(F.col("words"))
    cuts = totals.withColumns({
        "missing": F.col("target") - F.sum("certain").over(whole),
        "before": F.coalesce(F.sum(sampled).over(below), F.lit(0)), "sampled": sampled,
    }).select(F.col("source").alias("key"), F.col("bucket").alias("key_bucket"), "missing", "before", "sampled")
    # A document enters if the words before it are fewer than missing by more than half its own.
    state = F.when(F.col("bucket").isNull() | (F.col("before") >= F.col("missing")), F.lit(0)).when(
        F.col("before") + F.col("sampled") <= F.col("missing"), F.lit(1)
    ).otherwise(F.lit(2))
    placed = ranked.join(
        cuts,
        F.col("source").eqNullSafe(F.col("key")) & F.col("bucket").eqNullSafe(F.col("key_bucket")),
    ).withColumn("state", state)
    inside = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    clear = placed.filter(F.col("state") != 2).withColumn("extra", F.col("state"))
    split = placed.filter(F.col("state") == 2).withColumn(
        "ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    ).withColumn("extra", F.when(F.col("ahead") + F.col("size") / 2.0 <= F.col("missing"), 1).otherwise(0)).drop("ahead")
    done = clear.unionByName(split)
    return done.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + F.col("extra")).cast("long").alias("copies"),
        (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long").alias("taken"),
    )


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach one row per source, null being a source too."""
    return left.join(right, left["source"].eqNullSafe(right["key"]))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` repeated as often as the mix takes them, columns unchanged.

    Rows that repeat an id and a text are one document here: each of them gets the same copies.
    """
    own = {n: own_name(n) for n in ("id", "source", "size", "copies", "copy")}
    plan = mix(docs, **options).filter(F.col("copies") > 0)
    per_id = plan.groupBy(F.col("doc_id").alias(own["id"]), F.col("source").alias(own["source"]), F.col("size").alias(own["size"])).agg(
        F.max("copies").alias(own["copies"])
    )
    text, key, source = (options.get(k, d) for k, d in (("text_column", "text"), ("id_column", "doc_id"), ("source_column", "source")))
    joined = docs.join(
        per_id,
        docs[key].eqNullSafe(F.col(own["id"])) & docs[source].eqNullSafe(F.col(own["source"]))
        & (word_count(docs[text]) == F.col(own["size"])),
    )
    repeated = joined.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.col(own["copies"]).cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         source_size * 3.0 AS cap FROM s),
v AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM w),
l AS (SELECT *, (total - capped) / open AS lvl FROM v),
m AS (SELECT arg_min(lvl, capped) AS lvl FROM l WHERE lvl <= cap / weight),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce((SELECT lvl FROM m), 1e308) * weight) END AS target
  FROM l),
j AS (
  SELECT d.doc_id, d.source, size, source_size, target, draw,
         CASE WHEN source_size > 0 THEN least(target * 1.0 / source_size, 3.0) ELSE 0.0 END AS wanted
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, floor(wanted) AS whole, wanted - floor(wanted) AS part,
         CASE WHEN wanted > floor(wanted) THEN (draw / (1 - draw)) / ((wanted - floor(wanted)) / (1 - (wanted - floor(wanted)))) END AS rank
  FROM j),
c AS (
  SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS missing,
         coalesce(sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS FIRST, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND ahead + size / 2.0 <= missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
