"""Threshold-scaled sketches as document fingerprints, with DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, however
long the text is. So the sketch of a union is the union of the sketches, and the share of one
sketch found in another estimates how much of one document another holds, even if one is a
thousand times as long. The hash is the start of a shingle's md5, and the fraction is a number of
its leading sixteenths: SQL can state it as well.

A fingerprint is the sorted sketch as text, `HEX` digits for each hash. Texts equal in their
words have equal fingerprints.

Defined results: a null text is empty; a text with fewer words than a shingle has one shingle of
all its words; one without words has none and an empty fingerprint; two sketches that are both
empty have likeness 0; rows that repeat an id are ordered by text; a null id comes first; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.llm.common import cut
from folioscore.operators.ordering import global_position

WORDS = 5
SIXTEENTHS = 4
HEX = 12


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, words: int = WORDS, sixteenths: int = SIXTEENTHS) -> Column:
    """Sorted distinct shingle hashes below sixteenths / 16 of the range."""
    parts = words_of(text)

    def shingles(w: Column) -> Column:
        last = F.greatest(F.size(w) - words + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, words), " ")), 1, HEX))

    limit = format(sixteenths, "x") if sixteenths < 16 else "g"
    # One-element arrays bind the words once; otherwise each use would split the text again.
    hashes = F.flatten(F.transform(F.array(parts), lambda w: F.when(F.size(w) > 0, shingles(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))


def packed(hashes: Column) -> Column:
    """A sketch as bytes: a third of its size as text in a shuffle."""
    return F.unhex(F.array_join(hashes, ""))


def unpacked(data: Column) -> Column:
    text = F.lower(F.hex(data))
    each = lambda t: F.transform(F.sequence(F.lit(1), F.length(t), F.lit(HEX)), lambda i: F.substring(t, i, HEX))
    return F.flatten(F.transform(F.array(text), lambda t: F.when(F.length(t) > 0, each(t)).otherwise(F.array().cast("array<string>"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the documents behind two sketches."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of document a's shingles that document b holds."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together."""
    return F.array_sort(F.array_union(a, b))


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, sixteenths: int = SIXTEENTHS) -> DataFrame:
    """doc_id, text, sketch and fingerprint of each row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.withColumn("sketch", sketch(F.col("text"), words, sixteenths)).withColumn("fingerprint", F.array_join("sketch", ""))


def neighbour_ids(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, text): its key, the key before it by doc_id, and that one's length.

    Only ids, hashes and lengths are put in order; the first one's predecessor is the last.
    """
    distinct = docs.groupBy("key", "doc_id").agg(F.first("n_chars").alias("n_chars"))
    placed = cut(global_position(distinct, [F.col("doc_id").asc_nulls_first(), F.col("key")], "place"))
    total = placed.count()
    before = placed.select(
        F.when(F.col("place") == total, F.lit(1)).otherwise(F.col("place") + 1).cast("long").alias("place"),
        F.col("key").alias("previous_key"), F.col("n_chars").alias("previous_chars"),
    )
    return placed.select("place", "key").join(before, "place").drop("place")


def edited_fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, sixteenths: int = SIXTEENTHS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and what they say of both and the next one.

    The edited text has its last half, rounded down, replaced by as many first characters of
    the next document by doc_id, or by all of it if it is shorter. Rows that repeat an id and a
    text are one document in that order and share their result.

    One shuffle brings texts and neighbours together by key; the next document then sends its
    needed prefix and its sketch, not its text, to the one before it. Both sides read the same
    columns of that shuffle, so Spark writes it once.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text",
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text"))).alias("key"),
    )
    near = neighbour_ids(rows.withColumn("n_chars", F.length("text")))
    placed = rows.join(near, "key")
    once = placed.withColumn("copy", F.row_number().over(W.partitionBy("key").orderBy("key"))).filter(F.col("copy") == 1)
    sent = once.select(
        F.col("previous_key").alias("key"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("previous_chars") / 2).cast("int")).alias("prefix"),
        packed(sketch(F.col("text"), words, sixteenths)).alias("next_packed"), F.col("doc_id").alias("next_id"),
    )
    joined = placed.select("key", "doc_id", "text").join(sent, "key")
    n = F.length("text")
    texts = joined.select(
        "doc_id", "next_id", unpacked(F.col("next_packed")).alias("next_sketch"), n.cast("long").alias("n_chars"), sketch(F.col("text"), words, sixteenths).alias("sketch"),
        F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int")), "prefix").alias("edited"),
    )
    done = texts.withColumn("edited_sketch", sketch(F.col("edited"), words, sixteenths))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.size("sketch").cast("long").alias("n_hashes"), "next_id",
    )


_SKETCH = """list_sort(list_distinct(list_filter(CASE WHEN len({w}) = 0 THEN []::VARCHAR[] ELSE
  list_transform(range(1, greatest(len({w}) - 4, 1) + 1), lambda i: substr(md5(array_to_string({w}[i:i+4], ' ')), 1, 12)) END, lambda h: h < '4')))"""
_WORDS = "list_filter(string_split_regex({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LIKE = "CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, {_WORDS.format(t="text")} AS w FROM d),
s AS (SELECT doc_id, text, {_SKETCH.format(w="w")} AS sk FROM f),
n AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nt, coalesce(lead(sk) OVER o, first_value(sk) OVER o) AS ns,
         coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM s WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, (length(text) - length(text) // 2)::INT) || substr(nt, 1, (length(text) // 2)::INT) AS edited FROM n),
g AS (SELECT *, {_WORDS.format(t="edited")} AS ew FROM e),
h AS (SELECT *, {_SKETCH.format(w="ew")} AS es FROM g)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(sk, '') AS fingerprint, array_to_string(es, '') AS edited_fingerprint,
       {_LIKE.format(a="sk", b="es")} AS near_edited, {_LIKE.format(a="sk", b="ns")} AS near_next, len(sk)::BIGINT AS n_hashes, next_id
FROM h
"""
