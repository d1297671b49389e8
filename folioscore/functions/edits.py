"""Edit distances on characters and on words, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore.functions.text import exact_match, single_spaced, strip, words_of

# One character per word of a row's vocabulary: most rows stay inside this literal alphabet.
_ALPHABET = "".join(chr(0x100 + i) for i in range(256))
_NEXT_PLANE = 0x10000


def char_edits(prediction: Column, reference: Column) -> Column:
    """Levenshtein distance in code points.

    Equal texts skip the quadratic work, and so does a text that lies whole in the other: what the
    longer one has more is the least that any edits must add, and adding it is enough.
    """
    inside = F.contains(reference, prediction) | F.contains(prediction, reference)
    return (
        F.when(prediction == reference, F.lit(0))
        .when(inside, F.abs(F.length(prediction) - F.length(reference)))
        .otherwise(F.levenshtein(prediction, reference))
    )


def _symbol(position: Column) -> Column:
    """The character of a 1-based vocabulary position; rich rows go on in the next plane."""
    far = F.decode(F.unhex(F.lpad(F.hex(position + _NEXT_PLANE), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(F.split(F.lit(_ALPHABET), ""), position.cast("int")), far)


def word_edits(prediction_words: Column, reference_words: Column, vocabulary: Column) -> Column:
    """Levenshtein distance in words: each word of the row's vocabulary becomes one character."""

    def encode(tokens: Column) -> Column:
        return F.array_join(
            F.transform(tokens, lambda t: _symbol(F.array_position(vocabulary, t))), ""
        )

    return F.when(prediction_words == reference_words, F.lit(0)).otherwise(
        F.levenshtein(encode(prediction_words), encode(reference_words))
    )


def plain_word_edits(prediction: Column, reference: Column, prediction_words: Column, reference_words: Column) -> Column:
    """The distance in words where it needs no table of distances, else null.

    Equal texts, a run of words that lies whole in the other text, and texts of as many words that
    differ in their first or last word only. The texts are single-spaced.
    """
    p, r = prediction_words, reference_words
    apart = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    inside = F.contains(apart(reference), apart(prediction)) | F.contains(apart(prediction), apart(reference))
    but_first = lambda w: F.slice(w, F.lit(2), F.size(w))
    but_last = lambda w: F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    one = (F.size(p) == F.size(r)) & ((but_first(p) == but_first(r)) | (but_last(p) == but_last(r)))
    return F.when(prediction == reference, F.lit(0)).when(inside, F.abs(F.size(p) - F.size(r))).when(one, F.lit(1))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as doubles; null when the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def row_cer(edits: Column, ref_chars: Column) -> Column:
    return ratio(edits, ref_chars)


def with_char_features(df: DataFrame) -> DataFrame:
    """Adds `char_edits`, `ref_chars` and `exact` from `prediction` and `reference`."""
    p, r = strip(F.col("prediction")), strip(F.col("reference"))
    return df.withColumns(
        {"char_edits": char_edits(p, r), "ref_chars": F.length(r), "exact": p == r}
    )


def with_word_features(df: DataFrame) -> DataFrame:
    """Adds `word_edits` and `ref_words`."""
    df = df.withColumns({"_pt": single_spaced(F.col("prediction")), "_rt": single_spaced(F.col("reference"))})
    df = df.withColumns({"_pw": words_of(F.col("_pt")), "_rw": words_of(F.col("_rt"))})
    df = df.withColumn("_plain", plain_word_edits(*[F.col(c) for c in ("_pt", "_rt", "_pw", "_rw")]))
    # A column of its own, so that it is built once per row and not once per word.
    df = df.withColumn("_vocab", F.when(F.col("_plain").isNull(), F.array_distinct(F.concat("_pw", "_rw"))))
    edits = F.coalesce("_plain", word_edits(F.col("_pw"), F.col("_rw"), F.col("_vocab")))
    return df.withColumns({"word_edits": edits, "ref_words": F.size("_rw")}).drop(
        "_pt", "_rt", "_pw", "_rw", "_plain", "_vocab"
    )


def with_ned(df: DataFrame) -> DataFrame:
    """Adds `ned`: distance over the longer length, on the texts as they are.

    Where stripping changed nothing, an existing `char_edits` is the same distance.
    """
    p, r = F.col("prediction"), F.col("reference")
    distance = char_edits(p, r)
    if "char_edits" in df.columns:
        unchanged = (strip(p) == p) & (strip(r) == r)
        distance = F.when(unchanged, F.col("char_edits")).otherwise(distance)
    longest = F.greatest(F.length(p), F.length(r), F.lit(1))
    return df.withColumn("ned", ratio(distance, longest))


def with_row_features(df: DataFrame) -> DataFrame:
    """All row-level inputs of the metric bundle, computed once per row."""
    return with_ned(with_word_features(with_char_features(df)))


__all__ = [
    "char_edits", "exact_match", "plain_word_edits", "ratio", "row_cer", "with_char_features", "with_ned",
    "with_row_features", "with_word_features", "word_edits",
]
