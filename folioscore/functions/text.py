"""Text columns: trimming, normalising, mark-up and safe names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscore import vocab

# Every character that counts as whitespace.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_ANY_SPACE = f"[{_SPACES}]+"
# Characters that may be whitespace other than a space: few texts have one.
_UNCOMMON = r"[^ -~\x{A1}-\x{167F}]"


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of every kind (`trim` only drops spaces)."""
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Strip, then turn every run of whitespace into one space."""
    return strip(F.regexp_replace(c, _ANY_SPACE, " "))


def single_spaced(c: Column) -> Column:
    """The words of a text with one space between; most texts are that already."""
    unlike = c.rlike(_UNCOMMON) | F.contains(c, F.lit("  ")) | F.startswith(c, F.lit(" ")) | F.endswith(c, F.lit(" "))
    # A single character splits without a pattern, which Spark would compile for each row.
    cut = F.split(F.translate(c, _SPACES, " " * len(_SPACES)), " ")
    return F.when(unlike, F.array_join(F.array_remove(cut, ""), " ")).otherwise(c)


def words_of(flat: Column) -> Column:
    """Words of a single-spaced text."""
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def words(c: Column) -> Column:
    """Words of a text; an empty text has none."""
    return words_of(single_spaced(c))


def exact_match(prediction: Column, reference: Column) -> Column:
    return strip(prediction) == strip(reference)


def normalize_reference(c: Column, marker: str = "#") -> Column:
    """Reference text without correction markers and with single spaces."""
    return collapse(F.translate(c, marker, ""))


def parse_slices(c: Column) -> Column:
    """Pipe-delimited tags to a sorted, distinct array without blanks."""
    tags = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip)
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t != "")))


def normalize_slices(c: Column) -> Column:
    """An array of tags: trimmed, distinct and sorted; null becomes empty."""
    tags = F.coalesce(c, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(tags, strip)))


def safe_component(c: Column) -> Column:
    """A name usable as a file component; null when nothing usable is left."""
    kept = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.\-]+", "-"), r"^[\-.]+|[\-.]+$", "")
    return F.when(kept != "", kept)


def evaluation_set_id(pilot_id: Column, version: Column) -> Column:
    """`<pilot>-<version>`, or null when the result is not a valid identifier."""
    joined = F.concat_ws("-", pilot_id, version)
    return F.when(joined.rlike(vocab.EVALUATION_SET_ID), joined)


# Annotation mark-up, fixed by the labelling guideline.
CROSSED = r"\[CROSSED: ([^\]]*)\]"
INSERT = r"\[INSERT@line(\d+): ([^\]]*)\]"
PARTIAL = r"\[PARTIAL: ([^\]]*)\]"
UNREADABLE = r"\[UNREADABLE\]"


def markup_columns(c: Column) -> dict[str, Column]:
    """Extracted mark-up, its counts, and the transcript without the tags."""
    clean = F.regexp_replace(c, CROSSED, "")
    clean = F.regexp_replace(clean, INSERT, "$2")
    clean = F.regexp_replace(clean, PARTIAL, "$1")
    clean = F.regexp_replace(clean, UNREADABLE, "")
    return {
        "crossed": F.regexp_extract_all(c, F.lit(CROSSED), F.lit(1)),
        "inserted": F.regexp_extract_all(c, F.lit(INSERT), F.lit(2)),
        "insert_lines": F.transform(
            F.regexp_extract_all(c, F.lit(INSERT), F.lit(1)), lambda x: x.cast("int")
        ),
        "partial": F.regexp_extract_all(c, F.lit(PARTIAL), F.lit(1)),
        "n_unreadable": F.regexp_count(c, F.lit(UNREADABLE)).cast("int"),
        "clean_text": collapse(clean),
    }


def utc_timestamp(c: Column) -> Column:
    """ISO-8601 text with a mandatory zone to a timestamp; anything else is null."""
    return F.when(c.rlike(vocab.ZONED_TIMESTAMP), F.try_to_timestamp(c))
