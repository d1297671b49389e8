import hashlib
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioscore.functions import digests, edits, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).head()["x"]


def distance(a, b):
    """Plain edit distance, as the check."""
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            diagonal, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, diagonal + (x != y))
    return line[-1]


def test_char_and_word_edits_match_plain_distance(spark):
    rng = random.Random(7)
    alphabet = ["é", "漢", "a", "b", "ab", "ba", "x"]
    pairs = []
    for _ in range(200):
        p, r = ([rng.choice(alphabet) for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs.append(("  ".join(p) + " ", " ".join(r)))
    df = spark.createDataFrame(pairs, "prediction string, reference string")
    for row in edits.with_row_features(df).collect():
        p, r = row.prediction, row.reference
        assert row.char_edits == distance(p.strip(), r.strip())
        assert row.word_edits == distance(p.split(), r.split())
        assert row.ref_words == len(r.split())
        assert row.ned == pytest.approx(distance(p, r) / max(len(p), len(r), 1))


def test_word_edits_beyond_the_literal_alphabet(spark):
    left = [f"w{i}" for i in range(700)]
    right = left[:300] + ["other"] + left[302:]
    df = spark.createDataFrame([(" ".join(right), " ".join(left))], "prediction string, reference string")
    assert edits.with_word_features(df).head()["word_edits"] == 2


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \t\n  \x1c.#"), max_size=12))
def test_strip_and_normalise_follow_python(spark, value):
    assert one(spark, text.strip(F.col("v")), v=value) == value.strip()
    assert one(spark, text.words(F.col("v")), v=value) == value.split()
    assert one(spark, text.normalize_reference(F.col("v")), v=value) == " ".join(value.replace("#", "").split())


def test_digests(spark):
    want = hashlib.sha256(b"set\0v1\0line-1").hexdigest()
    assert one(spark, digests.stable_digest("set", "v1", F.col("v")), v="line-1") == want
    value = {"b": 'quote " and é', "a": 3, "c": None}
    canonical = digests.canonical_json(b=F.col("b"), a=F.col("a"), c=F.lit(None).cast("string"))
    want = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, canonical, b=value["b"], a=3) == want


def test_slices_and_names(spark):
    assert one(spark, text.parse_slices(F.col("v")), v="faint_pencil|cursive| faint_pencil||") == ["cursive", "faint_pencil"]
    assert one(spark, text.safe_component(F.col("v")), v="../model v1/") == "model-v1"
    assert one(spark, text.safe_component(F.col("v")), v="..-") is None


def test_markup(spark):
    raw = "The [CROSSED: cat] dog [INSERT@line3: big] sat [PARTIAL: wh_t] [UNREADABLE]"
    row = spark.range(1).select(F.lit(raw).alias("m")).select(
        *[c.alias(n) for n, c in text.markup_columns(F.col("m")).items()]
    ).head()
    assert (row.crossed, row.inserted, row.insert_lines, row.partial, row.n_unreadable) == (["cat"], ["big"], [3], ["wh_t"], 1)
    assert row.clean_text == "The dog big sat wh_t"


def test_timestamps_need_a_zone(spark):
    micros = lambda v: one(spark, F.unix_micros(text.utc_timestamp(F.col("v"))), v=v)
    assert micros("2024-01-01T02:00:00+02:00") == micros("2024-01-01T00:00:00Z") == 1704067200000000
    assert micros("2024-01-01T00:00:00") is None
    assert micros("yesterday") is None


def test_distances_that_need_no_table(spark):
    """Texts inside the other, one odd word at an end, odd white space, and all that is left."""
    texts = ["", "a b c", "b c", "a b", "xa b c", "a b cx", "a b  c ", "c b a", " a\tb", "ab", "a  a b c", "b", " c", None]
    rows = [(p, r) for p in texts for r in texts]
    frame = spark.createDataFrame(rows, "prediction string, reference string")

    def plain(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    found = edits.with_row_features(frame)
    for row in found.collect():
        p, r = row.prediction, row.reference
        if p is None or r is None:
            assert row.char_edits is None and row.word_edits is None
            continue
        assert (row.char_edits, row.word_edits) == (plain(p.strip(), r.strip()), plain(p.split(), r.split()))
        assert row.ref_words == len(r.split()) and row.ned == plain(p, r) / max(len(p), len(r), 1)
    flat = edits.with_word_features(frame).select(F.col("word_edits"))
    assert "_plain" not in flat.columns
    easy = edits.plain_word_edits(*[F.col(c) for c in ("p", "r")], *[F.split(c, " ") for c in ("p", "r")])
    some = spark.createDataFrame([("a b", "a b c"), ("x b c", "a b c"), ("a b x", "a b c"), ("c b a", "a b c")], "p string, r string")
    assert [x[0] for x in some.select(easy).collect()] == [1, 1, 1, None]


def test_category_totals_measure_each_row_once(spark):
    from folioscore.operators import diagnostics

    rows = spark.createDataFrame(
        [("i", "h", "test", "abc", "abd", 0.95, ["s"], False, True)],
        "sample_id string, source_sha256 string, split string, reference string, prediction string, confidence double, slices array<string>, is_uncertain boolean, is_unreadable boolean",
    )
    totals = diagnostics.category_totals(diagnostics.failure_records(rows.repartition(1)))
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") == 1
    assert sorted(r.category for r in totals.collect()) == ["character_error_ge_0_25", "high_confidence_exact_error", "model_marked_unreadable"]
