"""The pipeline's stages on the smallest tables, each against a plain version of its decisions."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from folioscore.llm import mixing, pseudonyms, quality
from folioscore.llm.common import crc_remainder

from test_jaccard_join import plain
from test_tokens import check_pieces


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in C.STAGES:
        frames.append(stage(spark, frames[-1], folder).cache())
    return frames


def test_every_stage_keeps_the_columns(stages):
    assert all(f.columns == stages[0].columns for f in stages[:-1])
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    network = quality.fit(stages[0], spark.createDataFrame([(i, q) for i, q in labels.items() if crc_remainder(i, 5)], "doc_id long, quality int"))
    rows = stages[0].collect()
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r, s in zip(rows, network.scores([r.text for r in rows])) if s >= 0.3}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({eval(r)[1] for r in plain(rows)})


def test_personal_data(stages):
    want = {r.doc_id: pseudonyms.replaced(r.text, C.KEY)[0] for r in stages[2].collect()}
    assert {r.doc_id: r.text for r in stages[3].collect()} == want
    assert any(want[r.doc_id] != r.text for r in stages[2].collect())


def test_mixing(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    found = {}
    for r in stages[4].collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}


def test_packing(stages):
    check_pieces(stages[4].collect(), stages[5].collect(), 2048)


def test_run(spark, stages):
    got = C.run(spark, "/root/testdata/sf0.001").collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(stages[5].collect())


@pytest.mark.parametrize("rows", ["messy", "empty"])
def test_odd_rows_pass_all_stages(request, spark, rows):
    docs = request.getfixturevalue(rows)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert (docs.count() == 0) == (rows == "empty")


def test_columns_with_the_names_of_helpers_pass_unchanged(spark, messy):
    names = ["_score", "_spans", "_text_key", "_place", "_id", "_key", "_mix_id", "_mix_source", "_mix_size", "_mix_copies", "_mix_copy"]
    docs = messy.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        rows = docs.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)
