import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.operators import augmentation as A, pages as P, pixels as X, review as R, row_images as RI


def pixel_table(spark, images):
    rows = [(p, y, x, int(v)) for p, img in images.items() for y, line in enumerate(img) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "page_id string, y int, x int, v int")


def test_blur_and_exposure_match_numpy_and_the_image_path(spark):
    rng = np.random.default_rng(1)
    images = {f"p{i}": rng.integers(0, 256, size=(5 + i, 7)).astype(np.uint8) for i in range(3)}
    from_table = {r["page_id"]: r for r in X.blur_variance(pixel_table(spark, images)).collect()}
    exposure = {r["page_id"]: r for r in X.exposure(pixel_table(spark, images)).collect()}
    files = spark.createDataFrame([(k, bytearray(X.write_pgm(v))) for k, v in images.items()], "path string, content binary")
    features = {r["path"]: r for r in X.image_features(files).collect()}
    for name, img in images.items():
        v = img.astype(float)
        p = np.pad(v, 1, mode="reflect")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * v
        assert from_table[name]["blur"] == pytest.approx(lap.var())
        assert features[name]["blur"] == pytest.approx(lap.var())
        assert exposure[name]["brightness"] == pytest.approx(v.mean()) == features[name]["brightness"]
        assert exposure[name]["contrast"] == pytest.approx(v.std())
    assert X.image_pixels(files).count() == sum(i.size for i in images.values())


def test_text_lines(spark):
    page = np.full((60, 50), 255)
    page[5:25, 10:30] = 0
    page[30:33, 10:30] = 0  # too low for a line
    page[40:60, 5:45] = 0  # reaches the last row
    rows = X.text_lines(X.row_profile(pixel_table(spark, {"a": page}))).orderBy("y1").collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows] == [(10, 5, 29, 25), (0, 40, 50, 60)]


def test_crops_and_augmentation_are_stable(spark):
    page = np.arange(48, dtype=np.uint8).reshape(6, 8)
    files = spark.createDataFrame([("p", bytearray(X.write_pgm(page)))], "path string, content binary")
    boxes = spark.createDataFrame([("p", 1, [0, 0, 8, 3]), ("p", 2, [2, 3, 6, 6])], "path string, line_no int, bbox array<int>")
    got = {r["line_no"]: bytes(r["content"]) for r in X.crop_lines(files, boxes).collect()}
    assert got == {1: X.write_pgm(page[:3]), 2: X.write_pgm(page[3:, 2:6])}
    images = spark.range(20).select(F.sha2(F.col("id").cast("string"), 256).alias("sample_id")).crossJoin(files.select("content"))
    plan = X.augmentation_plan(images)
    once, twice = ({r[0]: bytes(r[1]) for r in A.augment(images, plan).collect()} for _ in range(2))
    assert once == twice and len(set(once.values())) > 1


def test_sequence_confidence(spark):
    rows = [([np.log(0.8).item(), np.log(0.5).item(), -1.0], [3, 4, 0]), ([np.log(0.9).item()] * 3, [1, 2, 3]), ([-1.0], [0])]
    df = spark.createDataFrame(rows, "s array<double>, t array<int>")
    got = [r[0] for r in df.select(P.sequence_confidence(F.col("s"), F.col("t"), 0)).collect()]
    assert got == pytest.approx([0.4**0.5, 0.9, 0.5])


def test_page_model_output(spark):
    raws = [
        '```json\n[{"text": "a", "reading_order": 1, "confidence": 0.9}, {"text": "b"}]\n```',
        '{"text": "solo", "crossed_out": true}',
        "not json",
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "page_id int, raw_output string")
    rows = [tuple(r)[:5] for r in P.parse_page_model_output(df).collect()]
    assert rows[0] == (0, "student_handwriting", 1, "a", 0.9)
    assert rows[1] == (0, "student_handwriting", 0, "b", 0.5)
    assert rows[2][3] == "solo" and rows[3] == (2, "student_handwriting", 1, "not json", 0.3)


def test_quality_and_routes(spark):
    columns = "page_id int, blur double, width int, height int, skew double, brightness double, has_glare boolean, has_shadow boolean, is_blank boolean"
    rows = [
        (1, 300.0, 1000, 1000, 0.0, 128.0, False, False, False), (2, 0.0, 800, 600, 0.0, 255.0, True, False, True),
        (3, 50.0, 300, 300, 20.0, 10.0, False, False, False), (4, 50.0, 1000, 1000, 20.0, 128.0, False, False, False),
    ]
    quality = {r["page_id"]: r for r in P.assess_quality(spark.createDataFrame(rows, columns)).collect()}
    assert quality[1]["recommendation"] == "process" and quality[1]["passed"]
    assert quality[2]["recommendation"] == "skip" and not quality[2]["passed"]
    assert quality[3]["recommendation"] == "re-upload" and quality[3]["issues"] == ["blur", "low_resolution", "skew", "underexposed"]
    assert quality[4]["score"] == pytest.approx(0.55) and quality[4]["recommendation"] == "vlm_fallback"
    blocks = spark.createDataFrame([(1, "printed_text", False), (1, "student_handwriting", True)], "page_id int, type string, crossed_out boolean")
    df = spark.createDataFrame(rows, columns).withColumn("force_vlm", F.col("page_id") == 4)
    routed = {r["page_id"]: r for r in P.route_pages(P.assess_quality(df), P.layout_features(blocks)).collect()}
    assert routed[1]["route"] == "hybrid" and routed[1]["complexity"] == 3.5
    assert routed[3]["route"] == "human_only" and routed[3]["cost_usd"] == 0.15
    assert routed[4]["route"] == "vlm_fallback" and routed[4]["route_confidence"] == 0.9
    alone = P.route_pages(P.assess_quality(spark.createDataFrame(rows[:1], columns)), P.layout_features(blocks.limit(0))).head()
    assert alone["complexity"] == -1.0 and alone["route"] == "trocr_fast" and alone["latency_ms"] == 500.0


def test_transcripts(spark):
    rows = [(1, 2, 0, "c", False), (1, 0, 1, "a", False), (1, 1, 2, "x", True), (1, 1, 3, "", False), (1, 25_000, 4, "far", False)]
    df = spark.createDataFrame(rows, "page_id int, reading_order int, block_no int, text string, crossed_out boolean")
    assert [r["text"] for r in P.assemble_transcripts(df).collect()] == ["a\nc\nfar"]
    assert P.assemble_transcripts(df, keep_empty=True).head()["text"] == "a\n\nc\nfar"
    long = spark.range(25_000).selectExpr("1 AS page_id", "id AS reading_order", "id AS block_no", "cast(id AS string) AS text", "false AS crossed_out")
    assert [r["text"] for r in P.assemble_transcripts(long).collect()] == ["\n".join(map(str, range(25_000)))]


def test_active_learning_scores_and_queue(spark):
    rows = [("a", 0.2, "blur", 120.0, 5.0), ("b", 0.99, "blur", 10.0, 10.0), ("c", 0.5, None, 30.0, 20.0)]
    items = spark.createDataFrame(rows, "item_id string, confidence double, failure_category string, correction_impact double, label_seconds double")
    old = spark.createDataFrame([("blur", 0.8)], "category string, frequency double")
    scored = {r["item_id"]: r["priority_score"] for r in R.score_items(items, old).collect()}
    assert scored["a"] == pytest.approx(0.4 * 0.8 + 0.2 * 0.8 + 0.3 + 0.1)
    assert scored["c"] == pytest.approx(0.4 * 0.5 + 0.2 * 0.5 + 0.3 * 0.5 + 0.1 * 0.5)
    queue = R.annotation_queue(R.score_items(items, old))
    assert [r["item_id"] for r in queue.collect()] == ["a", "c"]
    batch, rest = R.next_batch(queue, 1)
    assert [r["item_id"] for r in batch.collect()] == ["a"] and [r["item_id"] for r in rest.collect()] == ["c"]
    merged = {r["category"]: r["frequency"] for r in R.merge_frequencies(old, R.failure_frequencies(items.filter("item_id = 'c'"))).collect()}
    assert merged == {"blur": 0.8, "unknown": 1.0}


def test_page_results_take_the_blocks_of_their_route(spark):
    """Against the same flow put together from its parts, with other texts from the page model."""
    from folioscore.plans.transcribe import page_results
    from folioscore.queries.inputs import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    lines = t.blocks.filter("page_id % 9 <> 4")
    pages = t.blocks.filter("page_id % 9 <> 5").withColumn("text", F.concat(F.lit("page "), "text"))
    got = {r["page_id"]: (r["route"], r["text"], r["uncertain_spans"]) for r in page_results(t.measurements, lines, pages).collect()}
    routed = P.route_pages(P.assess_quality(t.measurements), P.layout_features(lines))
    route = {r["page_id"]: r["route"] for r in routed.collect()}
    of = lambda blocks, name: blocks.filter(F.col("page_id").isin([p for p, r in route.items() if r == name] or [-1]))
    mixed = P.hybrid_blocks(of(lines, "hybrid"), of(pages, "hybrid")).drop("block_source")
    blocks = of(lines, "trocr_fast").unionByName(of(pages, "vlm_fallback")).unionByName(mixed)
    texts = {r["page_id"]: r["text"] for r in P.assemble_transcripts(blocks).collect()}
    spans = {r["page_id"]: r["uncertain_spans"] for r in P.page_confidence(blocks).collect()}
    assert got == {p: (r, texts.get(p), spans.get(p)) for p, r in route.items()}
    assert len(set(route.values())) > 1


def test_versions_promoted_at_once_are_ordered_by_name(spark):
    rows = [(f"v{i}", "m", 5 if i in (9, 10, 100) else 1 if i < 100 else None) for i in range(102)] + [("w1", "n", None)]
    for step in (1, -1):
        frame = spark.createDataFrame(rows[::step], "version string, model_type string, promoted_seq int")
        registry = frame.select("version", "model_type", F.create_map(F.lit("cer"), F.lit(0.5)).alias("metrics"))
        best = P.champions(registry, frame.select("version", "promoted_seq")).collect()
        assert {(r["model_type"], r["version"]) for r in best} == {("m", "v9"), ("n", None)}
