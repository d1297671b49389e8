"""Queries: page quality, layout, routing, assembly, exports, pixels, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore.operators import augmentation, pages as P, pages_index as index, pixels as X, review as R, row_images as RI
from folioscore.plans.transcribe import page_results
from folioscore.queries.inputs import Inputs, mod
from folioscore.queries.registry import query
from folioscore.session import staging_path
from folioscore.sources import sinks

# --- recogniser outputs ------------------------------------------------------------------------


def _token_scores(t: Inputs) -> DataFrame:
    """Five token scores per line; the last token is padding on even lines, all on every tenth."""
    k = F.col("k")
    scores = F.array(*[-(mod(k * (i + 3), 50) + 1).cast("double") / 100 for i in range(5)])
    pad = mod(k, 10) == 0
    ids = F.array(*[F.when(pad, 0).otherwise(5 + i) for i in range(4)], F.when(mod(k, 2) == 0, 0).otherwise(9))
    return t.pairs.select("sample_id", scores.alias("scores"), ids.alias("ids"))


_SCORES = "[{}]".format(",".join(f"-CAST((k*{i + 3})%50+1 AS DOUBLE)/100" for i in range(5)))


@query(
    "f16_sequence_confidence", "pairs",
    sql=f"""SELECT sample_id, round(CASE WHEN k%10=0 THEN 0.5::DOUBLE WHEN k%2=0 THEN exp(list_avg(s[1:4])) ELSE exp(list_avg(s)) END,6) AS confidence,
      CAST(CASE WHEN k%10=0 THEN 0 WHEN k%2=0 THEN 4 ELSE 5 END AS INT) AS n_tokens FROM (SELECT sample_id, k, {_SCORES} AS s FROM pairs)""",
)
def f16(t: Inputs) -> DataFrame:
    args = F.col("scores"), F.col("ids"), 0
    return _token_scores(t).select(
        "sample_id", P.sequence_confidence(*args).alias("confidence"), F.size(P.token_confidences(*args)).alias("n_tokens")
    )


@query(
    "f17_read_flags", "pairs",
    sql="""SELECT sample_id, is_uncertain, is_unreadable, CASE WHEN is_unreadable THEN '[UNREADABLE]' ELSE prediction END AS text, prediction AS raw_text FROM pairs""",
)
def f17(t: Inputs) -> DataFrame:
    rows = t.pairs.select("sample_id", "confidence", F.col("prediction").alias("raw_text"))
    return P.with_read_flags(rows).select("sample_id", "is_uncertain", "is_unreadable", "text", "raw_text")


def _page_model_text(t: Inputs) -> DataFrame:
    """Raw page-model outputs: fenced, bare, a single object, or broken, by page."""
    block = F.struct(
        "type", F.col("reading_order").cast("int").alias("reading_order"), "text",
        F.when(mod(F.col("reading_order"), 3) != 2, F.col("confidence")).alias("confidence"), "bbox",
    )
    entries = F.array_sort(F.collect_list(F.struct("block_no", block.alias("b"))))
    rows = t.blocks.groupBy("page_id").agg(F.transform(entries, lambda e: e["b"]).alias("bs"))
    page = mod(F.col("page_id"), 4)
    raw = (
        F.when(page == 0, F.concat(F.lit("```json\n"), F.to_json("bs"), F.lit("\n```")))
        .when(page == 1, F.to_json("bs"))
        .when(page == 2, F.to_json(F.element_at("bs", 1)))
        .otherwise(F.concat(F.lit('[{"text": '), F.col("page_id").cast("string")))
    )
    return rows.select("page_id", raw.alias("raw_output"))


@query(
    "f19_page_model_parse", "blocks",
    sql="""SELECT page_id, CAST(reading_order AS INT) AS reading_order, type, text, round(CASE WHEN reading_order%3=2 THEN 0.5::DOUBLE ELSE confidence END,6) AS confidence,
        CASE WHEN reading_order%3=2 THEN true ELSE confidence<0.7 END AS is_uncertain FROM blocks WHERE page_id%4 IN (0,1)
      UNION ALL SELECT page_id, CAST(reading_order AS INT), type, text, round(CASE WHEN reading_order%3=2 THEN 0.5::DOUBLE ELSE confidence END,6), CASE WHEN reading_order%3=2 THEN true ELSE confidence<0.7 END
        FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS rn FROM blocks WHERE page_id%4=2) WHERE rn=1
      UNION ALL SELECT page_id, CAST(1 AS INT), 'student_handwriting', '[{"text": '||page_id, 0.3::DOUBLE, true FROM (SELECT DISTINCT page_id FROM blocks WHERE page_id%4=3)""",
)
def f19(t: Inputs) -> DataFrame:
    parsed = P.parse_page_model_output(_page_model_text(t))
    return parsed.select("page_id", "reading_order", "type", "text", "confidence", "is_uncertain")


# --- quality and routing -----------------------------------------------------------------------------


@query("f21_quality_issues", "quality", sql="SELECT page_id, array_to_string(issues,'|') AS issues FROM quality")
def f21(t: Inputs) -> DataFrame:
    return t.measurements.select("page_id", P.quality_issues().alias("issues"))


@query("f20_quality_score", "quality", sql="SELECT page_id, round(score,6) AS score FROM quality")
def f20(t: Inputs) -> DataFrame:
    return P.assess_quality(t.measurements).select("page_id", "score")


@query("f22_recommendation", "recommended", sql="SELECT page_id, recommendation, passed FROM recommended")
def f22(t: Inputs) -> DataFrame:
    return P.assess_quality(t.measurements).select("page_id", "recommendation", "passed")


def _routed(t: Inputs) -> DataFrame:
    return P.route_pages(P.assess_quality(t.measurements), P.layout_features(t.blocks))


@query("f23_complexity", "routed", sql="SELECT page_id, round(complexity,6) AS complexity FROM routed")
def f23(t: Inputs) -> DataFrame:
    return _routed(t).select("page_id", "complexity")


@query(
    "f24_route", "routed",
    sql="""SELECT page_id, route, round(CASE route WHEN 'human_only' THEN 0.0 WHEN 'trocr_fast' THEN coalesce(handwriting_lines,10)*50.0 WHEN 'hybrid' THEN 1500.0 ELSE 2500.0 END::DOUBLE,6) AS latency_ms,
      round(CASE route WHEN 'human_only' THEN 0.15::DOUBLE WHEN 'trocr_fast' THEN coalesce(handwriting_lines,10)*0.0001::DOUBLE WHEN 'hybrid' THEN 0.005::DOUBLE ELSE 0.01::DOUBLE END,6) AS cost_usd FROM routed""",
)
def f24(t: Inputs) -> DataFrame:
    return _routed(t).select("page_id", "route", "latency_ms", "cost_usd")


_ESCALATED = "(SELECT page_id, count(*) FILTER (is_uncertain) AS u, count(*) AS n FROM blocks GROUP BY 1)"


@query(
    "f25_hybrid_escalation", "blocks",
    sql=f"""SELECT b.page_id, b.reading_order, CASE WHEN e.u>e.n*0.3::DOUBLE THEN 'page' ELSE 'line' END AS block_source,
      CASE WHEN e.u>e.n*0.3::DOUBLE THEN replace(text,'e','E') ELSE text END AS text FROM blocks b JOIN {_ESCALATED} e USING (page_id)""",
)
def f25(t: Inputs) -> DataFrame:
    page_model = t.blocks.withColumn("text", F.replace("text", F.lit("e"), F.lit("E")))
    return P.hybrid_blocks(t.blocks, page_model).select("page_id", "reading_order", "block_source", "text")


# --- layout --------------------------------------------------------------------------------------------


@query(
    "f26_bbox", "blocks",
    sql="""SELECT page_id, reading_order, CAST(x2-x1 AS BIGINT) AS box_width, CAST(y2-y1 AS BIGINT) AS box_height, CAST((x2-x1)*(y2-y1) AS BIGINT) AS box_area,
      CAST((x1+x2)//2 AS BIGINT) AS center_x, CAST((y1+y2)//2 AS BIGINT) AS center_y FROM blocks""",
)
def f26(t: Inputs) -> DataFrame:
    columns = P.bbox_columns(F.col("bbox").cast("array<bigint>"))
    return t.blocks.select("page_id", "reading_order", *[c.alias(n) for n, c in columns.items()])


def _measured(t: Inputs) -> DataFrame:
    page, order = F.col("page_id"), F.col("reading_order")
    return t.blocks.withColumns(
        {
            "ink_density": mod(page * 19 + order * 7, 40).cast("double") / 100,
            "width_std": mod(page * 23 + order * 5, 60).cast("double") / 100,
            "n_components": mod(page + order, 9),
        }
    )


@query(
    "f27_region_type", "blocks",
    sql="""SELECT page_id, reading_order, CASE WHEN (page_id+reading_order)%9=0 THEN 'blank' WHEN CAST((page_id*23+reading_order*5)%60 AS DOUBLE)/100<0.3
      AND CAST((page_id*19+reading_order*7)%40 AS DOUBLE)/100>0.15 THEN 'printed_text' ELSE 'student_handwriting' END AS region FROM blocks""",
)
def f27(t: Inputs) -> DataFrame:
    region = P.region_type(F.col("ink_density"), F.col("n_components"), F.col("width_std"))
    return _measured(t).select("page_id", "reading_order", region.alias("region"))


@query(
    "f28_crossed_out", "blocks",
    sql="""SELECT page_id, reading_order AS line_no, (y*30)>=9 AND (y*30)<=21 AS is_crossed_out FROM (SELECT *, CAST((page_id*3+reading_order*11)%100 AS DOUBLE)/100 AS y FROM blocks)""",
)
def f28(t: Inputs) -> DataFrame:
    lines = t.blocks.select("page_id", F.col("reading_order").alias("line_no"), "bbox")
    share = mod(F.col("page_id") * 3 + F.col("line_no") * 11, 100).cast("double") / 100
    strokes = lines.select("page_id", "line_no", (share * (F.col("bbox")[3] - F.col("bbox")[1])).alias("avg_y"))
    return P.crossed_out_lines(lines, strokes)


@query(
    "w6_reading_order", "blocks",
    sql="""SELECT page_id, block_no, row_number() OVER (PARTITION BY page_id ORDER BY (y1*7)%80, x1, block_no)-1 AS reading_order FROM blocks""",
)
def w6(t: Inputs) -> DataFrame:
    box = F.col("bbox")
    moved = F.array(box[0], mod(box[1] * 7, 80).cast("int"), box[2], box[3])
    lines = t.blocks.select("page_id", "block_no", moved.alias("bbox"))
    return P.reading_order(lines, "block_no").select("page_id", "block_no", "reading_order")


@query(
    "w15_review_context", "blocks",
    sql="""SELECT page_id, reading_order, coalesce(lag(text) OVER w,'') AS context_before, coalesce(lead(text) OVER w,'') AS context_after FROM blocks WINDOW w AS (PARTITION BY page_id ORDER BY reading_order)""",
)
def w15(t: Inputs) -> DataFrame:
    rows = R.review_context(t.blocks)
    blank = F.lit("")
    return rows.select(
        "page_id", "reading_order", F.coalesce("context_before", blank).alias("context_before"),
        F.coalesce("context_after", blank).alias("context_after"),
    )


@query(
    "a35_layout_totals", "blocks",
    sql="SELECT page_id, count(*) AS total_lines, count(*) FILTER (type='student_handwriting') AS handwriting_lines, count(*) FILTER (crossed_out) AS crossed_out_lines FROM blocks GROUP BY 1",
)
def a35(t: Inputs) -> DataFrame:
    return P.layout_totals(t.blocks)


# --- assembly ------------------------------------------------------------------------------------------------

_CONFIDENCE = """(SELECT page_id, round(coalesce(m,0),4) AS confidence_score, u AS uncertain_spans, u>0 OR coalesce(m,0)<0.8 AS needs_review FROM (
  SELECT page_id, avg(confidence) FILTER (confidence>0) AS m, count(*) FILTER (is_uncertain) AS u FROM blocks GROUP BY 1))"""
_TEXT = "(SELECT page_id, string_agg(text, chr(10) ORDER BY reading_order) AS text FROM blocks WHERE NOT crossed_out AND text<>'' GROUP BY 1)"


@query("a36_page_confidence", "blocks", sql=f"SELECT * FROM {_CONFIDENCE}")
def a36(t: Inputs) -> DataFrame:
    return P.page_confidence(t.blocks)


@query("a37_page_model_confidence", "blocks", sql="SELECT page_id, round(avg(confidence),6) AS avg_confidence FROM blocks GROUP BY 1")
def a37(t: Inputs) -> DataFrame:
    return P.page_model_confidence(t.blocks)


@query("a38_transcripts", "blocks", sql=f"SELECT page_id, text FROM {_TEXT}")
def a38(t: Inputs) -> DataFrame:
    return P.assemble_transcripts(t.blocks)


@query(
    "a38_page_results", "routed", "blocks",
    sql=f"""SELECT r.page_id, r.route, CASE WHEN r.route='human_only' THEN '' ELSE coalesce(t.text,'') END AS text FROM routed r LEFT JOIN {_TEXT} t USING (page_id)""",
)
def a38_results(t: Inputs) -> DataFrame:
    """The whole page flow, with the same blocks from both models."""
    rows = page_results(t.measurements, t.blocks, t.blocks)
    return rows.select("page_id", "route", F.coalesce("text", F.lit("")).alias("text"))


def _job_pages(t: Inputs) -> DataFrame:
    page = F.col("page_id")
    status = F.when(mod(page, 11) == 0, "failed").when(mod(page, 13) == 0, "queued").otherwise("completed")
    return P.page_confidence(t.blocks).withColumns(
        {
            "job_id": F.concat(F.lit("job-"), mod(page, 5).cast("string")), "status": status,
            "processing_seconds": mod(page, 7).cast("double") / 2,
            "confidence_score": mod(page, 129).cast("double") / 128,
        }
    )


@query(
    "a39_job_progress", "blocks",
    sql=f"""SELECT 'job-'||(page_id%5) AS job_id, count(*) AS pages_total, count(*) FILTER (s='completed') AS pages_completed, count(*) FILTER (s='completed' AND needs_review) AS pages_needs_review,
      count(*) FILTER (s='failed') AS pages_failed, round(coalesce(avg(CAST(page_id%129 AS DOUBLE)/128) FILTER (s='completed'),0),6) AS avg_confidence,
      round(coalesce(sum(CAST(page_id%7 AS DOUBLE)/2) FILTER (s='completed'),0),6) AS processing_seconds, round(count(*) FILTER (s='queued')*2.5::DOUBLE,6) AS remaining_seconds
      FROM (SELECT *, CASE WHEN page_id%11=0 THEN 'failed' WHEN page_id%13=0 THEN 'queued' ELSE 'completed' END AS s FROM {_CONFIDENCE}) GROUP BY 1""",
)
def a39(t: Inputs) -> DataFrame:
    return P.job_progress(_job_pages(t), "job_id")


def _pages(t: Inputs) -> DataFrame:
    texts = P.assemble_transcripts(t.blocks)
    return P.page_confidence(t.blocks).join(texts, "page_id", "left").select(
        F.concat(F.lit("job-"), mod(F.col("page_id"), 5).cast("string")).alias("job_id"),
        F.col("page_id").alias("page_number"), "text", "confidence_score", "needs_review",
        (mod(F.col("page_id"), 2) == 0).alias("reviewed"),
    )


def _exported(rows: DataFrame, t: Inputs, name: str) -> DataFrame:
    """Written per job and read back as whole lines."""
    path = staging_path(t.spark, name)
    sinks.write_export(rows, path)
    return t.spark.read.text(path)


@query(
    "s18_export_json", "blocks",
    sql=f"""SELECT 'job-'||(page_id%5) AS job_id, page_id AS page_number, '1.0' AS format_version, coalesce(text,'') AS text, true AS stripped FROM {_CONFIDENCE} c LEFT JOIN {_TEXT} t USING (page_id)""",
)
def s18(t: Inputs) -> DataFrame:
    block = F.array(F.struct(F.col("text").alias("text"), F.col("confidence_score").alias("confidence")))
    pages = _pages(t).withColumns({"metadata": F.struct(F.lit("x").alias("route")), "blocks": block})
    rows = _exported(sinks.export_json(pages, include_metadata=False, include_confidence=False), t, "export-json")
    parsed = F.from_json("value", "format_version string, page_number bigint, text string")
    clean = ~F.contains("value", F.lit('"metadata"')) & ~F.contains("value", F.lit('"confidence":'))
    return rows.select("job_id", parsed.alias("p"), clean.alias("stripped")).select(
        "job_id", "p.page_number", "p.format_version", F.coalesce("p.text", F.lit("")).alias("text"), "stripped"
    )


@query(
    "s19_export_txt", "blocks",
    sql=f"""SELECT job_id, count(*) AS lines, count(*) FILTER (starts_with(l,'--- Page ')) AS headers FROM (
      SELECT 'job-'||(page_id%5) AS job_id, unnest(string_split('--- Page '||page_id||' ---'||chr(10)||coalesce(text,'')||chr(10), chr(10))) AS l FROM {_CONFIDENCE} c LEFT JOIN {_TEXT} t USING (page_id)) GROUP BY 1""",
)
def s19(t: Inputs) -> DataFrame:
    rows = _exported(sinks.export_txt(_pages(t)), t, "export-txt")
    header = F.col("value").startswith("--- Page ")
    return rows.groupBy("job_id").agg(F.count("*").alias("lines"), F.count_if(header).alias("headers"))


@query(
    "s20_export_lms", "blocks",
    sql=f"""SELECT 'job-'||(page_id%5) AS submission_id, 'lms_v1' AS format, page_id AS page, coalesce(text,'') AS content, round(confidence_score,6) AS confidence, page_id%2=0 AS reviewed
      FROM {_CONFIDENCE} c LEFT JOIN {_TEXT} t USING (page_id)""",
)
def s20(t: Inputs) -> DataFrame:
    rows = _exported(sinks.export_lms(_pages(t)), t, "export-lms")
    schema = "submission_id string, format string, page bigint, content string, confidence double, reviewed boolean"
    return rows.select(F.from_json("value", schema).alias("e")).select("e.*")


@query("t5_result_page", "blocks", sql="SELECT page_id, reading_order FROM blocks ORDER BY page_id, reading_order LIMIT 50 OFFSET 100")
def t5(t: Inputs) -> DataFrame:
    return R.page_of_results(t.blocks.select("page_id", "reading_order"), ["page_id", "reading_order"], 3, 50)


_KEYS = ["page_id", "reading_order"]


def _ranked(t: Inputs) -> str:
    path = staging_path(t.spark, "ranked")
    index.store_ranked(t.blocks.select(*_KEYS), _KEYS, path, range_rows=120)
    return path


@query(
    "t5_indexed_pages", "blocks",
    sql="""SELECT page_id, reading_order, position FROM (SELECT page_id, reading_order, row_number() OVER (ORDER BY page_id, reading_order) AS position FROM blocks)
      WHERE position BETWEEN 101 AND 150 OR position BETWEEN 951 AND 1050""",
)
def t5_indexed(t: Inputs) -> DataFrame:
    """A page inside a range and one over two ranges."""
    path = _ranked(t)
    return index.page(t.spark, path, 3, 50).unionByName(index.page(t.spark, path, 20, 50)).unionByName(index.page(t.spark, path, 21, 50))


@query(
    "t5_keyset_page", "blocks",
    sql="""SELECT page_id, reading_order, row_number() OVER (ORDER BY page_id, reading_order) AS place FROM (SELECT page_id, reading_order FROM blocks
      WHERE page_id>17 OR (page_id=17 AND reading_order>1) ORDER BY page_id, reading_order LIMIT 200)""",
)
def t5_keyset(t: Inputs) -> DataFrame:
    """The rows after a key, whether or not it is there."""
    rows = index.page_after(t.spark, _ranked(t), _KEYS, (17, 1), 200)
    return rows.select(*_KEYS, (F.col("position") - rows.agg(F.min("position")).scalar() + 1).alias("place"))


def _mode(name: str, key: str) -> None:
    @query(
        f"t6_review_queue_{name}", "blocks",
        sql=f"SELECT page_id, reading_order FROM blocks WHERE is_uncertain ORDER BY {key}, page_id, reading_order LIMIT 100",
    )
    def t6(t: Inputs) -> DataFrame:
        return R.review_queue(t.blocks, name).select("page_id", "reading_order")


_mode("uncertainty", "confidence")
_mode("impact", "length(text) DESC")
_mode("active_learning", "(1-confidence)*length(text) DESC")


# --- pixels ----------------------------------------------------------------------------------------------------


@query(
    "a44_exposure", "pixels",
    sql="""SELECT page_id, round(avg(CAST(v AS DOUBLE)),6) AS brightness, round(stddev_pop(CAST(v AS DOUBLE)),6) AS contrast,
      round(CAST(count(*) FILTER (v>250) AS DOUBLE)/count(*),6) AS saturated_share, CAST(count(*) FILTER (v>250) AS DOUBLE)/count(*)>0.05 AS has_glare FROM pixels GROUP BY 1""",
)
def a44(t: Inputs) -> DataFrame:
    return RI.row_exposure(t.pixel_rows)


_PROFILE = "(SELECT page_id, y, count(*) FILTER (v<100) AS ink, min(x) FILTER (v<100) AS x_first, max(x) FILTER (v<100) AS x_last, max(x)+1 AS width FROM pixels GROUP BY 1,2)"


@query("a45_row_profile", "pixels", sql=f"SELECT page_id, y, ink, coalesce(x_first,-1) AS x_first, coalesce(x_last,-1) AS x_last, width FROM {_PROFILE}")
def a45(t: Inputs) -> DataFrame:
    none = F.lit(-1).cast("long")
    profile = RI.row_ink(t.pixel_rows)
    return profile.withColumns({c: F.coalesce(F.col(c), none) for c in ("x_first", "x_last")})


@query(
    "w7_text_lines", "pixels",
    sql=f"""SELECT page_id, CASE WHEN y2=b+1 THEN 0 ELSE x1 END AS x1, y1, CASE WHEN y2=b+1 THEN width ELSE x2 END AS x2, y2 FROM (
      SELECT page_id, g, min(y) AS y1, max(y)+1 AS y2, min(x_first) AS x1, max(x_last) AS x2, max(width) AS width, max(b) AS b FROM (
        SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS g FROM (SELECT *, max(y) OVER (PARTITION BY page_id) AS b FROM {_PROFILE}) WHERE ink > width*0.01) GROUP BY 1,2) WHERE y2-y1 BETWEEN 1 AND 200""",
)
def w7(t: Inputs) -> DataFrame:
    return RI.row_text_lines(RI.row_ink(t.pixel_rows), min_height=1)


@query(
    "w14_blur_variance", "pixels",
    sql="""SELECT page_id, round(var_pop(l),6) AS blur FROM (SELECT page_id, CAST(coalesce(lag(v) OVER r, lead(v) OVER r)+coalesce(lead(v) OVER r, lag(v) OVER r)
      +coalesce(lag(v) OVER c, lead(v) OVER c)+coalesce(lead(v) OVER c, lag(v) OVER c)-4*v AS DOUBLE) AS l
      FROM pixels WINDOW r AS (PARTITION BY page_id, y ORDER BY x), c AS (PARTITION BY page_id, x ORDER BY y)) GROUP BY 1""",
)
def w14(t: Inputs) -> DataFrame:
    return RI.row_blur_variance(t.pixel_rows)


# --- registry --------------------------------------------------------------------------------------------------------


@query(
    "a46_champions", "versions",
    sql="SELECT model_type, arg_max(version, promoted_seq) AS version, round(arg_max(cer, promoted_seq),6) AS cer FROM versions GROUP BY 1",
)
def a46(t: Inputs) -> DataFrame:
    promotions = t.registry.select("version", "promoted_seq")
    best = P.champions(t.registry.drop("promoted_seq"), promotions)
    return best.select("model_type", "version", F.col("metrics")["cer"].alias("cer"))


@query(
    "t8_best_version", "versions",
    sql="SELECT model_type, version, round(cer,6) AS cer FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY cer, version) AS rn FROM versions) WHERE rn=1",
)
def t8(t: Inputs) -> DataFrame:
    return P.best_version(t.registry)


# --- images in tasks ---------------------------------------------------------------------------------------------------


def _images(t: Inputs) -> DataFrame:
    """Each embedding as an 8 x 8 grey image in the raw format."""
    levels = F.transform(
        "embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(127.5 + 400 * v.cast("double")))).cast("int")
    )
    body = F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    content: Column = F.concat(F.encode(F.lit("P5\n8 8\n255\n"), "UTF-8"), body)
    return t.table("embeddings").select(
        "vec_id", F.format_string("page-%d", "vec_id").alias("path"), content.alias("content"),
        F.sha2(F.col("vec_id").cast("string"), 256).alias("sample_id"),
    )


@query(
    "x5_image_features", "pixels",
    sql="""SELECT 'page-'||page_id AS path, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height, round(avg(CAST(v AS DOUBLE)),6) AS brightness, round(stddev_pop(CAST(v AS DOUBLE)),6) AS contrast,
      round(CAST(count(*) FILTER (v>250) AS DOUBLE)/count(*),6) AS saturated_share FROM pixels GROUP BY page_id""",
)
def x5(t: Inputs) -> DataFrame:
    return X.image_features(_images(t)).drop("blur")


@query("x5_image_pixels", "pixels", sql="SELECT 'page-'||page_id AS page_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM pixels")
def x5_pixels(t: Inputs) -> DataFrame:
    return X.image_pixels(_images(t))


@query(
    "x6_line_crops", "pixels",
    sql="""SELECT 'page-'||page_id AS path, CAST(y//4+1 AS INT) AS line_no, CAST(32+length('P5 8 4 255 ') AS BIGINT) AS n_bytes, CAST(sum(v) AS BIGINT) AS ink FROM pixels GROUP BY page_id, y//4""",
)
def x6(t: Inputs) -> DataFrame:
    images = _images(t)
    halves = F.array(
        F.struct(F.lit(1).alias("line_no"), F.array(*[F.lit(v) for v in (0, 0, 8, 4)]).alias("bbox")),
        F.struct(F.lit(2).alias("line_no"), F.array(*[F.lit(v) for v in (0, 4, 8, 8)]).alias("bbox")),
    )
    boxes = images.select("path", F.explode(halves).alias("h")).select("path", "h.*")
    crops = X.crop_lines(images, boxes).filter(F.col("sha256") == F.sha2("content", 256))
    cells = F.substring(F.hex("content"), 2 * 11 + 1, 64)
    values = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(cells, 2 * i + 1, 2), 16, 10).cast("long"))
    return crops.select(
        "path", "line_no", F.length("content").cast("long").alias("n_bytes"),
        F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v).alias("ink"),
    )


# Draws of the plan, and levels after brightness and contrast where nothing else was drawn.
_DRAW = "CAST(CAST('0x'||substr({},{},6) AS BIGINT) AS DOUBLE)/16777216"
_PLAN = f"""(SELECT vec_id, sample_id, u0<=0.5 AS on_, u0<=0.5 AND u9<0.3 AS colour, u0<=0.5 AND (u1<0.3 OR u3<0.3 OR u5<0.2 OR u7<0.2) AS other,
    0.7::DOUBLE+w0*0.6::DOUBLE AS brightness, 0.7::DOUBLE+w1*0.6::DOUBLE AS contrast FROM (SELECT vec_id, sample_id, {', '.join(f"{_DRAW.format('d', 1 + 6 * i)} AS u{i}" for i in (0, 1, 3, 5, 7, 9))},
      {', '.join(f"{_DRAW.format('e', 1 + 6 * i)} AS w{i}" for i in (0, 1))}
    FROM (SELECT vec_id, sample_id, sha256('augment'||chr(0)||'42'||chr(0)||sample_id) AS d, sha256('augment-colour'||chr(0)||'42'||chr(0)||sample_id) AS e
      FROM (SELECT vec_id, sha256(CAST(vec_id AS VARCHAR)) AS sample_id FROM embeddings))))"""


@query(
    "x4_augmented_images", "pixels",
    sql=f"""SELECT sample_id, CAST(64+length('P5 8 8 255 ') AS BIGINT) AS n_bytes, CASE WHEN NOT other THEN ink END AS ink FROM
      (SELECT sample_id, other, CAST(sum(CASE WHEN colour THEN greatest(0,least(255,round_even(m+(b-m)*contrast,0))) ELSE v END) AS BIGINT) AS ink FROM
        (SELECT *, avg(b) OVER (PARTITION BY vec_id) AS m FROM
          (SELECT l.*, v, greatest(0.0,least(255.0,round_even(v*brightness,0))) AS b FROM {_PLAN} l JOIN pixels ON page_id=vec_id)) GROUP BY 1,2)""",
)
def x4(t: Inputs) -> DataFrame:
    """All changes of the plan; the oracle follows the levels of images without blur, rotation,
    noise and compression, which the tests compare with plain loops."""
    images = _images(t)
    plan = X.augmentation_plan(images)
    changed = augmentation.augment(images, plan).join(plan, "sample_id")
    cells = F.substring(F.hex("content"), 2 * 11 + 1, 128)
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(cells, 2 * i + 1, 2), 16, 10).cast("long"))
    other = F.coalesce("blur_radius", "rotation_degrees", "noise_sigma", F.col("jpeg_quality").cast("double"))
    ink = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    return changed.select("sample_id", F.length("content").cast("long").alias("n_bytes"), F.when(other.isNull(), ink).alias("ink"))
