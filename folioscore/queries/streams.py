"""Queries: pluggable models and the streaming operators, run over what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.operators import inference as I, pages as P
from folioscore.operators.review import score_items
from folioscore.queries.inputs import Inputs, as_items, as_requests, mod
from folioscore.queries.paging import _page_model_text
from folioscore.queries.registry import query
from folioscore.session import CODEC, staged, staging_path
from folioscore.streaming import counters, ledger as SL, tables, work


class TextModel:
    """A stand-in model that answers with the payload and one letter changed."""

    def predict_batch(self, inputs: list) -> list[I.Prediction]:
        return [
            I.Prediction(text.replace("e", "E"), (len(text) % 101) / 100, None, (len(text) % 101) < 70, (len(text) % 101) < 40, "model-v1")
            for text in inputs
        ]


# --- pluggable models -------------------------------------------------------------------------


@query(
    "x1_batch_predictor", "pairs",
    sql="""SELECT sample_id, reference, replace(reference,'e','E') AS prediction, round(CAST(length(reference)%101 AS DOUBLE)/100,6) AS confidence, split, 'model-v1' AS model_version FROM pairs""",
)
def x1(t: Inputs) -> DataFrame:
    manifest = t.pairs.select("sample_id", "source_sha256", "reference", "slices", "split")
    scored = I.predict(manifest.withColumn("payload", F.col("reference")), TextModel, "payload")
    return I.prediction_rows(scored).select(
        "sample_id", "reference", "prediction", "confidence", "split", "model_version"
    )


@query(
    "f18_batch_latency", "pairs",
    sql="SELECT sample_id, true AS shared, true AS positive FROM pairs",
)
def f18(t: Inputs) -> DataFrame:
    """Items of one model batch share one measured time: the batch's, divided by its size."""
    scored = I.predict(t.pairs.select("sample_id", F.col("reference").alias("payload")), TextModel, "payload")
    one = W.partitionBy("batch")
    spread = F.max("latency_ms").over(one) - F.min("latency_ms").over(one)
    return scored.select("sample_id", (spread == 0).alias("shared"), (F.col("latency_ms") > 0).alias("positive"))


@query(
    "x2_page_transcriber", "blocks",
    sql="""SELECT page_id, CAST(reading_order AS INT) AS reading_order, type, text FROM blocks WHERE page_id%4 IN (0,1)
      UNION ALL SELECT page_id, CAST(reading_order AS INT), type, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS rn FROM blocks WHERE page_id%4=2) WHERE rn=1
      UNION ALL SELECT page_id, CAST(1 AS INT), 'student_handwriting', '[{"text": '||page_id FROM (SELECT DISTINCT page_id FROM blocks WHERE page_id%4=3)""",
)
def x2(t: Inputs) -> DataFrame:
    """The model repeats the prepared answer; its texts are then parsed natively."""
    raw = I.transcribe_pages(_page_model_text(t), lambda: str, "raw_output")
    return P.parse_page_model_output(raw).select("page_id", "reading_order", "type", "text")


@query(
    "x3_image_loader", "pairs",
    sql="SELECT sample_id, replace(reverse(reference),'e','E') AS prediction FROM pairs",
)
def x3(t: Inputs) -> DataFrame:
    payload = t.pairs.select("sample_id", F.encode("reference", "UTF-8").alias("payload"))
    scored = I.predict(payload, TextModel, "payload", load=lambda raw: bytes(raw).decode()[::-1])
    return scored.select("sample_id", F.col("raw_text").alias("prediction"))


@query(
    "s21_resumed_predictions", "pairs",
    sql="SELECT sample_id, replace(reference,'e','E') AS prediction FROM pairs",
)
def s21(t: Inputs) -> DataFrame:
    """A first run covers the test split, the second one the rest; then all is published."""
    from folioscore.sources import sinks

    manifest = t.pairs.select("sample_id", "source_sha256", "reference", "slices", "split")
    path = staging_path(t.spark, "resumed")

    def run(rows: DataFrame) -> None:
        scored = I.predict(rows.withColumn("payload", F.col("reference")), TextModel, "payload")
        sinks.append_predictions(I.prediction_rows(scored), f"{path}/partial")

    run(manifest.filter(F.col("split") == "test"))
    done = t.spark.read.parquet(f"{path}/partial")
    run(I.resume(manifest, done))
    partial = t.spark.read.parquet(f"{path}/partial")
    sinks.publish_predictions(partial, manifest, f"{path}/final")
    return t.spark.read.schema(partial.schema).json(f"{path}/final").select("sample_id", "prediction")


# --- ledger streams ----------------------------------------------------------------------------


# Every slice is written as so many files and read as one micro-batch.
SLICES, FILES = 3, 4
EVENT_COLUMNS = [
    "pilot_id", "sequence", "event_id", "event_type", "subject_token_sha256", "scope_sha256", "event_sha256",
    "previous_event_sha256", "occurred_at", "recorded_at",
]


def _sliced(rows: DataFrame, name: str) -> DataFrame:
    """A stream over rows whose column `slice` says with which micro-batch they arrive."""
    spark = rows.sparkSession
    kept, source = staged(rows, name), staging_path(spark, f"{name}-source")
    for k in range(SLICES):
        kept.filter(F.col("slice") == k).drop("slice").repartition(FILES).write.mode("append").option("compression", CODEC).parquet(source)
    return tables.read_files(spark, kept.drop("slice").schema, source, FILES)


def _by_day(late: str = "sequence") -> Column:
    """Ten days a slice; every other event of a day comes one day late, so slices overlap."""
    day = F.datediff(F.col("occurred_at"), F.lit("2024-01-01")) + mod(F.col(late), 2)
    return F.least(F.floor(day / 10), F.lit(SLICES - 1)).cast("int")


# The same slice in SQL.
_DAY_SLICE = "CAST(least((date_diff('day', DATE '2024-01-01', CAST(occurred_at AS DATE)) + sequence%2)//10, 2) AS INT)"


# A subject has at most four events here, so the accepted state unrolls into three joins.
_STEP = """CASE
  WHEN event_type='consent_withdrawal_requested' THEN CASE WHEN req THEN 'duplicate_request' ELSE '' END
  WHEN NOT req THEN 'before_request' WHEN scope_sha256<>scope THEN 'scope_changed' WHEN cl THEN 'after_close'
  WHEN event_type='primary_deletion_verified' THEN CASE WHEN pr THEN 'duplicate_primary' ELSE '' END
  WHEN event_type='backup_deletion_verified' THEN CASE WHEN ba THEN 'duplicate_backup' ELSE '' END
  WHEN pr AND ba THEN '' ELSE 'closed_early' END"""
_REPLAY = f"""(WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY pilot_id, subject_token_sha256 ORDER BY sequence) AS rn FROM ledger),
  st AS (SELECT pilot_id, subject_token_sha256, CAST(0 AS BIGINT) AS rn, false AS req, CAST('' AS VARCHAR) AS scope, false AS pr, false AS ba, false AS cl, CAST(NULL AS TIMESTAMP) AS requested_at, CAST('' AS VARCHAR) AS event_id, CAST(NULL AS BIGINT) AS sequence, CAST('' AS VARCHAR) AS reason
      FROM (SELECT DISTINCT pilot_id, subject_token_sha256 FROM ledger)
    UNION ALL SELECT pilot_id, subject_token_sha256, rn, req OR (ok AND event_type='consent_withdrawal_requested'), CASE WHEN ok AND event_type='consent_withdrawal_requested' THEN scope_sha256 ELSE scope END,
      pr OR (ok AND event_type='primary_deletion_verified'), ba OR (ok AND event_type='backup_deletion_verified'), cl OR (ok AND event_type='withdrawal_closed'),
      CASE WHEN ok AND event_type='consent_withdrawal_requested' THEN occurred_at ELSE requested_at END, event_id, sequence, reason
    FROM (SELECT *, reason='' AS ok FROM (SELECT s.pilot_id, s.subject_token_sha256, e.rn, s.req, s.scope, s.pr, s.ba, s.cl, s.requested_at, e.event_id, e.sequence, e.event_type, e.scope_sha256, e.occurred_at, {_STEP} AS reason
      FROM st s JOIN ev e ON e.pilot_id=s.pilot_id AND e.subject_token_sha256=s.subject_token_sha256 AND e.rn=s.rn+1)))
  SELECT * FROM st)"""


# An event's place against the event numbered one less in `{rows}`.
_FAULTS = """SELECT *, concat_ws('|', CASE WHEN gap THEN 'gap' END,
    CASE WHEN previous_event_sha256 <> CASE WHEN sequence=1 THEN repeat('0',64) ELSE coalesce(head,'') END THEN 'chain_broken' END,
    CASE WHEN occurred_at>recorded_at THEN 'occurred_after_recorded' END, CASE WHEN occurred_at<prev_occurred THEN 'occurred_regressed' END,
    CASE WHEN recorded_at<prev_recorded THEN 'recorded_regressed' END) AS faults
  FROM (SELECT a.*, b.event_sha256 AS head, b.occurred_at AS prev_occurred, b.recorded_at AS prev_recorded, b.sequence IS NULL AND a.sequence>1 AS gap
    FROM {rows} a LEFT JOIN {rows} b ON b.pilot_id=a.pilot_id AND b.sequence=a.sequence-1)"""


@query(
    "st1_ledger_stream", "ledger",
    sql=f"""SELECT r.pilot_id, r.subject_token_sha256, r.sequence, r.event_id, reason='' AS accepted, reason, faults
      FROM {_REPLAY} r JOIN ({_FAULTS.format(rows="ledger")}) f USING (event_id) WHERE rn>0""",
)
def st1(t: Inputs) -> DataFrame:
    """Events arrive shuffled over all slices, and are judged as if they had come in order."""
    rows = t.ledger.select(*EVENT_COLUMNS, mod(F.crc32("event_id"), SLICES).alias("slice"))
    verdicts = SL.ledger_verdicts(_sliced(rows, "ledger"), delay="60 days")
    return tables.append_available(verdicts, staging_path(t.spark, "verdicts")).drop("batch").withColumn("reason", F.coalesce("reason", F.lit("")))


_GAPPY = f"""SELECT *, {_DAY_SLICE} AS slice FROM ledger WHERE sequence%211<>0"""
# Released: no gap before an event is still waiting when the stream ends.
_RELEASED = """SELECT * FROM (SELECT *, coalesce(max(CASE WHEN gap THEN epoch_us(occurred_at)//1000 END) OVER (PARTITION BY pilot_id ORDER BY sequence), 0)+3600000
    <= (SELECT epoch_us(max(occurred_at))//1000 FROM ledger)-2*86400000 AS free,
    count(*) FILTER (gap) OVER (PARTITION BY pilot_id ORDER BY sequence)=0 AS whole FROM ({}))
  WHERE free OR whole"""


@query(
    "st1_ledger_gaps", "ledger",
    sql=f"""SELECT r.pilot_id, r.subject_token_sha256, r.sequence, r.event_id, reason='' AS accepted, reason, faults
        FROM {_REPLAY.replace("FROM ledger", f"FROM ({_RELEASED.format(_FAULTS.format(rows=f'({_GAPPY})'))})")} r
        JOIN ({_RELEASED.format(_FAULTS.format(rows=f"({_GAPPY})"))}) f USING (event_id) WHERE rn>0
      UNION ALL SELECT pilot_id, subject_token_sha256, sequence, event_id, false, 'repeated_sequence', 'repeated_sequence'
        FROM ({_GAPPY}) WHERE sequence%149=0""",
)
def st1_gaps(t: Inputs) -> DataFrame:
    """Some events never come, some come twice, and the last slice brings some of the first again,
    too late to count; gaps are given up when the watermark has passed them by an hour."""
    rows = t.ledger.select(*EVENT_COLUMNS).filter(mod(F.col("sequence"), 211) != 0).withColumn("slice", _by_day())
    twice = rows.filter(mod(F.col("sequence"), 149) == 0)
    late = rows.filter((F.col("slice") == 0) & (mod(F.col("sequence"), 97) == 0)).withColumn("slice", F.lit(SLICES - 1))
    verdicts = SL.ledger_verdicts(_sliced(rows.unionByName(twice).unionByName(late), "gaps"), delay="2 days")
    return tables.append_available(verdicts, staging_path(t.spark, "verdicts")).drop("batch").withColumn("reason", F.coalesce("reason", F.lit("")))


@query(
    "st2_deadline_alarm", "ledger",
    sql=f"""SELECT * FROM (WITH placed AS (SELECT pilot_id, sequence, event_id, max({_DAY_SLICE}) OVER (PARTITION BY pilot_id ORDER BY sequence) AS released FROM ledger),
      marks AS (SELECT s, (SELECT epoch_us(max(occurred_at))//1000 FROM ledger WHERE {_DAY_SLICE}<=s)-2*86400000 AS mark FROM range({SLICES}) x(s)),
      ends AS (SELECT r.pilot_id, r.subject_token_sha256, epoch_us(max(r.requested_at))//1000 AS requested_ms, min(p.released) FILTER (r.cl) AS closed
        FROM {_REPLAY} r LEFT JOIN placed p USING (event_id) GROUP BY 1,2)
      SELECT pilot_id, subject_token_sha256, requested_ms FROM ends
      WHERE coalesce(closed,{SLICES}) > (SELECT CASE WHEN min(s) IS NOT NULL THEN least(min(s)+1, {SLICES - 1}) END FROM marks WHERE mark>=requested_ms+5*86400000))""",
)
def st2(t: Inputs) -> DataFrame:
    """A withdrawal that is closed by the micro-batch in which its timer fires raises no alarm."""
    rows = t.ledger.select(*EVENT_COLUMNS).withColumn("slice", _by_day())
    alarms = SL.deadline_alarms(_sliced(rows, "deadlines"), days=5, delay="2 days")
    return tables.append_available(alarms, staging_path(t.spark, "alarms")).select(
        "pilot_id", "subject_token_sha256", F.unix_millis(F.col("requested_at").cast("timestamp")).alias("requested_ms")
    )


# --- work streams ----------------------------------------------------------------------------------


@query(
    "st3_incremental_prediction", "pairs",
    sql="SELECT sample_id, replace(reference,'e','E') AS prediction, split FROM pairs",
)
def st3(t: Inputs) -> DataFrame:
    path = staging_path(t.spark, "incremental")
    manifest = t.pairs.select("sample_id", "source_sha256", "reference", "slices", "split", F.col("reference").alias("payload"))
    manifest.write.parquet(f"{path}/manifest")
    stream = tables.read_files(t.spark, manifest.schema, f"{path}/manifest", files_per_trigger=3)
    return work.predict_stream(stream, TextModel, "payload", f"{path}/out").select("sample_id", "prediction", "split")


@query(
    "st4_live_queue", "scored",
    sql="SELECT item_id, round(priority_score,6) AS priority_score FROM scored WHERE confidence<0.95 ORDER BY round(priority_score,9) DESC, item_id LIMIT 500",
)
def st4(t: Inputs) -> DataFrame:
    path = staging_path(t.spark, "queue-items")
    items = score_items(as_items(t.pairs), t.frequencies).select(
        "item_id", "confidence", F.round("priority_score", 9).alias("priority_score")
    )
    items.write.parquet(path)
    stream = tables.read_files(t.spark, items.schema, path, files_per_trigger=3)
    kept = tables.KeptTable(t.spark, "item_id string, confidence double, priority_score double", staging_path(t.spark, "queue"))
    return work.live_queue(stream, kept, 500, staging_path(t.spark, "queue-checkpoint")).select("item_id", "priority_score")


def _event_slices(t: Inputs) -> DataFrame:
    """Events with the micro-batch they arrive in: ten days each."""
    events = t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.datediff("ts", F.lit("2024-01-01"))
    return events.withColumn("slice", F.least(F.floor(day / 10), F.lit(SLICES - 1)).cast("int"))


def _event_stream(t: Inputs) -> DataFrame:
    """Requests in three micro-batches; the last one brings some of the first five days again, weeks
    too late to count."""
    rows = _event_slices(t)
    late = rows.filter((F.datediff("ts", F.lit("2024-01-01")) < 5) & (mod(F.col("event_id"), 97) == 0)).withColumn("slice", F.lit(SLICES - 1))
    return as_requests(_sliced(rows.unionByName(late), "events"))


def _with_start(rows: DataFrame) -> DataFrame:
    """Window starts as seconds, which do not depend on a time zone."""
    return rows.withColumn("window_start", F.unix_seconds("window_start"))


_HOUR = "CAST(epoch_us(ts)//3600000000*3600 AS BIGINT)"


@query(
    "st5_request_counts", "requests",
    sql=f"SELECT {_HOUR} AS window_start, method, endpoint, CAST(status AS INT) AS status, count(*) AS requests FROM requests GROUP BY 1,2,3,4",
)
def st5(t: Inputs) -> DataFrame:
    counts = counters.request_counts(_event_stream(t))
    rows = tables.upsert_available(counts, ["window_start", "method", "endpoint", "status"], staging_path(t.spark, "counts"))
    return _with_start(rows)


_BUCKETS = ", ".join(f"count(*) FILTER (latency_ms<={int(b)}) AS le_{int(b)}" for b in counters.LATENCY_BUCKETS)


@query(
    "st6_latency_histogram", "requests",
    sql=f"SELECT {_HOUR} AS window_start, endpoint, {_BUCKETS}, count(*) AS n, round(sum(latency_ms),6) AS sum_ms FROM requests GROUP BY 1,2",
)
def st6(t: Inputs) -> DataFrame:
    histogram = counters.latency_histogram(_event_stream(t))
    return _with_start(tables.upsert_available(histogram, ["window_start", "endpoint"], staging_path(t.spark, "histogram")))


@query(
    "st6_sliding_histogram", "requests",
    sql=f"""SELECT CAST(s AS BIGINT) AS window_start, endpoint, {_BUCKETS}, count(*) AS n, round(sum(latency_ms),6) AS sum_ms
      FROM (SELECT *, unnest([epoch_us(ts)//1800000000*1800, epoch_us(ts)//1800000000*1800-1800]) AS s FROM requests) GROUP BY 1,2""",
)
def st6_sliding(t: Inputs) -> DataFrame:
    histogram = counters.latency_histogram(_event_stream(t), slide="30 minutes")
    return _with_start(tables.upsert_available(histogram, ["window_start", "endpoint"], staging_path(t.spark, "sliding")))


@query(
    "st6_latency_quantiles", "requests",
    sql=f"SELECT {_HOUR.replace('3600000000*3600', '86400000000*86400')} AS window_start, endpoint, count(*) AS n, true AS p50_within, true AS p95_within FROM requests GROUP BY 1,2",
)
def st6_quantiles(t: Inputs) -> DataFrame:
    """Sketches of six hours come from the stream, merge into days, and their medians and 95th
    percentiles are placed among the exact latencies of the table."""
    sketches = counters.latency_sketches(_event_stream(t), size="6 hours")
    kept = tables.upsert_available(sketches, ["window_start", "endpoint"], staging_path(t.spark, "sketches"))
    days = staged(counters.merged_sketches(kept, "1 day"), "day-sketches")
    found = counters.sketch_quantiles(days, {"p50": 0.5, "p95": 0.95})
    rows = t.requests.select(F.window("ts", "1 day")["start"].alias("window_start"), "endpoint", "latency_ms")
    placed = rows.join(found, ["window_start", "endpoint"]).groupBy("window_start", "endpoint", "n", "p50", "p95").agg(
        *[F.count_if(F.col("latency_ms") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")],
        *[F.count_if(F.col("latency_ms") <= F.col(p)).alias(f"{p}_upto") for p in ("p50", "p95")], F.count("*").alias("rows"),
    )

    def within(p: str, q: float) -> Column:
        slack = counters.RANK_ERROR * F.col("rows") + 1
        return (F.col("n") == F.col("rows")) & (F.col(f"{p}_below") <= q * F.col("rows") + slack) & (F.col(f"{p}_upto") >= q * F.col("rows") - slack)

    return _with_start(placed.select("window_start", "endpoint", F.col("rows").alias("n"), within("p50", 0.5).alias("p50_within"), within("p95", 0.95).alias("p95_within")))


@query(
    "st7_pages_processed", "requests",
    sql=f"SELECT {_HOUR} AS window_start, 'model-'||(user_id%3) AS model, CASE event_id%4 WHEN 0 THEN 'trocr_fast' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'vlm_fallback' ELSE 'human_only' END AS route, count(*) AS pages FROM requests GROUP BY 1,2,3",
)
def st7(t: Inputs) -> DataFrame:
    e = mod(F.col("event_id"), 4)
    route = F.when(e == 0, "trocr_fast").when(e == 1, "hybrid").when(e == 2, "vlm_fallback").otherwise("human_only")
    pages = _event_stream(t).withColumns({"model": F.concat(F.lit("model-"), mod(F.col("user_id"), 3).cast("string")), "route": route})
    rows = tables.upsert_available(
        counters.pages_processed(pages), ["window_start", "model", "route"], staging_path(t.spark, "pages")
    )
    return _with_start(rows)


@query(
    "st7_job_counters", "requests",
    sql="SELECT 'job-'||user_id AS job_id, count(*) AS pages_total, count(*) FILTER (status=200) AS pages_completed, count(*) FILTER (status=500) AS pages_failed FROM requests GROUP BY 1",
)
def st7_jobs(t: Inputs) -> DataFrame:
    status = F.when(F.col("status") == 200, "completed").otherwise("failed")
    pages = _event_stream(t).select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), status.alias("status"), "ts")
    return counters.job_totals(tables.upsert_available(counters.job_counters(pages), ["window_start", "job_id"], staging_path(t.spark, "jobs")))


@query(
    "st8_corrections",
    sql="SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1",
)
def st8(t: Inputs) -> DataFrame:
    """Every event arrives twice as a correction, the second time a micro-batch later, and counts once."""
    rows = _event_slices(t).select(
        "ts", F.col("event_id").cast("string").alias("item_id"), F.col("event_type").alias("failure_category"), "slice"
    )
    again = rows.withColumn("slice", F.least(F.col("slice") + 1, F.lit(SLICES - 1)))
    return work.correction_counts(_sliced(rows.unionByName(again), "corrections"), staging_path(t.spark, "corrections"))


@query(
    "st9_consent_stream", "ledger",
    sql=f"""SELECT * FROM (WITH accepted AS (SELECT l.subject_token_sha256, l.event_type, l.occurred_at, l.sequence FROM {_REPLAY} r JOIN ledger l USING (event_id) WHERE reason='')
      SELECT l.event_id AS sample_id, coalesce((SELECT arg_max(a.event_type, a.sequence) FROM accepted a
          WHERE a.subject_token_sha256=l.subject_token_sha256 AND a.occurred_at <= l.occurred_at + INTERVAL 3 HOUR), 'withdrawal_closed')='withdrawal_closed' AS allowed
      FROM ledger l WHERE date_diff('day', DATE '2024-01-01', CAST(l.occurred_at + INTERVAL 3 HOUR AS DATE))>=8)""",
)
def st9(t: Inputs) -> DataFrame:
    """Withdrawals of the first eight days are the state to start from; then samples and
    withdrawals arrive side by side, in three micro-batches."""
    spark = t.spark
    day = lambda c: F.datediff(F.col(c), F.lit("2024-01-01"))
    events = staged(t.ledger.select(*EVENT_COLUMNS), "consent-events")
    three = F.expr("INTERVAL 3 HOURS")
    samples = staged(
        events.select("subject_token_sha256", F.col("event_id").alias("sample_id"), (F.col("occurred_at") + three).alias("arrived_at")), "consent-samples"
    )
    started = staged(SL.withdrawal_states(events.filter(day("occurred_at") < 8)), "started")
    folder = staging_path(spark, "consent-source")
    for low, high in ((8, 15), (15, 22), (22, 99)):
        for name, rows, at in (("events", events, "occurred_at"), ("samples", samples, "arrived_at")):
            rows.filter((day(at) >= low) & (day(at) < high)).repartition(FILES).write.mode("append").parquet(f"{folder}/{name}")
    gate = SL.consent_gate(
        tables.read_files(spark, samples.schema, f"{folder}/samples", FILES), tables.read_files(spark, events.schema, f"{folder}/events", FILES), started,
    )
    return tables.append_available(gate, staging_path(spark, "consented")).select("sample_id", "allowed")
