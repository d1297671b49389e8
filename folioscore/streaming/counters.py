"""Windowed request counters, latency histograms and progress of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed bucket bounds of the latency histogram, in milliseconds.
LATENCY_BUCKETS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]

# Of the quantile sketches: their parameter, and the normalised rank error that goes with it.
SKETCH_K, RANK_ERROR = 400, 0.0083


def _windowed(df: DataFrame, time: str, size: str, slide: str | None, delay: str) -> tuple:
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, delay), window.alias("w")


def request_counts(requests: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests per window, method, endpoint and status; late rows beyond the delay are not counted."""
    rows, window = _windowed(requests, "ts", size, None, delay)
    counts = rows.groupBy(window, "method", "endpoint", "status").agg(F.count("*").alias("requests"))
    return counts.select(F.col("w.start").alias("window_start"), "method", "endpoint", "status", "requests")


def latency_histogram(
    requests: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Cumulative bucket counts, sum and count of latencies per window and endpoint."""
    rows, window = _windowed(requests, "ts", size, slide, delay)
    latency = F.col("latency_ms")
    out = rows.groupBy(window, "endpoint").agg(
        *[F.count_if(latency <= b).alias(f"le_{int(b)}") for b in LATENCY_BUCKETS],
        F.count("*").alias("n"),
        F.sum("latency_ms").alias("sum_ms"),
    )
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def latency_sketches(
    requests: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", k: int = SKETCH_K
) -> DataFrame:
    """A mergeable quantile sketch (KLL) of the latencies per window and endpoint.

    Its size grows with the logarithm of the rows; latencies without a value are left out.
    """
    rows, window = _windowed(requests.filter(F.col("latency_ms").isNotNull()), "ts", size, slide, delay)
    out = rows.groupBy(window, "endpoint").agg(F.kll_sketch_agg_double("latency_ms", k).alias("sketch"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "endpoint", "sketch", "n")


def merged_sketches(sketches: DataFrame, size: str, k: int = SKETCH_K) -> DataFrame:
    """Sketches of short windows as sketches of longer ones, without the rows."""
    out = sketches.groupBy(F.window("window_start", size).alias("w"), "endpoint").agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n")
    )
    return out.select(F.col("w.start").alias("window_start"), "endpoint", "sketch", "n")


def sketch_quantiles(sketches: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """The named quantiles of each sketch; their ranks are off by at most `RANK_ERROR` of n, with
    a confidence of 99 %, also after merging."""
    found = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for name, q in fractions.items()}
    return sketches.select("window_start", "endpoint", "n", *[c.alias(name) for name, c in found.items()])


def pages_processed(pages: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Pages per window, model and route."""
    rows, window = _windowed(pages, "ts", size, None, delay)
    counts = rows.groupBy(window, "model", "route").agg(F.count("*").alias("pages"))
    return counts.select(F.col("w.start").alias("window_start"), "model", "route", "pages")


def job_counters(pages: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Totals per window and job, for update mode; the watermark ends a window's state.

    `job_totals` adds the windows of a job up.
    """
    rows, window = _windowed(pages, "ts", size, None, delay)
    counts = rows.groupBy(window, "job_id").agg(
        F.count("*").alias("pages_total"),
        F.count_if(F.col("status") == "completed").alias("pages_completed"),
        F.count_if(F.col("status") == "failed").alias("pages_failed"),
    )
    return counts.select(F.col("w.start").alias("window_start"), *[c for c in counts.columns if c != "w"])


def job_totals(counters: DataFrame) -> DataFrame:
    """Running totals per job."""
    return counters.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in ("pages_total", "pages_completed", "pages_failed")])
