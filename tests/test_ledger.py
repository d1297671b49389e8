import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioscore import vocab
from folioscore.operators import ledger as L
from folioscore.sources import scans
from folioscore.streaming import ledger as SL, tables

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
KINDS = vocab.EVENT_TYPES


def now():
    return F.lit("2024-12-31 00:00:00").cast("timestamp")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chain(steps, tamper=None):
    """A true hash chain: `steps` are (subject, kind, day), each event hashes the one before."""
    rows, previous = [], vocab.ZERO_SHA256
    for n, (subject, kind, day) in enumerate(steps, 1):
        when = (START + timedelta(days=day)).isoformat().replace("+00:00", "Z")
        event = {
            "schema_version": 1, "sequence": n, "event_id": f"evt-{n:032x}", "event_type": kind,
            "occurred_at": when, "recorded_at": when, "pilot_id": "pilot-cohort-0001",
            "subject_token_sha256": sha(subject), "scope_sha256": sha("scope" + subject),
            "actor_role": "storage_operator", "evidence_reference": "evidence-file",
            "evidence_sha256": sha("evidence"), "previous_event_sha256": previous,
        }
        event["event_sha256"] = sha(json.dumps(event, sort_keys=True, separators=(",", ":")))
        previous = event["event_sha256"]
        rows.append(event)
    if tamper is not None:
        rows[tamper]["evidence_sha256"] = sha("other")
    return rows


def load(spark, tmp_path, rows):
    path = tmp_path / "ledger.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return scans.ledger_events(spark, str(path))


def complete(subject, day):
    return [(subject, kind, day + i) for i, kind in enumerate(KINDS)]


def test_complete_withdrawals(spark, tmp_path):
    rows = chain([s for n in range(60) for s in complete(f"s{n}", 5 * n)])
    events = load(spark, tmp_path, rows)
    assert events.filter(F.size("errors") > 0).isEmpty()
    assert L.chain_breaks(events).isEmpty()
    assert L.sequence_gaps(events).head()["gap_free"]
    assert L.time_regressions(events, now()).isEmpty()
    assert L.transition_errors(events).isEmpty()
    assert L.check_events(events.drop("errors"), now()).filter(F.size("errors") > 0).isEmpty()
    summary = L.ledger_summary(events, 14, now()).head()
    assert summary["status"] == "lifecycle_ready" and summary["closed_withdrawals"] == 60
    assert summary["head_sha256"] == rows[-1]["event_sha256"]


def test_content_hash_of_an_event(spark, tmp_path):
    rows = chain(complete("a", 0), tamper=2)
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    from folioscore import schemas

    parsed = raw.select(F.from_json("value", schemas.LEDGER_EVENT).alias("e")).select("e.*")
    broken = parsed.filter(L.event_hash() != F.col("event_sha256"))
    assert [r["sequence"] for r in broken.collect()] == [3]


def test_broken_chain_gap_and_extra_key(spark, tmp_path):
    rows = chain(complete("a", 0) + complete("b", 10))
    rows[4]["previous_event_sha256"] = sha("x")
    rows[6]["note"] = "extra"
    rows[7]["occurred_at"] = "2024-01-14T00:00:00"
    events = load(spark, tmp_path, rows)
    assert [r["sequence"] for r in L.chain_breaks(events).collect()] == [5]
    errors = {r["sequence"]: r["errors"] for r in events.collect()}
    assert errors[7] == ["fields"] and errors[8] == ["occurred_at"]
    assert not L.sequence_gaps(events.filter("sequence <> 3")).head()["gap_free"]
    assert not L.sequence_gaps(events.unionByName(events.filter("sequence = 8"))).head()["gap_free"]


def test_illegal_transitions(spark, tmp_path):
    request, primary, backup, close = KINDS
    steps = [
        ("a", primary, 0), ("a", request, 1), ("a", request, 2), ("a", close, 3), ("a", primary, 4),
        ("a", primary, 5), ("b", request, 6), ("b", primary, 7), ("b", backup, 8), ("b", close, 9), ("b", backup, 10),
    ]
    got = {r["sequence"]: r["errors"] for r in L.transition_errors(load(spark, tmp_path, chain(steps))).collect()}
    assert got[1] == ["before_request"] and got[3] == ["duplicate_request"] and got[4] == ["closed_early"]
    assert "duplicate_primary" in got[6] and "after_close" in got[11]
    assert not {2, 7, 8, 9, 10} & set(got)


def test_deadlines(spark, tmp_path):
    request, primary, backup, close = KINDS
    late = [("a", request, 0), ("a", primary, 1), ("a", backup, 2), ("a", close, 20), ("b", request, 21)]
    summary = L.ledger_summary(load(spark, tmp_path, chain(late)), 14, now()).head()
    assert (summary["open_withdrawals"], summary["deadline_breaches"]) == (1, 2)
    assert summary["status"] == "lifecycle_attention_required"
    with pytest.raises(ValueError):
        L.ledger_summary(load(spark, tmp_path, chain(late)), 31, now())


def test_open_withdrawals_block_samples(spark, tmp_path):
    events = load(spark, tmp_path, chain([("a", KINDS[0], 0), *complete("b", 1)]))
    rows = spark.createDataFrame([(sha("a"),), (sha("b"),), (sha("c"),)], "subject_token_sha256 string")
    kept = {r[0] for r in L.consented(rows, L.open_withdrawals(events)).collect()}
    assert kept == {sha("b"), sha("c")}


def test_repeated_sequence_numbers_do_not_multiply(spark, tmp_path):
    events = load(spark, tmp_path, chain(complete("a", 0)))
    many = events.unionByName(events).unionByName(events)
    assert L._with_previous(many, "event_sha256").count() == 12


def test_stream_replays_across_batches_and_restarts(spark, tmp_path):
    """One event per micro-batch and a stop in the middle give the verdicts of a single run."""
    request, primary, backup, close = KINDS
    steps = [("a", request, 0), ("a", close, 1), ("a", primary, 2), ("a", backup, 3), ("a", close, 4), ("a", backup, 5)]
    events = load(spark, tmp_path, chain(steps)).drop("errors")
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    rows = events.orderBy("sequence").collect()

    def write(part):
        for row in part:
            spark.createDataFrame([row], events.schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = tables.read_files(spark, events.schema, source, files_per_trigger=1)
        return tables.append_available(SL.ledger_verdicts(stream), out)

    write(rows[:3])
    run()
    write(rows[3:])
    got = {r["sequence"]: r["reason"] for r in run().collect()}
    assert got == {1: None, 2: "closed_early", 3: None, 4: None, 5: None, 6: "after_close"}
