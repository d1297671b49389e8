"""Withdrawal ledger: chain, order and state checks without a window over a whole pilot.

Every check compares an event with the one before it, or with the first event of each kind
of its subject. The first needs an equi-join on (pilot, sequence), which spreads evenly; the
second needs minima that combine before the shuffle. No task ever sorts a pilot's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscore import vocab
from folioscore.functions.digests import canonical_sha256
from folioscore.operators.rules import Rule, is_role, is_sha256, validate


def event_hash() -> Column:
    """Content hash of an event: every field except the hash itself."""
    fields = [c for c in vocab.EVENT_COLUMNS if c != "event_sha256"]
    return canonical_sha256(**{c: F.col(c) for c in fields})


def expected_actor(owner: Column, operator: Column, deletion_owner: Column) -> Column:
    return (
        F.when(F.col("event_type") == vocab.WITHDRAWAL_REQUESTED, owner)
        .when(F.col("event_type") == vocab.WITHDRAWAL_CLOSED, deletion_owner)
        .otherwise(operator)
    )


def event_rules(now: Column) -> list[Rule]:
    """Rules of a single event with timestamp columns."""
    c = F.col
    return [
        Rule("schema_version", c("schema_version") == 1),
        Rule("event_type", c("event_type").isin(*vocab.EVENT_TYPES)),
        Rule("event_id", c("event_id").rlike(vocab.EVENT_ID)),
        Rule("pilot_id", c("pilot_id").rlike(vocab.PILOT_ID)),
        *[
            Rule(n, is_sha256(c(n), fold_case=False))
            for n in (
                "subject_token_sha256", "scope_sha256", "evidence_sha256",
                "previous_event_sha256", "event_sha256",
            )
        ],
        Rule("actor_role", is_role(c("actor_role"))),
        Rule("evidence_reference", c("evidence_reference").rlike(vocab.REFERENCE_ID)),
        Rule("timestamps", (c("occurred_at") <= c("recorded_at")) & (c("recorded_at") <= now)),
    ]


def check_events(events: DataFrame, now: Column) -> DataFrame:
    return validate(events, event_rules(now))


def _with_previous(events: DataFrame, *columns: str) -> DataFrame:
    """Each event with columns of the event before it in its pilot, as `prev_<column>`."""
    # A repeated sequence number keeps one predecessor, so the join never multiplies rows.
    before = events.groupBy("pilot_id", (F.col("sequence") + 1).alias("sequence")).agg(
        F.max(F.struct(*[F.col(c).alias(f"prev_{c}") for c in columns])).alias("p")
    )
    return events.join(before.select("pilot_id", "sequence", "p.*"), ["pilot_id", "sequence"], "left")


def chain_breaks(events: DataFrame) -> DataFrame:
    """Events whose previous hash is not the hash of the event before them."""
    expected = F.coalesce(
        "prev_event_sha256", F.when(F.col("sequence") == 1, F.lit(vocab.ZERO_SHA256))
    )
    return _with_previous(events, "event_sha256").filter(
        ~F.col("previous_event_sha256").eqNullSafe(expected)
    ).select("pilot_id", "sequence", "event_id")


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Per pilot: is the sequence exactly 1..n?"""
    per_number = events.groupBy("pilot_id", "sequence").agg(F.count("*").alias("n"))
    return per_number.groupBy("pilot_id").agg(
        F.sum("n").alias("events"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
        (
            (F.min("sequence") == 1) & (F.max("sequence") == F.sum("n")) & (F.max("n") == 1)
        ).alias("gap_free"),
    )


def time_regressions(events: DataFrame, now: Column) -> DataFrame:
    """Events recorded before they occurred, in the future, or earlier than their predecessor."""
    checked = validate(
        _with_previous(events, "occurred_at", "recorded_at"),
        [
            Rule("occurred_after_recorded", F.col("occurred_at") <= F.col("recorded_at")),
            Rule("recorded_in_future", F.col("recorded_at") <= now),
            Rule(
                "occurred_regressed",
                F.col("prev_occurred_at").isNull() | (F.col("occurred_at") >= F.col("prev_occurred_at")),
            ),
            Rule(
                "recorded_regressed",
                F.col("prev_recorded_at").isNull() | (F.col("recorded_at") >= F.col("prev_recorded_at")),
            ),
        ],
    )
    return checked.filter(F.size("errors") > 0).select("pilot_id", "sequence", "errors")


def subject_milestones(events: DataFrame) -> DataFrame:
    """Per subject: the first request, its scope, and the first event of every other kind."""
    def first(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("sequence")))

    requested = F.col("event_type") == vocab.WITHDRAWAL_REQUESTED
    closed = F.col("event_type") == vocab.WITHDRAWAL_CLOSED
    return events.groupBy("pilot_id", "subject_token_sha256").agg(
        F.count("*").alias("n_events"),
        F.max(F.struct("sequence", "event_sha256")).alias("head"),
        first(vocab.WITHDRAWAL_REQUESTED).alias("first_request"),
        first(vocab.PRIMARY_DELETED).alias("first_primary"),
        first(vocab.BACKUP_DELETED).alias("first_backup"),
        first(vocab.WITHDRAWAL_CLOSED).alias("first_close"),
        F.min_by(
            F.when(requested, F.col("scope_sha256")), F.when(requested, F.col("sequence"))
        ).alias("request_scope"),
        F.min_by(
            F.when(requested, F.col("occurred_at")), F.when(requested, F.col("sequence"))
        ).alias("requested_at"),
        F.min_by(F.when(closed, F.col("occurred_at")), F.when(closed, F.col("sequence"))).alias(
            "closed_at"
        ),
        F.min_by(F.when(closed, F.col("recorded_at")), F.when(closed, F.col("sequence"))).alias(
            "closed_recorded_at"
        ),
    )


def transition_errors(events: DataFrame) -> DataFrame:
    """Events that are illegal given everything recorded before them for their subject."""
    keys = ["pilot_id", "subject_token_sha256"]
    rows = events.join(subject_milestones(events), keys)
    seq, kind = F.col("sequence"), F.col("event_type")

    def seen(milestone: str) -> Column:
        return F.coalesce(F.col(milestone) < seq, F.lit(False))

    requested, follow_up = seen("first_request"), kind != vocab.WITHDRAWAL_REQUESTED
    rules = [
        Rule("duplicate_request", follow_up | ~requested),
        Rule("before_request", ~follow_up | requested),
        Rule(
            "scope_changed",
            ~follow_up | ~requested | (F.col("scope_sha256") == F.col("request_scope")),
        ),
        Rule("after_close", ~follow_up | ~seen("first_close")),
        Rule("duplicate_primary", (kind != vocab.PRIMARY_DELETED) | ~seen("first_primary")),
        Rule("duplicate_backup", (kind != vocab.BACKUP_DELETED) | ~seen("first_backup")),
        Rule(
            "closed_early",
            (kind != vocab.WITHDRAWAL_CLOSED) | (seen("first_primary") & seen("first_backup")),
        ),
    ]
    checked = validate(rows, rules)
    return checked.filter(F.size("errors") > 0).select("pilot_id", "sequence", "event_id", "errors")


def with_deadlines(milestones: DataFrame, days: int, now: Column) -> DataFrame:
    """Adds `is_open` and `breached`; both are null for a subject without a request."""
    due = F.col("requested_at") + F.make_dt_interval(F.lit(days))
    late_close = (F.col("closed_at") > due) | (F.col("closed_recorded_at") > due)
    requested, is_open = F.col("first_request").isNotNull(), F.col("closed_at").isNull()
    return milestones.withColumns(
        {
            "is_open": F.when(requested, is_open),
            "breached": F.when(requested, F.when(is_open, now > due).otherwise(late_close)),
        }
    )


def ledger_summary(events: DataFrame, days: int, now: Column) -> DataFrame:
    """Per pilot: events, open and closed withdrawals, breaches, head hash and status."""
    if not 1 <= days <= 30:
        raise ValueError("the deletion deadline is between 1 and 30 days")
    totals = with_deadlines(subject_milestones(events), days, now).groupBy("pilot_id").agg(
        F.sum("n_events").alias("num_events"),
        F.count_if("is_open").alias("open_withdrawals"),
        F.count_if(~F.col("is_open")).alias("closed_withdrawals"),
        F.count_if("breached").alias("deadline_breaches"),
        F.max("head")["event_sha256"].alias("head_sha256"),
    )
    ready = (F.col("open_withdrawals") == 0) & (F.col("deadline_breaches") == 0)
    return totals.withColumn(
        "status", F.when(ready, "lifecycle_ready").otherwise("lifecycle_attention_required")
    )


def open_withdrawals(events: DataFrame) -> DataFrame:
    """Subjects with a request that no close has answered."""
    return subject_milestones(events).filter(
        F.col("first_request").isNotNull() & F.col("first_close").isNull()
    ).select("pilot_id", "subject_token_sha256", F.col("request_scope").alias("scope_sha256"))


def consented(samples: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Samples whose subject has no open withdrawal."""
    return samples.join(withdrawals.select("subject_token_sha256"), "subject_token_sha256", "left_anti")
