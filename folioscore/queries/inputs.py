"""Inputs of the registered queries, derived from the given tables, in Spark and in SQL.

Every derivation covers the whole table and the whole text: a document becomes as many
twelve-word lines as it takes. `SQL` holds the same derivations for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscore import vocab
from folioscore.operators.ledger import _with_previous
from folioscore.operators.ordering import position_within
from folioscore.session import ship_package

SQL: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def _sql(name: str, text: str, *needs: str) -> None:
    SQL[name], NEEDS[name] = text, list(needs)


def oracle(body: str, *needs: str) -> str:
    """`body` with the derivations it needs as common table expressions."""
    done: list[str] = []

    def visit(name: str) -> None:
        for inner in NEEDS[name]:
            visit(inner)
        if name not in done:
            done.append(name)

    for name in needs:
        visit(name)
    if not done:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in done)
    return f"WITH {ctes}\n{body}"


def mod(expr: Column, n: int) -> Column:
    return F.pmod(expr, F.lit(n))


def one_line(c: Column) -> Column:
    """A text with every character but its white space, which becomes single spaces.

    A lone space is left as it is, so the pattern replaces few runs of most texts.
    """
    return F.trim(F.regexp_replace(c, r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " "))


TWELVE_WORDS = "(?:[^ ]+ ){0,11}[^ ]+"


def choose(index: Column, values: list) -> Column:
    out = F.when(index == 0, F.lit(values[0]))
    for i, value in enumerate(values[1:], 1):
        out = out.when(index == i, F.lit(value))
    return out


def hundredths(expr: Column, n: int = 101) -> Column:
    return mod(expr, n).cast("double") / F.lit(100.0)


def _distance(a: str, b: str) -> str:
    """SQL for the edit distance in characters of two texts whose distinct characters are `v`.

    The oracle's own function counts bytes, so each character becomes one byte first.
    """
    coded = [f"CASE WHEN {x}='' THEN '' ELSE array_to_string(list_transform(string_split({x},''), lambda t: chr(33+list_position(v,t))),'') END" for x in (a, b)]
    return f"levenshtein({coded[0]},{coded[1]})"


_WITH_CHARACTERS = "SELECT *, list_distinct(string_split(prediction||reference,'')) AS v FROM"

_sql(
    "lines",
    """SELECT d.doc_id, CAST(u.i AS BIGINT) AS line_no, d.lang, d.source, d.quality,
      sha256(d.doc_sha || ':' || u.i) AS source_sha256,
      array_to_string(d.w[u.i*12+1:u.i*12+12], ' ') AS reference, d.doc_id + u.i AS k
    FROM (SELECT t.doc_id, t.lang, t.source, l.quality, sha256(t.text) AS doc_sha,
            string_split(trim(regexp_replace(t.text,'[\\x20\\x09-\\x0D]+',' ','g')),' ') AS w
          FROM documents t LEFT JOIN labels l ON t.doc_id = l.doc_id) d,
      unnest(range(0, (len(d.w)+11)//12)) AS u(i)
    WHERE d.w[1] <> ''""",
)


def _pairs_sql(shift: int, factor: int) -> str:
    return f"""SELECT doc_id, line_no, k, sha256('documents'||chr(0)||'v1'||chr(0)||doc_id||'-'||line_no) AS sample_id,
      source_sha256, reference,
      CASE (k+{shift})%5 WHEN 0 THEN reference || CASE WHEN line_no%2=1 THEN ' ' ELSE '' END
        WHEN 1 THEN replace(reference,'e','c') WHEN 2 THEN substr(reference,2)
        WHEN 3 THEN regexp_replace(reference,' ?[^ ]+$','') ELSE reference||' x' END AS prediction,
      CAST((doc_id*{factor}+line_no*17)%101 AS DOUBLE)/100 AS confidence,
      CAST(50+(doc_id*13+line_no*7)%400 AS DOUBLE) AS latency_ms,
      CAST(1+k%7 AS DOUBLE)/1000 AS cost_per_page_usd,
      list_filter([ 'lang_'||lang, CASE WHEN k%2=0 THEN 'publisher_hash_marker' END,
        'quality_'||quality, 'src_'||CASE WHEN doc_id%2=0 THEN 'even' ELSE 'odd' END ], lambda x: x IS NOT NULL) AS slices,
      source AS writer_id, CASE WHEN doc_id%3=0 THEN 'test' ELSE 'validation' END AS split,
      CAST((doc_id*{factor}+line_no*17)%101 AS DOUBLE)/100 < 0.7 AS is_uncertain,
      CAST((doc_id*{factor}+line_no*17)%101 AS DOUBLE)/100 < 0.4 AS is_unreadable
    FROM lines"""


_sql("pairs", _pairs_sql(0, 37), "lines")
_sql("baseline", _pairs_sql(1, 41), "lines")
_sql(
    "feat",
    f"""SELECT * EXCLUDE (v), CASE WHEN trim(prediction)=trim(reference) THEN 0 ELSE {_distance("trim(prediction)", "trim(reference)")} END AS char_edits,
      length(trim(reference)) AS ref_chars, trim(prediction)=trim(reference) AS exact,
      CAST({_distance("prediction", "reference")} AS DOUBLE)/greatest(length(prediction),length(reference),1) AS ned,
      CAST({_distance("trim(prediction)", "trim(reference)")} AS DOUBLE)/length(trim(reference)) AS line_cer
    FROM ({_WITH_CHARACTERS} pairs)""",
    "pairs",
)
_sql(
    "wfeat",
    """SELECT * EXCLUDE (pw, rw, v), len(rw) AS ref_words,
      levenshtein(array_to_string(list_transform(pw, lambda t: chr(33+list_position(v,t))),''),
                  array_to_string(list_transform(rw, lambda t: chr(33+list_position(v,t))),'')) AS word_edits
    FROM (SELECT *, list_distinct(list_concat(pw,rw)) AS v FROM (
      SELECT *, CASE WHEN trim(prediction)='' THEN []::VARCHAR[] ELSE string_split(trim(prediction),' ') END AS pw,
        string_split(trim(reference),' ') AS rw FROM feat))""",
    "feat",
)
_sql(
    "bfeat",
    f"""SELECT * EXCLUDE (v), {_distance("trim(prediction)", "trim(reference)")} AS char_edits, length(trim(reference)) AS ref_chars,
      trim(prediction)=trim(reference) AS exact FROM ({_WITH_CHARACTERS} baseline)""",
    "baseline",
)
_sql(
    "dirty",
    """SELECT CASE WHEN d=0 THEN ' ' WHEN d=3 THEN sha256('duplicate'||writer_id) ELSE sample_id END AS sample_id,
      CASE WHEN d=1 THEN 'xyz' ELSE source_sha256 END AS source_sha256, reference, prediction,
      CASE WHEN d=2 THEN 1.5::DOUBLE ELSE confidence END AS confidence, slices,
      CASE WHEN d=4 THEN NULL ELSE latency_ms END AS latency_ms, cost_per_page_usd, k
    FROM (SELECT *, CASE WHEN k%50=0 THEN (k//50)%5 END AS d FROM pairs)""",
    "pairs",
)
_sql(
    "label_rows",
    """SELECT 'line-'||doc_id||'-'||line_no||'.png' AS filename, reference AS text, writer_id,
      array_to_string(slices,'|') AS slices, k, doc_id, line_no, source_sha256 FROM pairs""",
    "pairs",
)
_sql(
    "manifest",
    """SELECT sha256('lines'||chr(0)||'v1'||chr(0)||'images/'||filename) AS sample_id, source_sha256,
      'images/'||filename AS image_path, text AS reference,
      sha256('lines'||chr(0)||'v1'||chr(0)||writer_id) AS writer_id, slices, k FROM label_rows""",
    "label_rows",
)
_sql(
    "protected_labels",
    """SELECT CASE WHEN k%11=0 THEN 'scan_'||doc_id||'_'||line_no||'.png' ELSE 'sample-'||substr(sample_id,1,24)||'.png' END AS filename,
      CASE WHEN k%19=0 THEN reference||' ' ELSE reference END AS text,
      CASE WHEN k%13=0 THEN writer_id ELSE 'writer-'||substr(sha256(writer_id),1,16) END AS writer_id,
      CASE WHEN k%17=0 THEN 'essay|camera' ELSE 'camera|essay' END AS slices,
      CASE k%5 WHEN 0 THEN '5-7' WHEN 1 THEN '8-10' WHEN 2 THEN '11-13' WHEN 3 THEN '14-17' ELSE '18+' END AS age_band,
      CASE k%4 WHEN 0 THEN 'essay' WHEN 1 THEN 'short_answer' WHEN 2 THEN 'worksheet' ELSE 'memo' END AS document_type,
      CASE k%3 WHEN 0 THEN 'camera' WHEN 1 THEN 'scan' ELSE 'fax' END AS capture_type, sample_id
    FROM pairs""",
    "pairs",
)
_sql(
    "reviews",
    """SELECT CASE WHEN k%29=0 THEN 'orphan-' ELSE '' END || 'line-'||doc_id||'-'||line_no||'.png' AS filename,
      'annotator-'||substr(sha256('a'||writer_id),1,12) AS annotator_1_id,
      CASE WHEN k%31=0 THEN 'annotator-'||substr(sha256('a'||writer_id),1,12) ELSE 'annotator-'||substr(sha256('b'||writer_id),1,12) END AS annotator_2_id,
      sha256(reference) AS pass_1_sha256,
      CASE WHEN k%4=0 THEN sha256(reference||'?') ELSE sha256(reference) END AS pass_2_sha256,
      CASE WHEN k%23=0 THEN sha256(reference||'!') ELSE sha256(reference) END AS final_sha256,
      CASE WHEN k%4=0 THEN 'adjudicated' ELSE 'agreed' END AS status,
      CASE WHEN k%4=0 THEN 'annotator-'||substr(sha256('c'||writer_id),1,12) ELSE '' END AS adjudicator_id,
      CASE WHEN k%4=0 THEN CASE WHEN k%37=0 THEN 'taste' ELSE 'transcription_disagreement' END ELSE '' END AS adjudication_reason,
      CASE WHEN k%41=0 THEN 'false' ELSE 'true' END AS crop_reviewed,
      CAST(20+k%30 AS DOUBLE) AS pass_1_seconds, CAST(25+k%20 AS DOUBLE) AS pass_2_seconds,
      CAST(CASE WHEN k%4=0 THEN 10+k%15 ELSE 0 END AS DOUBLE) AS adjudication_seconds, writer_id
    FROM pairs""",
    "pairs",
)
_sql(
    "corpus_lines",
    """SELECT printf('%04d-%03d', doc_id//25, doc_id%25) || ',' || ((doc_id*7)%300) || ' ' ||
      CASE WHEN doc_id%3=0 THEN substr(t,1,3)||'#'||substr(t,4) ELSE t END AS value
    FROM (SELECT doc_id, trim(regexp_replace(text,'[\\x20\\x09-\\x0D]+',' ','g')) AS t FROM documents)""",
)
_sql(
    "corpus",
    r"""SELECT sample_id, split_part(sample_id,'-',1) AS writer_id, reference, contains(reference,'#') AS marked,
      trim(regexp_replace(replace(reference,'#',''),'\s+',' ','g')) AS normalized_reference, threshold
    FROM (SELECT regexp_extract(value,'^([0-9]{4,}-[0-9]{3}),([0-9]+)\s+(.*)$',1) AS sample_id,
      TRY_CAST(regexp_extract(value,'^([0-9]{4,}-[0-9]{3}),([0-9]+)\s+(.*)$',2) AS INT) AS threshold,
      regexp_extract(value,'^([0-9]{4,}-[0-9]{3}),([0-9]+)\s+(.*)$',3) AS reference FROM corpus_lines)""",
    "corpus_lines",
)
_sql(
    "blocks",
    """SELECT conv_id AS page_id, turn AS reading_order, turn AS block_no,
      CASE role WHEN 'user' THEN 'student_handwriting' WHEN 'assistant' THEN 'printed_text' ELSE 'margin_insertion' END AS type,
      t AS text, CAST((conv_id*31+turn*17)%129 AS DOUBLE)/128 AS confidence, (conv_id+turn)%7=0 AS crossed_out,
      10 AS x1, 40*turn AS y1, 10+8*length(t) AS x2, 40*turn+30 AS y2,
      CAST((conv_id*31+turn*17)%129 AS DOUBLE)/128 < 0.7 AS is_uncertain
    FROM (SELECT *, trim(regexp_replace(text,'[\\x20\\x09-\\x0D]+',' ','g')) AS t FROM conversations)""",
)
_sql(
    "pixels",
    """SELECT vec_id AS page_id, (i-1)//8 AS y, (i-1)%8 AS x,
      CAST(greatest(0, least(255, floor(127.5+400*CAST(embedding[i] AS DOUBLE)))) AS INT) AS v
    FROM embeddings, unnest(range(1, len(embedding)+1)) AS u(i)""",
)
_sql(
    "measurements",
    """SELECT page_id, CAST((h*53)%400 AS DOUBLE) AS blur, 400+(h*37)%900 AS width, 500+(tags*29)%900 AS height,
      CAST((tags*7)%41-20 AS DOUBLE) AS skew, CAST((h*29+tags)%256 AS DOUBLE) AS brightness,
      tags%11=0 AS has_glare, h%13=0 AS has_shadow, (h+tags)%17=0 AS is_blank
    FROM (SELECT page_id, CAST(coalesce(length(html),0) AS BIGINT) AS h, CAST(coalesce(length(html)-length(replace(html,'<','')),0) AS BIGINT) AS tags FROM pages)""",
)
_sql(
    "quality",
    """SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE
        - CASE WHEN blur<100 THEN 0.3 ELSE 0 END::DOUBLE - CASE WHEN least(width,height)<640 THEN 0.25 ELSE 0 END::DOUBLE
        - CASE WHEN abs(skew)>15 THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN brightness<40 OR brightness>220 THEN 0.2 ELSE 0 END::DOUBLE
        - CASE WHEN has_glare THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN has_shadow THEN 0.15 ELSE 0 END::DOUBLE
        - CASE WHEN is_blank THEN 1.0 ELSE 0 END::DOUBLE) AS score,
      list_filter([CASE WHEN blur<100 THEN 'blur' END, CASE WHEN least(width,height)<640 THEN 'low_resolution' END,
        CASE WHEN abs(skew)>15 THEN 'skew' END,
        CASE WHEN brightness<40 THEN 'underexposed' WHEN brightness>220 THEN 'overexposed' END,
        CASE WHEN has_glare THEN 'glare' END, CASE WHEN has_shadow THEN 'shadow' END,
        CASE WHEN is_blank THEN 'blank_page' END], lambda x: x IS NOT NULL) AS issues FROM measurements""",
    "measurements",
)
_sql(
    "recommended",
    """SELECT *, CASE WHEN is_blank THEN 'skip' WHEN score<0.3 THEN 're-upload' WHEN score<0.6 THEN 'vlm_fallback' ELSE 'process' END AS recommendation,
      len(issues)=0 OR (score>0.5 AND NOT is_blank) AS passed FROM quality""",
    "quality",
)
_sql(
    "layout",
    """SELECT page_id, count(DISTINCT type) AS n_types, count(*) FILTER (type='student_handwriting') AS handwriting_lines,
      count(*) FILTER (crossed_out) AS crossed_out_lines, count(*) FILTER (type='margin_insertion') AS insertions,
      bool_or(type='printed_text') AND bool_or(type='student_handwriting') AS mixed FROM blocks GROUP BY 1""",
    "blocks",
)
_sql(
    "routed",
    """SELECT *, CASE WHEN recommendation='re-upload' THEN 'human_only' WHEN complexity<3 THEN 'trocr_fast'
        WHEN complexity<7 THEN 'hybrid' ELSE 'vlm_fallback' END AS route
    FROM (SELECT r.*, handwriting_lines, least(10.0::DOUBLE, (len(issues)*1.5 + (coalesce(n_types,0)-1) + coalesce(crossed_out_lines,0)*0.5
        + coalesce(insertions,0) + CASE WHEN coalesce(mixed,false) THEN 2 ELSE 0 END)::DOUBLE) AS complexity
      FROM recommended r LEFT JOIN layout l ON r.page_id=l.page_id)""",
    "recommended",
    "layout",
)
_sql(
    "ranked_events",
    """SELECT *, (n-1)//4 AS cycle, sha256('subject:'||user_id||':'||((n-1)//4)) AS subject,
      'pilot-cohort-'||printf('%04d', user_id%8) AS pilot_id
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""",
)
_sql(
    "ledger0",
    """SELECT pilot_id, row_number() OVER (PARTITION BY pilot_id ORDER BY ts, event_id) AS sequence,
      'evt-'||md5(CAST(event_id AS VARCHAR)) AS event_id, subject AS subject_token_sha256, ts,
      CASE WHEN (user_id+cycle)%10=0 THEN
        CASE (n-1)%4 WHEN 0 THEN 'consent_withdrawal_requested' WHEN 1 THEN 'primary_deletion_verified'
          WHEN 2 THEN 'backup_deletion_verified' ELSE 'primary_deletion_verified' END
      WHEN (user_id+cycle)%15=1 THEN
        CASE (n-1)%4 WHEN 0 THEN 'consent_withdrawal_requested' WHEN 1 THEN 'withdrawal_closed'
          WHEN 2 THEN 'primary_deletion_verified' ELSE 'backup_deletion_verified' END
      ELSE CASE (n-1)%4 WHEN 0 THEN 'consent_withdrawal_requested' WHEN 1 THEN 'primary_deletion_verified'
          WHEN 2 THEN 'backup_deletion_verified' ELSE 'withdrawal_closed' END END AS event_type
    FROM ranked_events""",
    "ranked_events",
)
_sql(
    "ledger1",
    """SELECT *, sha256(event_id||'|'||event_type||'|'||subject_token_sha256||'|'||epoch_us(ts)) AS event_sha256,
      ts AS occurred_at, ts + CASE WHEN sequence%89=0 THEN INTERVAL (-1) MINUTE ELSE INTERVAL 1 MINUTE END AS recorded_at,
      sha256('scope:'||subject_token_sha256||CASE WHEN sequence%53=0 THEN '?' ELSE '' END) AS scope_sha256 FROM ledger0""",
    "ledger0",
)
_sql(
    "ledger",
    """SELECT *, CASE WHEN sequence%97=0 THEN repeat('f',64) ELSE
      coalesce(lag(event_sha256) OVER (PARTITION BY pilot_id ORDER BY sequence), repeat('0',64)) END AS previous_event_sha256 FROM ledger1""",
    "ledger1",
)
_sql(
    "milestones",
    """SELECT pilot_id, subject_token_sha256,
      min(sequence) FILTER (event_type='consent_withdrawal_requested') AS first_request,
      min(sequence) FILTER (event_type='primary_deletion_verified') AS first_primary,
      min(sequence) FILTER (event_type='backup_deletion_verified') AS first_backup,
      min(sequence) FILTER (event_type='withdrawal_closed') AS first_close,
      arg_min(scope_sha256, sequence) FILTER (event_type='consent_withdrawal_requested') AS request_scope,
      arg_min(occurred_at, sequence) FILTER (event_type='consent_withdrawal_requested') AS requested_at,
      arg_min(occurred_at, sequence) FILTER (event_type='withdrawal_closed') AS closed_at,
      arg_min(recorded_at, sequence) FILTER (event_type='withdrawal_closed') AS closed_recorded_at
    FROM ledger GROUP BY 1,2""",
    "ledger",
)
_sql(
    "requests",
    """SELECT event_id, ts, event_type AS endpoint, CASE WHEN CAST(json_extract(props,'$.k') AS INT)>=90 THEN 500 ELSE 200 END AS status,
      value AS latency_ms, user_id, CASE WHEN event_id%3=0 THEN 'POST' ELSE 'GET' END AS method FROM events""",
)
_sql(
    "al_items",
    """SELECT sample_id AS item_id, confidence, CASE k%6 WHEN 0 THEN 'faint_pencil' WHEN 1 THEN 'joined_cursive' WHEN 2 THEN 'touching_lines'
        WHEN 3 THEN 'crossed_out' WHEN 4 THEN 'heavy_blur' END AS failure_category,
      CAST((k*11)%120 AS DOUBLE) AS correction_impact, CAST(5+(k*3)%40 AS DOUBLE) AS label_seconds, k FROM pairs""",
    "pairs",
)
_sql(
    "frequencies",
    """SELECT coalesce(failure_category,'unknown') AS category, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM al_items) AS frequency
    FROM al_items GROUP BY 1""",
    "al_items",
)
_sql(
    "old_frequencies",
    """SELECT p_brand AS category, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM part) AS frequency FROM part GROUP BY 1""",
)
_sql(
    "scored",
    """SELECT a.*, coalesce(f.frequency,0.5::DOUBLE) AS frequency, 0.4::DOUBLE*(1-confidence)+0.2::DOUBLE*coalesce(f.frequency,0.5::DOUBLE)
      +0.3::DOUBLE*least(1.0::DOUBLE,correction_impact/60)+0.1::DOUBLE*(1.0::DOUBLE/greatest(1.0::DOUBLE,label_seconds/10)) AS priority_score
    FROM al_items a LEFT JOIN frequencies f ON coalesce(a.failure_category,'unknown')=f.category""",
    "frequencies",
)
_sql(
    "failures",
    """SELECT *, list_sort(list_filter([CASE WHEN line_cer>=0.25 THEN 'character_error_ge_0_25' WHEN line_cer>=0.1 THEN 'character_error_0_10_to_0_25' ELSE 'character_error_below_0_10' END,
        CASE WHEN list_contains(slices,'publisher_hash_marker') THEN 'publisher_correction_marker' END,
        CASE WHEN confidence>=0.9 THEN 'high_confidence_exact_error' END,
        CASE WHEN is_uncertain THEN 'model_marked_uncertain' END,
        CASE WHEN is_unreadable THEN 'model_marked_unreadable' END], lambda x: x IS NOT NULL)) AS categories
    FROM feat WHERE NOT exact""",
    "feat",
)
_sql(
    "prioritised",
    """SELECT p.sample_id, p.source_sha256, coalesce(least(f.line_cer,1.0::DOUBLE)*0.4::DOUBLE+f.confidence*0.25::DOUBLE
        +CASE WHEN list_contains(f.categories,'publisher_correction_marker') THEN 0.15 ELSE 0 END::DOUBLE
        +CASE WHEN list_contains(f.categories,'model_marked_uncertain') THEN 0.1 ELSE 0 END::DOUBLE
        +CASE WHEN list_contains(f.categories,'high_confidence_exact_error') THEN 0.1 ELSE 0 END::DOUBLE, -1.0::DOUBLE) AS priority
    FROM pairs p LEFT JOIN failures f ON p.sample_id=f.sample_id WHERE p.split='validation'""",
    "failures",
)
_sql(
    "instances",
    f"""SELECT sample_id AS instance_id, CASE k%6 WHEN 0 THEN 'faint_pencil' WHEN 1 THEN 'joined_cursive' WHEN 2 THEN 'touching_lines'
        WHEN 3 THEN 'crossed_out' WHEN 4 THEN 'heavy_blur' ELSE 'unknown' END AS category,
      'images/'||doc_id||'-'||line_no||'.png' AS image_path, prediction AS predicted_text, reference AS reference_text,
      confidence, CASE WHEN k%6=5 THEN 0.0::DOUBLE ELSE CAST({_distance("trim(prediction)", "trim(reference)")} AS DOUBLE)/length(trim(reference)) END AS cer, model_version
    FROM ({_WITH_CHARACTERS} (SELECT *, 'v1' AS model_version FROM pairs UNION ALL SELECT *, 'v2' AS model_version FROM baseline))""",
    "pairs",
    "baseline",
)
_sql(
    "versions",
    """SELECT 'v'||p_partkey AS version, p_type AS model_type, CAST((p_partkey*7)%100 AS DOUBLE)/1000 AS cer, (p_partkey*7919)%100003 AS promoted_seq FROM part""",
)


class Inputs:
    """The derived tables of one scale folder."""

    # Shift and factor of the predictions of two models.
    MODEL, BASELINE = (0, 37), (1, 41)

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship_package(spark), folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """A scan with fewer partitions than cores is spread before costly row work.

        A large table has more partitions than that and is left alone, without a shuffle.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def lines(self) -> DataFrame:
        documents = self.spread(self.table("documents")).select(
            "doc_id", "lang", "source", F.sha2("text", 256).alias("doc_sha"),
            F.regexp_extract_all(one_line(F.col("text")), F.lit(TWELVE_WORDS), F.lit(0)).alias("cut"),
        )
        joined = documents.join(self.table("labels").select("doc_id", "quality"), "doc_id", "left")
        rows = joined.select(
            # The outer form keeps Spark from inferring a filter that repeats the expression.
            "doc_id", "lang", "source", "quality", "doc_sha",
            F.posexplode_outer("cut").alias("pos", "reference"),
        ).filter(F.col("pos").isNotNull())
        line = F.col("pos").cast("long")
        return rows.select(
            "doc_id", line.alias("line_no"), "lang", "source", "quality",
            F.sha2(F.concat_ws(":", "doc_sha", line), 256).alias("source_sha256"),
            "reference", (F.col("doc_id") + line).alias("k"),
        )

    def _predicted(self, shift: int, factor: int) -> tuple[Column, Column]:
        """Prediction and confidence of a line."""
        k, reference = F.col("k"), F.col("reference")
        pick = mod(k + shift, 5)
        padded = F.when(mod(F.col("line_no"), 2) == 1, F.concat(reference, F.lit(" "))).otherwise(reference)
        prediction = (
            F.when(pick == 0, padded)
            .when(pick == 1, F.replace(reference, F.lit("e"), F.lit("c")))
            .when(pick == 2, F.substring(reference, 2, 1 << 30))
            .when(pick == 3, F.regexp_replace(reference, " ?[^ ]+$", ""))
            .otherwise(F.concat(reference, F.lit(" x")))
        )
        return prediction, hundredths(F.col("doc_id") * factor + F.col("line_no") * 17)

    @staticmethod
    def _sample_id() -> Column:
        sample = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("line_no").cast("string"))
        return F.sha2(F.concat_ws("\0", F.lit("documents"), F.lit("v1"), sample), 256)

    def _pairs(self, shift: int, factor: int) -> DataFrame:
        k = F.col("k")
        prediction, confidence = self._predicted(shift, factor)
        slices = F.array_compact(
            F.array(
                F.concat(F.lit("lang_"), "lang"),
                F.when(mod(k, 2) == 0, "publisher_hash_marker"),
                F.concat(F.lit("quality_"), F.col("quality").cast("string")),
                F.when(mod(F.col("doc_id"), 2) == 0, "src_even").otherwise("src_odd"),
            )
        )
        return self.lines.select(
            "doc_id", "line_no", "k",
            self._sample_id().alias("sample_id"), "source_sha256", "reference", prediction.alias("prediction"),
            confidence.alias("confidence"),
            (50 + mod(F.col("doc_id") * 13 + F.col("line_no") * 7, 400)).cast("double").alias("latency_ms"),
            ((1 + mod(k, 7)).cast("double") / 1000).alias("cost_per_page_usd"),
            slices.alias("slices"), F.col("source").alias("writer_id"),
            F.when(mod(F.col("doc_id"), 3) == 0, "test").otherwise("validation").alias("split"),
            (confidence < 0.7).alias("is_uncertain"), (confidence < 0.4).alias("is_unreadable"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return self._pairs(*self.MODEL)

    @cached_property
    def baseline(self) -> DataFrame:
        return self._pairs(*self.BASELINE)

    @cached_property
    def validation(self) -> DataFrame:
        return self.pairs.filter(F.col("split") == "validation")

    @cached_property
    def test(self) -> DataFrame:
        return self.pairs.filter(F.col("split") == "test")

    @cached_property
    def dirty(self) -> DataFrame:
        d = F.when(mod(F.col("k"), 50) == 0, mod(F.floor(F.col("k") / 50), 5))
        p = self.pairs.withColumn("d", d)
        d = F.col("d")
        return p.select(
            F.when(d == 0, F.lit(" "))
            .when(d == 3, F.sha2(F.concat(F.lit("duplicate"), "writer_id"), 256))
            .otherwise(F.col("sample_id")).alias("sample_id"),
            F.when(d == 1, "xyz").otherwise(F.col("source_sha256")).alias("source_sha256"),
            "reference", "prediction",
            F.when(d == 2, 1.5).otherwise(F.col("confidence")).alias("confidence"),
            "slices", F.when((d != 4) | d.isNull(), F.col("latency_ms")).alias("latency_ms"),
            "cost_per_page_usd", "k",
        )

    @cached_property
    def label_rows(self) -> DataFrame:
        return self.pairs.select(
            F.format_string("line-%d-%d.png", "doc_id", "line_no").alias("filename"),
            F.col("reference").alias("text"), "writer_id",
            F.array_join("slices", "|").alias("slices"), "k", "doc_id", "line_no", "source_sha256",
        )

    @cached_property
    def manifest(self) -> DataFrame:
        from folioscore.operators.manifest import DatasetIdentity, build_manifest

        rows = self.label_rows
        identity = DatasetIdentity("lines", "v1", "CC-BY-4.0", "https://example.org/license", "line")
        files = rows.select("filename", "source_sha256")
        return build_manifest(rows.drop("source_sha256"), files, identity)

    @cached_property
    def protected_labels(self) -> DataFrame:
        k = F.col("k")
        return self.pairs.select(
            F.when(mod(k, 11) == 0, F.format_string("scan_%d_%d.png", "doc_id", "line_no"))
            .otherwise(F.concat(F.lit("sample-"), F.substring("sample_id", 1, 24), F.lit(".png"))).alias("filename"),
            F.when(mod(k, 19) == 0, F.concat("reference", F.lit(" "))).otherwise(F.col("reference")).alias("text"),
            F.when(mod(k, 13) == 0, F.col("writer_id"))
            .otherwise(F.concat(F.lit("writer-"), F.substring(F.sha2("writer_id", 256), 1, 16))).alias("writer_id"),
            F.when(mod(k, 17) == 0, "essay|camera").otherwise("camera|essay").alias("slices"),
            choose(mod(k, 5), ["5-7", "8-10", "11-13", "14-17", "18+"]).alias("age_band"),
            choose(mod(k, 4), ["essay", "short_answer", "worksheet", "memo"]).alias("document_type"),
            choose(mod(k, 3), ["camera", "scan", "fax"]).alias("capture_type"),
            "sample_id",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        k, ref = F.col("k"), F.col("reference")
        who = lambda tag: F.concat(F.lit("annotator-"), F.substring(F.sha2(F.concat(F.lit(tag), "writer_id"), 256), 1, 12))
        mark = lambda tag: F.sha2(F.concat(ref, F.lit(tag)), 256)
        split = mod(k, 4) == 0
        return self.pairs.select(
            F.concat(
                F.when(mod(k, 29) == 0, "orphan-").otherwise(""),
                F.format_string("line-%d-%d.png", "doc_id", "line_no"),
            ).alias("filename"),
            who("a").alias("annotator_1_id"),
            F.when(mod(k, 31) == 0, who("a")).otherwise(who("b")).alias("annotator_2_id"),
            F.sha2(ref, 256).alias("pass_1_sha256"),
            F.when(split, mark("?")).otherwise(mark("")).alias("pass_2_sha256"),
            F.when(mod(k, 23) == 0, mark("!")).otherwise(mark("")).alias("final_sha256"),
            F.when(split, "adjudicated").otherwise("agreed").alias("status"),
            F.when(split, who("c")).otherwise(F.lit("")).alias("adjudicator_id"),
            F.when(split, F.when(mod(k, 37) == 0, "taste").otherwise("transcription_disagreement"))
            .otherwise("").alias("adjudication_reason"),
            F.when(mod(k, 41) == 0, "false").otherwise("true").alias("crop_reviewed"),
            (20 + mod(k, 30)).cast("double").alias("pass_1_seconds"),
            (25 + mod(k, 20)).cast("double").alias("pass_2_seconds"),
            F.when(split, 10 + mod(k, 15)).otherwise(0).cast("double").alias("adjudication_seconds"),
            "writer_id",
        )

    @cached_property
    def corpus_lines(self) -> DataFrame:
        t = one_line(F.col("text"))
        doc = F.col("doc_id")
        marked = F.concat(F.substring("t", 1, 3), F.lit("#"), F.substring("t", 4, 1 << 30))
        return self.spread(self.table("documents")).select("doc_id", t.alias("t")).select(
            F.concat(
                F.format_string("%04d-%03d", F.floor(doc / 25), mod(doc, 25)), F.lit(","),
                mod(doc * 7, 300).cast("string"), F.lit(" "),
                F.when(mod(doc, 3) == 0, marked).otherwise(F.col("t")),
            ).alias("value")
        )

    @cached_property
    def corpus(self) -> DataFrame:
        from folioscore.sources.scans import corpus_index

        # Writers count on beyond four digits, so that every document has an id.
        return corpus_index(self.corpus_lines, vocab.CORPUS_INDEX_LINE.replace("{4}", "{4,}"))

    @cached_property
    def blocks(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        # Multiples of 1/128 add up exactly in any order, so means round alike everywhere.
        confidence = mod(conv * 31 + turn * 17, 129).cast("double") / 128
        kind = F.when(F.col("role") == "user", "student_handwriting").when(
            F.col("role") == "assistant", "printed_text"
        ).otherwise("margin_insertion")
        box = F.array(F.lit(10).cast("long"), 40 * turn, 10 + 8 * F.length("t"), 40 * turn + 30)
        return self.table("conversations").withColumn("t", one_line(F.col("text"))).select(
            conv.alias("page_id"), turn.alias("reading_order"), turn.alias("block_no"), kind.alias("type"),
            F.col("t").alias("text"), confidence.alias("confidence"),
            (mod(conv + turn, 7) == 0).alias("crossed_out"), box.cast("array<int>").alias("bbox"),
            (confidence < 0.7).alias("is_uncertain"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        level = F.floor(127.5 + 400 * F.col("value").cast("double"))
        return self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
            F.col("vec_id").alias("page_id"), F.floor(F.col("pos") / 8).alias("y"), mod(F.col("pos"), 8).cast("long").alias("x"),
            F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int").alias("v"),
        )

    @cached_property
    def pixel_rows(self) -> DataFrame:
        """The same images with an array per row."""
        level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(127.5 + 400 * v.cast("double")))).cast("int")
        rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("embedding", y * 8 + 1, 8))
        return self.table("embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode(rows).alias("y", "r")).select(
            "page_id", F.col("y").cast("long").alias("y"), F.transform("r", level).alias("levels")
        )

    @cached_property
    def measurements(self) -> DataFrame:
        """Measurements made from the length and the number of tags of each page's whole HTML."""
        length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
        h, tags = F.col("h"), F.col("tags")
        counted = self.table("pages").select(
            "page_id", length(F.col("html")).alias("h"), (length(F.col("html")) - length(F.replace("html", F.lit("<"), F.lit("")))).alias("tags")
        )
        return counted.select(
            "page_id", mod(h * 53, 400).cast("double").alias("blur"),
            (400 + mod(h * 37, 900)).alias("width"), (500 + mod(tags * 29, 900)).alias("height"),
            (mod(tags * 7, 41) - 20).cast("double").alias("skew"), mod(h * 29 + tags, 256).cast("double").alias("brightness"),
            (mod(tags, 11) == 0).alias("has_glare"), (mod(h, 13) == 0).alias("has_shadow"), (mod(h + tags, 17) == 0).alias("is_blank"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """All events as ledger entries: four in a row of a user are one withdrawal."""
        hour = F.date_trunc("HOUR", "ts")
        events = self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
        n = position_within(events, ["user_id"], [F.col("ts"), F.col("event_id")], hour, name="n")
        cycle = F.floor((F.col("n") - 1) / 4)
        user = F.col("user_id")
        rows = n.withColumns(
            {
                "cycle": cycle,
                "subject_token_sha256": F.sha2(F.concat_ws(":", F.lit("subject"), user.cast("string"), cycle.cast("string")), 256),
                "pilot_id": F.format_string("pilot-cohort-%04d", mod(user, 8)),
            }
        )
        rows = position_within(rows, ["pilot_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("MINUTE", "ts"), name="sequence")
        at = mod(F.col("n") - 1, 4)
        request, primary, backup, close = vocab.EVENT_TYPES
        group = F.col("user_id") + F.col("cycle")
        kind = (
            F.when(mod(group, 10) == 0, choose(at, [request, primary, backup, primary]))
            .when(mod(group, 15) == 1, choose(at, [request, close, primary, backup]))
            .otherwise(choose(at, [request, primary, backup, close]))
        )
        seq, subject = F.col("sequence"), F.col("subject_token_sha256")
        minute = F.expr("INTERVAL 1 MINUTE")
        rows = rows.select(
            "pilot_id", "sequence", F.concat(F.lit("evt-"), F.md5(F.col("event_id").cast("string"))).alias("event_id"),
            "subject_token_sha256", kind.alias("event_type"), F.col("ts").alias("occurred_at"),
            F.when(mod(seq, 89) == 0, F.col("ts") - minute).otherwise(F.col("ts") + minute).alias("recorded_at"),
            F.sha2(F.concat(F.lit("scope:"), subject, F.when(mod(seq, 53) == 0, "?").otherwise("")), 256).alias("scope_sha256"),
        )
        own = F.concat_ws("|", "event_id", "event_type", "subject_token_sha256", F.unix_micros("occurred_at").cast("string"))
        rows = rows.withColumn("event_sha256", F.sha2(own, 256))
        chained = _with_previous(rows, "event_sha256")
        previous = F.when(mod(seq, 97) == 0, F.lit("f" * 64)).otherwise(
            F.coalesce("prev_event_sha256", F.lit(vocab.ZERO_SHA256))
        )
        return chained.withColumn("previous_event_sha256", previous).drop("prev_event_sha256")

    @cached_property
    def requests(self) -> DataFrame:
        return as_requests(self.table("events"))

    @cached_property
    def al_items(self) -> DataFrame:
        return as_items(self.pairs)

    @cached_property
    def frequencies(self) -> DataFrame:
        from folioscore.operators.review import failure_frequencies

        return failure_frequencies(self.al_items)

    @cached_property
    def old_frequencies(self) -> DataFrame:
        from folioscore.operators.review import failure_frequencies

        return failure_frequencies(self.table("part").select(F.col("p_brand").alias("failure_category")))

    @cached_property
    def instances(self) -> DataFrame:
        from folioscore.functions.edits import row_cer, with_char_features

        # Both versions of a line come from one row and stand together.
        versions = [
            F.struct(prediction.alias("prediction"), confidence.alias("confidence"), F.lit(version).alias("model_version"))
            for version, (prediction, confidence) in (("v1", self._predicted(*self.MODEL)), ("v2", self._predicted(*self.BASELINE)))
        ]
        both = self.lines.select(
            "doc_id", "line_no", "k", self._sample_id().alias("sample_id"), "reference", F.inline(F.array(*versions))
        )
        k = mod(F.col("k"), 6)
        cer = F.when(k == 5, 0.0).otherwise(row_cer(F.col("char_edits"), F.col("ref_chars")))
        return with_char_features(both).select(
            F.col("sample_id").alias("instance_id"),
            choose(k, ["faint_pencil", "joined_cursive", "touching_lines", "crossed_out", "heavy_blur", "unknown"]).alias("category"),
            F.format_string("images/%d-%d.png", "doc_id", "line_no").alias("image_path"),
            F.col("prediction").alias("predicted_text"), F.col("reference").alias("reference_text"),
            "confidence", cer.alias("cer"), "model_version", F.lit(None).cast("string").alias("notes"),
        )

    @cached_property
    def registry(self) -> DataFrame:
        part = self.table("part")
        metric = mod(F.col("p_partkey") * 7, 100).cast("double") / 1000
        return part.select(
            F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("version"),
            F.col("p_type").alias("model_type"), F.create_map(F.lit("cer"), metric).alias("metrics"),
            mod(F.col("p_partkey") * 7919, 100003).alias("promoted_seq"),
        )


def as_requests(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"),
        F.when(k >= 90, 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"), "user_id",
        F.when(mod(F.col("event_id"), 3) == 0, "POST").otherwise("GET").alias("method"),
    )


def as_items(pairs: DataFrame) -> DataFrame:
    k = F.col("k")
    return pairs.select(
        F.col("sample_id").alias("item_id"), "confidence",
        choose(mod(k, 6), ["faint_pencil", "joined_cursive", "touching_lines", "crossed_out", "heavy_blur"]).alias("failure_category"),
        mod(k * 11, 120).cast("double").alias("correction_impact"),
        (5 + mod(k * 3, 40)).cast("double").alias("label_seconds"), "k",
    )
