"""Divergence of sources inside each language, by three-dimensional cube partitioning.

Terms are runs of letters, where every character beyond ASCII counts as a letter. A language keeps
the terms that enough of its documents hold. Every group (a source in a language) gives each kept
term a share in billionths, with one added to its count, and the divergence of a group from another
adds up floor((p - q)**2 / q) over all kept terms.

Counts are small next to the text: map tasks count whole texts in bounded dictionaries. Groups are
dealt into blocks of about `group_block`, kept terms into blocks of about `term_block`. A slice
holds the counts of one group block in one term block, and goes to every cell (group block, group
block, term block) it takes part in. A cell owns two slices, computes the partial divergences
between all their groups, both ways, and the parts are added along the term axis. So no task holds
more than two slices, whatever the number of sources or terms, and a source with a third of all
rows weighs no more than another.

Defined results: null text, language and source are empty strings; a language without kept terms
gives pairs of value 0 and no terms; rows that repeat are documents of their own; an empty table
gives an empty result; extra columns are ignored, whatever their names. All arithmetic is exact.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.llm.common import cut

BILLION = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
GROUP_BLOCK = 32
TERM_BLOCK = 4096
PARTS = 256
# A map task hands its counts on when it holds this many: a bound on memory, not on results.
HELD = 400_000
STRETCH = 1_000_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _letters() -> bytes:
    """Maps each byte of UTF-8 to itself in lower case, or to a space where no term goes on."""
    keep = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in keep else 32 for b in range(256))


def _stretches(data: bytes):
    """Parts of at most about STRETCH bytes, cut between terms."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _counted(held: int):
    def run(batches):
        table = _letters()
        groups: dict = {}

        def flush():
            for (lang, source), (counts, documents, rows) in groups.items():
                terms = list(counts)
                for at in range(0, len(terms), 65_536):
                    part = terms[at:at + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                            pa.array(part, pa.binary()).cast(pa.string()),
                            pa.array([counts[t] for t in part], pa.int64()), pa.array([documents[t] for t in part], pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "docs"],
                    )
                # The group itself, so that one without terms is known as well.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([source]), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                group = groups.setdefault((lang, source), [Counter(), Counter(), 0])
                counts, documents = group[0], group[1]
                before = len(counts)
                if len(text) <= STRETCH:
                    terms = text.translate(table).split()
                    counts.update(terms)
                    seen = set(terms)
                else:
                    seen = set()
                    for part in _stretches(text.translate(table)):
                        terms = part.split()
                        counts.update(terms)
                        seen.update(terms)
                documents.update(seen)
                group[2] += 1
                size += len(counts) - before
                if size >= held:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def term_counts(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents); a null term stands for the group."""
    column = lambda name: F.coalesce(docs[name].cast("string"), F.lit(""))
    rows = docs.select(column(lang_column).alias("lang"), column(source_column).alias("source"), column(text_column).cast("binary").alias("text"))
    partial = rows.mapInArrow(_counted(held), COUNTS)
    return cut(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, term, lang_n, block and number of the term, terms in its block, kept terms of the language."""
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = terms.filter(F.col("docs") >= min_documents).drop("docs")
    # A language's number of terms goes to its terms by (language, part), so that no task gets a language.
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    block = W.partitionBy("lang", "term_block")
    parted = terms.withColumn("part", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(PARTS)).cast("int"))
    dealt = parted.join(kept, ["lang", "part"]).drop("part").withColumn(
        "term_block", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / term_block)).cast("int")
    )
    return cut(dealt.withColumns({
        "term_no": (F.row_number().over(block.orderBy("term")) - 1).cast("int"), "terms": F.count("*").over(block).cast("int"),
    }))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / total), exact for counts of any size."""
    return F.expr("1").cast("long") + F.call_function("div", (n + F.lit(1)).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same over arrays. Three digits of base 1000 at a time keep the products in 64 bits."""
    if len(total) and int(total.max()) >= 9 * 10**15:
        exact = (n.astype(object) + 1) * BILLION // total.astype(object)[:, None] + 1
        return exact.astype(np.int64)
    rest = n + 1
    total = np.maximum(total, 1)[:, None]
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out = out * 1000 + digit
        rest -= digit * total
    return out + 1


def _packed(values, kind) -> bytes:
    return zlib.compress(np.asarray(values, kind).tobytes(), 1)


def _slice(rows: pd.DataFrame) -> pd.DataFrame:
    """One slice: its groups with their totals, and its counts as three arrays."""
    counts = rows["term_no"].to_numpy() >= 0
    groups = rows[~counts].sort_values("group_no")
    cells = rows[counts]
    return pd.DataFrame({
        "lang": rows["lang"].iloc[:1], "group_block": rows["group_block"].iloc[:1], "term_block": rows["term_block"].iloc[:1],
        "blocks": rows["blocks"].iloc[:1], "terms": rows["terms"].iloc[:1],
        "sources": [groups["source"].tolist()], "totals": [groups["n"].tolist()],
        "group_no": [_packed(cells["group_no"], np.int32)], "term_no": [_packed(cells["term_no"], np.int32)], "n": [_packed(cells["n"], np.int64)],
    })


SLICES = (
    "lang string, group_block int, term_block int, blocks int, terms int, sources array<string>, totals array<long>, "
    "group_no binary, term_no binary, n binary"
)


def _matrix(row) -> tuple[list[str], np.ndarray]:
    """Shares of every term of the block in every group of the slice."""
    n = np.zeros((len(row.sources), row.terms), np.int64)
    array = lambda raw, kind: np.frombuffer(zlib.decompress(raw), kind)
    n[array(row.group_no, np.int32), array(row.term_no, np.int32)] = array(row.n, np.int64)
    return list(row.sources), shares(n, np.asarray(row.totals, np.int64))


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of one cell: from each group of a slice to each of the other, both ways."""
    same = rows["low"].iloc[0] == rows["high"].iloc[0]
    if not same and len(rows) == 1:
        # No group was dealt into the other block.
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []}).astype({"lang": str, "source": str, "item": str, "value": "int64"})
    sides = [_matrix(r) for r in rows.sort_values("group_block").itertuples()]
    names: list[tuple[str, str]] = []
    values: list[np.ndarray] = []
    left_names, left = sides[0]
    right_names, right = sides[-1]
    for i, source in enumerate(left_names):
        gap = left[i] - right
        gap *= gap
        names.extend((source, other) for other in right_names)
        values.append((gap // right).sum(axis=1))
        if not same:
            names.extend((other, source) for other in right_names)
            values.append((gap // left[i]).sum(axis=1))
    flat = np.concatenate(values)
    out = pd.DataFrame({"source": [a for a, _ in names], "item": [b for _, b in names], "value": flat})
    out.insert(0, "lang", rows["lang"].iloc[0])
    return out[out["source"] != out["item"]]


def divergences(
    counts: DataFrame, terms: DataFrame, *, group_block: int = GROUP_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(pairs: lang, source, item, value; terms of groups: lang, source, item, value) from counts
    as `term_counts` has them and terms as `kept_terms` has them."""
    held = counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "kept", "term_block", "term_no", "terms")
    groups = counts.filter("term is null").select("lang", "source")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    per_lang = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_held"), F.count("*").alias("kept"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / group_block).cast("int").alias("blocks"))
    langs = sizes.join(per_lang, "lang", "left").na.fill(0, ["lang_held", "kept"])
    number = W.partitionBy("lang", "group_block").orderBy("source")
    known = cut(
        groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select(
            "lang", "source", "blocks", (F.coalesce("held", F.lit(0)) + F.col("kept")).alias("total"),
            (F.col("lang_held") + F.col("kept")).alias("lang_total"),
            F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("group_block"),
        ).withColumn("group_no", (F.row_number().over(number) - 1).cast("int"))
    )
    cells = cut(held.join(known, ["lang", "source"]))
    # Every slice lists all its groups, also those without a count in it.
    blocks = terms.select("lang", "term_block", "terms").distinct()
    listed = known.join(blocks, "lang", "left").select(
        "lang", "group_block", F.coalesce("term_block", F.lit(0)).alias("term_block"), "blocks", F.coalesce("terms", F.lit(0)).alias("terms"),
        "source", "group_no", F.lit(-1).alias("term_no"), F.col("total").alias("n"),
    )
    counted = cells.select("lang", "group_block", "term_block", "blocks", "terms", F.lit("").alias("source"), "group_no", "term_no", "n")
    slices = cut(listed.unionByName(counted).groupBy("lang", "group_block", "term_block").applyInPandas(_slice, SLICES))
    partner = slices.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = partner.withColumns({"low": F.least("group_block", "partner"), "high": F.greatest("group_block", "partner")})
    partial = dealt.groupBy("lang", "low", "high", "term_block").applyInPandas(_cell, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    above = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    return pairs, above.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def divergence_audit(
    docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
    min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
    held: int = HELD,
) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence
    (`pair`), and the terms that set a group most apart from its language (`term`)."""
    counts = term_counts(docs, text_column=text_column, lang_column=lang_column, source_column=source_column, held=held)
    terms = kept_terms(counts, min_documents, term_block)
    pairs, apart = divergences(counts, terms, group_block=group_block)
    best = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = apart.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(best)}).select(*columns).unionByName(
        ranked.withColumn("part", F.lit("term")).select(*columns)
    )


TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}),
v AS (SELECT lang, count(*) + sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON k.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT f.*, (1 + {BILLION}::HUGEINT * (f.n + 1) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + count(*) OVER (PARTITION BY f.lang, f.source)))::BIGINT AS p,
         (1 + {BILLION}::HUGEINT * (f.lang_n + 1) // v.total)::BIGINT AS q
  FROM f JOIN v ON v.lang = f.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms)
WHERE rank <= {TOP_TERMS}
"""
