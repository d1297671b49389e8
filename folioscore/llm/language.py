"""Language identification by interpolated Kneser-Ney character models.

Counts of 4-grams of letters come from all learned texts, added up in map tasks before the
shuffle. From them follow one model for each language: the highest order discounts counts, lower
orders discount continuation counts (how many letters an n-gram was seen after), and every order
is interpolated with the next lower one. The models of all languages lie side by side in sorted
arrays of n-gram hashes: one search gives a row with the log probability in each language.

A text's score is its cross-entropy per letter in each language; the lowest wins. `score` is the
softmax of the entropies, and `rejected` marks texts whose entropy is above what held-in texts of
that language show (mean plus `spread` standard deviations over all distinct learned texts).

Letters are lower-cased code points; runs of anything else are word breaks. Every n-gram of every
language is kept. Models of at most `max_cells` numbers an order are broadcast. Larger ones stay
a distributed table: discounts, continuation counts and back-off are Spark aggregates, blocks of
distinct texts ask for the n-grams that occur in them, and a join brings each block the rows of its
own, from which it makes its sorted arrays. Both ways give the same probabilities.

Defined results: a text that is null or has no letter is `und` with score 0 and not rejected; so
is every text if there is nothing to learn from. Texts of any length are read whole. Repeated rows
get the same result. An empty table gives an empty result. Other columns pass through, and columns
named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscore.llm.common import cut, first_of_each, mixed, own_name

ORDER = 4
MAX_CELLS = 2_000_000
SHARPNESS = 12.0
SPREAD = 4.0
BLOCK_BYTES = 32_000_000
SPACE, OTHER = 32, 0xFFFF  # a letter beyond the basic plane counts as OTHER
U16 = np.uint64(16)


def _letters() -> np.ndarray:
    """Lower-case letter, or SPACE, for each code point of the basic plane; once per worker."""
    import unicodedata

    table = unicodedata.__dict__.get("_letter_table")
    if table is None:
        table = np.full(1 << 16, SPACE, np.uint16)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < OTHER else c
        table[OTHER] = OTHER
        unicodedata.__dict__["_letter_table"] = table
    return table


def symbols_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, end): texts one after another, with two spaces before and after each.

    Runs of other characters become at most two spaces; neighbouring texts share theirs.
    """
    lengths = np.array([len(t or "") for t in texts], np.int64)
    joined = "   " + "   ".join(t or "" for t in texts) + "   "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = points > 0xFFFE
    symbols = _letters()[np.where(far, 0, points)]
    for i in np.flatnonzero(far):
        symbols[i] = OTHER if chr(points[i]).isalpha() else SPACE
    blank = symbols == SPACE
    keep = ~blank
    keep[:2] = True
    keep[2:] |= ~(blank[1:-1] & blank[:-2])
    place = np.concatenate(([0], np.cumsum(keep)))
    begin = 3 + np.concatenate(([0], np.cumsum(lengths + 3)[:-1]))
    kept = symbols[keep]
    first = place[begin] - 2
    return kept, first, np.append(first[1:], len(kept) - 2) + 2


def grams_of(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed n-gram that starts at each position: 16 bits for each symbol, the last lowest."""
    wide = symbols.astype(np.uint64)
    n = len(wide) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(order):
        key = (key << U16) | wide[i:i + n]
    return key


def spans_of(first: np.ndarray, end: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past the last) n-gram of each text; equal where a text has none."""
    return first, np.maximum(end - order + 1, first)


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows; every task adds up its own texts first."""

    def run(batches):
        held: dict[str, list] = {}

        def flush(lang: str):
            keys, n = _summed(held.pop(lang))
            for at in range(0, len(keys), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(n[part])], ["lang", "gram", "n"]
                )

        for batch in batches:
            languages = np.array(batch.column(0).to_pylist(), object)
            texts = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(languages)):
                mine = texts[languages == lang].tolist()
                for at, upto in _slices(mine):
                    symbols, first, end = symbols_of(mine[at:upto])
                    grams = grams_of(symbols)
                    a, b = spans_of(first, end)
                    inside = np.zeros(len(grams) + 1, np.int32)
                    np.add.at(inside, np.minimum(a, len(grams)), 1)
                    np.add.at(inside, np.minimum(b, len(grams)), -1)
                    grams = grams[np.cumsum(inside[:-1]) > 0]
                    keys, n = np.unique(grams, return_counts=True)
                    held.setdefault(lang, []).append((keys, n.astype(np.int64)))
                if len(held.get(lang, [])) > 40:
                    held[lang] = [_summed(held[lang])]
        for lang in sorted(held):
            yield from flush(lang)

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _slices(texts: list):
    from folioscore.llm.pretokens import slices

    return slices(texts, 2_000_000)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


class SortedHashes:
    """Rows by n-gram: sorted hashes, found by way of a directory of their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mixed(keys)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = values[order] if len(keys) else np.zeros((1, *values.shape[1:]), values.dtype)
        self.bits = max(1, int(len(keys)).bit_length())
        heads = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.starts = np.concatenate((np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32), [len(keys)] * 2)).astype(np.int32)
        # One entry that no query meets inside its bucket ends the array.
        self.hashes = np.append(self.hashes, np.uint64(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        hashes = mixed(keys)
        head = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.starts[head], self.starts[head + 1]
        found = np.where((self.hashes[at] == hashes) & (at < stop), at, -1)
        left = np.flatnonzero((found < 0) & (at + 1 < stop))
        step = 1
        while len(left):
            here = at[left] + step
            hit = self.hashes[here] == hashes[left]
            found[left[hit]] = here[hit]
            left = left[~hit & (here + 1 < stop[left])]
            step += 1
        return found


def _side_by_side(tables: list[tuple[np.ndarray, np.ndarray]], other: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of all tables: a column for each, `other` where it has no such key."""
    keys = np.unique(np.concatenate([k for k, _ in tables])) if tables else np.empty(0, np.uint64)
    out = np.full((len(keys), len(tables)), other)
    for j, (own, values) in enumerate(tables):
        out[np.searchsorted(keys, own), j] = values
    return keys, out


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


class Models:
    """Kneser-Ney models of several languages over shared n-gram rows."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        languages = sorted(counts)
        tables = [self._of_language(*counts[lang], order) for lang in languages]
        seen = np.concatenate([t[0]["keys"] for t in tables]) if tables else np.empty(0, np.uint64)
        orders = []
        for n in range(order):
            keys, direct = _side_by_side([(t[n]["keys"], t[n]["direct"]) for t in tables], 0.0)
            contexts, gamma = _side_by_side([(t[n]["contexts"], t[n]["gamma"]) for t in tables], 1.0)
            orders.append((keys, direct, contexts, gamma))
        self._fill(languages, len(np.unique(seen)), orders)

    @classmethod
    def of_rows(cls, languages: list[str], vocabulary: int, rows: pd.DataFrame, order: int = ORDER) -> Models:
        """From rows (slot, key, lang, value) of a stored table: all that the texts to be scored ask for."""
        slot, key = rows["slot"].to_numpy(), rows["key"].to_numpy(np.int64).view(np.uint64)
        lang, value = rows["lang"].to_numpy(), rows["value"].to_numpy()

        def table(wanted: int, other: float):
            mine = slot == wanted
            return _side_by_side([(key[mine & (lang == j)], value[mine & (lang == j)]) for j in range(len(languages))], other)

        models = cls.__new__(cls)
        models._fill(languages, vocabulary, [(*table(2 * n, 0.0), *table(2 * n + 1, 1.0)) for n in range(1, order + 1)])
        return models

    def _fill(self, languages: list[str], vocabulary: int, orders: list[tuple]) -> None:
        """Log probabilities from (n-grams, discounted parts, contexts, backoff weights) of each order."""
        self.languages, self.order = languages, len(orders)
        self.sharpness, self.limits = SHARPNESS, None
        self.unseen = np.full(len(languages), -np.log(max(1, vocabulary) + 1.0), np.float32)
        self.rows: list[SortedHashes] = []
        self.backoffs: list[SortedHashes] = []
        for n, (keys, direct, contexts, gamma) in enumerate(orders, 1):
            prefix = np.searchsorted(contexts, keys >> U16)
            logs = np.log(direct + gamma[prefix] * np.exp(self._lower(keys, n))) if len(keys) else direct
            self.rows.append(SortedHashes(keys, logs.astype(np.float32)))
            self.backoffs.append(SortedHashes(contexts, np.log(gamma).astype(np.float32)))

    @staticmethod
    def _of_language(keys: np.ndarray, counts: np.ndarray, order: int) -> list[dict]:
        """For each order: n-grams, discounted direct parts, contexts and their backoff weights."""
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        out = []
        for n in range(order, 0, -1):
            contexts, back = np.unique(keys >> U16, return_inverse=True)
            total = np.bincount(back, weights=counts, minlength=len(contexts))
            kinds = np.bincount(back, minlength=len(contexts))
            d = _discount(counts)
            out.append({
                "keys": keys, "counts": counts, "direct": np.maximum(counts - d, 0) / total[back] if len(keys) else np.empty(0),
                "contexts": contexts, "gamma": d * kinds / np.maximum(total, 1e-300),
            })
            # Continuation counts: how many different symbols stood before the shorter n-gram.
            keys, counts = np.unique(keys & np.uint64((1 << (16 * (n - 1))) - 1), return_counts=True)
        return out[::-1]

    def _lower(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the last symbol from one order below `n`."""
        if n == 1:
            return np.broadcast_to(self.unseen, (len(keys), len(self.unseen)))
        return self.logs(keys & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)

    def logs(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log probability of each n-gram's last symbol after the others, in every language."""
        table = self.rows[n - 1]
        at = table.find(keys)
        out = table.values[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = keys[missing]
            contexts = self.backoffs[n - 1]
            where = contexts.find(lost >> U16)
            gamma = np.where((where >= 0)[:, None], contexts.values[where], np.float32(0))
            out[missing] = gamma + self._lower(lost, n)
        return out

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol in each language, number of symbols) of each text."""
        wide = len(self.languages)
        out, sizes = np.zeros((len(texts), wide)), np.zeros(len(texts), np.int64)
        for a, b in _slices(texts):
            symbols, first, end = symbols_of(texts[a:b])
            grams = grams_of(symbols, self.order)
            lo, hi = spans_of(first, end, self.order)
            sums = np.zeros((b - a, wide))
            # A very long text is added up piece by piece.
            for at in range(0, len(grams), 1_000_000):
                upto = min(at + 1_000_000, len(grams))
                logs = self.logs(grams[at:upto], self.order)
                i, j = np.clip(lo, at, upto) - at, np.clip(hi, at, upto) - at
                some = np.flatnonzero(j > i)
                if len(some):
                    bounds = np.stack([i[some], j[some]], 1).ravel()
                    padded = np.concatenate([logs, np.zeros((1, wide), logs.dtype)]) if bounds[-1] == len(logs) else logs
                    sums[some] += np.add.reduceat(padded, bounds, axis=0, dtype=np.float64)[::2]
            # Two breaks around at least one letter make two n-grams.
            letters = np.add.reduceat(np.append(symbols != SPACE, False), np.stack([first, end], 1).ravel(), dtype=np.int64)[::2] if len(first) else []
            n = np.where(np.array(letters) > 0, hi - lo, 0)
            sizes[a:b] = n
            out[a:b] = -sums / np.maximum(n, 1)[:, None]
        return out, sizes

    def predict(self, texts: list) -> pd.DataFrame:
        if not self.languages:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "entropy": np.nan, "rejected": False})
        entropy, sizes = self.entropies(texts)
        best = entropy.argmin(1)
        lowest = entropy.min(1)
        share = 1 / np.exp(-self.sharpness * (entropy - lowest[:, None])).sum(1)
        named = np.array([*self.languages, "und"], object)
        blank = sizes == 0
        over = np.zeros(len(texts), bool) if self.limits is None else lowest > self.limits[best]
        return pd.DataFrame({
            "lang": named[np.where(blank, len(self.languages), best)], "score": np.where(blank, 0.0, share),
            "entropy": np.where(blank, np.nan, lowest), "rejected": over & ~blank,
        })


class StoredModels:
    """Models of any size: a table (slot, key, lang, value) of which a text needs its own rows only.

    Slot 2n holds the discounted parts of n-grams, slot 2n + 1 the backoff weights of their contexts;
    `lang` is the place in `languages`.
    """

    def __init__(self, languages: list[str], counts: DataFrame, order: int = ORDER):
        self.languages, self.order, self.limits = languages, order, None
        levels = None
        for n in range(order, 0, -1):
            level = counts.select("lang", F.lit(n).alias("n_order"), "gram", F.shiftrightunsigned("gram", 16).alias("context"), "n")
            levels = level if levels is None else levels.unionByName(level)
            # Continuation counts: how many different symbols stood before the shorter n-gram.
            shorter = F.col("gram").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))
            counts = counts.select("lang", shorter.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        levels = cut(levels)
        one, two = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = levels.groupBy("lang", "n_order").agg(F.when((one > 0) & (two > 0), one / (one + 2 * two)).otherwise(0.5).alias("d"))
        # A context is followed by no more symbols than there are.
        contexts = levels.groupBy("lang", "n_order", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discounts, ["lang", "n_order"])
        direct = levels.join(contexts, ["lang", "n_order", "context"]).select(
            (F.col("n_order") * 2).alias("slot"), F.col("gram").alias("key"), "lang", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value"),
        )
        gamma = contexts.select((F.col("n_order") * 2 + 1).alias("slot"), F.col("context").alias("key"), "lang", (F.col("d") * F.col("kinds") / F.col("total")).alias("value"))
        place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
        self.table = cut(direct.unionByName(gamma).withColumn("lang", place.cast("int")))
        self.vocabulary = self.table.filter("slot = 2").select("key").distinct().count()


def _wanted(order: int):
    """The n-grams and contexts of all orders that occur in a block of texts, each once."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        texts, found = block["text"].tolist(), np.empty(0, np.uint64)
        for at, upto in _slices(texts):
            found = np.unique(np.concatenate([found, grams_of(symbols_of(texts[at:upto])[0], order)]))
        slots, keys = [], []
        for n in range(order, 0, -1):
            for slot, part in ((2 * n, found), (2 * n + 1, np.unique(found >> U16))):
                slots.append(np.full(len(part), slot, np.int32))
                keys.append(part.view(np.int64))
            found = np.unique(found & np.uint64((1 << (16 * (n - 1))) - 1))
        return pd.DataFrame({"block": block["block"].iloc[0], "slot": np.concatenate(slots), "key": np.concatenate(keys)})

    return run


def _scored(languages: list[str], vocabulary: int, limits: np.ndarray | None, order: int):
    def run(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        # Tasks before the shuffle may each have kept a copy.
        block = block.drop_duplicates("text_key")
        models = Models.of_rows(languages, vocabulary, rows, order)
        models.limits = limits
        return models.predict(block["text"].tolist()).assign(text_key=block["text_key"].to_numpy())

    return run


def _predicted(docs: DataFrame, models: StoredModels, text_column: str, block_bytes: int) -> DataFrame:
    """(text_key, lang, score, entropy, rejected) of each distinct text."""
    texts = docs.select(F.md5(text_column).alias("text_key"), F.col(text_column).alias("text")).filter("text IS NOT NULL")
    blocks = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // block_bytes)
    once = texts.mapInArrow(first_of_each, "text_key string, text string")
    placed = once.withColumn("block", F.pmod(F.xxhash64("text_key"), F.lit(blocks))).groupBy("block")
    wanted = placed.applyInPandas(_wanted(models.order), "block long, slot int, key long")
    rows = wanted.join(models.table, ["slot", "key"])
    score = _scored(models.languages, models.vocabulary, models.limits, models.order)
    return rows.groupBy("block").cogroup(placed).applyInPandas(score, "lang string, score double, entropy double, rejected boolean, text_key string")


def fit(
    docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", max_cells: int = MAX_CELLS,
    spread: float = SPREAD,
) -> Models | StoredModels:
    """Models of every language in `docs`, from all rows with a language and a text.

    Names of languages reach the driver, and the counts if they make `max_cells` numbers at most.
    """
    counts = cut(gram_counts(docs, text_column, lang_column))
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if counts.count() * len(languages) > max_cells:
        models = StoredModels(languages, counts)
    else:
        table = counts.toArrow()
        names = table.column("lang").combine_chunks().dictionary_encode()
        grams = table.column("gram").to_numpy().view(np.uint64)
        n, number = table.column("n").to_numpy(), names.indices.to_numpy(zero_copy_only=False)
        models = Models({lang: (grams[number == i], n[number == i]) for i, lang in enumerate(names.dictionary.to_pylist())})
    if models.languages:
        known = docs.filter(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
        texts = known.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
        # Copies count once; they are told by their hashes after scoring, so no text is shuffled for it.
        found = identified(texts, models, prefix="own_").filter("own_pred = lang").select("lang", F.md5("text").alias("key"), "own_entropy")
        found = found.dropDuplicates(["lang", "key"])
        by = {r.lang: r.m + spread * (r.s or 0.0) for r in found.groupBy("lang").agg(F.avg("own_entropy").alias("m"), F.stddev("own_entropy").alias("s")).collect()}
        models.limits = np.array([by.get(lang, np.inf) for lang in models.languages])
    return models


def identified(
    docs: DataFrame, models: Models | StoredModels, *, text_column: str = "text", prefix: str = "lang_", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with <prefix>pred, <prefix>score, <prefix>entropy and <prefix>rejected."""
    held = own_name("lang")
    if isinstance(models, StoredModels):
        key = own_name("key")
        found = _predicted(docs, models, text_column, block_bytes).select(F.col("text_key").alias(key), F.struct("lang", "score", "entropy", "rejected").alias(held))
        blank = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected"))
        done = docs.withColumn(key, F.md5(text_column)).join(found, key, "left").withColumn(held, F.coalesce(held, blank))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(models)  # at most `max_cells` numbers an order

        @F.pandas_udf("lang string, score double, entropy double, rejected boolean")
        def predict(texts: pd.Series) -> pd.DataFrame:
            return shared.value.predict(texts.tolist())

        done = docs.withColumn(held, predict(F.col(text_column)))
    new = {f"{prefix}{name}": F.col(f"{held}.{field}") for name, field in (("pred", "lang"), ("score", "score"), ("entropy", "entropy"), ("rejected", "rejected"))}
    return done.select(*[c for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])
