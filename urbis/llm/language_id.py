"""Language identification with interpolated Kneser-Ney character models.

Each language has a character model of order 4 over lower-cased text in which every run of non-letters
is one space. Counts come from all training rows: partitions emit their distinct 4-grams, one shuffle
sums them, and further aggregates give the continuation counts. Models are stored in hash arrays: entries
sorted by the hash of their n-gram, found through the array of bucket starts. A text gets the language of
the lowest cross-entropy per character. It is also marked rejected if that cross-entropy is above the
language's calibrated limit.

The counts stay a written table. They are cut into shards of about SHARD_GRAMS entries by the two middle
characters of the 4-gram: all counts that orders 3 and 4 need for a 4-gram are in its shard, and orders 1
and 2, bounded by the pairs of characters that occur, go with every shard. One shard at a time is gathered
and broadcast; each adds up the logarithms of the texts' 4-grams that are its own, as whole numbers, so the
sums do not depend on the number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.llm.common import discard, finish, fold, held_out, persist, slices

ORDER = 4
#: Bits of a character in a packed n-gram; characters outside the BMP share the codes above 0xE000 (private use).
BITS = 16
#: Steps of a bit in which the calibration counts cross-entropies: bounds what it gathers, whatever the number of texts.
STEP = 1 << 12
#: Temperatures of the score that the calibration tries, and the fraction in which it adds up their losses.
SCALES, LOSS_UNIT = np.exp2(np.arange(-1, 7)), 1 << 28
#: Entries (language, 4-gram) of a shard: some 30 bytes each in the worker that holds it.
SHARD_GRAMS = 4_000_000
#: Logarithms (base 2) are stored as whole numbers of this fraction.
UNIT = 1 << 24

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams of all predicted characters, the n + 1 bounds of each text's, and its number of letters.

    A text is its words with one space after each, and three spaces of context before them.
    """
    pad = " " * ORDER
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer((pad + pad.join(low) + pad).encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[code]
    code = np.where(code < 0x10000, code, 0xE000 + code % 0x1900).astype(np.int64)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.arange(len(low)) * ORDER + ORDER + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(low) else np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code[~letter] = 32
    # Each text brings ORDER pads before it: all but the last are kept, and of the text's end one space at most.
    for k in range(ORDER - 1):
        keep[starts - ORDER + 1 + k] = True
    bounds_at = np.concatenate([[0], np.cumsum(keep)])
    code = code[keep]
    letters = np.concatenate([[0], np.cumsum(letter)])
    n_letters = letters[starts + sizes] - letters[starts]
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= code[:-k] << (BITS * k)
    first = bounds_at[starts]
    last = bounds_at[starts + sizes + (1 if len(low) else 0)]
    last = np.maximum(first, last)
    return key, np.stack([first, last]), n_letters


def count_ngrams(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, ngram, n) over all rows with a text and a language."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def emit(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "ngram", "n"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in slices(batches, "text"):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                key, (first, last), _ = characters([t for t, g in zip(texts, langs, strict=True) if g == lang])
                inside = np.zeros(len(key) + 1, np.int64)
                np.add.at(inside, first, 1)
                np.add.at(inside, last, -1)
                keys, counts = np.unique(key[np.cumsum(inside)[:-1] > 0], return_counts=True)
                if lang in held:
                    keys, at = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                    counts = np.bincount(at.reshape(-1), np.concatenate([held[lang][1], counts])).astype(np.int64)
                held[lang] = keys, counts
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from emit(held)
        yield from emit(held)

    return rows.mapInArrow(run, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


@dataclass
class HashArray:
    """Rows of `values` under 64-bit keys: sorted by hash, with the start of each bucket of top bits."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    shift: int

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        bits = max(8, int(len(keys)).bit_length() + 2)
        h = finish(keys.astype(np.uint64))
        order = np.argsort(h, kind="stable")
        bucket = (h[order] >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.int32)
        return cls(keys[order], values[order], starts, 64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        bucket = (finish(keys.astype(np.uint64)) >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        first = np.minimum(at, len(self.keys) - 1)
        row = np.where((self.keys[first] == keys) & (at < end), at, -1)
        todo = np.flatnonzero((row < 0) & (at + 1 < end))  # the first entry of a bucket is mostly the one
        at, end = at[todo] + 1, end[todo]
        while len(todo):
            hit = self.keys[at] == keys[todo]
            row[todo[hit]] = at[hit]
            go = ~hit & (at + 1 < end)
            todo, at, end = todo[go], at[go] + 1, end[go]
        return row


def shard_number(middle, shards: int):
    """Shard of a packed pair of middle characters: a column or an array of whole numbers below 2**32."""
    return middle * 40_503 % 1_000_003 % shards


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class KneserNey:
    """Interpolated Kneser-Ney of one language, for the 4-grams of one shard.

    grams, counts: all 4-grams of the shard; pairs, n_pairs: all 2-grams and the numbers of distinct
    characters before them; discounts of the orders 3 and 4 (worked out from the given counts if None).
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, n_pairs: np.ndarray, discounts: tuple[float, float] | None = None):
        triples, n_triples = np.unique(grams & ((1 << (BITS * 3)) - 1), return_counts=True)
        singles, n_singles = np.unique(pairs & ((1 << BITS) - 1), return_counts=True)
        given = (None, None, *(discounts or (None, None)))
        self.levels: list[tuple[HashArray, HashArray]] = []
        for cut, keys, n in zip(given, (singles, pairs, triples, grams), (n_singles, n_pairs, n_triples, counts), strict=True):
            n = n.astype(np.float64)
            cut = discount(int((n == 1).sum()), int((n == 2).sum())) if cut is None else cut
            contexts, at = np.unique(keys >> BITS, return_inverse=True)
            at = at.reshape(-1)
            total = np.bincount(at, n)
            back = cut * np.bincount(at) / total
            self.levels.append((HashArray.build(keys, np.maximum(n - cut, 0) / total[at]), HashArray.build(contexts, back)))
        self.floor = 1 / (len(singles) + 1)  # uniform over the seen characters and one unseen

    def prob(self, keys: np.ndarray) -> np.ndarray:
        """P(last character | the three before), for packed 4-grams of the shard."""
        p = np.full(len(keys), self.floor)
        for order, (grams, contexts) in enumerate(self.levels, 1):
            part = keys & ((1 << (BITS * order)) - 1) if order < ORDER else keys
            row, ctx = grams.find(part), contexts.find(part >> BITS)
            seen = np.where(row >= 0, grams.values[row] if len(grams.values) else 0.0, 0.0)
            back = contexts.values[ctx] if len(contexts.values) else 1.0
            p = np.where(ctx >= 0, seen + back * p, p)
        return p


class Shard:
    """All languages' models of one shard, with the logarithms of every stored 4-gram worked out."""

    def __init__(self, models: list[KneserNey], grams: np.ndarray, number: int, shards: int):
        self.models, self.number, self.shards = models, number, shards
        self.table = HashArray.build(grams, self._logs(grams))

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.rint(np.log2(m.prob(keys)) * UNIT).astype(np.int32) for m in self.models], axis=1)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the logarithms of the shard's 4-grams (texts x languages), and all texts' numbers of characters and letters."""
        key, (first, last), letters = characters(texts)
        total = np.zeros((len(texts), len(self.models)), np.int64)
        own = np.flatnonzero(shard_number((key >> BITS) & 0xFFFFFFFF, self.shards) == self.number) if self.shards > 1 else None
        begin, end = (first, last) if own is None else (np.searchsorted(own, first), np.searchsorted(own, last))
        key = key if own is None else key[own]
        row = self.table.find(key)
        logs = self.table.values[row] if len(self.table.values) else np.zeros((len(key), len(self.models)), np.int32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            missed, at = np.unique(key[miss], return_inverse=True)
            logs[miss] = self._logs(missed)[at.reshape(-1)]
        some = np.flatnonzero(end > begin)
        if len(some):
            cuts = np.stack([begin[some], end[some]], axis=1).reshape(-1)
            cuts = cuts[:-1] if cuts[-1] >= len(key) else cuts
            total[some] = np.add.reduceat(logs, cuts, axis=0, dtype=np.int64)[::2]
        return total, last - first, letters


@dataclass
class Model:
    """Languages, counts as written tables, discounts, and the calibration.

    counts: (lang, ngram, n) of 4-grams; pairs: of each language, its 2-grams and continuation counts.
    """

    langs: list[str]
    counts: DataFrame | None = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    discounts: list[tuple[float, float]] = field(default_factory=list)
    shards: int = 1
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0

    def language(self, column: Column) -> Column:
        """Number of a language, null for others."""
        number = F.array_position(F.lit(self.langs), column) - 1
        return F.when(number >= 0, number.cast("int"))

    def shard(self, number: int) -> Shard:
        """Gather one shard: about SHARD_GRAMS entries, whatever the size of the corpus."""
        rows = self.counts.where(shard_number(F.shiftright("ngram", BITS).bitwiseAND(0xFFFFFFFF), self.shards) == number)
        found = rows.select(self.language(F.col("lang")).alias("lang"), "ngram", "n").toArrow()
        lang, grams, n = (found.column(c).to_numpy() for c in ("lang", "ngram", "n"))
        models = [KneserNey(grams[lang == k], n[lang == k], *self.pairs[k], self.discounts[k]) for k in range(len(self.langs))]
        return Shard(models, np.unique(grams), number, self.shards)

    def decide(self, sums: np.ndarray, n: np.ndarray, letters: np.ndarray) -> dict[str, np.ndarray]:
        """lang_pred, score, cross_entropy and rejected, from the sums of all shards."""
        h = -sums / UNIT / np.maximum(n, 1)[:, None]
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        weight = np.exp2(-self.scale * (h - low[:, None]))
        none = letters == 0
        pick = np.array([*self.langs, "und"], object)[np.where(none, len(self.langs), best)]
        return {"lang_pred": pick, "score": np.where(none, 0.0, 1 / weight.sum(axis=1)), "cross_entropy": np.where(none, np.nan, low), "rejected": none | (low > self.limits[best])}

    def statistics(self, sums: np.ndarray, n: np.ndarray, letters: np.ndarray, truth: np.ndarray) -> pa.RecordBatch:
        """What texts of known languages add to the calibration, as whole numbers that may be summed in any order.

        (kind, at, n): for a language's number, how many right texts have a cross-entropy of `at` steps; for -1, the
        loss of the scale with number `at`.
        """
        use = letters > 0
        h, truth = -sums[use] / UNIT / n[use, None], truth[use]
        low, best = h.min(axis=1, initial=np.inf), h.argmin(axis=1)
        right = best == truth
        seen, times = np.unique(np.stack([best[right], np.rint(low[right] * STEP).astype(np.int64)], axis=1), axis=0, return_counts=True)
        above = h - low[:, None]
        losses = [int(np.rint((np.log2(np.exp2(-s * above).sum(axis=1)) + s * above[np.arange(len(h)), truth]) * LOSS_UNIT).sum()) for s in SCALES]
        kinds = np.concatenate([seen[:, 0], np.full(len(SCALES), -1)])
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(np.concatenate([seen[:, 1], np.arange(len(SCALES))]), pa.int64()), pa.array(np.concatenate([times, losses]), pa.int64())], ["kind", "at", "n"])

    def calibrate(self, summed: DataFrame, truth: str, quantile: float = 0.995) -> None:
        """Rejection limits: a quantile of the right texts' cross-entropies, and slack. Scale: best log-likelihood.

        summed: log_sums of all training texts. Only the counts of the steps that occur and a sum a scale are gathered.
        """
        model, languages = Model(self.langs), len(self.langs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                yield model.statistics(*_arrays(part, languages), part.column(truth).to_numpy(zero_copy_only=False))

        found = summed.mapInArrow(run, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow().sort_by("at")
        kind, at, n = (found.column(c).to_numpy() for c in ("kind", "at", "n"))
        self.limits = np.full(languages, np.inf)
        for k in range(languages):
            value, times = at[kind == k] / STEP, n[kind == k]
            if (total := times.sum()) >= 20:
                place = quantile * (total - 1)
                below, above = value[np.searchsorted(times.cumsum(), [np.floor(place), np.ceil(place)], "right")]
                spread = np.sqrt(np.average((value - np.average(value, weights=times)) ** 2, weights=times))
                self.limits[k] = below + (place - np.floor(place)) * (above - below) + 3 * spread
        if (kind == -1).any():
            self.scale = float(SCALES[n[kind == -1].argmin()])


def log_sums(df: DataFrame, model: Model, keep: str, text_col: str) -> DataFrame:
    """keep, n (characters), letters and sums (one for each language) of every row.

    With one shard this is one pass. Else the rows are written with a tag, each shard makes a pass that
    leaves its sums in the shared folder, and the sums of a tag are added up.
    """
    spark, slim = df.sparkSession, df.select(keep, text_col)

    def a_pass(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                total, n, letters = shared.value.sums(part.column(part.schema.get_field_index(text_col)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)), pa.array(total.reshape(-1)))
                rest = [k for k, name in enumerate(part.schema.names) if name != text_col]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(n), pa.array(letters), lists], [*(part.schema.names[k] for k in rest), "__n", "__letters", "__sums"])

        kept = [f for f in rows.schema.fields if f.name != text_col]
        return rows.mapInArrow(run, T.StructType([*kept, T.StructField("__n", T.LongType()), T.StructField("__letters", T.LongType()), T.StructField("__sums", T.ArrayType(T.LongType()))]))

    if model.shards == 1:
        return a_pass(slim, spark.sparkContext.broadcast(model.shard(0)))
    tagged, passes = persist(slim.withColumn("__tag", F.monotonically_increasing_id()), "langid-texts"), None
    for number in range(model.shards):
        shared = spark.sparkContext.broadcast(model.shard(number))
        part = persist(a_pass(tagged, shared), "langid-sums")
        shared.destroy()
        passes = part if passes is None else passes.unionByName(part)
    discard(tagged)
    sums = F.array(*(F.sum(F.get("__sums", F.lit(k))) for k in range(len(model.langs))))
    return passes.groupBy("__tag").agg(F.first(keep).alias(keep), F.first("__n").alias("__n"), F.first("__letters").alias("__letters"), sums.alias("__sums")).drop("__tag")


def _arrays(part: pa.RecordBatch | pa.Table, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sums = part.column("__sums")
    flat = sums.combine_chunks() if isinstance(sums, pa.ChunkedArray) else sums
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, languages), *(np.asarray(part.column(c)) for c in ("__n", "__letters"))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count all of df, then calibrate on all of it.

    Gathered on the driver: languages, their count statistics, 2-grams and histograms of cross-entropies; of the longer
    n-grams one shard at a time.
    """
    counts = persist(count_ngrams(df, text_col, lang_col), "langid-counts")
    triples = persist(counts.groupBy("lang", F.col("ngram").bitwiseAND((1 << (BITS * 3)) - 1).alias("ngram")).agg(F.count(F.lit(1)).alias("n")), "langid-triples")

    def seen(table: DataFrame) -> dict[str, tuple[int, int, int]]:
        return {r[0]: (r[1], r[2], r[3]) for r in table.groupBy("lang").agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()}

    four, three = seen(counts), seen(triples)
    model = Model(sorted(four), counts, shards=max(1, -(-sum(v[0] for v in four.values()) // SHARD_GRAMS)))
    if not model.langs:
        return model
    model.discounts = [(discount(*three[g][1:]), discount(*four[g][1:])) for g in model.langs]
    pairs = triples.groupBy(model.language(F.col("lang")).alias("lang"), F.col("ngram").bitwiseAND((1 << (BITS * 2)) - 1).alias("ngram")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    lang, grams, n = (pairs.column(c).to_numpy() for c in ("lang", "ngram", "n"))
    model.pairs = [(grams[lang == k], n[lang == k]) for k in range(len(model.langs))]

    known = df.where(F.col(text_col).isNotNull()).select(model.language(F.col(lang_col).cast("string")).alias("__truth"), F.col(text_col)).where("__truth IS NOT NULL")
    model.calibrate(log_sums(known, model, "__truth", text_col), "__truth")
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), cross_entropy (bits a character), rejected.

    A null text and one without a letter get `und`, score 0 and no cross-entropy; without any learned
    language every text does. Rows with equal texts are judged alike, other columns are ignored, an
    empty table gives an empty result.
    """
    if not model.langs:
        return df.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    summed = log_sums(df, model, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = model_here.decide(*_arrays(part, len(model_here.langs)))
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(found["lang_pred"], pa.string()), pa.array(found["score"]), pa.array(found["cross_entropy"], from_pandas=True), pa.array(found["rejected"])], [id_col, *found])

    model_here = Model(model.langs, limits=model.limits, scale=model.scale)
    return summed.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")


def query(documents: DataFrame) -> DataFrame:
    """Train on the rows outside fold 0 and predict all rows."""
    model = train(documents.where(fold(F.col("doc_id")) != 0))
    return identify(documents, model).withColumn("held_out", held_out(F.col("doc_id")))
