"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a mask over consecutive tokens that ignores some positions, so a window still matches after a
substitution there. The masks lose nothing: a stretch that verification accepts starts with 10 equal tokens
among which substitutions take fewer than half as many places from any start on (its score stays positive);
there are 143 such patterns, and each holds a window of one of the masks.

One scan hashes the windows of each document under each mask and joins them with the benchmark's distinct ones,
which gives the pairs of document and item. For these few, window positions are joined: a hit fixes the
alignment (diagonal). In repetitive text a hit whose windows both stand a period after an equal window is
left out, since the hit a period earlier is on the same diagonal; so hits grow with the sum of two runs, not
with their product. Every diagonal is verified on the tokens: the best-scoring stretch (a match counts 1, a
mismatch -MISMATCH) must hold enough equal tokens. Tokens are runs of letters and digits, lower-cased, and
single characters of scripts that are written without spaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbis.llm.common import fresh, persist, small

#: Positions of a window that each mask compares. Together they find every pattern of 10 equal tokens that
#: best_stretch accepts at MISMATCH; a test enumerates them.
MASKS = ((0, 1, 2, 4, 6), (0, 1, 2, 4, 7))
#: Tokens of the shortest mask; shorter items are sought whole.
SPAN = min(mask[-1] for mask in MASKS) + 1
MISMATCH = 2
#: An item with fewer tokens is found only where it is a document's whole text: inside other text it is no evidence.
LEAST_ITEM = 5
#: Periods, in tokens, of repetitive text.
PERIODS = 4
#: Characters of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han): each is a token.
UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
#: Rows up to which a table is broadcast (windows and items of the benchmark, keys of hit documents).
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Overlap:
    """min_words: equal tokens that an overlap needs (all tokens of an item that has fewer)."""

    min_words: int = 10


def tokens(text: Column) -> Column:
    """Hashes of the text's tokens (null: no tokens)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parted = F.when((F.octet_length(low) > F.length(low)) & low.rlike(f"[{UNSPACED}]"), F.regexp_replace(low, f"([{UNSPACED}])", " $1 ")).otherwise(low)
    words = F.filter(F.split(parted, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(h: Column, masks: list[tuple[int, ...]]) -> Column:
    """Hashes of all windows of an array of token hashes; entry k belongs to position k div M, mask k mod M.

    Entries that would pass the end are null. Fewer tokens than LEAST_ITEM (one at least) are one window, all of them.
    """
    shortest, m = min(mask[-1] for mask in masks) + 1, len(masks)
    count = F.size(h) - shortest + 1

    def hashed(k: Column) -> Column:
        at = F.floor(k / m).cast("int") if m > 1 else k
        each = [F.xxhash64(F.lit(str(mask)), *(F.get(h, at + p) for p in mask)) for mask in masks]
        each = [F.when(at + mask[-1] < F.size(h), e) if mask[-1] >= shortest else e for e, mask in zip(each, masks, strict=True)]
        out = each[-1]
        for i in range(m - 2, -1, -1):
            out = F.when(k % m == i, each[i]).otherwise(out)
        return out

    every = F.sequence(F.lit(0), F.greatest(count, F.lit(1)) * m - 1)
    whole = F.when((F.size(h) > 0) & (F.size(h) < LEAST_ITEM), F.array(F.xxhash64(F.lit("whole"), *(F.get(h, F.lit(p)) for p in range(LEAST_ITEM - 1)))))
    return whole.when(count > 0, F.transform(every, hashed)).otherwise(F.array().cast("array<bigint>"))


def spread(hashed: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(key, w): the windows of windows(), without their places, of all rows (key, h).

    Neighbouring tokens become columns of one row, so that generated code hashes them; this is the only
    step that every token of every document passes.
    """
    at_once = max(mask[-1] for mask in masks) + 1
    shifted = [F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))) if k else F.col("h") for k in range(at_once)]
    h = [F.col(f"h{k}") for k in range(at_once)]
    rows = hashed.select("key", F.posexplode(F.arrays_zip(*shifted)).alias("at", "z")).select("key", "at", "z.*").toDF("key", "at", *(f"h{k}" for k in range(at_once)))
    each = [F.when(h[mask[-1]].isNotNull(), F.xxhash64(F.lit(str(mask)), *(h[p] for p in mask))) for mask in masks]
    whole = (F.col("at") == 0) & h[LEAST_ITEM - 1].isNull()
    each[0] = F.when(whole, F.xxhash64(F.lit("whole"), *h[: LEAST_ITEM - 1])).otherwise(each[0])
    return rows.select("key", F.explode(F.array(*each)).alias("w")).where("w IS NOT NULL")


def periodic(w: Column, m: int) -> Column:
    """Each window of an array with its number and the least period after which it repeats an earlier one (0: none)."""

    def entry(x: Column, k: Column) -> Column:
        period = F.lit(0)
        for p in range(PERIODS, 0, -1):
            period = F.when((k >= p * m) & (F.get(w, F.greatest(k - p * m, F.lit(0))) == x), p).otherwise(period)
        return F.struct(x.alias("w"), k.alias("k"), period.alias("period"))

    return F.filter(F.transform(w, entry), lambda e: e["w"].isNotNull())


def row_key(id_col: str, text_col: str) -> Column:
    """Two hashes of id and text, and the text's length: what tells a document from all others."""
    i, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    return F.struct(F.xxhash64(i, text).alias("a"), F.xxhash64(F.lit(1), text, i).alias("b"), F.length(text).alias("n"))


def hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(key, h, item_id, diagonals) of documents (doc, key, text) and items (item_id, h)."""
    short = sorted(r[0] for r in items.where(F.size("h").between(LEAST_ITEM, SPAN - 1)).select(F.size("h")).distinct().collect())  # at most SPAN - LEAST_ITEM
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    m = len(masks)
    # An item of fewer tokens than the seeds span is sought by all its tokens, others by the seeds.
    own = F.lit(len(MASKS))
    for i, n in enumerate(short, len(MASKS)):
        own = F.when(F.size("h") == n, i).otherwise(own)
    fits = (F.size("h") < LEAST_ITEM) | F.when(F.size("h") < SPAN, F.col("e.k") == own).otherwise(F.col("e.k") % m < len(MASKS))
    # One expression a step: inside a lambda, Spark would evaluate an argument anew for every element.
    theirs = items.select("item_id", "h", windows(F.col("h"), masks).alias("ws")).select("item_id", "h", F.explode(periodic(F.col("ws"), m)).alias("e"))
    theirs = persist(theirs.where(fits).select("item_id", "e.*"), "benchmark-windows")
    distinct = theirs.select("item_id", "w").distinct()
    ours = spread(documents.select("key", tokens(F.col("text")).alias("h")), masks)
    met = persist(ours.join(small(distinct, BROADCAST_ROWS), "w").select("key", "item_id").distinct(), "benchmark-pairs")
    keys = small(met.select("key").distinct(), BROADCAST_ROWS // 10)
    held = persist(documents.join(keys, "key").select("doc", "key", tokens(F.col("text")).alias("h")).distinct(), "benchmark-texts")
    placed = held.select("key", windows(F.col("h"), masks).alias("ws")).select("key", F.explode(periodic(F.col("ws"), m)).alias("e")).select("key", "e.*")
    # A window that repeats after a period meets all but those that repeat after the same one.
    others = theirs.select("item_id", "w", F.col("k").alias("at"), F.explode(F.when(F.col("period") == 0, F.sequence(F.lit(0), F.lit(PERIODS))).otherwise(F.array_remove(F.sequence(F.lit(0), F.lit(PERIODS)), F.col("period")))).alias("period"))
    diagonal = (F.floor(F.col("k") / m) - F.floor(F.col("at") / m)).cast("int")
    laid = placed.join(small(others, BROADCAST_ROWS), ["w", "period"]).groupBy("key", "item_id").agg(F.collect_set(diagonal).alias("diagonals"))
    return held.join(laid, "key")


def best_stretch(h: Column, item: Column, diagonal: Column) -> Column:
    """Equal tokens in the best-scoring stretch of item laid over h from `diagonal` on."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("equal"), F.lit(0).alias("best"), F.lit(0).alias("found"))

    def step(s: Column, j: Column) -> Column:
        same = F.coalesce(F.get(h, diagonal + j) == F.get(item, j), F.lit(False))
        score = F.when(same, s["score"] + 1).otherwise(F.greatest(s["score"] - MISMATCH, F.lit(0)))
        equal = F.when(same, s["equal"] + 1).when(s["score"] > MISMATCH, s["equal"]).otherwise(0)
        better = same & (s["score"] + 1 >= s["best"])
        return F.struct(score.alias("score"), equal.alias("equal"), F.when(better, s["score"] + 1).otherwise(s["best"]).alias("best"), F.when(better, s["equal"] + 1).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step, lambda s: s["found"])


def overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rule: Overlap = Overlap()) -> DataFrame:
    """One row per document and item that overlap: id, item_id, matched_words, item_words, key.

    Null or empty texts overlap nothing, equal rows (id and text) give one result row, null ids stay null,
    other columns are ignored, and an empty table on either side gives an empty result. Items with equal
    ids and different texts are each reported; equal items once. A pair's diagonals, at most as many as its
    two texts have tokens, are held in one row beside the tokens.
    """
    items = persist(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("h")).where(F.size("h") > 0).distinct(), "benchmark-items")
    numbered = persist(items.select(F.struct("item_id", F.monotonically_increasing_id().alias("number")).alias("item_id"), "h"), "benchmark-numbered")
    keyed = documents.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("key"))
    found = persist(hits(keyed, numbered), "benchmark-hits")
    known = small(numbered.withColumnRenamed("h", "item"), BROADCAST_ROWS // 10)
    joined = found.join(known, found["item_id"]["number"] == known["item_id"]["number"]).select("doc", "key", found["item_id"]["item_id"].alias("item_id"), "h", "item", "diagonals")
    best = F.array_max(F.transform("diagonals", lambda d: best_stretch(F.col("h"), F.col("item"), d)))
    measured = joined.select(F.col("doc").alias(id_col), "key", "item_id", F.size("item").alias("item_words"), best.alias("matched_words"))
    return measured.where(F.col("matched_words") >= F.least(F.col("item_words"), F.lit(rule.min_words)))


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, matched_words of every contaminated document and the items it holds."""
    return overlaps(documents, benchmark).select("doc_id", "item_id", "item_words", "matched_words").distinct()


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Overlap = Overlap()) -> DataFrame:
    """The rows that overlap no item, with all their columns."""
    name = fresh(documents, "contaminated")
    bad = persist(overlaps(documents, benchmark, id_col, text_col, rule=rule).select(F.col("key").alias(name)).distinct(), "contaminated")
    return documents.join(small(bad, BROADCAST_ROWS // 10), row_key(id_col, text_col) == F.col(name), "left_anti")
