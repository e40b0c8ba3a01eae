"""Quality rules by suffix-array repetition.

The words of a slice of texts are numbered, every text ends in a sentinel of its own, and one suffix
array over the slice is built by prefix doubling; only suffixes whose rank is still shared are sorted
again. The longest repeat that starts at a suffix is its larger common prefix with its two neighbours in
suffix order, the depth of the deepest LCP interval that holds it; so the intervals need not be stored.
Repeats that no longer repeat covers are the maximal ones, and the union of their spans, over all suffixes,
is the covered part. A text fails the method if the covered fraction or the longest repeated run exceeds its
limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urbis.llm.common import Spans, slices, sums, text_bytes

#: Fixed values of the base counts.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Limits:
    """min_repeat: words from which a repeat counts; limits: of the covered fraction and the longest repeat."""

    min_repeat: int = WINDOW
    max_covered: float = 0.30
    max_longest: int = 50


#: The method's own limits: repeats shorter than the base rule's window count too, such as runs of one word.
METHOD = Limits(min_repeat=4)


def repeat_lengths(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each word, the longest run starting there that also starts elsewhere in its text.

    This is the larger LCP with the two neighbours in the suffix array. words: ids from 0; begins: n + 1
    positions where texts begin. Runs never cross a text's end, and texts are never compared.
    """
    n, texts = len(words), len(begins) - 1
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    owner = np.repeat(np.arange(texts), np.diff(begins))
    end = begins[1:][owner]
    # Level k: names[k][i] names the run of 2**k words at i; -1 where it would pass the end of the text.
    rank = np.unique(owner * (int(words.max()) + 1) + words, return_inverse=True)[1].reshape(-1).astype(np.int64)
    names, width = [rank], 1
    shared = np.flatnonzero(np.bincount(rank)[rank] > 1)
    while len(shared):
        fits = shared[shared + 2 * width <= end[shared]]
        name = np.full(n, -1, np.int64)
        alive = fits[names[-1][fits + width] >= 0]
        if not len(alive):
            break
        pairs = names[-1][alive] * n + names[-1][alive + width]
        _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        inverse = inverse.reshape(-1)
        twice = counts[inverse] > 1
        name[alive[twice]] = inverse[twice]
        if not twice.any():
            break
        names.append(name)
        shared, width = alive[twice], 2 * width
    # Suffix order among suffixes that repeat at all: sort by the longest level down, which is the order of
    # the suffix array restricted to them, then take the LCP of neighbours by descending the levels.
    at = np.flatnonzero(np.bincount(names[0])[names[0]] > 1)
    order = suffix_order(names, at, n)
    left, right = order[:-1], order[1:]
    length = np.zeros(len(left), np.int64)
    for k in range(len(names) - 1, -1, -1):
        i, j = left + length, right + length
        ok = (i < n) & (j < n)
        a, b = names[k][np.where(ok, i, 0)], names[k][np.where(ok, j, 0)]
        same = ok & (a == b) & (a >= 0)
        if k == 0:
            same &= owner[np.where(ok, i, 0)] == owner[left]
        length[same] += 1 << k
    np.maximum.at(out, left, length)
    np.maximum.at(out, right, length)
    return out


def suffix_order(names: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
    """The positions `at` in suffix-array order, by doubling ranks on those alone.

    names[0] ranks single words. A suffix whose next words are unique in the slice is separated from all
    others there, so ranks outside `at` are those of single words.
    """
    rank = np.full(n + 1, -1, np.int64)
    rank[:n] = names[0] * (n + 1)  # room for finer ranks below each word
    order = at[np.argsort(rank[at], kind="stable")]
    width, todo = 1, np.ones(len(order), bool)
    while True:
        head = rank[order]
        new = np.empty(len(order), bool)
        if len(order):
            new[0] = True
            new[1:] = head[1:] != head[:-1]
        group = np.cumsum(new) - 1
        todo = np.bincount(group, minlength=1)[group] > 1 if len(order) else todo
        slots = np.flatnonzero(todo)
        if not len(slots):
            return order
        after = order[slots] + width
        second = np.where(after <= n, rank[np.minimum(after, n)], -1)
        by = np.lexsort((second, head[slots]))
        order[slots] = order[slots][by]
        head, second = head[slots][by], second[by]
        first = np.ones(len(slots), bool)
        first[1:] = head[1:] != head[:-1]
        step = first | np.concatenate([[True], second[1:] != second[:-1]])
        base = np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))
        place = np.maximum.accumulate(np.where(step, np.arange(len(slots)), 0))
        rank[order[slots]] = head + place - base  # by place, so that a later split finds free ranks
        width *= 2
        if width > n:
            return order


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of the repeats of `least` words or more."""
    mark = np.zeros(len(lengths) + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + lengths[at], -1)
    return np.cumsum(mark)[:-1] > 0


def measure(column: pa.Array, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """Counts and verdicts of a slice of texts (null: empty text)."""
    data, offsets = text_bytes(column)
    spans = Spans(data, offsets)
    starts, ends, begins = spans.words()
    hashes = spans.hashes(starts, ends)
    _, ids = np.unique(hashes, return_inverse=True)
    n_words = np.diff(begins)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    word_chars = sums(heads[ends] - heads[starts], begins)
    n_symbols = sums(_SYMBOL[data].astype(np.int64), offsets)

    line_starts, line_ends, line_begins = spans.lines()
    filled = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_owner = np.repeat(np.arange(len(offsets) - 1), np.diff(line_begins))[filled]
    line_hash = spans.hashes(line_starts[filled], line_ends[filled])
    n_lines = np.bincount(line_owner, minlength=len(n_words))
    distinct = np.unique(np.stack([line_owner.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64) if len(line_hash) else np.zeros(0, np.int64)
    n_dup_lines = n_lines - np.bincount(distinct, minlength=len(n_words))

    lengths = repeat_lengths(ids.reshape(-1).astype(np.int64), begins)
    windows = covered(lengths, WINDOW)
    n_repeat = sums(windows.astype(np.int64), begins)
    spans_in = windows if limits.min_repeat == WINDOW else covered(lengths, limits.min_repeat)
    n_covered = sums(spans_in.astype(np.int64), begins)
    longest = np.zeros(len(n_words), np.int64)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    np.maximum.at(longest, owner, lengths)
    failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    fraction = n_covered / np.maximum(n_words, 1)
    kept = ~failed & (fraction <= limits.max_covered) & (longest <= limits.max_longest)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "covered_fraction": fraction, "longest_repeat": longest}


def _typed(found: dict[str, np.ndarray]) -> list[pa.Array]:
    return [pa.array(v if v.dtype.kind in "bf" else v.astype(np.int64)) for v in found.values()]


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per input row: id, base counts, base_failed, kept, covered_fraction, longest_repeat.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, null ids
    stay null, other columns are ignored, and an empty table gives an empty result.
    """
    slim = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            found = measure(part.column(1), limits)
            yield pa.RecordBatch.from_arrays([part.column(0), *_typed(found)], [id_col, *found])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, {_RESULT}")


def keep_good(df: DataFrame, text_col: str = "text", limits: Limits = METHOD) -> DataFrame:
    """The rows whose text passes the rules, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.filter(pa.array(measure(part.column(text_col), limits)["kept"]))

    return df.mapInArrow(run, df.schema)
