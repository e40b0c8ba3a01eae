"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of a word. A proposal is the merge result if no merge can
cross the border of any two neighbouring tokens; that is checked for all distinct neighbours at once,
by walking up the two tokens' border spines in order of merge rank. Only the words with a failing pair
are merged exactly. The vocabulary file's own normaliser, pre-tokeniser and special tokens are applied.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbis.llm.common import slices

#: Words a worker keeps encoded before it starts afresh; only speed depends on it.
KEPT_WORDS = 300_000
_FAR = np.int64(1) << 40
_NONE = (1 << 40, -1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others get the code points from 256 up in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


# Code points that the tokenizers library holds for letters or numbers, and capitals that it
# lower-cases, although Unicode 15.1 (the installed Python's tables) has not assigned them.
_LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
_LATER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LATER_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

# Marks that the library's canonical composition, of an older Unicode version, neither reorders nor composes.
_LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)

_MARKS = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER_MARKS) + "])")
#: Code points with rules of their own; few texts hold one.
_RARE = np.zeros(0x110000, bool)
_RARE[list(_LATER_CAPITALS)] = True
for _low, _high in _LATER_MARKS:
    _RARE[_low : _high + 1] = True


def composed(text: str) -> str:
    """Canonical composition as the library does it: marks that it does not know stand as they are and part the text."""
    return "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(_MARKS.split(text)))


def normal(text: str) -> str:
    """Composed and lower-cased as the library does it: letter by letter, so without a final sigma."""
    if _RARE[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any():
        text = composed(text).translate(_LATER_CAPITALS)
    else:
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def _kinds() -> str:
    """A letter for each code point: L letters, N numbers, S white space, - others; as the tokenizers library has them."""
    kinds = [k if (k := unicodedata.category(chr(c))[0]) in "LN" else "-" for c in range(0x110000)]
    for k, ranges in (("L", _LATER_LETTERS), ("N", _LATER_NUMBERS)):
        for low, high in ranges:
            kinds[low : high + 1] = k * (high + 1 - low)
    for c in range(0x10000):
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            kinds[c] = "S"
    return "".join(kinds)


def _spelt(pattern: str, kinds: str) -> str:
    """The pattern with its property classes spelt out as the ranges of the code points in `kinds`."""
    for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "S")):
        text = "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{kind}+", kinds))
        pattern = pattern.replace(f"[{name}]", f"[{text}]").replace(name, text)
    return pattern


class _Rows(dict):
    """Row of each known word; an unknown one gets the next row and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = row = len(self)
        return row


class WordBpe:
    """Encoder and decoder of a byte-level BPE vocabulary with an end-of-word suffix (tokenizers JSON)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self._check(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.names = np.full(size, "", object)
        for name, i in chain(self.vocab.items(), self.special.items()):
            self.names[i] = name
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.product = [self.vocab[a + b] for a, b in merges]
        self.letters = byte_letters()
        self.byte_map = {b: ord(c) for b, c in enumerate(self.letters)}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = _kinds()
        self.split, self.quick = re.compile(_spelt(split, kinds)), re.compile(_spelt(split, kinds[:0x10000]))  # quick: no code point beyond the BMP
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._tables(size)
        self._restart()

    def _check(self, spec: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pre = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or pre != ["Split", "ByteLevel"] or not self.suffix or spec.get("decoder"):
            raise ValueError("a vocabulary of another kind")

    def _tables(self, size: int) -> None:
        """Parents along the border spines: for each token, its symbols at one border and their merges upwards."""
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)  # rank that makes the token, -1 for symbols
        for (a, b), (r, t) in self.rank.items():
            if self.made[t] < 0:
                left[t], right[t], self.made[t] = a, b, r
        self.left_spine, self.right_spine = self._spine(left), self._spine(right)
        pairs = np.array([(a << 24) | b for a, b in self.rank], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], np.arange(len(pairs), dtype=np.int64)[order]
        # Proposals use only tokens that merging their own symbols gives back.
        self.valid = {name: i for name, i in self.vocab.items() if self.merge(self._symbols(name)) == [i]}
        self.longest = max(map(len, self.valid))
        self.reach: dict[str, int] = {}  # length of the longest token that begins with two given letters
        for name in self.valid:
            if not name.endswith(self.suffix):
                self.reach[name[:2]] = max(len(name), self.reach.get(name[:2], 1))
        self.known = np.zeros(0, np.int64)
        self.known_ok = np.zeros(0, bool)

    @staticmethod
    def _spine(child: np.ndarray) -> np.ndarray:
        """Row t: the border symbol of t, its parent, and so on up to t; padded with -1."""
        levels, at = [np.arange(len(child))], np.arange(len(child))
        while (child[at] >= 0).any():
            at = np.where(child[at] >= 0, child[at], at)
            levels.append(at)
        down = np.stack(levels, axis=1)
        depth = (down[:, 1:] != down[:, :-1]).sum(axis=1)
        out = np.full((len(child), down.shape[1] + 1), -1, np.int64)
        for k in range(down.shape[1]):
            rows = np.flatnonzero(depth >= k)
            out[rows, depth[rows] - k] = down[rows, k]
        return out

    def _symbols(self, name: str) -> list[int]:
        whole = name.endswith(self.suffix) and len(name) > len(self.suffix)
        body = name[: -len(self.suffix)] if whole else name
        ids = [self.vocab[c] for c in body]
        if whole:
            ids[-1] = self.vocab[body[-1] + self.suffix]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        ids, get = list(ids), self.rank.get
        ranks = [get(p, _NONE)[0] for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < _NONE[0]:
            i = ranks.index(best)
            ids[i : i + 2] = [self.product[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)[0]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)[0]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """merge() by a heap over a linked list, for words of any length."""
        import heapq

        if len(ids) < 48:
            return self.merge(ids)
        ids, after, before = list(ids), [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = self.rank[pair][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, p))
        return [t for t in ids if t >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of a word of byte letters."""
        out, at, n, valid = [], 0, len(word), self.valid
        while at < n:
            rest = word[at:] + self.suffix if n - at <= self.longest else None
            if rest is not None and rest in valid:
                out.append(valid[rest])
                break
            for end in range(min(n - 1, at + self.reach.get(word[at : at + 2], 1)), at, -1):
                if word[at:end] in valid:
                    break
            else:
                return [*out, *self._symbols(word[at:] + self.suffix)]
            out.append(valid[word[at:end]])
            at = end
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens (left << 24 | right)."""
        a, b = keys >> 24, keys & 0xFFFFFF
        i, j = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ok, todo = np.ones(len(keys), bool), np.arange(len(keys))
        while len(todo):
            x, y = self.right_spine[a[todo], i[todo]], self.left_spine[b[todo], j[todo]]
            pair = x << 24 | y
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            crossing = np.where(self.pairs[at] == pair, self.pair_rank[at], _FAR)
            up_x, up_y = self.right_spine[a[todo], i[todo] + 1], self.left_spine[b[todo], j[todo] + 1]
            next_x, next_y = np.where(up_x >= 0, self.made[up_x], _FAR), np.where(up_y >= 0, self.made[up_y], _FAR)
            bad = (crossing < next_x) & (crossing <= next_y) & (crossing < _FAR)
            ok[todo[bad]] = False
            go = ~bad & ((next_x < _FAR) | (next_y < _FAR))
            step_x = next_x <= next_y
            i[todo[go & step_x]] += 1
            j[todo[go & ~step_x]] += 1
            todo = todo[go]
        return ok

    def _verified(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        have = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        if not have.all():
            new = np.unique(keys[~have])
            both, ok = np.concatenate([self.known, new]), np.concatenate([self.known_ok, self.compatible(new)])
            order = np.argsort(both, kind="stable")
            self.known, self.known_ok = both[order], ok[order]
            at = np.searchsorted(self.known, keys)
        ok = self.known_ok[at]
        if len(self.known) > 2_000_000:
            self.known, self.known_ok = self.known[:0], self.known_ok[:0]
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (pre-tokeniser output)."""
        mapped = [w.encode().decode("latin-1").translate(self.byte_map) for w in words]
        found = [self.propose(w) for w in mapped]
        flat = np.fromiter(chain.from_iterable(found), np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(found)), sizes)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            ok = self._verified(flat[inner] << 24 | flat[inner + 1])
            for w in np.unique(owner[inner[~ok]]).tolist():
                found[w] = self.merge_long(self._symbols(mapped[w] + self.suffix))
        return found

    # Encoded words, as rows of a pool of tokens and a pool of their strings, each with a space before it.

    def _restart(self) -> None:
        self.rows = _Rows()
        self.pool, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.shown, self.shown_offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _fill(self) -> None:
        """Encode the words noted as new."""
        new, self.rows.new = self.rows.new, []
        if not new:
            return
        plain = [w for w in new if w not in self.special]
        found = dict(zip(plain, self.encode_words(plain), strict=True))
        ids = [found[w] if w in found else [self.special[w]] for w in new]
        shown = [f" {' '.join(map(self.names.__getitem__, i))}".encode() for i in ids]
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(i) for i in ids])])
        self.shown = np.concatenate([self.shown, np.frombuffer(b"".join(shown), np.uint8)])
        self.shown_offsets = np.concatenate([self.shown_offsets, self.shown_offsets[-1] + np.cumsum([len(b) for b in shown])])

    def words_of(self, text: str) -> list[str]:
        """The text's words and special tokens in order (special tokens are found in the raw text)."""
        if self.cut is not None and "<|" in text and self.cut.search(text):
            out: list[str] = []
            for piece in self.cut.split(text):
                out.extend([piece] if piece in self.special else self._plain(piece))
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = normal(text)
            if len(text.encode("utf-16-le")) > 2 * len(text):
                return self.split.findall(text)
            return self.quick.findall(text)
        return self.quick.findall(text.lower())

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts in one array, the n + 1 offsets of the texts, and the decoded texts."""
        if len(self.rows) > KEPT_WORDS:
            self._restart()
        row_of = self.rows.__getitem__
        rows = [list(map(row_of, self.words_of(t))) if t else [] for t in texts]
        self._fill()
        flat = np.fromiter(chain.from_iterable(rows), np.int64, sum(map(len, rows)))
        words = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        at, ends = _ragged(self.offsets, flat)
        text_at, text_ends = _ragged(self.shown_offsets, flat)
        shown, text_bounds = self.shown[text_at], text_ends[words]
        some = np.flatnonzero(np.diff(text_bounds))  # each text's first space goes
        lead = np.zeros(len(texts) + 1, np.int64)
        lead[some + 1] = 1
        shown = np.delete(shown, text_bounds[some])
        decoded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(text_bounds - np.cumsum(lead)), pa.py_buffer(shown.tobytes()))
        return self.pool[at], ends[words], decoded.cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does: the tokens' strings, one space between; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names) and self.names[i])


def _ragged(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the elements of the given rows one after another, and where each row's end."""
    starts = offsets[rows]
    sizes = offsets[rows + 1] - starts
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes), ends


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


_LOADED: dict[int, WordBpe] = {}


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int), decoded (the ids decoded again).

    vocabulary: path of the vocabulary file, read on the driver and broadcast (a few MB, whatever the
    input). Null and empty texts have no ids and decode to "". Repeated rows are encoded alike, null ids
    stay null, other columns are ignored, an empty table gives an empty result.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    slim, key = df.select(id_col, text_col), hash(vocabulary) ^ id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = WordBpe(json.loads(shared.value))
        coder = _LOADED[key]
        for part in slices(batches, text_col):
            ids, bounds, decoded = coder.encode_batch(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), decoded], [id_col, "ids", "decoded"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of encode()'s result."""
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
