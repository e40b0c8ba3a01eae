"""N-gram Jaccard join by a MinHash LSH forest, and the classes of documents it links.

Texts are sets of word shingles. Equal texts are collapsed first. Each other text has a MinHash signature
of TREES paths of DEPTH labels; a tree is the table of its paths in sorted order, where a prefix is a run
of neighbouring rows and a trie node. Levels go from the deepest prefix to shorter ones. At a level, every
trie node that branches there joins its texts, and all its pairs that share no longer prefix in any tree
and no such prefix in an earlier tree are verified exactly, so each pair is verified once in the forest.

Prefixes are shortened adaptively. A link of similarity s is found at level d with chance
1 - (1 - s**d)**TREES, so the exact similarities of a text's links tell how many it still lacks. A text
whose expected share of found links has reached the target recall opens no more nodes; a text without links
goes on to the level at which even links at the threshold are found with the target's chance.

A node's texts are dealt to blocks bounded in bytes and in texts. Blocks are verified against themselves
where they are packed, and pairs of blocks of one crowded node in tasks of their own, by sparse incidence
products; only sums for each text and a spanning forest of the links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.llm.common import Spans, discard, finish, persist, slices, small, text_bytes, word_shingles

#: Unless a contract says otherwise: five words, similarity 0.8.
WORDS = 5
THRESHOLD = 0.8
TREES = 32
#: Labels of a path; a label is a byte, so a path is a 64-bit number.
DEPTH = 8
TARGET_RECALL = 0.9999
#: Texts and shingles (8 bytes each) of a block of a crowded trie node; a longer text is a block of its own.
BLOCK = 512
BLOCK_SHINGLES = 1 << 18

#: Labels by which a level's prefix is shorter than that of the level before.
STEP = 2

#: Rows of ids (24 bytes each) up to which a table is broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: A shingle in at most this many texts of a task is counted pair by pair, others by matrix product.
FEW = 16
#: Pairs whose paths are compared at once.
PAIRS_AT_ONCE = 1 << 15

_RNG = np.random.default_rng(1618)
_MULTIPLY = _RNG.integers(1, 2**32, (TREES, DEPTH), dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, (TREES, DEPTH), dtype=np.uint32)


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """That two texts of this similarity share a prefix of `depth` labels in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def last_level(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix that texts of similarity `threshold` share in some tree with chance `target`."""
    depth = DEPTH
    while depth > 1 and chance(threshold, depth) < target:
        depth -= 1
    return depth


def levels(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> list[int]:
    """Lengths of the prefixes, from the whole path down to last_level()."""
    least = last_level(threshold, target)
    return [*range(DEPTH, least, -STEP), least]


def shingle_sets(column: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, the n + 1 bounds of each text's, and a 64-bit hash of each text's words.

    A text with fewer words than `width` (one at least) is one shingle, all its words; one without words has none.
    """
    data, offsets = text_bytes(column)
    spans = Spans(data, offsets)
    starts, ends, begins = spans.words()
    hashes = spans.hashes(starts, ends)
    shingles, text = word_shingles(hashes, begins, width)
    n_words = np.diff(begins)
    index = np.arange(len(hashes)) - np.repeat(begins[:-1], n_words)
    place = finish(hashes + (index.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(place, out=total[1:])
    identity = finish((total[begins[1:]] - total[begins[:-1]]) + n_words.astype(np.uint64))
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    shingles, text = np.concatenate([shingles, identity[few]]), np.concatenate([text, few])
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    if len(shingles):
        new = np.ones(len(shingles), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
        shingles, text = shingles[new], text[new]
    return shingles, np.searchsorted(text, np.arange(len(n_words) + 1)), identity


def tree_paths(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Path of each text in each tree (texts x TREES), its first label in the top byte.

    A label is a byte of the least of the shingles' 32-bit hashes; every label has a hash function of its
    own. Rows of empty sets are meaningless.
    """
    some = np.flatnonzero(np.diff(bounds))
    paths = np.zeros((len(bounds) - 1, TREES), np.uint64)
    starts = bounds[:-1][some]
    halves = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for tree in range(TREES if len(some) else 0):
        path = np.zeros(len(some), np.uint64)
        for level in range(DEPTH):
            least = np.minimum.reduceat(halves[level % 2] * _MULTIPLY[tree, level] + _ADD[tree, level], starts)
            path = path << np.uint64(8) | finish(least.astype(np.uint64) + np.uint64(DEPTH * tree + level + 1)) >> np.uint64(56)
        paths[some, tree] = path
    return paths.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes but the smallest of each component, for edges (a, b).

    Alternating large-star and small-star steps; each round is written to the shared folder, and the
    rounds end when the edges stay the same. Work per round is linear in the edges. Each node's least
    neighbour is written before it is joined back, so that Spark sees two plain shuffles and splits the
    one node of a large component that most edges end in. A round's tables go when the next one is written.
    """
    edges = persist(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = persist(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-least")
        large = persist(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components-large")
        low = persist(large.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        small_star = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = persist(small_star, "components")
        discard(edges, least, large, low)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def intersections(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of sets[i] & sets[j] for i < cut <= j (or for all pairs if cut is 0; the diagonal is meaningless)."""
    n, rows = len(sets), cut or len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    order = np.argsort(column, kind="stable")
    owner, each = owner[order], counts[column[order]]
    flat = []
    for c in range(2, FEW + 1):
        members = owner[each == c].reshape(-1, c)  # ascending within a shingle
        for i in range(c):
            for j in range(i + 1, c):
                flat.append(members[:, i] * n + members[:, j])
    common = np.bincount(np.concatenate(flat), minlength=n * n).reshape(n, n).astype(np.float32) if flat else np.zeros((n, n), np.float32)
    common = common[:rows, cut:] if cut else common + common.T
    many = np.flatnonzero(each > FEW)
    if len(many):
        serial = np.unique(column[order][many], return_inverse=True)[1].reshape(-1)
        for start in range(0, int(serial[-1]) + 1, 2048):
            inside = many[(serial >= start) & (serial < start + 2048)]
            at = serial[(serial >= start) & (serial < start + 2048)] - start
            part = np.zeros((n, int(at.max()) + 1), np.float32)
            part[owner[inside], at] = 1
            common += part[:rows] @ part[cut:].T
    return common


class Block:
    """Texts of a trie node: node ids, rows with each text, whether each still seeks links, paths and shingle sets."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, seeking: np.ndarray, paths: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.weights, self.seeking, self.paths, self.sets = nodes, weights, seeking, paths, sets

    def pack(self) -> bytes:
        sizes = np.array([len(self.nodes), *map(len, self.sets)], np.int64)
        return b"".join(np.ascontiguousarray(a).tobytes() for a in (sizes, self.nodes, self.weights, self.seeking.astype(np.int64), self.paths, *self.sets))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        words = np.frombuffer(data, np.int64)
        n = int(words[0])
        sizes, at = words[1 : n + 1], n + 1
        nodes, weights, seeking = (words[at + k * n : at + (k + 1) * n] for k in range(3))
        at += 3 * n
        paths, at = words[at : at + n * TREES].view(np.uint64).reshape(n, TREES), at + n * TREES
        return cls(nodes, weights, seeking > 0, paths, np.split(words[at:].view(np.uint64), np.cumsum(sizes)[:-1]))

    def __add__(self, other: Block) -> Block:
        return Block(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("nodes", "weights", "seeking", "paths")), [*self.sets, *other.sets])


def verify(block: Block, cut: int, tree: int, level: int, above: int | None, least: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links between the texts before `cut` and from it on (all pairs if cut is 0) that belong to this tree and level.

    above: the level before. Returns each text's linked rows, the links it is expected to lack for each found one at each of the
    levels least..DEPTH, and for each text the first text of its component here.
    """
    n, rows = len(block.nodes), cut or len(block.nodes)
    sizes = np.array([len(s) for s in block.sets])
    common = intersections(block.sets, cut).astype(np.float64)  # single precision would lose pairs exactly at the threshold
    # |A & B| >= t |A | B|, in whole numbers of shingles
    linked = common * (1 + threshold) >= threshold * (sizes[:rows, None] + sizes[None, cut:]) - 1e-6
    if not cut:
        linked = np.triu(linked, 1)
    first, second = np.nonzero(linked)
    same = common[first, second]
    second = second + cut
    keep = np.zeros(len(first), bool)
    for k in range(0, len(first), PAIRS_AT_ONCE):
        i, j = first[k : k + PAIRS_AT_ONCE], second[k : k + PAIRS_AT_ONCE]
        apart = block.paths[i] ^ block.paths[j]
        met = apart >> np.uint64(8 * (DEPTH - level)) == 0
        good = met[:, tree] & ~met[:, :tree].any(axis=1)
        if above:
            good &= ~(apart >> np.uint64(8 * (DEPTH - above)) == 0).any(axis=1)
        keep[k : k + PAIRS_AT_ONCE] = good
    keep &= block.seeking[first] | block.seeking[second]
    first, second, same = first[keep], second[keep], same[keep]
    likeness = same / (sizes[first] + sizes[second] - same)
    ends, theirs = np.concatenate([first, second]), block.weights[np.concatenate([second, first])]
    total = np.bincount(ends, theirs, minlength=n).astype(np.int64)
    lack = np.zeros((n, DEPTH - least + 1))
    for k in range(DEPTH - least + 1):
        each = 1 / chance(likeness, least + k) - 1
        lack[:, k] = np.bincount(ends, theirs * np.concatenate([each, each]), minlength=n)
    label = np.arange(n)
    while len(first):
        low = np.minimum(label[first], label[second])
        before = label.copy()
        np.minimum.at(label, before[first], low)
        np.minimum.at(label, before[second], low)
        label = label[label]
        if (label == before).all():
            break
    return total, lack, label


RESULT = "node long, other long, links long, lack array<double>"


def _rows(block: Block, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple]:
    """Rows of RESULT: the sums of each linked text, and an edge to the first text of its component."""
    total, lack, label = found
    some, moved = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(label)))
    out = [(i, None, t, row) for i, t, row in zip(block.nodes[some].tolist(), total[some].tolist(), lack[some].tolist(), strict=True)]
    return out + [(i, o, 0, None) for i, o in zip(block.nodes[moved].tolist(), block.nodes[label[moved]].tolist(), strict=True)]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
_PACKED = ["node", "other", "links", "lack", "task", "tree", "piece", "block"]


def _pack(batches: Iterator[pa.RecordBatch], level: int, above: int | None, least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (task, part, tree, blocks, node, n, seeking, paths, shingles) sorted by task and part -> results, and blocks of crowded nodes."""
    key, held, filled, piece = None, [], 0, 0

    def done() -> list[tuple]:
        block = Block(*(np.array([h[k] for h in held], np.int64) for k in (0, 1, 2)), np.stack([h[3] for h in held]), [h[4] for h in held])
        block.seeking = block.seeking > 0
        out = [(*r, None, None, None, None) for r in _rows(block, verify(block, 0, key[2], level, above, least, threshold))] if len(held) > 1 else []
        if key[3] > 1:
            out.append((None, None, None, None, key[0], key[2], key[1] << 32 | piece, block.pack()))
        return out

    types = [*_TYPES, pa.int64(), pa.int32(), pa.int64(), pa.large_binary()]
    for batch in batches:
        out: list[tuple] = []
        columns = [c.to_pylist() for c in batch.columns[:7]]
        for k, (*now, node, n, seeking) in enumerate(zip(*columns, strict=True)):
            paths, shingles = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (7, 8))
            new = key is not None and key != now
            if held and (new or (key[3] > 1 and (len(held) >= BLOCK or filled + len(shingles) > BLOCK_SHINGLES))):
                out += done()
                held, filled, piece = [], 0, piece + 1
            if new:
                piece = 0
            key = now
            held.append((node, n, seeking, paths, shingles))
            filled += len(shingles)
            if len(out) > 10_000 or any(r[7] is not None for r in out):
                yield _batch(out, _PACKED, types)
                out = []
        if out:
            yield _batch(out, _PACKED, types)
    if held:
        out = done()
        if out:
            yield _batch(out, _PACKED, types)


def _meet(batches: Iterator[pa.RecordBatch], level: int, above: int | None, least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, other block) -> results over the pairs between the two."""
    for batch in batches:
        for k in range(batch.num_rows):
            tree, x, y = batch.column(0)[k].as_py(), *(Block.unpack(batch.column(c)[k].as_buffer()) for c in (1, 2))
            both = x + y
            out = _rows(both, verify(both, len(x.nodes), tree, level, above, least, threshold))
            if out:
                yield _batch(out, _PACKED[:4], _TYPES)


ROW, IDENTITY, PATHS, SIZE = "__urbis_row", "__urbis_identity", "__urbis_paths", "__urbis_size"


def _level(forest: DataFrame, sets: DataFrame, satisfied: DataFrame | None, opened: DataFrame | None, level: int, above: int | None, least: int, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Results of a level of the forest and the nodes opened for it (written tables), or None if no node is opened."""
    spark = forest.sparkSession
    prefix = F.shiftrightunsigned("path", 8 * (DEPTH - level))
    child = F.shiftrightunsigned("path", 8 * (DEPTH - (above or level)))
    rows = forest.select("tree", "node", "size", prefix.alias("prefix"), child.alias("child"))
    if satisfied is not None:
        rows = rows.join(small(satisfied.withColumn("quiet", F.lit(1)), BROADCAST_ROWS), "node", "left").withColumn("seeking", F.col("quiet").isNull().cast("int")).drop("quiet")
    else:
        rows = rows.withColumn("seeking", F.lit(1))
    nodes = rows.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("node").alias("least"),
        F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.hash("node")).alias("mark2"),
        F.max("seeking").alias("seeking"), (F.min("child") != F.max("child")).alias("branches"),
    ).where("n > 1 AND seeking = 1")
    if above:  # where all texts go on to one child, all pairs share a longer prefix
        nodes = nodes.where("branches")
    # Nodes with the same texts: the one of the earliest tree verifies all their pairs, at their deepest level.
    same = ["n", "least", "mark", "mark2"]
    nodes = nodes.groupBy(same).agg(F.min(F.struct("tree", "prefix")).alias("at"), F.min("shingles").alias("shingles"))
    if opened is not None:
        nodes = nodes.join(opened.select(same), same, "left_anti")
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK)).cast("int")
    nodes = persist(nodes.select("at.tree", "at.prefix", blocks.alias("blocks"), *same), "near-nodes")
    if nodes.isEmpty():
        discard(nodes)
        return None
    dealt = rows.join(nodes.select("tree", "prefix", "blocks"), ["tree", "prefix"]).select(F.xxhash64("tree", "prefix").alias("task"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("part"), "tree", "blocks", "node", "seeking")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = dealt.join(sets, "node").select("task", "part", "tree", "blocks", "node", "n", "seeking", "paths", "shingles").repartition(spread, "task", "part").sortWithinPartitions("task", "part", "tree", "blocks")
    found = persist(tasks.mapInArrow(lambda b: _pack(b, level, above, least, threshold), f"{RESULT}, task long, tree int, piece long, block binary"), "near-level")
    results = found.where("block IS NULL").select("node", "other", "links", "lack")
    crowded = found.where("block IS NOT NULL").select("task", "tree", "piece", "block")
    if not crowded.isEmpty():
        x, y = crowded.select("task", "tree", F.col("piece").alias("one")), crowded.select("task", F.col("piece").alias("two"))
        pairs = x.join(y, "task").where("one < two")
        pairs = pairs.join(crowded.select("task", F.col("piece").alias("one"), F.col("block").alias("x")), ["task", "one"])
        pairs = pairs.join(crowded.select("task", F.col("piece").alias("two"), F.col("block").alias("y")), ["task", "two"])
        met = pairs.select("tree", "x", "y").repartition(spread).mapInArrow(lambda b: _meet(b, level, above, least, threshold), RESULT)
        results = results.unionByName(persist(met, "near-meetings"))
    return results, nodes


def link_classes(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET_RECALL, width: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows is df with a unique ROW and the IDENTITY of its word sequence (null without words);
    texts has IDENTITY, node (smallest ROW with it), n (rows with it), links (other rows within the threshold)
    and root (smallest node of its class).

    Both are written tables. Rows with equal word sequences share an identity; texts without words are in
    no class. A third of all rows may be copies of one text, or one class: equal texts are collapsed by a
    partial aggregate, and the texts of a crowded trie node are dealt to blocks.
    """
    steps = levels(threshold, target)
    least = steps[-1]
    source = df.withColumn(ROW, F.monotonically_increasing_id())
    names = [f.name for f in source.schema]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            shingles, bounds, identity = shingle_sets(part.column(names.index(text_col)), width)
            sizes, paths = np.diff(bounds), tree_paths(shingles, bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, TREES, dtype=np.int32)), pa.array(paths.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(identity.view(np.int64), mask=sizes == 0), pa.array(sizes.astype(np.int64)), lists], [*names, IDENTITY, SIZE, PATHS])

    schema = T.StructType([*source.schema.fields, T.StructField(IDENTITY, T.LongType()), T.StructField(SIZE, T.LongType()), T.StructField(PATHS, T.ArrayType(T.LongType()))])
    signed = persist(source.mapInArrow(sign, schema), "near-signed")

    texts = persist(signed.where(F.col(IDENTITY).isNotNull()).groupBy(IDENTITY).agg(F.min(ROW).alias("node"), F.count(F.lit(1)).alias("n")), "near-texts")
    paths = signed.select(F.col(ROW).alias("node"), F.col(SIZE).alias("size"), PATHS).join(texts.select("node"), "node", "left_semi").select("node", "size", F.posexplode(PATHS).alias("tree", "path"))
    # Only texts that meet another at the shortest prefix of all can meet any; the sorted tables hold these.
    shortest = F.shiftrightunsigned("path", 8 * (DEPTH - least)).alias("shortest")
    shared = paths.groupBy("tree", shortest).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("tree", "shortest")
    meeting = paths.withColumn("shortest", shortest).join(shared, ["tree", "shortest"]).select("tree", "path", "node", "size")
    forest = persist(meeting.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node"), "near-forest")

    known = persist(forest.select("node").distinct().join(texts, "node").select("node", "n"), "near-known")
    # Texts are far wider than ids: up to a checked number the candidates' ids go to the texts.
    members = signed.select(F.col(ROW).alias("node"), F.col(text_col).cast("string").alias("text"), PATHS).join(small(known, BROADCAST_ROWS), "node").select("node", "n", PATHS, "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            shingles, bounds, _ = shingle_sets(part.column(3), width)
            sets = pa.array([shingles[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.large_binary())
            flat = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, TREES)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([p.tobytes() for p in flat], pa.binary()), sets], ["node", "n", "paths", "shingles"])

    sets = persist(members.mapInArrow(shingled, "node long, n long, paths binary, shingles binary"), "near-sets")

    results = satisfied = opened = None
    for above, level in zip([None, *steps], steps):
        found = _level(forest, sets, satisfied, opened, level, above, least, threshold)
        if found is not None:
            results, opened = found if results is None else (results.unionByName(found[0]), opened.unionByName(found[1]))
        if level > least and results is not None:
            lack = F.get("lack", F.lit(level - least))
            sums = results.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("k"), F.sum(lack).alias("lack"))
            satisfied = persist(sums.where(F.col("lack") <= (1 - target) * (F.col("k") + F.col("lack"))).select("node"), "near-satisfied")
    empty = "SELECT cast(null as bigint) AS node, cast(null as bigint) AS other, 0L AS links WHERE false"
    results = results.select("node", "other", "links") if results is not None else df.sparkSession.sql(empty)

    roots = components(results.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))).select("node", "root")
    links = results.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    found = texts.join(links, "node", "left").join(roots, "node", "left")
    found = found.select(IDENTITY, "node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    classes = persist(found, "near-classes")
    discard(forest, known, sets)
    return signed.drop(PATHS, SIZE), classes


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), n_links (other rows within the threshold).

    A class is a connected component of the links; copies are links too. A null text or one without
    words is alone: its own id, no links. Null ids never name a class that has another; an empty table
    gives an empty result. Other columns are ignored.
    """
    rows, texts = link_classes(df.select(id_col, text_col), text_col, threshold)
    least = rows.where(F.col(IDENTITY).isNotNull()).groupBy(IDENTITY).agg(F.min(id_col).alias("least"))
    named = texts.join(least, IDENTITY)
    names = named.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = persist(named.join(names, "root").select(IDENTITY, "class_id", "links"), "near-named")
    alone = F.col(IDENTITY).isNull()
    return rows.join(classes, IDENTITY, "left").select(id_col, F.when(alone, F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, and every row without words, with all their columns."""
    rows, texts = link_classes(df, text_col, threshold)
    others = rows.select(ROW, IDENTITY).join(texts.select(IDENTITY, "root"), IDENTITY).where(F.col(ROW) != F.col("root"))
    dropped = persist(others.select(F.col(ROW).alias("__urbis_dropped")), "near-dropped")
    return rows.join(small(dropped, BROADCAST_ROWS), F.col(ROW) == F.col("__urbis_dropped"), "left_anti").drop(ROW, IDENTITY)
