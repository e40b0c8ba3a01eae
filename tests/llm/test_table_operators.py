"""WARC, near-duplicates, decontamination, sharding and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from urbis.llm import decontamination, near_duplicates, sharding, toxicity, warc
from urbis.llm.common import shared_dir
from urbis.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "z" * 1500


def pages(spark):
    rows = [(1, "http://a", "x" * 999), (2, "http://b", "x" * 999), (3, "u r l", LONG), (4, None, LONG), (None, "http://c", LONG), (5, "http://d", None), (6, "http://e", ""), (7, "http://f", "é" * 600), (7, "http://f", "é" * 600), (9, "http://g", "q" * 700_000)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, record_type string")


def test_warc_round_trip(spark):
    got = warc.query(pages(spark)).collect()
    rows = [(r["page_id"], r["html"] or "") for r in pages(spark).collect()]
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == collections.Counter((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, h in rows)
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[3, "revisit", 4] == kinds[None, "revisit", 4] == kinds[4, "response", None] == 1
    assert kinds[7, "response", None] == kinds[7, "revisit", 7] == 1 and kinds[1, "response", None] == kinds[2, "response", None] == 1
    assert warc.query(pages(spark).where("false")).count() == 0


def test_warc_seeks_single_records(spark):
    index = warc.write(pages(spark), shared_dir(spark, "warc-test"))
    assert index.count() == 10 and index.select("frame").distinct().count() > 1
    (record,) = warc.lookup(index, [9])
    assert record.payload == b"q" * 700_000 and record.headers["WARC-Target-URI"] == "http://g"
    assert {r["payload"] for r in warc.read(spark, index, payloads=True).where("record_id = '4'").collect()} == {LONG.encode()}
    import io

    import zstandard

    bundle = index.first()["bundle"].removeprefix("file://")
    with open(bundle, "rb") as f:  # a plain decompressor skips the seek table
        content = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert content.startswith(b"WARC/1.1\r\n")


def test_warc_ids_of_any_type(spark, monkeypatch):
    rows = [("a/b", "u", LONG), ("ü %", "v", LONG), ("", None, "x"), (None, None, "y"), ("z", "w", "q" * 3_000_000)]
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.query(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {"a/b": ("revisit", "ü %"), "ü %": ("response", None), "": ("response", None), None: ("response", None), "z": ("response", None)}


def test_warc_is_read_by_many_tasks(spark, monkeypatch):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = spark.range(400, numPartitions=partitions).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 200).alias("html"))
    index = warc.write(some, shared_dir(spark, "warc-tasks"))
    assert index.select("bundle").distinct().count() == partitions
    tasks = warc.read(spark, index).select(F.spark_partition_id().alias("task"), "record_id")
    assert tasks.select("task").distinct().count() == partitions and tasks.select("record_id").distinct().count() == 400
    monkeypatch.setattr(warc, "TASK_BYTES", 256 << 10)  # several tasks a bundle
    assert warc.read(spark, index).select(F.spark_partition_id().alias("task")).distinct().count() > partitions


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows, threshold=0.8):
    sets, links, parent = [shingles(t) for _, t in rows], collections.Counter(), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return links, [top(i) for i in range(len(rows))]


def corpus(seed, copies):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    rows = []
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows), rnd.choice((" ", "  ")).join(w)))
    return rows


@pytest.mark.parametrize(("block", "broadcast"), [(1024, 1_000_000), (8, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "BROADCAST_ROWS", broadcast)
    rows = corpus(1, 25)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, class_id string, node int").repartition(5)
    links, tops = brute_classes(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.join(df).collect()}
    assert got == {i: (rows[tops[i]][0], links[i]) for i in range(len(rows))}
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(tops))


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.8, 0.9, 1.0])
def test_near_duplicates_at_other_thresholds(spark, threshold):
    rows = corpus(7, 12)
    links, tops = brute_classes(rows, threshold)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.join(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=threshold).collect()}
    assert got == {i: (rows[tops[i]][0], links[i]) for i in range(len(rows))}


def test_near_duplicates_recall_at_the_threshold(spark):
    """600 pairs of similarity exactly 0.8 (36 of 45 shingles): all links, or nearly all, are found."""
    rnd, rows = random.Random(4), []
    for k in range(600):
        base = [f"w{k}x{j}" for j in range(40)]  # 36 shingles, extended by 9 more on one side
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"v{k}x{rnd.random()}x{j}" for j in range(9)]))]
    got = near_duplicates.join(spark.createDataFrame(rows, "doc_id bigint, text string")).where("n_links = 1 AND class_id = doc_id - doc_id % 2").count()
    assert got >= 0.995 * 1200


def test_texts_with_enough_links_open_no_more_nodes(spark, monkeypatch):
    """Texts whose links are all very similar stop at the deepest level; a text without links goes on to the last."""
    seen, level = [], near_duplicates._level

    def noted(forest, sets, satisfied, *rest):
        seen.append({r["node"] for r in satisfied.collect()} if satisfied is not None else set())
        return level(forest, sets, satisfied, *rest)

    monkeypatch.setattr(near_duplicates, "_level", noted)
    base = [f"w{j}" for j in range(400)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(6)] + [(6, " ".join(base[:330] + [f"z{j}" for j in range(70)]))]
    found = near_duplicates.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["n_links"] for r in found) == [0, 5, 5, 5, 5, 5, 5]
    assert len(seen) == len(near_duplicates.levels()) and [len(s) for s in seen] == [0, 6]


def test_near_duplicates_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "a b"), (2, "a b"), (3, "a  b"), (None, "a b"), (4, "c"), (5, "long " * 20_000), (6, "long " * 20_001), (7, " \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates.join(df).collect())
    assert got == collections.Counter([(None, None, 0), (1, 1, 0), (1, 1, 0), (2, 2, 3), (2, 2, 3), (3, 2, 3), (None, 2, 3), (4, 4, 0), (5, 5, 1), (6, 5, 1), (7, 7, 0)])
    assert near_duplicates.keep_one(df).count() == 7
    assert near_duplicates.join(df.where("false")).count() == 0


def test_forest_depth_reaches_the_recall():
    depth = near_duplicates.last_level()
    assert near_duplicates.chance(0.8, depth) >= near_duplicates.TARGET_RECALL > near_duplicates.chance(0.8, depth + 1)
    assert near_duplicates.last_level(0.8, 0.99) > depth > near_duplicates.last_level(0.5)


def test_intersections_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(70)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    whole = near_duplicates.intersections(sets, 0)
    off = ~np.eye(70, dtype=bool)
    assert (whole[off] == exact[off]).all() and (near_duplicates.intersections(sets, 30) == exact[:30, 30:]).all()


def tokens(text):
    return re.findall(r"[\u4e00-\u9fff]|[^\W_\u4e00-\u9fff]+", (text or "").lower())


def brute_overlap(h, item):
    best = 0
    for diagonal in range(1 - len(item), len(h)):
        score = equal = top = found = 0
        for j, w in enumerate(item):
            if 0 <= diagonal + j < len(h) and h[diagonal + j] == w:
                score, equal = score + 1, equal + 1
                if score >= top:
                    top, found = score, equal
            else:
                equal = equal if score > 2 else 0
                score = max(score - 2, 0)
        best = max(best, found)
    return best


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rnd.choice(vocabulary) for _ in range(n)] for n in (15, 30, 59, 6, 5, 4, 20)]
    rows = []
    for k, item in enumerate(items):
        for subs in (0, 1, 2, 3):
            w = list(item)
            for at in rnd.sample(range(len(w)), min(subs, len(w) - 1)):
                w[at] = "other"
            pad = [rnd.choice(vocabulary) for _ in range(60)]
            rows.append((len(rows), " ".join(pad[:20]) + ", " + " ".join(w).upper() + "! " + " ".join(pad[20:])))
        rows.append((len(rows), " ".join(item[: len(item) // 2])))
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "clean " * 30_000)]
    rows += [(903, " ".join(items[5])), (904, "她说：" + "今天天气很好我们去公园散步吧" + "，然后走了"), (905, "今天天气很糟")]
    items.append(list("今天天气很好我们去公园散步吧"))
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, item_id string, h int, contaminated int")
    bench = spark.createDataFrame([(k, ("" if len(w[0]) == 1 else " ").join(w)) for k, w in enumerate(items)] + [(90, None), (91, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontamination.query(docs, bench).collect()}
    expected = {(i, k): m for i, t in rows for k, item in enumerate(items) if (len(item) >= 5 or tokens(t) == item) and (m := brute_overlap(tokens(t), tokens(" ".join(item)))) >= min(len(item), 10)}
    assert set(got) <= set(expected) and all(expected[key] == m for key, m in got.items())
    missed = set(expected) - set(got)
    assert not missed, missed
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({i for i, _ in expected})
    assert decontamination.query(docs, bench.where("false")).count() == 0 and decontamination.query(docs.where("false"), bench).count() == 0


def test_repetitive_text_has_few_hits_and_all_diagonals(spark):
    """Runs of periods 1, 2 and 3 in documents and items: the same best overlaps as brute force, from few hits."""
    runs = ["ha " * 300, "x y " + "ha " * 40 + "z " * 9, "do re " * 60, "do re mi " * 30 + "fa so", "q r s t u " + "do re " * 20]
    rows = [(k, t) for k, t in enumerate([*runs, runs[1] + runs[3], "ha do " * 30 + runs[4]])]
    bench = [(k, t) for k, t in enumerate(["ha " * 20, "x y " + "ha " * 12, "do re " * 12, "mi do re " * 5 + "fa", "t u do re do re do re do re", "ha z ha z ha z ha z ha z"])]
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontamination.query(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    expected = {(i, k): m for i, t in rows for k, item in bench if (m := brute_overlap(tokens(t), tokens(item))) >= min(len(tokens(item)), 10)}
    assert got == expected and len(expected) > 10
    long = spark.range(1).select(decontamination.tokens(F.lit("same " * 20_000)).alias("h")).select(decontamination.windows(F.col("h"), [*decontamination.MASKS]).alias("ws"))
    edges = long.select(F.explode(decontamination.periodic(F.col("ws"), len(decontamination.MASKS))).alias("e")).where("e.period = 0").count()
    assert edges == len(decontamination.MASKS)  # only the first window of each mask meets all of an item's


def test_sharding_keeps_every_row(spark):
    tiers = sharding.Tiers(target_bytes=60_000, fan_in=2, least_bytes=2_000)
    kind = "doc_id bigint, text string, m map<string,int>, shard string, run string, _shard string, path string, n_rows int"
    df = spark.createDataFrame([(i % 50 if i % 9 else None, f"{i} " * (i % 200), {"a": i}, "s", "r", f"own{i % 7}", "p", 1) for i in range(900)], kind).repartition(6)
    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    store = sharding.shard(df, shared_dir(spark, "shard-test"), tiers, arrivals=3)
    assert settings == {k: spark.conf.get(k, None) for k in settings}
    back = store.read(df.schema)
    rows = lambda d: collections.Counter((r["doc_id"], r["text"], r["m"]["a"], r["shard"], r["_shard"]) for r in d.collect())
    assert rows(back) == rows(df) and back.columns == [*df.columns, "_shard_"]
    first, last = store.manifest(3), store.manifest()
    assert first.select("run").distinct().count() == 3 and last.count() < first.count() and store.version() > 3
    sizes = {r["path"]: r["length"] for r in spark.read.format("binaryFile").load(f"{store.root}/data/*/*.parquet").select("path", "length").collect()}
    assert {r["path"]: r["n_bytes"] for r in last.collect()} == sizes  # the live files, all of them, and no others
    with pytest.raises(Exception):
        store._commit(last, store.version() - 1)  # that version is there already
    nothing = sharding.shard(df.where("false"), shared_dir(spark, "shard-empty"), tiers)
    assert nothing.read(df.schema).count() == 0


def test_sharding_merges_due_tiers_only(spark):
    tiers = sharding.Tiers(target_bytes=1 << 20, fan_in=3, least_bytes=2_000)
    store = sharding.ShardStore(spark, shared_dir(spark, "shard-tiers"), tiers)
    part = spark.range(100, numPartitions=4).withColumn("text", F.lit("x"))
    for _ in range(2):
        store.append(part)
    assert store.compact(part.schema) == 2 and store.manifest().count() == 8  # eight files, but of two runs only
    part.write.parquet(f"{store.root}/data/underway")  # another writer's append, not committed yet
    store.append(part)
    assert store.compact(part.schema, keep_merged=False) == 4 and store.manifest().count() == 1
    assert spark.read.parquet(f"{store.root}/data/underway").count() == 100 and store.read(part.schema).count() == 300


def test_sharding_reads_its_input_once(spark):
    reads = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda i: reads.add(1) or i, "bigint").asNondeterministic()
    df = spark.range(200, numPartitions=8).select(counted("id").alias("id"), F.rand().alias("r"))
    store = sharding.shard(df, shared_dir(spark, "shard-once"), sharding.Tiers(fan_in=2))
    assert reads.value == 200 and sorted(r["id"] for r in store.read(df.schema).collect()) == list(range(200))


def test_every_operator_is_registered():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES}
    assert numbers == set(range(1, 11)) and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard", "decontamination", "bpe"]


def brute_kept(text):
    """The repetition rules by counting: the base rule's windows of 8 words, covered words by windows of 4, the longest repeat."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def covered(width):
        places = collections.defaultdict(list)
        for i in range(len(w) - width + 1):
            places[tuple(w[i : i + width])].append(i)
        return len({j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + width)})

    return len(w) >= 20 and 100 * covered(8) <= 30 * len(w) and covered(4) <= 0.3 * len(w) and not covered(51)


def brute_toxic(text, model):
    """P(grade 1) from the fitted weights, feature by feature."""
    found = collections.Counter(toxicity.features(pa.array([text or ""]))[1].tolist())
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    eta = sum(weight[h] * np.log1p(n) for h, n in found.items() if h in weight) if found else -30
    return 1 / (1 + np.exp(model.thresholds[0] - eta))


def test_pipeline_equals_brute_force(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    model = toxicity.train(toxicity.labelled(tables["documents"], tables["labels"], "toxic", toxicity.TRAINING_ROWS), "text", "label")
    rows = [(r["doc_id"], r["text"]) for r in tables["documents"].collect()]
    rows = [r for r in rows if brute_toxic(r[1], model) < 0.4]
    rows = [r for r in rows if brute_kept(r[1])]
    _, tops = brute_classes(rows)
    items = [tokens(r["text"]) for r in tables["benchmark"].collect()]

    def leaks(text):
        h = tokens(text)
        return any(sum(t in known for t in h) >= min(len(item), 10) and brute_overlap(h, item) >= min(len(item), 10) for item in items if len(item) >= 5 for known in [set(item)])

    classes = collections.defaultdict(list)
    for (i, t), top in zip(rows, tops, strict=True):
        classes[top].append((i, t))
    reference = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    reference.no_truncation()
    texts = dict(rows)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    for members in classes.values():
        held = [i for i, _ in members if i in got]
        assert len(held) == 1 or (not held and any(leaks(t) for _, t in members)), members[0]
    assert set(got) <= set(texts) and not any(leaks(texts[i]) for i in got) and len(got) > 50
    for i, r in got.items():
        ids = reference.encode(texts[i] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_stages_keep_columns_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, "same words " * 3, None, None, None), (7, "same words " * 3, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs.limit(40).unionByName(odd), docs.where("false")):
            kept = stage(spark, rows, SF)
            assert kept.columns == docs.columns and kept.exceptAll(rows).isEmpty(), name
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
