"""Operators decide the cases that narrower rules, seeds or tables would lose."""

from pyspark.sql import functions as F

from urbis.llm import decontamination, language_id, quality_rules
from urbis.llm.queries import QUERIES


def test_runs_of_one_word_fail(spark, tmp_path):
    clean = " ".join(f"word{i}" for i in range(60))
    run = " ".join(w for k in range(9) for w in [f"w{k}"] * 7)  # no repeat of 8 words: the base rule passes it
    docs = spark.createDataFrame([(1, clean), (2, run), (3, f"{clean} {' '.join(['the'] * 7)}")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, str(tmp_path)).collect()}
    assert not any(r["base_failed"] for r in rows.values()) and rows[2]["n_repeat_words"] == 0
    assert {i: r["kept"] for i, r in rows.items()} == {1: True, 2: False, 3: True}
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {1, 3}


def accepted(score=0, equal=0, pattern=""):
    """All patterns up to the tenth equal token of a stretch that best_stretch accepts (1: equal, 0: substituted)."""
    if equal == 10:
        yield pattern
        return
    yield from accepted(score + 1, equal + 1, pattern + "1")
    if score > decontamination.MISMATCH:
        yield from accepted(score - decontamination.MISMATCH, equal, pattern + "0")


def test_every_accepted_pattern_has_a_seed(spark):
    whole = [p for n in (10, 12, 14, 15) for p in ("1" * n, "11111001111111"[:n])]
    periodic = [(p * 60)[:60] for p in ("1110", "1101110", "1111100", "11111100", "110")]
    patterns = sorted({*accepted(), *whole, *periodic, "111110011111"})
    items = [(k, " ".join(f"t{k}x{j}" for j in range(len(p)))) for k, p in enumerate(patterns)]
    docs = [(k, " ".join(["before"] + [f"t{k}x{j}" if c == "1" else f"s{k}x{j}" for j, c in enumerate(p)] + ["after"])) for k, p in enumerate(patterns)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.query(documents, benchmark).collect()}

    def best(p):
        score = equal = top = found = 0
        for c in p:
            if c == "1":
                score, equal = score + 1, equal + 1
                if score >= top:
                    top, found = score, equal
            else:
                score, equal = (score - 2, equal) if score > 2 else (0, 0)
        return found

    expected = {(k, k) for k, p in enumerate(patterns) if best(p) >= 10}
    assert len([p for p in patterns if len(p) == 60 and best(p) >= 10]) >= 4 and len(expected) > 30
    assert got == expected, sorted(patterns[k] for k, _ in expected - got)


def test_language_model_keeps_every_count(spark, monkeypatch):
    """More 4-grams than a shard holds, nearly all of them a large language's: every one is in just one shard."""
    rows, letters = 60_000, "abcdefghijklmnopqrstuvwxyz"
    big = spark.range(rows).select(F.lit("big").alias("lang"), (F.col("id") * 65_537).alias("ngram"), F.lit(1).cast("long").alias("n"))
    texts = ["".join(letters[(7 * i + j * j) % 26] for j in range(12)) for i in range(8)]
    rare = spark.createDataFrame([(t, "rare") for t in texts], "text string, lang string")
    counts = language_id.count_ngrams(rare, "text", "lang")
    want = {r["ngram"]: r["n"] for r in counts.collect()}
    monkeypatch.setattr(language_id, "SHARD_GRAMS", 20_000)
    monkeypatch.setattr(language_id, "count_ngrams", lambda *_: counts.unionByName(big))
    monkeypatch.setattr(language_id.Model, "calibrate", lambda *_: None)
    model = language_id.train(rare.withColumn("doc_id", F.lit(1)))
    assert model.shards == 4 and model.langs == ["big", "rare"]
    seen = []
    for k in range(model.shards):
        table = model.shard(k).table.keys
        assert len(table) < 40_000
        seen.extend(table.tolist())
    assert len(seen) == len(set(seen)) and set(seen) == {i * 65_537 for i in range(rows)} | set(want)
