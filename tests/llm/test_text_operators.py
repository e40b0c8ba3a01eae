"""Text operators against brute force, the tokenizers library and held-out labels."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urbis.llm import bpe, language_id, quality_crf, quality_rules, toxicity, url_filter
from urbis.llm.common import slices

SF = "/root/testdata/sf0.001"
EXTRA = [(None, None), (1, ""), (1, ""), (2, " \n\t "), (3, "x"), (4, "é 日本 ß " * 40), (5, "word " * 30_000), (5, "word " * 30_000)]


def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "l", 0.5, True, "s") for i, t in EXTRA], "doc_id bigint, text string, lang string, score double, kept boolean, ids string")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_rules(text):
    w, places = words(text), collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    inside = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    longest = 0
    while True:
        runs = [tuple(w[i : i + longest + 1]) for i in range(len(w) - longest)]
        if len(set(runs)) == len(runs):
            break
        longest += 1
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), longest


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#", max_size=120), max_size=6))
def test_quality_rules_small_texts(texts):
    found = quality_rules.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert tuple(int(found[c][i]) for c in COLUMNS) == brute_rules(text)


def test_quality_rules_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.judge(docs).collect():
        expected = brute_rules(texts[r["doc_id"]])
        assert tuple(r[c] for c in COLUMNS) == expected
        n, _, _, _, repeats, longest = expected
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert r["kept"] == (not r["base_failed"] and repeats / n <= 0.3 and longest <= 50)


def test_quality_rules_odd_rows(spark):
    rows = quality_rules.judge(odd(spark)).collect()
    assert len(rows) == len(EXTRA) and {r["n_words"] for r in rows if r["doc_id"] == 5} == {30_000}
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (None, 1, 2))
    assert quality_rules.keep_good(odd(spark)).columns == odd(spark).columns and quality_rules.judge(empty(spark)).count() == 0


def test_slices_keep_texts_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 900, 0, 40)] + [None])], ["text"])
    parts = list(slices([batch], "text", 100))
    assert [len(t or "") for p in parts for t in p.column(0).to_pylist()] == [5, 900, 0, 40, 0] and len(parts) == 3


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


def test_bpe_equals_the_library():
    path, reference = tokenizer()
    coder, rnd = bpe.load(path), random.Random(5)
    vocabulary = [v.replace("</w>", "") for v in coder.vocab]
    texts = ["", None, "<|endoftext|> hi<|startoftext|>x <|endoftext", "İstanbul ΟΔΥΣΣΕΥΣ Σ", "don't I'LL we've 12 3.5", "日本語 𝔘𝔫𝔦 🙂🙂", "a" * 500, "ab" * 300, "é é Å", "\x1c a\x85b\xa0c", "ǅ ẞ ﬁ"]
    texts += [" ".join("".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 4))) for _ in range(60)) for _ in range(40)]
    ids, bounds, decoded = coder.encode_batch(texts)
    for i, text in enumerate(texts):
        expected = reference.encode(text or "", add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == expected
        assert str(decoded[i]) == reference.decode(expected, skip_special_tokens=False) == coder.decode(expected)


def test_bpe_equals_the_library_for_every_code_point():
    path, reference = tokenizer()
    coder = bpe.load(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 50_000):
        texts = [f"1{chr(c)}b{chr(c)} {chr(c)}!a{chr(c)}\u0323\u0301" for c in points[start : start + 50_000]]
        ids, bounds, _ = coder.encode_batch(texts)
        expected = reference.encode_batch(texts, add_special_tokens=False)
        assert [c for k, c in enumerate(points[start : start + 50_000]) if ids[bounds[k] : bounds[k + 1]].tolist() != expected[k].ids] == []


def test_bpe_compatibility_is_exact():
    path, _ = tokenizer()
    coder, rnd = bpe.load(path), random.Random(6)
    tokens = [i for name, i in coder.vocab.items() if not name.endswith("</w>")]
    ends = [i for name, i in coder.vocab.items() if name.endswith("</w>")]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens if rnd.random() < 0.5 else ends)) for _ in range(3000)]
    ok = coder.compatible(np.array([(a << 24) | b for a, b in pairs]))
    for (a, b), got in zip(pairs, ok, strict=True):
        symbols = [s for t in (a, b) for s in coder._symbols(coder.names[t])]
        assert got == (coder.merge(symbols) == [a, b])


def test_bpe_odd_rows(spark):
    path, reference = tokenizer()
    rows = bpe.digests(bpe.encode(odd(spark), path)).collect()
    assert collections.Counter(r["n_tokens"] for r in rows) == collections.Counter(len(reference.encode(t or "", add_special_tokens=False).ids) for _, t in EXTRA)
    assert bpe.encode(empty(spark), path).count() == 0


def padded(text):
    """A text's characters as the model sees them: three spaces before, runs of non-letters one space."""
    w = re.findall(r"[a-z]+", text.lower())
    return "   " + "".join(f"{x} " for x in w) if w else ""


class BruteKneserNey:
    """Interpolated Kneser-Ney of order 4 in plain dictionaries, straight from its definition."""

    def __init__(self, texts):
        count = [collections.Counter() for _ in range(5)]
        for t in map(padded, texts):
            count[4].update(t[k - 3 : k + 1] for k in range(3, len(t)))
        for order in (3, 2, 1):
            count[order].update(g[1:] for g in count[order + 1])
        self.count, self.discounts = count, {}
        for order in (1, 2, 3, 4):
            ones, twos = (sum(n == k for n in count[order].values()) for k in (1, 2))
            self.discounts[order] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def prob(self, gram):
        order = len(gram)
        if not order:
            return 1 / (len(self.count[1]) + 1)
        after = {g: n for g, n in self.count[order].items() if g[:-1] == gram[:-1]}
        lower = self.prob(gram[1:])
        if not after:
            return lower
        total = sum(after.values())
        return max(self.count[order][gram] - self.discounts[order], 0) / total * (gram in after) + self.discounts[order] * len(after) / total * lower


@pytest.mark.parametrize("shard_grams", [1_000_000, 150])
def test_language_equals_brute_force(spark, monkeypatch, shard_grams):
    monkeypatch.setattr(language_id, "SHARD_GRAMS", shard_grams)
    rnd = random.Random(8)
    letters = {"aa": "abcdeabcd e", "bb": "abcxyzxyz y", "cc": "efghij efgh"}
    train = [(k, "".join(rnd.choice(letters[g]) for _ in range(rnd.randint(1, 60))), g) for k, g in enumerate(sorted(letters) * 12)]
    model = language_id.train(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    assert (model.shards > 1) == (shard_grams == 150)
    brute = {g: BruteKneserNey([t for _, t, h in train if h == g]) for g in letters}
    texts = [t for _, t, _ in train[:9]] + ["zebra, fig", "a", "jjj 12 ??", "", None, "12"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in language_id.identify(rows, model).collect()}
    for k, text in enumerate(texts):
        t = padded(text or "")
        if not t:
            assert (got[k]["lang_pred"], got[k]["score"], got[k]["cross_entropy"]) == ("und", 0.0, None)
            continue
        bits = {g: -sum(np.log2(m.prob(t[i - 3 : i + 1])) for i in range(3, len(t))) / (len(t) - 3) for g, m in brute.items()}
        assert got[k]["cross_entropy"] == pytest.approx(min(bits.values()), abs=1e-6)
        assert bits[got[k]["lang_pred"]] == pytest.approx(min(bits.values()), abs=1e-6)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in test]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_calibration_counts_all_rows(spark):
    """Limits and scale from every training text: 20 odd ones of 3000 move the limit, wherever their ids fall."""
    rnd = random.Random(5)
    letters = {"aa": "abcdeabcd e", "bb": "abcxyzxyz y"}
    train = [(k, "".join(rnd.choice(letters[g]) for _ in range(rnd.randint(2, 8))), g) for k, g in enumerate(sorted(letters) * 1500)]
    train = [(k, t + " q" * (k % 40) if k % 150 == 0 else t, g) for k, t, g in train]
    model = language_id.train(spark.createDataFrame(train, "doc_id bigint, text string, lang string").repartition(3))
    shard = model.shard(0)
    sums, n, letters = shard.sums([t for _, t, _ in train])
    some = letters > 0
    h, truth = (-sums / language_id.UNIT / np.maximum(n, 1)[:, None])[some], np.array([model.langs.index(g) for _, _, g in train])[some]
    for k in range(2):
        own = h[(truth == k) & (h.argmin(axis=1) == k), k]
        assert len(own) > 800
        assert model.limits[k] == pytest.approx(np.quantile(own, 0.995) + 3 * own.std(), abs=2e-3)
    z = [-s * (h - h.min(axis=1, keepdims=True)) for s in language_id.SCALES]
    assert model.scale == language_id.SCALES[np.argmin([np.mean(np.log2(np.exp2(x).sum(axis=1)) - x[np.arange(len(x)), truth]) for x in z])]


def test_language_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    rows = language_id.identify(odd(spark), model).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (None, 1, 2)} == {"und"} and len(rows) == len(EXTRA)
    bare = language_id.train(empty(spark))
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), bare).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    score, pull, begins = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 3, 4, 7])
    marginal, pairs, log_z = quality_crf.forward_backward(score, pull, begins)
    exact, exact_pairs, exact_z = np.zeros(7), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(begins):
        total, m, p = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(score[a + i] for i in range(b - a) if y[i]) + sum(pull[y[i], y[i + 1]] for i in range(b - a - 1)))
            total, m = total + w, m + w * np.array(y)
            for i in range(b - a - 1):
                p[y[i], y[i + 1]] += w
        exact[a:b], exact_pairs, exact_z = m / total, exact_pairs + p / total, exact_z + np.log(total)
    assert np.allclose(marginal, exact) and np.allclose(pairs, exact_pairs) and log_z == pytest.approx(exact_z)


def numeric(f, w):
    """Central differences of f at w."""
    out = np.zeros(len(w))
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-5
        out[k] = (f(w + step) - f(w - step)) / 2e-5
    return out


def test_quality_gradient_is_numeric():
    rng = np.random.default_rng(3)
    begins, label = np.array([0, 3, 4, 9]), np.array([1, 0, 1])
    features, w = rng.normal(size=(9, 5)), rng.normal(size=9) * 0.5
    _, g = quality_crf.objective(w, features, begins, label, 1e-2)
    assert np.allclose(g, numeric(lambda u: quality_crf.objective(u, features, begins, label, 1e-2)[0], w), atol=1e-6)


def test_line_labels_may_change_within_a_document():
    """Good documents with a bad tail: the lines of the tail are found bad, and quality is the length-weighted share."""
    good, bad = "this is a plain line of text that ends well.", "$$$ ||| !!! *** 999"
    texts = [good + "\n" + "\n".join([good] * 5 + [bad] * (k % 2) * 4) for k in range(40)] + ["\n".join([bad] * 7)] * 30
    x, size, begins = quality_crf.line_features(pa.array(texts))
    model = quality_crf.fit(x, size, begins, np.array([1] * 40 + [0] * 30))
    column = pa.array([good + "\n" + "\n".join([good] * 5 + [bad] * 4)])
    lines = quality_crf.line_features(column)
    marginal = model.marginals(lines[0], lines[2])
    assert (marginal[:5] > 0.5).all() and (marginal[-2:] < 0.5).all()
    weight = lines[1] + 1.0
    assert model.quality(*lines)[0] == pytest.approx((marginal * weight).sum() / weight.sum())
    q = model.quality(*lines)[0]
    assert model.score(column)[0] == pytest.approx(1 / (1 + np.exp(-(model.curve[0] * np.log(q / (1 - q)) + model.curve[1]))))


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in quality_crf.query(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    model = quality_crf.train(docs, labels)
    got = quality_crf.score(odd(spark), model).collect()
    assert len(got) == len(EXTRA) and all(0 <= r["score"] <= 1 for r in got) and quality_crf.score(empty(spark), model).count() == 0
    none = quality_crf.train(empty(spark), labels)
    assert quality_crf.score(odd(spark), none).count() == len(EXTRA)


def test_ordinal_gradient_is_numeric():
    rng = np.random.default_rng(5)
    row, feature = rng.integers(0, 30, 80), rng.integers(0, 6, 80)
    value, grade, w = rng.random(80) + 0.1, rng.integers(0, 4, 30), rng.normal(size=6 + 3) * 0.4
    _, g = toxicity.objective(w, row, feature, value, grade, 1e-2)
    assert np.allclose(g, numeric(lambda u: toxicity.objective(u, row, feature, value, grade, 1e-2)[0], w), atol=1e-6)


def test_ordinal_grades_share_weights(spark):
    """Four grades by how often a marker stands in the text: thresholds are ordered, severity is the sum of P(grade >= k)."""
    rnd, rows = random.Random(2), []
    for k in range(800):
        words_ = [rnd.choice(("plain", "green", "house", "river", "stone")) for _ in range(12)]
        markers = rnd.randint(0, 9)
        rows.append((k, " ".join(words_ + ["vilest"] * markers), min(3, markers // 3)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = toxicity.train(df, "text", "grade")
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert np.mean([got[k]["grade"] == g for k, _, g in rows]) > 0.9
    for k, text, _ in rows[:50]:
        h, at = toxicity.features(pa.array([text]))[1], {int(x): i for i, x in enumerate(model.hashes)}
        eta = sum(model.weights[at[x]] * np.log1p(n) for x, n in collections.Counter(h.tolist()).items() if x in at)
        assert got[k]["severity"] == pytest.approx(sum(1 / (1 + np.exp(t - eta)) for t in model.thresholds))


def test_ordinal_held_out_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.labelled(docs, labels, "toxic", 5_000), "text", "label")
    assert len(model.thresholds) == 1  # the labels hold two grades
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels, "doc_id").collect()
    clean = [r["found"] for r in rows if r["toxic"] == 0]
    caught = [r["found"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) < 0.02 and np.mean(caught) > 0.6 and all(r["severity"] >= r["p_toxic"] for r in rows)
    got = toxicity.score(odd(spark), model).collect()
    assert len(got) == len(EXTRA) and not any(r["toxic"] for r in got if r["doc_id"] in (None, 1, 2))
    assert toxicity.keep_clean(odd(spark), model).columns == odd(spark).columns and toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.train(toxicity.labelled(empty(spark), labels, "toxic", 10), "text", "label")
    assert not any(r["toxic"] for r in toxicity.score(odd(spark), nothing).collect())


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, verdict in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (h.count("."), len(p)) > (best[0].count("."), len(best[1])):
                best = (h, p, verdict)
    return host, path, None if best is None else best[0] + best[1], "allow" if best is None else best[2]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "/fr/x", "block"), ("b.org", "/f", "block")]


def test_url_rules(spark):
    urls = [None, "", "no", "http://A.NET", "http://a.net/", "http://Example.Net/en/x?q#f", "x://example.com/de/1", "x://notexample.com/de/1", "http://example.com/den/", "http://a.b.org/fr/xyz", "http://b.org/fr/", "http://b.org/fa/", "http://net:80/", "http://c.org?x/fr/", "a://b://c.net/x", "http://ÄÖ.net/", "http://.net/"]
    df = spark.createDataFrame([(i, u, "v", "r") for i, u in enumerate(urls)] + [(None, "http://a.net/x", "v", "r")], "page_id bigint, url string, verdict string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, RULES).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)} | {None: brute_url("http://a.net/x")}
    assert url_filter.judge_urls(df.where(F.lit(False)), RULES).count() == 0


def test_letters_decide_about_und():
    _, _, letters = language_id.characters(["🙂 12 ", "𝔘", "ªb", "퟿", "漢字 x"])
    assert letters.tolist() == [0, 1, 2, 0, 3]
