"""Operators over documents against brute force and held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragspark.llm import jaccard, lm, perplexity, rules, toxicity


def words(text, fold=True):
    raw = (text or "").encode()
    return (raw.lower() if fold else raw).split()


def groups_by_brute_force(texts):
    sets, holders = {}, {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, own in sets.items():
        for e, n in Counter(e for s in own for e in holders[s] if e < d).items():
            if 100 * n >= 80 * (len(own) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize("frame", ["docs", "odd", "near"])
def test_jaccard_groups(request, spark, frame, monkeypatch):
    if frame == "near":
        monkeypatch.setattr(jaccard, "HOT_IN_BATCH", 4)
        monkeypatch.setattr(jaccard, "SMALL", 3)
        monkeypatch.setattr(jaccard, "TILE", 8)
        rng = np.random.default_rng(5)
        base = [f"v{i}" for i in range(300)]
        rows = []
        for d in range(60):
            own = [f"x{d}{i}" if rng.random() < 0.03 * (d % 3) else w for i, w in enumerate(base)][: 300 - d % 40]
            rows.append((d, " ".join(own)))
        rows = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        rows = request.getfixturevalue(frame)
    got = jaccard.jaccard_groups(rows).collect()
    texts = {r.doc_id: r.text for r in rows.collect() if r.doc_id is not None}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups_by_brute_force(texts)


def test_jaccard_of_nothing(none):
    assert jaccard.jaccard_groups(none).isEmpty()


def test_blocks_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9, 40, 333, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = jaccard.differing(n)
        for less in {0, cut // 2, cut}:
            b = a[less:]
            if not len(b) or 5 * len(b) < 4 * len(a):
                continue
            shared = {k for own in jaccard.block_keys(a) for k in own.tolist()} & {k for own in jaccard.block_keys(b) for k in own.tolist()}
            assert len(shared) > min(jaccard.slack(len(a)), jaccard.slack(len(b)))


def test_both_ends_drop_fewer_keys_than_they_share():
    rng = np.random.default_rng(3)
    for n in range(1, 700):
        b = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        a = np.unique(np.append(b, rng.integers(0, 1 << 63, jaccard.differing(n), dtype=np.uint64)))
        shared = {k for own in jaccard.block_keys(a) for k in own.tolist()} & {k for own in jaccard.block_keys(b) for k in own.tolist()}
        assert len(shared) > max(jaccard.slack(len(a)), jaccard.slack(len(b)))


def test_jaccard_of_pairs_of_different_sizes(spark):
    sizes = [(n, more) for n in range(13, 37) for more in range(1, jaccard.differing(n) + 1)] + 200 * [(15, 3)]
    rows = []
    for k, (n, more) in enumerate(sizes):
        own = [f"p{k}.{i}" for i in range(n + 4 + more)]
        rows += [(2 * k, " ".join(own[: n + 4])), (2 * k + 1, " ".join(own))]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups_by_brute_force(dict(rows))


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(2)

    def best(seq, lo, hi):
        top = max(((sum(seq[i : j + 1]), i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
        if top[0] <= 0:
            return []
        s, i, j = top
        return best(seq, lo, i) + [(i, j, round(s, 6))] + best(seq, j + 1, hi)

    for _ in range(60):
        at = sorted(rng.choice(24, rng.integers(1, 10), replace=False).tolist())
        score, drift = rng.uniform(0.5, 4, len(at)).tolist(), float(rng.uniform(0.2, 1.5))
        seq = [-drift] * 24
        for p, s in zip(at, score):
            seq[p] = s
        assert [(i, j, round(s, 6)) for i, j, s in toxicity.segments(at, score, drift)] == best(seq, 0, 24)


def test_toxicity_on_held_out_labels(spark, docs, labels):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(big, marks, toxicity.training_rows())
    n, held = toxicity.HELD_OUT
    out = toxicity.toxicity(big, model).join(marks, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == held).toPandas()
    bad, fine = out[out.toxic == 1].score, out[out.toxic == 0].score
    assert (bad >= toxicity.CUT).mean() > 0.85 and (fine < toxicity.CUT).mean() > 0.99


def test_toxicity_of_odd_rows(odd, none, labels, docs):
    model = toxicity.train(docs, labels)
    assert toxicity.toxicity(odd, model).where("score between 0 and 1").count() == odd.count()
    empty = toxicity.train(none, labels)
    assert toxicity.toxicity(odd, empty).where("score < 0.3").count() == odd.count()
    assert toxicity.accepted(odd, empty).columns == odd.columns and toxicity.toxicity(none, model).isEmpty()


def test_kneser_ney_sums_to_one(docs, labels):
    probabilities, weights = perplexity.train(docs, labels.where("quality = 1").select("doc_id"))
    model = perplexity.Model(probabilities, weights)
    assert math.isclose(probabilities[0].agg(F.sum("p")).first()[0] + (256 - probabilities[0].count()) * weights[0].first().p / 256, 1, rel_tol=1e-9)
    # the end and every byte after the opening "th"
    gram = (perplexity.START << 24 | perplexity.START << 16 | ord("t") << 8 | ord("h"))
    total = 0.0
    for byte in range(256):
        g, log = np.array([gram << 8 | byte], np.uint64), 0.0
        for n in range(perplexity.ORDER, 0, -1):
            own = g & np.uint64((1 << 8 * n) - 1)
            row = model.table.find(perplexity.T.mix(own | np.uint64(n << 56)))[0]
            if row >= 0:
                log += model.values[row]
                break
            log += model.values[model.table.find(perplexity.T.mix((own >> np.uint64(8)) | np.uint64(n << 56) | perplexity._CONTEXT))[0]]
        else:
            log -= 8
        total += 2.0 ** float(log)
    assert math.isclose(total, 1, rel_tol=1e-3)


def test_quality_keeps_clean_text_and_drops_noise(spark):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = perplexity.quality(big, perplexity.classifier(big, marks)).join(big, "doc_id").join(marks, "doc_id").where("toxic = 0").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98
    noise = out[(out.quality == 0) & out.text.map(lambda t: t.upper() == t or sum(map(t.count, "*#$%&|")) > 0.3 * len(t.split()))]
    assert len(noise) > 100 and noise.kept.mean() < 0.02


def test_thresholds_use_every_unseen_trusted_document(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 400)
    rng = np.random.default_rng(6)
    texts = {lang: ["".join(rng.choice(list(letters), 6)) for _ in range(200)] for lang, letters in (("aa", "abcdefgh"), ("zz", "stuvwxyz"))}
    rows = [(d, " ".join(rng.choice(texts[lang], 40)), lang) for d in range(4_000) for lang in ("zz" if d % 20 == 0 else "aa",)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = perplexity.classifier(frame, frame.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert {("aa", 8), ("aa", None), ("zz", 8), ("zz", None)} <= set(own.limits)


def test_language_comes_before_the_band_of_all():
    limits = perplexity._Limits({("zz", None): (5.0, 6.0), (None, 8): (1.0, 2.0), (None, None): (0.0, 9.0)})
    kept = perplexity.Classifier.kept(limits, np.array([5.5, 1.5, 1.5]), np.array([300, 300, 300]), ["zz", "zz", "aa"])
    assert kept.tolist() == [True, False, True]


def test_quality_of_odd_rows(odd, none, labels, docs):
    own = perplexity.classifier(docs, labels)
    out = perplexity.quality(odd, own)
    assert out.count() == odd.count() and out.where("doc_id <= 3 and kept").isEmpty()
    assert perplexity.accepted(odd, own).columns == odd.columns
    bare = perplexity.classifier(none, labels)
    assert perplexity.quality(odd, bare).where("kept").count() == odd.count() - 3 and perplexity.quality(none, own).isEmpty()


@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_rules_measure_whole_texts(request, frame):
    rows = request.getfixturevalue(frame)
    got = sorted(rules.judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), key=str)
    want = []
    for r in rows.collect():
        t = r.text or ""
        w = [x.decode() for x in words(t, False)]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(w)
        want.append((r.doc_id, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n))
    assert list(map(tuple, got)) == sorted(want, key=lambda x: str(rowlike(x)))


def rowlike(x):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return "Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, x)) + ")"


def test_rules_keep_clean_text_and_drop_noise(spark):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = rules.judged(big).join(marks, "doc_id").where("not base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.99 and out[out.quality == 0].kept.mean() < 0.05


def test_rules_of_nothing(none):
    assert rules.judged(none).isEmpty()


@pytest.mark.parametrize("frame", ["docs", "odd"])
def test_language_model_counts_and_base(request, frame):
    rows = request.getfixturevalue(frame)
    own = [(r.doc_id, [*words(r.text), None]) for r in rows.collect()]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    count = Counter(w for d, ws in own if not out(d) for w in ws)
    n, v = sum(count.values()), len(count)
    low = math.log10(n + 0.5 * (v + 1))
    want = sorted((str(d), out(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10(count[w] + 0.5) - low for w in ws), 4)) for d, ws in own)
    got = lm.score(rows, lm.held_out()).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) or frame == "odd"


def test_filter_gives_back_levels(spark):
    rng = np.random.default_rng(4)
    h, c = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), rng.zipf(1.7, 20_000).clip(1, 10**6)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h.view(np.int64), c)], "h long, c long")
    got = lm.build(rows, 21).levels(h)
    want = lm.level(c)
    assert (got >= want).all() and (got > want).mean() < 0.01
    assert (lm.build(rows, 21).levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.01


def scores_with_room(docs, monkeypatch, bits_each):
    monkeypatch.setattr(lm, "BITS_EACH", bits_each)
    return {(str(r.doc_id), r.n_tokens): r.score for r in lm.score(docs, lm.held_out()).collect()}


@pytest.mark.parametrize("room", [3_000, 300])
def test_scores_do_not_depend_on_the_bound_of_the_filter(docs, monkeypatch, room):
    """N-grams that the filter has no room for, pairs alone or tokens too, are looked up in the counts."""
    want = scores_with_room(docs, monkeypatch, 200)
    monkeypatch.setattr(lm, "MAX_BITS_LOG2", 20)
    got = scores_with_room(docs, monkeypatch, (1 << 20) // room)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def test_language_model_of_nothing(none, odd):
    assert lm.score(none, lm.held_out()).isEmpty()
    unseen = lm.score(odd, F.lit(True)).collect()
    assert len(unseen) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in unseen)


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
    near = corpus_pipeline.drop_near_copies(spark, docs, folder)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, (_, c) in groups_by_brute_force(texts).items() if c == d)
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(out.doc_id) <= set(texts) and out.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_on_odd_rows(spark, odd, none):
    folder = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns
        assert stage(spark, none, folder).isEmpty()
    assert corpus_pipeline.drop_near_copies(spark, odd, folder).where("doc_id in (7, 8, 5)").isEmpty()


@pytest.mark.parametrize("bound", [200_000, 5])
def test_models_learn_from_every_label(spark, monkeypatch, bound):
    """A rare term of twelve among 400 toxic documents is learned, and the byte model counts half of the trusted ones."""
    monkeypatch.setattr(toxicity, "MAX_LABELLED", bound)
    rows = [(d, ("vilexyz " if d % 10 == 1 else "") + f"plain words number{d % 7} here", "en") for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = docs.select("doc_id", (F.col("doc_id") % 10 == 1).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    model = toxicity.train(docs, marks)
    x, _ = model.evidence(pa.array(["plain words vilexyz here", "plain words here"]))
    assert x[0] > x[1] and len(model.scores) == 2
    counted = []
    monkeypatch.setattr(perplexity, "train", lambda d, trusted, text="text", own=perplexity.train: counted.append(trusted.count()) or own(d, trusted, text))
    perplexity.classifier(docs, marks)
    assert 130 < counted[0] < 230
