"""Scores, rates and the corpus pipeline against plain versions, clashing columns and empty tables."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from foliant.llm import merge_dropout, mixing, quality, rules, subword, token_counts, toxicity

WORDS = "calm words here idiot scum (scum) Idiot! x éé zz9 --".split()


def _texts(n, seed):
    rng = random.Random(seed)
    return [None, "", " \t\n", *(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40))) for _ in range(n))]


def test_toxicity_against_single_words():
    """The sum over a text's distinct features, gathered word by word, through each threshold's sigmoid."""
    cfg = toxicity.Settings(bits=12, l1=0.1)
    texts = _texts(60, 1)
    grade = np.array([0 if t is None else min(2, t.count("scum")) for t in texts])
    single = lambda t: sorted({int(r) for w in (t or "").split() for r in toxicity.occurrences([w], cfg)[0]})
    model = toxicity.fit([np.array(single(t), np.int32) for t in texts], grade, 3, cfg)
    assert (np.diff(model.thresholds) >= 0).all()
    got = model.above(texts)
    for i, t in enumerate(texts):
        z = sum(model.weights[r] for r in single(t))
        assert np.allclose(got[i], [1 / (1 + np.exp(-(z - theta))) for theta in model.thresholds])


def test_quality_against_one_text_at_a_time():
    """The softmax of the mean vector, text by text, is what the folded tables give for many at once."""
    cfg = subword.Settings(bits=10, width=4, sample=60)
    texts = _texts(60, 2)
    bags = subword.bags(texts, cfg)
    y = np.array([int("scum" in (t or "")) for t in texts])
    model = subword.fit([b[0] for b in bags], [b[1] for b in bags], y, 2, cfg)
    for t, p in zip(texts, model.probabilities(texts), strict=True):
        ids, w = subword.bags([t], cfg)[0]
        logit = model.bias[1] + float((w * model.table[0][ids]).sum())
        assert abs(p[1] - 1 / (1 + np.exp(-logit))) < 1e-4 and abs(p.sum() - 1) < 1e-9


def test_rates_against_brute_force(spark):
    """Nonnegative least squares by many plain projected gradient steps; some rates end at 0."""
    rng = np.random.default_rng(3)
    for total, weights in ((100.0, {"x": 0.05, "y": 0.95}), (500.0, {"x": 0.9, "y": 0.1})):
        p, t = rng.beta(0.5, 0.5, 60), rng.integers(1, 50, 60)
        points = spark.createDataFrame([(int(a), float(b), float(1 - b)) for a, b in zip(t, p, strict=True)], "n_tokens long, p_x double, p_y double").coalesce(1)
        found = mixing.fit(points, weights, total=total)
        mine = np.array([r[0] for r in points.select(found.rate()).collect()])
        post, r = np.stack([p, 1 - p], axis=1), np.ones(60)
        moments = np.linalg.eigvalsh((post * t[:, None]).T @ post)[-1]
        for _ in range(20000):
            r = np.maximum(0, r - post @ ((post * (t * r)[:, None]).sum(axis=0) - found.targets) / moments)
        miss = lambda x: float((((post * (t * x)[:, None]).sum(axis=0) - found.targets) ** 2).sum())
        assert (mine == 0).any() and (mine >= 0).all() and miss(mine) <= miss(r) + 1e-3 * total and found.absent == []


def test_scarce_domains_are_reported(spark):
    points = spark.createDataFrame([(100, 1.0, 0.0, 0.0), (100, 0.02, 0.98, 0.0)], "n_tokens long, p_x double, p_y double, p_z double").coalesce(1)
    found = mixing.fit(points, {"x": 0.5, "y": 0.3, "z": 0.2})
    assert found.absent == ["z"] and found.targets[2] == 0 and found.residual < 1e-5
    few = mixing.fit(spark.createDataFrame([(1000, 1.0, 0.0), (10, 0.0, 1.0)], "n_tokens long, p_x double, p_y double").coalesce(1), {"x": 0.01, "y": 0.99})
    assert few.targets.sum() <= 4 * 1010 + 1e-6
    none = mixing.fit(points.limit(0), {"x": 0.5, "y": 0.5, "z": 0.0})
    assert none.passes == 1 and not none.steps


def test_clashing_columns(spark, odd_docs, labels, empty_docs):
    """Columns of the input that are named like results are replaced; all others stay."""
    model = subword.fit([], [], np.zeros(0, np.int64), 2, subword.Settings(bits=8))
    clash = odd_docs.withColumns({c: F.lit("q") for c in ("n_tokens", "score", "p_toxic", "kept", "other")})
    for df in (quality.score(clash, model), toxicity.score(clash, toxicity.fit([], np.zeros(0, np.int64), 3, toxicity.Settings(bits=8))), token_counts.counted(clash), rules.judge(clash, [])):
        rows = df.collect()
        assert len(rows) == 14 and all(r.other == "q" for r in rows) and len(df.columns) == len(set(df.columns))
    assert token_counts.count_all(empty_docs).count() == 0
    mixed = mixing.mixed(clash.withColumn("copies", F.lit("c")).withColumn("p_en", F.lit("p")), labels)
    assert set(mixed.columns) == {*clash.columns, "copies", "p_en"} and {(r.n_tokens, r.copies, r.p_en) for r in mixed.collect()} == {("q", "c", "p")}


def test_corpus_pipeline(spark, tmp_path):
    """All stages on a small table with good and bad texts, near copies, an address and odd rows."""
    rng = random.Random(15)
    word = lambda p: p + "".join(rng.choice("abcdefgh") for _ in range(5))
    good = {i: " ".join(word("k") for _ in range(80)) for i in range(60)}
    good[61] = good[60 - 1].replace(good[59].split()[40], "changed")
    good[62] = good[5] + " mail to someone@q.com please"
    bad = {i: " ".join(word("zz") for _ in range(80)) for i in range(100, 160)}
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in {**good, **bad}.items()] + [(None, good[7], "en", "s", 1), (300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*good, *bad] if i % 3], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    # Bad texts go, of near copies one stays, all other good ones stay; the address is masked before encoding.
    assert set(good) - {61, 62} <= ids and not ids & set(bad) and 61 not in ids and ids <= {*good, None, 300, 301}
    assert all(r.lossless for r in out)
    pieces = merge_dropout.Pieces(merge_dropout.vocabulary_path())
    assert not any("someone@q.com" in pieces.decode(np.array(r.token_ids, np.uint16)) for r in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "encoding"]
