"""Learned operators on held-out rows."""

import re

import numpy as np
import pytest
from graphloam.llm import language, quality, queries, rules, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def joined(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    return got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id", how="left")


def test_quality_on_held_out_rows(spark):
    m = joined(spark, "op2_quality")
    h = m[m.held_out & m.quality.notna()]
    assert len(h) > 500 and m.score.between(0, 1).all() and (m.predicted == (m.score >= 0.5)).all()
    assert (h.predicted == h.quality).mean() > 0.97
    assert (h[h.quality == 1].predicted == 1).mean() > 0.98


def test_attention_is_the_formula():
    rng = np.random.default_rng(1)
    size = sum(int(np.prod(s)) for s in quality.Attention.SHAPE.values())
    model = quality.Attention(rng.normal(0, 0.1, quality.DIM), rng.uniform(0.5, 2, quality.DIM), rng.normal(0, 0.3, size))
    texts = ["", "one two three " * 60, "A b c! 12 " * 200, "x"]
    x, own = quality.passages(texts)
    got = model.score(x, own)
    q = model.parts(model.p)
    for k in range(len(texts)):
        hs, es = [], []
        for row in x[own == k]:
            h = np.tanh(((row - model.mean) / model.scale) @ q["W"] + q["b"])
            hs.append(h)
            es.append(sum(w * np.tanh(h @ q["V"][:, j]) / (1 + np.exp(-h @ q["U"][:, j])) for j, w in enumerate(q["w"])))
        a = np.exp(es) / np.exp(es).sum()
        z = sum(a_ * h for a_, h in zip(a, hs, strict=True))
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(z @ q["c"] + q["d"][0]))), abs=1e-6)
    assert len(x[own == 1]) == -(-180 // quality.PASSAGE)


def test_one_bad_passage_of_many_is_learnt_from(spark):
    """Labels that rest on one passage of 60, anywhere in the text."""
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in ("em", "um", "or", "an", "et", "is")]
    rows = []
    for k in range(400):
        parts = [" ".join(rng.choices(words, k=50)) for _ in range(60)]
        if k % 2:
            parts[rng.randrange(60)] = " ".join(rng.choices(["$$#", "@@@", "%%|", "7#7", "<<>"], k=50))
        rows.append((k, " ".join(parts), 1 - k % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    h = [r for r in quality.score_quality(docs, labels).collect() if r.held_out]
    assert len(h) > 90 and sum(r.predicted == 1 - r.doc_id % 2 for r in h) > 0.95 * len(h)
    assert quality.within(docs.selectExpr("doc_id", "1 y", "text"), 10 * len(rows[0][1])).count() in (10, 11)


def test_toxicity_on_held_out_rows(spark):
    m = joined(spark, "op6_toxicity")
    h = m[m.held_out & m.toxic.notna()]
    assert (m.predicted == (m.score >= 0.3)).all()
    assert (h[h.toxic == 1].predicted == 1).mean() > 0.87
    assert (h[h.toxic == 0].predicted == 1).mean() < 0.005


def test_rules_keep_clean_and_reject_bad(spark):
    m = joined(spark, "op7_rules")
    ok = m[~m.base_failed & m.quality.notna()]
    assert ok[ok.quality == 1].kept.mean() > 0.95
    assert ok[ok.quality == 0].kept.mean() < 0.2


def test_languages_on_held_out_rows(spark):
    got = queries.op10_language(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    h = got[got.held_out]
    assert len(h) > 1000 and (h.lang_pred == h.lang).mean() > 0.99


def test_lm_scores_tell_good_from_bad(spark):
    m = joined(spark, "op4_lm_score")
    assert m[m.quality == 1].score.median() < m[m.quality == 0].score.median()


def test_words_without_letters_are_undetermined():
    x, some = language.features(["", "123 ,.", "a", "é"])
    assert some.tolist() == [False, False, True, True]
    assert np.allclose(np.linalg.norm(x[2:], axis=1), 1)


def test_runs_of_marks_vote_whatever_marks_they_hold():
    own, voter = toxicity.Votes([])(["what???", "no?!?", "so!?!", "hey!!!", "fine!!", "a! b? c!"])
    assert list(own[voter == len(toxicity.LEXICONS) + len(toxicity.PATTERNS) - 1]) == [0, 1, 2, 3]


def planted_votes(n, flipped, seed=0):
    """Hidden classes, given labels of which a share is flipped, 40 informative voters and five near-copies of the first."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.2).astype(float)
    given = np.where(rng.random(n) < flipped, 1 - y, y)
    yes, no = rng.uniform(0.2, 0.6, 40), rng.uniform(0.01, 0.1, 40)
    votes = (rng.random((n, 40)) < np.where(y[:, None] == 1, yes, no)).astype(float)
    again = np.where(rng.random((n, 5)) < 0.85, votes[:, :1], (rng.random((n, 5)) < 0.1)).astype(float)
    return y, given, yes, no, np.concatenate([votes, again], 1)


def test_label_model_overturns_wrong_labels_and_estimates_voters():
    y, given, yes, no, votes = planted_votes(6000, 0.1)
    model = toxicity.LabelModel(votes, given)
    found = model.posterior(votes, given) > 0.5
    wrong = given != y
    assert (found[wrong] == y[wrong]).mean() > 0.9 and (found == y).mean() > 0.98
    assert np.abs(model.fire[1][:40] - yes).max() < 0.06 and np.abs(model.fire[0][:40] - no).max() < 0.03
    assert abs(model.accuracy[-1] - 0.9) < 0.02 and abs(model.prior - y.mean()) < 0.02


def test_label_model_finds_planted_correlations():
    y, given, _, _, votes = planted_votes(6000, 0.1, 1)
    model = toxicity.LabelModel(votes, given)
    copies = {0, *range(40, 45)}
    assert {frozenset(p[:2]) for p in model.pairs} <= {frozenset((a, b)) for a in copies for b in copies} and len(model.pairs) == 5
    for child, up, odds in model.pairs:
        n = [[[((votes[:, child] == i) & (votes[:, up] == j) & (y == k)).sum() for j in (0, 1)] for i in (0, 1)] for k in (0, 1)]
        true = sum(t[1][1] * t[0][0] / np.sum(t) for t in n) / sum(t[1][0] * t[0][1] / np.sum(t) for t in n)
        assert 0.6 < odds / true < 1.6
    one = np.zeros((2, 45))
    one[0, [1, 2]], one[1, list(copies)[:2]] = 1, 1  # two independent votes say more than a vote and its copy
    apart, alike = (np.log(p / (1 - p)) for p in model.posterior(one, np.zeros(2)))
    assert apart > alike


def test_posteriors_are_those_of_the_forest():
    model = toxicity.LabelModel(*[x[4] if k == 0 else x[1] for k, x in enumerate([planted_votes(50, 0.1)] * 2)])
    model.prior, model.fire = 0.2, np.array([[0.1, 0.05, 0.2, 0.1, 0.02], [0.6, 0.4, 0.3, 0.5, 0.9]])
    model.parent, model.odds = np.array([-1, 0, 0, 2, -1]), np.array([1.0, 9.0, 0.5, 30.0, 1.0])
    every = np.array([[k >> b & 1 for b in range(5)] for k in range(32)], float)
    joint = np.ones((2, 32))
    for c, fire in enumerate(model.fire):
        for k, up in enumerate(model.parent):
            for j, row in enumerate(every):
                chance = fire[k]
                if up >= 0:
                    ab = toxicity.together(fire[k], fire[up], model.odds[k])
                    chance = ab / fire[up] if row[up] else (fire[k] - ab) / (1 - fire[up])
                    assert ab * (1 - fire[k] - fire[up] + ab) / ((fire[k] - ab) * (fire[up] - ab)) == pytest.approx(model.odds[k])
                joint[c, j] *= chance if row[k] else 1 - chance
    assert joint.sum(1) == pytest.approx([1, 1])
    want = 0.2 * joint[1] / (0.8 * joint[0] + 0.2 * joint[1])
    assert model.posterior(every[:, :4], every[:, 4]) == pytest.approx(want, abs=1e-6)


def test_toxicity_scores_are_the_linear_model(spark):
    """The scorer against its definition: every voter of a text once, summed by hand."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    from graphloam.llm.common import remainder
    from pyspark.sql import functions as F

    entries, weights, bias = toxicity.train(docs, labels, ~(remainder(F.col("doc_id"), 4) == 2))
    lexicon = [set(ws) for ws in toxicity.LEXICONS.values()]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    number = {e: k for k, e in enumerate(entries)}
    for r in docs.limit(60).collect():
        low = (r.text or "").lower()
        words = set(re.findall(r"[^\W\d_]+", low))
        fired = {number[k] for w in words for k in [toxicity.entry_hash(w), *(toxicity.entry_hash(w[:n] + "*") for n in toxicity.BEGINNINGS if len(w) > n)] if k in number}
        fired |= {len(entries) + k for k, ws in enumerate(lexicon) if ws & words}
        fired |= {len(entries) + len(lexicon) + k for k, (_, p) in enumerate(toxicity.PATTERNS) if p.search(low)}
        want = 1 / (1 + np.exp(-(sum(weights[k] for k in fired) + bias)))
        assert got[r.doc_id] == pytest.approx(want, abs=1e-5)


def test_forest_scores_outliers_higher():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(9, 1, (20, 3))])
    s = rules.Forest(x).score(x)
    assert s[400:].min() > np.quantile(s[:400], 0.9)
    assert rules.threshold(s, np.arange(420) < 400) < s[400:].min() + 1e-9


def test_slices_of_long_texts_count_every_n_gram_once():
    texts = ["", "a", "  Straße 12,, über-all  ", "één twee\n\ndrie 4 " * 30, "1234", "ab"]
    whole = language.features(texts)
    for size in (1, 2, 3, 7, 50):
        sliced = language.features(texts, size)
        assert np.allclose(whole[0], sliced[0]) and (whole[1] == sliced[1]).all()


def test_language_decision_is_family_then_pairs():
    rng = np.random.default_rng(0)
    langs = ["en", "de", "nl", "fr", "es", "fi"]
    centre = rng.normal(0, 1, (6, language.DIM)).astype(np.float32)
    x = np.concatenate([c + rng.normal(0, 2, (12, language.DIM)).astype(np.float32) for c in centre]) / 50
    m = language.Model(x, [v for v in langs for _ in range(12)])
    got, score = m.predict(x)
    for row, lang, s in zip(x, got, score, strict=True):
        margin = row @ m.root[:-1] + m.root[-1]
        p = np.exp(4 * (margin - margin.max()))
        k = int(margin.argmax())
        codes = m.members[m.families[k]]
        votes = dict.fromkeys(codes, 0.0)
        for (one, two), w in m.pairs.items():
            if one in votes and two in votes:
                v = 1 / (1 + np.exp(-4 * float(row @ w[:-1, 0] + w[-1, 0])))
                votes[one] += v
                votes[two] += 1 - v
        best = max(codes, key=lambda c: votes[c])
        assert lang == best
        assert s == pytest.approx(p[k] / p.sum() * (votes[best] / (len(codes) - 1) if len(codes) > 1 else 1), abs=1e-4)


def test_forest_keeps_what_it_was_not_calibrated_on(spark):
    """Rules calibrated on a part of the labelled rows, measured on the others."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    m = rules.apply_rules(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0")).toPandas()
    m = m.merge(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 2 = 1").toPandas(), on="doc_id")
    ok = m[~m.base_failed & m.quality.notna()]
    assert len(ok) > 500 and ok[ok.quality == 1].kept.mean() > 0.95 and ok[ok.quality == 0].kept.mean() < 0.2


def test_path_lengths_match_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 4))
    f = rules.Forest(x, trees=20)
    got = f.score(x[:40])
    for row, s in zip(x[:40], got, strict=True):
        lengths = []
        for k in f.roots:
            while f.feature[k] >= 0:
                k = f.child[k] + (row[f.feature[k]] > f.threshold[k])
            lengths.append(f.length[k])
        n = f.size
        usual = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
        assert s == pytest.approx(2 ** (-np.mean(lengths) / usual))


def test_families():
    assert language.family("en") == language.family("de") != language.family("fr") == language.family("es")
    assert language.family("xx") == "own:xx"


@pytest.mark.parametrize("langs", [["en"], ["en", "xx"], ["en", "de", "fr", "es"]])
def test_language_models_of_any_number(langs):
    x = np.eye(len(langs), language.DIM, dtype=np.float32)
    m = language.Model(np.repeat(x, 5, 0), [v for v in langs for _ in range(5)])
    assert m.predict(x)[0].tolist() == langs


def test_all_labelled_rows_calibrate_the_rules(spark):
    """Bad labels on none of the first 4,000 ids by hash: rules from a sample of that size knew no bad row."""
    ids = spark.range(5000).selectExpr("id AS doc_id")
    last = ids.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").toPandas().doc_id[4000:].tolist()
    bad = set(last[::20])
    rng = np.random.default_rng(0)
    text = {i: " ".join(("#%d|" if i in bad else "w%d") % k for k in rng.integers(0, 10000, 60)) for i in range(5000)}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = ids.selectExpr("doc_id").withColumn("quality", F.when(F.col("doc_id").isin(*bad), 0).otherwise(1))
    got = rules.apply_rules(docs, labels).toPandas()
    assert len(got) == 5000 and not got.base_failed.any()
    assert not got[got.doc_id.isin(bad)].kept.any() and got[~got.doc_id.isin(bad)].kept.mean() > 0.99


def test_leaves_of_the_forest_count_all_rows(spark):
    x = np.random.default_rng(1).normal(0, 1, (3000, 8))
    rows = spark.createDataFrame([(k, 60, False, bytearray(r.tobytes())) for k, r in enumerate(x)], "doc_id long, n_words long, base_failed boolean, x binary")
    forest, _ = rules.train(rows, spark.createDataFrame([], "doc_id long, quality int"))
    n = np.bincount(forest.leaves(x).ravel(), minlength=len(forest.feature))
    assert (n[forest.feature >= 0] == 0).all() and n.sum() == 3000 * rules.TREES
    want = forest.depth + rules._average(n * 256 / 3000)
    assert np.allclose(forest.length[forest.feature < 0], want[forest.feature < 0])
