import numpy as np
import pytest
from pyspark.sql import functions as F

from lossgauge.llm import ordinal, queries, toxicity


def test_folding_undoes_disguises():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ")
    assert toxicity.fold("l0​ser") == toxicity.fold("loser")


def test_matches_words_beginnings_and_exceptions():
    entries = ((toxicity.fold("trash"), 2.0), (toxicity.fold("stupid") + "*", 3.0), (toxicity.fold("stupid"), 1.0))
    weigh = toxicity.Lexicon(entries, ("trash can",)).matcher()
    weights = {"trash": 2, "trashy": 0, "utrash": 0, "stupidity!": 3, "a trash can": 0, "trash cans, trash": 4, "5tup1d": 3, "": 0}
    assert {t: weigh(toxicity.fold(t)) for t in weights} == weights


def test_toxicity_on_held_out_documents(spark, raw):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    import duckdb

    labels = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    hits = [p for t, p in held if t]
    assert sum(hits) >= 0.5 * len(hits) and sum(p for t, p in held if not t) <= 1


def test_toxicity_of_messy_rows(spark, messy):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (6, 0), (99, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(messy, labels)
    found = toxicity.classify(messy, lexicon)
    assert found.count() == messy.count() and found.where("score IS NULL").count() == 0
    assert toxicity.classify(messy.limit(0), lexicon).count() == 0
    nothing = toxicity.learn(messy, labels.limit(0))
    assert len(nothing.entries) == len(set(map(toxicity.fold, toxicity.SEEDS)))
    few = [(toxicity.fold(t), p) for t, p in (("you idiot", 1), ("a fine day", 0), ("", 0))]
    assert [(round(s) == 1) == bool(p) for s, (_, p) in zip(nothing.score([t for t, _ in few]), few)] == [True] * 3


def test_abuse_beside_known_abuse_is_learned_and_copies_count_once(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("bcdfghjkmnpqruvw"), 7))
    plain = [word() for _ in range(400)]
    line = lambda *more: " ".join([*rng.choice(plain, 30), *more])
    toxic = [line("stupid", "grumpfel") for _ in range(60)]
    copied = line("stupid", "grumpfel", "quimbaru", *[word() for _ in range(200)])
    toxic += [copied + " " * i for i in range(60)]
    clean = [line("moron" if i % 2 else "fine") for i in range(300)]
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    entries = dict(lexicon.entries)
    assert entries[toxicity.fold("grumpfel")] == entries[toxicity.fold("stupid")] != toxicity.SEED_WEIGHT
    assert toxicity.fold("quimbaru") not in entries and toxicity.fold("moron") not in entries
    scores = lexicon.score([line("grumpfel"), line("moron"), line("quimbaru")])
    assert [s >= 0.5 for s in scores] == [True, False, False]
    assert not lexicon.exceptions


def test_phrases_of_clean_documents_are_learned_as_exceptions(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("bcdfghjkmnpqruvw"), 7)) for _ in range(300)]
    line = lambda *more: " ".join([*rng.choice(plain, 25), *more])
    toxic = [line("grumpfel") for _ in range(80)]
    clean = [line("grumpfel bin" if i < 12 else "fine") for i in range(400)]
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert toxicity.fold("grumpfel bin") in lexicon.exceptions
    scores = lexicon.score([line("grumpfel"), line("grumpfel", "bin"), line("Grumpfe1 bin, grumpfel")])
    assert [s >= 0.5 for s in scores] == [True, False, True]


def naive_weight(entries, exceptions, text):
    """Every entry tried at every place of the text."""
    best, excused = {}, set()
    bound = lambda i: i < 0 or i >= len(text) or not text[i].isalnum()
    for start in range(len(text)):
        if not bound(start - 1):
            continue
        for entry, weight in entries:
            form = entry.rstrip("*")
            if text.startswith(form, start) and (entry.endswith("*") or bound(start + len(form))):
                if weight > best.get(start, (0, 0.0))[1]:
                    best[start] = (start + len(form), weight)
        for phrase in exceptions:
            if text.startswith(phrase, start) and bound(start + len(phrase)):
                excused.add((start, start + len(phrase)))
    return sum(w for a, (b, w) in best.items() if not any(x <= a and b <= y for x, y in excused))


def test_matching_equals_every_entry_at_every_place():
    rng = np.random.default_rng(6)
    for _ in range(300):
        forms = ["".join(rng.choice(list("ab "), rng.integers(1, 5))).strip() for _ in range(8)]
        forms = list(dict.fromkeys(f for f in forms if f))
        entries = tuple((f + "*" * int(rng.integers(0, 2)), float(i + 1)) for i, f in enumerate(forms[:5]))
        lexicon = toxicity.Lexicon(entries, tuple(forms[5:]))
        text = "".join(rng.choice(list("aab b.-"), 40))
        assert lexicon.matcher()(text) == pytest.approx(naive_weight(entries, forms[5:], text))


def test_evidence_is_the_likelihood_ratio(spark):
    rows = [(float(t), float(c)) for t in range(9) for c in range(13)]
    found = spark.createDataFrame(rows, "t double, c double").withColumn("e", toxicity._evidence(F.col("t"), F.col("c"), 8, 12))

    def likelihood(seen, n):
        return sum(k * np.log(k / n) for k in (seen, n - seen) if k)

    for r in found.collect():
        t, c = r["t"], r["c"]
        want = 2 * (likelihood(t, 8) + likelihood(c, 12) - likelihood(t + c, 20))
        assert r["e"] == pytest.approx(want if t * 12 >= c * 8 else -want, abs=1e-9)


def test_a_sample_is_bounded_where_ids_repeat(spark):
    rows = [(i % 10, f"text {i} of many words") for i in range(500)] + [(None, "no id")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3, "doc_id long, toxic int")
    sampled = toxicity.training_sample(docs, labels, "toxic", 5, "doc_id", "text").collect()
    assert 0 < len(sampled) <= 5 and len({r["id"] for r in sampled}) == len(sampled)
    again = toxicity.training_sample(docs.repartition(3), labels, "toxic", 5, "doc_id", "text").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, sampled))


def test_slopes_of_the_ordinal_likelihood():
    rng = np.random.default_rng(1)
    scores, grades, thresholds = rng.normal(size=40), rng.integers(0, 4, 40), np.array([-1.0, 0.2, 0.9])

    def loss(s, t):
        tails = 1 / (1 + np.exp(-(s[:, None] - t)))
        edges = np.column_stack([np.ones(len(s)), tails, np.zeros(len(s))])
        rows = np.arange(len(s))
        return -np.log(edges[rows, grades] - edges[rows, grades + 1]).mean()

    d_score, d_threshold = ordinal._slopes(scores, thresholds, grades)
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert d_threshold[i] == pytest.approx((loss(scores, thresholds + step) - loss(scores, thresholds - step)) / 2e-6, abs=1e-5)
        step = np.eye(40)[i] * 1e-6
        assert d_score[i] == pytest.approx((loss(scores + step, thresholds) - loss(scores - step, thresholds)) / 2e-6, abs=1e-5)


def test_predictions_equal_the_formula_and_the_fit_equals_a_dense_one():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)] + [""]
    grades = np.array([min(2, t.count("w1")) for t in texts])
    rows = list(ordinal.vectorise(texts))
    model = ordinal.fit(rows, grades, 3, steps=40)
    used = sorted({int(b) for found, _ in rows for b in found})
    dense = np.zeros((len(texts), len(used)))
    for i, (found, values) in enumerate(rows):
        dense[i, [used.index(b) for b in found]] = values
    # the same steps on a dense matrix, slopes by differences
    share = np.array([np.mean(grades >= 1), np.mean(grades >= 2)])
    start = np.maximum.accumulate(np.log((1 - share) / share) + 1e-2 * np.arange(2))
    x = np.concatenate([np.zeros(len(used)), [start[0], np.log(start[1] - start[0])]])

    def loss(x):
        thresholds = x[-2] + np.array([0.0, np.exp(x[-1])])
        tails = 1 / (1 + np.exp(-((dense @ x[:-2])[:, None] - thresholds)))
        edges = np.column_stack([np.ones(len(texts)), tails, np.zeros(len(texts))])
        at = np.arange(len(texts))
        return -np.log(edges[at, grades] - edges[at, grades + 1]).mean() + ordinal.STRENGTH / 2 * (x[:-2] ** 2).sum()

    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, 41):
        slope = np.array([(loss(x + d) - loss(x - d)) / 2e-6 for d in np.eye(len(x)) * 1e-6])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        x = x - ordinal.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    np.testing.assert_allclose(model.weights[used], x[:-2], atol=1e-3)
    scores = dense @ model.weights[used]
    tails = 1 / (1 + np.exp(-(scores[:, None] - model.thresholds)))
    np.testing.assert_allclose(model.tails(texts), tails, atol=1e-9)


def test_a_quality_sample_is_bounded_in_rows_and_features(spark, monkeypatch):
    rows = [(i % 40, " ".join(f"w{i} {j}x" for j in range(5))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_id long, grade int")
    given = []
    monkeypatch.setattr(ordinal, "fit", lambda rows, grades, n: given.append((rows, grades)))
    ordinal.learn(docs, ratings, 3, sample=12)
    ordinal.learn(docs, ratings, 3, sample=12, sample_buckets=50)
    assert len(given[0][0]) == len(given[0][1]) == 12
    assert 0 < sum(len(b) for b, _ in given[1][0]) <= 50


def test_shapes_count_whole():
    long = "a1" * 20
    assert ordinal._features_of(long + "b2")[1] == ordinal._features_of("a1" * 21)[1] != ordinal._features_of(long)[1]


def test_quality_on_held_out_documents(spark):
    import duckdb

    rows = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = duckdb.sql("SELECT doc_id, quality + 1 - toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    grades = dict(labels)
    held = [(grades[r["doc_id"]], r["kept"]) for r in rows if r["held_out"] and r["doc_id"] in grades]
    good = [k for g, k in held if g == 2]
    assert sum(good) >= 0.95 * len(good)
    assert sum(k for g, k in held if g < 2) <= 0.75 * sum(g < 2 for g, _ in held)
    assert all(0 <= r["expected_grade"] <= 2 and r["tail_probability"] <= r["expected_grade"] for r in rows)


def test_quality_of_messy_rows(spark, messy):
    ratings = spark.createDataFrame([(1, 2), (2, 0), (None, 1), (6, 7), (7, 1)], "doc_id long, grade int")
    model = ordinal.learn(messy, ratings, 3)
    assert np.all(np.diff(model.thresholds) > 0)
    assert ordinal.select(messy, model, 2).count() == messy.count()
    assert ordinal.select(messy.limit(0), model, 2).count() == 0
    assert not ordinal.learn(messy, ratings.limit(0), 3).weights.any()
