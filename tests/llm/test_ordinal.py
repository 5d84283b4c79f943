import random

import numpy as np

from quarrylake.llm import ordinal


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        grade = i % 4
        share = (0.05, 0.3, 0.6, 0.95)[grade]
        words = [rng.choice(["flowing", "clear", "measured"]) if rng.random() < share else rng.choice(["$$x$", "!!", "zz"]) for _ in range(60)]
        out.append((i, " ".join(words), grade))
    return out


def test_grades_on_held_out_rows(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k") for i, t, _ in rows], "doc_id long, text string, grade string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(5, None), (None, 2)], "doc_id long, grade int")
    model = ordinal.learn(df, ratings.where("doc_id % 3 <> 1"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    got = {r.doc_id: r for r in ordinal.grade(df, model).collect()}
    held = [(got[i], g) for i, _, g in rows if i % 3 == 1]
    assert np.mean([abs(r.grade - g) <= 1 for r, g in held]) > 0.95
    assert np.mean([r.grade == g for r, g in held]) > 0.6
    assert np.corrcoef([r.expected_grade for r, _ in held], [g for _, g in held])[0, 1] > 0.85
    kept = ordinal.select_quality(df, model, 0.5)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.tail_prob >= 0.5}
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "clear " * 50_000), (4, "clear"), (4, "clear")], "doc_id long, text string")
    found = sorted(ordinal.grade(odd, model).collect(), key=lambda r: r.doc_id or 0)
    assert len(found) == 5 and found[1].expected_grade == found[2].expected_grade and found[3] == found[4]
    assert found[0].grade >= 2
    assert ordinal.grade(odd.limit(0), model).count() == 0
    assert ordinal.grade(odd, ordinal.learn(df, ratings.where("grade > 9"))).agg({"grade": "max"}).first()[0] == 0


def test_a_rare_middle_grade_is_recovered(spark):
    rows = [(i, t, 2 * g + 1) for i, t, g in corpus(900, 7) if g != 2 or i % 20 == 2]  # grades 1, 3, 5 and 7, of which 5 is rare
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = ordinal.learn(df, spark.createDataFrame([(i, g) for i, _, g in rows if i % 3 != 1], "doc_id long, grade int"))
    assert model.levels.tolist() == [1, 3, 5, 7]
    got = {r.doc_id: r for r in ordinal.grade(df, model, tail=5).collect()}
    for grade in (1, 3, 5, 7):
        held = [got[i] for i, _, g in rows if i % 3 == 1 and g == grade]
        assert held and np.mean([r.grade == grade for r in held]) > 0.5, grade
    assert all(1 <= r.expected_grade <= 7 for r in got.values())


def test_scores_match_the_plain_formula(spark):
    """Brute force: each word's weights summed, their mean cut by the thresholds."""
    rows = corpus(200, 3)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = ordinal.learn(df, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"))
    got = {r.doc_id: r for r in ordinal.grade(df, model).collect()}
    for i, text, _ in rows[:40]:
        words, total = text.split(), 0.0
        for k, w in enumerate(words):
            one = ordinal.pa.array([w])
            buckets = ordinal.features(*ordinal.kernel.string_buffers(one))[0][0].copy()
            if k and words[k - 1] == w:
                same = ordinal.kernel.mix(np.ones(1, np.uint64))[0]
                buckets[3] = int(same >> np.uint64(49)) + 3 * ordinal.BUCKETS
            total += model.weights[buckets].sum()
        scale = ordinal.SCALE * total / len(words)
        beyond = 1 / (1 + np.exp(model.thresholds - scale))
        assert abs(got[i].expected_grade - beyond.sum()) < 1e-9 and abs(got[i].tail_prob - beyond[-1]) < 1e-9


def test_learns_from_whole_texts(spark):
    rows = corpus(120)
    filler = "plain " * 3000
    rows = [(i, filler + t + " " + filler, g) for i, t, g in rows]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = ordinal.learn(df, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"))
    word, noise = (ordinal.kernel.string_buffers(ordinal.pa.array([w])) for w in ("flowing", "$$x$"))
    assert model.scale(*word)[0] > 0.5 > -0.5 > model.scale(*noise)[0]
    sample = spark.createDataFrame([(str(i), g, i, t) for i, t, g in rows[:5]], "doc_id string, grade int, turn long, text string").mapInArrow(ordinal.counted, ordinal.SAMPLE).collect()
    assert all(r.n_words == 6060 and np.frombuffer(r.times, np.int32).sum() == 4 * 6060 for r in sample)
