import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilgraph.llm import ordinal

from . import plain


@pytest.fixture(scope="module")
def rated(spark):
    rows = []
    for i in range(900):
        g = i % 3
        filler = " ".join(f"f{(i * 31 + k * k) % 97}" for k in range(30))
        rows.append((i, f"{filler} {['vile', 'plain###', 'good'][g]} words", g if i % 10 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_thresholds_stay_ordered_and_grades_are_learned(rated):
    model = ordinal.fit(rated)
    assert (np.diff(model.thresholds) > 0).all()
    doc, feature = ordinal.features(pa.array(["vile words", "plain### words", "good words", None, ""]))
    tails = model.tails(doc, feature, 5)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert tails[:3].sum(axis=1).argsort().tolist() == [0, 1, 2]
    assert tails[3] == pytest.approx(tails[4])


def test_grading(spark, rated):
    model = ordinal.fit(rated)
    rows = [(1, "f1 f2 vile"), (2, "f1 f2 good"), (None, None), (3, ""), (2, "f1 f2 good"), (4, "good " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Grade string")
    out = ordinal.grade_documents(df, model)
    assert out.columns == ["doc_id", "text", "expected_grade", "p_low", "p_top", "grade", "selected"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    assert by[1, "f1 f2 vile"].grade == 0 and not by[1, "f1 f2 vile"].selected
    assert by[2, "f1 f2 good"].grade == 2 and by[2, "f1 f2 good"].selected
    assert all(0 <= r.expected_grade <= 2 for r in got)
    assert ordinal.grade_documents(df.where("1 = 0"), model).collect() == []
    assert ordinal.grade_documents(df, None).first().expected_grade is None
    assert ordinal.fit(rated.where("grade is null")) is None


def test_held_out(spark):
    got = ordinal.op9_quality(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: 0 if r.toxic else 1 + r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.grade == g for r, g in held) >= 0.85 * len(held)
    assert np.mean([not r.selected for r, g in held if g == 0]) >= 0.9
    assert np.mean([r.selected for r, g in held if g == 2]) > 0.98


def plain_features(text):
    lower = (text or "").translate(plain.LOWER)
    said = [(b"w", w.encode()) for w in plain.ALNUM_WORD.findall(lower)]
    said += [(b"h%d" % n, w.decode()[:n].encode()) for _, w in said for n in (3, 4, 5)]
    said += [(b"t", w.encode()[-3:]) for w in plain.words(text)]
    return {xxhash.xxh3_64_intdigest(kind + value) >> (64 - ordinal.BITS) for kind, value in said}


def test_grades_against_plain(spark, rated):
    """Every column of op9 from the model's weights, word by word."""
    model = ordinal.fit(rated)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    texts = [r.text for r in docs] + [None, "", "Vile ünd Plain### 42x42", "good " * 20_000 + "vile"]
    got = ordinal.grade_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        score = sum(model.weights[f] for f in plain_features(texts[r.doc_id]))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert (r.expected_grade, r.p_low, r.p_top) == pytest.approx((sum(tails), 1 - tails[0], tails[-1]), abs=1e-9)
        assert r.grade == sum(t > 0.5 for t in tails) and r.selected == (1 - tails[0] < 0.1)


def test_gradients():
    rng = np.random.default_rng(4)
    score, free, y = rng.normal(size=30), np.array([-0.7, 0.2, -0.4]), rng.integers(0, 4, 30)
    loss, d_score, d_free = ordinal.gradients(score, free, y)
    cuts = [-math.inf, *ordinal.thresholds(free), math.inf]
    below = lambda t, s: 1 / (1 + math.exp(s - t)) if abs(t) < math.inf else float(t > 0)
    assert loss == pytest.approx(-np.mean([math.log(below(cuts[k + 1], s) - below(cuts[k], s)) for s, k in zip(score, y, strict=True)]))
    for x, d in ((score, d_score), (free, d_free)):
        for k in range(len(x)):
            old = x[k]
            x[k] = old + 1e-5
            up = ordinal.gradients(score, free, y)[0]
            x[k] = old - 1e-5
            down = ordinal.gradients(score, free, y)[0]
            x[k] = old
            assert (up - down) / 2e-5 == pytest.approx(d[k], rel=1e-4, abs=1e-8)


def test_sample(spark):
    """Rows that share id and text count once, with their lowest grade; long
    texts are read whole; both bounds hold."""
    long = " ".join(f"word{k}x" for k in range(9000))
    rows = [(1, "two grades", 2), (1, "two grades", 0), (2, long, 1), (3, None, 1), (3, None, 1), (4, "x", 5), (4, "x", None), (5, "x", -1)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, grade int, key string")
    for layout in (df, df.orderBy("grade"), df.orderBy(ordinal.F.desc("grade"))):
        doc, feature, grade = ordinal.sample_rated(layout, 3, 100, 1 << 30)
        assert sorted(grade) == [0, 1, 1]
        assert {frozenset(feature[doc == k].tolist()) for k in range(3)} == {frozenset(plain_features(t)) for t in ("two grades", long, None)}
    many = spark.range(4000).selectExpr("id AS doc_id", "concat('some words ', id) AS text", "cast(id % 3 AS int) AS grade")
    assert 0 < len(ordinal.sample_rated(many, 3, 400, 1 << 30)[2]) < 600
    assert 0 < len(ordinal.sample_rated(many, 3, 4000, 1500)[2]) < 250


def test_only_sampled_texts_are_joined_with_their_ratings(spark, rated, tmp_path):
    """The join that counts the rated documents moves no text, and the sample
    is that of the joined table."""
    rated.select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    docs, ratings = spark.read.parquet(str(tmp_path / "docs")), rated.select("doc_id", "grade")
    seen = []
    first = type(docs).first
    type(docs).first = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or first(df)
    try:
        got = ordinal.sample_rated(docs, 3, 300, 1 << 20, ratings)
    finally:
        type(docs).first = first
    below = seen[0].split("Join", 1)[1].splitlines()
    assert not any("text#" in x.split("AS key")[0].split("octet_length")[0] for x in below if "Project" in x)
    want = ordinal.sample_rated(rated, 3, 300, 1 << 20)
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and 200 < len(got[2]) < 400
