import math

import numpy as np
import pytest

from veilgraph.llm import langid

EN = "the wind in the hills and the rain on the road with three old friends that were there "
FR = "le vent dans les collines et la pluie sur la route avec trois vieux amis qui étaient là "


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, (EN if i % 2 else FR)[i % 40 :] * 3, "en" if i % 2 else "fr") for i in range(300)] + [(900, None, "en"), (901, "", "fr"), (902, EN, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def net(labelled):
    return langid.fit(labelled, 150)


def test_gradients():
    net = langid.Network.fresh(["a", "b", "c"], units=3)
    for w in net.weights():
        w[...] = w.astype(np.float64)
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (5, 9)).astype(np.uint8)
    lengths, labels = np.array([9, 9, 4, 1, 7]), np.array([0, 1, 2, 1, 0])
    mask = (np.arange(9)[:, None] < lengths).astype(np.float32)

    def loss():
        p = np.stack(list(langid._probabilities(net, windows.T, mask)))
        return -(np.log(p[:, labels, np.arange(5)].astype(np.float64)) * mask).sum() / mask.sum()

    grads = langid._gradients(net, np.ascontiguousarray(windows.T), mask, labels, 3)
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.03, abs=1e-4)


def test_identify(spark, net):
    rows = [(1, EN, 1), (2, FR * 50, 1), (3, None, 1), (4, "", 1), (5, "123 !? \n", 1), (None, EN, 1), (1, EN, 1), (6, "é" * 3000, 1), (7, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE int")
    out = langid.identify(df, net)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, EN][0] == "en" and got[None, EN] == got[1, EN] and got[2, FR * 50][0] == "fr"
    assert all(got[k] == ("und", 0.0) for k in [(3, None), (4, ""), (5, "123 !? \n")])
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(df.where("1 = 0"), net).collect() == []
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_pooled_is_the_mean_of_positions(net):
    import pyarrow as pa

    for text in [EN, "é", "ab" * 64, "a" * 65]:
        labels = langid.label_positions(net, text)
        assert len(labels) == len(text.encode())
        raw, at = langid.raw_text(pa.array([text, "zz", text]))
        p = langid.pooled(net, raw, at)
        assert p.sum(axis=1) == pytest.approx(1, abs=1e-4)
        assert p[0] == pytest.approx(p[2], abs=1e-5)


def plain_positions(net, text):
    """The network's probabilities at every byte, by scalar loops."""
    data = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    units, out = net.states[0].shape[1], []
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def run(side, piece):
        x, u, h, states = net.inputs[side].tolist(), net.states[side].tolist(), [0.0] * units, []
        for byte in piece:
            into = [sum(u[i][j] * h[j] for j in range(units)) for i in range(3 * units)]
            z = [sigmoid(x[i][byte] + into[i]) for i in range(units)]
            r = [sigmoid(x[units + i][byte] + into[units + i]) for i in range(units)]
            n = [math.tanh(x[2 * units + i][byte] + r[i] * into[2 * units + i]) for i in range(units)]
            h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(units)]
            states.append(h)
        return states

    for at in range(0, len(data), langid.WINDOW):
        piece = data[at : at + langid.WINDOW]
        ahead, back = run(0, piece), run(1, piece[::-1])[::-1]
        for a, b in zip(ahead, back, strict=True):
            e = [math.exp(sum(w * v for w, v in zip(row, a + b, strict=True)) + float(c[0])) for row, c in zip(net.out.tolist(), net.bias, strict=True)]
            out.append([v / sum(e) for v in e])
    return out


def test_against_plain_loops(spark, net):
    texts = [EN, FR.upper() + "é!", "x", "a" * 65, "Ж" * 40 + EN]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for k, text in enumerate(texts):
        p = plain_positions(net, text)
        means = [sum(c) / len(p) for c in zip(*p, strict=True)]
        assert got[k].score == pytest.approx(max(means), abs=1e-4)
        assert got[k].lang_pred == net.languages[means.index(max(means))]
        labels = langid.label_positions(net, text)
        assert [s for _, s in labels] == pytest.approx([max(x) for x in p], abs=1e-4)


def test_sample_is_bounded_and_whole(spark, labelled):
    languages, windows, lengths, labels = langid.sample_windows(labelled, 20, 1 << 30)
    assert languages == ["en", "fr"] and len(windows) <= 2 * 60 * 5
    again = labelled.unionByName(labelled).unionByName(labelled)
    assert len(langid.sample_windows(again, 10_000, 1 << 30)[1]) == len(langid.sample_windows(labelled, 10_000, 1 << 30)[1])
    assert len(langid.sample_windows(labelled, 10_000, 10_000)[1]) * langid.WINDOW < 20_000
    assert langid.fit(labelled.where("lang is null")) is None
    long = " ".join(f"mot{k}" for k in range(5000))
    rows = [(1, long, "fr"), (2, "ab", "en"), (2, "ab", "en")]
    languages, windows, lengths, labels = langid.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 600, 1 << 30)
    whole = [b"".join(w[:n].tobytes() for w, n, y in zip(windows, lengths, labels, strict=True) if y == k) for k in range(2)]
    assert whole == [b"ab", long.encode()]


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(i, "text " * 5, f"l{i % 7}") for i in range(20)]
    assert langid.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 600, 1 << 30)[0] == ["l0", "l1", "l2"]


def test_held_out_accuracy(spark):
    got = langid.op4_langid(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
