"""The network's gradients, its accuracy on rows that it hasn't seen, and odd cases."""

import math
import zlib

import numpy as np

from ledgerspark.llm import langid


def test_gradients_are_those_of_the_loss():
    net = langid.Network(["a", "b", "c"], langid.Settings(hidden=3))
    codes, target = np.random.default_rng(0).integers(0, 256, (5, 4)), np.array([0, 1, 2, 0])

    def loss():
        p = net.probabilities(codes)
        return -np.mean([[np.log(p[target[lane], t, lane]) for lane in range(4)] for t in range(5)])

    gradients = net.gradients(codes, target)
    for name in net.weights:
        at = (4, codes[2, 1]) if name[0] == "E" else (1, 0)
        w, step = net.weights[name], 1e-2
        old = w[at]
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - gradients[name][at]) < 2e-3, name


def plain(net, text):
    """Probabilities at each byte of one window, number by number from the textbook's equations."""
    w, h = net.weights, net.settings.hidden
    sigma = lambda v: 1 / (1 + math.exp(-v))

    def states(d, codes):
        state, out = [0.0] * h, []
        for code in codes:
            through = [sum(float(w[f"U{d}"][r, k]) * state[k] for k in range(h)) + float(w[f"c{d}"][r, 0]) for r in range(3 * h)]
            into = [float(w[f"E{d}"][r, code]) for r in range(3 * h)]
            update = [sigma(into[k] + through[k]) for k in range(h)]
            reset = [sigma(into[h + k] + through[h + k]) for k in range(h)]
            candidate = [math.tanh(into[2 * h + k] + reset[k] * through[2 * h + k]) for k in range(h)]
            state = [update[k] * state[k] + (1 - update[k]) * candidate[k] for k in range(h)]
            out.append(state)
        return out

    forth, back, out = states("f", text), states("b", text[::-1])[::-1], []
    for f, b in zip(forth, back):
        z = [sum(float(w["Of"][c, k]) * f[k] + float(w["Ob"][c, k]) * b[k] for k in range(h)) + float(w["o"][c, 0]) for c in range(len(net.languages))]
        e = [math.exp(v) for v in z]
        out.append([v / sum(e) for v in e])
    return np.array(out)


def test_network_is_that_of_the_equations():
    net = langid.trained([b"aba abab", b"cdc dcdc"] * 4, ["x", "y"] * 4, langid.Settings(window=8, steps=5, batch=8))
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (8, 5))
    p = net.probabilities(codes.astype(np.intp))
    for lane in range(5):
        assert np.allclose(p[:, :, lane].T, plain(net, codes[:, lane].tolist()), atol=1e-4)
    text = bytes(range(60, 84))
    assert np.allclose(langid.pooled(net, [text])[0], np.mean([plain(net, list(text[k : k + 8])) for k in (0, 8, 16)], axis=(0, 1)), atol=1e-4)


def test_windows_come_from_whole_texts(spark):
    docs = spark.createDataFrame([(i, "a" * 5_000 + "b" * 5_000 + "c" * 5_000, "x", "y") for i in range(1, 60)] + [(100, "short", "x", "y"), (101, "", "x", "z")], "doc_id long, text string, lang string, cuts string")
    texts, labels = langid.training_sample(docs, langid.Settings(sample_rows=40))
    found = b"".join(texts)
    assert min(found.count(c) for c in (b"a", b"b", b"c")) > len(found) / 6 and max(map(len, texts)) == langid.Settings().window and set(labels) == {"x"}


def test_pooling_counts_each_byte_once():
    net = langid.Network(["a", "b"], langid.Settings(window=8, lanes=3))
    texts = [b"abc", b"abcdefgh", b"abcdefghij", bytes(range(65, 100))]
    got = langid.pooled(net, texts)
    for text, p in zip(texts, got):
        n, total = len(text), np.zeros(2)
        begins = [0] if n <= 8 else [*range(0, n - 7, 8)] + ([n - 8] if n % 8 else [])
        seen = set()
        for begin in begins:
            codes = np.frombuffer(text[begin : begin + 8].ljust(8), np.uint8).astype(np.intp)[:, None]
            q = net.probabilities(codes)[:, :, 0]
            for t in range(8):
                if begin + t < n and begin + t not in seen:
                    seen.add(begin + t)
                    total += q[:, t]
        assert np.allclose(p, total / n, atol=1e-5) and abs(p.sum() - 1) < 1e-4


def test_held_out_accuracy(documents):
    rows = {r.doc_id: r for r in langid.identified(documents).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert rows.keys() == truth.keys()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i in rows if rows[i].held_out and truth[i]]
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.9


def test_prediction_sees_only_the_text(documents):
    net = langid.fitted(documents)
    a = {r.doc_id: r.lang_pred for r in langid.predicted(documents, net).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.predicted(documents.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source"), net).collect()}
    assert a == b


def test_odd_cases(spark, odd, nothing):
    rows = langid.identified(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id}
    assert all(by[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert by[5][0] == "en" and by[7][0] == "en" and by[13] == by[14]
    assert langid.identified(nothing).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in langid.identified(unlabelled).collect()} == {"und"}
    kept = langid.accepted(odd, langid.fitted(odd), 0.3)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {5, 13, 14} and kept.where("doc_id IN (1, 2, 3, 4)").isEmpty()


def test_letters():
    assert langid.has_letter("1 é") and langid.has_letter("½ a") and not langid.has_letter("½ ² 12 _") and langid.has_letter("日")
