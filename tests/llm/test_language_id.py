from __future__ import annotations

import numpy as np

from tabgate.llm import language_id as L

SYLLABLES = {"aa": ["the", "ing", "er", "an", "sh"], "bb": ["sch", "ung", "ü", "ein", "ß"], "cc": ["eau", "é", "tion", "ç", "ou"]}


def make(rng, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(n))


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in L.start_weights(3, 4, 1).items()}
    x = rng.integers(0, 256, (3, 7))
    real = np.ones((3, 7))
    real[2, 4:] = 0
    label = np.array([0, 2, 1])
    _, grads = L.loss_and_gradients(w, x, real, label)
    for name in w:
        flat = w[name].reshape(-1)
        places = np.argsort(-np.abs(grads[name].reshape(-1)))[:4]
        for i in places.tolist():
            old, ends = flat[i], []
            for step in (1e-2, -1e-2):
                flat[i] = old + step
                ends.append(L.loss_and_gradients(w, x, real, label)[0])
            flat[i] = old
            assert abs((ends[0] - ends[1]) / 2e-2 - grads[name].reshape(-1)[i]) < 2e-3


def test_held_out_accuracy_and_defined_results(spark):
    rng = np.random.default_rng(1)
    rows = [(i, make(rng, lang, 40), lang, i, 0.5) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(900, None, "aa", 0, 1.0), (901, "", "aa", 0, 1.0), (902, "12 :)", "bb", 0, 1.0), (903, make(rng, "bb", 9000), None, 0, 1.0)]
    rows += [(904, make(rng, "cc", 30).upper(), "aa", 0, 1.0), (None, make(rng, "aa", 30), "bb", 0, 1.0), (5, rows[5][1], "aa", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out long, score double")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for d in (900, 901, 902):
        assert (by_id[d].lang_pred, by_id[d].score) == ("und", 0.0)
    assert by_id[903].lang_pred == "bb" and by_id[904].lang_pred == "cc" and by_id[None].lang_pred == "aa" and not by_id[None].held_out
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 180]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.95 * len(held) > 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(docs).collect()] == [("und", 0.0)]
    assert L.identify(docs.limit(0)).collect() == []


def test_pooling_covers_whole_texts():
    net = L.fit([(lang, make(np.random.default_rng(i), lang, 12)) for i in range(30) for lang in SYLLABLES], steps=40)
    texts = [b"", b"the ing er" * 50, "ü ß sch".encode() * 100]
    offsets = np.cumsum([0, *map(len, texts)])
    pooled = net.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, p in zip(texts, pooled):
        pieces = [t[i : i + L.PIECE] for i in range(0, len(t), L.PIECE)]
        x, real = L.as_pieces(pieces) if pieces else (np.zeros((0, L.PIECE), np.uint8), np.zeros((0, L.PIECE), np.float32))
        f, _ = L.states(x, real, net.weights["in_f"], net.weights["state_f"], range(L.PIECE), False)
        b, _ = L.states(x, real, net.weights["in_b"], net.weights["state_b"], range(L.PIECE - 1, -1, -1), False)
        want = (L.probabilities(f, b, net.weights) * real.T[:, :, None]).sum(axis=(0, 1)) / max(1, len(t))
        assert np.allclose(p, want, atol=1e-5)
