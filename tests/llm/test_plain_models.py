"""Learnt models against plain formulas, and the exact interplay of their parts on long texts."""

import numpy as np
import pytest
from samples import messages, prose

from restomart.llm import language as L
from restomart.llm import quality as Q
from restomart.llm import shingles as S
from restomart.llm.shingles import shingle_set, word_hashes


def test_discriminant_equals_full_covariance_formulas(spark):
    texts = [(i, prose(i, 20 + i % 50) if i % 3 else f"{prose(i, 9)}!!! 123 {'x ' * (i % 7)}") for i in range(120)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 120, 2)]
    found = {r["id"]: r["score"] for r in Q.score_quality(
        messages(spark, texts), spark.createDataFrame(labels, "id long, quality int")).collect()}
    x = {i: np.array(Q.statistics(t)) for i, t in texts}
    own = [np.array([x[i] for i, y in labels if y == c]) for c in (0, 1)]
    n = [len(c) for c in own]
    scatter = [(c - c.mean(axis=0)).T @ (c - c.mean(axis=0)) for c in own]
    pooled = sum(scatter) / sum(n)
    target = (1 - Q.SHRINK_DIAGONAL) * pooled + Q.SHRINK_DIAGONAL * np.diag(np.diag(pooled))
    covariance = [(1 - Q.SHRINK_POOLED) * s / k + Q.SHRINK_POOLED * target + 1e-6 * np.eye(Q.SIZE) for s, k in zip(scatter, n)]

    def density(v, c):
        away = v - own[c].mean(axis=0)
        return (-0.5 * away @ np.linalg.inv(covariance[c]) @ away - 0.5 * np.linalg.slogdet(covariance[c])[1]
                + np.log(n[c] / sum(n)))

    for i, v in x.items():
        wanted = 1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -700, 700)))
        assert found[i] == pytest.approx(wanted, abs=1e-6)


def plain_ftrl(rows, features, classes, alpha, beta, l1, l2):
    """One coordinate at a time."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + np.sqrt(n[i, c])) / alpha + l2)

    for x, label in rows:
        logit = np.array([sum(v * weight(i, c) for i, v in x.items()) for c in range(classes)])
        p = np.exp(logit - logit.max())
        p /= p.sum()
        for c in range(classes):
            for i, v in x.items():
                g = (p[c] - (c == label)) * v
                sigma = (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / alpha
                z[i, c] += g - sigma * weight(i, c)
                n[i, c] += g * g
    return np.array([[weight(i, c) for c in range(classes)] for i in range(features)])


def test_weights_equal_a_plain_regularised_leader():
    rng = np.random.default_rng(2)
    rows = [({int(i): float(rng.random()) for i in rng.choice(12, 4, replace=False)}, int(rng.integers(3))) for _ in range(60)]
    options = dict(alpha=0.5, beta=1.0, l1=0.05, l2=0.01)
    model = L.Ftrl(12, 3, **options)
    for x, label in rows:
        model.learn(np.array(list(x)), np.array(list(x.values())), label)
    wanted = plain_ftrl(rows, 12, 3, **options)
    assert np.allclose(model.weights(), wanted, atol=1e-9) and (wanted == 0).any()


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 10 ** 6])
def test_long_texts_in_pieces_give_the_same(monkeypatch, piece):
    text = "Één été à la carte, " * 9 + "x" * 50 + prose(3, 40)
    rng = np.random.default_rng(0)
    weights = rng.standard_normal((L.BUCKETS + 1, 4)).astype(np.float32)
    weights[-1] = 0
    model = L.LanguageModel(["a", "b", "c"], weights, np.zeros(3), 1.0)
    whole = model.measures([text, "other"])
    monkeypatch.setattr(L, "CHUNK", piece)
    alone = model.measures([text])
    assert np.allclose(whole[0][0], alone[0][0], atol=1e-4) and np.allclose(whole[1][0], alone[1][0], atol=1e-4)
    hashes, sets = word_hashes(np.frombuffer(text.encode(), np.uint8)), shingle_set(text, 3)
    monkeypatch.setattr(S, "PIECE", min(piece, S.PIECE))
    assert (word_hashes(np.frombuffer(text.encode(), np.uint8)) == hashes).all() and len(hashes) == len(text.split())
    loud = "".join(c.upper() if c.isascii() else c for c in text)
    assert (shingle_set(loud, 3) == sets).all()


def test_signs_that_are_no_letters_have_no_language():
    found = [bool(L._LETTER.search(t)) for t in ("½ ² Ⅷ", "12 + 7", "٣", "ß", "日", "x½")]
    assert found == [False, False, False, True, True, True]
