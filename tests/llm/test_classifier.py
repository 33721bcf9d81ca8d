"""The classifier against its definition: numbers of a text by plain loops, the fit by plain sums, scores from both."""

import random

import numpy as np
import pyarrow as pa
import pytest

from veilwork.llm import classifier
from veilwork.llm.classifier import N_SHAPE, classify, features, fit, matrix

TEXTS = ["", " ", "one", "a b\nA  B\n\nc a b c a b", "Die Löwen, die  Löwen!\nx\ty#", "## $$ %\r\n| a*", "\n".join(["same line"] * 5 + ["other"]), "word " * 700]


def plain_shape(text: str) -> list[float]:
    """Words without case, lines as their words, windows of three words."""
    raw = text.encode()
    words, lines = raw.lower().split(), [tuple(x.lower().split()) for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    return [np.log1p(len(words)), np.log1p(len(lines)), len(set(words)) / n, 1 - len(set(lines)) / m if lines else 0,
            1 - len(set(windows)) / len(windows) if windows else 0, sum(w[-1:] in b"#*$%&!|" for w in words) / n,
            sum(len(w) == 1 for w in words) / n, len(raw) / n / 10, not words]


def buffer(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


@pytest.mark.parametrize("text", TEXTS)
def test_numbers_of_a_text(text):
    got = features(buffer(text))
    assert np.allclose(got[N_SHAPE - 9:N_SHAPE], plain_shape(text))
    raw = text.encode()
    assert np.isclose(got[0], sum(65 <= b <= 90 for b in raw) / max(1, len(raw)))
    words, runs = got[N_SHAPE:N_SHAPE + classifier.BUCKETS], got[N_SHAPE + classifier.BUCKETS:]
    assert np.isclose((words ** 2).sum(), bool(raw.split())) and np.isclose((runs ** 2).sum(), len(raw) > 2)


def test_long_texts_in_steps_have_the_same_numbers():
    rnd = random.Random(3)
    text = "".join(rnd.choice(["Word ", "löwe\n", "x\t", "#! ", "other thing\n", "\r\n"]) for _ in range(4_000))
    for step in (64, 999, 1 << 20):
        assert np.allclose(features(buffer(text), step), features(buffer(text)))
    assert features(buffer("y" * 300), 100)[N_SHAPE - 9] == np.log1p(3)  # a word longer than a step is cut


def test_very_long_text_needs_little_memory():
    import tracemalloc

    data = buffer("some words of a long text, line by line\n" * 400_000)  # 16 MB
    tracemalloc.start()
    features(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(data)


def test_fit_and_scores_by_definition(spark):
    rnd = random.Random(11)
    text = lambda good: " ".join(rnd.choice(["sun", "moon", "Star"] if good else ["moon", "buy#", "win!"]) for _ in range(rnd.randint(3, 40)))
    rows = [(i, text(i % 3 > 0)) for i in range(90)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    learned = [i for i in range(90) if not got[i].held_out]
    x, good = matrix(pa.array([rows[i][1] for i in learned])), np.array([i % 3 > 0 for i in learned])
    order = np.lexsort(x.T)
    mean, scale, weights = fit(x[order], good[order])

    def strength(v):
        return sum(w * max(-8, min(8, (a - m) / s)) * (1 if k < N_SHAPE else classifier.HASHED)
                   for k, (a, m, s, w) in enumerate(zip(v.astype(float), mean, scale, weights)))

    ranked = np.array([strength(v) for v in x])
    cut = np.quantile(ranked, 1 - good.mean())
    # the pairwise loss is near its least: a step along the slope of the whole loss gains next to nothing
    z = classifier.centred(x, mean, scale)
    diff = (z[good][:, None] - z[~good][None]).reshape(-1, z.shape[1])
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean()
    assert loss(weights) < 0.05 < loss(0 * weights)
    for i, t in rows:
        odds = .3 / .7 * np.exp(strength(matrix(pa.array([t or ""]))[0]) - cut)
        assert got[i].score == pytest.approx(odds / (1 + odds), abs=1e-4) and got[i].predicted == (got[i].score >= .3)
    assert all(got[i].predicted == (i % 3 > 0) for i in range(90) if got[i].held_out)
