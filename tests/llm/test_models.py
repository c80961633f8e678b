"""Brute force of the trained models and of the license alignment."""

import random

import numpy as np

from halogrid.llm import licenses, quality, toxicity
from halogrid.llm.packing import WordIds, best_fit, bin_completion, lower_bound


def test_first_split_is_the_best_of_all(spark):
    """One stump: its cut has the largest gain of every edge of every feature, summed row by row."""
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(200, 5)), 1)
    y = (x[:, 3] + r.normal(0, 0.5, 200) > 0.3).astype(int)
    t = quality.boost(x, y, trees=1, depth=1, bins=16, ridge=2.0, rate=0.5)
    p = (y.sum() + 1) / (len(y) + 2)
    part = lambda rows: sum(y[i] - p for i in rows) ** 2 / (sum(p * (1 - p) for _ in rows) + 2.0)
    gains = {}
    for f in range(5):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])):
            gains[f, c] = part([i for i in range(200) if x[i, f] <= c]) + part([i for i in range(200) if x[i, f] > c])
    assert abs(gains[int(t.feature[0, 0]), float(t.cut[0, 0])] - max(gains.values())) < 1e-9
    left = [i for i in range(200) if x[i, t.feature[0, 0]] <= t.cut[0, 0]]
    assert abs(t.leaf[0, 0] - 0.5 * sum(y[i] - p for i in left) / (len(left) * p * (1 - p) + 2.0)) < 1e-9


def test_flat_trees_equal_a_walk_row_by_row():
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 6))
    x[3] = 0.0
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    t = quality.boost(x, y, trees=12, depth=3)
    for row, got in zip(x, t.score(x), strict=True):
        z = t.base
        for feature, cut, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            i = 0
            while i < len(feature):
                i = 2 * i + (2 if row[feature[i]] > cut[i] else 1)
            z += leaf[i - len(feature)]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12
    assert np.mean((t.score(x) >= 0.5) == y) > 0.9


def test_toxicity_score_from_single_words():
    """A text's logit is the sum over its words of the mean weight of their n-grams, over the words and the neutral ones."""
    r = np.random.default_rng(6)
    model = toxicity.Model(r.normal(size=toxicity.BUCKETS), 0.25)
    texts = [b"", b" \n", b"one", b"Two words", "été, x1; y".encode(), b"word " * 4000]

    def weight(word):
        b = toxicity.bag([word])
        grams = [model.weight[x[i]] for n, x in zip(toxicity.GRAMS, b.buckets, strict=True) for i in range(b.start[0] - 1, b.end[0] + 2 - n)]
        return sum(grams) / len(grams)

    for t, z in zip(texts, model.logit(texts), strict=True):
        own = "".join(chr(c) if 48 <= c < 58 or 97 <= c < 123 or c > 127 else " " for c in t.lower()).encode("latin-1").split()
        assert abs(z - (sum(map(weight, own)) / (len(own) + toxicity.NEUTRAL) + 0.25)) < 1e-9
    empty = model.score([b""])[0]
    assert empty == model.score([b" \t"])[0] == 1 / (1 + np.exp(-0.25))


def test_unseen_misspellings_are_like_the_words():
    r = random.Random(7)
    clean = ["river", "hills", "garden", "paper", "market", "window", "stone", "music"]
    bad = ["horrible", "disgusting", "worthless", "pathetic"]
    text = lambda extra: " ".join(r.choice(clean) for _ in range(20)) + extra
    texts = [text(" " + " ".join(r.choice(bad) for _ in range(4))) for _ in range(60)] + [text("") for _ in range(60)]
    model = toxicity.train([t.encode() for t in texts], np.array([1] * 60 + [0] * 60))
    misspelt = [w[:3] + w[4] + w[3] + w[5:] for w in bad] + [w[:-1] for w in bad]
    assert not set(misspelt) & set(bad)
    base = text("")
    plain = model.logit([base.encode()])[0]
    for w in misspelt:
        assert model.logit([f"{base} {w} {w} {w}".encode()])[0] > plain + 0.2 * (model.logit([f"{base} {bad[0]} {bad[0]} {bad[0]}".encode()])[0] - plain), w


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_against_all_alignments():
    """Words that are unique on both sides: as many aligned as in the best of all alignments.  Any words: a valid one, and no more."""
    r = random.Random(8)
    for trial in range(300):
        if trial % 2:
            a, b = r.sample(range(14), r.randint(0, 12)), r.sample(range(14), r.randint(0, 12))
        else:
            a, b = ([r.randrange(6) for _ in range(r.randint(0, 12))] for _ in "ab")
        pairs = licenses.align([str(x).encode() for x in a], [str(x).encode() for x in b])
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
        assert len(pairs) <= lcs(a, b) and (trial % 2 == 0 or len(pairs) == lcs(a, b))


def test_longest_increasing_against_all_subsets():
    r = random.Random(9)
    for _ in range(200):
        second = r.sample(range(9), r.randint(0, 8))
        got = licenses.increasing(list(enumerate(second)))
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got[:-1], got[1:], strict=True))
        rising = [[second[i] for i in range(len(second)) if m >> i & 1] for m in range(1 << len(second))]
        assert len(got) == max(len(s) for s in rising if s == sorted(s))


def test_ids_of_words_that_defeat_a_hash_modulo_a_power_of_two():
    import public_tokenizers

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for text, got in zip((word, other), ids.ids([word, other]), strict=True):
        assert got.tolist() == [*ids.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_packing_between_the_bound_and_best_fit():
    r = random.Random(10)
    for _ in range(30):
        counts = {r.randint(1, 100): r.randint(1, 60) for _ in range(r.randint(1, 25))}
        found = bin_completion(counts, 100, steps=20_000)
        assert found.bound == lower_bound(counts, 100) <= sum(t for _, t in found.plan) == found.bins <= sum(t for _, t in best_fit(counts, 100))
