"""The learned models against plain versions: mixtures by single steps, trees by every split."""

import math
import random

import numpy as np

from leafwork.llm import language_mix, quality


def plain_mixture(likes, rounds):
    """Expectation-maximisation of one text's segments, then languages taken out one by one."""
    n, k = len(likes), len(likes[0])

    def fit(member):
        shares = [m / sum(member) for m in member]
        for _ in range(rounds):
            new = [0.0] * k
            for row in likes:
                total = max(sum(a * s for a, s in zip(row, shares, strict=True)), 1e-300)
                for j in range(k):
                    new[j] += row[j] * shares[j] / total / n
            shares = new
        return shares, sum(math.log(max(sum(a * s for a, s in zip(row, shares, strict=True)), 1e-300)) for row in likes)

    member = [s > 1e-6 for s in fit([True] * k)[0]]
    shares, fitness = fit(member)
    while sum(member) > 1:
        weakest = min((j for j in range(k) if member[j]), key=lambda j: shares[j])
        less = [m and j != weakest for j, m in enumerate(member)]
        fewer, worse = fit(less)
        if worse + math.log(max(n, 2)) / 2 < fitness:
            break
        member, shares, fitness = less, fewer, worse
    return shares, member


def test_mixtures_equal_single_steps():
    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes, k = rng.integers(1, 12, rng.integers(1, 6)), int(rng.integers(1, 5))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        likes = rng.random((len(owner), k)) ** rng.integers(1, 30)
        likes /= likes.max(axis=1, keepdims=True)
        shares, member = language_mix._mixtures(likes, owner, len(sizes), 15)
        for t in range(len(sizes)):
            want, chosen = plain_mixture(likes[owner == t].tolist(), 15)
            assert np.allclose(shares[t], want, atol=1e-9) and member[t].tolist() == chosen


def test_predictions_follow_single_steps_on_texts():
    model = language_mix.LanguageModel(["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(language_mix.BUCKETS), 2).T).astype(np.float32))
    texts = ["one two three four five six seven eight nine ten " * 20, "ab cd", "zyx " * 100]
    got = language_mix.mixtures(texts, model)
    for text, shares in zip(texts, got, strict=True):
        grams, _ = language_mix.trigrams([text])
        pieces = max(1, len(grams) // language_mix.SEGMENT)
        likes = []
        for p in range(pieces):
            part = grams[p * language_mix.SEGMENT : (p + 1) * language_mix.SEGMENT if p < pieces - 1 else None]
            logs = model.log_rates[part].astype(np.float64).sum(axis=0)
            likes.append(np.exp(np.maximum(logs - logs.max(), -60)).tolist())
        assert np.allclose(shares, plain_mixture(likes, 20)[0], atol=1e-3)


def best_split(codes, gradient, weight, wide, ridge):
    """(gain, feature, cut) of the best of all splits; the first one, of equal gains."""
    best = (0.0, 0, wide)
    g_all, h_all = sum(gradient), sum(weight)
    for k in range(codes.shape[1]):
        for cut in range(wide):
            left = codes[:, k] <= cut
            g, h = float(gradient[left].sum()), float(weight[left].sum())
            if h < 1 or h_all - h < 1:
                continue
            gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, k, cut)
    return best


def test_one_tree_takes_the_best_of_all_splits():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        rows = np.round(rng.normal(size=(80, 3)), 1)
        labels = (rows[:, seed % 3] + 0.5 * rng.normal(size=80) > 0).astype(int)
        bins, ridge, rate = 8, 2.0, 0.15
        model = quality.fit(rows, labels, trees=1, depth=2, bins=bins, rate=rate, ridge=ridge)
        codes = model.binned(rows).astype(int)
        chance = 1 / (1 + math.exp(-model.start))
        gradient, weight = labels - chance, np.full(80, chance * (1 - chance))
        gain, k, cut = best_split(codes, gradient, weight, bins + 1, ridge)
        assert gain > 0 and (model.feature[0, 0], model.cut[0, 0]) == (k, cut)
        right = codes[:, k] > cut
        total = np.full(80, model.start)
        for side, inside in enumerate((~right, right)):
            gain, k2, cut2 = best_split(codes[inside], gradient[inside], weight[inside], bins + 1, ridge)
            assert (model.feature[0, 1 + side], model.cut[0, 1 + side]) == (k2, cut2)
            lower = codes[:, k2] > cut2
            for part in (inside & ~lower, inside & lower):
                total[part] += rate * gradient[part].sum() / (weight[part].sum() + ridge)
        assert np.allclose(model.score(rows), 1 / (1 + np.exp(-total)))


def test_traversal_equals_walking_each_tree():
    rng = random.Random(2)
    data = np.random.default_rng(3)
    rows, labels = data.normal(size=(300, 4)), data.integers(0, 2, 300)
    model = quality.fit(rows, labels, trees=10, depth=3, bins=16)
    codes = model.binned(rows)
    for i in rng.sample(range(300), 40):
        total = model.start
        for t in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(codes[i, model.feature[t, node]] > model.cut[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        assert abs(model.score(rows[i : i + 1])[0] - 1 / (1 + math.exp(-total))) < 1e-9
