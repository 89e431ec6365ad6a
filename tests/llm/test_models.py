"""The fitted models against independent computations: noisy-or and its gradient, and the rates of the mix."""

import math

import numpy as np
import pytest

from codegauge.llm import source_mix, toxicity


def test_noisy_or_likelihood_and_gradient():
    texts = ["you are bad. fine day\nawful thing", "fine day", "", None, "bad bad bad. good", "a good day! bad luck"]
    labels = [1, 0, 0, 1, 1, 0]
    words = sorted({p for t in texts for w in (t or "").split() for p in toxicity.parts_of(w.strip(".!"))})
    number = {p: i for i, p in enumerate(words)}
    rng = np.random.default_rng(1)
    w, bias = rng.normal(0, 0.4, len(number)), -0.7
    bags = toxicity.Bags(texts, labels, number)

    def chance(text):
        none = 1.0
        for words in toxicity.bag_of(text) or [[]]:
            z = bias + sum(w[number[p]] for x in words for p in toxicity.parts_of(x))
            none *= 1 - 1 / (1 + math.exp(-z))
        return 1 - none

    want = sum(0.5 / labels.count(y) * math.log(chance(t) if y else 1 - chance(t)) for t, y in zip(texts, labels))
    assert bags.likelihood(w, bias) == pytest.approx(want)
    gw, gb = bags.gradient(w, bias)
    for i in [*rng.choice(len(w), 25), None]:
        up, down = (w + d * (np.arange(len(w)) == i) if i is not None else w for d in (1e-5, -1e-5))
        rise = (bags.likelihood(up, bias + 1e-5 * (i is None)) - bags.likelihood(down, bias - 1e-5 * (i is None))) / 2e-5
        assert (gb if i is None else gw[i]) == pytest.approx(rise, rel=1e-4, abs=1e-7)


def test_scores_are_noisy_or_of_sentences():
    model = ({"<bad>": 3.0, "awfu": 1.5, "wful": 0.25}, -2.0)
    spans, p = toxicity.Scorer(model)("Bad day. so awful! fine")
    z = [-2 + 3, -2 + 1.75, -2]
    assert len(spans) == 3 and p == pytest.approx([1 / (1 + math.exp(-x)) for x in z])
    assert toxicity.noisy_or(p) == pytest.approx(1 - math.prod(1 - x for x in p))


def test_joined_up_text_is_read():
    model = ({"awfu": 4.0, "wful": 1.0, "<" + "x" * 3: 0.5}, -3.0)
    for n in (10, 199, 200, 5000):
        _, p = toxicity.Scorer(model)("x" * n + "awful" + "y" * n)
        assert p == pytest.approx([1 / (1 + math.exp(-(-3 + 5 + 0.5)))])


def test_rates_against_an_independent_solve(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{i % 7}" if i % 11 else None) for i in range(900)]
    rows += [(1000 + i, "w " * 40, "s1") for i in range(400)]  # a hot size of a large source
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    inner = 0
    for rs in by.values():
        total = sum(r.size for r in rs)
        target = rs[0].target
        assert sum(r.size * r.rate for r in rs) == pytest.approx(target, rel=1e-6)
        if target < 2.99 * total:
            inner += 1
            # The tilt is exponential in the size: log(2 r / (3 - r)) / size is one number, here found by bisection.
            low, high = -50.0, 50.0
            for _ in range(200):
                mid = (low + high) / 2
                words = sum(r.size * 3 / (1 + 2 * math.exp(-max(-500, min(500, mid * r.size)))) for r in rs)
                low, high = (mid, high) if words < target else (low, mid)
            for r in rs:
                if r.size:
                    assert r.rate == pytest.approx(3 / (1 + 2 * math.exp(-max(-500, min(500, low * r.size)))), rel=1e-5)
        assert abs(sum(r.taken for r in rs) - target) <= 60 and all(r.taken <= 3 * r.size for r in rs)
    assert inner >= 3


def test_capitals_are_letters_of_the_class_lu():
    import unicodedata

    from codegauge.llm import quality_rules

    text = "".join(chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000)
    assert quality_rules.Text(text).n_upper == sum(unicodedata.category(c) == "Lu" for c in text)
