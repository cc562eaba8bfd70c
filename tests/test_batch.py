"""Scores of many pairs at once equal the scores of single pairs."""

import random

import numpy as np
import pytest

from kinmatch.functions import batch, similarity


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcd efg हिन्दी") for _ in range(k))
    xs = ["", "", "a b", "b a", "é", "a" * 600] + [word(rng.choice([0, 1, 2, 5, 20, 30, 63, 64, 65, 70, 130])) for _ in range(n)]
    ys = ["", "a", "b a", "b a", "é", "ab" * 300]
    for x in xs[len(ys) :]:
        y = list(x)
        for _ in range(rng.randrange(4)):
            if y:
                y[rng.randrange(len(y))] = rng.choice("abxyz ")
        ys.append("".join(y)[rng.randrange(3) :] + word(rng.randrange(4)) if rng.random() < 0.7 else word(rng.choice([0, 1, 3, 10, 40, 64, 66, 100])))
    return xs, ys


@pytest.mark.parametrize("scorer", list(similarity.SCORERS))
def test_batch_equals_single(scorer):
    xs, ys = texts(5, 400)
    want = [similarity.SCORERS[scorer](x, y) for x, y in zip(xs, ys)]
    assert np.allclose(batch.SCORERS[scorer](xs, ys), want, atol=1e-9)
    assert len(batch.SCORERS[scorer]([], [])) == 0
