"""The forward algorithm against an enumeration of every segmentation."""
import itertools
import math

import numpy as np

from basketry.llm import language_id

MARK = language_id.MARK


def _sum_of_cuts(word, probability, lone):
    """Sum over all ways to cut ``word`` into pieces or lone bytes, by trying every set of cuts."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        product = 1.0
        for a, b in zip(edges, edges[1:]):
            part = word[a:b]
            product *= probability.get(part, 0.0) + (lone if len(part) == 1 else 0.0)
        total += product
    return total


def _case():
    texts = sorted([MARK, MARK + b"a", MARK + b"ab", b"a", b"ab", b"b", b"ba", b"abab", "é".encode()])
    rng = np.random.default_rng(3)
    table = rng.uniform(0.01, 0.3, (len(texts) + 1, 2))
    return texts, language_id.Pieces(texts), table


def test_probability_is_the_sum_over_all_segmentations():
    texts, pieces, table = _case()
    words = [b"a", b"ab", b"abab", b"babab", b"zz", b"az", "abé".encode(), b"ababab"]
    got = language_id.log_probabilities(pieces, table, words)
    for k in range(2):
        probability = {t: table[i, k] for i, t in enumerate(texts)}
        want = [math.log(_sum_of_cuts(MARK + w, probability, table[-1, k])) for w in words]
        np.testing.assert_allclose(got[:, k], want, rtol=1e-10)


def test_expected_uses_are_the_slopes_of_the_log_probability():
    """A piece's expected uses are the derivative of the log probability by the log of its value."""
    _, pieces, table = _case()
    words, language, count = [b"abab", b"bab", b"az"], np.array([0, 1, 0]), np.array([2.0, 1.0, 3.0])
    got = language_id.expected_counts(pieces, table, words, language, count)

    def value(t):
        return sum(n * language_id.log_probabilities(pieces, t, [w])[0, k] for w, k, n in zip(words, language, count))

    for i, k in itertools.product(range(len(table)), range(2)):
        up, down = table.copy(), table.copy()
        up[i, k] *= math.exp(1e-5)
        down[i, k] *= math.exp(-1e-5)
        assert abs((value(up) - value(down)) / 2e-5 - got[i, k]) < 1e-5
