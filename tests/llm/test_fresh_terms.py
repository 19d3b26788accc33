"""Levels of a document's terms: one new term for each of its prefixes, whatever the order of the terms."""

import random
from collections import Counter

from riskloom.llm import divergence


def test_every_prefix_of_a_document_counts_once():
    rng = random.Random(3)
    for _ in range(300):
        terms = {bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 60))}
        terms |= {b"a" * n for n in rng.sample(range(1, 60), 5)}
        levels = divergence.fresh_terms(set(terms))
        assert Counter(t for level in levels for t in level) == Counter(terms)
        for k in range(6):
            length = divergence.FIRST * 2 ** k
            new = Counter(t[:length] for level in levels[:k + 1] for t in level)
            assert set(new) == {t[:length] for t in terms} and set(new.values()) == {1}


def test_levels_do_not_depend_on_the_order_of_terms():
    terms = [b"abcdefg", b"abcdef", b"abcdefgh", b"zz", b"abcdefghijklmnop", b"abcdefghijklx"]
    want = [{b"abcdef", b"zz"}, {b"abcdefg", b"abcdefgh", b"abcdefghijklmnop"}, {b"abcdefghijklx"}]
    assert [set(level) for level in divergence.fresh_terms(set(terms))] == want
    assert [set(level) for level in divergence.fresh_terms(set(reversed(terms)))] == want
