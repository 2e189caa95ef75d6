"""Fingerprints of short texts, and matching by place."""

import random

import pytest

from quillmark.llm import fingerprints as f


def short(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.mark.parametrize("n", [1, 14, 15, 18, 24])
def test_only_the_empty_text_has_no_anchor(n):
    texts = [short(n, (n, i).__hash__()) for i in range(200)]
    assert all(len(f.sketch(t)) for t in texts) and not len(f.sketch(""))
    assert all(f.likeness(f.sketch(t), f.sketch("")) == 0 and f.likeness(f.sketch(t), f.sketch(t)) == 1 for t in texts)
    if n >= 14:
        assert all(f.likeness(f.sketch(a), f.sketch(b)) == 0 for a, b in zip(texts, texts[1:]))


def test_covered_counts_places_of_all_anchors():
    a, b = short(5000, 1), short(5000, 2)
    share = lambda x, y: f.covered(len(x), f.anchors(x), f.anchors(y))
    assert share(a, a) > 0.9 and share(a, b) == 0 and share("", "") == 1 and share("", a) == 0 and share("abc", "abc") == 1
    changed = a[:2500] + b[:2500]
    hashes, at = f.anchors(a)
    other = set(f.anchors(changed)[0].tolist())
    want = {i for h, p in zip(hashes.tolist(), at.tolist()) if h in other for i in range(p, p + f.K)}
    assert share(a, changed) == len(want) / len(a) and 0.45 < share(a, changed) < 0.51
