"""Training rows are put in order in place."""

import numpy as np

from quillmark.llm import language_id


def test_rows_in_order_in_place():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 50):
        x, order = rng.normal(size=(n, 3)), list(rng.permutation(n))
        want = x[order].copy()
        language_id._permute(x, order)
        assert (x == want).all()
