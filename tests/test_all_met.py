"""Where bounds tell nothing, rows are not sent to every cell."""

import numpy as np
import pytest

from quillmark.operators import metric
from tests.test_metric import brute, frame, joined


@pytest.mark.parametrize("blocks", [False, True])
def test_random_vectors_are_not_sent_to_every_cell(spark, monkeypatch, blocks):
    """Copies, ties and points far from the origin; no query is sent to cells, and the rows are those of brute force."""
    for name, value in (("CELL_ROWS", 4), ("RING", 5), ("CHUNK", 3), ("SIDE_ROWS", 80), ("PRODUCT", (7, 16))):
        monkeypatch.setattr(metric, name, value)
    monkeypatch.setattr(metric._Space, "within", lambda *_: pytest.fail("queries are sent to cells"))
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(130, 40)), np.zeros((6, 40)), np.eye(40)[:20]]) + 1e3
    block = [0 if i % 4 else None for i in range(len(x))] if blocks else None
    assert joined(frame(spark, x, None, block), 3, "bin_id" if blocks else None) == brute(x, list(range(len(x))), block, 3)
