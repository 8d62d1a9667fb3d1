"""Kernels for pixels on values that stand between two."""

import duckdb
import numpy as np
import pyarrow as pa

from photonest.functions.pixels import dhash
from photonest.plans.queries import ORACLE_SQL


def test_hash_of_halves_is_that_of_the_sql():
    """Rows whose pixels pair up to one odd sum have a half in their middle, beside which the neighbours are close."""
    rng = np.random.default_rng(5)
    left = rng.integers(90, 130, (200, 8, 4))
    total = rng.integers(190, 240, (200, 8, 1)) | 1
    levels = np.concatenate([left, (total - left)[..., ::-1]], axis=2).reshape(200, 64).repeat(3, axis=0)  # three alike are one gray image
    vectors = pa.array(((levels + 0.5) / 255 * 1.1 - 0.55).astype(np.float32).tolist(), pa.list_(pa.float32()))
    duck = duckdb.connect()
    duck.register("embeddings", pa.table({"vec_id": np.arange(600), "embedding": vectors}))
    want = dict(duck.execute(ORACLE_SQL["perceptual_hash"]).fetchall())
    for i in range(600):
        rgb = np.stack([levels[(i + k) % 600] for k in range(3)], axis=1).reshape(8, 8, 3)
        assert dhash(rgb) == want[i], i
