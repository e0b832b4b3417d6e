"""Copies of the points: as many as there are bands, however many points there are."""

import numpy as np
import pyarrow as pa

from themeloom.operators import silhouette as S


def test_points_move_once_a_band_and_bands_stop_growing():
    assert [S._bands(n) for n in (1, 9, 32, 600, 1024, 2048)] == [1, 9, 32, 32, 32, 64]


def batch(band, passing, x, cluster, copies):
    n = len(x)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([band] * n, pa.int32()), pa.array([passing] * n, pa.int32()), pa.array([2**60 + i for i in range(n)]),
            pa.array(cluster, pa.int32()), pa.array(copies, pa.int64()), pa.array([list(v) for v in x], pa.list_(pa.float64())),
        ],
        names=["band", "passing", "key", "cluster", "copies", "f"],
    )


def test_a_band_takes_all_points_batch_by_batch():
    rng = np.random.default_rng(3)
    x, cluster, copies = rng.normal(size=(50, 4)), rng.integers(0, 3, 50).tolist(), rng.integers(1, 4, 50)
    stream = [batch(0, 0, x[:20], cluster[:20], copies[:20]), batch(0, 0, x[20:25], cluster[20:25], copies[20:25])]
    stream += [batch(0, 1, x[i : i + 7], cluster[i : i + 7], copies[i : i + 7]) for i in range(0, 50, 7)]
    stream += [batch(3, 0, x[25:], cluster[25:], copies[25:]), batch(3, 1, x, cluster, copies)]
    got = pa.Table.from_batches(list(S._band_sums(iter(stream)))).to_pandas()
    assert len(got) == 50 * 3 and got["key"].min() == 2**60
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for label, rows in got.groupby("other"):
        mine = np.array(cluster) == label
        assert set(rows["n"]) == {int(copies[mine].sum())}
        assert np.allclose(sorted(rows["total"]), sorted(distance[:, mine] @ copies[mine]))
