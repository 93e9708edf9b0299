"""Dense layers on chunks against the row-wise layers and NumPy."""

import numpy as np
import pytest

from voxframe.operators import chunked, nn

SHAPE, CHUNK = (5, 9, 7), (2, 4, 4)


def rows_of(spark, a):
    at = np.argwhere(np.ones(a.shape, bool))
    return spark.createDataFrame([(*map(int, i), float(a[tuple(i)])) for i in at], "c int, z int, y int, x int, v double")


def dense(spark, a, chunk=CHUNK):
    return chunked.from_voxels(rows_of(spark, a), len(a), a.shape[1:], chunk)


def array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        out[r["c"], r["z"], r["y"], r["x"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(2).normal(size=(4, *SHAPE))


def kernel(out, into, size=(-1, 0, 1)):
    rng = np.random.default_rng(out + into)
    return [(o, c, z, y, x, float(rng.normal())) for o in range(out) for c in range(into) for z in size for y in size for x in size]


@pytest.mark.parametrize("chunk", [CHUNK, (5, 9, 7), (1, 3, 2)])
def test_convolution(spark, data, chunk):
    k = kernel(3, 4)
    got = array(chunked.to_voxels(chunked.conv3d(dense(spark, data, chunk), chunked.kernel_array(k, -1), chunk)), (3, *SHAPE))
    assert np.allclose(got, array(nn.conv3d(rows_of(spark, data), k), (3, *SHAPE)))
    pad = np.pad(data, ((0, 0), (1, 1), (1, 1), (1, 1)))
    assert np.allclose(got, chunked.convolved(pad, chunked.kernel_array(k, -1)))


def test_margins(spark, data):
    pad = np.pad(data, ((0, 0), (1, 1), (3, 3), (2, 2)))
    boxes = chunked.with_margin(dense(spark, data), CHUNK, (1, 3, 2)).collect()
    assert len(boxes) == 3 * 3 * 2
    for r in boxes:
        lo = [r["oz"] + 1, r["oy"] + 3, r["ox"] + 2]
        to = (slice(None), *[slice(a, a + n) for a, n in zip(lo, (r["sz"], r["sy"], r["sx"]))])
        assert np.array_equal(np.frombuffer(r["data"]).reshape(4, r["sz"], r["sy"], r["sx"]), pad[to])
    with pytest.raises(ValueError):
        chunked.with_margin(dense(spark, data), CHUNK, (3, 0, 0))


def test_shuffle_grows_with_faces(spark):
    a = np.zeros((1, 32, 32, 32))
    sent = chunked.with_margin(dense(spark, a, (16, 16, 16)), (16, 16, 16), (1, 1, 1))
    assert sum(r["sz"] * r["sy"] * r["sx"] for r in sent.collect()) == 8 * 18**3  # 1.42 times the voxels, for any channels


def test_layers(spark, data):
    chunks = dense(spark, data)
    pooled = chunked.max_pool3d(chunks, (1, 2, 2), CHUNK)
    assert np.array_equal(array(chunked.to_voxels(pooled), (4, 5, 4, 3)), array(nn.max_pool3d(rows_of(spark, data), (1, 2, 2), SHAPE), (4, 5, 4, 3)))
    up = kernel(2, 4, (0, 1))
    grown = chunked.to_voxels(chunked.conv_transpose3d(chunks, chunked.kernel_array(up), 0.5))
    assert np.allclose(array(grown, (2, 10, 18, 14)), array(nn.conv_transpose3d(rows_of(spark, data), up, (2, 2, 2), 0.5), (2, 10, 18, 14)))
    normed = chunked.to_voxels(chunked.group_norm(chunks, 4, 2, rectify=True))
    assert np.allclose(array(normed, data.shape), array(nn.relu(nn.group_norm(rows_of(spark, data), 4, 2)), data.shape))
    both = array(chunked.to_voxels(chunked.concat_channels(chunks, chunks)), (8, *SHAPE))
    assert np.array_equal(both, np.concatenate((data, data)))
    w, b = np.array([[1.0, -1, 0.5, 2]]), np.array([0.25])
    assert np.allclose(array(chunked.to_voxels(chunked.heads(chunks, w, b)), (1, *SHAPE)), np.tensordot(w, data, 1) + 0.25)
    with pytest.raises(ValueError):
        chunked.max_pool3d(chunks, (2, 3, 2), CHUNK)


def test_norm_of_large_numbers(spark):
    a = 1e8 + np.random.default_rng(0).normal(size=(2, 4, 4, 4))
    got = array(chunked.to_voxels(chunked.group_norm(dense(spark, a), 2, 1)), a.shape)
    assert np.allclose(got, (a - a.mean()) / np.sqrt(a.var() + 1e-3), atol=1e-5)


def test_empty_chunks_and_models(spark, data):
    none = chunked.from_voxels(rows_of(spark, data).where("z > 99"), 4, SHAPE, CHUNK)
    assert none.count() == 18 and (array(chunked.to_voxels(none), data.shape) == 0).all()

    def make():
        calls = []

        def model(a):
            calls.append(1)
            return np.full((1, *[n - 2 for n in a.shape[1:]]), float(len(calls)))

        return model

    out = chunked.predict(dense(spark, data).coalesce(1), make, CHUNK, (1, 2, 1))
    got = array(chunked.to_voxels(out.coalesce(1)), (1, *SHAPE))
    assert got.max() > 1  # one model saw several chunks
    assert chunked.made_once("k", make) is chunked.made_once("k", make)
