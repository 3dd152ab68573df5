"""EPIG holds one tile's products, whatever the number of targets."""

import tracemalloc

import numpy as np

from tidepool.operators import acquisition as acq


def _peak_and_sums(n_targets):
    rnd = np.random.default_rng(3)
    P, Q = rnd.random((300, 4)), rnd.random((n_targets, 4))
    tracemalloc.start()
    try:
        s = acq._epig_sums(P, Q)
        return tracemalloc.get_traced_memory()[1], s, P, Q
    finally:
        tracemalloc.stop()


def test_sums_over_tiles_equal_the_whole_block():
    _, s, P, Q = _peak_and_sums(5000)
    np.testing.assert_allclose(s, acq._epig_block(P, P.mean(axis=1), Q, Q.mean(axis=1)), rtol=1e-9)
    assert (acq._epig_sums(P, Q[:0]) == 0).all() and len(acq._epig_sums(P[:0], Q)) == 0


def test_memory_does_not_grow_with_the_targets():
    few, many = _peak_and_sums(10_000)[0], _peak_and_sums(40_000)[0]
    assert many < few + 8 * 40_000 * 4  # means and views of the targets, no products of all of them
    assert many < 60e6
