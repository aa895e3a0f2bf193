"""Keys of linked sets that agree in no segment but empty ones."""

import numpy as np
import pytest

from urbanweave.llm.arrays import mix
from urbanweave.llm.ngram_jaccard import _keys, bands


def keys_of(tokens, band, segments, double):
    tokens = np.sort(tokens)
    return set(_keys(tokens, np.array([len(tokens)]), np.array([band]), segments, double)[0].tolist())


def segments_of(tokens, band, m):
    return (mix(tokens + np.array([band], np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(int)


@pytest.mark.parametrize("band", [12, 17, 18, 20, 22])
def test_sets_that_agree_only_in_empty_segments_share_a_key(band):
    first, segments, double = bands(8, 10, 4096)
    m, size = int(segments[band]), int(first[band + 1]) - 1
    rng = np.random.default_rng(band)
    met = 0
    for _ in range(60):
        a = rng.integers(0, 2**63, size=size, dtype=np.uint64)
        # Some further segments are emptied, as by chance in few sets.
        where = segments_of(a, band, m)
        a = a[~np.isin(where, rng.choice(m, size=rng.integers(0, 4), replace=False))]
        where = segments_of(a, band, m)
        used = np.unique(where)
        if len(used) == m:
            continue
        # Every used segment loses one token or gains one, so that no used segment agrees;
        # one segment in all that the pigeonhole allows more than 1 to loses another.
        b = [np.delete(a[where == s], 0) if rng.random() < 0.5 else a[where == s] for s in used]
        spare = rng.integers(0, 2**63, size=40 * m, dtype=np.uint64)
        spot = segments_of(spare, band, m)
        for i, s in enumerate(used):
            if len(b[i]) == (where == s).sum():
                b[i] = np.append(b[i], spare[spot == s][0])
        room = m - 1 - len(used)
        for i in rng.permutation(len(used))[:room]:
            b[i] = np.append(b[i], spare[spot == used[i]][1])
        b = np.concatenate(b)
        assert len(np.setxor1d(a, b)) <= m - 1
        assert keys_of(a, band, segments, double) & keys_of(b, band, segments, double)
        met += 1
    assert met > 10


def test_no_key_of_a_single_empty_segment():
    """Sets that share nothing seldom share a key, even if both have the same empty segment."""
    first, segments, double = bands(8, 10, 4096)
    rng = np.random.default_rng(5)
    size = int(first[20])
    found = [keys_of(rng.integers(0, 2**63, size=size, dtype=np.uint64), 20, segments, double) for _ in range(200)]
    assert sum(bool(found[i] & found[j]) for i in range(200) for j in range(i)) < 2000
