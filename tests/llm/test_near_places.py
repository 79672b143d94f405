"""The near_dedup stage's sketches and the places under which its fingerprints meet."""

import numpy as np

from textloom.llm import simhash


def of(grams):
    return np.frombuffer(simhash.sketch(grams), "<u2")[None]


def test_sketches_tell_large_sets_apart():
    """Sets of thousands of shingles that share half of them, or differ in size, are told apart; those of the similarity never are."""
    r = np.random.default_rng(3)
    for n in (300, 1000, 2600, 9000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        new = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        half = np.sort(np.concatenate([a[: int(0.75 * n)], new[: int(0.25 * n)]]))  # 0.75 / 1.25 = 0.6
        assert not simhash.can_be_alike(of(a), of(half), 0.8).any()
        near = np.sort(np.concatenate([a[: int(0.9 * n)], new[: int(0.1 * n)]]))  # 0.9 / 1.1
        assert simhash.can_be_alike(of(a), of(near), 0.8).all()
    a = np.unique(r.integers(0, 2**63, 1100).astype(np.uint64))
    part = np.sort(r.permutation(a)[: int(0.82 * len(a))])  # the two have 2,048 and 1,024 bits
    assert of(a).shape != of(part).shape and simhash.can_be_alike(of(a), of(part), 0.8).all() and simhash.can_be_alike(of(part), of(a), 0.8).all()


def test_few_rows_hold_every_variant(spark):
    """Each fingerprint is dealt 32 times, not 160, and still meets whatever differs by one bit of a segment."""
    r = np.random.default_rng(6)
    n, shape = 300, (simhash.SEGMENTS, simhash.SEGMENT_BITS)
    bits = r.random((n, *shape)) < 0.5
    for i in range(0, n, 3):  # rows that have a segment in common with the one before, but for a bit
        if i:
            j, k = r.integers(0, shape[0]), r.integers(0, shape[1])
            bits[i] = bits[i - 1] ^ (r.random(shape) < 0.1)
            bits[i, j] = bits[i - 1, j]
            bits[i, j, k] ^= True
    powers = 1 << np.arange(shape[1])
    rows = [(i, bytearray(np.packbits(b).tobytes()), (b @ powers).tolist()) for i, b in enumerate(bits)]
    dealt = simhash.set_places(spark.createDataFrame(rows, "node long, print binary, segments array<int>"))
    assert dealt.count() == 32 * n
    found = dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(simhash._candidate_batches, "a long, b long, far int").collect()
    got = {(x.a, x.b): x.far for x in found}
    meet, apart = (bits[:, None] != bits[None]).sum(-1).min(-1) <= 1, (bits[:, None] != bits[None]).sum((-1, -2))
    assert all(meet[a, b] and apart[a, b] == far for (a, b), far in got.items())
    for i in range(n):  # each has a candidate where an earlier one is near
        if any(meet[i, j] and apart[i, j] <= simhash.FAR_BITS for j in range(i)):
            assert min(far for (a, _), far in got.items() if a == i) == min(apart[i, j] for j in range(i) if meet[i, j])
