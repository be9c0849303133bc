"""What op5 compares inside crowded buckets: every pair of different components, in few steps."""

import numpy as np
import pyarrow as pa

from tesserine.llm import components, near_dedup


def _rows(rng: np.random.Generator, n: int) -> list[np.ndarray]:
    """Band, block pair, own block and component of ``n`` rows, sorted as :func:`near_dedup._pairs` wants them."""
    band, one, two = rng.integers(0, 3, n), rng.integers(0, 3, n), rng.integers(0, 3, n)
    low, high = np.minimum(one, two), np.maximum(one, two)
    own, inside = np.where(rng.random(n) < 0.5, low, high), rng.choice([-5, 7, 7, 7, 2**40], n)
    order = np.lexsort((inside, own, high, low, band))
    return [x[order] for x in (band, low, high, own, inside)]


def test_pairs_are_all_those_of_different_components():
    rng = np.random.default_rng(4)
    for n, most in ((0, 10), (1, 10), (2, 1), (60, 1), (90, 25), (90, 10**6)):
        band, low, high, own, inside = _rows(rng, n)
        got = [(int(a), int(b)) for i, j in near_dedup._pairs(band, low, high, own, inside, most) for a, b in zip(i, j, strict=True)]
        want = {
            (a, b) for a in range(n) for b in range(a + 1, n)
            if (band[a], low[a], high[a]) == (band[b], low[b], high[b]) and (low[a] == high[a] or own[a] != own[b]) and inside[a] != inside[b]
        }
        assert len(got) == len(set(got))
        assert {tuple(sorted(p)) for p in got} == want


def test_the_slope_says_what_the_search_says():
    rng, sketch = np.random.default_rng(0), near_dedup.Sketch()
    x = rng.integers(20_000, 20_100, (2_000, sketch.m)).astype(np.uint16)
    y = np.where(rng.random(x.shape) > rng.random((len(x), 1)), rng.integers(20_000, 20_100, x.shape), x).astype(np.uint16)
    nx, ny = (rng.integers(1, 200, len(x)).astype(float) for _ in range(2))
    nx[:1_000] = ny[:1_000]
    estimate = near_dedup.likely_similarity(x, y, nx, ny, sketch)
    for least in (0.3, 0.6, 0.75):
        clear = np.abs(estimate - least) > 1e-6
        assert ((estimate >= least) == near_dedup.reaches(x, y, nx, ny, sketch, least))[clear].all()
        assert 50 < (estimate >= least).sum() < len(x) - 50


def test_a_crowded_bucket_takes_few_steps(monkeypatch):
    """A bucket of 600 classes, half of them in one component, was compared row by row: 599 searches for the likeliest similarity."""
    rng, sketch, n = np.random.default_rng(1), near_dedup.Sketch(), 600
    base = rng.integers(20_000, 30_000, sketch.m).astype(np.uint16)
    regs = np.where(rng.random((n, sketch.m)) < 0.1, rng.integers(20_000, 30_000, (n, sketch.m)), base).astype(np.uint16)
    regs[:, :4] = base[:4]  # the first band is shared by all
    inside = np.where(np.arange(n) % 2 == 0, 0, np.arange(n))
    names = ["_band", "_lo", "_hi", "_own", "_in", "_n", "_sketch"]
    band = np.full(n, near_dedup.band_codes(base[None].astype(np.uint64), sketch)[0, 0])
    none = np.zeros(n, np.int64)
    table = pa.table([band, none, none, none, inside, np.full(n, 500), pa.array([r.tobytes() for r in regs], pa.binary())], names)
    steps = []
    for name in ("likely_similarity", "reaches"):
        if hasattr(near_dedup, name):
            monkeypatch.setattr(near_dedup, name, lambda *a, f=getattr(near_dedup, name): steps.append(name) or f(*a))
    order, i, j = near_dedup._candidates(table, sketch, 0.6)
    assert 0 < len(steps) <= 20
    got = {tuple(sorted((int(order[a]), int(order[b])))) for a, b in zip(i, j, strict=True)}
    codes = near_dedup.band_codes(regs.astype(np.uint64), sketch)
    assert (codes[:, 0] == band[0]).all()
    a, b = np.triu_indices(n, 1)
    apart = inside[a] != inside[b]
    a, b = a[apart], b[apart]
    same = (regs[a] == regs[b]).sum(1) >= sketch.m * 0.58
    good = same & (near_dedup.likely_similarity(regs[a], regs[b], np.full(len(a), 500.0), np.full(len(a), 500.0), sketch) >= 0.6)
    assert got == set(zip(a[good].tolist(), b[good].tolist(), strict=True))


def test_components_within_a_block_take_no_rounds(spark, monkeypatch):
    """A few links took as many rounds of shuffles as many do; they also agree where they are dealt to many blocks."""
    rng = np.random.default_rng(2)
    pairs = [(int(x), int(y)) for x, y in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1_000, 1_060)] + [(None, 3), (3, None), (5, 5)]
    root: dict[int, int] = {}

    def find(n: int) -> int:
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for x, y in pairs:
        if x is not None and y is not None and x != y:
            root[max(find(x), find(y))] = min(find(x), find(y))
    want = {n: find(n) for n in list(root)}
    rounds = []
    monkeypatch.setattr(components, "_star", lambda *a, f=components._star, **b: rounds.append(1) or f(*a, **b))
    links = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    for block in (None, 50):
        rows = components.components(links, "a", "b", **({"block": block} if block else {})).collect()
        assert len(rows) == len(want)
        assert {r.node: r.component for r in rows} == want
        assert bool(rounds) == (block is not None)
    assert components._forests(links.filter("a is not null and b is not null and a <> b").selectExpr("a", "b"), 2, 3).count() > 0
    none = components.components(links.filter("a = b"), "a", "b").collect()
    assert none == []
