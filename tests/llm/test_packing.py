"""Plans of containers (problem 6)."""

import numpy as np

from codeloom.llm.packing import Plan, best_plan, bucket_bounds, plan


def _contents(p: Plan, lengths, counts):
    """Container numbers of all pieces of each length, as pack() places them."""
    out = {}
    for x, n in zip(lengths, counts, strict=True):
        rows = [(s, c, m) for y, s, c, m in zip(p.length, p.start, p.container, p.per, strict=True) if y == x]
        out[x] = []
        for rank in range(n):
            s, c, m = max(r for r in rows if r[0] <= rank)
            out[x].append(int(c + (rank - s) // m))
    return out


def test_bounds_decide_the_plan():
    lengths, counts = np.array([200, 400, 500, 600]), np.array([5, 5, 4, 3])
    two, one = (_contents(plan(lengths, counts, 1000, b), lengths, counts) for b in ([400, 600], [600]))
    assert two != one
    # in buckets of their own the five texts of 200 fill a container with 400s only, never beside a text of 600
    full = {c for c in set(two[400]) if c not in two[600] and c not in two[500]}
    assert full and not set(two[600]) & full


def test_every_piece_once_and_no_container_too_full():
    rng = np.random.default_rng(3)
    for capacity in (64, 512):
        lengths, counts = np.unique(np.minimum(rng.geometric(0.01, 3000), capacity), return_counts=True)
        for p in (plan(lengths, counts, capacity, bucket_bounds(lengths, counts)), best_plan(lengths, counts, capacity)):
            held = np.zeros(p.n_containers, int)
            for x, places in _contents(p, lengths, counts).items():
                np.add.at(held, places, x)
            assert held.sum() == (lengths * counts).sum() and held.min() > 0 and held.max() <= capacity
            assert 1 - held.mean() / capacity < 0.02


def test_buckets_never_cost_many_containers():
    lengths, counts = np.array([250, 600]), np.array([100, 100])
    assert plan(lengths, counts, 1000, [250, 600]).n_containers == 125
    assert best_plan(lengths, counts, 1000).n_containers == 100
