"""Asking for rows takes a bounded multiple of a group's text in memory, and sums are exact."""

import tracemalloc

import numpy as np

from envspark.llm import lm_scoring


class _Steps:
    """Takes the functions that would run over groups."""

    sparkSession = None

    def __init__(self):
        self.steps = []

    def mapInArrow(self, step, schema):
        self.steps.append(step)
        return self

    def select(self, *columns):
        return self

    repartition = sortWithinPartitions = select


def test_a_group_asks_in_little_memory(monkeypatch):
    monkeypatch.setattr(lm_scoring, "partitions", lambda spark: 1)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(20_000)]
    data = np.frombuffer((" ".join(words[i] for i in rng.integers(0, len(words), 800_000)) + "\n").encode(), np.uint8)
    tree = lm_scoring.Tree(np.bincount(data, minlength=256))
    offsets = np.arange(9) * (len(data) // 8)
    folds = np.array([0, 1, 2, 1, 1, 2, 0, 1], np.uint8)
    row = lm_scoring._row("grp ids folds offsets text", [0, *lm_scoring._pack(np.arange(8), folds, offsets, data)])
    groups = _Steps()
    lm_scoring._answers(groups, tree, 3)
    tracemalloc.start()
    try:
        assert sum(1 for _ in groups.steps[0](iter([row])))
        assert tracemalloc.get_traced_memory()[1] < 16 * len(data)
    finally:
        tracemalloc.stop()


def test_sums_and_numbers_are_exact():
    rng = np.random.default_rng(2)
    cells, n = rng.integers(0, 500, 4000).astype(np.uint64) << np.uint64(40), rng.integers(0, 3000, 4000)
    got, sums = lm_scoring._summed(cells, n)
    want = np.unique(cells)
    assert (got == want).all() and (sums == [n[cells == c].sum() for c in want]).all()
    near = (np.uint64(1) << np.uint64(63)) + rng.integers(0, 300, 4000).astype(np.uint64)  # differ in the last bits only
    for x, width in ((near, 64), (cells >> np.uint64(8), 48), (near[:0], 64)):
        values, place, number = lm_scoring._distinct(x, width)
        assert (values == np.unique(x)).all() and (x[place] == values).all() and (values[number] == x).all()
