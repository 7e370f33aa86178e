import random

import pytest
from pyspark.sql import functions as F

from revloom.llm import packing as P


def check_groups(histogram, capacity):
    groups = P.pack_histogram(histogram, capacity)
    used: dict = {}
    for k, lengths in groups:
        assert k > 0 and 0 < sum(lengths) <= capacity
        for l in lengths:
            used[l] = used.get(l, 0) + k
    assert used == {l: c for l, c in histogram.items() if c}
    return sum(k for k, _ in groups)


@pytest.mark.parametrize("seed", range(6))
def test_histograms(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 7, 64, 512, 2048])
    h = {rnd.randint(1, capacity): rnd.randint(0, 400) for _ in range(rnd.randint(0, 200))}
    n = check_groups(h, capacity)
    total = sum(l * c for l, c in h.items())
    assert n >= -(-total // capacity)


def test_little_room_is_wasted():
    rnd = random.Random(1)
    h: dict = {}
    for _ in range(20_000):
        l = min(512, max(3, int(rnd.lognormvariate(4.8, 0.9))))
        h[l] = h.get(l, 0) + 1
    n, total = check_groups(h, 512), sum(l * c for l, c in h.items())
    assert n <= 1.01 * total / 512
    # Bounded by the capacity, not by the items: a thousand times as many make hardly more groups.
    many = P.pack_histogram({l: 1000 * c for l, c in h.items()}, 512)
    assert len(many) < 5000


@pytest.mark.parametrize("capacity", [8192, 2048, 512])
def test_the_fit_never_costs_a_container(capacity):
    rnd = random.Random(capacity)
    h: dict = {}
    for _ in range(10_000):
        l = int(rnd.lognormvariate(5.2, 0.9))
        l = l % capacity if l > capacity else l
        if l:
            h[l] = h.get(l, 0) + 1
    alone = sum(k for k, _ in P.best_fit(dict(h), [], capacity))
    assert check_groups(h, capacity) <= alone
    left = dict(h)
    fitted = P.fill_patterns(left, P.fitted_patterns(h, capacity), capacity, min(P.UNITS, capacity))
    assert sum(k * sum(ls) for k, ls in fitted) > {8192: 0, 2048: 0.2, 512: 0.5}[capacity] * sum(l * c for l, c in h.items())


def test_one_length_of_a_third_of_all():
    assert check_groups({300: 10_000, 212: 10_000}, 512) == 10_000
    assert check_groups({512: 5}, 512) == 5 and check_groups({}, 512) == 0 and check_groups({257: 9}, 512) == 9


def test_nnls():
    import numpy as np

    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(a @ P.nnls(a, np.array([4.0, 2.0])), [4, 2])
    assert np.allclose(P.nnls(np.eye(2), np.array([-1.0, 3.0])), [0, 3])


@pytest.mark.parametrize("shard_rows, shards", [(200_000, 1024), (7, 3)])
def test_places(spark, monkeypatch, shard_rows, shards):
    monkeypatch.setattr(P, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(P, "SHARDS_A_TIER", shards)
    rnd = random.Random(2)
    lens = {d: rnd.choice([0, 5, 5, 5, 40, 99, 100, 101, 250, 1000, rnd.randint(1, 300)]) for d in range(400)}
    rows = [(d, None, n) for d, n in lens.items()] + [(0, None, lens[0]), (1000, "one two, three!", None), (1001, None, None), (None, "x", 5), (1002, "", None)]
    lens |= {1000: 5, 1001: 0, 1002: 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").withColumn("len", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("full", F.lit(2))
    windows = spark.createDataFrame([("w", 100), ("none", None), ("zero", 0), ("big", 5000)], "window_name string, capacity_tokens int")
    got = P.pack_all(docs, windows).collect()
    for name, cap in (("w", 100), ("big", 5000)):
        mine = [r for r in got if r.window_name == name]
        pieces: dict = {}
        rooms: dict = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append(r)
            if r.n_tokens:
                rooms.setdefault(r.window_no, []).append(r)
        assert set(pieces) == set(lens)
        for d, ps in pieces.items():
            ps.sort(key=lambda r: r.piece)
            assert [p.piece for p in ps] == list(range(1, len(ps) + 1))
            assert sum(p.n_tokens for p in ps) == lens[d]
            assert len(ps) == 1 or (lens[d] > cap and all(p.n_tokens == cap for p in ps[:-1]))
            assert [p.start_token for p in ps] == [sum(q.n_tokens for q in ps[:k]) for k in range(len(ps))]
        for w, rs in rooms.items():
            rs.sort(key=lambda r: r.place)
            assert sum(r.n_tokens for r in rs) <= cap
            assert [r.place for r in rs] == list(range(1, len(rs) + 1))
            assert [r.at_token for r in rs] == [sum(q.n_tokens for q in rs[:k]) for k in range(len(rs))]
        assert sorted(rooms) == list(range(1, len(rooms) + 1))
    assert {r.window_name for r in got} == {"w", "big"}
    assert P.pack_all(docs.limit(0), windows).count() == 0
    assert P.pack_all(docs, windows.limit(0)).count() == 0
