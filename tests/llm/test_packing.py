import random

import numpy as np

from evifold.llm.packing import balanced_steps, context_sizes, count_tokens, pack, pack_shard, sized, vocabulary_path


def test_pack_shard_is_sound_and_tight():
    rng = random.Random(4)
    for n, capacity in ((0, 10), (1, 10), (500, 64), (5_000, 2_048)):
        sizes = np.array([rng.randrange(1, capacity + 1) if rng.random() < 0.2 else rng.randrange(1, capacity // 4 + 2) for _ in range(n)], np.int64)
        seq, place, tier = pack_shard(sizes, capacity, 5)
        used = np.bincount(seq, weights=sizes) if n else np.zeros(0)
        assert (used <= capacity).all() and len(used) <= 1.02 * sizes.sum() / capacity + 2
        for s in set(seq.tolist()):
            spans = sorted((int(p), int(p + z)) for p, z, q in zip(place, sizes, seq) if q == s) if n <= 500 else []
            assert all(b == c for (_, b), (c, _) in zip(spans, spans[1:])) and (not spans or spans[0][0] == 0)
        assert ((tier >= 0) & (tier < 5)).all()


def test_steps_are_balanced():
    cost = np.arange(1.0, 101.0)
    step = balanced_steps(cost, 10)
    sums = np.bincount(step, weights=cost)
    assert len(sums) == 10 and np.bincount(step).max() == 10 and sums.max() - sums.min() < 0.02 * sums.mean()
    assert len(balanced_steps(np.zeros(0), 10)) == 0


def test_operator(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "word " * 5_000), (5, "x"), (5, "x"), (6, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS shard", "2 AS n_tokens")
    sizes = {}
    for r in sized(df).collect():
        sizes.setdefault(r.item_id, []).append(r.n_tokens)
    path = vocabulary_path()
    assert set(sizes) == {1, 4, 5, 6} and sizes[4] == [count_tokens("word " * 5_000, path)] and len(sizes[5]) == 2 and sizes[6][0] > 1
    got = pack(sized(df), capacity=512).collect()
    total = {}
    for r in got:
        assert 0 < r.n_tokens <= 512 and r.seq_start + r.n_tokens <= 512
        total[r.item_id] = total.get(r.item_id, 0) + r.n_tokens
    assert total == {k: sum(v) for k, v in sizes.items()}
    assert sum(r.item_id == 1 for r in got) == 1 and sorted(r.part_no for r in got if r.item_id == 4) == list(range(-(-sizes[4][0] // 512)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, pack(sized(df.repartition(3)), capacity=512).collect()))
    assert pack(sized(df.limit(0))).count() == 0


def test_tiers_decide_where_items_go():
    rng = random.Random(8)
    sizes = np.array([rng.randrange(1, 2_049) if rng.random() < 0.3 else rng.randrange(1, 400) for _ in range(3_000)], np.int64)
    one, five = pack_shard(sizes, 2_048, 1), pack_shard(sizes, 2_048, 5)
    assert (one[2] == 0).all() and set(five[2].tolist()) == {0, 1, 2, 3, 4} and not np.array_equal(one[0], five[0])
    routed = np.searchsorted(-np.array([1_024, 512, 256, 128]), -sizes, side="right")  # smallest window that holds each
    assert (five[2] <= routed).all() and (five[2] < routed).any()  # none in a window too small, gaps filled from shorter tiers
    for k in range(4):  # each window was opened by an item that needs its size
        assert (five[2][routed == k] == k).any()
    for seq in (one[0], five[0]):
        assert seq.max() + 1 <= 1.01 * sizes.sum() / 2_048 + 2
    assert context_sizes(2_048, 3) == [2_048, 1_024, 512] and context_sizes(10, 5) == [10, 5]
