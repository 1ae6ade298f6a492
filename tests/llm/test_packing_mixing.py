import random

import pytest
from hypothesis import given, settings, strategies as st

from veinstone.llm import mixing, packing, tokens


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_pack_is_a_partition_within_capacity(sizes):
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= 100 for b in bins)
    first = packing.first_filling(sizes, 100)
    assert len(bins) <= len(first)


def test_local_search_empties_bins():
    sizes = [60, 60, 60, 40, 40, 40, 33, 33, 34]
    assert len(packing.pack(sizes, 100)) == 4
    bins = [packing._Bin() for _ in range(3)]
    for b, items in zip(bins, ([(50, 0), (20, 1)], [(40, 2), (10, 3)], [(30, 4), (30, 5)])):
        for s, i in items:
            b.add(s, i)
    squares = sum(b.fill**2 for b in bins)
    after = packing.improve(bins, 90)
    assert sum(b.fill**2 for b in after) > squares and len(after) == 2


def test_bins_of_many_small_items_exchange_pairs_too():
    rng = random.Random(5)
    for sizes in ([rng.randrange(1, 30) for _ in range(700)], [600] * 300, [rng.randrange(400, 700) for _ in range(300)]):
        bins = packing.pack(sizes, 1000)
        assert all(sum(sizes[i] for i in b) <= 1000 for b in bins) and sorted(i for b in bins for i in b) == list(range(len(sizes)))
    # a bin of 60 items gives two for one: only 7 + 8 for 5 fills the other
    donor, taker = packing._Bin(), packing._Bin()
    for i, size in enumerate([7, 8] + [20] * 58):
        donor.add(size, i)
    for i, size in enumerate([5] + [1985]):
        taker.add(size, 100 + i)
    after = packing.improve([donor, taker], 2000)
    assert sorted(b.fill for b in after) == [1165, 2000]


def test_frame(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 90)) for i in range(900)] + [(1000, 1234), (1001, None), (1002, 0), (1003, 100)]
    items = spark.createDataFrame(rows, "item_id long, size long").selectExpr("*", "'x' as pack_name", "7 as piece")
    packs = spark.createDataFrame([("s", 100), ("l", 700), ("none", 0)], "pack_name string, capacity int")
    got = packing.pack_items(items, packs, group_items=100).collect()
    for name, capacity in (("s", 100), ("l", 700)):
        mine = [r for r in got if r.pack_name == name]
        total = {}
        for r in mine:
            total[r.item_id] = total.get(r.item_id, 0) + r.size
        assert total == {i: s for i, s in rows if s}
        assert all(r.size <= capacity for r in mine) and all(r.piece == 0 for r in mine if dict(rows)[r.item_id] <= capacity)
        fills = {}
        for r in mine:
            fills[r.bin_id] = fills.get(r.bin_id, 0) + r.size
        assert max(fills.values()) <= capacity and sum(fills.values()) / (len(fills) * capacity) > 0.94  # groups of 100, half of the items above half the capacity
    assert packing.pack_items(items.limit(0), packs).count() == 0 and packing.pack_items(items, packs.limit(0)).count() == 0


def test_weights():
    shares = {"a": 0.9, "b": 0.09, "c": 0.01}
    assert mixing.tempered(shares, 0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})
    e = mixing.exponent_for_entropy(shares, 0.8)
    assert mixing.entropy(mixing.tempered(shares, e)) == pytest.approx(0.8, abs=1e-6)
    targets = {s: mixing.Target(s, w, 2) for s, w in (("a", 0.2), ("b", 0.3), ("c", 0.5))}
    sizes = {"a": 900, "b": 90, "c": 10}
    free, exponents = mixing.budgets(sizes, targets)
    assert set(exponents.values()) == {1.0} and free["c"] == pytest.approx(20) and free["b"] == pytest.approx(12)
    everything, exponents = mixing.budgets(sizes, targets, total=10**6)
    assert everything == {"a": 1800, "b": 180, "c": 20} and exponents["a"] == pytest.approx(0, abs=1e-6)
    forced, exponents = mixing.budgets(sizes, targets, total=400)
    assert 0 < exponents["c"] < 1 and sum(forced.values()) == pytest.approx(400, rel=1e-3) and forced["c"] == 20
    # c stops at its limit, b at its own, a takes what is left; with less, a and b keep the proportion of their targets
    assert forced["b"] == pytest.approx(180) and forced["a"] == pytest.approx(200)
    some, exponents = mixing.budgets(sizes, targets, total=120)
    assert some["c"] == 20 and exponents["a"] == exponents["b"] == 1 and some["b"] / some["a"] == pytest.approx(1.5) and sum(some.values()) == pytest.approx(120)
    assert mixing.budgets({}, targets, total=5) == ({}, {}) and mixing.budgets({}, targets) == ({}, {})


@pytest.mark.parametrize("blocks", [4096, 3])
def test_mix(spark, blocks):
    rng = random.Random(4)
    rows = [(i, "Big" if i % 3 else "tiny-one ", f"t{i}", rng.randrange(1, 9)) for i in range(3000)]
    rows += [(5000 + i, "tiny_one", "t0", rows[0][3]) for i in range(1000)]  # one text a third of all rows
    rows += [(9000, "other", "q", 5), (9001, None, "r", 5), (9002, "big", "z", 0)]
    items = spark.createDataFrame(rows, "item_id long, source string, text_key string, n_tokens long").selectExpr("*", "1 as block", "2 as passes")
    targets = spark.createDataFrame([("big", 0.2, 1), ("Tiny One", 0.7, 2), ("absent", 0.1, 3)], "source string, target_weight double, max_repeats int")
    made = mixing.mix(items, targets, "most", blocks=blocks)
    shares = {r.source: r for r in made.shares.collect()}
    assert shares["tiny_one"].reached_share == pytest.approx(0.7 / 0.9, abs=0.005) and shares["big"].reached_share == pytest.approx(0.2 / 0.9, abs=0.005)
    assert shares["absent"].tokens == 0 and shares["tiny_one"].most_uses <= 2 and shares["big"].most_uses <= 1
    uses = made.uses.collect()
    keys = {r[0]: r[2] for r in rows}
    used = {}
    for u in uses:
        used[keys[u.item_id]] = used.get(keys[u.item_id], 0) + u.n_uses
    assert max(used.values()) <= 2
    assert mixing.mix(items.limit(0), targets).uses.count() == 0
    large = mixing.mix(items, targets, blocks=blocks)
    assert large.exponents["tiny_one"] < 1 and {r.source: r.most_uses for r in large.shares.collect()} == {"big": 1, "tiny_one": 2, "absent": 0}


def test_tokens(spark):
    assert tokens.count_tokens(None) == tokens.count_tokens("") == 0
    text = "def load_rows(path):\n\treturn 1  # ü <|endoftext|>"
    assert b"".join(tokens.encoder(tokens.VOCABULARY).decode_single_token_bytes(t) for t in tokens.encoder(tokens.VOCABULARY).encode_ordinary(text)).decode() == text
    df = spark.createDataFrame([(1, text), (2, None)], "n_rows int, text string")
    assert {r.n_rows: r.n_tokens for r in tokens.with_tokens(df, "text", ["n_rows"]).collect()} == {1: tokens.count_tokens(text), 2: 0}
