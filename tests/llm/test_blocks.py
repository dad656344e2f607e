"""The coding of keys and sums that blocks exchange."""

import time

import numpy as np
import pyarrow as pa
import pytest

from netloom.llm import blocks, ngram_join, substring_dedup, suffix_tree_lm
from netloom.llm.blocks import FAN_BITS, asked, bundle_of, merged, parts_of, passed_on, signed, stages, summed, unsigned, values_of


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 3000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 2**63, size=n, dtype=np.uint64) >> rng.integers(0, 63, size=n).astype(np.uint64)
    edges = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, size=4)]))
    assert np.array_equal(values_of(parts_of(values, edges), np.diff(edges)), values)
    either = values.view(np.int64) // 2 * rng.choice([-1, 1], size=n)
    assert np.array_equal(unsigned(signed(either)), either)


def test_sums_beyond_32_bits():
    keys = np.array([1, 5], np.uint64) << np.uint64(60)
    sent = pa.concat_tables([pa.Table.from_batches([asked(keys, [np.array([2**40, 3])], b, 4)]).slice(0, 1) for b in range(3)])
    out = merged(sent, 1, lambda k, v: [summed(k, v[0])])
    assert unsigned(values_of(out["r0"], np.asarray(out["n"]))).tolist() == [3 * 2**40] * 3


def test_rows_and_time_follow_the_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, size=200_000, dtype=np.uint64) * np.uint64(2))
    counts = np.ones(len(keys), np.int64)
    asked(keys, [counts], 0, 4)
    for ranges in (128, 8192, 1 << 18, 1 << 30):
        began = time.time()
        rows = asked(keys, [counts], 7, ranges)
        assert time.time() - began < 2
        assert len(rows) <= len(keys) and sum(rows.column("n").to_pylist()) == len(keys)
        assert rows.nbytes < 64 * len(keys)
    few = keys[:: 200_000 // 50]
    assert len(asked(few, [counts[:: 200_000 // 50]], 7, 1 << 30)) <= len(few)


def test_low_bits_of_keys_are_left_as_they_are():
    rng = np.random.default_rng(5)
    for plain in (0, 8, 16):
        for n in (1, 100, 5000):
            sent = []
            for block in (3, 1, 2):
                keys = np.unique(rng.integers(0, 1 << 61, n).astype(np.uint64))  # the highest bits, a range of 8, are 0
                sent.append((block, keys, pa.Table.from_batches([asked(keys, [np.ones(len(keys), np.int64)], block, 8, plain)])))
            seen = []
            out = merged(pa.concat_tables([t for _, _, t in sent]), 1, lambda k, v, seen=seen: seen.append(k) or [summed(k, v[0])], plain)
            assert out.column("block").to_pylist() == [1, 2, 3]
            assert np.array_equal(seen[0], np.concatenate([k for _, k, _ in sorted(sent, key=lambda x: x[0])]))


def test_stages_tell_all_ranges_apart():
    assert stages(4, 10) == [2] and stages(1024, 10) == [10] and stages(8192, 10) == [6, 13] and stages(1 << 24, 10) == [8, 16, 24]
    for bits in range(2, 31):
        steps = np.diff([0, *stages(1 << bits, FAN_BITS)])
        assert steps.sum() == bits and steps.min() >= 1 and steps.max() <= FAN_BITS


def test_bytes_a_key_do_not_grow_with_the_ranges():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, size=200_000, dtype=np.uint64) * np.uint64(2))
    counts = np.ones(len(keys), np.int64)
    size = {}
    for bits in (10, 13, 18, 24):  # some 8 GB to 100 TB of text
        told = stages(1 << bits, FAN_BITS)
        rows = asked(keys, [counts], 7, 1 << told[0], 0, bundle_of(7, 1 << bits - told[0]))
        assert len(rows) <= 1 << FAN_BITS
        size[bits] = rows.nbytes / len(keys)
    assert max(size.values()) <= 1.01 * size[10] and size[10] < 10


@pytest.mark.parametrize("twice", [0, 1, 2])
def test_a_key_of_every_block_reaches_its_range_from_few_bundles(twice):
    """Blocks double, and so do ranges: the rows of a hot key's groups stay as they are, and their sums are whole."""
    bits, fan = 6 + twice, 3
    told, n = stages(1 << bits, fan), 2 << bits
    hot = np.array([3, 1 << 40, (1 << 62) + 5], np.uint64)
    sent = [pa.Table.from_batches([asked(hot, [np.array([1, 2, 3])], b << 20, 1 << told[0], 0, bundle_of(b << 20, 1 << bits - told[0]))]) for b in range(n)]
    for i, t in enumerate(told):
        whole = pa.concat_tables(sent).to_pydict()
        groups = {g: pa.Table.from_pylist([{c: whole[c][j] for c in whole} for j in range(len(whole["range"])) if whole["range"][j] == g], pa.concat_tables(sent).schema) for g in set(whole["range"])}
        assert max(len(g) for g in groups.values()) <= 6 << fan
        if i + 1 < len(told):
            sent = [pa.Table.from_batches([passed_on(g, 1, t, told[i + 1])]) for g in groups.values()]
    assert set(groups) == {int(k) >> (64 - bits) for k in hot}
    told_sums = {}
    for g in groups.values():
        merged(g, 1, lambda k, v: told_sums.update(zip(k.tolist(), summed(k, v[0]).tolist())) or [v[0]])
    assert told_sums == {3: n, 1 << 40: 2 * n, (1 << 62) + 5: 3 * n}


def _numbers_told(blocks_of: list[np.ndarray], least: int | None, code: tuple | None):
    """What a range tells blocks that hold these keys once each, and their numbers as they are read."""
    count = suffix_tree_lm._count(least)
    sent = pa.concat_tables([pa.Table.from_batches([asked(k, [np.ones(len(k), np.int64)], b, 4)]) for b, k in enumerate(blocks_of)])
    out = merged(sent, 1, count, code=code)
    size = np.asarray(out["n"], np.int64)
    results = [unsigned(values_of(out[f"r{i}"], size)) for i in range(2)]
    return out, code[1](results, size) if code else results


@pytest.mark.parametrize("least", [0, 2, None])
def test_numbers_are_told_by_their_steps(least):
    """The same numbers in fewer bytes: those of a sixth of the keys of a range took 1.9 bytes each."""
    rng = np.random.default_rng(3)
    every = np.unique(rng.integers(0, 1 << 62, 60_000, dtype=np.uint64))
    held = [np.sort(rng.choice(every, 10_000, replace=False)) for _ in range(5)] + [every[:1], every[:40]]
    plain, numbers = _numbers_told(held, least, None)
    coded, read = _numbers_told(held, least, suffix_tree_lm._CODE)
    assert all(np.array_equal(x, y) for x, y in zip(numbers, read, strict=True))
    if least is not None:
        assert coded["r1"].nbytes < 0.75 * plain["r1"].nbytes
    # two ranges in one part, whose numbers stay and go down
    several = [np.array([6, 6, 4, 4, 2], np.int64), np.array([1, 1, 3, 2, 0], np.int64)]
    assert [x.tolist() for x in suffix_tree_lm._numbers(suffix_tree_lm._steps(several, np.array([5])), np.array([5]))] == [x.tolist() for x in several]
    # sums too large for one number with the part
    whole = [np.array([2**62, 6, 2**62 + 1, 9, 9], np.int64), np.array([1, 0, 1, 7, 8], np.int64)]
    sizes = np.array([2, 3])
    assert [x.tolist() for x in suffix_tree_lm._numbers(suffix_tree_lm._steps(whole, sizes), sizes)] == [x.tolist() for x in whole]


@pytest.mark.parametrize("name", ["substring_dedup", "ngram_join", "suffix_tree"])
def test_operators_in_three_stages(spark, monkeypatch, name):
    """The brute-force tests of the operators again, with 64 ranges told apart two bits at a time and seven blocks."""
    import test_llm

    monkeypatch.setattr(blocks, "FAN_BITS", 2)
    for module in (substring_dedup, ngram_join, suffix_tree_lm):
        monkeypatch.setattr(module, "ranges", lambda *_: 64)
    docs = spark.createDataFrame(test_llm.corpus(), test_llm.SCHEMA).repartition(7)
    getattr(test_llm, f"test_{name}")(spark, docs, spark.createDataFrame([], test_llm.SCHEMA))
    assert not spark.sql("SHOW TABLES").where("tableName LIKE '%stage%'").count()
