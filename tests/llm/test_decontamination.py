"""Leaks against a plain edit distance over whole texts, on random and on repetitive texts, and the time that repeated q-grams take."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from netloom.llm.decontamination import RATE, SPAN, Benchmark, Q, leaks


def leaked(item: str, text: str) -> bool:
    item, text = item.encode(), text.encode()
    span = min(len(item), SPAN)
    most = min(int(span * RATE), (span - Q) // Q)
    t, along = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for begin in range(len(item) - span + 1):
        row = np.zeros(len(t) + 1, int)
        for i, c in enumerate(item[begin : begin + span], 1):
            new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (t != c))])
            row = np.minimum.accumulate(new - along) + along
        if row.min() <= most:
            return True
    return False


@pytest.mark.parametrize("common", [64, 1])
@pytest.mark.parametrize("alphabet", ["abcdefghij klmno", "ab ", "-- a", "abc def"])
def test_every_leak_and_no_other(alphabet, common):
    rnd = random.Random(alphabet)
    some = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    plain = lambda t: " ".join(t.split())
    hits = 0
    for _ in range(12):
        items = [x for x in (plain(some(rnd.randint(Q, 130))) for _ in range(3)) if len(x) >= Q] + ["-" * rnd.choice([40, 90, 100])]
        texts = ["x " + "-" * 60 + " y", "", "-" * 2000]
        for item in items * 2:
            t = list(item)
            for _ in range(rnd.randint(0, 7)):
                j = rnd.randrange(len(t))
                t[j : j + rnd.randrange(2)] = rnd.choice(["z", "", "yy"])
            texts.append(some(rnd.randint(0, 40)) + "".join(t)[rnd.choice([0, 0, 10]) :] + some(rnd.randint(0, 40)))
        found = {(r[0], r[1]) for r in leaks(Benchmark(list(range(len(items))), items, SPAN, RATE, common), list(range(len(texts))), pa.array(texts, pa.string()))}
        expected = {(k, x) for k, t in enumerate(texts) for x, item in enumerate(items) if leaked(item, plain(t))}
        assert found == expected
        hits += len(expected)
    assert hits > 20


def test_short_items_are_searched_as_words():
    bench = Benchmark([1, 2, 3, 4], ["Yes", "no way", "", None or " \t"], SPAN, RATE)
    found = {(r[0], r[1]) for r in leaks(bench, [0, 1, 2, 3], pa.array(["oh  YES indeed", "yesterday no\n way", "nowhere", None], pa.string()))}
    assert found == {(0, 1), (1, 2)}


def test_repeated_grams_cost_little():
    bench = Benchmark([0], ["x" + "-" * 100 + "y"], SPAN, RATE)
    texts = pa.array(["a " * 12 + "-" * 60 + " b" * 3] * 40, pa.string())
    began = time.time()
    assert leaks(bench, list(range(40)), texts) == []
    assert time.time() - began < 40 * 0.05
    assert len(leaks(Benchmark([0], ["-" * 2000], SPAN, RATE), [0], pa.array(["-" * 2000], pa.string()))) == 1


def edited(rnd, text, edits):
    t = list(text)
    for _ in range(edits):
        j = rnd.randrange(len(t))
        t[j : j + rnd.randrange(2)] = rnd.choice(["z", "", "yy"])
    return "".join(t)


@pytest.mark.parametrize("where", ["opening", "ending", "middle", "both"])
@pytest.mark.parametrize("common", [2, 5])
def test_items_that_share_text_against_brute_force(where, common):
    """Items share openings, endings or both; documents hold that text alone, with an item's own words, and with edits."""
    rnd = random.Random(where)
    some = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))
    opening, ending = "the following is a multiple choice question about", "choose the one answer that fits best among these"
    made = {"opening": lambda: f"{opening} {some(9)}", "ending": lambda: f"{some(9)} {ending}", "middle": lambda: f"{some(6)} {opening} {some(6)}", "both": lambda: f"{opening} {some(4)} {ending}"}[where]
    items = [made() for _ in range(6)]
    items += [items[0], items[1][:90]]
    texts = [f"{some(3)} {opening} {some(12)}", f"{some(12)} {ending}", f"{opening} {ending}", f"{opening} {some(3)} {ending}"]
    for k, item in enumerate(items[:6]):
        texts.append(f"{some(2)} {edited(rnd, item, k)} {some(2)}")
        texts.append(item[rnd.randint(0, 30) :] + " " + opening if k % 2 else some(3) + " " + item[: rnd.randint(60, 100)])
    bench = Benchmark(list(range(len(items))), items, SPAN, RATE, common)
    assert len(bench.held) > 1  # there are sections
    found = {(r[0], r[1]) for r in leaks(bench, list(range(len(texts))), pa.array(texts, pa.string()))}
    expected = {(k, x) for k, t in enumerate(texts) for x, item in enumerate(items) if leaked(item, " ".join(t.split()))}
    assert found == expected and len(expected) >= 6


def shared_opening(n):
    rnd = random.Random(n)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(20_000)]
    opening = "The following is a multiple choice question about "
    return rnd, words, opening, [opening + " ".join(rnd.choice(words) for _ in range(20)) for _ in range(n)]


def test_a_long_opening_of_all_items_costs_little():
    n = 10_000
    rnd, words, opening, items = shared_opening(n)
    bench = Benchmark(list(range(n)), items, SPAN, RATE)
    texts = [" ".join(rnd.choice(words) for _ in range(10)) + " " + opening + " ".join(rnd.choice(words) for _ in range(20)) for _ in range(10)]
    texts += [items[7], "x " + items[9][20:110].replace("e", "", 1)]
    tracemalloc.start()
    began = time.time()
    found = {(r[0], r[1]) for r in leaks(bench, list(range(len(texts))), pa.array(texts, pa.string()))}
    spent, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(10, 7), (11, 9)}
    assert spent < 0.3 * len(texts) and peak < 500 << 20
