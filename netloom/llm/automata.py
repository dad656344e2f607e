"""Weighted acyclic automata of n-grams, in numpy.

An automaton reads up to ``LENGTH`` labels (numbers above 0) from one initial state; the weight of a way from there is how many of the given sequences
begin with its labels, written on its last arc. States at the same depth with equal arcs (label, weight, state they lead to) are one state. It is
kept by depth: for each state the number of its arcs, for each arc label, weight and target (0: the final state without arcs, else one of the next
depth, from 1).
"""

from __future__ import annotations

import numpy as np

from netloom.llm.blocks import pack, unpack
from netloom.llm.words import mix

LENGTH = 5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def keys_of(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sequences, padded with 0, as three sort keys, the first counting most."""
    a, b, c, d, e = (x.astype(np.uint64) for x in columns)
    return [a << np.uint64(32) | b, c << np.uint64(32) | d, e]


def columns_of(keys: list[np.ndarray]) -> list[np.ndarray]:
    low = np.uint64(0xFFFFFFFF)
    return [x.astype(np.int32) for x in (keys[0] >> np.uint64(32), keys[0] & low, keys[1] >> np.uint64(32), keys[1] & low, keys[2])]


def sort_order(keys: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(keys[::-1])


def cuts(keys: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted sequences lie before each bound."""
    low, high = np.searchsorted(keys[0], bounds[0], "left"), np.searchsorted(keys[0], bounds[0], "right")
    for j in np.flatnonzero(high > low).tolist():
        a, b = int(low[j]), int(high[j])
        for k in (1, 2):
            part = keys[k][a:b]
            a, b = a + int(np.searchsorted(part, bounds[k][j], "left")), a + int(np.searchsorted(part, bounds[k][j], "right"))
        low[j] = a
    return low


def build(columns: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The automaton of sorted sequences (columns of labels, padded with 0, the first never 0): a list by depth of arcs for each state, labels, weights, targets."""
    n = len(columns[0])
    fresh, nodes, parents = np.zeros(n, bool), [], []
    fresh[:1] = True
    before = np.full(n, -1)
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(fresh)
        size = np.diff(begin, append=n)
        real = c[begin] > 0
        at = begin[real]
        nodes.append((c[at], size[real]))
        parents.append(before[at])
        here = np.zeros(n, np.int64)
        here[at] = 1
        before = np.cumsum(here) - 1
    levels, target = [], np.zeros(len(nodes[-1][0]), np.int64)
    for depth in range(LENGTH - 1, 0, -1):
        label, weight = nodes[depth]
        states = len(nodes[depth - 1][0])
        fan = np.bincount(parents[depth], minlength=states)
        some = np.flatnonzero(fan)
        first = np.concatenate([[0], np.cumsum(fan)])[some]
        sign = mix(label.astype(np.uint64) * _MIX[0] + weight.astype(np.uint64) * _MIX[1] + target.astype(np.uint64) * _MIX[2])
        sign = np.add.reduceat(sign, first) + fan[some].astype(np.uint64) if len(some) else np.zeros(0, np.uint64)
        _, one, which = np.unique(sign, return_index=True, return_inverse=True)
        kept = fan[some][one]
        arcs = np.repeat(first[one] - (np.cumsum(kept) - kept), kept) + np.arange(int(kept.sum()))
        levels.append([kept, label[arcs], weight[arcs], target[arcs]])
        target = np.zeros(states, np.int64)
        target[some] = which + 1
    levels.append([np.array([len(nodes[0][0])]), nodes[0][0], nodes[0][1], target])
    return levels[::-1]


def encode(levels: list[list[np.ndarray]]) -> tuple[list[int], list[bytes]]:
    """Sizes (states and arcs of each depth), and the four kinds of numbers of all depths one after another."""
    return [x for level in levels for x in (len(level[0]), len(level[1]))], [pack(np.concatenate([level[k] for level in levels])) for k in range(4)]


def decode(sizes: list[int], raw: list[bytes]) -> list[list[np.ndarray]]:
    states, arcs = sizes[::2], sizes[1::2]
    parts = [np.split(unpack(x, sum(n)).astype(np.int64), np.cumsum(n)[:-1]) for x, n in zip(raw, (states, arcs, arcs, arcs), strict=True)]
    return [list(level) for level in zip(*parts, strict=True)]


def union(automata: list[list[list[np.ndarray]]], least: int, low: list[int] | None = None, high: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth the ways (rows of labels) of the union of the automata and their summed weights, if ``least`` or more. A way lighter than that is
    followed no further, as none that it begins is heavier. The ways along the sequences ``low`` and ``high`` are kept and followed whatever they
    weigh: they may go on in the union of another range."""
    joined, offset = [], None
    for depth in range(LENGTH):
        parts = [a[depth] for a in automata]
        after = np.concatenate([[0], np.cumsum([len(a[depth + 1][0]) for a in automata])]) if depth + 1 < LENGTH else np.zeros(len(automata) + 1, np.int64)
        target = np.concatenate([np.where(p[3] > 0, p[3] - 1 + o, -1) for p, o in zip(parts, after[:-1], strict=True)])
        joined.append([np.concatenate([p[k] for p in parts]) for k in range(3)] + [target])
    state, node = np.arange(len(automata)), np.zeros(len(automata), np.int64)
    ways, on_low, on_high, found = np.zeros((1, 0), np.int64), np.array([low is not None]), np.array([high is not None]), []
    for depth, (fan, label, weight, target) in enumerate(joined):
        first, n = np.concatenate([[0], np.cumsum(fan)])[state], fan[state]
        arcs = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = np.repeat(node, n) << 32 | label[arcs]
        order = np.argsort(key, kind="stable")
        key, arcs = key[order], arcs[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight[arcs], begins) if len(key) else np.zeros(0, np.int64)
        parent, own = key[begins] >> 32, key[begins] & 0xFFFFFFFF
        on_low = on_low[parent] & (own == (low[depth] if low else -1))
        on_high = on_high[parent] & (own == (high[depth] if high else -1))
        keep = (total >= least) | on_low | on_high
        number = np.cumsum(keep) - 1
        which = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(key)))
        on = keep[which] & (target[arcs] >= 0)
        state, node = target[arcs][on], number[which][on]
        ways = np.concatenate([ways[parent[keep]], own[keep, None]], axis=1)
        on_low, on_high = on_low[keep], on_high[keep]
        found.append((ways, total[keep]))
    return found
