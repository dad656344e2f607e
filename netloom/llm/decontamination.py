"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are compared as UTF-8 bytes, A-Z lower-cased and white space (``[\\x20\\x09-\\x0D]+``) as one space. A document leaks
an item if a stretch of ``span`` bytes of the item (all of it where it is shorter) occurs in the text within an edit distance of ``rate`` of
the stretch, its budget e (less where so short a stretch needn't share a q-gram then). By the q-gram lemma such an occurrence shares span - q + 1 - q * e q-grams with the stretch, all within a band of e
diagonals. So the q-grams that a text shares with items are put into diagonal bands of width 2 e + 1 or more that overlap by half; a region
of a band with as many hits within a stretch's length is retained, and verified by alignment within the band. Nothing else is looked at. A run
of one repeated character is one run of places, a place of the text counts once in a band, and a region is aligned at few of its begins, as
each distance excludes those near it. Items under q bytes are leaked where their words stand in the text, one after another.

Items often share an opening or an ending. Q-grams of more than ``COMMON`` items are counted for all items of a section at once, and expanded
for an item only near a q-gram that few items have; regions of common q-grams alone are aligned for their items together, along what
these have in common and from there on branch by branch, each left where it is above the budget.

The benchmark's q-grams go to every task. They are of bounded size: a benchmark of more than ``MOST_BYTES`` is searched in parts, one after
another. Each document is handled where it is read, with no shuffle; a text's hits are expanded a stretch and some items at a time.

Null and empty texts leak nothing and null or empty items are not searched for. Repeated rows, ids and items are rows of their own, empty tables
give an empty result, other columns are ignored or kept as they are. Of several regions of a document that leak an item, one is reported: the
first without edits, or else of the fewest edits among those that were aligned together. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.blocks import slices
from netloom.llm.memory import release, tidy
from netloom.llm.words import _LOWER, _SPACE, Words, mix, utf8, windows

Q, SPAN, RATE, MOST_BYTES = 12, 80, 0.05, 8 << 20
#: Hits of a stretch of text that are expanded together.
MOST_HITS = 1 << 20
#: A q-gram of more items is common. Items that are aligned together.
COMMON, HOLDERS = 64, 1 << 14
_BITS = 22
#: Bytes of text that a task looks at together.
AT_ONCE = 1 << 20
LEAKS = "doc_id long, item_id long, item_start long, doc_start long, doc_end long, shared long, edits long"


def normalised(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; each text's white space is one space, at its ends too."""
    body, offsets = utf8(texts)
    space = _SPACE[body]
    keep = np.ones(len(body), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    cuts = offsets[1:-1]
    keep[cuts[cuts < len(body)]] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    body = _LOWER[body[keep]]
    body[space[keep]] = 32
    return body, places[offsets]


def grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of q bytes from each place on, and whether they lie in one text."""
    if len(body) < Q:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    eight = np.ndarray(len(body) - 7, "<u8", body.tobytes(), strides=(1,))
    h = mix(eight[: len(body) - Q + 1] * np.uint64(0x9E3779B97F4A7C15) ^ eight[Q - 8 :])
    ok = np.ones(len(h), bool)
    for o in offsets[1:-1].tolist():
        ok[max(o - Q + 1, 0) : o] = False
    return h, ok


class _Index:
    """Where q-grams stand: groups of equal q-grams (``rank``) of one owner (an item, or a section that items share), sorted by both as
    what it is made of is by rank, owner and place, and ``first:last`` the runs of places ``low`` to ``high`` at which each stands; ``begin:end`` the groups of a q-gram."""

    def __init__(self, rank: np.ndarray, owner: np.ndarray, place: np.ndarray, span: np.ndarray, budget: np.ndarray, n_ranks: int):
        group, run = np.ones(len(rank), bool), np.ones(len(rank), bool)
        group[1:] = (rank[1:] != rank[:-1]) | (owner[1:] != owner[:-1])
        run[1:] = group[1:] | (place[1:] != place[:-1] + 1)
        runs, group = np.flatnonzero(run), np.flatnonzero(group)
        self.rank, self.owner = rank[group].astype(np.int64), owner[group].astype(np.int64)
        self.low, self.high = place[runs].astype(np.int32), place[np.append(runs[1:], len(rank))[: len(runs)] - 1].astype(np.int32)
        self.first = np.searchsorted(runs, group)
        self.last = np.append(self.first[1:], len(runs))[: len(group)]
        self.span, self.budget, self.least = span, budget, np.maximum(span - Q + 1 - Q * budget, 1)
        bands = (self.high - self.low) // (budget[owner[runs]] + 1) + 2
        self.cost = (np.add.reduceat(bands, self.first) if len(runs) else bands).astype(np.int64)  # rows that a hit of the group becomes
        self.begin, self.end = np.searchsorted(self.rank, np.arange(n_ranks)), np.searchsorted(self.rank, np.arange(n_ranks), side="right")

    def costs(self) -> np.ndarray:
        """Rows that a hit of each q-gram becomes."""
        total = np.concatenate([[0], np.cumsum(self.cost)])
        return total[self.end] - total[self.begin]


class Benchmark:
    """Items and their q-grams (``gram``: the distinct ones, sorted; in front of them a table of bits). A q-gram of more than ``common`` items
    is common. What items hold of common q-grams, section by section (sections so far apart that no stretch has both), is kept once for all
    items with the same section: ``sections`` counts them as if they were items, ``holders`` says which items hold one and where. Items
    under q bytes are held as word sequences."""

    def __init__(self, item_ids: list, texts: list[str], span: int, rate: float, common: int = COMMON):
        body, offsets = normalised(pa.array(texts, pa.string()))
        self.ids, raw = item_ids, body.tobytes()
        self.items = [raw[a:b].strip() for a, b in zip(offsets, offsets[1:], strict=False)]
        self.body = np.frombuffer(b"".join(self.items), np.uint8)
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in self.items])]).astype(np.int64)
        self.size = np.diff(self.base)
        self.span = np.minimum(self.size, span)
        self.budget = np.minimum((self.span * rate).astype(np.int64), np.maximum(self.span - Q, 0) // Q)
        self.grams, ok = grams(self.body, self.base)
        at = np.flatnonzero(ok)
        item = np.repeat(np.arange(len(self.items), dtype=np.int32), self.size)[at]
        order = np.argsort(self.grams[at], kind="stable").astype(np.int32)
        h = self.grams[at][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.gram, sorted_rank = h[new], np.cumsum(new, dtype=np.int32) - np.int32(1)
        rank = np.empty_like(sorted_rank)
        rank[order] = sorted_rank
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.index = _Index(sorted_rank, item[order], (at - self.base[item]).astype(np.int32)[order], self.span, self.budget, len(self.gram))
        self.key = self.index.rank * len(self.items) + self.index.owner
        self.common = self.index.end - self.index.begin > common
        self.share(at[self.common[rank]], item[self.common[rank]], rank[self.common[rank]])
        short = [i for i, x in enumerate(self.items) if 0 < len(x) < Q]
        words = Words(pa.array([self.items[i].decode(errors="replace") for i in short], pa.string()))
        whole, self.short = words.hashes(), {}
        for n in np.unique(words.counts).tolist():
            own = np.flatnonzero(words.counts == n)
            h = windows(whole, n)[words.first[own]] if n else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            self.short[n] = (h[order], np.array(short, np.int64)[own[order]] if n else order)

    def share(self, at: np.ndarray, item: np.ndarray, rank: np.ndarray) -> None:
        """Sections from the places of common q-grams. Equal ones are known by their span, length and a 64-bit sum over q-grams and places."""
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (at[1:] - at[:-1] > self.span[item[1:]] - Q)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        # a section of fewer q-grams than any occurrence shares finds nothing alone
        full = size >= np.maximum(self.span - Q + 1 - Q * self.budget, 1)[item[begin]]
        whole = np.repeat(full, size)
        at, item, rank, size = at[whole], item[whole], rank[whole], size[full]
        begin = np.cumsum(size) - size
        owner, start = item[begin], at[begin]
        place = at - np.repeat(start, size)
        each = mix(self.gram[rank] ^ mix(place.astype(np.uint64) + np.uint64(1)))
        total = np.add.reduceat(each, begin) if len(at) else each
        order = np.lexsort((size, self.span[owner], total))
        same = np.ones(len(order), bool)
        for v in (total, self.span[owner], size):
            same[1:] &= v[order[1:]] == v[order[:-1]]
        same[:1] = False
        section = np.empty(len(order), np.int64)
        section[order] = np.cumsum(~same) - 1
        n, model = int((~same).sum()), order[~same]
        own = np.repeat(section, size)
        # the q-grams of one section of each kind; the places of all, in the order of the text from there on
        shown = np.repeat(np.isin(np.arange(len(section)), model), size)
        rank, own, place = rank[shown], own[shown], place[shown]
        order = np.lexsort((place, own, rank))
        self.sections = _Index(rank[order], own[order], place[order], self.span[owner[model]], self.budget[owner[model]], len(self.gram))
        raw = self.body.tobytes()
        held = sorted(range(len(section)), key=lambda i: (section[i], raw[start[i] : start[i] + 2 * int(self.span[owner[i]])]))
        self.holders = owner[held], (start - self.base[owner])[held]
        self.held = np.concatenate([[0], np.cumsum(np.bincount(section, minlength=n))]).astype(np.int64)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges low:high, one after another: which range, and the number in it."""
    times = high - low
    which = np.repeat(np.arange(len(low)), times)
    return which, np.arange(len(which)) + np.repeat(low - (np.cumsum(times) - times), times)


def band_distances(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row the least edit distance between the pattern (m bytes) and a stretch of the text (m + w bytes) whose diagonals lie in the
    band of w: row i of the matrix holds the ends i .. i + w in the text."""
    m, w = patterns.shape[1], texts.shape[1] - patterns.shape[1]
    along = np.arange(w + 1, dtype=np.int16)
    row = np.zeros((len(patterns), w + 1), np.int16)
    for i in range(m):
        new = row + 1
        new[:, :w] = np.minimum(row[:, :w] + (texts[:, i : i + w] != patterns[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - along, axis=1) + along
    return row.min(axis=1)


class _Search:
    """One piece of the corpus against the benchmark: of each document and item the first region found within the budget."""

    def __init__(self, bench: Benchmark, texts):
        self.bench = bench
        self.body, self.offsets = normalised(texts)
        self.found: dict[tuple[int, int], tuple] = {}
        self.whole_words(texts)
        self.h, ok = grams(self.body, self.offsets)
        at = np.flatnonzero(bench.bits[(self.h >> np.uint64(64 - _BITS)).astype(np.int64)] & ok)
        if not len(at) or not len(bench.gram):
            return
        rank = np.minimum(np.searchsorted(bench.gram, self.h[at]), len(bench.gram) - 1)
        real = bench.gram[rank] == self.h[at]
        at, rank = at[real], rank[real]
        cost = np.cumsum(np.where(bench.common, bench.sections.costs(), bench.index.costs())[rank])
        # stretches of text, overlapping by more than an occurrence is long, whose hits fit in memory
        overlap, r = 2 * int(bench.span.max(initial=0)), 0
        while r < len(at):
            most = int(np.searchsorted(cost, (cost[r - 1] if r else 0) + MOST_HITS))
            end = max(most, int(np.searchsorted(at, at[r] + 4 * overlap)))
            self.own(at[r:end], rank[r:end])
            self.shared(at[r:end], rank[r:end])
            r = end if end >= len(at) else max(r + 1, int(np.searchsorted(at, at[end - 1] - overlap)))

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, side="right") - 1

    def own(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Items with a q-gram that is not common in this stretch of text: all their hits near it, some items at a time."""
        bench, n = self.bench, len(self.bench.items)
        frequent = bench.common[rank]
        which, group = spread(bench.index.begin[rank[~frequent]], bench.index.end[rank[~frequent]])
        place, item = at[~frequent][which], bench.index.owner[group]
        if not len(place):
            return
        pair = self.doc(place) * n + item
        order = np.lexsort((place, pair))
        place, item, group, pair = place[order], item[order], group[order], pair[order]
        # common hits between low and high lie near, each once for a pair
        commons, ranks = at[frequent], rank[frequent]
        reach = bench.span[item] + 2 * bench.budget[item]
        low, high = np.searchsorted(commons, place - reach), np.searchsorted(commons, place + reach, side="right")
        again = pair[1:] == pair[:-1]
        low[1:] = np.where(again, np.maximum(low[1:], high[:-1]), low[1:])
        high = np.maximum(high, low)
        ends = np.flatnonzero(np.append(~again, True)) + 1
        cost = np.cumsum(bench.index.cost[group] + 3 * (high - low))[ends - 1]
        a = 0
        while a < len(place):
            spent = cost[np.searchsorted(ends, a, side="right") - 1] if a else 0
            k = max(int(np.searchsorted(cost, spent + MOST_HITS, side="right")) - 1, int(np.searchsorted(ends, a, side="right")))
            z = int(ends[k])
            which, c = spread(low[a:z], high[a:z])
            key = ranks[c] * n + item[a:z][which]
            g = np.minimum(np.searchsorted(bench.key, key), len(bench.key) - 1)
            real = bench.key[g] == key
            self.pairs(np.concatenate([place[a:z], commons[c[real]]]), np.concatenate([item[a:z], item[a:z][which[real]]]), np.concatenate([group[a:z], g[real]]))
            a = z

    def pairs(self, place, item, group) -> None:
        bench, n = self.bench, len(self.bench.items)
        doc = self.doc(place)
        inside = (place >= self.offsets[doc]) & (place < self.offsets[doc + 1])
        self.exact(self.h, place[inside], doc[inside], item[inside], bench.index.low[bench.index.first[group[inside]]].astype(np.int64))
        # what is found needs no more hits
        open_ = ~np.isin(doc * n + item, np.array([k * n + x for k, x in self.found], np.int64))
        doc, x, edge, low, high, shared = self.regions(bench.index, place[open_], doc[open_], item[open_], group[open_])
        most = bench.size[x] - bench.span[x]
        self.align(doc, x, edge, np.clip(low, 0, most), np.clip(high, 0, most), shared)

    def shared(self, at: np.ndarray, rank: np.ndarray) -> None:
        """Regions of common q-grams alone, counted once for all items that hold the section. What each begin of a region has in common is
        aligned for these items together; items left are aligned by themselves."""
        bench = self.bench
        frequent = bench.common[rank]
        which, group = spread(bench.sections.begin[rank[frequent]], bench.sections.end[rank[frequent]])
        place = at[frequent][which]
        if not len(place):
            return
        doc, section, edge, low, high, shared = self.regions(bench.sections, place, self.doc(place), bench.sections.owner[group], group)
        times = np.cumsum(bench.held[section + 1] - bench.held[section])
        a = 0
        while a < len(section):
            z = max(a + 1, int(np.searchsorted(times, (times[a - 1] if a else 0) + HOLDERS, side="right")))
            first = bench.held[section[a:z]]
            which, k = spread(first, bench.held[section[a:z] + 1])
            for b in range(0, len(which), HOLDERS):
                r, x, at_item = a + which[b : b + HOLDERS], bench.holders[0][k[b : b + HOLDERS]], bench.holders[1][k[b : b + HOLDERS]]
                most = bench.size[x] - bench.span[x]
                rows = (doc[r], x, edge[r] - at_item, np.clip(low[r] + at_item, 0, most), np.clip(high[r] + at_item, 0, most), shared[r])
                kept = self.near(*rows[:5])
                self.align(*(v[kept] for v in rows))
            a = z

    def near(self, doc, x, edge, low, high) -> np.ndarray:
        """Which of these rows may hold an occurrence, by what all stretches from ``low`` to ``high`` contain. Neighbouring rows that begin
        alike in the same text share the rows of their matrices until they part; rows above the budget are left there."""
        bench = self.bench
        length, budget = bench.span[x] - (high - low), bench.budget[x]
        kept = length <= budget
        kind = length * (1 << 20) + budget
        for k in np.unique(kind[~kept]).tolist():
            own = np.flatnonzero(kind == k)
            m, most = k >> 20, k & ((1 << 20) - 1)
            width = 4 * most + 2
            start = self.offsets[doc[own]] + high[own] + edge[own] - most
            pattern = np.lib.stride_tricks.sliding_window_view(bench.body, m)[bench.base[x[own]] + high[own]]
            differ = pattern[1:] != pattern[:-1]
            alike = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
            same = (start[1:] == start[:-1]) & (doc[own][1:] == doc[own][:-1])
            alike = np.concatenate([[0], np.where(same, alike, 0)])
            low_end, high_end = self.offsets[doc[own]], self.offsets[doc[own] + 1]
            live, along = np.arange(len(own)), np.arange(width + 1, dtype=np.int16)
            row = np.zeros((int((alike == 0).sum()), width + 1), np.int16)
            for i in range(m):
                lead = alike <= i
                heads = live[lead]
                if i:
                    row = row[(np.cumsum(alike < i) - 1)[lead]]
                where = (start[heads] + i)[:, None] + np.arange(width)
                inside = (where >= low_end[heads][:, None]) & (where < high_end[heads][:, None])
                other = ~inside | (self.body[np.clip(where, 0, len(self.body) - 1)] != pattern[heads, i][:, None])
                new = row + np.int16(1)
                new[:, :width] = np.minimum(row[:, :width] + other, row[:, 1:] + np.int16(1))
                row = np.minimum.accumulate(new - along, axis=1) + along
                good = row.min(axis=1) <= most
                if not good.all():
                    stay = good[np.cumsum(lead) - 1]
                    row, live, alike = row[good], live[stay], alike[stay]
                    if not len(live):
                        break
            kept[own[live]] = True
        return np.flatnonzero(kept)

    def whole_words(self, texts) -> None:
        bench = self.bench
        if not bench.short:
            return
        words = Words(texts, lower=True)
        h = words.hashes()
        for n, (hashes, items) in bench.short.items():
            at = np.flatnonzero(words.left >= n) if len(h) else np.zeros(0, np.int64)
            own = windows(h, n)[at] if len(h) else h
            which, k = spread(np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right"))
            for a, x in zip(at[which].tolist(), items[k].tolist(), strict=True):
                doc = int(words.doc[a])
                if (doc, x) not in self.found:
                    start = int(words.start[a] - words.offsets[doc])
                    self.found[doc, x] = (0, start, start + len(bench.items[x]), 0, 0)

    def exact(self, h, place, doc, item, begin) -> None:
        """Whole stretches without an edit, by their chained q-grams: from the first place of a q-gram in an item on."""
        bench = self.bench
        fits = (begin + bench.span[item] <= bench.size[item]) & (place + bench.span[item] <= self.offsets[doc + 1])
        hits, step = np.flatnonzero(fits), 0
        while len(hits):
            x = item[hits]
            ends = bench.span[x] - Q
            shift = np.minimum(step, ends)
            same = h[place[hits] + shift] == bench.grams[bench.base[x] + begin[hits] + shift]
            hits, ends = hits[same], ends[same]
            done = hits[step >= ends]
            for k, y, a, b, s in zip(doc[done].tolist(), item[done].tolist(), place[done].tolist(), begin[done].tolist(), bench.span[item[done]].tolist(), strict=True):
                if (k, y) not in self.found:
                    a -= int(self.offsets[k])
                    self.found[k, y] = (0, a, a + s, s - Q + 1, b)
            hits = hits[step < ends]
            step += Q

    def regions(self, index: _Index, place, doc, item, group) -> tuple[np.ndarray, ...]:
        """Diagonal bands of these hits; regions with as many shared q-grams as the budget leaves:
        document, owner, the band's first diagonal, begins in the owner from low to high, and how many are shared."""
        place = place - self.offsets[doc]
        which, run = spread(index.first[group], index.last[group])
        p, half = place[which], index.budget[item[which]] + 1
        # bands are 2 * half wide and overlap by half; a place of the text counts once in a band
        again, b = spread((p - index.high[run]) // half - 1, (p - index.low[run]) // half + 1)
        which, p = which[again], p[again]
        d, m = doc[which], item[which]
        order = np.lexsort((p, b, m, d))
        d, m, b, p = d[order], m[order], b[order], p[order]
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (b[1:] != b[:-1])
        once = new.copy()
        once[1:] |= p[1:] != p[:-1]
        d, m, b, p, new = d[once], m[once], b[once], p[once], new[once]
        held_in = np.cumsum(new)
        span, budget, least = index.span[m], index.budget[m], index.least[m]
        # hit i is the last of an occurrence if the one ``least - 1`` before lies in the same band and near enough
        back = np.arange(len(p)) - least + 1
        i = np.flatnonzero((back >= 0) & (held_in[np.maximum(back, 0)] == held_in))
        i = i[p[i] - p[back[i]] <= (span + budget - Q)[i]]
        if not len(i):
            return (np.zeros(0, np.int64),) * 6
        # the occurrence begins in the text between low and high; overlapping ones of a band are one region
        low, high, g = p[i] + Q - span[i] - budget[i], p[back[i]], held_in[i]
        first = np.ones(len(i), bool)
        first[1:] = (g[1:] != g[:-1]) | (low[1:] > high[:-1] + 1)
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(i)) - 1
        shared = np.diff(np.append(at, len(i))) + least[i[at]] - 1
        x, doc = m[i[at]], d[i[at]]
        edge, width = b[i[at]] * (index.budget[x] + 1), 2 * (index.budget[x] + 1)
        return doc, x, edge, low[at] - edge - width, high[last] - edge, shared

    def align(self, doc, x, edge, low, high, shared) -> None:
        """Tries begins in low .. high of each region, the middle first. A stretch that begins d bytes further on has d edits less at the
        most, so one with too many excludes those around it."""
        bench = self.bench
        while len(doc):
            open_ = np.array([(k, y) not in self.found for k, y in zip(doc.tolist(), x.tolist(), strict=True)], bool)
            doc, x, edge, low, high, shared = (v[open_] for v in (doc, x, edge, low, high, shared))
            begin, distance = (low + high) // 2, np.zeros(len(doc), np.int64)
            for span in np.unique(bench.span[x]).tolist():
                own = np.flatnonzero(bench.span[x] == span)
                for part in np.array_split(own, -(-len(own) // 2048)):
                    distance[part] = self.distances(doc[part], x[part], edge[part], begin[part], span)
            budget = bench.budget[x]
            for r in np.flatnonzero(distance <= budget).tolist():
                key = (int(doc[r]), int(x[r]))
                if key not in self.found or distance[r] < self.found[key][0]:
                    a = max(int(begin[r] + edge[r] - budget[r]), 0)
                    z = min(int(begin[r] + edge[r] + 3 * budget[r] + 2 + bench.span[x[r]]), int(self.offsets[doc[r] + 1] - self.offsets[doc[r]]))
                    self.found[key] = (int(distance[r]), a, z, int(shared[r]), int(begin[r]))
            clear = np.maximum(distance - budget, 1)
            parts = [(low, begin - clear), (begin + clear, high)]
            keep = [a <= b for a, b in parts]
            doc, x, edge, shared = (np.concatenate([v[k] for k in keep]) for v in (doc, x, edge, shared))
            low, high = (np.concatenate([part[j][k] for part, k in zip(parts, keep, strict=True)]) for j in (0, 1))

    def distances(self, doc, x, edge, begin, span: int) -> np.ndarray:
        bench, budget = self.bench, int(self.bench.budget[x[0]])
        start = self.offsets[doc] + begin + edge - budget
        where = start[:, None] + np.arange(span + 2 * (budget + 1) + 2 * budget)
        inside = (where >= self.offsets[doc][:, None]) & (where < self.offsets[doc + 1][:, None])
        texts = np.where(inside, self.body[np.clip(where, 0, max(len(self.body) - 1, 0))].astype(np.int16), -1)
        return band_distances(bench.body[(bench.base[x] + begin)[:, None] + np.arange(span)].astype(np.int16), texts)


def leaks(bench: Benchmark, ids: list, texts) -> list[tuple]:
    """Rows (LEAKS) of a batch, one for each document and the item that it leaks."""
    found = _Search(bench, texts).found
    return [(ids[k], bench.ids[x], begin, a, z, shared, edits) for (k, x), (edits, a, z, shared, begin) in sorted(found.items())]


def _parts(spark: SparkSession, benchmark: DataFrame) -> Iterator:
    """Broadcasts of the benchmark's items, each of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and octet_length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(total) // MOST_BYTES
    for part in range(parts):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(([r["item_id"] for r in held], [r["text"] for r in held]))


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, span: int = SPAN, rate: float = RATE) -> DataFrame:
    """A row for each document and the item that it leaks: where in the item (bytes, normalised), between which bytes of the normalised
    text, how many q-grams are shared, and the edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([(c.split()[0], pa.int64()) for c in LEAKS.split(", ")])

    def search(shared) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*shared.value, span, rate)
            for batch in batches:
                for piece in slices(batch, "text", AT_ONCE):
                    if found := leaks(bench, piece.column("doc_id").to_pylist(), piece.column("text")):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)

        return rows.mapInArrow(tidy(scan), LEAKS)

    return reduce(DataFrame.union, [search(x) for x in _parts(spark, benchmark)])


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, span: int = SPAN, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that leak no item."""

    def leaky(shared):
        @F.arrow_udf("boolean")
        def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bench = Benchmark(*shared.value, span, rate)
            for texts in batches:
                found, at = np.zeros(len(texts), bool), 0
                for piece in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", AT_ONCE):
                    for row in leaks(bench, list(range(at, at + len(piece))), piece.column(0)):
                        found[row[0]] = True
                    at += len(piece)
                yield pa.array(found)
            release()

        return scan

    for shared in _parts(spark, benchmark):
        docs = docs.where(~leaky(shared)(F.col("text").cast("string")))
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
