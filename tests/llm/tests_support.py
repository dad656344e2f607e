"""Plain versions of what the stages decide."""

from __future__ import annotations


def _norm(text: str) -> str:
    return " ".join(x.decode() for x in text.encode().lower().split())


def groups_of(rows: list[tuple]) -> list[list]:
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    held: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    pairs: dict = {}
    for l in held.values():
        for a in range(len(l)):
            for b in range(a):
                pairs[l[b], l[a]] = pairs.get((l[b], l[a]), 0) + 1
    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups: dict = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return list(groups.values())


def leaks_of(rows: list[tuple], items: list[str]) -> set:
    """Documents that hold a whole item; the given tables have no others."""
    items = [_norm(x) for x in items]
    return {doc for doc, text in rows if any(x in _norm(text or "") for x in items)}


def packed_ids(rows: list[tuple], pieces: list, path: str) -> list[tuple]:
    """What each piece must hold, given where it begins and how long it is; and that each id of each document lies in one piece."""
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    held: Counter = Counter()
    out = []
    for p in pieces:
        held[p["doc_id"]] += p["length"]
        crcs = {zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for ids in texts[p["doc_id"]] if len(ids) == p["doc_tokens"]}
        assert p["ids_crc32"] in crcs
        out.append((p["doc_id"] is None, p["doc_id"] or 0, p["start"], p["length"], p["ids_crc32"]))
    assert held == {doc: sum(map(len, all_ids)) for doc, all_ids in texts.items()}
    return sorted(out)
