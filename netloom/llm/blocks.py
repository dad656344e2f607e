"""Blocks of documents, and corpus-wide sums that return to the block that asked.

Several operators need, for every key of every document (an n-gram, a word in its context), a number summed over the whole corpus. A row
per key and document would shuffle many times the input. Instead the documents are written once as rows of some megabytes (a block),
bucketed by block id; each block sends its distinct keys, sorted and delta-coded, one part to each key range; a key range adds up and
answers each block with the sums in the order asked; the answers are joined to the blocks by bucket, without moving the blocks.

A key appears once per block however often documents repeat it, so a key that a third of all rows hold costs one entry per block. The number of
ranges follows the bytes of the corpus, so a range holds about as many distinct keys at any size. Where there are more than ``1 << FAN_BITS`` of them,
keys are added up in stages: blocks send to bundles of blocks, each for some of the highest bits of keys; a bundle sends each key once, with its sum, to a
bundle of bundles for more of these bits, and so on, until a range has all bits and one bundle; answers come back the same way. Each
stage has as many groups as there are ranges, of about as many entries as a block. So a sender writes to at most ``1 << FAN_BITS`` groups and a group hears
from about as many senders whatever the corpus: bytes a key don't grow with the number of ranges, and a range whose key all blocks hold
isn't told so by every block. A stage moves the keys once more each way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.memory import tidy, tidy_group
from netloom.llm.scratch import Scratch
from netloom.llm.words import mix

#: Bytes of text in a block, and of text per range of keys. A longer text is a block of its own.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
#: The most bits of keys by which a stage tells ranges apart.
FAN_BITS = 10
#: A row's number is its block's times this, plus its place there; a block has fewer rows.
ROWS = 1 << 20


#: Parts of so many integers are compressed one by one; shorter ones are written all at once, so that the time follows the integers and not the parts.
ONE_BY_ONE = 128


def pack(a: np.ndarray) -> bytes:
    """Integers, byte by byte of equal weight together, each weight compressed by itself: which weights have bytes other than 0, then for each of
    these its size and its bytes."""
    a = np.ascontiguousarray(a, np.uint64)
    held, planes = int(np.bitwise_or.reduce(a)), a.view(np.uint8).reshape(len(a), 8)
    used = [k for k in range(8) if held >> 8 * k & 255]
    raw = [pa.compress(planes[:, k].tobytes(), codec="zstd", asbytes=True) for k in used]
    return b"".join([bytes([sum(1 << k for k in used)]), *(len(x).to_bytes(4, "little") + x for x in raw)])


def unpack(raw: bytes, n: int) -> np.ndarray:
    out, at = np.zeros(n, np.uint64), 1
    planes = out.view(np.uint8).reshape(n, 8)
    for k in range(8):
        if raw[0] >> k & 1:
            size = int.from_bytes(raw[at : at + 4], "little")
            planes[:, k] = np.frombuffer(pa.decompress(raw[at + 4 : at + 4 + size], n, codec="zstd", asbytes=True), np.uint8)
            at += 4 + size
    return out


def parts_of(values: np.ndarray, edges: np.ndarray) -> pa.LargeBinaryArray:
    """Unsigned integers as one binary for each part edges[i]:edges[i + 1]. Short parts hold the number of bytes of each, then these bytes."""
    values, size = values.astype(np.uint64), np.diff(edges)
    long = size >= ONE_BY_ONE
    short = np.repeat(~long, size)
    v = values[short]
    width = np.zeros(len(v), np.int64)
    for k in range(8):
        width += v >= np.uint64(1 << 8 * k)
    part = np.repeat(np.arange(len(size)), size)[short]
    packed = {int(i): pack(values[edges[i] : edges[i + 1]]) for i in np.flatnonzero(long)}
    body = np.bincount(part, weights=width, minlength=len(size)).astype(np.int64)
    whole = np.where(long, 0, size + body)
    for i, x in packed.items():
        whole[i] = len(x)
    offsets = np.concatenate([[0], np.cumsum(whole)])
    out = np.zeros(int(offsets[-1]), np.uint8)
    # places of the widths and of the bytes of short parts
    rank = np.arange(len(v)) - (np.cumsum(np.where(long, 0, size)) - np.where(long, 0, size))[part]
    out[offsets[part] + rank] = width
    before = np.cumsum(width) - width
    at = offsets[part] + size[part] + before - (np.cumsum(body) - body)[part]
    for k in range(8):
        own = np.flatnonzero(width > k)
        out[at[own] + k] = (v[own] >> np.uint64(8 * k)).astype(np.uint8)
    for i, x in packed.items():
        out[offsets[i] : offsets[i + 1]] = np.frombuffer(x, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])


def values_of(parts: pa.Array, size: np.ndarray) -> np.ndarray:
    """The integers of all parts, one after another; ``size``: how many each holds."""
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    parts, size = parts.cast(pa.large_binary()), np.asarray(size, np.int64)
    _, offsets, data = parts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    edges, long = np.concatenate([[0], np.cumsum(size)]), size >= ONE_BY_ONE
    out = np.zeros(int(edges[-1]), np.uint64)
    for i in np.flatnonzero(long).tolist():
        out[edges[i] : edges[i + 1]] = unpack(raw[offsets[i] : offsets[i + 1]].tobytes(), int(size[i]))
    few = np.flatnonzero(~long)
    n = size[few]
    part = np.repeat(np.arange(len(few)), n)
    rank = np.arange(len(part)) - (np.cumsum(n) - n)[part]
    width = raw[offsets[few][part] + rank].astype(np.int64)
    body = np.bincount(part, weights=width, minlength=len(few)).astype(np.int64)
    at = (offsets[few] + n)[part] + np.cumsum(width) - width - (np.cumsum(body) - body)[part]
    v = np.zeros(len(part), np.uint64)
    for k in range(8):
        own = np.flatnonzero(width > k)
        v[own] |= raw[at[own] + k].astype(np.uint64) << np.uint64(8 * k)
    out[edges[few][part] + rank] = v
    return out


def signed(a: np.ndarray) -> np.ndarray:
    """Integers of either sign as unsigned ones, small where these are near 0."""
    a = a.astype(np.int64)
    return ((a << 1) ^ (a >> 63)).view(np.uint64)


def unsigned(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(1)).view(np.int64) ^ -(a & np.uint64(1)).view(np.int64)


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text and fewer than ROWS rows."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_pandas(), float)).astype(np.int64)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(batch)]
    for a, b in zip(edges, edges[1:], strict=False):
        for c in range(int(a), int(b), ROWS - 1):
            yield batch.slice(c, min(ROWS - 1, int(b) - c))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, one after another in memory; of a list its values, as they lie."""
    for i in range(len(batch)):
        yield {c: x.values if isinstance(x, pa.ListScalar) else x.as_py() for j, c in enumerate(batch.schema.names) for x in (batch.column(j)[i],)}


def encode(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def decode(payload) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def write_blocks(scratch: Scratch, docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, convert: Callable | None = None, deal: bool = True) -> DataFrame:
    """``docs`` (a text column and small ones) as rows block, bytes, payload; where each row stands is fixed from here on.
    ``convert`` may turn a block's table into another with the same rows. Without ``deal`` the blocks are written where they are made."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, rows, k = TaskContext.get().partitionId(), [], 0, 0, 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, rows, k
            table = pa.Table.from_batches(held)
            payload, k = encode(convert(table) if convert else table), k + 1
            out = pa.RecordBatch.from_pydict({"block": pa.array([(part << 20) + k - 1], pa.int64()), "bytes": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})
            held, size, rows = [], 0, 0
            return out

        for batch in batches:
            for piece in slices(batch, text, block_bytes):
                if held and rows + len(piece) >= ROWS:
                    yield block()
                held.append(piece)
                rows += len(piece)
                size += piece.column(piece.schema.get_field_index(text)).nbytes
                if size >= block_bytes:
                    yield block()
        if held:
            yield block()

    return scratch.bucketed(docs.mapInArrow(tidy(gather), "block long, bytes long, payload binary"), "blocks", "block", deal)


def ranges(blocks: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """The number of key ranges, a power of two, from the bytes of the corpus (a read of one small column)."""
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return 1 << max(2, (int(total) // range_bytes).bit_length())


def stages(n_ranges: int, fan_bits: int) -> list[int]:
    """How many of the highest bits of keys are told apart after each stage; the last has those of all ranges."""
    bits = n_ranges.bit_length() - 1
    n = max(1, -(-bits // fan_bits))
    return [bits * (i + 1) // n for i in range(n)]


def bundle_of(block: int, n_bundles: int) -> int:
    return int(mix(np.array([block], np.uint64))[0]) & (n_bundles - 1)


def asked(keys: np.ndarray, values: list[np.ndarray], block: int, n_ranges: int, plain: int = 0, bundle: int = 0) -> pa.RecordBatch | None:
    """Rows (range, block, n, keys, v0...) of sorted distinct keys; a key's range is its highest bits, after those of the bundle. A row for each range that
    the block has keys of: no more than its keys, however many ranges there are. The lowest ``plain`` bits of keys are written as they are, the rest as steps."""
    if not len(keys):
        return None
    part = range_of(keys, n_ranges)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
    edges = np.append(begins, len(keys))
    high = keys >> np.uint64(plain)
    steps = np.diff(high, prepend=np.uint64(0))
    steps[begins] = high[begins]
    steps = steps << np.uint64(plain) | keys & np.uint64((1 << plain) - 1)
    rows = {"range": pa.array(part[begins] + bundle * n_ranges, pa.int32()), "block": pa.array(np.full(len(begins), block), pa.int64()), "n": pa.array(np.diff(edges), pa.int32()), "keys": parts_of(steps, edges)}
    return pa.RecordBatch.from_pydict(rows | {f"v{i}": parts_of(signed(v), edges) for i, v in enumerate(values)})


def received(table: pa.Table, n_values: int, plain: int = 0) -> tuple[pa.Table, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The rows that ``asked`` made for one range, in the order of their blocks, whatever the order they come in, so that a task that runs again says
    the same; the edges of their entries, and the keys and values of these."""
    table = table.take(np.argsort(table.column("block").to_numpy(), kind="stable"))
    size = np.asarray(table.column("n"), np.int64)
    steps = values_of(table.column("keys"), size)
    edges = np.concatenate([[0], np.cumsum(size)])
    run = np.cumsum(steps >> np.uint64(plain), dtype=np.uint64)
    before = np.where(edges[:-1] > 0, run[edges[:-1] - 1], np.uint64(0))
    keys = (run - np.repeat(before, size)) << np.uint64(plain) | steps & np.uint64((1 << plain) - 1)
    return table, edges, keys, [unsigned(values_of(table.column(f"v{i}"), size)) for i in range(n_values)]


def _answer(table: pa.Table, edges: np.ndarray, results: list[np.ndarray], code: tuple[Callable, Callable] | None = None) -> pa.Table:
    results = code[0](results, np.diff(edges)) if code else results
    return pa.table({"block": table.column("block"), "range": table.column("range"), "n": table.column("n"), **{f"r{i}": parts_of(signed(r), edges) for i, r in enumerate(results)}})


def merged(table: pa.Table, n_values: int, merge: Callable, plain: int = 0, code: tuple[Callable, Callable] | None = None) -> pa.Table:
    """Rows (block, range, n, r0...) of the rows that ``asked`` made for one range."""
    table, edges, keys, values = received(table, n_values, plain)
    return _answer(table, edges, merge(keys, values), code)


def passed_on(table: pa.Table, n_values: int, told: int, further: int, plain: int = 0) -> pa.RecordBatch:
    """What a bundle of a stage that tells ``told`` bits apart asks the next, which tells ``further`` ones: each key once, with the sums of its values."""
    node = table.column("range")[0].as_py()
    _, _, keys, values = received(table, n_values, plain)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return asked(k[begins], [np.add.reduceat(v[order], begins) for v in values], node, 1 << further, plain, node >> further)


def passed_back(table: pa.Table, found: pa.Table, n_results: int, share: Callable | None, plain: int = 0, code: tuple[Callable, Callable] | None = None) -> pa.Table:
    """The answers to the senders of a bundle (``table``, as it was received), from those to the bundle (``found``). Senders of a key get the same unless
    ``share(results, which, first)`` deals it out: ``which`` key each entry has, and the ``first`` entry of each key."""
    table, edges, keys, _ = received(table, 0, plain)
    found = found.take(np.argsort(found.column("part").to_numpy(), kind="stable"))
    size = np.asarray(found.column("n"), np.int64)
    results = [unsigned(values_of(found.column(f"r{i}"), size)) for i in range(n_results)]
    results = code[1](results, size) if code else results
    _, first, which = distinct(keys)
    return _answer(table, edges, share(results, which, first) if share else [r[which] for r in results], code)


def _plain_binary(out):
    return out.cast(pa.schema([f.with_type(pa.binary()) if f.type == pa.large_binary() else f for f in out.schema]))


def answers(
    scratch: Scratch, rows: DataFrame, n_ranges: int, ask: Callable, n_values: int, name: str, merge: Callable, n_results: int, plain: int = 0, share: Callable | None = None, code: tuple[Callable, Callable] | None = None
) -> DataFrame:
    """One round: ``ask(row)`` (a dict of a block's columns) gives sorted distinct uint64 keys and ``n_values`` arrays of integers, which are added up by key;
    ``merge(keys, values)`` gets those of one range from all blocks or bundles, one after another, and gives ``n_results`` arrays in that order.
    ``plain`` as for ``asked``, ``share`` as for ``passed_back``; ``code``, two functions of the results of some parts and the parts' sizes: what is written
    instead of these results, and the results from that. Returns block, ``name``: the list of answers by range, for ``answered``; bucketed as the
    blocks are, so that rounds to come don't move them again."""
    values, results = "".join(f", v{i} binary" for i in range(n_values)), "".join(f", r{i} binary" for i in range(n_results))
    asks, gives = f"range int, block long, n int, keys binary{values}", f"block long, range int, n int{results}"
    told = stages(n_ranges, FAN_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                keys, found = ask(row)
                if (out := asked(keys, found, row["block"], 1 << told[0], plain, bundle_of(row["block"], n_ranges >> told[0]))) is not None:
                    yield _plain_binary(out)

    def add(table: pa.Table) -> pa.Table:
        return _plain_binary(merged(table, n_values, merge, plain, code))

    def up(i: int) -> Callable:
        return tidy_group(lambda table: _plain_binary(pa.Table.from_batches([passed_on(table, n_values, told[i], told[i + 1], plain)])))

    def down(table: pa.Table, found: pa.Table) -> pa.Table:
        return _plain_binary(passed_back(table, found, n_results, share, plain, code))

    sent, bundles = rows.mapInArrow(tidy(send), asks), []
    for i in range(len(told) - 1):
        bundles.append(scratch.bucketed(sent, f"{name}_stage{i}", "range"))
        sent = bundles[-1].groupBy("range").applyInArrow(up(i), asks)
    summed = sent.groupBy("range").applyInArrow(tidy_group(add), gives)
    for bundle in reversed(bundles):
        back = summed.select(F.col("block").cast("int").alias("range"), F.col("range").alias("part"), "n", *(f"r{i}" for i in range(n_results)))
        summed = bundle.select("range", "block", "n", "keys").groupBy("range").cogroup(back.groupBy("range")).applyInArrow(down, gives)
    each = summed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "n", *(f"r{i}" for i in range(n_results))))).alias(name))
    out = scratch.bucketed(each, name, "block")
    for i in range(len(bundles)):
        scratch.drop(f"{name}_stage{i}")
    return out


def answered(found: pa.StructArray | None, n_results: int, code: tuple[Callable, Callable] | None = None) -> list[np.ndarray]:
    """The answers to a block's keys, in the order of its sorted keys."""
    if found is None or not len(found):
        return [np.zeros(0, np.int64) for _ in range(n_results)]
    size = found.field("n").to_numpy()
    results = [unsigned(values_of(found.field(f"r{i}"), size)) for i in range(n_results)]
    return code[1](results, size) if code else results


def range_of(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (n_ranges.bit_length() - 1))).astype(np.int64)


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which of them each entry is."""
    order = np.argsort(a)
    s = a[order]
    begins = np.ones(len(s), bool)
    begins[1:] = s[1:] != s[:-1]
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(begins) - 1
    return s[begins], order[begins], which


def summed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry, the sum of the counts of its key."""
    if not len(keys):
        return counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    totals = np.add.reduceat(counts[order].astype(np.int64), begins)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(totals, np.diff([*begins, len(k)]))
    return out
