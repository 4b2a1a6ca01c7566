"""Best-fit packing with swap-based local search (operator 1).

1. Tokens. Each task encodes its texts, appends the end id and cuts texts
   longer than a sequence; only (doc_id, piece, start, length, crc32) rows
   leave it, written once to the shared folder.
2. Packing. The pieces are dealt evenly over tasks (round robin: no key, so no
   hot key). A task packs at most `GROUP` pieces at a time: best fit in
   falling length, then a local search among the underfull bins. It empties
   the least full bin by moving a piece, by exchanging one for one, two for
   one or one for two with a fuller bin; every step raises the sum of
   squared fills, so it ends. A group needs no more search once it has as few
   bins as its tokens allow.
3. What a group could not fill is packed again: the pieces of bins with room
   left (a few for each group) are dealt into groups in turn, so the waste of
   one group does not add up over groups.

Nulls count as empty texts (one piece with only the end id). Repeated rows are
packed like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoint import scratch_table
from .bpe import word_codec
from .common import map_arrow, steps, text_or_empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Tokens of a sequence.
CAPACITY = 4096
#: The id after each document.
END = 1
#: Characters encoded at once.
STEP = 1_000_000
#: Pieces that a task packs at once.
GROUP = 16_384
#: Of a bin with more pieces only pairs that stand less than this apart are exchanged for one.
PAIRS = 16
#: Bins with more free tokens than this are packed again with those of other groups.
LOOSE = 8


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every row; nothing is shuffled."""
    slim = docs.select(docs[key].alias("k"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0)
            for lo, hi in steps(texts, STEP):
                ids, lens = codec.encode(texts[lo:hi])
                cut = np.cumsum(lens)
                raw = np.insert(ids, cut, end).astype("<u4")  # the end id after each document
                rows, piece, start, size, crc, at = [], [], [], [], [], 0
                for i, n in enumerate((lens + 1).tolist()):
                    for p, s in enumerate(range(0, n, capacity)):
                        m = min(capacity, n - s)
                        rows.append(lo + i), piece.append(p), start.append(s), size.append(m)
                        crc.append(zlib.crc32(raw[at + s : at + s + m]))
                    at += n
                yield pa.record_batch([keys.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["k", "piece", "start", "length", "ids_crc32"])

    return map_arrow(slim, run, f"k {slim.schema['k'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


def best_fit(size: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: falling length, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, those in by_room
    for i in np.argsort(-size, kind="stable").tolist():
        n = int(size[i])
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        bins[b].append(i)
        room -= n
        if room:
            if room not in by_room:
                rooms.insert(bisect_left(rooms, room), room)
            by_room.setdefault(room, []).append(b)
    return bins


def local_search(size: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties underfull bins by moves and exchanges that raise the squared fill."""
    least = -(-int(size.sum()) // capacity)
    fill = np.array([int(size[b].sum()) for b in bins], np.int64)
    home = np.empty(len(size), np.int64)
    for b, some in enumerate(bins):
        home[some] = b
    held = [set(b) for b in bins]
    left, stuck, emptied = len(bins), set(), False
    while left > least:
        open_ = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in stuck]
        if not open_:
            if not emptied:  # a whole pass without a bin less: a local optimum
                break
            stuck, emptied = set(), False
            continue
        victim = min(open_, key=lambda b: (fill[b], b))
        if _empty(victim, size, fill, home, held, capacity):
            left, emptied = left - 1, True
        else:
            stuck.add(victim)
    return [sorted(b, key=lambda i: (-size[i], i)) for b in held if b]


def _empty(v: int, size, fill, home, held, capacity) -> bool:
    """Moves what it can out of bin v; true if nothing is left."""

    def put(i: int, b: int) -> None:
        held[home[i]].discard(i)
        fill[home[i]] -= size[i]
        home[i] = b
        held[b].add(i)
        fill[b] += size[i]

    while held[v]:
        own = sorted(held[v], key=lambda i: (-size[i], i))
        room = np.where(fill > 0, capacity - fill, 0)  # of bins in use
        room[v] = 0
        step = None
        for i in own:  # a move into the tightest bin with room
            fits = np.flatnonzero(room >= size[i])
            if len(fits):
                step = ([i], [], int(fits[np.argmin(room[fits])]))
                break
        if step is None:
            step = _exchange(own, size, fill, home, room, v)
        if step is None:
            return False
        out, back, b = step
        for i in back:
            put(i, v)
        for i in out:
            put(i, b)
    return True


def _exchange(own: list[int], size, fill, home, room, v: int):
    """(out, back, bin): the exchange with a fuller bin that fills it best."""
    there = np.flatnonzero((room[home] > 0) & (fill[home] >= fill[v]) & (home != v))
    if not len(there):
        return None
    n, free = size[there], room[home[there]]
    best, step = 0, None
    own = list({int(size[i]): i for i in own}.values())  # one of each length
    for i in own:  # one for one
        gain = size[i] - n
        gain = np.where((gain > 0) & (gain <= free), gain, 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, step = int(gain[k]), ([i], [int(there[k])], int(home[there[k]]))
    for a in range(len(own)):  # two for one
        for c in range(a + 1, len(own)):
            gain = size[own[a]] + size[own[c]] - n
            gain = np.where((gain > 0) & (gain <= free), gain, 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, step = int(gain[k]), ([own[a], own[c]], [int(there[k])], int(home[there[k]]))
    order = np.argsort(home[there], kind="stable")  # one for two of a bin
    h, m, f = home[there][order], n[order], free[order]
    for apart in range(1, min(len(h), PAIRS)):
        first = np.flatnonzero(h[:-apart] == h[apart:])
        if not len(first):
            break
        two = m[first] + m[first + apart]
        for i in own:
            gain = size[i] - two
            gain = np.where((gain > 0) & (gain <= f[first]), gain, 0)
            x = int(gain.argmax())
            if gain[x] > best:
                k = first[x]
                best, step = int(gain[x]), ([i], [int(there[order[k]]), int(there[order[k + apart]])], int(h[k]))
    return step


def pack_group(size: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    if not len(size):
        return []
    return local_search(size, best_fit(size, capacity), capacity)


def _deal(rows: DataFrame, level: int, capacity: int, group: int, loose: int) -> DataFrame:
    """Rows with sequence_id, offset and room, packed in groups; the number of tasks follows the rows."""
    n = rows.count()
    schema = rows.schema.names
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, kept, held = (level << 56) | (TaskContext.get().partitionId() << 32), [], 0

        def packed(base: int) -> tuple[pa.RecordBatch, int]:
            table = pa.Table.from_batches(kept).combine_chunks()
            size = table.column("length").to_numpy().astype(np.int64)
            bins = pack_group(size, capacity)
            order = np.array([i for b in bins for i in b], np.int64)
            count = np.array([len(b) for b in bins], np.int64)
            which = np.repeat(np.arange(len(bins)), count)
            ends = np.cumsum(size[order])
            total = np.add.reduceat(size[order], np.cumsum(count) - count)
            out = table.take(pa.array(order))
            made = [which + base, ends - size[order] - (np.cumsum(total) - total)[which], (capacity - total)[which]]
            cols = [c.combine_chunks() for c in out.columns]
            return pa.record_batch(cols + [pa.array(x, pa.int64()) for x in made], [*schema, "sequence_id", "offset", "room"]), len(bins)

        for b in batches:
            while b.num_rows:
                some = b.slice(0, group - held)
                b = b.slice(some.num_rows)
                kept.append(some)
                held += some.num_rows
                if held == group:
                    out, made = packed(base)
                    yield out
                    base, kept, held = base + made, [], 0
        if held:
            yield packed(base)[0]

    return map_arrow(rows.repartition(max(1, -(-n // group))), run, f"{typed}, sequence_id long, offset long, room long")


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, loose: int = LOOSE) -> DataFrame:
    """rows: any columns and `length` (1 to capacity). Adds sequence_id and offset."""
    dealt = scratch_table(_deal(rows, 1, capacity, group, loose), "packed")
    first = dealt.filter(F.col("room") <= loose)
    again = dealt.filter(F.col("room") > loose).select(*rows.columns)
    return first.unionByName(_deal(again, 2, capacity, group, loose)).drop("room")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every document's pieces with their sequences (see the module)."""
    return pack(scratch_table(pieces(docs, key, text, path, capacity, end), "pieces"), capacity)
