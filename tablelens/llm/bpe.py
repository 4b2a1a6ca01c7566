"""Byte-level BPE on padded numpy matrices.

Rows of one length bucket form a matrix of symbol ids, padded on the right.
In each round every row merges its leftmost pair of minimum rank, found in an
open-addressing table of pairs; a row without a pair leaves the matrix, and
as every remaining row has lost exactly one symbol the matrix is compacted by
one column. Two vocabularies are read: rank files (`RankCodec`) and the JSON
of a BPE with word ends (`WordCodec`). Their paths are parameters.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

from .common import offsets, ragged

NONE = np.int32(2**31 - 1)
_EMPTY = np.uint32(0xFFFFFFFF)
#: Upper ends of the length buckets; longer rows are merged one by one.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128)
#: Matrix cells handled at once.
CELLS = 4_000_000
#: Words remembered by a worker before it starts afresh.
REMEMBERED = 500_000
#: A longer text is worked on in segments cut at word starts.
SEGMENT = 4_000_000
#: Longest word whose hash coefficients are kept ready.
LONGEST = 256


class PairTable:
    """Open-addressing table from a pair of ids below 65,536 to its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        self.bits = max(4, (4 * len(key)).bit_length())
        self.mask = np.uint32((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.vals = np.full(1 << self.bits, NONE)
        owner = np.full(1 << self.bits, -1, np.int64)
        todo, pos = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = owner[pos[todo]] < 0
            owner[pos[todo[free]]] = todo[free]  # of those that ask, the last one gets the slot
            todo = todo[owner[pos[todo]] != todo]
            pos[todo] = (pos[todo] + np.uint32(1)) & self.mask
        self.keys[pos], self.vals[pos] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(2654435769)) >> np.uint32(32 - self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is none or a side is padding (-1)."""
        shape = left.shape
        key = ((left.astype(np.uint32) << np.uint32(16)) | (right.astype(np.uint32) & np.uint32(0xFFFF))).ravel()
        pos = self._slot(key)
        found = self.keys[pos]
        out = np.where(found == key, self.vals[pos], NONE)
        miss = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(miss):
            pos[miss] = (pos[miss] + np.uint32(1)) & self.mask
            found = self.keys[pos[miss]]
            hit = found == key[miss]
            out[miss[hit]] = self.vals[pos[miss[hit]]]
            miss = miss[~hit & (found != _EMPTY)]
        out[((left < 0) | (right < 0)).ravel()] = NONE
        return out.reshape(shape)


def merge_matrix(rows: np.ndarray, table: PairTable, merged: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """rows: ids padded with -1. Returns (row numbers, their final ids, padded) as rows leave."""
    left, number = [], np.arange(len(rows))
    rank = table.ranks(rows[:, :-1], rows[:, 1:])
    while rows.shape[1] > 1 and len(rows):
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(rows)), at]
        live = best != NONE
        if not live.all():
            left.append((number[~live], rows[~live]))
            number, rows, rank, at, best = number[live], rows[live], rank[live], at[live], best[live]
            if not len(rows):
                return left
        i, new, width = np.arange(len(rows)), merged[best], rows.shape[1] - 1
        col = np.arange(width)
        rows = np.take_along_axis(rows, col + (col > at[:, None]), axis=1)
        rows[i, at] = new
        if width == 1:
            break
        col = col[: width - 1]
        rank = np.take_along_axis(rank, col + (col >= at[:, None]), axis=1)
        has = np.flatnonzero(at > 0)
        rank[has, at[has] - 1] = table.ranks(rows[has, at[has] - 1], new[has])
        has = np.flatnonzero(at < width - 1)
        rank[has, at[has]] = table.ranks(new[has], rows[has, at[has] + 1])
    left.append((number, rows))
    return left


def merge_long(ids: np.ndarray, table: PairTable, merged: np.ndarray) -> np.ndarray:
    """One very long row. A round merges every occurrence of its best pair from
    left to right, unless that would give a pair of a better rank on the way:
    then only the leftmost one. Same ids as one merge a round."""
    while len(ids) > 1:
        rank = table.ranks(ids[:-1], ids[1:])
        best = rank.min()
        if best == NONE:
            break
        at = np.flatnonzero(rank == best)
        if len(at) > 1:
            run = np.concatenate([[True], np.diff(at) != 1])
            first = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
            at = at[(at - first) % 2 == 0]  # of overlapping pairs every second one
        new = merged[best]
        done, taken = _join(ids, at, new)
        where = np.flatnonzero(taken)
        near = [
            table.ranks(np.full(len(x := at[at + 2 < len(ids)]), new), ids[x + 2]),
            table.ranks(done[(x := where[where > 0]) - 1], done[x]),
            table.ranks(done[(x := where[where + 1 < len(done)])], done[x + 1]),
        ]
        if any(len(r) and r.min() <= best for r in near):
            done, _ = _join(ids, at[:1], new)
        ids = done
    return ids


def _join(ids: np.ndarray, at: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
    out, taken, keep = ids.copy(), np.zeros(len(ids), bool), np.ones(len(ids), bool)
    out[at], taken[at], keep[at + 1] = new, True, False
    return out[keep], taken[keep]


def merge_all(flat: np.ndarray, lens: np.ndarray, table: PairTable, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows flat[offset:offset+len] of symbol ids; the merged rows likewise."""
    starts, n = offsets(lens)[:-1], len(lens)
    out_len = np.minimum(lens, 1).astype(np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their ids one after the other, lengths
    one = np.flatnonzero(lens == 1)
    parts.append((one, flat[starts[one]], np.ones(len(one), np.int64)))
    low = 1
    for high in BUCKETS:
        bucket = np.flatnonzero((lens > low) & (lens <= high))
        low = high
        for k in range(0, len(bucket), max(1, CELLS // high)):
            some = bucket[k : k + max(1, CELLS // high)]
            col = np.arange(high)
            inside = col < lens[some, None]
            mat = np.where(inside, flat[np.minimum(starts[some, None] + col, len(flat) - 1)], -1).astype(np.int32)
            for number, rows in merge_matrix(mat, table, merged):
                real = rows >= 0
                parts.append((some[number], rows[real], real.sum(axis=1)))
    for i in np.flatnonzero(lens > low):
        ids = merge_long(flat[starts[i] : starts[i] + lens[i]].astype(np.int32), table, merged)
        parts.append((np.array([i]), ids, np.array([len(ids)])))
    for rows, _, count in parts:
        out_len[rows] = count
    order = np.concatenate([p[0] for p in parts])
    ids = np.concatenate([p[1] for p in parts]).astype(np.int32)
    count = np.concatenate([p[2] for p in parts])
    place = np.zeros(n, np.int64)
    place[order] = offsets(count)[:-1]
    return ragged(ids, place, out_len), out_len


def splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:s+n]; the words follow one another without gaps."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, lens)
    coef = splitmix(max(LONGEST, int(lens.max())), 7)
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * coef[place], starts)
    return h ^ (h >> np.uint64(29))


class _Store:
    """Bytes and ids of words seen so far, found by hash and compared in full."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # sorted
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.d_start = self.d_len = self.i_start = self.i_len = np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def add(self, h: np.ndarray, data: np.ndarray, d_len: np.ndarray, ids: np.ndarray, i_len: np.ndarray) -> None:
        d_start, i_start = len(self.data) + offsets(d_len)[:-1], len(self.ids) + offsets(i_len)[:-1]
        self.data, self.ids = np.concatenate([self.data, data]), np.concatenate([self.ids, ids])
        order = np.argsort(np.concatenate([self.hash, h]), kind="stable")
        for name, more in (("hash", h), ("d_start", d_start), ("d_len", d_len), ("i_start", i_start), ("i_len", i_len)):
            setattr(self, name, np.concatenate([getattr(self, name), more])[order])


class Codec:
    """Texts to ids. Word boundaries are found for all texts of a step at once;
    each different word is merged once and remembered."""

    def __init__(self) -> None:
        self.store = _Store()

    def words(self, cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cp: code points of the texts one after the other; first: where a text
        begins. Returns cp as it is to be encoded, where a word begins, and which
        code points belong to no word."""
        raise NotImplementedError

    def merge_words(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            for part in self.segments(t) if len(t) > SEGMENT else (t,):
                parts.append(part)
                owner.append(i)
        lens = np.zeros(len(texts), np.int64)
        ids, per = self._encode(parts)
        np.add.at(lens, owner, per)
        return ids, lens

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        edge = offsets(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not edge[-1]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = np.zeros(len(cp) + 3, bool)
        first[edge] = True
        first[len(cp) :] = True
        cp, begin, out = self.words(cp, first)
        starts = np.flatnonzero(begin)
        data = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        size = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        at = offsets(size)
        b_start = at[starts]
        b_len = np.diff(np.append(b_start, at[-1]))
        real = ~out[starts]
        h = word_hashes(data, b_start, b_len)[real]
        b_start, b_len = b_start[real], b_len[real]
        _, some, which = np.unique(h, return_index=True, return_inverse=True)
        found = self.store.find(h[some])
        if len(self.store.hash) + (found < 0).sum() > REMEMBERED and len(self.store.hash):
            self.store = _Store()
            found = np.full(len(some), -1)
        new = some[found < 0]
        if len(new):
            words = ragged(data, b_start[new], b_len[new])
            self.store.add(h[new], words, b_len[new], *self.merge_words(words, b_len[new]))
            found = self.store.find(h[some])
        store = self.store
        row = found[which]
        if not (np.array_equal(store.d_len[row], b_len) and np.array_equal(ragged(store.data, store.d_start[row], b_len), ragged(data, b_start, b_len))):
            ids, count = self.merge_words(ragged(data, b_start, b_len), b_len)  # two words share a hash
        else:
            count = store.i_len[row]
            ids = ragged(store.ids, store.i_start[row], count)
        total = offsets(count)
        return ids, np.diff(total[np.searchsorted(starts[real], edge)])

    @staticmethod
    def segments(text: str):
        """Cuts before a space that something other than white space follows."""
        start = 0
        while len(text) - start > SEGMENT:
            cut = text.rfind(" ", start + 1, start + SEGMENT)
            while cut > start and text[cut + 1 : cut + 2].isspace():
                cut = text.rfind(" ", start + 1, cut)
            if cut <= start:
                m = re.compile(r" (?=\S)").search(text, start + SEGMENT - 1)
                if not m:
                    break
                cut = m.start()
            yield text[start:cut]
            start = cut
        yield text[start:]


#: Classes of code points.
SIGN, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(name, every)]] = kind
    return out


#: Fixed value: endings that both vocabularies split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def split_endings(cp: np.ndarray, kind: np.ndarray, first: np.ndarray, begin: np.ndarray) -> None:
    at = np.flatnonzero((cp[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER) & ~first[1 : len(cp)])
    follow = np.zeros(len(cp) + 3, np.uint32)
    follow[: len(cp)] = cp
    for e in ENDINGS:
        hit = at[follow[at + 1] == ord(e[0])]
        if len(e) == 2:
            hit = hit[(follow[hit + 2] == ord(e[1])) & ~first[hit + 2]]
        begin[hit + 1] = False
        after = hit + 1 + len(e)
        begin[after[after < len(cp)]] = True


class RankCodec(Codec):
    """A rank file. Its pattern (public_tokenizers.PATTERN) is: an ending after
    an apostrophe; letters, digits or signs with one space before them; white
    space, which leaves its last character to what follows."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(rank.values()) + 1)
        for token, i in rank.items():
            self.bytes_of[i] = token
        self.byte_id = np.array([rank[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, i) for token, i in rank.items() for k in range(1, len(token)) if (a := rank.get(token[:k])) is not None and (b := rank.get(token[k:])) is not None]
        self.table = PairTable(*np.array(pairs, np.int64).T)
        self.merged = np.arange(len(self.bytes_of), dtype=np.int32)
        size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.token_bytes, self.token_start, self.token_size = np.frombuffer(b"".join(self.bytes_of), np.uint8), offsets(size)[:-1], size

    def words(self, cp, first):
        kind = classes()[cp]
        begin = first[: len(cp)].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1 : len(cp)]) + 1
        begin[after - 1] = True
        begin[after[cp[after - 1] == 32]] = False
        split_endings(cp, kind, first, begin)
        return cp, begin, np.zeros(len(cp), bool)

    def merge_words(self, data, lens):
        return merge_all(self.byte_id[data], lens, self.table, self.merged)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.token_bytes, self.token_start[ids], self.token_size[ids])


class WordCodec(Codec):
    """A BPE with word ends: lower case; an ending after an apostrophe, letters,
    one digit, or signs; white space dropped. What stands between white space is
    given to the tokenizers library as it is if it has a character other than
    ASCII, Latin letters and signs below U+0250."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        self.last_id = np.array([vocab[c + "</w>"] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PairTable(*np.array([(vocab[a], vocab[b], i) for i, (a, b) in enumerate(pairs)], np.int64).T)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x250))], np.uint32)
        self.own = np.zeros(0x110000, bool)
        self.own[[*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250)]] = True

    def words(self, cp, first):
        kind = classes()[cp]
        blank = kind == SPACE
        begin = first[: len(cp)].copy()
        begin[1:] |= blank[1:] != blank[:-1]  # what stands between white space
        group = np.cumsum(begin) - 1
        foreign = np.zeros(group[-1] + 1, bool)
        foreign[group[~blank & ~self.own[cp]]] = True
        foreign = foreign[group]
        cp = np.where(foreign, cp, self.lower[np.minimum(cp, 0x24F)])
        inner = kind == NUMBER
        inner[1:] |= kind[1:] != kind[:-1]
        whole, begin = begin, begin | inner
        split_endings(cp, kind, first, begin)
        return cp, np.where(foreign, whole, begin), blank

    def merge_words(self, data, lens):
        end = offsets(lens)
        safe = np.ones(len(lens), bool)
        if (data >= 0xC9).any() or (data < 0x21).any() or (data == 0x7F).any() or (data == 0xC2).any() or (data == 0xC4).any():
            for i in np.flatnonzero(np.add.reduceat(((data >= 0xC2) | (data < 0x21) | (data == 0x7F)).astype(np.int64), end[:-1]) > 0):
                word = data[end[i] : end[i + 1]].tobytes().decode()
                safe[i] = self.own[np.frombuffer(word.encode("utf-32-le"), np.uint32)].all() if len(word) else True
        if safe.all():
            flat = self.byte_id[data]
            flat[end[1:] - 1] = self.last_id[data[end[1:] - 1]]
            return merge_all(flat, lens, self.table, self.merged)
        here, other = np.flatnonzero(safe), np.flatnonzero(~safe)
        ids, count = self.merge_words(ragged(data, end[here], lens[here]), lens[here]) if len(here) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        got = [np.array(e.ids, np.int32) for e in self._library().encode_batch([data[end[i] : end[i + 1]].tobytes().decode() for i in other], add_special_tokens=False)]
        place, total = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        place[here], total[here] = offsets(count)[:-1], count
        total[other] = [len(g) for g in got]
        place[other] = len(ids) + offsets(total[other])[:-1]
        return ragged(np.concatenate([ids, *got]), place, total), total

    def _library(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=2)
def rank_codec(path: str) -> RankCodec:
    """One per worker process."""
    return RankCodec(path)


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)
