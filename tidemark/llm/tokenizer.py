"""Encoding a corpus with a public byte-level BPE vocabulary, in numpy.

Texts are cut into pieces by class of code point with array operations, each different piece of a chunk is encoded
once, and the pieces are laid out as padded matrices bucketed by length. In each round every row merges its leftmost
pair of least rank; pairs are looked up in an open-addressing hash table, and rows are shifted together and dropped as
they are done. Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Where the vocabulary files lie unless a path is given.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Code points that are worked on at once, and different pieces that are remembered by a worker.
CHUNK = 1_000_000
REMEMBERED = 400_000
#: Bytes of a vocabulary file that may be broadcast.
LARGEST = 64_000_000
#: Pieces of more bytes than this are encoded one by one.
WIDEST = 64
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: What may follow an apostrophe as a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, DIGIT, SPACE, EDGE = range(5)
NEVER = np.int32(2**31 - 1)
PAD = 65535


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT)):
        for m in regex.finditer(pattern + "+", every):
            points = np.frombuffer(m.group().encode("utf-32-le"), np.uint32)
            out[points] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    place = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [place[b] for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with its merges as hash table."""

    BITS = 18
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, text: str | bytes):
        model = json.loads(text)["model"]
        vocab = model["vocab"]
        if max(vocab.values()) >= PAD:
            raise ValueError("ids must be below 65535")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.array([vocab[c] for c in byte_letters()], np.int32)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        made_at = np.full(PAD, -1, np.int64)
        made_at[self.merged] = np.arange(len(pairs))
        #: No merge makes a token whose own merges come earlier; then all places of a pair may be merged in one round.
        self.rising = bool((np.maximum(made_at[left], made_at[right]) < np.arange(len(pairs))).all())
        self._fill((left << 16) | right)
        self.known: dict[bytes, np.ndarray] = {}

    def _fill(self, keys: np.ndarray) -> None:
        size = 1 << self.BITS
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NEVER, np.int32)
        slots = self._slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            at = slots[waiting]
            free = self.keys[at] < 0
            chosen, index = np.unique(at[free], return_index=True)
            winners = waiting[free][index]
            self.keys[chosen], self.ranks[chosen] = keys[winners], winners
            placed = np.zeros(len(keys), bool)
            placed[winners] = True
            waiting = waiting[~placed[waiting]]
            slots[waiting] = (slots[waiting] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.FACTOR) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, :data:`NEVER` if it does not merge."""
        keys = (left.astype(np.int64) << 16) | right
        shape, keys = keys.shape, keys.ravel()
        slots = self._slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], NEVER)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        at = slots[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.BITS) - 1)
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], at[more]
        return out.reshape(shape)

    def _matrix(self, tokens: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Rows of padded tokens, merged to the end."""
        out: list = [None] * len(tokens)
        rows = np.arange(len(tokens))
        ranks = self.rank(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            done = best == NEVER
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = tokens[i, : lengths[i]].copy()
                go = ~done
                rows, tokens, ranks, lengths, at, best = rows[go], tokens[go], ranks[go], lengths[go], at[go], best[go]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            width = tokens.shape[1]
            lengths = lengths - 1
            tokens[line, at] = self.merged[best]
            column = np.arange(width - 1)
            tokens = np.take_along_axis(tokens, column + (column > at[:, None]), 1)
            if width == 2:
                for i, row in enumerate(rows):
                    out[row] = tokens[i, :1].copy()
                break
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self.rank(tokens[right, at[right]], tokens[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(tokens[left, at[left] - 1], tokens[left, at[left]])
        return out

    def _long(self, tokens: np.ndarray) -> np.ndarray:
        """One piece of any length: all places of its least pair are merged at once, from the left."""
        while len(tokens) > 1:
            ranks = self.rank(tokens[:-1], tokens[1:])
            best = ranks.min()
            if best == NEVER:
                break
            places = np.flatnonzero(ranks == best)
            if self.rising:
                fresh = np.concatenate([[True], np.diff(places) > 1])
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - start) % 2 == 0]
            else:
                places = places[:1]
            tokens = tokens.copy()
            tokens[places] = self.merged[best]
            tokens = np.delete(tokens, places + 1)
        return tokens

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (found := self.known.get(p)) is not None:
                out[i] = found
            elif len(p) == 1:
                out[i] = self.first[p[0] : p[0] + 1]
            elif len(p) > WIDEST:
                out[i] = self._long(self.first[np.frombuffer(p, np.uint8)])
            else:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            lengths = np.array([len(pieces[i]) for i in members])
            tokens = np.full((len(members), width), PAD, np.int32)
            inside = np.arange(width) < lengths[:, None]
            tokens[inside] = self.first[np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for i, ids in zip(members, self._matrix(tokens, lengths), strict=True):
                out[i] = self.known[pieces[i]] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offset of each text and the end)."""
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            parts = [self._whole([x])[0] for x in segments(texts[0])]
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)])
        return self._whole(texts)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, sizes)
        data = whole.encode("utf-8") + bytes(8)
        if len(data) == len(points) + 8:
            begin = np.flatnonzero(starts)
            end = np.append(begin[1:], len(points))
        else:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width)])
            begin = at[np.flatnonzero(starts)]
            end = np.append(begin[1:], at[-1])
        which, firsts = same_pieces(data, begin, end)
        ids = self.pieces([data[a:b] for a, b in zip(begin[firsts].tolist(), end[firsts].tolist(), strict=True)])
        counts = np.array([len(x) for x in ids], np.int64)
        pool = np.concatenate(ids)
        offset = np.cumsum(counts) - counts
        n = counts[which]
        upto = np.cumsum(n)
        out = pool[np.repeat(offset[which] - (upto - n), n) + np.arange(upto[-1])]
        pieces_before = np.concatenate([[0], np.cumsum(starts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return out.astype(np.int32, copy=False), np.concatenate([[0], upto])[pieces_before]


def piece_starts(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin: a contraction, a run of letters, digits or other signs with one blank
    before it, or white space, of which the last sign before a word stands alone."""
    kind = classes()[points]
    n = len(points)
    first = np.cumsum(sizes) - sizes
    first = first[sizes > 0]
    last = np.append(first[1:], n) - 1
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[first] = EDGE
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[last] = EDGE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 0x20
    blank_before[first] = False
    space = kind == SPACE
    starts = (kind != before) & ~(blank_before & ~space)
    starts |= space & (after != SPACE) & (after != EDGE)
    marks = np.flatnonzero((points == 0x27) & starts & (after == LETTER))
    if len(marks):
        ends = np.append(first[1:], n)[np.searchsorted(first, marks, "right") - 1]
        for word in CONTRACTIONS:
            hit = marks + len(word) < ends
            for j, c in enumerate(word):
                hit &= points[np.minimum(marks + 1 + j, n - 1)] == ord(c)
            found = marks[hit]
            starts[found + 1] = False
            nxt = found + 1 + len(word)
            starts[nxt[nxt < n]] = True
            if len(found):
                keep = ~hit
                marks, ends = marks[keep], ends[keep]
    return starts


def same_pieces(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the distinct piece of each piece, a piece of each number). Pieces of up to seven bytes are compared
    as numbers, longer ones by a mixed hash and then word for word with the piece that stands for them."""
    length = end - begin
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    head = words[begin]
    short = length < 8
    mask = (np.uint64(1) << (np.minimum(length, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
    keys = np.where(short, (head & mask) | (np.minimum(length, 7).astype(np.uint64) << np.uint64(56)), 0)
    rest = np.flatnonzero(~short)
    if len(rest):
        b, e = begin[rest], end[rest]
        h = _mix(length[rest].astype(np.uint64))
        left = np.arange(len(rest))
        step = 0
        while len(left):
            at = np.minimum(b[left] + step, e[left] - 8)
            h[left] = _mix(h[left] ^ words[at])
            step += 8
            left = left[b[left] + step < e[left]]
        keys[rest] = h | (np.uint64(0xFF) << np.uint64(56))
    _, firsts, which = np.unique(keys, return_index=True, return_inverse=True)
    if len(rest):
        rep = firsts[which[rest]]
        differs = length[rest] != length[rep]
        left = np.flatnonzero(~differs)
        step = 0
        while len(left):
            a, b, e = begin[rest[left]], begin[rep[left]], length[rest[left]]
            at = np.minimum(step, e - 8)
            differs[left] = words[a + at] != words[b + at]
            step += 8
            left = left[(step < e) & ~differs[left]]
        for i in rest[differs]:  # equal hashes of different pieces: as good as never
            firsts = np.append(firsts, i)
            which[i] = len(firsts) - 1
    return which, firsts


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


@lru_cache(4)
def bpe(path: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe(f.read())


_SENT: dict[str, Bpe] = {}


def _received(mark: str, shared: Broadcast) -> Bpe:
    if mark not in _SENT:
        _SENT[mark] = Bpe(shared.value)
    return _SENT[mark]


def sent(df: DataFrame, path: str) -> Callable[[], Bpe]:
    """A vocabulary file of the driver as a broadcast, so executors need not have it; what makes the model of it there,
    once a worker. The file must not be larger than :data:`LARGEST`."""
    if os.path.getsize(path) > LARGEST:
        raise ValueError(f"{path} is larger than {LARGEST} bytes")
    with open(path, "rb") as f:
        data = f.read()
    mark, shared = hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)

    return lambda: _received(mark, shared)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` code points, nulls as empty texts; a longer text is a run of its own."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > most:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def segments(text: str, most: int = CHUNK) -> Iterator[str]:
    """A long text in parts that are encoded alike alone and together: cut before a blank that follows no white space.
    Where there is no such blank the part is longer than ``most``."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while (cut := text.find(" ", cut)) > 0 and (text[cut - 1].isspace() or ord(text[cut - 1]) in WHITE_SPACE):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """``key`` and ``ids``, the list of token ids of the whole text; one row per row, in place, without a shuffle."""
    kind, vocabulary = df.schema[key].dataType.simpleString(), sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, part in chunks(texts):
                ids, offsets = model.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of the whole text."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    vocabulary = sent(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary()
        for batch in batches:
            counts = [np.diff(model.encode(part)[1]) for _, part in chunks(batch.column(len(keep)).to_pylist())]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, f"{schema}, n_tokens long")
