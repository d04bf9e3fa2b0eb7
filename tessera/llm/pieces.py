"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow

SPACE = "▁"
#: Chunks a worker remembers, bytes of text encoded at once, the longest remembered chunk, code points in a suffix array.
CACHE_CHUNKS, MATCH_CHARS, CACHE_CHARS, INDEX_CHARS = 400_000, 4_000_000, 64, 500_000
PAIRS = 4_000_000


class Pieces:
    """A SentencePiece BPE model (identity normaliser), encoding many chunks of text at once.

    A chunk is a run of spaces and what follows it up to the next: no piece has a space after
    another character, so no merge crosses a chunk's border (checked here). New chunks of a batch are
    concatenated and indexed by a suffix array (prefix doubling from blocks of 4 characters); every
    piece is binary-searched for the range of its occurrences; the occurrences are edges of a lattice.
    Sorted by where they end, they are relaxed from left to right: a prefix's encoding ends in the one
    piece that is compatible with the last piece of the encoding of what precedes it, two pieces being
    compatible if merging their joint text by the model's ranks gives just the two. (A sequence of
    pieces is the result of the merges exactly if all its neighbours are compatible.)
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.n, self.unk = n, sp.unk_id()
        self.text: list[str] = ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)]
        self.rank = {t: (-sp.get_score(i), i) for i, t in enumerate(self.text) if t}
        self.byte = np.full(256, self.unk, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        if any(SPACE in t.lstrip(SPACE) for t in self.text) or any("\0" in t for t in self.text):
            raise ValueError("a piece has a space after another character")
        self.newline = any("\n" in t for t in self.text)
        alphabet = sorted({c for t in self.text for c in t})
        if len(alphabet) > 65_000:
            raise ValueError("the pieces have too many different characters")
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.single = np.full(len(alphabet) + 1, -1, np.int64)
        for i, t in enumerate(self.text):
            if len(t) == 1:
                self.single[self.code[ord(t)]] = i
        self.known = np.array([i for i, t in enumerate(self.text) if t], np.int64)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.block = 4
        while self.block < self.size.max():
            self.block *= 2
        codes = np.zeros((len(self.known), self.block), np.uint16)
        for row, i in zip(codes, self.known, strict=True):
            row[: self.size[i]] = [self.code[ord(c)] for c in self.text[i]]
        self.low = codes
        self.high = np.where(np.arange(self.block) < self.size[self.known][:, None], codes, np.uint16(0xFFFF))
        # decoding: bytes of each id, spaces for SPACE
        raw = [b"" for _ in range(n)]
        for i, t in enumerate(self.text):
            raw[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            if i != self.unk:
                raw[i] = bytes([b])
        raw[self.unk] = raw[self.unk] or " ⁇ ".encode()
        self.raw_start = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.pair_keys, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)

    # pairs

    def merged(self, text: str) -> list[str]:
        """The model's merges on a text, best rank first, the leftmost of equals."""
        s = list(text)
        while len(s) > 1:
            best = min(((self.rank[x], i) for i in range(len(s) - 1) if (x := s[i] + s[i + 1]) in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each two pieces are compatible; ids from n on are characters that are in no piece."""
        key = first * (1 << 32) + second
        own, back = np.unique(key, return_inverse=True)
        out = np.ones(len(own), bool)
        todo = np.flatnonzero(((own >> 32) < self.n) & ((own & 0xFFFFFFFF) < self.n))
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, own[todo]), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == own[todo]
            out[todo[hit]] = self.pair_fits[at[hit]]
            todo = todo[~hit]
        if len(todo):
            for i in todo.tolist():
                a, b = self.text[int(own[i]) >> 32], self.text[int(own[i]) & 0xFFFFFFFF]
                out[i] = self.merged(a + b) == [a, b]
            if len(self.pair_keys) > PAIRS:
                self.pair_keys, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)
            keys = np.concatenate([self.pair_keys, own[todo]])
            order = np.argsort(keys, kind="stable")
            self.pair_keys, self.pair_fits = keys[order], np.concatenate([self.pair_fits, out[todo]])[order]
        return out[back]

    # matching

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of all pieces: start and piece."""
        n = len(codes)
        pad = np.concatenate([codes, np.zeros(self.block, np.uint16)]).astype(np.uint64)
        pack = lambda c, o: (c[..., o] << np.uint64(48)) | (c[..., o + 1] << np.uint64(32)) | (c[..., o + 2] << np.uint64(16)) | c[..., o + 3]
        key = (pad[:n] << np.uint64(48)) | (pad[1 : n + 1] << np.uint64(32)) | (pad[2 : n + 2] << np.uint64(16)) | pad[3 : n + 3]
        low = [pack(self.low.astype(np.uint64), o) for o in range(0, self.block, 4)]
        high = [pack(self.high.astype(np.uint64), o) for o in range(0, self.block, 4)]
        width, ranks = 4, []
        while True:
            own, rank = np.unique(key, return_inverse=True)
            # a block of a piece as the range of ranks from low to high
            low = [np.searchsorted(own, x, "left") for x in low]
            high = [np.searchsorted(own, x, "right") for x in high]
            ranks.append((width, rank, low[0], high[0]))
            if width >= self.block:
                break
            shifted = np.concatenate([rank[width:], np.zeros(min(width, n), np.int64)])[:n]
            key = (rank.astype(np.uint64) << np.uint64(32)) | shifted.astype(np.uint64)
            # the first half of a longer piece is one rank if it occurs at all; the second half is a range
            pairs = range(0, len(low), 2)
            gone = [high[i] - low[i] < 1 for i in pairs]
            low_next = [np.where(gone[j], np.uint64(1 << 63), (low[i].astype(np.uint64) << np.uint64(32)) | low[i + 1].astype(np.uint64)) for j, i in enumerate(pairs)]
            high_next = []
            for j, i in enumerate(pairs):
                top = (high[i] - 1).clip(0).astype(np.uint64) << np.uint64(32)
                last = high[i + 1].astype(np.int64) - 1
                high_next.append(np.where(gone[j] | (last < 0), np.uint64(0), top | last.clip(0).astype(np.uint64)))
            low, high = low_next, high_next
            width *= 2
        order = np.argsort(rank, kind="stable")  # the suffix array, by its first `block` characters
        start, piece = [], []
        for at, (w, r, lo, hi) in enumerate(ranks):
            mine = np.flatnonzero((self.size[self.known] <= w) & (self.size[self.known] > (ranks[at - 1][0] if at else 0)))
            along = r[order]
            a, b = np.searchsorted(along, lo[mine], "left"), np.searchsorted(along, hi[mine], "left")
            count = (b - a).clip(0)
            ends = np.cumsum(count)
            start.append(order[np.repeat(a - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)])
            piece.append(np.repeat(self.known[mine], count))
        return np.concatenate(start), np.concatenate(piece)

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (already with SPACE) one after another, and how many each has."""
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
        codes = self.code[points]
        start, piece = self.edges(codes)
        odd = np.flatnonzero(self.single[codes] < 0)  # characters without a piece of their own, and the borders
        border = np.zeros(len(points) + 1, bool)
        border[first[1:] - 1] = True
        odd = odd[~border[odd]]
        start, piece = np.concatenate([start, odd]), np.concatenate([piece, self.n + points[odd].astype(np.int64)])
        length = np.concatenate([self.size, [1]])[np.minimum(piece, self.n)]
        end = start + length
        chunk_of = np.searchsorted(first, start, "right") - 1
        depth = end - first[chunk_of]
        order = np.argsort(depth, kind="stable")
        start, piece, end, head = start[order], piece[order], end[order], first[chunk_of[order]]
        steps = np.searchsorted(depth[order], np.arange(1, int(size.max(initial=0)) + 2))
        last, cut = np.full(len(points) + 1, -1, np.int64), np.zeros(len(points) + 1, np.int64)
        for i, j in zip(steps[:-1], steps[1:], strict=True):
            s, p, e = start[i:j], piece[i:j], end[i:j]
            before = last[s]
            opening = s == head[i:j]
            able = opening | (before >= 0)
            good = opening.copy()
            ask = np.flatnonzero(able & ~opening)
            good[ask] = self.fits(before[ask], p[ask])
            last[e[good]], cut[e[good]] = p[good], s[good]
        # back from each end; the ends are where the borders stand
        at, who = first + size, np.arange(len(texts))
        found, owner = [], []
        while len(at):
            on = at > first[who]
            at, who = at[on], who[on]
            found.append(last[at]), owner.append(who)
            at = cut[at]
        ids, who = np.concatenate(found), np.concatenate(owner)
        back = np.argsort(who[::-1], kind="stable")
        ids, who = ids[::-1][back], who[::-1][back]
        lost = np.flatnonzero(ids >= self.n)
        if len(lost):  # byte fallback
            some = [self.byte[list(chr(int(x)).encode("utf-8", "replace"))] for x in ids[lost] - self.n]
            if (self.byte == self.unk).any():
                some = [np.array([self.unk])] * len(lost)
            count = np.ones(len(ids), np.int64)
            count[lost] = [len(x) for x in some]
            who = np.repeat(who, count)
            ends = np.cumsum(count)
            wide = np.repeat(ids, count)
            for x, e in zip(some, ends[lost], strict=True):
                wide[e - len(x) : e] = x
            ids = wide
        return ids.astype(np.int32), np.bincount(who, minlength=len(texts))

    # texts

    def split(self, text: str) -> list[str]:
        """Chunks, short: one without its single leading SPACE, one that starts a line as the newline and what follows."""
        if not text:
            return []
        t = text if self.newline else text.replace("\n", " \n")
        if SPACE not in t and "  " not in t and t[0] not in " \n" and t[-1] != " ":
            return t.split(" ")
        t = SPACE + text.replace(" ", SPACE)
        stop = SPACE if self.newline else SPACE + "\n"
        found = re.findall(f"{SPACE}*[^{stop}]+|{SPACE}+" + ("" if self.newline else f"|\n[^{stop}]*"), t)
        return [x[1:] if x[0] == SPACE and len(x) > 1 and x[1] not in (SPACE, "\n") else x for x in found]  # all start with SPACE or a newline

    def full_chunk(self, short: str) -> str:
        return short if short[0] in (SPACE, "\n") else SPACE + short

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of each text: without the space that encoding put before it."""
        n = (self.raw_start[1:] - self.raw_start[:-1])[ids]
        ends = np.cumsum(n)
        data = self.raw[np.repeat(self.raw_start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a + 1 if b > a and data[a : a + 1] == b" " else a : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """Remembers the ids of chunks over batches."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._clear()

    def _clear(self) -> None:
        self.number, self.start, self.flat = _Numbers(), np.zeros(1, np.int64), np.empty(0, np.int32)

    @staticmethod
    def _parts(chunks: list[str]) -> Iterator[list[str]]:
        """Chunks of about INDEX_CHARS in all: some edges start at each character, and they are held together."""
        at = np.cumsum([len(x) + 1 for x in chunks]) // INDEX_CHARS
        bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(chunks)]
        return (chunks[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > CACHE_CHUNKS:
            self._clear()
        split = [self.pieces.split(t) for t in texts]
        counts = np.array([len(x) for x in split], np.int64)
        number = np.fromiter(map(self.number.__getitem__, (w for x in split for w in x)), np.int64, int(counts.sum()))
        if self.number.new:
            for part in self._parts([self.pieces.full_chunk(x) for x in self.number.new]):
                ids, n = self.pieces.chunks(part)
                self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
                self.flat = np.concatenate([self.flat, ids])
            long = [x for x in self.number.new if len(x) > CACHE_CHARS]
            self.number.new = []
        else:
            long = []
        n = self.start[number + 1] - self.start[number]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[number] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[np.cumsum(counts)]
        if sum(map(len, long)) > CACHE_CHUNKS:  # not worth their memory
            self._clear()
        return ids, np.diff(ends, prepend=0)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)

        def flush(docs: list, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
            ids, sizes = coder.encode([x.decode("utf-8", "replace") for x in raw])
            back = coder.pieces.decode(ids, sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            for i in range(0, len(docs), 256):
                j = min(i + 256, len(docs))
                lists = pa.ListArray.from_arrays(pa.array((bounds[i : j + 1] - bounds[i]).astype(np.int32)), pa.array(ids[bounds[i] : bounds[j]], pa.int32()))
                yield arrow.batch(OUT, doc_id=docs[i:j], ids=lists, n_ids=sizes[i:j], decoded_crc32=[zlib.crc32(x) for x in back[i:j]], round_trip=[a == b for a, b in zip(back[i:j], raw[i:j], strict=True)])

        docs, raw, held = [], [], 0
        for b in arrow.full(batches):
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc), raw.append(x)
                held += len(x)
                if held >= MATCH_CHARS:
                    yield from flush(docs, raw)
                    docs, raw, held = [], [], 0
        if docs:
            yield from flush(docs, raw)

    return run


def encode_decode(documents: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every whole text, and what decoding them gives.

    The texts of a batch are cut into chunks, and those that the worker has not met before are concatenated and
    indexed (see ``Pieces``); the others' ids are known.

    Null and empty texts have no ids; one of any length is encoded whole. Characters in no piece become byte pieces. A text that has
    U+2581 itself does not come back: SentencePiece takes it for a space; nor does what is no UTF-8, which counts as U+FFFD.
    Rows stay as they are, repeated ones too; ties between pieces go by the model's ranks. An empty table gives none. Only the
    two columns are read.

    Columns: doc_id, ids, n_ids, decoded_crc32 (of the decoded bytes), round_trip (they equal the text's).
    """
    docs = arrow.narrowed(documents, doc_id=F.col(id_col).cast("long"), text=arrow.raw(F.col(text_col)))
    return docs.mapInArrow(_encode(model), "doc_id long, ids array<int>, n_ids long, decoded_crc32 long, round_trip boolean")
