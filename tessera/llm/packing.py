"""Token ids of documents packed online into windows by the sum-of-squares rule.

Each task packs the rows of its part as they come. A document's whole windows stand alone; what is left of it goes to
the fill level that makes the sum of squared counts of partly filled windows least. The counts stand in an array
by level, with the open windows of a level beside it.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow

#: Tokens of a window; windows that a task holds open; sequences of a part, of which the number has so many low bits.
WINDOW, OPEN, LOW = 2048, 4096, 40
#: Parts of words a worker remembers; bytes of text encoded at once; parts given to the tokenizer as one text.
CACHE_PARTS, ENCODE_BYTES, JOINED = 500_000, 8 << 20, 64
#: White space (Unicode's). Where none follows a space or a line break, a piece begins at the space, and behind the break.
WHITE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARK = "\x00"  # stands for a line break
HARD = f"[{WHITE}][{WHITE}]|{MARK}"  # texts that are encoded whole
WORD = rf"(?s)^(?P<core>{MARK}?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[^A-Za-zÀ-ÖØ-öø-ÿ].*)?$"
PLAIN = f"(?s)^[^{WHITE}](.*[^{WHITE}])?$"

PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES_DDL.split(", ")])


class _Parts:
    """Parts of words seen, and the ids of each."""

    def __init__(self, learn):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.start, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """Numbers of the parts; ids of new ones are learnt."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary())
        new = distinct.filter(pc.invert(pc.is_in(distinct, self.known)))
        if len(new):
            flat, sizes = self.learn(new.to_numpy(zero_copy_only=False).tolist())
            self.known = pa.concat_arrays([self.known, new])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
        return pc.index_in(distinct, self.known).to_numpy()[coded.indices.to_numpy()]


class Encoder:
    """The tokenizers library, asked once for the letters that begin a word, and once for what follows them.

    The ids are those of the whole text (tested): a byte-level pre-tokenizer begins a piece at a space, behind a line break and
    behind a run of letters, and nothing joins over that. Texts with runs of white space, and all texts for other
    tokenizers (``whole``), are encoded as they are.
    """

    def __init__(self, path: str, whole: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of an id: a character of its name each
        self.width[list(vocab.values())] = [len(t) for t in vocab]
        self.spaced, self.bare = _Parts(lambda x: self._learn(x, b" ", b"")), _Parts(lambda x: self._learn(x, b"", b"\n"))

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, parts: list[bytes], before: bytes, behind: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts with ``before``, and how many each has. JOINED of them make a text, parted by a space or a line break:
        the ids' widths tell where one ends. What begins or ends with white space is asked for alone."""
        plain = pc.match_substring_regex(pa.array(parts, pa.large_binary()).view(pa.large_string()), PLAIN).to_numpy(zero_copy_only=False)
        trim = len(behind)  # a line break is one id
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(parts)
        places = np.flatnonzero(plain)
        groups = [places[i : i + JOINED] for i in range(0, len(places), JOINED)]
        alone = np.flatnonzero(~plain).tolist()
        for group, ids in zip(groups, self._ids([before + (behind + before).join([parts[i] for i in g]) + behind for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            ends, borders = np.cumsum(self.width[ids]), np.cumsum([len(parts[i]) + 1 for i in group])
            at = np.searchsorted(ends, borders)
            if at[-1] < len(ends) and (ends[at] == borders).all():
                for i, x, y in zip(group.tolist(), [0, *(at[:-1] + 1).tolist()], (at + 1 - trim).tolist(), strict=True):
                    out[i] = ids[x:y]
            else:
                alone += group.tolist()
        for i, ids in zip(alone, self._ids([before + parts[i] for i in alone]), strict=True):
            out[i] = np.array(ids, np.uint32)
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _words(self, words: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, each with the space or line break before it, and how many each has; bare ones (not ``spaced``) have neither."""
        found = pc.extract_regex(words, WORD)
        core, rest = pc.struct_field(found, "core"), pc.struct_field(found, "rest")
        marked = pc.starts_with(words, MARK).to_numpy(zero_copy_only=False)
        first = pc.if_else(found.is_valid(), core, words)  # without letters in front: as it is
        first = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(first, 1), first).view(pa.large_binary())
        rest = pc.fill_null(pc.if_else(found.is_valid(), rest, pa.scalar("", pa.large_string())), "").view(pa.large_binary())
        own = spaced & ~marked
        a, b, c = np.empty(len(words), np.int64), np.empty(len(words), np.int64), self.bare.numbers(rest)
        x, y = self.spaced.numbers(first.filter(pa.array(own))), self.bare.numbers(first.filter(pa.array(~own)))
        base, bare = len(self.spaced.flat), self.bare.start
        a[own], b[own] = self.spaced.start[x], np.diff(self.spaced.start)[x]
        a[~own], b[~own] = base + bare[y], np.diff(bare)[y]
        flat = np.concatenate([self.spaced.flat, self.bare.flat, self.line])
        lead = (marked & spaced).astype(np.int64)
        starts = np.stack([np.full(len(words), len(flat) - 1), a, base + bare[c]], 1).ravel()
        sizes = np.stack([lead, b, np.diff(bare)[c]], 1)
        return _taken(flat, starts, sizes.ravel()), sizes.sum(1)

    @functools.cached_property
    def line(self) -> np.ndarray:
        return np.array(self._ids([b"\n"])[0], np.uint32)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts, each followed by ``end``, and the number of each text's ids."""
        texts = texts.cast(pa.large_binary()).view(pa.large_string())
        hard = np.ones(len(texts), bool) if self.whole else pc.match_substring_regex(texts, HARD).to_numpy(zero_copy_only=False)
        parts = []
        if not hard.all():
            parts.append(self._split(texts.filter(pa.array(~hard)), end))
        if hard.any():
            ids = self._ids(texts.filter(pa.array(hard)).view(pa.large_binary()).to_pylist())
            parts.append((np.array([i for x in ids for i in [*x, end]], np.uint32), np.array([len(x) + 1 for x in ids], np.int64)))
        if len(parts) == 1:
            return parts[0]
        order = np.argsort(np.concatenate([np.flatnonzero(~hard), np.flatnonzero(hard)]))
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _taken(flat, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]

    def _split(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        for known in (self.spaced, self.bare):
            if len(known.known) > CACHE_PARTS:
                known.clear()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " " + MARK), " ")
        counts = split.value_lengths().to_numpy().astype(np.int64)
        heads = np.cumsum(counts) - counts
        found = split.flatten().dictionary_encode()
        index = found.indices.to_numpy()
        begins = found.dictionary.take(pa.array(index[heads])).dictionary_encode()  # a text's first word has nothing before it
        distinct = pa.concat_arrays([found.dictionary, begins.dictionary])
        flat, sizes = self._words(distinct, np.arange(len(distinct)) < len(found.dictionary))
        flat, sizes = np.append(flat, np.uint32(end)), np.append(sizes, 1)
        index = index.astype(np.int64)
        index[heads] = len(found.dictionary) + begins.indices.to_numpy()
        words = np.insert(index, heads + counts, len(distinct))  # the end is one more word
        n = sizes[words]
        lasts = np.cumsum(counts + 1) - 1
        return _taken(flat, (np.cumsum(sizes) - sizes)[words], n), np.diff(np.cumsum(n)[lasts], prepend=0)


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of flat, one after another."""
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    place += np.arange(len(place))
    return flat[place]


@functools.lru_cache(maxsize=2)
def encoder(path: str, whole: bool = False) -> Encoder:
    """One a worker: it keeps its chunks over tasks."""
    return Encoder(path, whole)


Piece = tuple  # doc_id, start, ids, doc_tokens


class Packer:
    """Open windows by fill level. ``done`` gets a closed sequence: a list of pieces."""

    def __init__(self, done, window: int = WINDOW, most: int = OPEN):
        self.done, self.window, self.most = done, window, most
        self.levels: dict[int, list[list[Piece]]] = {}
        self.open = 0
        self.arrive = np.ones(window + 1)  # 2n + 1: what one more window at a level adds to the sum of squares
        self.arrive[window] = 0  # a full one is closed
        self.leave = np.full(window + 1, np.inf)  # 1 - 2n: what one less adds; none to take where the level is empty
        self.leave[0] = 0  # a new window

    def _count(self, level: int) -> None:
        n = len(self.levels[level])
        self.arrive[level], self.leave[level] = 2 * n + 1, 1 - 2 * n if n else np.inf

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while n - at >= self.window:
            self.done([(doc_id, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            self._place((doc_id, at, ids[at:].copy(), n))

    def _place(self, piece: Piece) -> None:
        size = len(piece[2])
        room = self.window - size
        cost = (self.leave[: room + 1] + self.arrive[size:])[::-1]  # the fullest level first: it wins ties
        level = room - int(cost.argmin())
        held = [] if level == 0 else self.levels[level].pop()
        if level:
            self._count(level)
        held.append(piece)
        if level == room:
            self.open -= level > 0
            self.done(held)
            return
        self.open += level == 0
        self.levels.setdefault(level + size, []).append(held)
        self._count(level + size)
        if self.open > self.most:
            self._close()

    def _close(self) -> None:
        """Pours all open windows into whole ones, the fullest first, so few documents are cut; one window at most stays open."""
        rest, free = [], self.window
        for level in sorted(self.levels, reverse=True):
            for held in self.levels[level]:
                for doc_id, start, ids, n in held:
                    at = 0
                    while at < len(ids):
                        take = min(free, len(ids) - at)
                        rest.append((doc_id, start + at, ids[at : at + take], n))
                        at, free = at + take, free - take
                        if not free:
                            self.done(rest)
                            rest, free = [], self.window
        for level in list(self.levels):
            self.levels[level] = []
            self._count(level)
        self.open = int(bool(rest))
        if rest:
            self.levels[self.window - free] = [rest]
            self._count(self.window - free)

    def finish(self) -> None:
        """Closes all. The last window is cut into powers of two, which need no padding."""
        self._close()
        for level in list(self.levels):
            for held in self.levels[level]:
                sizes = [1 << b for b in range(level.bit_length() - 1, -1, -1) if level >> b & 1]
                part: list[Piece] = []
                for doc_id, start, ids, n in held:
                    at = 0
                    while at < len(ids):
                        take = min(sizes[0], len(ids) - at)
                        part.append((doc_id, start + at, ids[at : at + take], n))
                        at += take
                        sizes[0] -= take
                        if not sizes[0]:
                            self.done(part)
                            sizes, part = sizes[1:], []
        self.levels, self.open = {}, 0


def _pack(path: str, end: int, window: int, most: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = encoder(path, whole), TaskContext.get().partitionId() << LOW
        out: list[tuple] = []

        def done(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, n in pieces:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), n, number, offset))
                offset += len(ids)
            number += 1

        def table() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PIECES)

        packer = Packer(done, window, most)
        for names, texts in _gathered(batches):
            ids, sizes = coder.encode(texts, end)
            upto = np.cumsum(sizes)
            for doc_id, i, j in zip(names, (upto - sizes).tolist(), upto.tolist(), strict=True):
                packer.add(doc_id, ids[i:j])
            if out:
                yield table()
                out.clear()
        packer.finish()
        if out:
            yield table()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of some megabytes at once, so that a chunk is looked up once for many texts."""
    names, texts, held = [], [], 0
    for b in arrow.full(batches):
        names += b.column(0).to_pylist()
        texts.append(arrow.valid(b.column(1)))
        held += texts[-1].nbytes
        if held >= ENCODE_BYTES:
            yield names, pa.concat_arrays([t.cast(pa.large_binary()) for t in texts])
            names, texts, held = [], [], 0
    if names:
        yield names, pa.concat_arrays([t.cast(pa.large_binary()) for t in texts])


def pack(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 1, window: int = WINDOW, most: int = OPEN, whole: bool = False) -> DataFrame:
    """Pieces of the documents' ids (each document's, then ``end``) in sequences of at most ``window`` tokens.

    Parts of the scan are packed apart, without a shuffle; a repeated task reads its part in the same order and so gives the same pieces
    and numbers. A part holds at most ``most`` open windows; beyond that, and at its end, they are poured together (documents
    are cut there), and the part's last window is cut into powers of two, so no sequence is padded. Null and empty texts are
    their end alone, null ids stay null, rows that share an id are documents of their own, an empty table gives no rows, what is no UTF-8
    counts as U+FFFD. Only the two columns are read. A very long text is one array of ids in its task.
    """
    docs = arrow.narrowed(documents, doc_id=F.col(id_col).cast("long"), text=arrow.raw(F.col(text_col)))
    return docs.mapInArrow(_pack(tokenizer, end, window, most, whole), PIECES_DDL)
