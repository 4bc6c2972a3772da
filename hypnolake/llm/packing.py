"""Sequence packing by minimum bin slack.

Documents become token ids plus an end id. Whole windows are cut off the front of long documents; what
remains, always shorter than a window, waits in a pool of bounded size. A window is opened with the
longest waiting remainder and a subset-sum over the multiset of waiting lengths (one bit per
reachable sum) picks the counts that come closest to its capacity. A gap that no subset can close is closed by
cutting one more remainder, and the last, part-filled window of a task is cut into powers of two, so nothing is padded.

The work is one pass over the input splits: no shuffle, no group, memory bounded by the pool. A lost
task is run again on its split and gives the same pieces.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, query, table

WINDOW = 2048
POOL = 4096
EOD = 1
MEMO_WORDS = 800_000
WORDS_AT_ONCE = 2000
END_OF_WORD = "</w>"
# Fixed value: the pattern by which the tokenizer parts a word
_UNITS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
FLUSH_IDS = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def _stable(word: str) -> bool:
    """Whether normal form and lower case leave the word's units where they are."""
    return unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", word.lower()) and "\u0130" not in word


@lru_cache(maxsize=2)
def _encoder(path: str, memo_words: int | None = None):
    """texts -> little-endian ids. Whitespace always parts words here, so a word's ids are kept by the word, about ``memo_words`` of them.

    New words are cut into the units that the tokenizer's own pattern gives. A unit of letters ends with one end-of-word token, so new ones are
    encoded many at a time and cut there.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    ends = np.zeros(tok.get_vocab_size(), bool)
    for token, i in tok.get_vocab().items():
        ends[i] = token.endswith(END_OF_WORD)
    memo: dict[bytes, bytes] = {}  # ids of words
    units: dict[str, bytes] = {}  # ids of what words are made of

    def alone(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(letters: list[str]) -> None:
        ids = np.array(tok.encode(" ".join(letters), add_special_tokens=False).ids, "<u4")
        stop = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(stop) != len(letters):  # a letter that lower case makes two
            half = len(letters) // 2
            for part in (letters[:half], letters[half:]):
                if len(part) == 1:
                    units[part[0]] = alone(part[0])
                elif part:
                    learn(part)
            return
        raw = ids.tobytes()
        units.update((w, raw[i:j]) for w, i, j in zip(letters, [0, *stop], stop))

    def encode(texts: list[str]) -> Iterator[bytes]:
        limit = MEMO_WORDS if memo_words is None else memo_words
        if len(memo) > limit:
            memo.clear()
        if len(units) > limit:
            units.clear()
        split = []
        for text in texts:
            raw = text.encode()
            if b"<|" not in raw:  # special tokens are matched before lower-casing
                raw = raw.lower()
            split.append(raw.split())
        made: dict[bytes, list[str]] = {}
        for w in set().union(*split).difference(memo):
            text = w.decode()
            if "<|" in text or not (w.isascii() or _stable(text)):
                memo[w] = alone(text)
            else:
                made[w] = _UNITS.findall(text)
        new = {u for parts in made.values() for u in parts}.difference(units)
        letters = [u for u in new if u.isalpha()]
        for i in range(0, len(letters), WORDS_AT_ONCE):
            learn(letters[i : i + WORDS_AT_ONCE])
        units.update((u, alone(u)) for u in new.difference(letters))
        memo.update((w, b"".join([units[u] for u in parts])) for w, parts in made.items())
        for words in split:
            yield b"".join(map(memo.__getitem__, words))

    return encode


def _runs(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Successive texts of about ``chars`` characters together; no others are made Python's."""
    held, size = [], 0
    for t in map(pa.StringScalar.as_py, texts):
        held.append(t)
        size += len(t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def closest_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts by length, at most ``counts``, whose total comes closest to ``capacity`` from below.

    ``lengths`` ascends. ``reach`` has bit s set when some choice sums to s; it is kept per step for the way back.
    """
    mask = (1 << (capacity + 1)) - 1
    full = 1 << capacity
    reach, steps = 1, []
    for k in range(bisect.bisect_right(lengths, capacity) - 1, -1, -1):
        size = lengths[k]
        steps.append((size, reach))
        left, part = min(counts[size], capacity // size), 1
        while left:  # multiplicity in doubling parts
            take = min(part, left)
            reach |= reach << (take * size) & mask
            left -= take
            part *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= size
            n += 1
        if n:
            chosen[size] = n
    return chosen


class Packer:
    """Packs (doc, ids) into windows; ``emit`` gets (doc, start, ids, doc_tokens, sequence, offset) per piece."""

    def __init__(self, window: int, pool: int, emit):
        self.window, self.limit, self.emit = window, pool, emit
        self.waiting: dict[int, list] = defaultdict(list)
        self.lengths: list[int] = []
        self.n = self.total = self.sequence = 0

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            self.emit(doc, start, ids[4 * start : 4 * (start + self.window)], n, self.sequence, 0)
            self.sequence += 1
        if n > whole:
            self._wait((doc, whole, ids[4 * whole :], n))
        if self.n >= self.limit:
            while self.n > self.limit // 2 and self.total >= self.window:
                self._fill()

    def close(self) -> None:
        while self.total >= self.window:
            self._fill()
        self._powers()

    def _wait(self, piece) -> None:
        size = len(piece[2]) // 4
        if not self.waiting[size]:
            bisect.insort(self.lengths, size)
        self.waiting[size].append(piece)
        self.n += 1
        self.total += size

    def _take(self, size: int):
        piece = self.waiting[size].pop()
        if not self.waiting[size]:
            del self.lengths[bisect.bisect_left(self.lengths, size)], self.waiting[size]
        self.n -= 1
        self.total -= size
        return piece

    def _cut(self, piece, at: int):
        doc, start, ids, n = piece
        self._wait((doc, start + at, ids[4 * at :], n))
        return doc, start, ids[: 4 * at], n

    def _put(self, pieces) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.emit(doc, start, ids, n, self.sequence, offset)
            offset += len(ids) // 4
        self.sequence += 1

    def _fill(self) -> None:
        pieces = [self._take(self.lengths[-1])]
        room = self.window - len(pieces[0][2]) // 4
        counts = {s: len(self.waiting[s]) for s in self.lengths}
        for size, n in closest_fill(self.lengths, counts, room).items():
            for _ in range(n):
                pieces.append(self._take(size))
            room -= n * size
        if room:  # every waiting piece is longer than the gap, as the subset could not grow
            pieces.append(self._cut(self._take(self.lengths[-1]), room))
        self._put(pieces)

    def _powers(self) -> None:
        for bit in range(self.total.bit_length() - 1, -1, -1):
            room = 1 << bit
            if not self.total & room:
                continue
            pieces = []
            while room:
                piece = self._take(self.lengths[-1])
                if len(piece[2]) // 4 > room:
                    piece = self._cut(piece, room)
                pieces.append(piece)
                room -= len(piece[2]) // 4
            self._put(pieces)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, pool: int = POOL, end_id: int = EOD, memo_words: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Null or empty text is the end id alone; a null doc_id stays null; equal rows are packed each for itself; a text of any
    length is cut at the window; an empty table gives no rows. Other columns are not read. Sequences are full windows or
    powers of two, their ids unique over the result: the task's partition times 2**33 plus its own count. Fewer ``memo_words`` take less
    memory and more time, the pieces are the same.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what other stages left in the worker
        encode = _encoder(tokenizer_path, memo_words)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0

        def emit(doc, start, ids, n, sequence, offset):
            nonlocal held
            rows.append((doc, start, len(ids) // 4, ids, n, base + sequence, offset))
            held += len(ids) // 4

        def flush():
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
            rows, held = [], 0
            return out

        packer = Packer(window, pool, emit)
        for batch in batches:
            encoded = (ids for some in _runs(batch.column(1)) for ids in encode(some))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded):
                packer.add(doc, ids + end)
                if held >= FLUSH_IDS:
                    yield flush()
        packer.close()
        if rows:
            yield flush()

    return id_text(docs).mapInArrow(run, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 2048 ids."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
