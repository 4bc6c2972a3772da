"""Alignment of two tokenizers by inverted pair bitmaps.

Two tokens are linked where their byte ranges overlap. Documents are numbered inside blocks; every id pair has, per block, one bitmap of
documents for each binary digit of its number of links in a document (multiplicity planes). A pair's bitmaps are OR-merged and popcounted
for its document count, its planes weigh its links. The counts then go back along the postings: each block adds them up per document.

Bitmaps are compressed: a sorted list of 16-bit document numbers, or plain bits where these are shorter. Blocks close at ``BLOCK_DOCS`` documents
or ``BLOCK_LINKS`` links, so a block's rows fit in one task; a frequent pair has a row per block, which its join may spread.

Texts are cut into pieces at a space after a character that is no space: both tokenizers end a token there whatever stands beyond, so
a piece has the same ids alone as in its text. Pieces are encoded together where new, remembered, and added up per document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import id_text, query, table

BLOCK_DOCS = 1 << 16
BLOCK_LINKS = 1 << 22
MEMO_PIECES = 300_000
RIGHT_BITS = 20  # of a pair: the right id
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_STORED = f"block long, ordinal int, {_DOC}, pair long, planes array<binary>"
_STORED_ARROW = pa.schema([
    ("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("planes", pa.list_(pa.binary())),
])
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
# A cut: a space after a character that neither tokenizer takes for a space (U+2581 is the right one's space)
_CUT = re.compile("(?<=[^\\s▁])(?= )")
_SPACED = re.compile("[\\s▁]\\Z")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------ tokenizers
def _byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def left_tokenizer(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """A byte-level BPE: its encoder and every id's bytes."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    byte = _byte_symbols()
    spelled = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
    return lambda text: tok.encode(text, add_special_tokens=False).ids, [bytes(byte.get(c, 63) for c in s) for s in spelled]


def right_tokenizer(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """A piece model that puts a space before the text: its encoder of texts given with that space, and every id's bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    last = sp.encode("a ")[len(sp.encode("a")) :]  # a space that ends a text; alone it would be none
    return lambda text: sp.encode(text[1:]) if text != " " else last, spelled


# ------------------------------------------------------------------ pieces
class Pieces:
    """What is known of every piece seen: counts, links and the text of its groups, under a running number."""

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.left_size, self.right_size = (np.array([len(b) for b in side[1]], "int64") for side in (left, right))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), "int64")  # left tokens, right tokens, groups, links, 1 where the bytes are not the text's
        self.links = np.zeros(0, "int64")
        self.link_start = np.zeros(1, "int64")

    def learn(self, texts: Iterable[str]) -> None:
        """Encode new pieces, many at once: those that end in a space go alone, for it would run into the next."""
        together, alone = [], []
        for t in texts:
            (alone if _SPACED.search(t) else together).append(t)
        for i in range(0, len(together), 4000):
            self._add(together[i : i + 4000])
        for t in alone:
            self._add([t])

    def _add(self, texts: list[str]) -> None:
        whole = "".join(texts)
        data = whole.encode()
        ends = np.cumsum([len(t.encode()) for t in texts])
        ids = [np.array(side[0](whole), "int64") for side in (self.left, self.right)]
        spelled = [b"".join([side[1][i] for i in x.tolist()]) for side, x in zip((self.left, self.right), ids)]
        if len(texts) > 1 and (spelled[0] != data or spelled[1] != data):
            half = len(texts) // 2  # close in on what is not spelled back
            self._add(texts[:half])
            self._add(texts[half:])
            return
        if spelled[0] != data or spelled[1] != data or not texts[0]:
            self._keep(texts, np.array([[0, 0, 0, 0, 1]]), [""], np.zeros(0, "int64"))
            return
        a, b = ids
        a_end, b_end = np.cumsum(self.left_size[a]), np.cumsum(self.right_size[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        # the right tokens that a left one overlaps: from the first that ends after its start to the first that ends at or after its end
        first = np.searchsorted(b_end, a_end - self.left_size[a], "right")
        n = np.searchsorted(b_end, a_end, "left") - first + 1
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        links = (np.repeat(a, n) << RIGHT_BITS) | b[at]
        piece_of = lambda end: np.searchsorted(ends, end, "left")
        size = len(texts)
        per = [np.bincount(piece_of(e), minlength=size) for e in (a_end, b_end, cuts)]
        per.append(np.bincount(np.repeat(piece_of(a_end), n), minlength=size))
        counts = np.column_stack([*per, np.zeros(size, "int64")])
        self._keep(texts, counts, _group_texts(a, np.searchsorted(a_end, cuts, "right"), b, np.searchsorted(b_end, cuts, "right"), np.cumsum(per[2])), links)

    def _keep(self, texts: list[str], counts: np.ndarray, groups: list[str], links: np.ndarray) -> None:
        self.number.update(zip(texts, range(len(self.groups), len(self.groups) + len(texts))))
        self.groups += groups
        self._new.append((counts, links))

    def number_all(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The pieces of every document by number, new ones learned."""
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        known = self.number
        self.learn(dict.fromkeys(p for d in docs for p in d if p not in known))
        if self._new:
            self.counts = np.concatenate([self.counts, *[c for c, _ in self._new]])
            self.links = np.concatenate([self.links, *[x for _, x in self._new]])
            self.link_start = np.concatenate([[0], np.cumsum(self.counts[:, 3])])
        return [np.fromiter(map(known.__getitem__, d), "int64", len(d)) for d in docs]

    def links_of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the given pieces, one after the other, and their number per piece."""
        n = self.counts[pieces, 3]
        at = np.repeat(self.link_start[pieces] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.links[at], n


def _group_texts(a: np.ndarray, a_cut: np.ndarray, b: np.ndarray, b_cut: np.ndarray, piece_cut: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` per piece: ``a_cut`` and ``b_cut`` end the groups, ``piece_cut`` the pieces."""
    sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for k, m in zip(a_cut.tolist(), b_cut.tolist()):
        out.append(f"{','.join(sa[i:k])}|{','.join(sb[j:m])}")
        i, j = k, m
    ends = piece_cut.tolist()
    return [";".join(out[s:e]) for s, e in zip([0, *ends], ends)]


# ------------------------------------------------------------------ bitmaps
def pack(rows: np.ndarray, numbers: np.ndarray, n_rows: int, size: int) -> pa.Array:
    """One bitmap per row: ``numbers`` (below ``size``) ascending within ascending ``rows``.

    The first two bytes tell the form: 0, then 16-bit numbers, or 1, then bits, where these are fewer bytes.
    """
    n = np.bincount(rows, minlength=n_rows)
    stop = np.cumsum(n)
    wide = -(-size // 16) * 2
    words = np.zeros(len(numbers) + n_rows, "<u2")
    words[np.arange(len(numbers)) + rows + 1] = numbers
    data, parts, done = words.tobytes(), [], 0
    length = 2 * (n + 1)
    for r in np.flatnonzero(2 * n > wide).tolist():
        s, e = int(stop[r] - n[r]), int(stop[r])
        bits = np.zeros(wide * 8, "u1")
        bits[numbers[s:e]] = 1
        parts += [data[done : 2 * (s + r)], b"\x01\x00", np.packbits(bits, bitorder="little").tobytes()]
        done, length[r] = 2 * (e + r + 1), wide + 2
    offsets = np.concatenate([[0], np.cumsum(length)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join([*parts, data[done:]]))])


def unpack(maps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, document number) of every bit set."""
    if isinstance(maps, pa.ChunkedArray):
        maps = maps.combine_chunks()
    if not len(maps):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    kind = "<i8" if pa.types.is_large_binary(maps.type) else "<i4"
    offsets = np.frombuffer(maps.buffers()[1], kind)[maps.offset : maps.offset + len(maps) + 1].astype("int64") // 2
    words = np.frombuffer(maps.buffers()[2], "<u2", count=int(offsets[-1]))
    start, n = offsets[:-1] + 1, np.diff(offsets) - 1
    dense = np.flatnonzero(words[offsets[:-1]] == 1)
    m = n.copy()
    m[dense] = 0
    rows, numbers = np.repeat(np.arange(len(maps)), m), words[np.repeat(start - np.cumsum(m) + m, m) + np.arange(m.sum())].astype("int64")
    found = [(np.full(len(x), r), x) for r in dense.tolist() for x in [np.flatnonzero(np.unpackbits(words[start[r] : start[r] + n[r]].view("u1"), bitorder="little"))]]
    return np.concatenate([rows, *[r for r, _ in found]]), np.concatenate([numbers, *[x for _, x in found]])


def _planes(pairs: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, pa.Array]:
    """Distinct pairs of a block, ascending, and each one's bitmaps by multiplicity plane; one entry of ``pairs`` is one link."""
    key = np.sort((pairs << 16) | docs)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    pair, doc = key >> 16, key & 0xFFFF
    names, row = np.unique(pair, return_inverse=True)
    top = np.zeros(len(names), "int64")
    np.maximum.at(top, row, times)
    n_planes = np.frexp(top.astype("float64"))[1].astype("int64")  # binary digits
    first = np.concatenate([[0], np.cumsum(n_planes)])
    cells, numbers = [], []
    for p in range(int(n_planes.max())):
        on = (times >> p) & 1 == 1
        cells.append(first[row[on]] + p)
        numbers.append(doc[on])
    cell, number = np.concatenate(cells), np.concatenate(numbers)
    order = np.argsort(cell, kind="stable")  # documents stay ascending
    maps = pack(cell[order], number[order], int(first[-1]), n_docs)
    return names, pa.ListArray.from_arrays(pa.array(first.astype("int32")), maps)


# ------------------------------------------------------------------ the job
def _blocks(left_path: str, right_path: str):
    """Arrow batches of (doc_id, text) to rows of documents (ordinal set) and of postings (pair set), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(left_tokenizer(left_path), right_tokenizer(right_path))
        part, made = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []  # pieces of the open block's documents with tokens
        which: list[int] = []
        n_docs = n_links = 0

        def postings() -> Iterator[pa.RecordBatch]:
            links, n = pieces.links_of(np.concatenate(held)) if held else (np.zeros(0, "int64"), None)
            if not len(links):
                return
            docs = np.repeat(np.repeat(np.array(which, "int64"), [len(h) for h in held]), n)
            names, planes = _planes(links, docs, n_docs)
            for i in range(0, len(names), 10_000):
                yield _batch(block=np.full(len(names[i : i + 10_000]), block), pair=names[i : i + 10_000], planes=planes[i : i + 10_000])

        block = part << 32
        for batch in batches:
            texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for s, e in _spans(texts):
                numbers = pieces.number_all([_CUT.split(" " + t) if t else [] for t in texts[s:e]])
                rows = []
                for doc_id, x in zip(doc_ids[s:e], numbers):
                    if n_docs == BLOCK_DOCS or n_links >= BLOCK_LINKS:
                        yield _batch(**_doc_columns(rows))
                        rows = []
                        yield from postings()
                        made += 1
                        block, n_docs, n_links, held, which = (part << 32) + made, 0, 0, [], []
                    a, b, g, links, odd = pieces.counts[x].sum(axis=0).tolist() if len(x) else (0, 0, 0, 0, 1)
                    if odd:
                        a = b = g = links = 0
                        sha = ""
                    else:
                        sha = hashlib.sha256(";".join([pieces.groups[i] for i in x.tolist()]).encode()).hexdigest()
                        held.append(x)
                        which.append(n_docs)
                    rows.append((block, n_docs, doc_id, a, b, g, links, sha))
                    n_docs += 1
                    n_links += links
                yield _batch(**_doc_columns(rows))
                if len(pieces.groups) > MEMO_PIECES:  # numbers change: the open block must go first
                    yield from postings()
                    made += 1
                    block, n_docs, n_links, held, which = (part << 32) + made, 0, 0, [], []
                    pieces.clear()
        yield from postings()

    return run


def _spans(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` characters together."""
    start = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= chars or i == len(texts):
            yield start, i
            start, size = i, 0


def _doc_columns(rows: list[tuple]) -> dict:
    names = ("block", "ordinal", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return dict(zip(names, map(list, zip(*rows)))) if rows else {"block": []}


def _batch(**columns) -> pa.RecordBatch:
    """A batch of the stored columns; those not given are null."""
    n = len(columns["block"])
    arrays = [c if isinstance(c := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for f in _STORED_ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=_STORED_ARROW)


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n_docs, n_links per posting row: planes OR-merged and popcounted; plane p has 2**p links a bit."""
    for batch in batches:
        row, plane, doc, n = _bits(batch.column("planes"))
        merged = np.unique((row << 16) | doc) >> 16
        docs = np.bincount(merged, minlength=n)
        links = np.zeros(n, "int64")
        np.add.at(links, row, np.int64(1) << plane)
        yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(docs, pa.int64()), pa.array(links, pa.int64())], names=["pair", "n_docs", "n_links"])


def _bits(planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, plane, document number) of every bit set in lists of bitmaps, and the number of rows."""
    if isinstance(planes, pa.ChunkedArray):
        planes = planes.combine_chunks()
    sizes = planes.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell, doc = unpack(planes.flatten())
    return owner[cell], place[cell], doc, len(sizes)


def _return_scores(rows: pa.Table) -> pa.Table:
    """One block's documents with the counts of their links added up from its postings."""
    is_doc = pc.is_valid(rows["ordinal"])
    docs, posts = rows.filter(is_doc), rows.filter(pc.invert(is_doc))
    ordinal = docs["ordinal"].to_numpy()
    size = int(ordinal.max()) + 1 if len(ordinal) else 0
    best, total = np.zeros(size, "int64"), np.zeros(size, "int64")
    for s in range(0, len(posts), 100_000):
        part = posts.slice(s, 100_000)
        row, plane, doc, _ = _bits(part["planes"])
        times, count = np.int64(1) << plane, part["count"].to_numpy()[row]
        top = part["best"].to_numpy(zero_copy_only=False).astype(bool)[row]
        best += np.bincount(doc[top], times[top], size).astype("int64")
        # sums of floats are exact below 2**53: high and low digits apart
        total += np.bincount(doc, times * (count & 0xFFFFF), size).astype("int64") + (np.bincount(doc, times * (count >> 20), size).astype("int64") << 20)
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {"n_best": pa.array(best[ordinal], pa.int64()), "count_sum": pa.array(total[ordinal], pa.int64()), "groups_sha256": docs["groups_sha256"]}
    return pa.table(columns)


def postings(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (ordinal set: token, group and link counts) and of postings (pair set: planes), block by block; written once."""
    texts = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(texts.mapInArrow(_blocks(left_path, right_path), _STORED))


def pair_counts(stored: DataFrame) -> DataFrame:
    """left_id, right_id, pair, n_docs, n_links and best (its left id has no pair of more documents) per linked id pair."""
    counted = stored.filter("pair IS NOT NULL").select("pair", "planes").mapInArrow(_popcounts, "pair long, n_docs long, n_links long")
    pairs = cut_lineage(counted.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")).withColumn("left_id", F.shiftright("pair", RIGHT_BITS)))
    most = pairs.groupBy(F.col("left_id").alias("_l")).agg(F.max("n_docs").alias("_most"))
    out = pairs.join(most, F.col("left_id") == F.col("_l"))
    return out.select("left_id", F.col("pair").bitwiseAND((1 << RIGHT_BITS) - 1).alias("right_id"), "pair", "n_docs", "n_links", (F.col("n_docs") == F.col("_most")).alias("best"))


def align(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token, group and link counts of every row of ``docs``, and its links weighed by their pairs' document counts.

    Null and empty texts, and those one of the tokenizers does not spell back, have no tokens: zeros and an empty digest. Texts of any
    length are encoded whole; repeated rows are documents like others (each counts); an empty table gives none; other columns are not read.
    """
    stored = postings(docs, left_path, right_path, id_col, text_col)
    scores = cut_lineage(pair_counts(stored).select(F.col("pair").alias("_pair"), F.col("n_docs").alias("count"), "best"))
    # one plan at every size: pairs grow with the corpus, so neither side is taken to be small
    posts = stored.filter("pair IS NOT NULL").join(scores.hint("merge"), F.col("pair") == F.col("_pair")).select("block", "planes", "count", "best")
    rows = stored.filter("pair IS NULL").drop("pair", "planes").unionByName(posts, allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(_return_scores, _RESULT)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of a byte-level BPE and a piece model."""
    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
