"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end. The CODED most frequent words, one symbol for all rarer ones and the end are spelled by a Huffman
code of the training tokens, and every bit is predicted in three hashed contexts: none, the last token, the last two. A context
predicts the log odds of the counts that the training texts left in its slot; from the second on it is taken as a change to the one
before, shrunk where the slot is thin. A mixer adds them with weights chosen by the depth in the code (the gate), and a second stage rescales the
sum by how sure it is. Both learn online, block by block, inside the text that is scored, so a score never depends on
other texts of its task. Texts are scored side by side, each with its own weights: a step takes one block of every text of a group. A rarer word adds its share of the counts of all rarer words, unseen ones being one more word. The total of -log2 p over
the bytes of the text is its bits per byte.

Training gathers the count of every distinct word, combined before the shuffle, and the counts of the hashed contexts, summed from dense
tables of each task. The slots (2**TABLE_BITS per context) and the list of FREQUENT words whose counts every task knows are fixed, so what is broadcast is
bounded; the counts of all other words are joined.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypnolake.session import cut_lineage

from .common import id_text, query, table

CODED = 1 << 17
FREQUENT = 1 << 17
TABLE_BITS = 21
CONTEXTS = 3
PRIOR = 0.4  # added to both counts of a slot
THIN = (0.0, 30.0, 30.0)  # counts at which a context weighs one half
CLIP = 9.0
GATES = 8
CONFIDENCE = 10
BLOCK = 1024  # bits between two updates
RATE, RATE_SCALE = 0.3, 0.02
SEGMENT = 32_768  # tokens of one text expanded to bits at once
GROUP = 65_536  # tokens of texts that are scored together
SPELLED = 8192  # tokens spelled at once
ABREAST = 16  # texts scored side by side
CHUNK_BYTES = 4_000_000  # of texts that are split at once
COUNTED = 400_000  # distinct words held while counting
END = b""  # the end as a token
_ROW = 1 << 12


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Successive rows (id, text) of about ``CHUNK_BYTES`` together."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``tokens`` of all texts in a row, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, n = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends leaves empty words
    if not full.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
        words = words.filter(pa.array(full))
    return words, n


def held_out(doc_id) -> bool:
    """Whether a document is kept out of training; a null id counts as the empty string."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, length) per symbol into (node, bit): the inner nodes on the way to it and the turns taken. Every symbol has a code."""
    k = len(counts)
    heap = [(n + 1, s) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, turn = [-1] * (2 * k - 1), [0] * (2 * k - 1)
    for made in range(k, 2 * k - 1):  # the last one made is the root
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = made
        turn[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], made))
    length, nodes, bits = [], [], []
    for s in range(k):
        path, at = [], s
        while parent[at] >= 0:
            path.append((2 * k - 2 - parent[at], turn[at]))
            at = parent[at]
        length.append(len(path))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    length = np.array(length)
    return np.cumsum(length) - length, length, np.array(nodes, np.int64), np.array(bits, np.int64)


class Speller:
    """Tokens to bits with their context slots. Symbols: the frequent words, RARE, the end; START stands before a text."""

    def __init__(self, frequent: list[tuple[bytes, int]], n_rare: int, n_end: int, table_bits: int):
        self.rare, self.end, self.start = len(frequent), len(frequent) + 1, len(frequent) + 2
        first, length, node, bit = huffman([c for _, c in frequent] + [n_rare, n_end])
        self.first, self.length, self.node, self.bit = first.astype(np.int32), length.astype(np.int32), node.astype(np.int32), bit.astype(np.int8)
        self.shift = np.uint64(64 - table_bits)
        self.slots = 1 << table_bits
        self.size = self.rare + 1 + (CONTEXTS - 1) * self.slots  # the first context has a slot per inner node

    def symbols(self, places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts in a row the symbols, each text's end after its ``n`` words, and the last but one and the last symbol before each.

        ``places`` are those of the words among the frequent ones, negative or beyond for all others.
        """
        ends = np.cumsum(n + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.end, np.int32)
        word = np.ones(len(out), bool)
        word[ends - 1] = False
        out[word] = np.where((places >= 0) & (places < self.rare), places, self.rare)
        last, last2 = np.roll(out, 1), np.roll(out, 2)
        starts = ends - n - 1
        last[starts] = last2[starts] = self.start
        last2[starts[n > 0] + 1] = self.start
        return out, last2, last

    def spell(self, symbol: np.ndarray, before: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots [CONTEXTS, bits], bit, gate) of ``symbol``; ``before`` has the last but one and the last symbol before each."""
        last2, last = (np.broadcast_to(np.asarray(b).astype(np.uint64) + np.uint64(1), symbol.shape) for b in before)
        n = self.length[symbol]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.arange(int(ends[-1]), dtype=np.int32)
        step = at + np.repeat(self.first[symbol] - (ends - n), n)
        node = self.node.take(step, mode="clip")
        slots = np.empty((CONTEXTS, len(step)), np.int32)
        slots[0] = node
        at_node = node.astype(np.uint64)
        at_node *= np.uint64(0x9E3779B97F4A7C15)
        for k, context in enumerate((last, last * np.uint64(0xC2B2AE3D27D4EB4F) + last2), 1):
            mixed = np.repeat(context * np.uint64(0x165667B19E3779F9), n)
            mixed ^= at_node
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0x9FB21C651E98DF25)
            mixed >>= self.shift
            mixed += np.uint64(self.rare + 1 + (k - 1) * self.slots)
            slots[k] = mixed
        at -= np.repeat(ends - n, n)
        return slots, self.bit.take(step, mode="clip"), np.minimum(at, GATES - 1, out=at)


def log_odds(n0: np.ndarray, n1: np.ndarray, thin: float) -> np.ndarray:
    """odds * trust + i trust per slot, trust being n / (n + thin): one complex number, so that one look-up gets both."""
    n = n0 + n1
    trust = n / (n + thin) if thin else np.ones_like(n)
    return (np.log((n1 + PRIOR) / (n0 + PRIOR)).clip(-CLIP, CLIP) * trust + 1j * trust).astype(np.complex64)


def inputs(odds: np.ndarray, slots: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Mixer inputs [CONTEXTS, bits], signed towards the true bit: the first context's odds, then each next one's change to it."""
    sign = (2 * bit - 1).astype(np.float32)
    x = np.empty(slots.shape, np.float32)
    np.multiply(odds.take(slots[0], mode="clip").real, sign, out=x[0])
    below = x[0].copy()
    for k in range(1, CONTEXTS):
        found = odds.take(slots[k], mode="clip")
        np.multiply(found.real, sign, out=x[k])
        x[k] -= found.imag * below
        below += x[k]
    return x


def mix(x: np.ndarray, gate: np.ndarray, weights: np.ndarray, scale: np.ndarray) -> float:
    """-ln p of a text's bits with inputs ``x``; ``weights`` [CONTEXTS, GATES] and ``scale`` learn on the way."""
    return float(mix_texts(x, gate, np.array([x.shape[1]]), weights[None], scale[None])[0])


def mix_texts(x: np.ndarray, gate: np.ndarray, sizes: np.ndarray, weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """-ln p of each of some texts, whose bits follow each other; text by text ``weights`` and ``scale`` learn on the way."""
    loss = np.zeros(len(sizes))
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), ABREAST):  # of about one size
        some = order[i : i + ABREAST]
        for at in range(0, int(sizes[some[0]]), BLOCK):
            live = some[sizes[some] > at]
            loss[live] += _step(x, gate, begin[live] + at, np.minimum(sizes[live] - at, BLOCK), live, weights, scale)
    return loss


def _step(x: np.ndarray, gate: np.ndarray, begin: np.ndarray, n: np.ndarray, live: np.ndarray, weights: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """-ln p of a block of each of the texts ``live``, after which their weights and scales are updated."""
    spans = [slice(b, b + k) for b, k in zip(begin.tolist(), n.tolist())]
    xb, g = np.concatenate([x[:, s] for s in spans], axis=1), np.concatenate([gate[s] for s in spans])
    text = np.repeat(np.arange(len(live)), n)
    g = text * GATES + g
    w = weights[live].astype(np.float32)
    z = xb[0] * w[:, 0].ravel().take(g, mode="clip")
    for k in range(1, CONTEXTS):
        z += xb[k] * w[:, k].ravel().take(g, mode="clip")
    sure = np.minimum(np.abs(z), CONFIDENCE - 1).astype(np.int64)
    text *= CONFIDENCE
    sure += text
    e = scale[live].astype(np.float32).ravel().take(sure, mode="clip")
    e *= z
    np.clip(e, -30, 30, out=e)
    np.negative(e, out=e)
    np.exp(e, out=e)
    loss = np.add.reduceat(np.log1p(e), np.cumsum(n) - n, dtype=np.float64)
    miss = e / (1 + e)
    cells = len(live) * GATES
    rate = RATE / (np.bincount(g, minlength=cells) + 32.0)
    for k in range(CONTEXTS):
        weights[live, k] += (rate * np.bincount(g, weights=miss * xb[k], minlength=cells)).reshape(-1, GATES)
    cells = len(live) * CONFIDENCE
    rate = RATE_SCALE / (np.bincount(sure, minlength=cells) + 32.0)
    scale[live] += (rate * np.bincount(sure, weights=miss * z, minlength=cells)).reshape(-1, CONFIDENCE)
    return loss


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the training rows of ``docs`` (doc_id, text); the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not held_out(doc):
                    found.update(tokens(text.as_py()))
                    found[END] += 1
                    if len(found) > COUNTED:
                        yield rows()
                        found.clear()
        if found:
            yield rows()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _tables(docs: DataFrame, model) -> np.ndarray:
    """``log_odds`` of all slots. A task counts its training rows in dense tables and passes them on in rows of 2**12 slots, summed by row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, words = model.value
        places = pa.array(words, pa.binary())
        rows = -(-speller.size // _ROW)
        n = np.zeros(2 * rows * _ROW, np.int64)  # slot by slot both bits
        ones = np.zeros(speller.end + 1, np.int64)  # the first context has no more than the counts of the symbols
        for batch in batches:
            keep = [not held_out(doc) for doc in batch.column(0).to_pylist()]
            for some in chunks(batch.filter(pa.array(keep, pa.bool_()))):
                found, size = split(some.column(1))
                symbol, last2, last = speller.symbols(_places(found, places), size)
                ones += np.bincount(symbol, minlength=len(ones))
                for s in range(0, len(symbol), SPELLED):
                    part = slice(s, s + SPELLED)
                    slots, bit, _ = speller.spell(symbol[part], (last2[part], last[part]))
                    for k in range(1, CONTEXTS):
                        cell = 2 * slots[k].astype(np.int64)
                        cell += bit
                        np.add.at(n, cell, 1)
        used = np.flatnonzero(ones)
        for s in range(0, len(used), SPELLED):
            part = used[s : s + SPELLED]
            slots, bit, _ = speller.spell(part, (0, 0))
            np.add.at(n, 2 * slots[0].astype(np.int64) + bit, np.repeat(ones[part], speller.length[part]))
        cells = n.reshape(rows, _ROW, 2).transpose(2, 0, 1).astype(np.int32)
        for s in range(0, cells.shape[1], 64):
            at = np.flatnonzero(cells[:, s : s + 64].any(axis=(0, 2))) + s
            if len(at):
                packed = [[zlib.compress(cells[b, r].tobytes(), 1) for r in at] for b in (0, 1)]
                yield pa.RecordBatch.from_pydict({"row": at, "n0": packed[0], "n1": packed[1]})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n = None, np.zeros((2, _ROW))

        def done():
            return pa.RecordBatch.from_pydict({"row": [current], "n0": [n[0].astype(np.float32).tobytes()], "n1": [n[1].astype(np.float32).tobytes()]})

        for batch in batches:
            for r, n0, n1 in zip(*(c.to_pylist() for c in batch.columns)):
                if r != current:
                    if current is not None:
                        yield done()
                    current, n = r, np.zeros((2, _ROW))
                n += np.stack([np.frombuffer(zlib.decompress(b), np.int32) for b in (n0, n1)])
        if current is not None:
            yield done()

    speller, _ = model.value
    parts = docs.mapInArrow(add, "row long, n0 binary, n1 binary")
    summed = parts.repartition("row").sortWithinPartitions("row").mapInArrow(total, "row long, n0 binary, n1 binary")
    n = np.zeros((2, -(-speller.size // _ROW) * _ROW), np.float32)
    for r in summed.toLocalIterator():  # a fixed number of rows, whatever the input
        n[0, r.row * _ROW : (r.row + 1) * _ROW] = np.frombuffer(r.n0, np.float32)
        n[1, r.row * _ROW : (r.row + 1) * _ROW] = np.frombuffer(r.n1, np.float32)
    edges = [0, *(speller.rare + 1 + k * speller.slots for k in range(CONTEXTS))]
    return np.concatenate([log_odds(n[0, a:b], n[1, a:b], thin) for a, b, thin in zip(edges, edges[1:], THIN)])


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word ``among`` others, -1 where it is none of them."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False)


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of successive texts of about ``GROUP`` tokens together; a longer one than SEGMENT stays alone."""
    at = held = before = 0
    for i, n in enumerate(sizes.tolist()):
        if held and (held + n > GROUP or max(before, n) > SEGMENT):
            yield at, i
            at, held = i, 0
        held += n
        before = n
    if held:
        yield at, len(sizes)


def _nats(speller: Speller, odds: np.ndarray, symbol: np.ndarray, before: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """-ln p of each of some texts, whose ``sizes`` symbols follow each other. Longer texts than SEGMENT go piece by piece."""
    loss = np.zeros(len(sizes))
    starts = np.cumsum(sizes) - sizes
    for a, b in _groups(sizes):
        weights, scale = np.ones((b - a, CONTEXTS, GATES)), np.ones((b - a, CONFIDENCE))
        end = int(starts[a] + sizes[a:b].sum())
        for s in range(int(starts[a]), end, SEGMENT if b - a == 1 else GROUP):
            stop = min(s + SEGMENT, end) if b - a == 1 else end
            gates, found = [], []
            for at in range(s, stop, SPELLED):
                part = slice(at, min(at + SPELLED, stop))
                slots, bit, gate = speller.spell(symbol[part], (before[0][part], before[1][part]))
                gates.append(gate)
                found.append(inputs(odds, slots, bit))
            bits = np.add.reduceat(speller.length[symbol[s:stop]], np.maximum(starts[a:b] - s, 0), dtype=np.int64)
            loss[a:b] += mix_texts(np.concatenate(found, axis=1), np.concatenate(gates), bits, weights, scale)
    return loss


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, logs double, nats double, in_rare long, rare_logs double, rare array<long>, rare_n array<long>"
)


def _score_texts(docs: DataFrame, model, learned) -> DataFrame:
    """Per row -ln p of its symbols, and sums over the words whose counts are known; others as (hash, n) for the join. ``model`` and ``learned`` are broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, words = model.value
        odds, logs_of, end_log = learned.value  # the logs of the frequent words by place
        places = pa.array(words, pa.binary())
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "held_out", "n_tokens", "n_bytes", "known", "logs", "nats", "in_rare", "rare_logs", "rare", "rare_n"]

        for batch in batches:
            for some in chunks(batch):
                docs_, (found, n) = some.column(0).to_pylist(), split(some.column(1))
                at = _places(found, places)
                symbol, last2, last = speller.symbols(at, n)
                nats = _nats(speller, odds, symbol, (last2, last), n + 1)
                text = np.repeat(np.arange(len(n)), n)
                log, seen, rare = np.where(at >= 0, logs_of.take(at, mode="clip"), 0.0) if len(logs_of) else np.zeros(len(at)), at >= 0, at >= speller.rare
                of = lambda w=None: np.bincount(text, w, len(n))  # noqa: B023, E731
                size = of(pc.binary_length(found).to_numpy(zero_copy_only=False)).astype(np.int64) + n + 1
                known, in_rare = of(seen).astype(np.int64) + (not end_log < 0), of(rare).astype(np.int64)
                others: list[Counter] = [Counter() for _ in docs_]
                other = np.flatnonzero(~seen)
                for i, w in zip(text[other].tolist(), found.take(pa.array(other)).to_pylist()):
                    others[i][w] += 1
                hashes = [[h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(w, 42) for w in o)] for o in others]
                out = (
                    docs_, [held_out(d) for d in docs_], n + 1, size, known, end_log + of(log), nats, in_rare, of(log * rare), hashes, [[*o.values()] for o in others],
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return docs.mapInArrow(run, SCORED)


def _most_frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The words of the highest counts, most frequent first: all steps of 2**(1/16) in the count, from the top, that together hold at most ``limit``.

    A histogram of at most a thousand steps finds the lowest count, so no task sends more than its share of the list.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    held, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        held += r["count"]
        if held > limit:
            break
        lowest = r.step
    if lowest is None:
        return []
    return sorted(((bytes(r.word), r.c) for r in counts.filter(step >= lowest).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def score(docs: DataFrame, table_bits: int = TABLE_BITS, most_frequent: int = FREQUENT, coded: int = CODED) -> DataFrame:
    """Tokens, base score, model score (log10) and bits per byte of every row of ``docs`` (doc_id, text).

    Null or empty text is one end; a null doc_id counts as the empty string when folds are dealt, and stays; equal rows are counted and scored each for itself; texts
    of any length are read whole, in bounded pieces; without training rows all counts are zero; an empty table gives none; other columns are not read.
    Words are joined by their 64-bit hash.
    """
    spark = docs.sparkSession
    texts = id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = cut_lineage(count_words(texts))
    is_end = F.col("word") == F.lit(END)
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0))).first()
    top = _most_frequent(counts.filter(~is_end), most_frequent)
    spelled = top[:coded]
    n_rare = total - ends - sum(c for _, c in spelled)
    v_rare = distinct - (ends > 0) - len(spelled)
    words = [w for w, _ in top]  # the first of them are spelled
    model = spark.sparkContext.broadcast((Speller(spelled, n_rare, ends, table_bits), words))
    odds = _tables(texts, model)
    learned = spark.sparkContext.broadcast((odds, np.log10(np.array([c for _, c in top], np.float64) + 0.5), math.log10(ends + 0.5)))
    rows = cut_lineage(_score_texts(texts, model, learned).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("n"))
    known = rare.join(counts.select(F.xxhash64("word").alias("h"), "c"), "h", "left")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    more = known.groupBy("row").agg(
        F.sum(n * F.log10(c + 0.5)).alias("more_logs"), F.sum(n).alias("more"), F.sum(F.when(c > 0, n).otherwise(0)).alias("more_known")
    )
    more_logs = F.coalesce("more_logs", F.lit(0.0))
    in_rare = math.log10(n_rare + 0.5 * (v_rare + 1))
    whole = math.log10(total + 0.5 * (distinct + 1))
    rare_logs = F.col("rare_logs") + more_logs - (F.col("in_rare") + F.coalesce("more", F.lit(0))) * in_rare
    model_log = rare_logs - F.col("nats") / math.log(10)
    return rows.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * whole).alias("base_score"),
        model_log.alias("score"), (-model_log / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


@query("op8_lm_mixing")
def op8_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the mixed contexts of the training documents."""
    return score(table(spark, sf_dir, "documents"))
