"""Byte-pair encoding and decoding with a tokenization automaton.

The automaton reads tokens: from the state of token t an arc u says that u may follow t. It starts as one state with a loop
per base symbol. Merge k, (a, b) -> c, inserts a gadget: a's state is split off and loses its arc b; every state with an
arc a gains an arc c, which ends in a copy of the state that b led to. After all merges the paths that spell a word are exactly
one: its encoding. As a state differs from the one it was copied from by few arcs, the tables keep the splits (parts
and birth time of each token, time at which an arc was lost) and ``arc`` reads an arc off them.

Words are encoded by table-driven transitions: a goto table over symbols proposes the longest token, the arc table accepts or
rejects it, and rejected positions are never entered twice. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, id_text, query, table
from .packing import tokenizer_path

MEMO_WORDS = 250_000
MEMO_ARCS = 1_000_000
FLUSH_BYTES = 16_000_000
ENCODED = "doc_id long, ids binary, decoded string"
ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.large_string())])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class Automaton:
    """Tables compiled from a vocabulary and its merges in order of priority."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        size = max(vocab.values()) + 1
        self.size, self.suffix = size, suffix
        self.label = [""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.lost: dict[int, int] = {}
        symbols: list[tuple[int, ...]] = [(i,) for i in range(size)]
        pairs = [pair if isinstance(pair, (list, tuple)) else pair.split(" ") for pair in merges]
        merged = {vocab[a + b] for a, b in pairs}
        for k, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            known = all(t not in merged or self.born[t] >= 0 for t in (x, y))
            if known and self.born[z] < 0 and self.arc(x, y):  # else no text ever brings the two together, and no state has the arc
                self._gadget(k, x, y, z)
                symbols[z] = symbols[x] + symbols[y]
        self.length = [len(s) for s in symbols]
        self._gotos([s if t not in merged or self.born[t] >= 0 else () for t, s in enumerate(symbols)])
        self.arcs = Memo(lambda key: self.arc(*divmod(key, size)), MEMO_ARCS)

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        """Merge k: a's state loses arc b, and arc c appears wherever arc a was."""
        self.lost[a * self.size + b] = k
        self.left[c], self.right[c], self.born[c] = a, b, k

    def arc(self, t: int, u: int, time: int = 1 << 60) -> bool:
        """Whether the state of t has an arc u just before merge ``time``."""
        while True:
            if self.lost.get(t * self.size + u, time) < time:
                return False
            born_t, born_u = self.born[t], self.born[u]
            if born_t < 0 and born_u < 0:
                return True
            if born_t > born_u:  # its state was copied from that of its right part
                t, time = self.right[t], born_t
            else:  # arc u was added beside arc left(u), after left(u)'s own state had lost its arc
                u, time = self.left[u], born_u + 1

    def _gotos(self, symbols: list[tuple[int, ...]]) -> None:
        self.goto: dict[int, int] = {}
        token_at = [-1]
        for t, spelled in enumerate(symbols):
            node = 0
            for s in spelled:
                key = node * self.size + s
                nxt = self.goto.get(key)
                if nxt is None:
                    nxt = self.goto[key] = len(token_at)
                    token_at.append(-1)
                node = nxt
            if spelled:
                token_at[node] = t
        self.token_at = token_at
        self.shorter = [-1] * len(symbols)
        for t, spelled in enumerate(symbols):
            node, best = 0, -1
            for s in spelled[:-1]:
                node = self.goto[node * self.size + s]
                best = token_at[node] if token_at[node] >= 0 else best
            self.shorter[t] = best

    def _longest(self, spelled: list[int], i: int) -> int:
        goto, token_at, size, node, best = self.goto, self.token_at, self.size, 0, -1
        for s in spelled[i:]:
            node = goto.get(node * size + s)
            if node is None:
                break
            if token_at[node] >= 0:
                best = token_at[node]
        return best

    def encode(self, spelled: list[int]) -> list[int]:
        """The one accepted path over the base symbols ``spelled``."""
        out: list[int] = []
        dead: set[int] = set()
        i, n, t = 0, len(spelled), self._longest(spelled, 0)
        while i < n:
            while t >= 0:
                if i + self.length[t] not in dead and (not out or self.arcs[out[-1] * self.size + t]):
                    break
                t = self.shorter[t]
            if t >= 0:
                out.append(t)
                i += self.length[t]
                t = self._longest(spelled, i)
            else:
                if not out:
                    raise ValueError("no path spells this word")
                dead.add(i)
                t = out.pop()
                i -= self.length[t]
                t = self.shorter[t]
        return out


class Codec:
    """Text to ids and back, as the tokenizer file describes: special tokens, normal form, pre-split, automaton."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tok = Tokenizer.from_file(path)  # only for normal form and pre-split of words beyond ASCII
        self.normal, self.pre = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ascii_rule = re.compile(rule.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r"))
        shown = byte_symbols()
        vocab, end = model["vocab"], self.automaton.suffix
        self.inner = {c: vocab[c] for c in shown}
        self.last = {c: vocab[c + end] for c in shown}
        self.byte_of = dict(enumerate(shown[:128]))
        self.labels = [s.encode() for s in self.automaton.label]
        self.labels += [b""] * (max([*self.special.values(), 0]) + 1 - len(self.labels))
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        self.memo = Memo(self._word, MEMO_WORDS)

    def _presplit(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [w.translate(self.byte_of) for w in self.ascii_rule.findall(chunk.lower())]
        return [w for w, _ in self.pre(self.normal(chunk))]

    def _word(self, raw: bytes) -> tuple[bytes, bytes]:
        """Ids and label string of a run without white space."""
        ids: list[int] = []
        for k, part in enumerate(self.parts.split(raw.decode())):
            if k % 2:
                ids.append(self.special[part])
                continue
            for w in self._presplit(part):
                ids += self.automaton.encode([*map(self.inner.__getitem__, w[:-1]), self.last[w[-1]]])
        return b"".join(i.to_bytes(4, "little") for i in ids), self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        """Labels of the arcs, parted as the file's (absent) decoder parts them: by a space."""
        return b" ".join([self.labels[i] for i in ids])

    def both(self, text: str) -> tuple[bytes, bytes]:
        raw = text.encode()
        if b"<|" not in raw:
            raw = raw.lower()
        found = [self.memo[w] for w in raw.split()]
        return b"".join([x for x, _ in found]), b" ".join([y for x, y in found if x])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (little-endian uint32) and the text decoded from them, for each row of ``docs`` (doc_id, text).

    Map only. Null or empty text has no ids and decodes to the empty string; equal rows give equal rows; an empty table gives none;
    other columns are not read. Words are kept in a memo of bounded size, so memory does not grow with the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            docs_, ids, decoded, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x, y = c.both(text.as_py())
                docs_.append(doc)
                ids.append(x)
                decoded.append(y)
                held += len(x) + len(y)
                if held >= FLUSH_BYTES:
                    yield _rows(docs_, ids, decoded)
                    docs_, ids, decoded, held = [], [], [], 0
            if docs_:
                yield _rows(docs_, ids, decoded)

    return id_text(docs).mapInArrow(run, ENCODED)


def _rows(docs: list, ids: list, decoded: list) -> pa.RecordBatch:
    text = pa.array(decoded, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary()), text], names=["doc_id", "ids", "decoded"])


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    done = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
