"""Byte-pair encoding and decoding by an index of pair occurrences.

A task collects the distinct words of a batch of texts that it hasn't encoded yet, lays their
symbols out in one array, and maps each mergeable pair to all its positions.  The lowest active
rank is merged everywhere at once; the pairs that a merge makes join the lists of their ranks.
Words don't touch, so the order by rank within each word is the order the algorithm asks for.

Tokenizer files are those of the ``tokenizers`` library with a BPE model over byte-level symbols
and a suffix for the end of a word.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import require, text_of

#: Words whose encoding a task remembers (some 260 bytes each); beyond, it starts afresh.
CACHE_WORDS = 100_000
#: Code points of text whose words are merged at once (some 80 bytes each where all words are new), and rows decoded at once; a longer text goes alone.
MERGE_CHARS, DECODE_ROWS = 1 << 20, 1000
_SHIFT = 20


def byte_symbols() -> list[str]:
    """The character for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Tokenizer:
    """What a tokenizer file says, ready for encoding and decoding."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]]
        known = model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        if not known or not model["end_of_word_suffix"] or spec["decoder"] is not None or steps[0]["behavior"] != "Removed":
            raise ValueError("a tokenizer file of another kind")
        self.word = regex.compile(steps[0]["pattern"]["Regex"])
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for name, k in [*self.vocab.items(), *self.special.items()]:
            self.names[k] = name
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols, suffix = byte_symbols(), model["end_of_word_suffix"]
        self.inner = np.array([self.vocab[s] for s in symbols], np.int32)
        self.last = np.array([self.vocab[s + suffix] for s in symbols], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = (self.left << _SHIFT) | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order

    @classmethod
    def load(cls, text: str) -> Tokenizer:
        return cls(json.loads(text))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where they don't merge."""
        key = (a.astype(np.int64) << _SHIFT) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def parts(self, text: str) -> Iterator[str | int]:
        """The words of a text in order, normalised; special tokens as their ids."""
        for k, piece in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield self.special[piece]
            elif piece:
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                yield from self.word.findall(piece)

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """The token ids of each word (not empty), by merging pairs over all the words at once."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(d) for d in data], np.int64)
        ends = np.cumsum(sizes) - 1
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbol = self.inner[raw]
        symbol[ends] = self.last[raw[ends]]
        total = len(symbol)
        after = np.arange(1, total + 1, dtype=np.int32)
        after[ends] = -1
        before = np.arange(-1, total - 1, dtype=np.int32)
        before[ends[:-1] + 1] = -1

        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, positions in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(positions)

        index(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            left, right = self.left[rank], self.right[rank]
            found = lists.pop(rank)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            at = at[(symbol[at] == left) & (after[at] >= 0)]
            at = at[symbol[after[at]] == right]
            if left == right:  # overlapping occurrences merge from the left
                free, taken = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != taken:
                        free.append(p)
                        taken = q
                at = np.array(free, np.int32)
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = self.made[rank], -1
            follow = after[gone]
            after[at], after[gone] = follow, -1
            before[follow[follow >= 0]] = at[follow >= 0]
            ahead = before[at]
            begins = np.concatenate((ahead[ahead >= 0], at[follow >= 0]))
            index(np.unique(begins))
        alive = symbol >= 0
        starts = np.concatenate(([0], np.cumsum(np.add.reduceat(alive, ends - sizes + 1))))
        ids = symbol[alive].astype("<u4")
        return [ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]

    def encoder(self):
        """A function from a list of texts to the packed ids of each; it remembers words."""
        place: dict[str | int, int] = {}
        packed: list[bytes] = []

        def encode(texts: list[str]) -> list[bytes]:
            if len(place) > CACHE_WORDS:
                place.clear()
                packed.clear()
            rows = [np.fromiter((place.setdefault(w, len(place)) for w in self.parts(t)), np.int32) for t in texts]
            new = list(place)[len(packed) :]
            words = iter(self.merge_words([w for w in new if isinstance(w, str)]) if any(isinstance(w, str) for w in new) else ())
            packed.extend(np.array([w], "<u4").tobytes() if isinstance(w, int) else next(words).tobytes() for w in new)
            return [b"".join([packed[k] for k in row.tolist()]) for row in rows]

        return encode

    def decode(self, packed: bytes) -> str:
        """The tokens' names, special ones too, joined by spaces."""
        names = self.names
        return " ".join([names[k] for k in np.frombuffer(packed, "<u4").tolist()])


def slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``MERGE_CHARS`` of text."""
    begin, size = 0, 0
    for k, n in enumerate(pc.utf8_length(texts).to_pylist()):
        if size and size + n > MERGE_CHARS:
            yield batch.slice(begin, k - begin)
            begin, size = k, 0
        size += n
    yield batch.slice(begin)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) per row: the ids of the whole text, packed as little-endian unsigned
    32-bit integers.  ``tokenizer`` is the path of a tokenizer file, read on the driver.

    Null and empty texts, and texts of white space, have no ids.  Repeated rows are encoded alike.
    An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))  # one file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = Tokenizer.load(spec.value).encoder()
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                ids = encode_texts(part.column(1).to_pylist())
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_of(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the decoded ``text``; null ids decode to the empty text."""
    require(encoded, "doc_id", "n_tokens", "ids")
    spec = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = Tokenizer.load(spec.value).decode
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                texts = [decode_ids(x.as_py() or b"") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, text string")


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, text): ``encode``, then ``decode`` of what it gave, in the same Python worker.

    Two chained operators would hold two workers, each with its own tokenizer, for every task.
    """
    require(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokenizer.load(spec.value)
        encode_texts = known.encoder()
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                ids = encode_texts(part.column(1).to_pylist())
                for at in range(0, len(ids), DECODE_ROWS):
                    own = ids[at : at + DECODE_ROWS]
                    columns = [
                        part.column(0).slice(at, DECODE_ROWS), pa.array([len(x) // 4 for x in own], pa.int64()),
                        pa.array(own, pa.binary()), pa.array([known.decode(x) for x in own], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "text"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_of(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, text string")
