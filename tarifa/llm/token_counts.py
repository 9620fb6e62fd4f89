"""Token counts by greedy longest match, in one pass over each word, without building the pieces.

A trie of the vocabulary gets a failure link per node: where to go on when the next character has
no edge.  Following it pops the pieces that greedy matching has settled by then, and their number
is stored with the link, so counting is adding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import require, text_of

#: Words whose count a task remembers; beyond, it starts afresh.
CACHE_WORDS = 500_000
#: Marks the beginning of a word in the vocabulary.
BEGIN = "▁"


class LongestMatch:
    """The automaton of a vocabulary.  A character that no piece begins with costs its UTF-8 bytes, one token each."""

    def __init__(self, pieces: Iterable[str]):
        pieces = [p for p in pieces if p]
        self.edges: list[dict[str, int]] = [{}]
        cost: list[int] = [0]  # of the node's string as one piece; 0 if it is none
        for char in sorted({c for p in pieces for c in p}):  # each character can stand alone, as bytes at worst
            self._node(char, cost, len(char.encode("utf-8", "surrogatepass")))
        for piece in pieces:
            self._node(piece, cost, 1)
        self.fail, self.popped = [0] * len(cost), [0] * len(cost)
        level = [(0, c, v) for c, v in self.edges[0].items()]
        while level:
            step = []
            for parent, char, node in level:
                if cost[node]:
                    self.fail[node], self.popped[node] = 0, cost[node]
                else:
                    z, n = self.fail[parent], self.popped[parent]
                    while char not in self.edges[z]:
                        z, n = self.fail[z], n + self.popped[z]
                    self.fail[node], self.popped[node] = self.edges[z][char], n
                step += [(node, c, v) for c, v in self.edges[node].items()]
            level = step

    def _node(self, piece: str, cost: list[int], tokens: int) -> None:
        at = 0
        for c in piece:
            if c not in self.edges[at]:
                self.edges[at][c] = len(self.edges)
                self.edges.append({})
                cost.append(0)
            at = self.edges[at][c]
        cost[at] = tokens

    def count(self, word: str) -> int:
        """The number of pieces greedy longest match cuts ``word`` into."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for c in word:
            while c not in edges[at]:
                if not at:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[at]
                at = fail[at]
            else:
                at = edges[at][c]
        while at:
            n += popped[at]
            at = fail[at]
        return n


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The text pieces of a SentencePiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not special(k)]


def token_counts(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) per row: the tokens of the whole text, each word with ``BEGIN`` before it.

    Null, empty and blank texts have none.  Repeated rows are counted alike.  An empty table gives
    no rows.  Words are counted once per task and looked up after that.
    """
    require(docs, id_col, text_col)
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = LongestMatch(pieces.value).count, {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                split = text.as_py().encode("utf-8", "surrogatepass").split()
                total = 0
                for w in split:
                    n = known.get(w)
                    if n is None:
                        n = known[w] = count(BEGIN + w.decode("utf-8", "surrogatepass"))
                    total += n
                words.append(len(split))
                tokens.append(total)
                if len(known) > CACHE_WORDS:
                    known.clear()
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_of(text_col)).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
