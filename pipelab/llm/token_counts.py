"""Token counts by a linear longest-match automaton.

The pieces of a vocabulary form a trie. Greedy longest match takes the longest piece from
the left, again and again. Where the trie has no child for the next character, the failure
link of a node leads to the node reached after the pieces that greedy match would have taken
are popped off the front, and the node holds how many these are. So each character is read
once, no piece is built and nothing is read again.

A word is marked by the vocabulary's word mark in front; words are runs of characters other
than ASCII white space. A character that is no piece of its own counts as its UTF-8 bytes,
as with byte fallback. Null and empty texts have no words and 0 tokens.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_WORDS_KEPT = 500_000
_CHUNK = 512


class PieceAutomaton:
    """Trie with failure links and precomputed numbers of popped tokens."""

    def __init__(self, pieces: Iterable[str]):
        children: list[dict[str, int]] = [{}]
        ends: set[int] = set()
        for piece in pieces:
            node = 0
            for c in piece:
                below = children[node].get(c)
                if below is None:
                    below = children[node][c] = len(children)
                    children.append({})
                node = below
            ends.add(node)
        link, pops = [0] * len(children), [0] * len(children)
        queue: deque[int] = deque()
        for c, node in children[0].items():
            # A first character alone is a piece, or its bytes.
            pops[node] = 1 if node in ends else len(c.encode())
            queue.append(node)
        while queue:
            parent = queue.popleft()
            for c, node in children[parent].items():
                queue.append(node)
                if node in ends:
                    pops[node] = 1
                    continue
                at, popped = link[parent], pops[parent]
                while c not in children[at] and at:
                    popped += pops[at]
                    at = link[at]
                below = children[at].get(c)
                link[node] = below or 0
                pops[node] = popped + (0 if below is not None else len(c.encode()))
        self._children, self._link, self._pops = children, link, pops

    def count(self, word: str) -> int:
        """Number of tokens of one word, its mark included in ``word``."""
        children, link, pops = self._children, self._link, self._pops
        node = total = 0
        for c in word:
            below = children[node].get(c)
            while below is None:
                if not node:
                    total += len(c.encode())
                    break
                total += pops[node]
                node = link[node]
                below = children[node].get(c)
            else:
                node = below
        while node:
            total += pops[node]
            node = link[node]
        return total


def pieces_of_model(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model file (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(k)
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))
    ]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = PieceAutomaton(pieces_of_model(path))
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                chunk = batch.slice(at, _CHUNK)
                split = [t.encode().split() for t in chunk.column("text").to_pylist()]
                if len(known) > _WORDS_KEPT:
                    known = {}
                for w in {w for words in split for w in words if w not in known}:
                    known[w] = automaton.count(MARK + w.decode())
                get = known.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("id"), pa.array([len(s) for s in split], pa.int64()), pa.array([sum(map(get, s)) for s in split], pa.int64())],
                    ["doc_id", "n_words", "n_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and tokens of every whole text: doc_id, n_words, n_tokens. No shuffle; one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_counter(model_path), "doc_id long, n_words long, n_tokens long")
