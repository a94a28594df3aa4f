"""Token counts: greedy longest-match word pieces in one pass, by a trie with failure links.

Each trie node carries the number of pieces that are popped when its failure link is taken,
so counting a word's pieces needs one step a character and builds no piece. Nodes of whole
pieces fail to the continuation root and pop one piece; other nodes inherit from their parent.
A word with a character that no piece can cover is one unknown piece.

Edge cases: null and empty texts have zero words; repeated rows are counted each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

CACHE_WORDS = 1_000_000
_automata: dict[str, PieceAutomaton] = {}


class PieceAutomaton(dict):
    """Counts pieces; as a dict it keeps word (bytes) -> count, 0 for an unknown word."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.children: list[dict[str, int]] = [{}, {}]
        whole = {0: False, 1: False}
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = nxt
                if piece:
                    whole[node] = True
        n = len(self.children)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque((child, c, root) for root in (0, 1) for c, child in self.children[root].items())
        while queue:
            node, c, parent = queue.popleft()
            if whole.get(node):
                self.fail[node], self.pops[node] = 1, 1
            else:
                z, popped = self.fail[parent], self.pops[parent]
                while z >= 0 and c not in self.children[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.pops[node] = self.children[z][c], popped
            queue.extend((child, x, node) for x, child in self.children[node].items())

    def count(self, word: str) -> int:
        children, fail, pops = self.children, self.fail, self.pops
        node = total = 0
        for c in word:
            nxt = children[node].get(c)
            while nxt is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
                nxt = children[node].get(c)
            node = nxt
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return total

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        n = self[word] = self.count(word.decode("utf-8", "replace"))
        return n


def sentencepiece_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word (marked by U+2581 in the model) and pieces that go on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p[0] == "▁"], [p for p in plain if "▁" not in p]


def automaton(path: str) -> PieceAutomaton:
    if path not in _automata:
        _automata[path] = PieceAutomaton(*sentencepiece_pieces(path))
    return _automata[path]


def count_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_tokens (an unknown word is one) and n_unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton(vocabulary)
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for text in batch.column(1):
                found = list(map(table.__getitem__, (text.as_py() or b"").split()))
                unknown = found.count(0)
                for x, v in zip(out, (len(found), sum(found) + unknown, unknown), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
