"""Token counts by a linear longest-match automaton: a trie over the vocabulary with failure links and the precomputed number
of tokens that each link pops gives the length of the greedy word-piece segmentation without making the pieces.

A word is a maximal run of characters other than space and 09-0D; the mark of a word's start is put before it, and the longest
vocabulary entry is taken again and again from the left. A word that gets stuck counts as one unknown token. Every character
moves the automaton down the trie once and every link moves it up, so a word takes time linear in its length.

Defined cases: a null or empty text has no words and no tokens; repeated rows and ids are counted as they are; an empty table
gives an empty result; of entries that fit, the longest is taken, so there are no ties; columns of docs other than the two named
are ignored. A task needs some 100 bytes for each word of its longest text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, with_fields

START = "▁"


def sentence_pieces(path: str) -> list[str]:
    """The ordinary entries of a sentencepiece model: its pieces, with their mark of a word's start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


class LongestMatch:
    """goto: children by character; fail: the state that remains after popping (-1: stuck); pops: tokens popped on the way."""

    def __init__(self, vocabulary: list[str], start: str = START, memo: int = 500_000):
        self.start, self.memo, self.limit = start, {}, memo
        goto, token = [{}], [False]
        for piece in filter(None, vocabulary):
            s = 0
            for c in piece:
                if c not in goto[s]:
                    goto[s][c] = len(goto)
                    goto.append({})
                    token.append(False)
                s = goto[s][c]
            token[s] = True
        fail, pops = [-1] * len(goto), [0] * len(goto)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in goto[u].items():
                    below.append(v)
                    if token[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and c not in goto[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = goto[z][c], n
            level = below
        self.goto, self.fail, self.pops = goto, fail, pops

    def word(self, word: str) -> int:
        """The number of pieces of a word, 0 if it gets stuck."""
        goto, fail, pops = self.goto, self.fail, self.pops
        s = n = 0
        for c in self.start + word:
            while (t := goto[s].get(c)) is None:
                if fail[s] < 0:
                    return 0
                n += pops[s]
                s = fail[s]
            s = t
        while s:
            if fail[s] < 0:
                return 0
            n += pops[s]
            s = fail[s]
        return n

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        found = list(map(self.memo.get, words))
        if None in found:
            if len(self.memo) > self.limit:
                self.memo.clear()
            for k, w in enumerate(words):
                if found[k] is None:
                    found[k] = self.word(w.decode("utf-8", "surrogatepass"))
                    if len(w) <= 48:
                        self.memo[w] = found[k]
        unknown = found.count(0)
        return len(words), sum(found) + unknown, unknown


_automata: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown. path: a sentencepiece model, which every executor must have."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        if path not in _automata:
            _automata[path] = LongestMatch(sentence_pieces(path))
        counted = [_automata[path].count(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0)} | {str(k): [x[k] for x in counted] for k in range(3)}

    return by_batch(docs.select(id_col, text_col), run, with_fields(docs.select(F.col(id_col).alias("doc_id")), "n_words bigint, n_tokens bigint, n_unknown bigint"))
