"""Token counts of a unigram vocabulary, computed along a trie of pre-tokens.

Texts are cut at white space; each word gets the word mark in front. The distinct pre-tokens of a batch are
walked in sorted order, which is the depth-first order of their trie: the stack holds the forward scores of
the current path, so the scores of a shared prefix are computed once, and each terminal stores its token
count. Memory is the current path, the words of one batch and a bounded memo of counts; no table of all
words exists anywhere, and documents are not shuffled.

The best path has the highest sum of piece scores; of equal sums the one whose last piece is longest.
A character without a piece of its own is written as its UTF-8 bytes, one token each, at a score of ten
below the lowest.

Defined cases: null, empty and blank texts have no tokens; repeated rows give equal counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from passagework.llm.common import MEMO, MEMO_CHARS, fields, map_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a model file, without control and byte pieces."""
    model = SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in ids}


class Counter:
    """Counts the tokens of words; ``pieces`` maps a piece to its score."""

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        #: Pieces from their last character backwards; the key "" holds a piece's score.
        self.ending: dict = {}
        for piece, score in pieces.items():
            node = self.ending
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.counts: dict[str, int] = {}
        self.chars = 0

    def learn(self, new: Iterable[str]) -> None:
        """Store the counts of words, which must be sorted."""
        path, scores, tokens = "", [0.0], [0]
        ending, counts = self.ending, self.counts
        for word in new:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :]
            for d in range(shared, len(word)):
                node, start = ending.get(word[d]), d
                if node is None or "" not in node:
                    best, n = scores[d] + self.unknown, tokens[d] + len(word[d].encode("utf-8", "surrogatepass"))
                else:
                    best, n = scores[d] + node[""], tokens[d] + 1
                while node is not None and start:
                    start -= 1
                    node = node.get(word[start])
                    if node is not None and "" in node and (s := scores[start] + node[""]) >= best:
                        best, n = s, tokens[start] + 1
                scores.append(best)
                tokens.append(n)
            path = word
            counts[word] = tokens[-1]

    def batch(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        cut = [[MARK + w for w in t.split()] if t else [] for t in texts]
        if len(self.counts) > MEMO or self.chars > MEMO_CHARS:
            self.counts, self.chars = {}, 0
        fresh = sorted({w for c in cut for w in c} - self.counts.keys())
        self.chars += sum(map(len, fresh))
        self.learn(fresh)
        return [len(c) for c in cut], [sum(map(self.counts.__getitem__, c)) for c in cut]


def count_tokens(df: DataFrame, model: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``n_words`` and ``n_tokens``."""
    pieces = df.sparkSession.sparkContext.broadcast(load_pieces(model))
    schema = T.StructType([*fields(df, *keep), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    made: list[Counter] = []

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        if not made:
            made.append(Counter(pieces.value))
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n_words, n_tokens = made[0].batch(part.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.fieldNames()
            )

    return map_batches(df.select(*keep, df[text].alias("__text")), run, schema)
