"""Byte-level BPE encoding and decoding.

A vocabulary file of the ``tokenizers`` format is read once by the driver and broadcast: it is a fixed
file, so its size does not grow with the data. A text is cut into words by the byte-level pattern; each
word's merges run over a doubly linked list of symbols with a heap of merge ranks, where entries whose
pair is gone are skipped. A task keeps the ids of words it has met in a bounded memo. Decoding joins the
vocabulary's strings.

Defined cases: null is the empty text, which has no tokens; added tokens met in a text become their id;
bytes that are no UTF-8 after decoding become U+FFFD, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from passagework.llm.common import Memo, fields, map_batches

#: Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for characters below U+0370, whose classes differ in no Unicode version, in Python's terms.
SPACE, NUMBER = r"\t-\r \x85\xa0", "\\d²³¹¼½¾"
LOW_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W{NUMBER}_]+| ?[{NUMBER}]+| ?(?:[^\w{SPACE}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.prefix_space = spec["pre_tokenizer"].get("add_prefix_space", False)
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.start = [vocab[letters[b]] for b in range(256)]
        back = {c: b for b, c in letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.fast, self.sure = re.compile(LOW_PATTERN).findall, Split(Regex(PATTERN), "isolated").pre_tokenize_str
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None
        self.memo = Memo(self.word)

    def cut(self, text: str) -> list[str]:
        """Words of a text. Which characters are letters depends on a library's Unicode version, but not below U+0370."""
        return self.fast(text) if max(text) < "\u0370" else [w for w, _ in self.sure(text)]

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one word."""
        symbols = [self.start[b] for b in text.encode()]
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            now = merges.get((symbols[i], symbols[j])) if j >= 0 and symbols[i] >= 0 else None
            if now is None or now[0] != rank:
                continue  # the pair that was pushed is no longer there
            symbols[i], symbols[j] = now[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (m[0], i))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (m[0], h))
        return tuple(s for s in symbols if s >= 0)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.split(text or "") if self.split else [text or ""]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                if self.prefix_space and not part[0].isspace():
                    part = " " + part
                out.extend(chain.from_iterable(map(self.memo.__getitem__, self.cut(part))))
        self.memo.trim()
        return out

    def decode(self, ids: Sequence[int] | None) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids or ())).decode("utf-8", "replace")


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary on every executor; a worker builds its codec once."""
    spec = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    made: list[Codec] = []

    def codec() -> Codec:
        if not made:
            made.append(Codec(spec.value))
        return made[0]

    return codec


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``ids array<int>`` and ``n_tokens long``."""
    schema = T.StructType([*fields(df, *keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    codec = _shared(df, vocabulary)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        ids = [codec().encode(t) for t in batch.column("__text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())],
            names=schema.fieldNames(),
        )

    return map_batches(df.select(*keep, df[text].alias("__text")), run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the decoded ``text``; null ids give the empty text."""
    schema = T.StructType([*fields(df, *keep), T.StructField("text", T.StringType())])
    codec = _shared(df, vocabulary)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts = [codec().decode(i) for i in batch.column("__ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=schema.fieldNames())

    return map_batches(df.select(*keep, df[ids].alias("__ids")), run, schema)


def round_trip(
    df: DataFrame, vocabulary: str, text: str = "text", keep: Sequence[str] = ("doc_id",), with_ids: bool = False
) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256`` of the comma-joined ids and ``decoded_sha256``.

    ``with_ids`` adds ``ids``, for a caller that keeps the encoded corpus.
    """
    schema = T.StructType(
        [
            *fields(df, *keep),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        ]
    )
    codec = _shared(df, vocabulary)
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        c, counts, of_ids, of_text, kept = codec(), [], [], [], []
        for t in batch.column("__text"):
            ids = c.encode(t.as_py())
            counts.append(len(ids))
            of_ids.append(hexed(",".join(map(c.digits.__getitem__, ids))))
            of_text.append(hexed(c.decode(ids)))
            if with_ids:
                kept.append(pa.array(ids, pa.int32()))
        more = [pa.ListArray.from_arrays(_ends(counts), pa.concat_arrays(kept) if kept else pa.array([], pa.int32()))] if with_ids else []
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), *more],
            names=schema.fieldNames(),
        )

    return map_batches(df.select(*keep, df[text].alias("__text")), run, schema)


def _ends(counts: list[int]) -> pa.Array:
    ends = [0]
    for n in counts:
        ends.append(ends[-1] + n)
    return pa.array(ends, pa.int32())
