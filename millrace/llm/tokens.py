"""Token counts of whole texts by a public tokenizer: batches encoded in Arrow functions that return lengths only.

Texts stay where the scan has read them. In a task they are cut into pieces at safe boundaries, the distinct pieces of
about a megabyte of text that were not met before are encoded in batches of about `BATCH_BYTES`, so that neither a very
long text nor many long ones decide the size of a batch, and the counts of a text's pieces are added up. The counts of
pieces met before are kept up to `KEPT_PIECES`; beyond, the store starts anew.

A boundary is safe for a piece-BPE model whose normaliser is the identity, which adds a word mark in front of a text
and has no piece with a word mark after another character: a single space between two characters that are neither a space
nor the mark itself. The space is dropped, since the mark that the encoder puts in front of the piece stands for it.
Other models get whole texts.

Defined results: null and empty texts have no bytes and no tokens; rows that repeat are counted each; other columns do
not matter.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common
from millrace.llm.arrays import chunks, flat

BATCH_BYTES, KEPT_PIECES, LIMIT = 1 << 17, 200_000, 4096
SAFE = re.compile(rb"(?<=[^ ])(?<!\xe2\x96\x81) (?! |\xe2\x96\x81|\Z)")


class PieceCounter:
    """Counts of a sentencepiece model."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        path = public_tokenizers.path(name)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        inner = any("▁" in p.piece.lstrip("▁") for p in spec.pieces)
        own = any(p.type == 4 for p in spec.pieces)
        self.safe = plain and not inner and not own and not spec.trainer_spec.treat_whitespace_as_suffix

    def split(self, data: bytes) -> list[bytes]:
        return SAFE.split(data) if self.safe else [data]

    def lengths(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class FastCounter:
    """Counts of a `tokenizers` file; special strings inside texts are handled as that file says."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(public_tokenizers.path(name))
        self.model.no_truncation()
        self.model.no_padding()

    def split(self, data: bytes) -> list[bytes]:
        return [data]

    def lengths(self, texts: list[bytes]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch([t.decode() for t in texts], add_special_tokens=False)]


def counter(name: str):
    return FastCounter(name) if name.endswith(".json") else PieceCounter(name)


def count_column(model, column: pa.Array, known: dict[bytes, int], batch_bytes: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text. known: counts of pieces met before; it grows."""
    data, offsets = flat(column)
    raw, all_pieces, first = data.tobytes(), [], [0]
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if a < z:
            all_pieces += model.split(raw[a:z])
        first.append(len(all_pieces))
    if len(known) > KEPT_PIECES:
        known.clear()
    batch, held = [], 0
    new = [p for p in dict.fromkeys(all_pieces) if p not in known]
    for i, p in enumerate(new):
        batch.append(p)
        held += len(p)
        if held >= batch_bytes or i == len(new) - 1:
            known.update(zip(batch, model.lengths(batch)))
            batch, held = [], 0
    sums = np.zeros(len(all_pieces) + 1, np.int64)
    np.cumsum(np.fromiter(map(known.__getitem__, all_pieces), np.int64, len(all_pieces)), out=sums[1:])
    return np.diff(offsets), np.diff(sums[first])


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = counter(tokenizer), {}
        for b in chunks(batches, "text"):
            size, tokens = count_column(model, b.column(1), known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(common.table(spark, folder, "documents"))
