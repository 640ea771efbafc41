"""Token ids of a corpus by a public byte-level tokenizer, with exact decoding and character offsets.

Texts are encoded in Arrow batches. The tokenizer's own pre-tokenizer cuts a
text into pieces that are encoded independently of one another, so each distinct
piece is encoded once per worker and remembered (a bounded memory, emptied when
full: it changes speed, never results).

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; very long texts are encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import _arrow_schema, parts, spread, table

#: Folder of the vocabulary files; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"
#: Pieces remembered by a worker.
REMEMBERED = 200_000
#: Fixed value: the pre-tokenizer's published pattern, by which byte-level vocabularies of this family cut text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(None)
def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte: printable Latin-1 characters for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(4)
def _vocabulary(path: str) -> dict[int, bytes]:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table_ = byte_characters()
    return {i: bytes(table_[c] for c in token) for token, i in vocab.items() if all(c in table_ for c in token)}


class Encoder:
    """Encodes texts with a byte-level vocabulary, remembering pieces."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        self.path = f"{folder}/{name}.json"
        self.tokenizer, self.cut, self.known = _load(self.path), regex.compile(PIECES), {}

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.cut.findall(t) if t else () for t in texts]
        known = self.known
        new = list(set().union(*cut) - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*cut))
        for piece, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            known[piece] = e.ids
        out = []
        for pieces in cut:
            row: list[int] = []
            for p in pieces:
                row += known[p]
            out.append(row)
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        return [len(x) for x in self.ids(texts)]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The characters (start, end) each id covers; ids of parts of one character cover that character."""
        raw, at, starts = text.encode("utf-8"), 0, []
        char_of = [i for i, c in enumerate(text) for _ in range(len(c.encode("utf-8")))]
        for i in self.ids([text])[0]:
            n = len(_vocabulary(self.path)[i])
            starts.append((char_of[at], char_of[at + n - 1] + 1))
            at += n
        assert at == len(raw)
        return starts

    def decode(self, ids: list[int]) -> str:
        """The text of `ids`: bytes are joined first, so that characters split over ids come out whole; a cut character gives a replacement mark."""
        v = _vocabulary(self.path)
        return b"".join(v[i] for i in ids).decode("utf-8", "replace")


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row of `df`."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>"
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        encoder = Encoder(tokenizer, folder)
        for b, texts in parts(batches, 1):
            rows = encoder.ids(texts)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(rows, arrow.field(1).type)], schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) of each row of `df`; null and empty texts have 0."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_tokens int"
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        encoder = Encoder(tokenizer, folder)
        for b, texts in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array(encoder.counts(texts), pa.int32())], schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the characters that each of its ids covers: `starts` and `ends`; ids of parts of one character cover that character."""

    def run(batches):
        encoder = Encoder()
        for b, texts in parts(batches, 1):
            spans = [encoder.offsets(t) if t else [] for t in texts]
            of = lambda k: pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int32()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column(0), of(0), of(1)], names=["doc_id", "starts", "ends"])

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id bigint, starts array<int>, ends array<int>")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids and whether decoding them gives the text back."""

    def run(batches):
        encoder = Encoder()
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encoder.ids(texts)
            same = [encoder.decode(i) == (t or "") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int32()), pa.array(same)], names=["doc_id", "n_ids", "exact"])

    return table(spark, sf_dir, "documents").select("doc_id", F.col("text")).mapInArrow(run, "doc_id bigint, n_ids int, exact boolean")
