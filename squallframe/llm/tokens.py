"""Encoding with a public byte-level tokenizer, by a sentencepiece model written from its vocabulary.

The rank file gives every token's bytes and rank. Each byte stands for one visible character, so a token is a piece of such
characters; its score is its negative rank, and the model merges the best-scored neighbours first, just as ranks are merged.
The normaliser is the identity. Texts are split into pre-tokens by the vocabulary's pattern; each distinct pre-token of a batch
is encoded once. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every function that reads one takes the folder as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# The pattern that splits text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens that a worker remembers, and the longest of them in characters.
MEMORY, LONGEST = 400_000, 48


def byte_chars() -> list[str]:
    """A visible character for each byte: itself where Latin-1 has a visible one, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    by = {int(r): base64.b64decode(t) for t, r in pairs}
    return [by[i] for i in range(len(by))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece i is token i, the unknown piece comes last and is never produced, as every byte
    is a token."""
    chars = byte_chars()
    out = bytearray()
    for rank, t in enumerate(tokens):
        piece = "".join(chars[b] for b in t).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encoder and decoder of one model; a worker makes one and keeps it."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.sp.get_piece_size() - 1
        self.split = regex.compile(PATTERN).findall
        self.chars = dict(enumerate(byte_chars()))
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for null and empty texts."""
        parts = [self.split(t) if t else [] for t in texts]
        new = list({p for ps in parts for p in ps}.difference(self.known))
        known = self.known
        if new:
            mapped = [p.encode("utf-8").decode("latin-1").translate(self.chars) for p in new]
            fresh = dict(zip(new, self.sp.encode(mapped, num_threads=1)))
            known = self.known | fresh if len(self.known) + len(fresh) > MEMORY else self.known
            known.update(fresh)
        out = []
        for ps in parts:
            ids: list[int] = []
            for p in ps:
                ids += known[p]
            out.append(ids)
        if new:
            if known is not self.known:
                self.known = {}
            else:
                for p in new:
                    if len(p) > LONGEST:
                        del self.known[p]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        back = {c: b for b, c in self.chars.items()}
        return bytes(back[c] for i in ids for c in self.sp.id_to_piece(int(i))).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """This process's codec of the model."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def load_model(spark: SparkSession, folder: str = TOKENIZER_DIR, name: str = VOCABULARY):
    """The model as a broadcast variable: its size is that of the vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(model_bytes(read_ranks(f"{folder}/{name}")))


def _slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts (column 1) hold about so many bytes at most; a longer text is a part of its own."""
    sizes = batch.column(1).nbytes
    n = batch.num_rows
    step = max(1, n if sizes <= chars else int(n * chars / sizes))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def encode_documents(documents: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the ids of every text, without special tokens; strings that look like one are ordinary text.
    Null and empty texts have the empty list."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for whole in batches:
            for batch in _slices(whole):
                got = c.encode_batch(batch.column(1).to_pylist())
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids). A null or empty list is the empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        back = {ch: b for b, ch in c.chars.items()}
        pieces = [bytes(back[ch] for ch in c.sp.id_to_piece(i)) for i in range(c.size)]
        for batch in batches:
            texts = [b"".join(pieces[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(f"`{key}`").alias(key), "ids").mapInArrow(run, f"`{key}` {kind}, text string")
