"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from .byte_bpe import ByteBpe

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.json")

_loaded: dict[str, ByteBpe] = {}


def _tokenizer(key: str, content) -> ByteBpe:
    """One tokenizer a worker process, kept from task to task."""
    if key not in _loaded:
        _loaded[key] = ByteBpe(content.value)
    return _loaded[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read once and sent to the executors: a few MB, whatever the data."""
    ship(df.sparkSession)
    with open(path, "rb") as f:
        return path, df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens; their strings in a text are ordinary text.

    An empty and a null text give an empty list; a null key stays null. Repeated rows each come out. Other columns don't matter.
    """
    path, content = _vocabulary(docs, vocabulary)

    def run(batches):
        encode = _tokenizer(path, content).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.fromiter((x for i in ids for x in i), np.int32, int(ends[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens): the length of the list that encode_texts gives, without making the lists leave the worker."""
    path, content = _vocabulary(docs, vocabulary)

    def run(batches):
        encode = _tokenizer(path, content).encode
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, tokens bigint")


def decode_ids(encoded: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the exact text of each list of ids; a null list gives null."""
    path, content = _vocabulary(encoded, vocabulary)

    def run(batches):
        decode = _tokenizer(path, content).decode
        for batch in batches:
            texts = [None if i is None else decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")
