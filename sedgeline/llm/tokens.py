"""Encoding of texts with a public tokenizer, token offsets, and decoding.

The vocabulary file's path is a parameter. The driver reads the file once (about
1.5 MB, a fixed size) and broadcasts its text, so executors need no copy of it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import word_count
from sedgeline.llm import common

TOKENIZERS = "/opt/tokenizers"
#: Characters encoded in one call; bounds a worker's memory whatever the batch.
CHARS_A_CALL = 1_000_000

_loaded: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.json")


def _tokenizer(text: str):
    key = str(hash(text))
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        t.no_truncation()
        t.no_padding()
        _loaded[key] = t
    return _loaded[key]


def byte_characters() -> dict[str, int]:
    """The printable character by which byte-level BPE writes each byte, reversed.

    Printable Latin-1 bytes stand for themselves; the others follow, in order, from U+0100.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def token_bytes(text: str) -> list[bytes]:
    """The bytes of each id of a vocabulary file."""
    spec, table = json.loads(text), byte_characters()
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in spec["model"]["vocab"].items():
        out[i] = bytes(table[ch] for ch in token)
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def _lengths(text: str) -> np.ndarray:
    key = f"lengths{hash(text)}"
    if key not in _loaded:
        _loaded[key] = np.array([len(b) for b in token_bytes(text)], dtype=np.int64)
    return _loaded[key]


def _pieces(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts of a batch, some at a time, null as empty."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHARS_A_CALL:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(parts: list[np.ndarray], lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _vocabulary(df: DataFrame, path: str | None):
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.

    Text is taken as it is, whole. Null and empty text give an empty list; rows with
    equal or null ids stay apart, one row out for each row in. Other columns are
    left out, so their names can't clash.
    """
    vocabulary = _vocabulary(df, path)

    def run(batches):
        t = _tokenizer(vocabulary.value)
        for batch in common.bounded(batches, 1):
            parts, lengths = [], []
            for texts in _pieces(batch.column(1).to_pylist()):
                for e in t.encode_batch_fast(texts, add_special_tokens=False):
                    ids = e.ids
                    lengths.append(len(ids))
                    parts.append(np.array(ids, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts, lengths, pa.int32())], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, starts, ends): of each token the characters it covers, wholly or in part.

    Token bytes are laid end to end and mapped to characters, so a character split
    between tokens lies in the span of each of them.
    """
    vocabulary = _vocabulary(df, path)

    def run(batches):
        t, size = _tokenizer(vocabulary.value), _lengths(vocabulary.value)
        for batch in common.bounded(batches, 1):
            ids_, starts, ends, lengths = [], [], [], []
            for texts in _pieces(batch.column(1).to_pylist()):
                for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
                    ids = np.array(e.ids, dtype=np.int32)
                    raw = np.frombuffer(text.encode(), dtype=np.uint8)
                    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
                    end = np.cumsum(size[ids])
                    lengths.append(len(ids))
                    ids_.append(ids)
                    starts.append(char[end - size[ids]].astype(np.int32))
                    ends.append((char[end - 1] + 1).astype(np.int32))
            columns = [_lists(p, lengths, pa.int32()) for p in (ids_, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "ids", "starts", "ends"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the text of each list of ids, through the reversed byte table.

    Bytes are joined before they are read as UTF-8, so characters split between
    tokens come back whole; bytes that are no UTF-8 become U+FFFD, ids outside the
    vocabulary nothing. A null list gives null.
    """
    vocabulary = _vocabulary(df, path)

    def run(batches):
        table = token_bytes(vocabulary.value)
        n = len(table)
        for batch in common.bounded(batches, 1):
            texts = [
                None if ids is None else b"".join(table[i] for i in ids if i is not None and 0 <= i < n).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def fertility(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "lang", path: str | None = None) -> DataFrame:
    """(by, documents, tokens, words, fertility): tokens a word of the texts of each value of a column, whole;
    words are runs of characters other than spaces. Null and empty texts count as documents without either."""
    keyed = df.select(F.struct(F.col(id_col).alias("id"), F.col(by).alias("by"), word_count(F.col(text_col)).alias("words")).alias("key"), F.col(text_col).alias("text"))
    n = encode(keyed, "key", "text", path).select("key.by", F.coalesce("key.words", F.lit(0)).alias("w"), F.size("ids").alias("t"))
    out = n.groupBy(F.col("by").alias(by)).agg(F.count(F.lit(1)).alias("documents"), F.sum("t").alias("tokens"), F.sum("w").alias("words"))
    return out.withColumn("fertility", F.round(F.col("tokens") / F.nullif(F.col("words"), F.lit(0)), 6))
