"""Records that differ in writing only, collapsed into one with its number of copies.

Bloom filters with two bits a position (seen once, seen again) are filled in each
partition and merged; only records whose every position was seen again are
shuffled for exact grouping, all others are singletons at once. Filters grow in number with
the records, one for each range of hashes, so that their part of false repeats stays the same.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import common
from sedgeline.scratch import Stored, read_part, store, stored

#: Bits a record, and the least and most bits of one filter (2^28: 32 MB a plane in a worker). Records beyond what one
#: filter is for are divided among as many filters as they need, by ranges of their hash.
BITS_A_RECORD, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Bits of a slice, the unit in which partial filters are merged.
SLICE_BITS = 1 << 17

_SIGNS = {0x2212: "-", 0xD7: "*", 0xF7: "/"}
_POINT = re.compile(r"(?<!\d)\.|\.(?!\d)")
_DROP = re.compile(r"[^\w+\-*/=^<>%.]+|_+")
_LABEL = re.compile(r"(context|given|find|note)\s*[:：]", re.IGNORECASE)
_BEFORE_LABEL = re.compile(r"[^\w|\n\r]*$")
#: The ASCII characters that are no content, to be deleted.
_ASCII_DROP = {c: None for c in range(128) if not (chr(c).isalnum() or chr(c) in "+-*/=^<>%.")}


def squeeze(text: str) -> str:
    """What is left of a text when writing is disregarded: letters, digits,
    ``+ - * / = ^ < > %`` and points between digits, after NFKC and case folding."""
    s = common.folded(text)
    if "." in s:
        s = _POINT.sub("", s)
    return s.translate(_ASCII_DROP) if s.isascii() else _DROP.sub("", s.translate(_SIGNS))


def _labels(text: str) -> list[int]:
    """Where the labels of fields start: after the text's begin, a bar or a line end, with no word between."""
    out = []
    if ":" not in text and "：" not in text:
        return out
    for m in _LABEL.finditer(text):
        at = max(text.rfind(c, 0, m.start()) for c in "|\n\r") + 1
        if _BEFORE_LABEL.match(text, at, m.start()):
            out.append(m.start())
    return out


def _of_json(value) -> str:
    if isinstance(value, dict):
        return "".join(sorted(squeeze(k) + _of_json(v) for k, v in value.items()))
    if isinstance(value, list):
        return "".join(map(_of_json, value))
    return squeeze(value if isinstance(value, str) else json.dumps(value))


def content(text: str) -> str:
    """The content of a prompt: of a JSON object or of labelled fields, the fields'
    contents in an order of their own; else the squeezed text."""
    if text.lstrip()[:1] == "{":
        try:
            return _of_json(json.loads(text, strict=False))
        except ValueError:
            pass
    starts = _labels(text)
    if len(starts) < 2:
        return squeeze(text)
    head, parts = squeeze(text[: starts[0]]), [squeeze(text[a:b]) for a, b in zip(starts, [*starts[1:], None])]
    return head + "".join(sorted(parts))


def content_digest(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest): 16 bytes for the content of each text; rows with null text are left out."""

    def run(batches):
        for batch in common.bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            digests = [None if t is None else hashlib.blake2b(content(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, type=pa.binary())], names=["id", "digest"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"id {kind}, digest binary")


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """Two positions in the filter for each digest (two rows)."""
    raw = [hashlib.blake2b(d, digest_size=8).digest() for d in digests.to_pylist()]
    both = np.frombuffer(b"".join(raw), dtype="<u4").reshape(-1, 2).astype(np.int64)
    return both.T % bits


def _marked(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def _mark(bitmap: np.ndarray, pos: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, pos >> 3, np.left_shift(1, pos & 7).astype(np.uint8))


def filter_size(records: int) -> tuple[int, int]:
    """(filters, bits of each) for so many records: ``BITS_A_RECORD`` for each of them, however many."""
    filters = max(1, -(-records * BITS_A_RECORD // MOST_BITS))
    bits = LEAST_BITS
    while bits < records * BITS_A_RECORD / filters:
        bits *= 2
    return filters, bits


def _runs_of(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, from, to) of the stretches of equal numbers."""
    at = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)] if len(numbers) else [0]
    return [(int(numbers[i]), i, j) for i, j in zip(at, at[1:])]


def seen_again(table: DataFrame, bits: int) -> Stored:
    """(rng, k, again): the slices of the merged filters' "seen again" bits, written by filter.

    table: (rng, digest), rows of one filter lying together, so that a task fills one filter at a time.
    """

    def fill(batches):
        at, once, again = None, None, None

        def out():
            step = min(SLICE_BITS, bits) // 8
            for k in range(0, len(once), step):
                if once[k : k + step].any():
                    pack = [pa.array([zlib.compress(x[k : k + step].tobytes(), 1)], type=pa.binary()) for x in (once, again)]
                    yield pa.RecordBatch.from_arrays([pa.array([at], type=pa.int32()), pa.array([k], type=pa.int64()), *pack], names=["rng", "k", "once", "again"])

        for batch in batches:
            for rng, i, j in _runs_of(batch.column(0).to_numpy()):
                if rng != at:
                    if at is not None:
                        yield from out()
                    at, once, again = rng, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                for one in _positions(batch.column(1).slice(i, j - i), bits):
                    pos, n = np.unique(one, return_counts=True)
                    _mark(again, pos[(n > 1) | _marked(once, pos)])
                    _mark(once, pos)
        if at is not None:
            yield from out()

    def merge(batches):
        at, once, again = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], type=pa.int32()), pa.array([at[1]], type=pa.int64()), pa.array([zlib.compress(again.tobytes(), 1)], type=pa.binary())], names=["rng", "k", "again"])

        for batch in batches:
            for rng, k, o, a in zip(*(c.to_pylist() for c in batch.columns)):
                o, a = (np.frombuffer(zlib.decompress(x), np.uint8).copy() for x in (o, a))
                if (rng, k) != at:
                    if at is not None:
                        yield out()
                    at, once, again = (rng, k), o, a
                else:
                    again |= a | (once & o)
                    once |= o
        if at is not None:
            yield out()

    # both positions share a filter, so one record alone may mark a position twice: at worst it is shuffled in vain
    partial = table.select("rng", "digest").mapInArrow(fill, "rng int, k bigint, once binary, again binary")
    merged = partial.repartition("rng", "k").sortWithinPartitions("rng", "k").mapInArrow(merge, "rng int, k bigint, again binary")
    return store(merged, "filter", by="rng")


def _bitmap(uri: str, rng: int, bits: int) -> np.ndarray:
    """The "seen again" bits of one filter, read from the shared folder by the worker that needs them."""
    out = np.zeros(bits // 8, np.uint8)
    for batch in read_part(uri, "rng", rng, ["k", "again"]):
        for k, again in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(zlib.decompress(again), np.uint8)
            out[k : k + len(part)] = part
    return out


def groups(digests: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repeats, grouped, singles) of a table (record_set, id, digest).

    repeats: records that may have an equal one; grouped: (digest, keep, copies) of
    these; singles: records that certainly have none. Digests hold the record set,
    so records of different sets are never equal. The result is exact: the filters
    only decide which records are shuffled. most: records, if known (only sizes the filters).

    Nothing of the filters comes to the driver: merged slices are files of the shared folder, and a task
    reads the one filter that its rows belong to.
    """
    filters, bits = filter_size(digests.count() if most is None else most)
    rng = F.pmod(F.xxhash64("digest"), F.lit(filters)).cast("int")
    table = store(digests.withColumn("rng", rng), "digests", by="rng").df
    uri = seen_again(table, bits).uri()

    def split(batches):
        at, bitmap = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            hit = np.zeros(batch.num_rows, bool)
            for rng, i, j in _runs_of(batch.column(3).to_numpy()):
                if rng != at:
                    at, bitmap = rng, _bitmap(uri, rng, bits)
                hit[i:j] = np.logical_and(*(_marked(bitmap, pos) for pos in _positions(batch.column(2).slice(i, j - i), bits)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hit)], names=["record_set", "id", "digest", "repeat"])

    columns = table.select("record_set", "id", "digest")
    marked = table.select(*columns.columns, "rng").mapInArrow(split, columns.schema.simpleString()[7:-1].replace(":", " ") + ", repeat boolean")
    repeats = stored(marked.where("repeat").drop("repeat"), "repeats")
    grouped = repeats.groupBy("record_set", "digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("copies"))
    return repeats, grouped, marked.where("not repeat").drop("repeat")


def copies(digests: DataFrame, most: int | None = None) -> DataFrame:
    """(record_set, keep, copy) for each record that has an equal one with a smaller id.

    Null contents have no copies. A group of any size is met by ``common.attach``:
    no task holds a whole large group.
    """
    repeats, grouped, _ = groups(digests, most)
    found = common.attach(repeats, stored(grouped.where("copies > 1"), "groups"), ["record_set", "digest"], "copies")
    return found.where("id > keep").select("record_set", "keep", F.col("id").alias("copy"))


def prompt_digests(inventory: DataFrame, id_col: str = "record_no", text_col: str = "canonical_prompt") -> DataFrame:
    d = content_digest(inventory, id_col, text_col)
    return d.select(F.lit("inventory").alias("record_set"), F.col("id").cast("long").alias("id"), F.concat(F.lit(b"i"), "digest").alias("digest"))


def row_digests(rows: DataFrame, id_col: str = "line_no", hash_col: str = "canonical_content_hash") -> DataFrame:
    key = common.hash_key(F.col(hash_col))
    return rows.select(F.lit("training_rows").alias("record_set"), F.col(id_col).cast("long").alias("id"), F.concat(F.lit(b"t"), key).alias("digest")).where("digest is not null")


def found(inventory: DataFrame, rows: DataFrame) -> DataFrame:
    """(record_set, keep_no, copy_no) of prompts with the same content and of rows with the same content hash."""
    return copies(prompt_digests(inventory).unionByName(row_digests(rows)), inventory.count() + rows.count()).select("record_set", F.col("keep").alias("keep_no"), F.col("copy").alias("copy_no"))


def collapsed(inventory: DataFrame, rows: DataFrame) -> DataFrame:
    """(record_set, keep_no, copies): one row a record, with how many times it occurs."""
    _, grouped, singles = groups(prompt_digests(inventory).unionByName(row_digests(rows)), inventory.count() + rows.count())
    return grouped.select("record_set", F.col("keep").alias("keep_no"), "copies").unionByName(singles.select("record_set", F.col("id").alias("keep_no"), F.lit(1).cast("long").alias("copies")))
