"""Near-duplicate records: all pairs above a similarity of word sequences.

The product of the record x sequence incidence matrix with itself is taken block by
block over the sequences that can decide a pair. Each record's sequences are
ordered from rare to frequent by a frequency table; two similar records must then
share one of the first few (how many follows from the size and the threshold). Cells
whose size, position, or 256-bit signature bounds the overlap below what the threshold
needs are discarded inside the join; the others accumulate the overlap of the
deciding sequences for their pair. Pairs for which that and all that may follow is too
little are discarded, the rest is counted to the end. No pair above the threshold is lost.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import common, copies, shingles, splits
from sedgeline.scratch import store, stored

#: Words in a sequence, and the least similarity (common over all distinct sequences).
SEQUENCE, SIMILARITY = 3, 0.6
#: Counters of the frequency table: 16 bits each, at most 2^24 (32 MB broadcast). Frequencies only order sequences;
#: collisions cost time, never pairs. More sequences than these are for are counted exactly, by shuffles.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 24
_SLICE = 1 << 16


def incidence(df: DataFrame, id_col: str, text_col: str, words: int = SEQUENCE) -> DataFrame:
    """(id, content, same, size, seqs) of each text: digest of its content, digest of
    its set of sequences, and the sorted set. Null texts are left out."""

    def run(batches):
        for batch in common.bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            x, n = shingles.distinct(*shingles.sequences(*shingles.batch_words(texts, common.masked_words), words), len(texts))
            ends = np.cumsum(n)
            content = [hashlib.blake2b(copies.content(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            same = [hashlib.blake2b(x[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(ends, n)]
            seqs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(x.view(np.int64)))
            columns = [batch.column(0).cast(pa.int64()), pa.array(content, type=pa.binary()), pa.array(same, type=pa.binary()), pa.array(n.astype(np.int32)), seqs]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "content", "same", "size", "seqs"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_col).where(F.col(text_col).isNotNull())
    return rows.mapInArrow(run, "id bigint, content binary, same binary, size int, seqs array<bigint>")


def _values(column) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a list column as unsigned, size of each list)."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)


def frequencies(seqs: DataFrame, counters: int) -> np.ndarray:
    """Saturating counts of sequences by hash, summed over partitions slice by slice."""

    def count(batches):
        total = np.zeros(counters, np.uint32)
        for batch in common.bounded(batches, 0):
            at, n = np.unique(_values(batch.column(0))[0] & np.uint64(counters - 1), return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.uint32)
        for k in range(0, counters, _SLICE):
            part = np.minimum(total[k : k + _SLICE], 65535).astype(np.uint16)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], type=pa.binary())], names=["k", "counts"])

    def merge(batches):
        at, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], type=pa.int64()), pa.array([zlib.compress(np.minimum(total, 65535).astype(np.uint16).tobytes(), 1)], type=pa.binary())], names=["k", "counts"])

        for batch in batches:
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                part = np.frombuffer(zlib.decompress(c), np.uint16).astype(np.int64)
                if k != at:
                    if at is not None:
                        yield out()
                    at, total = k, part
                else:
                    total = total + part
        if at is not None:
            yield out()

    merged = seqs.mapInArrow(count, "k bigint, counts binary").repartition("k").sortWithinPartitions("k").mapInArrow(merge, "k bigint, counts binary")
    table = np.zeros(counters, np.uint16)
    for row in merged.toLocalIterator():  # 2 bytes a counter in all
        part = np.frombuffer(zlib.decompress(bytes(row.counts)), np.uint16)
        table[row.k : row.k + len(part)] = part
    return table


def with_frequencies(records: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """records (id, column, ...) with ``keys`` and ``counts``, from which ``Frequencies`` knows how often each item of
    a list column occurs in all records.

    While the table of counters (most: at most so many) has two counters for each item, it is that table, broadcast, and
    the columns are null; else items are counted exactly, common ones met by broadcast, and come back to their
    records, each with its own.
    """
    total, counters = records.agg(F.sum(F.size(column))).first()[0] or 0, LEAST_COUNTERS
    most = MOST_COUNTERS if most is None else most
    while counters < most and counters < 2 * total:
        counters *= 2
    none = F.lit(None).cast("array<bigint>")
    if counters >= 2 * total:
        return Frequencies(records.withColumns({"keys": none, "counts": none}), frequencies(records.select(column), counters))
    each = records.select("id", F.explode(F.array_distinct(column)).alias("key"))
    often = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "frequencies")
    own = common.attach(each, often, ["key"], "n").groupBy("id").agg(F.collect_list(F.struct("key", "n")).alias("own"))  # as many as the record has
    lists = own.select("id", F.transform("own", lambda o: o["key"]).alias("keys"), F.transform("own", lambda o: o["n"]).alias("counts"))
    empty = F.array().cast("array<bigint>")
    return Frequencies(records.join(lists, "id", "left").withColumns({"keys": F.coalesce("keys", empty), "counts": F.coalesce("counts", empty)}), None)


class Frequencies:
    """Records with what is known of the frequencies of their items; ``of`` is called in workers."""

    def __init__(self, records: DataFrame, table: np.ndarray | None):
        self.records, self._shared = records, None
        if table is not None:
            self._shared = records.sparkSession.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    def reader(self):
        """A function (items, their records, keys column, counts column) -> frequencies, to be made once a task."""
        shared = self._shared

        def exact(x: np.ndarray, doc: np.ndarray, keys, counts) -> np.ndarray:
            k, n = _values(keys)
            named = lambda v, d: shingles.mix(v ^ shingles.mix(d.astype(np.uint64) + np.uint64(1)))
            held = named(k, np.repeat(np.arange(len(n)), n))
            order = np.argsort(held)
            held, count = held[order], counts.flatten().to_numpy(zero_copy_only=False)[order]
            if not len(held):
                return np.ones(len(x), np.int64)
            asked = named(x, doc)
            at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
            return np.where(held[at] == asked, count[at], 1)

        def make():
            if shared is None:
                return exact
            freq = np.frombuffer(zlib.decompress(shared.value), np.uint16)
            mask = np.uint64(len(freq) - 1)
            return lambda x, doc, keys, counts: freq[(x & mask).astype(np.int64)].astype(np.int64)

        return make


def postings(known: Frequencies, similarity: float) -> DataFrame:
    """(seq, id, size, pos, idx, warm, b0..b3): the deciding sequences of each record.

    A record's first size - ceil(t size) + 1 sequences probe, the first
    size - ceil(2 t / (1 + t) size) + 1 of these (idx) also answer larger records.
    Sequences known to occur once are left out. warm: counted more often than a block has rows.
    """
    reader, t = known.reader(), similarity

    def run(batches):
        frequency = reader()
        for batch in common.bounded(batches, 1):
            x, n = _values(batch.column(1))
            if not len(x):
                continue
            ids, size = batch.column(0).to_numpy(), n
            doc = np.repeat(np.arange(len(n)), n)
            signature = np.zeros((len(n), 256), bool)
            signature[doc, (shingles.mix(x) & np.uint64(255)).astype(np.int64)] = True
            bits = np.packbits(signature, axis=1).view(np.int64)
            f = frequency(x, doc, batch.column(2), batch.column(3))
            order = np.lexsort((x, f, doc))
            x, f = x[order], f[order]
            pos = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            probe = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            index = n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64) + 1
            keep = (pos < probe[doc]) & (f > 1)
            d, pos = doc[keep], pos[keep]
            columns = [pa.array(x[keep].view(np.int64)), pa.array(ids[d]), pa.array(size[d].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(pos < index[d]), pa.array(f[keep] > common.BLOCK)]
            columns += [pa.array(np.ascontiguousarray(bits[d, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["seq", "id", "size", "pos", "idx", "warm", "b0", "b1", "b2", "b3"])

    return known.records.select("id", "seqs", "keys", "counts").mapInArrow(run, "seq bigint, id bigint, size int, pos int, idx boolean, warm boolean, b0 bigint, b1 bigint, b2 bigint, b3 bigint")


def _candidates(posts: DataFrame, similarity: float) -> DataFrame:
    """(x, y), once each: pairs that meet in a block, with the overlap accumulated over the
    deciding sequences they share, and that no bound discards.

    Both records hold their sequences in one order, so all that they share up to their last
    common deciding one is in the sum; the shorter of what follows in the two bounds the rest.
    """
    hot = common.blocks_of(posts.where("warm"), ["seq"])
    nb = F.coalesce("nb", F.lit(1))
    warm = posts.where("warm").join(hot, "seq", "left").withColumn("blk", F.pmod(F.xxhash64("id"), nb).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    cold = posts.where("not warm").withColumns({"blk": F.lit(0), "other": F.lit(0)})
    cells = cold.unionByName(warm.drop("nb"))
    side = lambda s, row, col: cells.select("seq", F.col("blk").alias(row), F.col("other").alias(col), *(F.col(c).alias(f"{s}_{c}") for c in ("id", "size", "pos", "idx", "b0", "b1", "b2", "b3")))
    met = side("x", "i", "j").where("x_idx").join(side("y", "j", "i"), ["seq", "i", "j"])
    t, both = F.lit(similarity), F.col("x_size") + F.col("y_size")
    need = t / (1 + t) * both - 1e-6
    after = F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))
    differ = sum((F.bit_count(F.col(f"x_b{k}").bitwiseXOR(F.col(f"y_b{k}"))) for k in range(4)), F.lit(0))
    smaller = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_id") < F.col("y_id")))
    bound = smaller & (F.col("x_size") >= t * F.col("y_size") - 1e-6) & (after >= need) & ((both - differ) / 2 >= need)
    left = F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos")) - 1
    cells = met.where(bound).select(F.col("x_id").alias("x"), F.col("y_id").alias("y"), "x_size", "y_size", left.alias("left"))
    sums = cells.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.min("left").alias("left"), F.first("x_size").alias("x_size"), F.first("y_size").alias("y_size"))
    return sums.where(F.col("shared") + F.col("left") >= t / (1 + t) * (F.col("x_size") + F.col("y_size")) - 1e-6).select("x", "y")


def similar(records: DataFrame, similarity: float = SIMILARITY, counters: int | None = None) -> DataFrame:
    """(x, y, overlap, x_size, y_size) of all pairs of records (id, size, seqs) at or above the similarity.

    records should be stored and hold no two equal sets. Records without sequences
    (fewer words than a sequence) are similar to none. counters: the most counters of the frequency table.
    """
    records = records.where("size > 0")
    posts = store(postings(with_frequencies(records, "seqs", counters), similarity), "postings")
    pairs = stored(_candidates(posts.df, similarity), "candidates")
    posts.drop()
    ends = stored(pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "id"), "candidate-ends")
    records = records.join(ends, "id", "left_semi")  # most records are in no pair
    of = lambda s: records.select(F.col("id").alias(s), F.col("size").alias(f"{s}_size"), F.col("seqs").alias(f"{s}_seqs"))
    counted = pairs.join(of("x"), "x").join(of("y"), "y").withColumn("overlap", F.size(F.array_intersect("x_seqs", "y_seqs")))
    ratio = F.col("overlap") / (F.col("x_size") + F.col("y_size") - F.col("overlap"))
    return counted.where(ratio >= similarity).select("x", "y", "overlap", "x_size", "y_size")


def classes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, records) of an incidence table: nodes (same, content, node, n, rep), one for the n records
    with the same sequences and content, of which node is the first and rep the first with the
    same sequences; records: the reps with their sequences."""
    nodes = table.groupBy("same", "content").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    reps = nodes.groupBy("same").agg(F.min("node").alias("rep"))
    nodes = stored(nodes.join(reps, "same"), "nodes")
    records = stored(table.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "size", "seqs"), "records")
    return nodes, records


def members_of(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, id) of all records; nodes with many records are met by broadcast."""
    by = ["same", "content"]
    return stored(common.attach(table.select(*by, "id"), nodes, by, "n").select("node", "id"), "members")


def found(inventory: DataFrame, id_col: str = "record_no", text_col: str = "canonical_prompt", similarity: float = SIMILARITY, words: int = SEQUENCE) -> DataFrame:
    """(a_no, b_no), a_no < b_no: pairs of records of different content and a similarity at or above the threshold.

    Similarity is worked out between distinct sets of sequences only; records with the
    same set and content are one node, and node pairs are expanded into record pairs
    at the end, in blocks.
    """
    table = stored(incidence(inventory, id_col, text_col, words), "incidence")
    nodes, records = classes(table)
    pairs = similar(records, similarity).select("x", "y").unionByName(records.where("size > 0").select(F.col("id").alias("x"), F.col("id").alias("y")))
    # a rep with one node has no pairs of its own
    several = nodes.groupBy(F.col("rep").alias("x")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
    pairs = pairs.where("x <> y").unionByName(pairs.where("x = y").join(several, "x", "left_semi").select("x", "y"))
    of_rep = nodes.select("rep", F.struct("node", "content").alias("m"))
    met = common.member_pairs(stored(pairs, "pairs"), of_rep, "x", "y", "rep", "m")
    met = met.where("a.content <> b.content and (x <> y or a.node < b.node)").select(F.col("a.node").alias("p"), F.col("b.node").alias("q"))
    members = members_of(table, nodes)
    out = common.member_pairs(stored(met, "node-pairs"), members, "p", "q", "node", "id")
    return out.select(F.least("a", "b").alias("a_no"), F.greatest("a", "b").alias("b_no"))


def grouped(inventory: DataFrame, id_col: str = "record_no", text_col: str = "canonical_prompt", similarity: float = SIMILARITY, words: int = SEQUENCE) -> DataFrame:
    """(record_no, group_no, links): of each record the smallest record of its group, and
    the number of differing sets of sequences similar to its own.

    A group is what similarity ties over any number of steps; records with the same
    sequences are one in this. Null texts are left out; texts too short for a sequence
    group with texts of the same content only.
    """
    table = stored(incidence(inventory, id_col, text_col, words), "incidence")
    nodes, records = classes(table)
    pairs = stored(similar(records, similarity).select("x", "y"), "pairs")
    components = splits.merge_components(None, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    links = pairs.select("x").union(pairs.select("y")).groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    short = table.where("size = 0").select("same").distinct()
    of = nodes.join(short.withColumn("short", F.lit(True)), "same", "left").select("node", F.when(F.col("short"), F.col("node")).otherwise(F.col("rep")).alias("rep"))
    of = of.join(components.withColumnsRenamed({"family": "rep"}), "rep", "left").join(links.withColumnRenamed("x", "rep"), "rep", "left")
    of = of.select("node", F.coalesce("component", "rep").alias("group_no"), F.coalesce("links", F.lit(0)).alias("links"))
    members = members_of(table, nodes)
    sized = stored(of.join(nodes.select("node", "n"), "node"), "sized")
    return common.attach(members, sized, ["node"], "n").select(F.col("id").alias(id_col), "group_no", "links")
