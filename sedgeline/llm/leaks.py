"""The same or nearly the same records on both sides of a split.

Normalised records are cut into content-defined chunks: a rolling hash over two
words decides where a chunk ends, so an edit moves the borders next to it only.
Chunk digests are joined across the splits and the lengths of shared chunks summed
into overlap fractions; pairs that this proposes are then checked exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import common, copies, neardup, shingles
from sedgeline.scratch import Stored, store, stored

#: A chunk ends after a word where the hash of it and the word before is 0 modulo
#: ``DIVISOR``, but has ``LEAST_WORDS`` words at least; about 6 words on average.
WINDOW, DIVISOR, LEAST_WORDS = 2, 4, 3
#: Part of a record's words that shared chunks must be able to cover for a pair to be proposed.
LEAST_OVERLAP = 0.05


def cut(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, words, text) of the chunks of texts, given their word hashes end to end."""
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    starts, lasts = np.cumsum(counts) - counts, np.cumsum(counts) - 1
    rolled = np.zeros(len(h), np.uint64)
    for back in range(WINDOW - 1, -1, -1):
        rolled = shingles.mix(rolled * np.uint64(31) + np.concatenate([np.zeros(back, np.uint64), h[: len(h) - back]]))
    border = rolled % np.uint64(DIVISOR) == 0
    is_last = np.zeros(len(h), bool)
    is_last[lasts[counts > 0]] = True
    ends = np.flatnonzero(border | is_last)
    first = np.zeros(len(h), bool)
    first[starts[counts > 0]] = True
    kept, at = [], 0
    for e, stop in zip(ends.tolist(), is_last[ends].tolist()):
        if stop or e + 1 - at >= LEAST_WORDS:
            kept.append(e)
            at = e + 1
    e = np.array(kept)
    s = np.concatenate([[0], e[:-1] + 1])
    # digest of a chunk: mixed sum over its words, each mixed with its place in the chunk
    place = np.arange(len(h)) - np.repeat(s, e - s + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(h + np.uint64(0x9E3779B97F4A7C15) * (place + 1).astype(np.uint64)), dtype=np.uint64)])
    digest = shingles.mix(total[e + 1] - total[s] + (e - s + 1).astype(np.uint64))
    doc = np.repeat(np.arange(len(counts)), counts)
    return digest, e - s + 1, doc[e]


def chunked(df: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """(id, train, content, same, size, seqs, chunks, lengths) of each text with a split.

    size, seqs: as in ``neardup.incidence``; chunks, lengths: digests of the chunks in order and
    their words. Texts that are null or in neither kind of split are left out.
    """

    def run(batches):
        for batch in common.bounded(batches, 2):
            texts = batch.column(2).to_pylist()
            h, counts = shingles.batch_words(texts, common.masked_words)
            x, n = shingles.distinct(*shingles.sequences(h, counts, neardup.SEQUENCE), len(texts))
            ends = np.cumsum(n)
            digest, words, doc = cut(h, counts)
            of_text = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            content = [hashlib.blake2b(copies.content(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            same = [hashlib.blake2b(x[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(ends, n)]
            lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in ((np.concatenate([[0], ends]).astype(np.int32), x.view(np.int64)), (of_text, digest.view(np.int64)), (of_text, words.astype(np.int32)))]
            columns = [batch.column(0), batch.column(1), pa.array(content, type=pa.binary()), pa.array(same, type=pa.binary()), pa.array(n.astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "train", "content", "same", "size", "seqs", "chunks", "lengths"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), train.alias("train"), F.col(text_col).alias("text")).dropna()
    return rows.mapInArrow(run, "id bigint, train boolean, content binary, same binary, size int, seqs array<bigint>, chunks array<bigint>, lengths array<int>")


def two_sided(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, nt, ne): the keys with training and evaluation rows, and how many of each; stored."""
    n = rows.groupBy(*by).agg(F.count_if("train").alias("nt"), F.count_if(~F.col("train")).alias("ne"))
    return stored(n.where("nt > 0 and ne > 0"), "two-sided")


def across(rows: DataFrame, by: list[str], values: list[str], condition: Column | None = None, block: int = common.BLOCK) -> DataFrame:
    """Pairs of a training row and an evaluation row with the same key.

    rows: by, train, values; out: t_* and e_* for each of values. Only keys with both sides go on; of the others
    large ones are dropped before any shuffle (``common.attach`` bounds what is broadcast, however much data there is).
    Every key is cut into blocks of rows by block, so that no task gets a whole large key.
    """
    n = rows.groupBy(*by).agg(F.count_if("train").alias("nt"), F.count_if(~F.col("train")).alias("ne"))
    sizes = stored(n.where(f"(nt > 0 and ne > 0) or nt + ne > {common.HOT_ROWS}"), "key-sizes").withColumn("n", F.col("nt") + F.col("ne"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    # a large key with one side only is met by broadcast as well, and has no blocks of the other side
    kept = common.attach(rows, sizes.select(*by, "n", blocks("nt").alias("bt"), blocks("ne").alias("be")), by, "n").where("bt > 0 and be > 0")
    mine = F.pmod(F.xxhash64(*values), F.when(F.col("train"), F.col("bt")).otherwise(F.col("be"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("train"), F.col("be")).otherwise(F.col("bt")) - 1))
    cells = kept.withColumn("mine", mine).withColumn("other", other)
    t = cells.where("train").select(*by, F.col("mine").alias("i"), F.col("other").alias("j"), *(F.col(v).alias(f"t_{v}") for v in values))
    e = cells.where("not train").select(*by, F.col("other").alias("i"), F.col("mine").alias("j"), *(F.col(v).alias(f"e_{v}") for v in values))
    met = t.join(e, [*by, "i", "j"])
    return (met if condition is None else met.where(condition)).select(*(f"{s}_{v}" for s in "te" for v in values))


def _postings(known: neardup.Frequencies) -> Stored:
    """(chunk, id, size, words, length, left, b0..b3, in_train, in_eval) of the chunks that can decide a pair: of a
    record's distinct chunks from rare to frequent, those before which no more than the
    rest, less than ``LEAST_OVERLAP`` of its words, remains. words: the record's, length: the chunk's (of all its
    occurrences), left: the words of the chunks after it in this order."""
    reader = known.reader()

    def run(batches):
        frequency = reader()
        for batch in common.bounded(batches, 1):
            c, n = neardup._values(batch.column(2))
            if not len(c):
                continue
            x, size = neardup._values(batch.column(1))
            signature = np.zeros((len(size), 256), bool)
            signature[np.repeat(np.arange(len(size)), size), (shingles.mix(x) & np.uint64(255)).astype(np.int64)] = True
            bits = np.packbits(signature, axis=1).view(np.int64)
            length = batch.column(3).flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            f = frequency(c, doc, batch.column(6), batch.column(7))
            order = np.lexsort((c, f, doc))
            c, f, length, doc = c[order], f[order], length[order], doc[order]
            # equal chunks of a record are one, with the words of all
            first = np.ones(len(c), bool)
            first[1:] = (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(first)
            c, f, doc, length = c[at], f[at], doc[at], np.add.reduceat(length, at)
            whole = np.bincount(doc, weights=length, minlength=len(n)).astype(np.int64)
            before = np.cumsum(length) - length - (np.cumsum(whole) - whole)[doc]
            keep = (whole[doc] - before >= LEAST_OVERLAP * whole[doc]) & (f > 1)
            d = doc[keep]
            ids, train, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 4, 5))
            numbers = [pa.array(v.astype(np.int32)) for v in (size[d], whole[d], length[keep], (whole[doc] - before - length)[keep])]
            columns = [pa.array(c[keep].view(np.int64)), pa.array(ids[d]), *numbers, *(pa.array(np.ascontiguousarray(bits[d, k])) for k in range(4)), pa.array(train[d].astype(bool)), pa.array(held[d].astype(bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "id", "size", "words", "length", "left", "b0", "b1", "b2", "b3", "in_train", "in_eval"])

    schema = "chunk bigint, id bigint, size int, words int, length int, left int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, in_train boolean, in_eval boolean"
    return store(known.records.select("id", "seqs", "chunks", "lengths", "in_train", "in_eval", "keys", "counts").mapInArrow(run, schema), "chunk-postings")


def _proposed(records: DataFrame, similarity: float) -> DataFrame:
    """(t_id, e_id), once each: records whose shared chunks can cover ``LEAST_OVERLAP`` of the words of the one with fewer,
    and whose sizes and signatures allow the similarity.

    The lengths of shared chunks are summed over the deciding ones; what the records hold behind the last of these
    bounds the rest.
    """
    kept = _postings(neardup.with_frequencies(records, "chunks"))
    sided = lambda held, train: kept.df.where(held).withColumn("train", F.lit(train)).drop("in_train", "in_eval")
    posts = sided("in_train", True).unionByName(sided("in_eval", False))
    t, both = F.lit(similarity), F.col("t_size") + F.col("e_size")
    differ = sum((F.bit_count(F.col(f"t_b{k}").bitwiseXOR(F.col(f"e_b{k}"))) for k in range(4)), F.lit(0))
    near = (F.col("t_id") != F.col("e_id")) & (F.least("t_size", "e_size") >= t * F.greatest("t_size", "e_size") - 1e-6) & ((both - differ) / 2 >= t / (1 + t) * both - 1e-6)
    cells = across(posts, ["chunk"], ["id", "size", "words", "length", "left", "b0", "b1", "b2", "b3"], near)
    shared = cells.groupBy("t_id", "e_id").agg(
        F.sum(F.least("t_length", "e_length")).alias("shared"), F.min(F.least("t_left", "e_left")).alias("left"), F.first(F.least("t_words", "e_words")).alias("words")
    )
    out = stored(shared.where(F.col("shared") + F.col("left") >= LEAST_OVERLAP * F.col("words")).select("t_id", "e_id"), "proposed")
    kept.drop()
    return out


def similar_reps(table: DataFrame, similarity: float = neardup.SIMILARITY, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, reps): pairs (t_id, e_id) of representatives, a training and an evaluation one, similar at or above the
    threshold, one with both kinds of members paired with itself; reps (same, id, in_train, in_eval) of all records.

    A representative is the first record of each distinct set of sequences; records without sequences are similar to
    none. Pairs are proposed by their shared chunks and then counted exactly. exact: proposed by shared
    sequences instead (``neardup.similar``), which loses no pair, also of records without a common chunk.
    """
    reps = stored(table.groupBy("same").agg(F.min("id").alias("id"), F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval")), "reps")
    records = stored(table.where("size > 0").join(reps.drop("same"), "id").select("id", "size", "seqs", "chunks", "lengths", "in_train", "in_eval"), "records")
    if exact:
        xy = neardup.similar(records.select("id", "size", "seqs"), similarity).select("x", "y")
        kinds = records.select("id", "in_train", "in_eval")
        ends = xy.union(xy.select("y", "x")).toDF("t_id", "e_id")
        near = ends.join(kinds.where("in_train").select(F.col("id").alias("t_id")), "t_id").join(kinds.where("in_eval").select(F.col("id").alias("e_id")), "e_id").select("t_id", "e_id")
    else:
        pairs = _proposed(records, similarity)
        ends = stored(pairs.select("t_id").union(pairs.select("e_id")).distinct().toDF("id"), "proposed-ends")
        few = records.join(ends, "id", "left_semi")  # most records are in no pair
        of = lambda s: few.select(F.col("id").alias(f"{s}_id"), F.col("size").alias(f"{s}_size"), F.col("seqs").alias(f"{s}_seqs"))
        counted = pairs.join(of("t"), "t_id").join(of("e"), "e_id").withColumn("overlap", F.size(F.array_intersect("t_seqs", "e_seqs")))
        near = counted.where(F.col("overlap") / (F.col("t_size") + F.col("e_size") - F.col("overlap")) >= similarity).select("t_id", "e_id")
    own = records.where("in_train and in_eval").select(F.col("id").alias("t_id"), F.col("id").alias("e_id"))
    return stored(near.unionByName(own), "rep-pairs"), reps


def _members(table: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, id, train) of all records; sets that many records share are met by broadcast."""
    n = table.groupBy("same").agg(F.count(F.lit(1)).alias("n"))
    named = stored(reps.select("same", F.col("id").alias("rep")).join(n, "same"), "rep-names")
    return stored(common.attach(table.select("same", "id", "train"), named, ["same"], "n").select("rep", "id", "train"), "rep-members")


def similar_across(table: DataFrame, similarity: float = neardup.SIMILARITY, exact: bool = False) -> DataFrame:
    """(t, e): a training and an evaluation record, similar at or above the threshold; see ``similar_reps``."""
    keys, reps = similar_reps(table, similarity, exact)
    members = _members(table, reps)
    # the pair of reps is the key on which their records meet
    out = common.member_pairs(keys, members.where("train"), "t_id", "e_id", "rep", "id", right_members=members.where("not train"))
    return out.select(F.col("a").alias("t"), F.col("b").alias("e"))


def _chunked_inventory(inventory: DataFrame) -> DataFrame:
    return stored(chunked(inventory, "record_no", "canonical_prompt", common.is_training(F.col("source_split"))), "chunked")


def _original_ids(inventory: DataFrame) -> DataFrame:
    """(id, train, source, original) of the records with a split, a source and an original id."""
    train = common.is_training(F.col("source_split"))
    return inventory.select(F.col("record_no").cast("long").alias("id"), train.alias("train"), F.trim("source_id").alias("source"), common.id_key(F.col("original_id")).alias("original")).dropna()


def overlapping(inventory: DataFrame, table: DataFrame, exact: bool = False) -> DataFrame:
    """(id), once each: the evaluation records that have a training record of the same content, of a
    similarity of 0.6 or more, or of the same source and original id.

    Groups are flagged by their counts and joined back to their rows; no pairs of records are made.
    """
    pairs, reps = similar_reps(table, exact=exact)
    hit = pairs.select(F.col("e_id").alias("rep")).distinct()
    similar = _members(table, reps).where("not train").join(hit, "rep", "left_semi").select("id")

    def flagged(rows: DataFrame, by: list[str]) -> DataFrame:
        rows = rows.select(*by, "id", "train")
        sizes = two_sided(rows, by).select(*by, F.col("ne").alias("n"))
        return common.attach(rows.where("not train"), sizes, by, "n").select("id")

    return similar.unionByName(flagged(table, ["content"])).unionByName(flagged(_original_ids(inventory), ["source", "original"])).distinct()


def classes(inventory: DataFrame, exact: bool = False) -> DataFrame:
    """(record_no, class_no, links): of each inventory record with a split the first record with the same set of sequences (of
    those too short for a sequence, each text content has a class), and how many classes on the other side of
    the split are similar to its class, its own counting if it has members there.

    The form for large groups: rows grow with the records, not with their pairs.
    """
    table = _chunked_inventory(inventory)
    short = F.when(F.col("size") == 0, F.concat("same", "content")).otherwise(F.col("same"))
    pairs, _ = similar_reps(table, exact=exact)
    links = pairs.groupBy(F.col("t_id").alias("rep")).agg(F.count(F.lit(1)).alias("links")).withColumn("train", F.lit(True))
    links = links.unionByName(pairs.groupBy(F.col("e_id").alias("rep")).agg(F.count(F.lit(1)).alias("links")).withColumn("train", F.lit(False)))
    sized = table.withColumn("same", short)
    keyed = stored(sized.groupBy("same").agg(F.min("id").alias("class_no"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval")), "classes")
    by_side = links.groupBy("rep").agg(F.max(F.when(F.col("train"), F.col("links"))).alias("lt"), F.max(F.when(~F.col("train"), F.col("links"))).alias("le"))
    named = stored(keyed.join(by_side, keyed["class_no"] == by_side["rep"], "left").select("same", "class_no", "n", "lt", "le", ((F.col("size") == 0) & F.col("in_train") & F.col("in_eval")).cast("long").alias("own")), "class-names")
    met = common.attach(sized.select("same", "id", "train"), named, ["same"], "n")
    of = F.coalesce(F.when(F.col("train"), F.col("lt")).otherwise(F.col("le")), "own")
    return met.select(F.col("id").alias("record_no"), "class_no", of.alias("links"))


def _ordered(t: str, e: str, record_set: str) -> list[Column]:
    return [F.lit(record_set).alias("record_set"), F.least(t, e).alias("a_no"), F.greatest(t, e).alias("b_no")]


def inventory_pairs(inventory: DataFrame, exact: bool = False) -> DataFrame:
    """(record_set, a_no, b_no): inventory records of a training and an evaluation split
    with the same content, a similarity of 0.6 or more, or the same source and original id."""
    table = _chunked_inventory(inventory)
    same = [across(table, ["content"], ["id"]), across(_original_ids(inventory), ["source", "original"], ["id"]), similar_across(table, exact=exact).select(F.col("t").alias("t_id"), F.col("e").alias("e_id"))]
    return same[0].unionByName(same[1]).unionByName(same[2]).distinct().select(*_ordered("t_id", "e_id", "inventory"))


def _sourced(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, key, source, split) of training rows with a source record: their family, the dataset of the record and
    its split or, if that is null, the one inside source_key. Family, dataset and split may be null."""
    of_key = sources.where("source_key is not null").groupBy("source_key")
    record = of_key.agg(F.max(common.split_name(F.col("source_split"))).alias("split"), F.max(common.dataset_key(F.col("dataset") if "dataset" in sources.columns else F.lit(None).cast("string"))).alias("source"))
    inside = common.split_name(F.try_element_at(F.split(F.substring_index("source_key", "@", -1), "/"), F.lit(2)))
    of = rows.select(F.col("line_no").cast("long").alias("id"), common.hash_key(F.col("family_id")).alias("key"), "source_key").join(record, "source_key")
    return of.select("id", "key", "source", F.coalesce("split", inside).alias("split"))


def row_splits(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, key, train) of training rows: their family and the kind of their split. Rows
    without a source record, a family or a known split are left out."""
    return _sourced(rows, sources).select("id", "key", (F.col("split") == "train").alias("train")).dropna()


def row_pairs(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_set, a_no, b_no): training rows of one family on both sides of the split."""
    return across(stored(row_splits(rows, sources), "row-splits"), ["key"], ["id"]).select(*_ordered("t_id", "e_id", "training_rows"))


def found(inventory: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    return inventory_pairs(inventory).unionByName(row_pairs(rows, sources))


def overlap_fractions(inventory: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(record_no, fraction): of each evaluation record the part of its words in chunks
    that also occur in a training record; 0 for a text without words. table: as ``chunked``, if there already."""
    table = _chunked_inventory(inventory) if table is None else table
    each = table.select("id", "train", F.explode(F.arrays_zip("chunks", "lengths")).alias("c")).select("id", "train", "c.chunks", "c.lengths")
    trained = each.where("train").select("chunks").distinct().withColumn("seen", F.lit(1))
    mine = each.where("not train").groupBy("id", "chunks").agg(F.sum("lengths").alias("w"))
    hit = mine.join(trained, "chunks", "left").groupBy("id").agg((F.sum(F.when(F.col("seen") == 1, F.col("w")).otherwise(0)) / F.sum("w")).alias("fraction"))
    return table.where("not train").select("id").join(hit, "id", "left").select(F.col("id").alias("record_no"), F.round(F.coalesce("fraction", F.lit(0.0)), 6).alias("fraction"))


def inventory_report(inventory: DataFrame, exact: bool = False) -> DataFrame:
    """(record_set, source, split, record_count, overlapping, mean_fraction) of the inventory by source_id, as in ``report``."""
    table = _chunked_inventory(inventory)
    found = overlapping(inventory, table, exact).select(F.col("id").alias("record_no")).withColumn("hit", F.lit(1))
    split = common.split_name(F.col("source_split"))
    records = inventory.select(F.col("record_no").cast("long").alias("record_no"), F.col("source_id").alias("source"), split.alias("split")).where("split <> 'train'")
    of = records.join(found, "record_no", "left").join(overlap_fractions(inventory, table), "record_no", "left")
    counts = of.groupBy("source", "split").agg(F.count(F.lit(1)).alias("record_count"), F.count("hit").alias("overlapping"), F.round(F.avg(F.coalesce("fraction", F.lit(0.0))), 6).alias("mean_fraction"))
    return counts.select(F.lit("inventory").alias("record_set"), "source", "split", "record_count", "overlapping", "mean_fraction")


def row_report(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_set, source, split, record_count, overlapping, mean_fraction) of training rows by dataset, as in ``report``.

    Rows are counted by family first, so a large family is one row of the join and no
    pairs are made. A row without a family overlaps with none.
    """
    counted = stored(_sourced(rows, sources).groupBy("source", "split", "key").agg(F.count(F.lit(1)).alias("n")), "row-counts")
    trained = counted.where("split = 'train'").select("key").dropna().distinct().withColumn("hit", F.lit(1))
    of = counted.where("split <> 'train'").join(trained, "key", "left").groupBy("source", "split")
    counts = of.agg(F.sum("n").alias("record_count"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("overlapping"))
    return counts.select(F.lit("training_rows").alias("record_set"), "source", "split", "record_count", "overlapping", F.lit(None).cast("double").alias("mean_fraction"))


def report(inventory: DataFrame, rows: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(record_set, source, split, record_count, overlapping, mean_fraction): evaluation records of the inventory
    and, with rows and sources, evaluation rows of training_rows by source and split; how many have a pair in
    the training split, and how much of them occurs there (null for rows, which have no text)."""
    out = inventory_report(inventory)
    return out if rows is None else out.unionByName(row_report(rows, sources))
