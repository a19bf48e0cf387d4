"""Helpers shared by the training-data operators: value spellings, hash forms,
and joins of groups that may be very large."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.functions.text import spelled, split_name  # noqa: F401
from sedgeline.joins import HOT_GROUPS, HOT_ROWS, attach  # noqa: F401

# Spellings of subjects.
SUBJECTS = {
    "math": ("math", "maths", "mathematics"),
    "physics": ("physics", "phys"),
    "chemistry": ("chemistry", "chem"),
    "biology": ("biology", "bio"),
    "earth_science": ("earth_science", "earth_sciences", "earthscience", "geoscience", "earth"),
}
#: Rows of one key from which its pairs are made block by block.
BLOCK = 2000


def is_training(c: Column) -> Column:
    """True for a training split, false for an evaluation split, null for neither."""
    return split_name(c) == "train"


def subject_name(c: Column) -> Column:
    """The usual name of a subject; other names only trimmed and lower-cased."""
    s = spelled(c)
    out = s
    for name, variants in SUBJECTS.items():
        out = F.when(s.isin(*variants), name).otherwise(out)
    return out


def dataset_name(c: Column) -> Column:
    """Trimmed and lower-cased, the form in which datasets are reported."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def dataset_key(c: Column) -> Column:
    """What datasets are joined on: separators and spacing disregarded too."""
    return F.regexp_replace(dataset_name(c), r"(?U)[\s\-_]+", "-")


def hash_key(c: Column) -> Column:
    """The 32 bytes of a value with 64 hexadecimal digits, else the trimmed text
    as bytes; null for null and blank values."""
    digits = F.regexp_extract(F.lower(c), "(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])", 1)
    text = F.lower(F.trim(c))
    return F.when(F.length(digits) == 64, F.unhex(digits)).when(F.length(text) > 0, F.encode(text, "UTF-8"))


def hash_text(key: Column) -> Column:
    """``sha256:`` and 64 lower-case digits for a hash key; other keys as their text."""
    return F.when(F.length(key) == 32, F.concat(F.lit("sha256:"), F.lower(F.hex(key)))).otherwise(F.decode(key, "UTF-8"))


def id_key(c: Column) -> Column:
    """An original id without case, separators and leading zeros of its numbers."""
    zeros = F.regexp_replace(F.lower(c), r"(?<![0-9])0+(?=[0-9])", "")
    return F.nullif(F.regexp_replace(zeros, r"(?U)[^\p{Alnum}]+", ""), F.lit(""))


def blocks_of(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The keys with more than ``block`` rows, with ``nb``, the blocks to cut them into.

    At most rows / block keys come out, whatever the skew.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > block)
        .select(*keys, F.ceil(F.col("n") / block).cast("int").alias("nb"))
    )


def member_pairs(nodes: DataFrame, members: DataFrame, left: str, right: str, node: str, member: str, right_members: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Rows (a, b) of all members of the left node with all of the right one.

    nodes: distinct pairs (left, right); members: (node, member), of the right node
    right_members where given. A node with more
    than ``block`` members is cut into blocks, and each pair of blocks is a join
    key of its own, so that no task holds more than block x block results of a pair.
    """
    spread = nodes
    for side, table, name in ((left, members, "a"), (right, members if right_members is None else right_members, "b")):
        hot = blocks_of(table, [node], block)
        spread = (
            spread.join(hot.select(F.col(node).alias(side), "nb"), side, "left")
            .withColumn(f"{side}_blk", F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1)))
            .drop("nb")
        )
        cut = table.join(hot, node, "left").select(
            F.col(node).alias(side), F.pmod(F.xxhash64(member), F.coalesce("nb", F.lit(1))).cast("int").alias(f"{side}_blk"), F.col(member).alias(name)
        )
        spread = spread.join(cut, [side, f"{side}_blk"])
    return spread


#: Characters, or list items, of a column that are worked on at once in a Python worker.
AT_ONCE = 4_000_000


def bounded(batches: Iterable[pa.RecordBatch], column: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text or list column holds no more than ``most`` bytes or items
    (or one row), whatever the length of single texts."""
    for batch in batches:
        c = batch.column(column)
        sizes = pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
        total = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(total) or total[-1] <= most:
            yield batch
            continue
        a, done = 0, 0
        while a < len(total):
            b = max(a + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(a, b - a)
            a, done = b, int(total[b - 1])


#: A number by itself, else a run of letters and digits. A search goes on where the last match ended, never inside a run.
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*(?![^\W_])|[^\W_]+")
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """A text after NFKC and case folding."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC and case folding."""
    return _WORD.findall(folded(text))


def masked_words(text: str) -> list[str]:
    """As ``words``, every number (with its inner points and commas) as ``0``."""
    return ["0" if t[0].isdigit() and not any(map(str.isalpha, t)) else t for t in _TOKEN.findall(folded(text))]
