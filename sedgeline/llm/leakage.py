"""Evaluation texts that occur, wholly or in part, in a training corpus.

Latent semantic retrieval: passages of the corpus and of the items become TF-IDF
rows, a distributed randomised SVD gives a space of few dimensions, and passages
whose cosine in it reaches a threshold make their document and item a
candidate. Successive passages of an item share a cell, a corpus passage is compared with the
cells' middles first and with the passages of those that come near. Candidates are
then compared word by word: for twelve successive words of the item, or, as paraphrases, by
longest common subsequence and the answer's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import common, folds, shingles
from sedgeline.operators import ordinal
from sedgeline.scratch import read_part, store, stored

#: Hashed words (columns), dimensions kept, dimensions beyond these while fitting.
COLUMNS, RANK, EXTRA = 1 << 15, 128, 10
#: Words of a corpus passage, two stretches of STEP words of which the first is the second of the passage
#: before: every run of STEP + 1 words or fewer lies in one passage. The space is fitted on passages
#: of PASSAGE words end to end, each word once. Words of an item's passage and from one to the next.
PASSAGE, STEP, ITEM_PASSAGE, ITEM_STEP = 24, 12, 12, 4
#: Successive passages of an item in a cell, and the least cosine with a cell's middle for a look into it.
CELL, CELL_COSINE = 3, 0.4
#: Least cosine of a candidate, and the successive words that make a leak.
COSINE, RUN = 0.45, 12
#: A paraphrase: cosine, words of the item's stretches around the best matching passage (or the whole of a shorter item), part
#: of a stretch in a common subsequence with the text around there, part of the answer's words: the stretch's numbers, else
#: its rarest quarter.
PARAPHRASE_COSINE, PARAPHRASE_WORDS, PARAPHRASE_LCS, PARAPHRASE_KEYS = 0.5, 24, 0.6, 0.5
#: Words of the items held at once; a larger set of items is searched in blocks.
BLOCK_WORDS = 500_000
#: Words of the corpus worked on at once in a worker.
AT_ONCE = 1_000_000
SEED = 20260101


def worded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): the 32-bit hash of each word of a text, in order; null has none."""

    def run(batches):
        for batch in common.bounded(batches, 1):
            h, counts = shingles.batch_words(batch.column(1).to_pylist(), common.words)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["id", "words"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_col).where(F.col("id").isNotNull())
    return rows.mapInArrow(run, "id bigint, words array<int>")


class Passages:
    """The passages of a batch of texts: places in the words that lie end to end."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, size: int, step: int):
        per = np.where(counts > 0, np.maximum(1, -(-(counts - size) // step) + 1), 0)
        self.text = np.repeat(np.arange(len(counts)), per)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first = np.cumsum(counts) - counts
        # the last passage ends with its text
        inside = np.minimum(k * step, np.maximum(counts[self.text] - size, 0))
        self.start, self.length, self.size = first[self.text] + inside, np.minimum(size, counts[self.text]), size
        self.columns = _columns(words)

    def __len__(self) -> int:
        return len(self.start)

    def parts(self, most: int = 256) -> Iterator[tuple[np.ndarray, slice]]:
        """(columns of each passage, COLUMNS for none; which passages), few at a time, which stays in a core's cache."""
        for a in range(0, len(self), most):
            yield _matrix(self.columns, self.start[a : a + most], self.length[a : a + most], self.size), slice(a, min(a + most, len(self)))


def _columns(words: np.ndarray) -> np.ndarray:
    return (words.astype(np.int64) & (COLUMNS - 1)).astype(np.int32)


def _matrix(columns: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """The columns of stretches of words, one row a stretch, short ones filled up with COLUMNS."""
    k = np.arange(size)
    return np.where(k < length[:, None], columns[np.minimum(start[:, None] + k, len(columns) - 1)], COLUMNS)


def _padded(matrix: np.ndarray) -> np.ndarray:
    """A matrix of COLUMNS rows, and a row of zeros for no word."""
    return np.vstack([matrix, np.zeros((1, matrix.shape[1]), matrix.dtype)])


def _sums(columns: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """The sum of a matrix' rows over each row of columns, one place after the other."""
    places = np.ascontiguousarray(columns.T)
    y = padded[places[0]]
    for at in places[1:]:
        y += padded[at]
    return y


def _tfidf(columns: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight): the TF-IDF rows of length 1 of passages given by their columns."""
    c = np.sort(columns, axis=1)
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    at = np.flatnonzero(new.ravel())
    count, column, row = np.diff(np.append(at, c.size)), c.ravel()[at], at // c.shape[1]
    own = column < COLUMNS
    count, column, row = count[own], column[own], row[own]
    weight = count * idf[column]
    length = np.sqrt(np.maximum(np.bincount(row, weights=weight * weight, minlength=len(c)), 1e-12))
    return row, column, (weight / length[row]).astype(np.float32)


def _batches(batches, size: int, step: int):
    """(batch, words, counts, passages) of batches of (id, words) with any words."""
    for batch in common.bounded(batches, 1, AT_ONCE):
        column = batch.column(1)
        words = column.flatten().to_numpy(zero_copy_only=False)
        counts = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        if len(words):
            yield batch, words, counts, Passages(words, counts, size, step)


def document_frequency(table: DataFrame, size: int, step: int) -> np.ndarray:
    """In how many passages each column occurs; the last entry is the number of passages."""

    def partial(batches):
        out = np.zeros((COLUMNS + 1, 1))
        for _, _, _, passages in _batches(batches, size, step):
            out[COLUMNS] += len(passages)
            for columns, _ in passages.parts():
                c = np.sort(columns, axis=1)
                new = c < COLUMNS
                new[:, 1:] &= c[:, 1:] != c[:, :-1]
                out[:COLUMNS, 0] += np.bincount(c[new], minlength=COLUMNS)
        return out

    return folds.total(table, partial, (COLUMNS + 1, 1))[:, 0]


def fit(corpus: DataFrame, items: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idf, V, singular values): the right singular vectors (columns x rank) of all TF-IDF passages.

    Corpus and item passages weigh the same in total, else the few items would have no
    say in the space in which they are sought. Randomised: a random matrix goes through
    the rows' Gram matrix, its orthonormal basis Q through the rows again, and the small
    Gram matrix of that gives the rotation. Each pass covers all passages; what
    comes to the driver has a fixed size (COLUMNS x (rank + extra) numbers). The space is the same for any
    order and partitioning of the rows, but for rounding.
    """
    sides = [(corpus, PASSAGE, PASSAGE), (items, ITEM_PASSAGE, ITEM_STEP)]
    counts = [document_frequency(*s) for s in sides]
    n = sum(c[COLUMNS] for c in counts)
    idf = (np.log((n + 1) / (counts[0][:COLUMNS] + counts[1][:COLUMNS] + 1)) + 0.1).astype(np.float32)
    width = rank + EXTRA
    context = corpus.sparkSession.sparkContext
    shared = context.broadcast(idf)

    def times_rows(matrix, rows: bool):
        """Sum over both sides of A'(A M), or of (A M)'(A M)."""
        held = context.broadcast(matrix)
        out = 0.0
        for (table, size, step), c in zip(sides, counts):

            def partial(batches, size=size, step=step):
                idf = shared.value
                m = held.value if held.value is not None else np.random.default_rng(SEED).standard_normal((COLUMNS, width), dtype=np.float32)
                out = np.zeros((COLUMNS if rows else width, width))
                for _, _, _, passages in _batches(batches, size, step):
                    for columns, _ in passages.parts():
                        row, column, weight = _tfidf(columns, idf)
                        own, place = np.unique(column, return_inverse=True)
                        a = np.zeros((columns.shape[0], len(own)), np.float32)
                        a[row, place] = weight
                        y = a @ m[own]
                        if rows:
                            out[own] += a.T @ y
                        else:
                            out += y.T @ y
                return out

            if c[COLUMNS]:
                out = out + folds.total(table, partial, (COLUMNS if rows else width, width), np.float32) / c[COLUMNS]
        return out

    through = times_rows(None, True)
    if not np.any(through):
        return idf, np.zeros((COLUMNS, rank), np.float32), np.zeros(rank)
    q = np.linalg.qr(through)[0].astype(np.float32)
    values, rotation = np.linalg.eigh(times_rows(q, False))
    return idf, (q @ rotation[:, ::-1][:, :rank]).astype(np.float32), np.sqrt(np.maximum(values[::-1][:rank], 0))


def _unit(y: np.ndarray) -> np.ndarray:
    """Rows of length 1; 0 for those outside the space."""
    norm = np.linalg.norm(y, axis=1)
    return np.divide(y, norm[:, None], out=np.zeros_like(y), where=norm[:, None] > 1e-6)


def _project(passages: Passages, padded: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Unit vectors of passages in the latent space, some at a time; as only directions matter, the lengths
    of TF-IDF rows do not. padded: idf x the space's vectors, with a row of zeros."""
    for columns, which in passages.parts():
        yield which, _unit(_sums(columns, padded))


def _windows(words: np.ndarray, counts: np.ndarray, padded: np.ndarray, most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place of the first word, unit vectors) of the corpus passages of texts, some at a time.

    A passage is two successive stretches of STEP words (a short text has one, a text's last may be shorter);
    each stretch is summed up once.
    """
    per = -(-counts // STEP)
    text = np.repeat(np.arange(len(counts)), per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start, length = (np.cumsum(counts) - counts)[text] + STEP * place, np.minimum(STEP, counts[text] - STEP * place)
    columns = _columns(words)
    follows = place + 1 < per[text]
    kept = follows | (per[text] == 1)  # the last stretch of a longer text is in the passage before
    for a in range(0, len(start), most):
        b = min(len(start), a + most)
        # one stretch more than passages, for the last one's second half
        sums = _sums(_matrix(columns, start[a : b + 1], length[a : b + 1], STEP), padded)
        y = sums[: b - a].copy()
        y[follows[a:b]] += sums[1:][follows[a:b][: len(sums) - 1]]
        yield text[a:b][kept[a:b]], start[a:b][kept[a:b]], _unit(y[kept[a:b]])


def _runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all RUN successive words."""
    return shingles.sequences(words.view(np.uint32).astype(np.uint64), counts, RUN)


class Items:
    """A block of items: vectors of their passages in cells, their runs, and their words."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, counts: np.ndarray, numbers: np.ndarray, idf: np.ndarray, padded: np.ndarray):
        self.ids, self.flat, self.counts, self.numbers, self.idf = ids, flat, counts, numbers, idf
        self.first = np.cumsum(counts) - counts
        passages = Passages(flat, counts, ITEM_PASSAGE, ITEM_STEP)
        self.item, self.start = passages.text, passages.start
        self.vectors = np.concatenate([y for _, y in _project(passages, padded)] or [np.empty((0, padded.shape[1]), np.float32)])
        # the place of each passage in its item, and cells of CELL successive ones
        place = np.arange(len(self.item)) - np.searchsorted(self.item, self.item)
        self.cell_start = np.flatnonzero(place % CELL == 0)
        self.cell_size = np.diff([*self.cell_start, len(self.item)])
        self.middles = _unit(np.add.reduceat(self.vectors, self.cell_start, axis=0)) if len(self.cell_start) else self.vectors
        runs, of = _runs(flat, counts)
        self.any_runs = np.unique(runs)
        self.runs = np.unique(shingles.mix(runs ^ shingles.mix(of.astype(np.uint64) + np.uint64(1))))

    def candidates(self, windows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, greatest cosine, where in the texts and which item passage) of all pairs with passages at or above a cosine."""
        found, best, which, where = [], [], [], []
        rows, reach = max(1, 1_000_000 // max(1, len(self.middles))), min(cosine, CELL_COSINE)  # rows at once stay in a core's cache
        for text, start, y in windows:
            for a in range(0, len(y), rows):
                part = y[a : a + rows]
                s = part @ self.middles.T
                near = np.flatnonzero(s.max(axis=1) >= reach) if s.size else np.empty(0, np.int64)
                r, c = np.nonzero(s[near] >= reach)
                for k in range(CELL):
                    has = self.cell_size[c] > k
                    place = self.cell_start[c[has]] + k
                    own = near[r[has]]
                    for b in range(0, len(place), 50_000):
                        p, q = place[b : b + 50_000], own[b : b + 50_000]
                        exact = np.einsum("ij,ij->i", part[q], self.vectors[p])
                        hit = np.flatnonzero(exact >= cosine)
                        found.append(text[a + q[hit]] * np.int64(max(1, len(self.ids))) + self.item[p[hit]])
                        best.append(exact[hit])
                        which.append(p[hit])
                        where.append(start[a + q[hit]])
        key = np.concatenate(found) if found else np.empty(0, np.int64)
        score, which, where = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((best, np.float32), (which, np.int64), (where, np.int64)))
        order = np.lexsort((which, where, -score, key))
        key = key[order]
        first = order[np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))] if len(key) else order
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        n = max(1, len(self.ids))
        return key // n, key % n, score[first], where[first], which[first]

    def stretches(self, item: int, passage: int) -> list[np.ndarray]:
        """The item's stretches of PARAPHRASE_WORDS words that hold a passage: with it at the end, in the middle, at the begin."""
        n, at = int(self.counts[item]), int(self.start[passage] - self.first[item])
        most = max(0, n - PARAPHRASE_WORDS)
        spare = max(0, PARAPHRASE_WORDS - ITEM_PASSAGE)
        begins = sorted({min(most, max(0, at - spare * k // 2)) for k in range(3)})
        return [self.flat[self.first[item] + a : self.first[item] + min(n, a + PARAPHRASE_WORDS)] for a in begins]

    def keys(self, words: np.ndarray) -> set[int]:
        """The words an answer hangs on: the numbers, else the rarest quarter by inverse frequency."""
        own = np.unique(words)
        numbers = own[np.isin(own, self.numbers)]
        if len(numbers):
            return set(numbers.tolist())
        order = np.lexsort((own, -self.idf[own.astype(np.int64) & (COLUMNS - 1)]))
        return set(own[order[: -(-len(own) // 4)]].tolist())

    def paraphrased(self, item: int, passage: int, own: np.ndarray) -> tuple[float, float] | None:
        """(common_part, key_part) of the best stretch around a passage that a piece of text holds as a paraphrase, or None."""
        listed = own.tolist()
        best, held = None, set(listed)
        for stretch in self.stretches(item, passage):
            asked = stretch.tolist()
            if sum(map(held.__contains__, asked)) < PARAPHRASE_LCS * len(asked):
                continue  # no subsequence can be as long
            part = lcs(asked, listed) / len(asked)
            if part < PARAPHRASE_LCS:
                continue
            keys = self.keys(stretch)
            known = len(keys & held) / len(keys)
            if known >= PARAPHRASE_KEYS:
                best = max(best or (0.0, 0.0), (round(part, 6), round(known, 6)))
        return best

    def verbatim(self, text: np.ndarray, item: np.ndarray, runs: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Whether each candidate text holds RUN successive words of its item; runs: those of
        all texts end to end, per_text: how many each has."""
        out = np.zeros(len(text), bool)
        if not len(self.runs) or not len(runs) or not len(text):
            return out
        # only runs that some item holds matter, and texts with such
        near = np.flatnonzero(self.any_runs[np.minimum(np.searchsorted(self.any_runs, runs), len(self.any_runs) - 1)] == runs)
        of_text = np.bincount(np.repeat(np.arange(len(per_text)), per_text)[near], minlength=len(per_text))
        first, runs = np.cumsum(of_text) - of_text, runs[near]
        open_ = np.flatnonzero(of_text[text] > 0)
        for a in range(0, len(open_), 20_000):
            part = open_[a : a + 20_000]
            t, i = text[part], item[part]
            n = of_text[t]
            at = np.cumsum(n) - n
            index = np.repeat(first[t] - at, n) + np.arange(n.sum())
            key = shingles.mix(runs[index] ^ shingles.mix(np.repeat(i, n).astype(np.uint64) + np.uint64(1)))
            place = np.minimum(np.searchsorted(self.runs, key), len(self.runs) - 1)
            hit = self.runs[place] == key
            out[part] = np.bincount(np.repeat(np.arange(len(t)), n)[hit], minlength=len(t)) > 0
        return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, numbers): as ``worded``, with the hashes of those of the words that are numbers."""

    def run(batches):
        for batch in common.bounded(batches, 1):
            words, numbers = [], []
            for t in batch.column(1).to_pylist():
                w = common.words(t) if t else []
                h = (shingles.word_hashes(w) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                words.append(h)
                numbers.append(np.unique(h[[x.isdigit() for x in w]]) if w else h)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate([*xs, np.empty(0, np.int32)]).astype(np.int32))) for xs in (words, numbers)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "words", "numbers"])

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).where(F.col("id").isNotNull())
    return rows.mapInArrow(run, "id bigint, words array<int>, numbers array<int>")


_held: dict = {}


def _block(uri: str, block: int, idf: np.ndarray, padded: np.ndarray) -> Items:
    """A block of items, read from the shared folder and projected by the worker that searches it; the last one is kept."""
    if (uri, block) not in _held:
        _held.clear()
        ids, words, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        counts = [np.empty(0, np.int64)]
        for batch in read_part(uri, "block", block, ["id", "words", "numbers"]):
            ids.append(batch.column(0).to_numpy())
            words.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            counts.append(np.asarray(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), np.int64))
            numbers.append(batch.column(2).flatten().to_numpy(zero_copy_only=False))
        _held[uri, block] = Items(np.concatenate(ids), np.concatenate(words), np.concatenate(counts), np.unique(np.concatenate(numbers)), idf, padded)
    return _held[uri, block]


def search(documents: DataFrame, items: DataFrame, paraphrases: bool, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, kind, cosine, common_part, key_part) of leaks.

    kind is verbatim (RUN successive words) or, where asked for, paraphrase. Every document
    is searched for every item: blocks of items are files of the shared folder, and a worker projects its documents
    once for all of them. Null and empty texts, and items of fewer than RUN words,
    have no verbatim leaks. Repeated (id, text) rows give a pair once a row.
    """
    spark = documents.sparkSession
    table, asked = stored(worded(documents, doc_col, text_col), "doc-words"), stored(_item_table(items, item_col, text_col), "item-words")
    schema = "doc_id bigint, item_id bigint, kind string, cosine double, common_part double, key_part double"
    placed = ordinal.with_running(asked.where("size(words) > 0").withColumn("n", F.size("words")), ["id", "words"], upto="n")
    blocks = store(placed.withColumn("block", F.floor((F.col("upto") - F.col("n")) / BLOCK_WORDS).cast("int")).drop("n", "upto"), "item-blocks", by="block")
    numbers = sorted(r.block for r in blocks.df.select("block").distinct().collect())  # one for each BLOCK_WORDS words of the items
    if not numbers:
        return spark.createDataFrame([], schema)
    idf, v, _ = fit(table, asked.select("id", "words"), rank)
    space = spark.sparkContext.broadcast((idf, _padded(v * idf[:, None])))  # COLUMNS x rank numbers
    uri = blocks.uri()

    def run(batches):
        idf, padded = space.value
        for batch, words, counts, _ in _batches(batches, PASSAGE, PASSAGE):
            ids, first = batch.column(0).to_numpy(), np.cumsum(counts) - counts
            windows = list(_windows(words, counts, padded))
            runs, run_text = _runs(words, counts)
            per_text = np.bincount(run_text, minlength=len(counts))
            rows = []
            for number in numbers:
                of = _block(uri, number, idf, padded)
                text, item, score, where, which = of.candidates(windows, cosine)
                exact = of.verbatim(text, item, runs, per_text)
                rows += [(ids[t], of.ids[i], "verbatim", float(s), None, None) for t, i, s in zip(text[exact], item[exact], score[exact])]
                for k in np.flatnonzero(~exact & (score >= PARAPHRASE_COSINE)) if paraphrases else []:
                    a, b = first[text[k]], first[text[k]] + counts[text[k]]
                    hit = of.paraphrased(item[k], which[k], words[max(a, where[k] - PASSAGE) : min(b, where[k] + 2 * PASSAGE)])
                    if hit:
                        rows.append((ids[text[k]], of.ids[item[k]], "paraphrase", float(score[k]), *hit))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "kind", "cosine", "common_part", "key_part"])

    return table.mapInArrow(run, schema)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold at least twelve successive words of the item's text."""
    return search(documents, items, False).select("doc_id", "item_id").distinct()


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """As ``search``, paraphrases too, cosines to four digits."""
    return search(documents, items, True).withColumn("cosine", F.round("cosine", 4))


def leaked_items(documents: DataFrame, items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """(item_id, suite, documents): every item that leaked, and into how many documents."""
    n = found(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return n.join(items.select(F.col(item_col).cast("long").alias("item_id"), "suite"), "item_id")
