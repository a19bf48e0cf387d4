"""The language of each part of a text, and labels that are missing or wrong.

Hierarchical discrimination: linear support vector machines over character
sequences first tell the language family of a sentence, then, one against one, the
languages within it. They are fitted on a bounded sample of labelled documents,
without sentences whose function words contradict the label, and twice: sentences on which the first
fit contradicts it are left out of the second. Everything else covers all documents and whole texts.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import common, shingles

LANGUAGES = ("am", "de", "en", "es", "fr", "pt", "sw")
FAMILIES = {"bantu": ("sw",), "ethiopic": ("am",), "germanic": ("de", "en"), "romance": ("es", "fr", "pt")}
# How labels name the languages, lower case, without region.
NAMES = {
    "am": ("am", "amh", "amharic", "አማርኛ"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "sw": ("sw", "swa", "swh", "swahili", "kiswahili"),
}
# Frequent function words, so that every language is known to any fit.
FUNCTION_WORDS = {
    "am": "እና ነው ላይ ውስጥ ግን ከ ወደ ይህ አንድ ነበር ስለ እንደ ጋር ሁሉ ምን",
    "de": "der die das und ist nicht ein eine mit auf für den von zu sich auch wird noch dem im wenn nur",
    "en": "the of and to in is that it for was with as on are this by from not which a an at its what how",
    "es": "el la los las de que y en un una por con no para es se del al como más lo su hay pero",
    "fr": "le la les des et est une un dans pour que qui pas sur avec au du ce plus par ne de en il",
    "pt": "o a os as de que e em um uma por com não para é se do da no na ao mais dos sua mas",
    "sw": "na ya wa kwa ni katika la za kuwa hii kama lakini yake cha vya huo hiyo sana hata tu ili kisha",
}
#: The sample: documents a language, sentences a document, characters a sentence.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, SAMPLE_CHARACTERS = 200, 4, 400
#: Hashed features; lengths of character sequences; steps and strength of the fit.
FEATURES, LENGTHS, STEPS, PENALTY = 1 << 13, (2, 3, 4), 60, 1e-4
#: A sentence has this many words at least. A text holds a second language if some
#: sentence of it has this many words and this confidence.
LEAST_WORDS, SECOND_WORDS, SECOND_CONFIDENCE, UNSEEN, LONG_LINE = 3, 4, 0.8, 0.05, 8

_FUNCTION = {code: frozenset(words.split()) for code, words in FUNCTION_WORDS.items()}
_MARKUP = re.compile(r"<<[^<>\n]*>>|</?[A-Za-z][^<>\n]{0,200}>|&#?\w{1,10};|https?://\S+|\\[A-Za-z]+|`[^`\n]*`")
_MARKS = ".!?…؟።፧፨"
_END = re.compile(r"[.!?…؟]+[\"'”’»)\]]*(?=\s|\Z)|[።፧፨]+|[\n\r\u2028\u2029]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"(.)\1{3}")


def label_language(c: Column) -> Column:
    """The language that a label names; null for labels that name none of the seven."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[-_].*$", "")
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(s.isin(*names), code).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int, str, int, bool]]:
    """(start, end, letters, words, whole) of the parts of a text with at least LEAST_WORDS words outside
    markup; letters: the words in lower case between single spaces. whole: it ends with a
    sentence's mark. A text without any such part counts its parts of eight longer words as whole; one without
    these too has no sentence.
    """
    out, at = [], 0
    for m in [*_END.finditer(text), None]:
        end = len(text) if m is None else m.end()
        part = unicodedata.normalize("NFKC", _MARKUP.sub(" ", html.unescape(text[at:end]) if "&" in text[at:end] else text[at:end])).casefold()
        words = [w for w in _LETTERS.findall(part) if (len(w) > 1 or ord(w) > 0x7F or w in "aeioy") and not _REPEATED.search(w)]
        if len(words) >= LEAST_WORDS:
            out.append((at, end, " ".join(words), len(words), m is not None and m.group()[0] in _MARKS))
        at = end
    if not any(s[4] for s in out):
        out = [(*s[:4], len([w for w in s[2].split() if len(w) > 1]) >= LONG_LINE) for s in out]
    return out if any(s[4] for s in out) else []


def _columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every character sequence of texts, a space on either side."""
    flat = np.frombuffer("".join(f"\0 {t} " for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    text = np.cumsum(flat == 0) - 1
    features, of = [], []
    for n in LENGTHS:
        x, inside = np.full(max(0, len(flat) - n + 1), n, np.uint64), np.ones(max(0, len(flat) - n + 1), bool)
        for k in range(n):
            c = flat[k : len(flat) - n + 1 + k]
            x = x * np.uint64(0x100000001B3) + c
            inside &= c != 0
        features.append((shingles.mix(x[inside]) & np.uint64(FEATURES - 1)).astype(np.int32))
        of.append(text[: len(x)][inside])
    f, t = np.concatenate(features), np.concatenate(of)
    order = np.argsort(t, kind="stable")
    return f[order], t[order]


def _machines() -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(positive, negative) languages of each machine: family against the rest, then pairs."""
    out = [(own, tuple(x for x in LANGUAGES if x not in own)) for own in FAMILIES.values()]
    return out + [((a,), (b,)) for own in FAMILIES.values() for i, a in enumerate(own) for b in own[i + 1 :]]


def plausible(text: str, label: str) -> bool:
    """Whether nothing in the script and function words of a sentence speaks clearly for another language."""
    letters = text.replace(" ", "")
    if 2 * sum("\u1200" <= c <= "\u139f" for c in letters) > len(letters):
        return label == "am"
    score = dict.fromkeys(LANGUAGES, 0.0)
    for w in text.split():
        of = [c for c in LANGUAGES if w in _FUNCTION[c]]
        for c in of:
            score[c] += 1 / len(of)
    return label != "am" and (max(score.values()) < 1 or score[label] > 0.5 * max(score.values()))


class Model:
    """Weights (features x machines), biases, and the temperature of the confidences."""

    def __init__(self, texts: list[str], labels: list[str]):
        texts, labels = [list(x) for x in zip(*[(t, y) for t, y in zip(texts, labels) if plausible(t, y)])] or [[], []]
        seeds = [(" ".join(w[k::3] + w[::2]), code) for code, w in ((c, x.split()) for c, x in FUNCTION_WORDS.items()) for k in range(3)]
        plain = [(_plain(t), y) for t, y in zip(texts, labels) if _plain(t) != t][::2]
        texts, labels = map(list, zip(*[*zip(texts, labels), *plain, *seeds]))
        y = np.array(labels)
        x = np.zeros((len(texts), FEATURES), np.float32)
        f, t = _columns(texts)
        np.add.at(x, (t, f), 1)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        self._fit(x, y, np.ones(len(y), bool))
        sure = self.probabilities(x @ self.weights + self.bias)
        own = sure[np.arange(len(y)), [LANGUAGES.index(v) for v in y]]
        keep = (sure.argmax(1) == [LANGUAGES.index(v) for v in y]) | (own > 0.4)
        self._fit(x, y, keep)
        margins, index = (x @ self.weights + self.bias)[keep], [LANGUAGES.index(v) for v in y[keep]]
        scale = [0.5, 1.0, 2.0, 3.0, 4.0, 6.0]
        loss = []
        for s in scale:
            self.scale = s
            loss.append(-np.log(np.maximum(self.probabilities(margins)[np.arange(len(index)), index], 1e-9)).mean())
        self.scale = scale[int(np.argmin(loss))]

    scale = 3.0

    def _fit(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> None:
        """Squared hinge loss over the rows to keep by accelerated gradient descent, all machines at once."""
        machines = _machines()
        target = np.stack([np.isin(y, a).astype(np.float32) - np.isin(y, b) for a, b in machines], 1)
        # every language weighs the same on its side of a machine
        weight = np.zeros_like(target)
        for k, (a, b) in enumerate(machines):
            for side in (a, b):
                for code in side:
                    rows = keep & (y == code)
                    if rows.any():
                        weight[rows, k] = 0.5 / (len(side) * rows.sum())
        v = np.random.default_rng(7).standard_normal(x.shape[1]).astype(np.float32)
        heaviest = weight.max(1)
        for _ in range(8):
            v = x.T @ (heaviest * (x @ v))
            norm = float(np.linalg.norm(v))
            v /= max(norm, 1e-12)
        step = 1 / (4 * norm + 2 * PENALTY)  # floats keep the arrays at 32 bits
        w = np.zeros((x.shape[1], len(machines)), np.float32)
        b, z, zb, m = np.zeros(len(machines), np.float32), w.copy(), np.zeros(len(machines), np.float32), 1.0
        for _ in range(STEPS):
            slack = np.maximum(0, 1 - target * (x @ z + zb)) * (target != 0)
            g = -2 * weight * target * slack
            nw, nb = z - step * (x.T @ g + 2 * PENALTY * z), zb - step * g.sum(0)
            nm = (1 + (1 + 4 * m * m) ** 0.5) / 2
            z, zb = nw + (m - 1) / nm * (nw - w), nb + (m - 1) / nm * (nb - b)
            w, b, m = nw, nb, nm
        self.weights, self.bias = w, b

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """(sentence x language): the family's part times the language's within it."""
        s = self.scale * margins
        family = np.exp(s[:, : len(FAMILIES)] - s[:, : len(FAMILIES)].max(1, keepdims=True))
        family /= family.sum(1, keepdims=True)
        out, k = np.zeros((len(s), len(LANGUAGES)), np.float32), len(FAMILIES)
        for n, own in enumerate(FAMILIES.values()):
            won = np.zeros((len(s), len(own)), np.float32)
            for i in range(len(own)):
                for j in range(i + 1, len(own)):
                    won[:, i] += s[:, k]
                    won[:, j] -= s[:, k]
                    k += 1
            won = np.exp((won - won.max(1, keepdims=True)) * (2 / max(2, len(own))))
            won /= won.sum(1, keepdims=True)
            for i, code in enumerate(own):
                out[:, LANGUAGES.index(code)] = family[:, n] * won[:, i]
        return out

    def classify(self, texts: list[str]) -> np.ndarray:
        """Probabilities of sentences (letters as ``sentences`` gives them)."""
        out = [np.empty((0, len(LANGUAGES)), np.float32)]
        for a in range(0, len(texts), 2000):
            part = texts[a : a + 2000]
            f, t = _columns(part)
            n = np.bincount(t, minlength=len(part))
            at = np.cumsum(n) - n
            margins = np.add.reduceat(self.weights[f], at, axis=0) / np.sqrt(n)[:, None] + self.bias
            out.append(self.probabilities(margins))
        return np.concatenate(out)


def _plain(text: str) -> str:
    """Without accents, as some texts have lost theirs."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[list[str], list[str]]:
    """(sentences, labels) of a bounded sample: about SAMPLE_DOCUMENTS documents of each
    label, drawn by a hash of their id, and SAMPLE_SENTENCES sentences of each."""
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("label")).where("text is not null and label is not null")
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 7 rows
    u = F.pmod(F.xxhash64(F.lit("languages"), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    part = F.lit(0.0)
    for label, n in counts.items():
        part = F.when(F.col("label") == label, min(1.0, SAMPLE_DOCUMENTS / n)).otherwise(part)

    def cut(batches):
        for batch in batches:
            out, labels = [], []
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                mine = sentences(text)
                step = max(1, len(mine) // SAMPLE_SENTENCES)
                for s in mine[::step][:SAMPLE_SENTENCES]:
                    out.append(s[2][:SAMPLE_CHARACTERS])
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string()), pa.array(labels, type=pa.string())], names=["sentence", "label"])

    rows = labelled.where(u < part).select("text", "label").mapInArrow(cut, "sentence string, label string")
    drawn = rows.sort("label", "sentence").limit(3 * SAMPLE_DOCUMENTS * SAMPLE_SENTENCES * len(LANGUAGES)).collect()
    return [r.sentence for r in drawn], [r.label for r in drawn]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    return Model(*sample(df, id_col, text_col, label_col))


def decide(p: np.ndarray, words: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The language of each sentence of one text, the text as a whole being a prior.

    A language's prior is its part of the words of the other sentences and UNSEEN. The text has its main
    language and those that some whole sentence, with the prior, has with
    SECOND_CONFIDENCE; other sentences go to the likeliest of these.
    """
    own = np.zeros_like(p)
    own[np.arange(len(p)), p.argmax(1)] = words
    q = p * ((own.sum(0) - own) / words.sum() + UNSEEN)
    q /= q.sum(1, keepdims=True)
    best, sure = q.argmax(1), whole & (q.max(1) >= SECOND_CONFIDENCE) & (words >= SECOND_WORDS)
    allowed = np.zeros(p.shape[1], bool)
    allowed[int((p * words[:, None]).sum(0).argmax())] = True
    allowed[best[sure]] = True
    return np.where(allowed, q, 0).argmax(1)


def _per_text(df: DataFrame, model: Model, id_col: str, text_col: str, extra: str | None, row, schema: str) -> DataFrame:
    """row(id, extra, spans, languages, probabilities) gives the output rows of each text with a sentence."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in common.bounded(batches, 1):
            texts = batch.column(1).to_pylist()
            spans = [sentences(t) if t else [] for t in texts]
            flat = [s[2] for mine in spans for s in mine]
            p, at, out = held.value.classify(flat), 0, []
            ids, more = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, mine in enumerate(spans):
                if mine:
                    own = p[at : at + len(mine)]
                    at += len(mine)
                    out += row(ids[i], more[i], mine, decide(own, np.array([s[3] for s in mine]), np.array([s[4] for s in mine])), own)
            yield out

    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}

    def arrow(batches):
        for rows in run(batches):
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kinds[f[1]]) for c, f in zip(columns, fields)], names=[f[0] for f in fields])

    third = F.col(extra) if extra else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), third.alias("extra")).mapInArrow(arrow, schema)


def segments(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segment, start, end, lang, confidence): the parts of each text in one language, in
    order, by characters; confidence is the mean of their sentences', by words. Texts without a sentence have none."""

    def row(i, _, spans, languages, p):
        out, n = [], 0
        while n < len(spans):
            m = n
            while m < len(spans) and languages[m] == languages[n]:
                m += 1
            words = np.array([s[3] for s in spans[n:m]])
            out.append((i, len(out), spans[n][0], spans[m - 1][1], LANGUAGES[languages[n]], round(float((p[n:m, languages[n]] * words).sum() / words.sum()), 4)))
            n = m
        return out

    return _per_text(df, model or fit(df), id_col, text_col, None, row, "doc_id bigint, segment int, start int, end int, lang string, confidence double")


def found(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, lang): the languages of texts with several, and of texts with one that
    their label doesn't name."""

    def row(i, label, spans, languages, p):
        codes = sorted({LANGUAGES[k] for k in languages})
        return [(i, c) for c in codes] if len(codes) > 1 or codes[0] != label else []

    named = df.withColumn("named_language", label_language(F.col(label_col)))
    return _per_text(named, model or fit(df), id_col, text_col, "named_language", row, "doc_id bigint, lang string")


def identified(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, lang, confidence, verdict): the main language of every text with a sentence; verdict
    is right, absent (no label, or one that names no known language), wrong or several."""

    def row(i, label, spans, languages, p):
        words = np.array([s[3] for s in spans])
        total = np.bincount(languages, weights=words, minlength=len(LANGUAGES))
        main = int(total.argmax())
        mine = languages == main
        confidence = round(float((p[mine, main] * words[mine]).sum() / words[mine].sum()), 4)
        verdict = "several" if (total > 0).sum() > 1 else "absent" if label is None else "right" if label == LANGUAGES[main] else "wrong"
        return [(i, LANGUAGES[main], confidence, verdict)]

    named = df.withColumn("named_language", label_language(F.col(label_col)))
    return _per_text(named, model or fit(df), id_col, text_col, "named_language", row, "doc_id bigint, lang string, confidence double, verdict string")
