"""Toxicity by multiple-instance learning: labels stand at documents, scores at sentences.

A sentence's score is a logistic function of the features it holds; a document is toxic if any of its
sentences is, so its score is the noisy-or 1 - (1 - leak) * prod(1 - s) over the sentences that hold any
feature; the leak, one small chance for each document, stands for labels that no sentence explains. A
sentence without any feature scores 0, so a text's length alone makes it no more toxic. Training lowers the cross entropy of the
documents' labels under the noisy-or, whose gradient reaches each sentence in proportion to what it
adds; so the sentences that make a document toxic get the weight, and the model finds them afterwards.

Features are words in lower case and their first 4, 5, 6 and 7 characters, as 64-bit hashes: endings
change and are stuck on in several languages, and a prefix is learnt from all of them. Neither the
label nor language, source or id are features.

The fit uses at most FIT_ROWS labelled documents: those of the least hash of their id, a uniform sample
that is the whole training set where that is smaller. Their features are counted in Spark, the
VOCABULARY with the most evidence of toxic documents (G test on documents) is kept, and the documents, reduced to the
sentences that hold any of it, are fitted on the driver: a bounded size whatever the corpus. Every
document is scored on its whole text.

Defined cases: a null or empty text has no sentences and scores 0; labels without id or verdict are not
learnt from, and of several labels of one id the highest holds; of several training rows with one id the
fit takes the least text; each row gets its own score; with labels of one kind only, or none, all texts
with a sentence score 1 where all labels are toxic, and else 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import mix, prefix_sums, slices, span_hashes, _LETTERS
from .common import lean, scratch, texts_of

#: Documents that the fit uses at most; features it keeps; documents that a feature needs.
FIT_ROWS, VOCABULARY, MIN_DOCS = 1 << 15, 1 << 10, 3
PREFIXES = (4, 5, 6, 7)
#: Steps, step size and weight decay of the fit; they and VOCABULARY were chosen on a split of training rows.
STEPS, RATE, DECAY = 200, 0.1, 1e-5
CUT = 0.3
#: A sentence of at least this score is reported as offending.
SENTENCE_CUT = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, in place of whole bytes of UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data < 91)] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


class Sentences:
    """The words of one slice of texts with their sentences and features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        low = _lower(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        letter = np.zeros(n + 1, bool)
        letter[:n] = _LETTER[low]
        first = letter[:n] & (~np.concatenate([[False], letter[: n - 1]]) | edge[:n]) if n else letter[:0]
        last = letter[:n] & (~letter[1:] | edge[1:])
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        # a sentence ends behind a line break, and behind a stop before white space
        behind = np.zeros(n + 1, bool)
        if n:
            behind[1:n] = (data[:-1] == 10) | (_STOP[data[:-1]] & _BLANK[data[1:]])
        behind[offsets[:-1]] = True
        behind[n] = True
        self.bounds = np.flatnonzero(behind)  # sentence k: bounds[k] to bounds[k + 1], some without words
        self.word_sentence = np.searchsorted(self.bounds, self.start, "right") - 1
        worded = np.zeros(len(self.bounds), bool)
        worded[self.word_sentence] = True
        self.doc_of = np.searchsorted(offsets, self.bounds, "right") - 1  # by sentence
        self.counts = np.bincount(self.doc_of[worded], minlength=len(offsets))[: len(offsets) - 1]
        sums = prefix_sums(low, _LETTERS)
        signs = np.flatnonzero(np.concatenate([(data & 0xC0) != 0x80, [True]]))  # where characters begin
        at = np.searchsorted(signs, self.start)
        features, words = [mix(span_hashes(sums, self.start, self.end))], [np.arange(len(self.start))]
        for k in PREFIXES:
            stop = signs[np.minimum(at + k, len(signs) - 1)]
            w = np.flatnonzero(stop <= self.end)
            features.append(mix(span_hashes(sums, self.start[w], stop[w]) ^ np.uint64(k)))
            words.append(w)
        self.feature, self.word = np.concatenate(features), np.concatenate(words)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


@dataclasses.dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, the weight that every sentence with a feature has, and
    that of the leak."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def hits(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, index of feature) of the vocabulary's features, each once a sentence."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sieve = np.zeros(1 << 20, bool)  # most features are none of the vocabulary's
        sieve[(self.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(sieve[(s.feature & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.features, s.feature[maybe]), len(self.features) - 1)
        found = self.features[at] == s.feature[maybe]
        return _distinct(s.word_sentence[s.word[maybe[found]]], at[found])

    def scores(self, s: Sentences, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents' scores; the sentences with hits, and theirs."""
        sentence, feature = self.hits(s)
        names, place = np.unique(sentence, return_inverse=True)
        z = self.bias + np.bincount(place, weights=self.weights[feature], minlength=len(names))
        total = _softplus(self.leak) + np.bincount(s.doc_of[names], weights=_softplus(z), minlength=n_docs)
        return np.where(s.counts > 0, -np.expm1(-total), 0.0), names, _sigmoid(z)


def _softplus(z):
    return np.logaddexp(0, z)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text and toxic of the documents that the fit uses."""
    d = F.col("doc_id").cast("long")
    marked = labels.select(d.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = texts_of(docs).select("doc_id").join(marked, "doc_id", "left_semi").distinct()  # labels without a document don't count
    chosen = labelled.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = scratch(chosen, "sample")
    # at most `rows` ids of 12 bytes: a proven bound
    return texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _vocabulary(sample: DataFrame, size: int, least: int) -> np.ndarray:
    """The hashes of the features with the most evidence of toxic documents, sorted."""

    def run(batches):
        for b in batches:
            marks = np.asarray(b.column("toxic")).astype(np.int64)
            for lo, hi, data, at in slices(b.column("text")):
                s = Sentences(data, at)
                feature, doc = _distinct(s.feature, s.doc_of[s.word_sentence[s.word]])
                names, place = np.unique(feature, return_inverse=True)
                toxic = marks[lo:hi][doc]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(place, weights=toxic, minlength=len(names)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(names)).astype(np.int64))], names=["feature", "toxic", "docs"])

    counts = sample.mapInArrow(lean(run), "feature long, toxic long, docs long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("docs").alias("n")).filter(F.col("n") >= least)
    sums = sample.agg(F.sum(F.col("toxic").cast("double")).alias("t"), F.count("*").cast("double").alias("all")).first()
    share = F.lit(sums.t / sums["all"])
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    evidence = term(a, n * share) + term(n - a, n * (1 - share))
    best = counts.filter(a > n * share).orderBy(evidence.desc(), "feature").select("feature").limit(size).collect()  # `size` hashes
    return np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))


def _bags(sample: DataFrame, vocabulary: np.ndarray):
    """(toxic, how many sentences have the same features, these features) by document."""
    finder = Model(vocabulary, np.zeros(len(vocabulary)), 0.0, 0.0)

    def run(batches):
        for b in batches:
            marks = np.asarray(b.column("toxic")).astype(np.int64)
            for lo, hi, data, at in slices(b.column("text")):
                s = Sentences(data, at)
                sentence, feature = finder.hits(s)
                cut = np.flatnonzero(np.diff(sentence)) + 1
                groups: list[dict[bytes, int]] = [{} for _ in range(hi - lo)]
                if len(sentence):
                    for first, part in zip(np.concatenate([[0], cut]).tolist(), np.split(feature.astype(np.uint16), cut), strict=True):
                        doc = s.doc_of[sentence[first]]
                        key = part.tobytes()
                        groups[doc][key] = groups[doc].get(key, 0) + 1
                rows = list(zip(marks[lo:hi].tolist(), [list(g.values()) for g in groups], [list(g) for g in groups], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())))], names=["toxic", "times", "features"])

    return sample.mapInArrow(lean(run), "toxic long, times array<long>, features array<binary>").collect()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = VOCABULARY, least: int = MIN_DOCS, steps: int = STEPS) -> Model:
    """The model of the labelled documents that aren't held out."""
    if size > 1 << 16:
        raise ValueError("a vocabulary has 65,536 features at most")
    sample = scratch(training_sample(docs, labels, rows), "bags")
    sums = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    none = np.zeros(0, np.uint64)
    if sums.t in (0, sums.n):
        return Model(none, np.zeros(0), 0.0, np.inf if sums.t else -np.inf)
    vocabulary = _vocabulary(sample, size, least)
    bags = sorted(_bags(sample, vocabulary))  # in an order of their own, so that each run gives the same sums
    y = np.array([b.toxic for b in bags], float)
    doc = np.repeat(np.arange(len(bags)), [len(b.times) for b in bags])
    times = np.array([t for b in bags for t in b.times], float)
    held = [np.frombuffer(bytes(f), np.uint16) for b in bags for f in b.features]
    row = np.repeat(np.arange(len(held)), [len(f) for f in held])
    column = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    return Model(vocabulary, *_descend(y, doc, times, row, column, len(vocabulary), steps))


def _descend(y, doc, times, row, column, size, steps) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak: Adam on the mean cross entropy of the noisy-or, all documents at each step."""
    w = np.zeros(size + 2)  # the last two: bias and leak
    w[-2] = np.log(max(y.mean(), 1e-6) / max(1.0, times.sum() / len(y)))
    w[-1] = np.log(max(y.mean(), 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = len(y)
    for t in range(1, steps + 1):
        z = w[-2] + np.bincount(row, weights=w[column], minlength=len(doc))
        total = _softplus(w[-1]) + np.bincount(doc, weights=times * _softplus(z), minlength=n)
        # of -[y log(1 - exp(-total)) + (1 - y)(-total)] by total
        slope = (1 - y) - y / np.maximum(np.expm1(np.minimum(total, 500)), 1e-9)
        dz = slope[doc] * times * _sigmoid(z)
        g = np.concatenate([np.bincount(column, weights=dz[row], minlength=size), [dz.sum(), slope.sum() * _sigmoid(w[-1])]]) / n
        g[:-2] += DECAY * w[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-2], float(w[-2]), float(w[-1])


def scored(docs: DataFrame, model: Model, cut: float = CUT, sentence_cut: float = SENTENCE_CUT) -> DataFrame:
    """Of every document: doc_id, held_out, score, predicted, n_sentences, and the sentences that reach
    sentence_cut as start, end (UTF-8 bytes) and score in their order. Many weak
    sentences together can make a document toxic that has no such sentence."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            score, counts = np.zeros(n), np.zeros(n, np.int64)
            found: list[list[dict]] = [[] for _ in range(n)]
            for lo, hi, data, at in slices(b.column("text")):
                s = Sentences(data, at)
                score[lo:hi], sentences, each = model.scores(s, hi - lo)
                counts[lo:hi] = s.counts
                worst = np.flatnonzero(each >= sentence_cut)
                for k, p in zip(sentences[worst].tolist(), each[worst].tolist(), strict=True):
                    doc = int(s.doc_of[k])
                    found[lo + doc].append({"start": int(s.bounds[k] - at[doc]), "end": int(s.bounds[k + 1] - at[doc]), "score": p})
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array(counts), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"],
            )

    cols = texts_of(docs).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return cols.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,score:double>>")


def offending_sentences(docs: DataFrame, model: Model, sentence_cut: float = SENTENCE_CUT) -> DataFrame:
    """doc_id, start, end, score and text of every sentence that reaches sentence_cut."""
    names = ["doc_id", "start", "end", "score", "sentence"]

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for lo, _, data, at in slices(b.column("text")):
                s = Sentences(data, at)
                _, sentences, each = model.scores(s, len(at) - 1)
                for k, p in zip(sentences.tolist(), each.tolist(), strict=True):
                    if p >= sentence_cut:
                        doc, i, j = int(s.doc_of[k]), int(s.bounds[k]), int(s.bounds[k + 1])
                        out.append((b.column("doc_id")[lo + doc].as_py(), i - int(at[doc]), j - int(at[doc]), p, data[i:j].tobytes().decode().strip()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()))], names=names)

    return texts_of(docs).mapInArrow(lean(run), "doc_id long, start long, end long, score double, sentence string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document scored by a model of the labels that aren't held out."""
    return scored(docs, fit(docs, labels))
