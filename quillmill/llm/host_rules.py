"""Quality rules with a verdict for each host.

Every document is measured on its whole text. Rule failures are counted by host, each host's rate
is shrunk towards an empirical beta prior (fitted to all hosts by the method of moments), and the
host verdicts are joined back to the documents.

Defined cases: a null or empty text has no words and fails; a null source is a host of its own, the
empty string; repeated rows and ids each keep their row; an empty table gives an empty result; other
columns, whatever their names, are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, Words, grams, mix, prefix_sums, slices, span_hashes, _LETTERS
from .common import lean, scratch, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is over this.
MAX_HOST_RATE = 0.5
#: Limits of the prior's weight, in documents.
MIN_WEIGHT, MAX_WEIGHT = 1.0, 1000.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(key: np.ndarray) -> np.ndarray:
    """For each entry, how many entries hold the same value."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    out = np.empty(len(s), np.int64)
    out[order] = np.bincount(group, minlength=1)[group] if len(s) else 0
    return out


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The five measures of each text of an Arrow array of strings."""
    out = {m: np.zeros(len(text), np.int64) for m in MEASURES}
    for lo, hi, data, at in slices(text):
        w = Words(data, at)
        n = hi - lo
        per = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[at])
        out["n_words"][lo:hi] = w.counts
        out["word_chars"][lo:hi] = per(~SPACE[data] & ((data & 0xC0) != 0x80))
        out["n_symbols"][lo:hi] = per(_SYMBOL[data])
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        h = w.hashes()
        g = grams(h, 3)
        inside = w.doc[: len(g)] == w.doc[2:] if len(g) else np.zeros(0, bool)
        at3 = np.flatnonzero(inside)
        twice = at3[_repeated(mix(g[at3] ^ salt[w.doc[at3]])) > 1]
        covered = np.zeros(len(h) + 2, bool)
        for j in range(3):
            covered[twice + j] = True
        out["n_repeat_words"][lo:hi] = np.bincount(w.doc[covered[: len(h)]], minlength=n)
        breaks = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
        start = start[start < len(data)]
        stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], at[np.searchsorted(at, start, "right")])
        worded = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
        start, stop = start[worded], stop[worded]
        doc = np.searchsorted(at, start, "right") - 1
        key = mix(span_hashes(w.sums, start, stop) ^ salt[doc])
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(key), bool)
        later[first] = False
        out["n_dup_lines"][lo:hi] = np.bincount(doc[later], minlength=n)
    return out


def fails(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def host_of(source: Column) -> Column:
    """The host of a URL, in lower case; any other source stands for itself."""
    s = F.lower(F.coalesce(source.cast("string"), F.lit("")))
    return F.when(s.contains("://"), F.regexp_extract(s, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)).otherwise(s)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, the five measures and base_failed of every document."""

    def run(batches):
        for b in batches:
            m = measure(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("host"), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(fails(m), pa.bool_())],
                names=["doc_id", "host", *MEASURES, "base_failed"],
            )

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), host_of(F.col("source")).alias("host"))
    return cut.mapInArrow(lean(run), "doc_id long, host string, " + ", ".join(f"{k} long" for k in MEASURES) + ", base_failed boolean")


def host_verdicts(failures: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate and host_ok from rows of host and base_failed."""
    hosts = failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"))
    weight = F.when(F.col("spread") <= 0, F.lit(MAX_WEIGHT)).otherwise(F.least(F.lit(MAX_WEIGHT), F.greatest(F.lit(MIN_WEIGHT), F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1)))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    prior = prior.select("mean", weight.alias("weight"))
    # the prior is one row by construction (an aggregate without keys)
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= MAX_HOST_RATE).alias("host_ok"))


def judged(docs: DataFrame) -> DataFrame:
    """The measures, base_failed and kept of every document."""
    m = scratch(measured(docs), "measures")
    hosts = scratch(host_verdicts(m), "hosts")  # as a table its size is known: joined by broadcast only if small
    return m.join(hosts.select("host", "host_ok", "shrunk_rate"), "host", "left").select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).alias("kept"), "host", "shrunk_rate"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that no rule and no host verdict rejects."""
    hosts = scratch(host_verdicts(measured(docs).select("host", "base_failed")), "hosts")
    bad = hosts.filter(~F.col("host_ok")).select(F.col("host").alias("_quillmill_host"))
    names = docs.columns

    def run(batches):
        for b in batches:
            bad_rows = fails(measure(b.column("_quillmill_text")))
            yield b.drop_columns(["_quillmill_text"]).filter(pa.array(~bad_rows))

    tagged = docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_quillmill_text"), host_of(F.col("source")).alias("_quillmill_host"))
    schema = tagged.drop("_quillmill_text").schema
    return tagged.mapInArrow(lean(run), schema).join(bad, "_quillmill_host", "left_anti").select(*names)
