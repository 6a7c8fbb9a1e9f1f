"""Token counts by the library, exact for texts of any length.

Huge texts are encoded as overlapping chunks with offsets. Two neighbouring chunks are spliced at a
boundary that both encodings have and that is proven stable: the two characters around it occur
side by side in no piece of the vocabulary, so no merge can ever cross it, whatever surrounds it,
and each side is encoded as if it stood alone. Where an overlap holds no such boundary it is
widened, up to the rest of the text.

Defined cases: null counts as the empty text, which has no tokens; repeated rows keep their rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, texts_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a chunk and of the first overlap; a text of up to CHUNK + OVERLAP is encoded whole.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: Stands before a chunk that does not begin its text, where the library would put a space of its
#: own: a character outside the vocabulary, which becomes byte pieces and merges with nothing.
_GUARD = "\x01"


@functools.cache
def tokenizer(model: str):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    return sp, inside


def stable(text: str, at: int, inside: set[str]) -> bool:
    """Whether no piece can cross position at of text."""
    return text[at - 1 : at + 1].replace(" ", "▁") not in inside


def _encoded(sp, text: str, start: int, end: int) -> list[int]:
    """The ends, in characters of the whole text, of the tokens of text[start:end]. A character
    that became several byte pieces has its end several times."""
    head = _GUARD if start else ""
    out, lead = [], 0
    surface = sp.encode(head + text[start:end], out_type="proto", num_threads=1).pieces
    at = start - len(head)
    for p in surface:
        at += len(p.surface)
        out.append(at)
    if head:  # the library's own space, and the guard, which end before or at start
        lead = sum(1 for e in out if e <= start)
    return out[lead:]


def count(text: str, model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of text."""
    sp, inside = tokenizer(model)
    if len(text) <= chunk + overlap:
        return len(sp.encode(text, num_threads=1))
    total, start, since = 0, 0, 0  # tokens up to `since` are counted; the chunk begins at start
    n = len(text)
    while True:
        width = overlap
        cut = start + chunk
        while True:
            end = min(n, cut + width)
            left = _encoded(sp, text, start, end)
            if end == n:
                return total + sum(1 for e in left if e > since) + (_silent(left, since))
            right = set(_encoded(sp, text, cut, min(n, end + width)))
            common = [e for e in sorted(set(left)) if max(cut, since) < e < end and e in right and stable(text, e, inside)]
            if common:
                break
            width *= 2
        splice = common[len(common) // 2]
        total += sum(1 for e in left if since < e <= splice) + _silent(left, since)
        since, start = splice, cut


def _silent(ends: list[int], since: int) -> int:
    """Tokens without characters of their own, before the first character of the text."""
    return sum(1 for e in ends if e == 0) if since == 0 else 0


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document."""

    def run(batches):
        sp, _ = tokenizer(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts = b.column("text").to_pylist()
                n = np.zeros(len(texts), np.int64)
                short = [i for i, t in enumerate(texts) if len(t) <= CHUNK + OVERLAP]
                for i, ids in zip(short, sp.encode([texts[i] for i in short], num_threads=1), strict=True):
                    n[i] = len(ids)
                for i, t in enumerate(texts):
                    if len(t) > CHUNK + OVERLAP:
                        n[i] = count(t, model)
                size = np.array([len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
