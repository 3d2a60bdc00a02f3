"""Quality rules: base rules on words and lines, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed words and word pairs: one of the raw corpus, counted over every
document, and one of the trusted target, counted over every text labelled as good. A text's
ratio is the sum of log(target / raw) over its n-grams, divided by their number; a text below
the threshold isn't kept, always alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import in_small_batches, slices, with_columns
from terrascape.llm.textops import SPACE, Texts, mix, span_hash, prefix_sums, windows

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Least log-likelihood ratio for each n-gram of a text that is kept.
THRESHOLD = -0.05

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ngrams(words, h: np.ndarray, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each word and of each word pair."""
    mask = np.uint64(buckets - 1)
    out = [((mix(h + np.uint64(1)) >> np.uint64(20)) & mask, words.text)]
    pair = windows(h, 2)
    same = words.text[: len(pair)] == words.text[1 : 1 + len(pair)]
    out.append(((mix(pair + np.uint64(2)) >> np.uint64(20)) & mask, words.text[: len(pair)]))
    out[1] = (out[1][0][same], out[1][1][same])
    return [(i.astype(np.int32), t) for i, t in out]


def repeated_window_words(words, h: np.ndarray, k: int = 8) -> np.ndarray:
    """Words of each text in k-word windows that occur in it twice or more."""
    w = windows(h, k)
    if not len(w):
        return np.zeros(words.texts.n, np.int64)
    inside = words.text[: len(w)] == words.text[k - 1 :]
    at = np.flatnonzero(inside)
    key = mix(w[at] ^ mix(words.text[at].astype(np.uint64)))
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    return np.bincount(words.text, np.cumsum(cover[:-1]) > 0, words.texts.n).astype(np.int64)


def repeated_lines(texts: Texts) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    end = np.flatnonzero(texts.buf == 10)
    start = np.append(0, end[:-1] + 1)
    worded = np.zeros(len(texts.buf) + 1, np.int64)
    np.cumsum(~SPACE[texts.buf], out=worded[1:])
    real = worded[end] > worded[start]
    start, end = start[real], end[real]
    text = np.searchsorted(texts.at, start, "right") - 1
    s = prefix_sums(texts.buf)
    key = mix(span_hash(s, start, end) ^ mix(text.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(text[again], minlength=texts.n).astype(np.int64)


def base(texts: Texts, words, h: np.ndarray) -> dict[str, np.ndarray]:
    n_words, repeat = words.count.astype(np.int64), repeated_window_words(words, h)
    return {
        "n_words": n_words,
        "word_chars": texts.per_text(~SPACE[texts.buf] & ((texts.buf & 0xC0) != 0x80)),
        "n_symbols": texts.per_text(_SYMBOL[texts.buf]),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeat,
        "base_failed": (n_words < 20) | (100 * repeat > 30 * n_words),
    }


def trusted_texts(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """The texts of log_ratios()'s target.

    Texts meet their ids in one shuffle at every size: ids are hashed, so texts aren't sorted, and
    neither broadcast, as they grow with the labels. Rows that aren't `learnable` stay out of it.
    """
    may = F.col("learnable") if "learnable" in documents.columns else F.lit(True)
    return documents.where(may).select("doc_id", "text").join(trusted.select("doc_id").hint("shuffle_hash"), "doc_id").select("text")


def counted(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams of all texts each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets)
        for _, some in slices(batches):
            words = Texts(some).words()
            for index, _ in ngrams(words, words.hashes(), buckets):
                n += np.bincount(index, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(n)], names=["bucket", "n"])

    counts = in_small_batches(texts).mapInArrow(run, "bucket int, n double").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(buckets)
    n[counts["bucket"]] = counts["n"]
    return n


def log_ratios(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket; raw counts every document, the target every one whose doc_id is in `trusted`, which has each doc_id once.

    A boolean column `learnable` of documents, if there is one, is true wherever `trusted` may have
    the doc_id; a row where it is not true is out of the target.
    """
    target = counted(trusted_texts(documents, trusted), buckets)
    if not target.sum():
        return np.zeros(buckets)
    raw = counted(documents.select("text"), buckets)
    return np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * buckets)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets))


def judged(documents: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean.

    A null text counts as empty: no words, base_failed. Equal texts are judged alike, and each row
    is judged, whatever doc_id holds; columns by these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(ratios)

    def compute(texts: list[bytes | None]):
        held = Texts(texts)
        words = held.words(lower=False)
        h = words.hashes()
        facts = base(held, words, h)
        found = ngrams(words, held.words().hashes(), len(shared.value))
        total = sum(np.bincount(text, shared.value[index], held.n) for index, text in found)
        ratio = total / np.maximum(1, sum(np.bincount(text, minlength=held.n) for _, text in found))
        return *facts.values(), ratio, ~facts["base_failed"] & (ratio >= threshold)

    return with_columns(documents, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean", compute)
