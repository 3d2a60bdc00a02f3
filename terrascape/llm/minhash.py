"""Document fingerprints by MinHash.

A signature holds, for each of 128 universal hash permutations, the least value over a text's
word shingles, computed in vectorised numpy; 16 bits of each are kept. Fingerprints compare by
the share of equal places. Near duplicates are found by bands of the signature, joined in
Spark, and verified by their exact Jaccard similarity.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import in_small_batches, slices, with_columns
from terrascape.llm.prefixjoin import set_key, verified_classes
from terrascape.llm.textops import Texts, mix, shingle_sets, windows

PERMUTATIONS = 128
SHINGLE = 5
BANDS = 32
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
#: Shingles that are permuted at once.
_SLICE = 1 << 15


def signatures(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """A row of 128 16-bit places a text; a text of fewer than k words has one shingle, a text without words a row of zeros."""
    words = Texts(texts).words()
    h = words.hashes()
    w = windows(h, k)
    out = np.zeros((len(texts), PERMUTATIONS), np.uint16)
    long = words.count >= k
    for i in np.flatnonzero(~long & (words.count > 0)):
        n = int(words.count[i])
        one = windows(h[words.first[i] : words.first[i] + n], n)
        out[i] = (mix(one[:1] * _A + _B) >> np.uint64(48)).astype(np.uint16)
    rows = np.flatnonzero(long)
    first, count = words.first[:-1][rows], words.count[rows] - k + 1
    i = 0
    while i < len(rows):
        j = i + 1
        total = int(count[i])
        while j < len(rows) and total + count[j] <= _SLICE:
            total += int(count[j])
            j += 1
        ends = np.cumsum(count[i:j])
        at = np.arange(total) + np.repeat(first[i:j] - (ends - count[i:j]), count[i:j])
        inside, starts = w[at], ends - count[i:j]
        for p in range(PERMUTATIONS):
            least = np.minimum.reduceat(inside * _A[p] + _B[p], starts)
            out[rows[i:j], p] = (mix(least) >> np.uint64(48)).astype(np.uint16)
        i = j
    return out


def encoded(signature: np.ndarray, empty: np.ndarray) -> list[str]:
    """Fingerprint strings; '' for a text without words."""
    return ["" if e else base64.b64encode(row.astype("<u2").tobytes()).decode() for row, e in zip(signature, empty, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row; of texts without words, 1 to each other and 0 to others."""
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), (a == b).mean(axis=1))


def _wordless(texts: list[bytes | None]) -> np.ndarray:
    return np.array([not (t or b"").strip(b" \t\n\x0b\x0c\r") for t in texts], bool)


def fingerprints(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """documents with a column fingerprint (replaced if there); null and empty texts have ''; equal texts have equal ones."""
    return with_columns(documents, "fingerprint string", lambda texts: [encoded(signatures(texts, k), _wordless(texts))])


def _bounds(documents: DataFrame, buckets: int) -> list[int]:
    """doc_ids that cut the documents into about equal parts: at most `buckets` of them."""
    found = documents.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return sorted({int(x) for x in found})


def _place(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most value, by halving."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    sorted_bounds = F.array(*map(F.lit, bounds)).cast("array<long>")
    at = lambda n, step: F.when((n + step <= len(bounds)) & (F.get(sorted_bounds, n + step - 1) <= value), n + step).otherwise(n)
    return F.aggregate(steps, F.lit(0), at)


def edited_neighbours(documents: DataFrame, k: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next document.

    The next document has the next smaller doc_id; after the smallest comes the greatest. The
    edited text is the document's with its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Rows of one doc_id follow each other in the order of their texts'
    hashes, a null doc_id comes after all others; a table of one row is its own next.
    Documents are cut into ranges of doc_id, those without one into ranges of their texts' hashes;
    the first row of each range goes to the range before too, so that every text moves once and is
    read as a stream.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # those without a doc_id have the buckets below 0, from -1 down as their hashes rise
    nulls = -1 - F.floor((F.shiftright("tie", 32) + (1 << 31)) * buckets / (1 << 32))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), nulls).otherwise(_place(_bounds(rows, buckets), F.col("doc_id"))).cast("int"))
    # the first row of each range, by the complement of its doc_id and its hash: at most 2 * buckets rows
    heads = sorted((r.bucket, r.m.less, r.m.tie) for r in rows.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("less"), "tie")).alias("m")).collect())
    # its text follows the last one of the range above, or, from the top, of the lowest range
    before = {head[0]: heads[(i + 1) % len(heads)][0] for i, head in enumerate(heads)}
    place = lambda b, guard: F.struct(b.cast("int").alias("bucket"), F.lit(guard).alias("guard"))
    own = place(F.col("bucket"), 0)
    if heads:
        # rows that look like a head and aren't come after it in its range, and are passed over there
        ids = [~less for _, less, _ in heads if less is not None]
        is_head = F.col("tie").isin([tie for *_, tie in heads]) & (F.col("doc_id").isNull() | (F.col("doc_id").isin(ids) if ids else F.lit(False)))
        to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket"))
        rows = rows.select("doc_id", "text", "tie", F.explode(F.when(is_head, F.array(own, place(to, 1))).otherwise(F.array(own))).alias("at"))
    else:
        rows = rows.select("doc_id", "text", "tie", own.alias("at"))
    rows = rows.select("doc_id", "text", "at.bucket", "at.guard", "tie")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "guard", F.desc_nulls_last("doc_id"), "tie")

    def compute(ids: list, texts: list[bytes], following: list[bytes]) -> pa.RecordBatch:
        said, then = [t.decode("utf-8", "replace") for t in texts], [t.decode("utf-8", "replace") for t in following]
        edited = [(s[: len(s) - len(s) // 2] + n[: len(s) // 2]).encode() for s, n in zip(said, then, strict=True)]
        # the batch's own texts, and the one that follows it
        sig, none = signatures([*texts, following[-1]], k), _wordless([*texts, following[-1]])
        same = [i + 1 < len(texts) and following[i] is texts[i + 1] for i in range(len(texts))]
        if all(same[:-1]):
            after, none_after = sig[1:], none[1:]
        else:  # a range of doc_ids ends inside the batch
            after, none_after = signatures(following, k), _wordless(following)
        sig, none = sig[:-1], none[:-1]
        changed, none_changed = signatures(edited, k), _wordless(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in said], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(encoded(sig, none), pa.string()),
                pa.array(encoded(changed, none_changed), pa.string()),
                pa.array(likeness(sig, changed, none, none_changed)),
                pa.array(likeness(sig, after, none, none_after)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        following: list[bytes] = []
        last = None  # (bucket, doc_id, text) whose next row hasn't come yet
        for batch, found in slices(batches):
            for b, guard, doc, text in zip(batch.column("bucket").to_pylist(), batch.column("guard").to_pylist(), batch.column("doc_id").to_pylist(), found, strict=True):
                text = text or b""
                if last and last[0] == b:
                    ids.append(last[1])
                    texts.append(last[2])
                    following.append(text)
                    last = None
                if not guard:
                    last = (b, doc, text)
            if ids:
                yield compute(ids, texts, following)
                ids, texts, following = [], [], []

    return in_small_batches(rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def band_links(documents: DataFrame, k: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """(a, b) keys of texts that agree in a band of their signatures: each with the least key there, so that no band's pairs are spread out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            keep = np.flatnonzero(~_wordless(texts))
            if not len(keep):
                continue
            texts = [texts[i] for i in keep]
            key = np.array([set_key(s)[0] for s in shingle_sets(Texts(texts).words(), k)], np.int64)
            sig = signatures(texts, k).reshape(len(texts), bands, -1)
            parts = np.ascontiguousarray(sig).view(np.uint16).astype(np.uint64)
            h = np.zeros((len(texts), bands), np.uint64)
            for i in range(parts.shape[2]):
                h = mix(h * np.uint64(31) + parts[:, :, i] + np.uint64(1))
            h = mix(h + np.arange(bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(key, bands))], names=["band", "key"])

    rows = in_small_batches(documents).select("text").mapInArrow(run, "band long, key long").distinct()
    least = rows.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, "band").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()


def near_duplicates(documents: DataFrame, k: int = SHINGLE, threshold: str = "0.8", bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id: what texts are joined by links that the bands propose and whose Jaccard similarity is verified.

    Bands propose the groups, whole sets decide within them. Null and empty texts are linked with
    nothing; equal texts share a class; an empty table gives no rows.
    """
    return verified_classes(documents, k, threshold, band_links(documents, k, bands)).select("doc_id", "n_shingles", "component_id")
