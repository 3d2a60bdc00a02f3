"""Counterfactual-regularised toxicity classifier.

Logistic regression over the distinct hashed words, word pairs and word beginnings of a text
(ASCII punctuation around a word doesn't count). In labelled sentences that mention an identity
term, the term is swapped for each other term of its group; a penalty on the squared change of
the score keeps the mention itself from carrying weight, so that neutral mentions of a group
don't look toxic. Training takes at most `most` labelled texts (a documented bound).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import labelled_sample, with_columns, written
from terrascape.llm.quality import Ftrl, averaged, packed
from terrascape.llm.textops import Texts, mix, spans_hashed, windows

BUCKETS = 1 << 20
#: Weight of a toxic text in training: of the two, they are the rarer.
POSITIVE = 3.0
#: Gradient that a bucket has to gather before it weighs anything; the same for any number of texts.
L1 = 5.0
MOST_LABELLED = 12_000
#: Bytes of sentences whose swaps are worked out at once.
SWAPPED_BYTES = 1 << 18
#: Lengths in bytes of the word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Groups of identity terms that may stand for each other.
IDENTITY_GROUPS = (
    ("he", "she", "they"), ("him", "her", "them"), ("his", "hers", "theirs"),
    ("man", "woman", "person"), ("men", "women", "people"), ("boy", "girl", "child"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("american", "mexican", "chinese", "indian", "african", "european"),
    ("mann", "frau"), ("männer", "frauen"), ("homme", "femme"), ("hommes", "femmes"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("il", "elle"), ("él", "ella"), ("er", "sie"),
)

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def occurrences(texts: list[bytes | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each feature's occurrences, a family at a time."""
    words = Texts(texts).words()
    # punctuation around a word goes; of one that is nothing else its middle stays
    said = np.append(np.flatnonzero(~_PUNCTUATION[words.buf]), len(words.buf))
    start = said[np.searchsorted(said, words.start)]
    end = said[np.maximum(np.searchsorted(said, words.end) - 1, 0)] + 1
    none = start >= words.end
    middle = (words.start + words.end - 1) // 2
    start, end = np.where(none, middle, start), np.where(none, middle + 1, end)
    mask = np.uint64(buckets - 1)

    def bucket(h: np.ndarray, salt: int) -> np.ndarray:
        return ((mix(h + np.uint64(salt)) >> np.uint64(20)) & mask).astype(np.int32)

    whole = spans_hashed(words.buf, start, end)
    yield words.text, bucket(whole, 1)
    pair = windows(whole, 2)
    same = words.text[: len(pair)] == words.text[1 : 1 + len(pair)]
    yield words.text[: len(pair)][same], bucket(pair[same], 2)
    for n in BEGINNINGS:
        longer = end - start > n
        yield words.text[longer], bucket(spans_hashed(words.buf, start[longer], start[longer] + n), n)


def distinct(found: Iterable[tuple[np.ndarray, np.ndarray]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([text * np.int64(buckets) + index for text, index in found]))
    return key // buckets, (key % buckets).astype(np.int32)


def scores(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text; an empty text has the bias alone."""
    counts = weights != 0
    text, index = distinct(((t[k], i[k]) for t, i in occurrences(texts, len(weights)) for k in [counts[i]]), len(weights))
    z = bias + np.bincount(text, weights[index], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sparse(texts: list[bytes | None], buckets: int) -> list[np.ndarray]:
    """Each text's distinct buckets, the last of which is the bias."""
    text, index = distinct(occurrences(texts, buckets), buckets)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [np.append(index[a:b], np.int32(buckets)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def swaps(text: bytes | None, groups=IDENTITY_GROUPS) -> Iterator[tuple[bytes, bytes]]:
    """Each mention of an identity term in the text: its sentence, and the sentence with another term of the group there, for every other."""
    others = {a: [b for b in group if b != a] for group in groups for a in group}
    term = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, others), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    for sentence in re.split(r"(?<=[.!?])\s+|\n", (text or b"").decode("utf-8", "replace")):
        for m in term.finditer(sentence):
            for other in others[m[1].lower()]:
                yield sentence.encode(), (sentence[: m.start()] + other + sentence[m.end() :]).encode()


def swapped(texts: list[bytes | None], groups=IDENTITY_GROUPS) -> list[tuple[bytes, bytes]]:
    return [pair for text in texts for pair in swaps(text, groups)]


def changes(texts: list[bytes | None], buckets: int, groups=IDENTITY_GROUPS) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Per text, for each of its swaps: the buckets that only the sentence has, and those that only its swapped form has."""
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    each = ((i, pair) for i, text in enumerate(texts) for pair in swaps(text, groups))
    held: list[tuple[int, tuple[bytes, bytes]]] = []

    def settle() -> None:
        for (i, _), a, b in zip(held, *(sparse([pair[side] for _, pair in held], buckets) for side in (0, 1)), strict=True):
            out[i][0].append(np.setdiff1d(a, b))
            out[i][1].append(np.setdiff1d(b, a))
        held.clear()

    size = 0
    for one in each:
        held.append(one)
        size += len(one[1][0])
        if size >= SWAPPED_BYTES:
            settle()
            size = 0
    if held:
        settle()
    return out


def fit(rows: list[tuple[np.ndarray, int]], pairs: list[tuple[np.ndarray, np.ndarray]], buckets: int, state: Ftrl | None = None, epochs: int = 3, penalty: float = 0.5, shares: list[float] | None = None) -> Ftrl:
    """Passes over (buckets, label) rows and, spread between them, over all pairs: the buckets of sentences and of their swapped forms; shares: weights of the pairs."""
    model = state or Ftrl(buckets, alpha=1.0, l1=L1, l2=0.01)
    steps = []
    for a, b in pairs:
        at = np.setxor1d(a, b)
        steps.append((at, np.where(np.isin(at, a), 1.0, -1.0)))
    for _ in range(epochs):
        for i, (at, y) in enumerate(rows):
            model.step(at, np.ones(len(at)), y, POSITIVE if y else 1.0)
            for k in range(i * len(steps) // len(rows), (i + 1) * len(steps) // len(rows)):
                at, sign = steps[k]
                w = model.weights(at)
                change = float(np.clip(w @ sign, -4, 4))
                model.add(at, w, penalty * 2 * change * (1.0 if shares is None else shares[k]) * sign)
    return model


def trained(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, buckets: int = BUCKETS, groups=IDENTITY_GROUPS) -> tuple[np.ndarray, float]:
    """Weights and bias, learned from at most `most` rows of labels(doc_id, toxic) that aren't held out.

    The swapped sentences are those of all identity mentions of the same texts; each pair is a row
    of its own, and the pairs of a text share the weight of one. Without a labelled text the
    weights are 0 and every score is 0.5.
    """
    sample = documents.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, "toxic", most)), "doc_id")

    def extract(texts: list[bytes | None]):
        found = changes(texts, buckets, groups)
        return sparse(texts, buckets), *([one[side] for one in found] for side in (0, 1))

    rows = written(with_columns(sample, "at array<int>, said array<array<int>>, other array<array<int>>", extract).drop("text"), "toxicity-sample")
    pairs = rows.select("doc_id", (1 / F.size("said")).alias("share"), F.posexplode(F.arrays_zip("said", "other")).alias("place", "pair"))
    pairs = pairs.select(F.pmod(F.xxhash64("doc_id", "place"), F.lit(1 << 16)).alias("deal"), "doc_id", "place", "share", "pair.said", "pair.other")
    both = rows.select(F.xxhash64("doc_id").alias("deal"), "doc_id", "label", "at").unionByName(pairs, allowMissingColumns=True)
    return averaged(both, lambda batches: learned(batches, buckets), buckets)


def learned(batches: Iterator[pa.RecordBatch], buckets: int) -> tuple[Ftrl, int]:
    """The model of a shard, and its number of texts: rows (doc_id, label, at), and swaps (deal, doc_id, place, share, said, other) without a label."""
    texts, pairs, df = [], [], np.zeros(buckets + 1, np.int64)
    for batch in batches:
        of_texts = pc.is_valid(batch.column("label"))
        rows, swaps = batch.filter(of_texts), batch.filter(pc.invert(of_texts))
        at = packed(rows.column("at"))
        for a in at:
            df[a] += 1
        texts += zip(rows.column("doc_id").to_pylist(), at, rows.column("label").to_pylist(), strict=True)
        order = zip(*(swaps.column(c).to_pylist() for c in ("deal", "doc_id", "place")), strict=True)
        pairs += zip(order, packed(swaps.column("said")), packed(swaps.column("other")), swaps.column("share").to_pylist(), strict=True)
    texts.sort(key=lambda row: row[0])
    # in the order of their hashes, so that those of one text don't come together
    pairs.sort(key=lambda row: row[0])
    rows = [(a[df[a] > 1], y) for _, a, y in texts]
    del texts, df
    return fit(rows, [(a, b) for _, a, b, _ in pairs], buckets, shares=[share for *_, share in pairs]), len(rows)


def classify(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """documents with score double (0 to 1, higher: toxic likelier) and predicted int (1 if score >= threshold).

    A null or empty text is scored by the bias alone; equal texts score alike; rows are neither
    dropped nor merged, whatever doc_id holds; columns named score or predicted are replaced.
    """
    weights = documents.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes | None]):
        score = scores(texts, *weights.value)
        return score, (score >= threshold).astype(np.int32)

    return with_columns(documents, "score double, predicted int", compute)
