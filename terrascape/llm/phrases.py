"""Phrase collocations: candidates from a sketch, exact counts by automata over shards, then thresholds.

Texts are brought to one form: a space around each word, a line feed after each piece. They go
into shards of one language and bounded bytes. Each shard hashes its n-grams into the columns of a
count-min sketch of one row, whose width grows with the corpus; the sketch is kept sparse and cut
in ranges of columns, so no task or driver holds it whole. A range adds up what all shards have
in its columns, which bounds the counts from above, and tells each shard which of its columns reach
the threshold. The shard compiles the n-grams in these into automata over one or two signs a word,
each n-gram guarded by the kinds of its signs, counts all matches, overlaps included, and the counts of shards are added up. An
n-gram that is frequent in the whole is a candidate in every shard that holds it, so counts are
exact, whatever falls together in the sketch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascape.llm.common import in_small_batches, slices, written
from terrascape.llm.textops import LOWER, Texts, mix, spans_hashed, windows

#: Bytes from which a shard is closed, and of the rows that it is stored in (more where one piece has more).
SHARD_BYTES, ROW_BYTES = 6 << 20, 256 << 10
#: Bytes that a task holds open over all languages.
OPEN_BYTES = 24 << 20
#: Entries that a range of the sketch should have.
RANGE_ENTRIES = 1_000_000
#: Columns of the sketch for each n-gram counted, as a power of two.
SPARE_BITS = 1
#: Phrases of one automaton; a shard with more has several.
MOST_PHRASES = 600_000
#: Words of a shard that have a sign of their own, and signs that end others, at least.
SHORT_WORDS, LEAST_SIDE = 128, 128

#: Shares of a language's phrases that are ranked apart.
RANKED_APART = 32

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x09]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


def normal(texts: list[bytes | None]) -> tuple[bytes, int]:
    """The pieces of texts, as ` word word ` and a line feed each, A-Z lower-cased; and the number of words."""
    buf = LOWER[Texts(texts).buf]
    word = ~(_BETWEEN | _ENDS)[buf]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return b"", 0
    ends = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_ENDS[buf], out=ends[1:])
    new = np.ones(len(start), bool)
    new[1:] = ends[start[1:]] > ends[end[:-1]]
    length = end - start
    # a space before each word; before a new piece also what ends the last one
    at = np.cumsum(np.where(new, 3, 1) + np.concatenate([[0], length[:-1]]))
    out = np.full(int(at[-1] + length[-1]) + 2, 0x20, np.uint8)
    out[at[new] - 2] = 0x0A
    out[-1] = 0x0A
    out[np.repeat(at - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))] = buf[word]
    return out[2:].tobytes(), len(start)


def shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, n_words, body) of docs(lang, text), written: normal() of texts of one language, in rows of about ROW_BYTES, compressed; n_words is on a shard's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[bytes], int, int]] = {}
        number = TaskContext.get().partitionId() << 32

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            parts, _, n = held.pop(lang)
            body, i, rows = b"".join(parts), 0, []
            while i < len(body):
                j = body.find(b"\n", i + ROW_BYTES) + 1 or len(body)
                rows.append(squeezed(body[i:j]))
                i = j
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([lang] * len(rows)), pa.array([n, *[0] * (len(rows) - 1)], pa.int64()), pa.array(rows, pa.binary())], names=["shard", "lang", "n_words", "body"])

        for batch, texts in slices(batches):
            by_lang: dict[str, list[bytes | None]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                body, n = normal(some)
                if n:
                    parts, size, words = held.get(lang, ([], 0, 0))
                    held[lang] = [*parts, body], size + len(body), words + n
                    if size + len(body) >= SHARD_BYTES:
                        yield closed(lang)
            if sum(x[1] for x in held.values()) >= OPEN_BYTES:
                yield from map(closed, list(held))
        yield from map(closed, list(held))

    rows = in_small_batches(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))
    return written(rows.mapInArrow(run, "shard long, lang string, n_words long, body binary"), "phrase-shards", **{"parquet.block.size": 16 << 20})


class Grams:
    """The n-grams of a shard's body: byte spans of words, and hashes of the runs of 1 to `most` words that lie within pieces."""

    def __init__(self, lang: str, body: bytes, most: int):
        buf = np.frombuffer(body, np.uint8)
        edge = np.flatnonzero(np.diff((buf != 0x20) & (buf != 0x0A), prepend=False, append=False))
        self.body, self.start, self.end = body, edge[::2], edge[1::2]
        salt = np.frombuffer(hashlib.sha256(lang.encode()).digest()[:8], np.uint64)
        h = mix(spans_hashed(buf, self.start, self.end) ^ salt)
        self.piece = piece = np.searchsorted(np.flatnonzero(buf == 0x0A), self.start)
        #: by k: the first words of runs of k, and their hashes
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, most + 1):
            whole = np.flatnonzero(piece[: len(piece) - k + 1] == piece[k - 1 :]) if len(piece) >= k else np.empty(0, np.int64)
            self.runs[k] = whole, windows(h, k)[whole] if len(whole) else np.empty(0, np.uint64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def loosened(blob: bytes) -> bytes:
    return pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)


def packed(columns: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending columns as the bytes of their steps, low ones first, and counts up to 255; compressed."""
    steps = np.diff(columns, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return squeezed(len(columns).to_bytes(4, "little") + steps + (b"" if counts is None else np.minimum(counts, 255).astype(np.uint8).tobytes()))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = loosened(blob)
    n = int.from_bytes(data[:4], "little")
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 4).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(data, np.uint8, offset=4 + 8 * n).astype(np.int64)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
    """(shard, lang, body) of neighbouring rows of one shard."""
    at, lang, parts = None, "", []
    for batch in batches:
        for shard, name, body in zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if shard != at:
                if parts:
                    yield at, lang, b"".join(parts)
                at, lang, parts = shard, name, []
            parts.append(loosened(body))
    if parts:
        yield at, lang, b"".join(parts)


def candidates(bodies: DataFrame, most: int, least: int, width: int, ranges: int) -> DataFrame:
    """(shard, columns): of the 2**width columns of the sketch those that n-grams of the shard fall in and whose total is `least` or more, a row a range."""
    cut = np.uint64(width - ranges)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, lang, body in by_shard(batches):
            column, count = np.unique(np.concatenate([h for _, h in Grams(lang, body, most).runs.values()]) >> np.uint64(64 - width), return_counts=True)
            at = (column >> cut).astype(np.int64)
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=1 << 40))
            blobs = [packed(column[i:j], count[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]], pa.int64()), pa.array([shard] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["range", "shard", "columns"])

    def total(table: pa.Table) -> pa.Table:
        found = [unpacked(b) for b in table.column("columns").to_pylist()]
        column, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        reach = (np.bincount(back, np.concatenate([n for _, n in found])) >= least)[back]
        edges = np.cumsum([0, *(len(c) for c, _ in found)])
        kept = [c[reach[i:j]] for (c, _), i, j in zip(found, edges[:-1], edges[1:], strict=True)]
        some = [i for i, c in enumerate(kept) if len(c)]
        return pa.table({"shard": table.column("shard").take(pa.array(some, pa.int64())), "columns": pa.array([packed(kept[i]) for i in some], pa.binary())})

    rows = in_small_batches(bodies.select("shard", "lang", "body")).mapInArrow(sketch, "range long, shard long, columns binary")
    return rows.groupBy("range").applyInArrow(total, "shard long, columns binary")


class Signs:
    """A shard's body as a string of one sign for a frequent word, two for any other and one for a line feed.

    Signs of frequent words, signs that begin others, signs that end these and the line feed's
    have none in common, so they guard a match at both ends as spaces do. Frequent words have low
    numbers: automata look through a node's children in the order in which they were added.
    """

    def __init__(self, grams: Grams):
        offsets = np.zeros(len(grams.start) + 1, np.int64)
        np.cumsum(grams.end - grams.start, out=offsets[1:])
        buf = np.frombuffer(grams.body, np.uint8)
        words = pa.Array.from_buffers(pa.large_binary(), len(grams.start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[(buf != 0x20) & (buf != 0x0A)])])
        word = words.dictionary_encode().indices.to_numpy()
        often = np.bincount(word)
        number = np.empty(len(often), np.int64)
        number[np.argsort(-often, kind="stable")] = np.arange(len(often))
        self.number = number[word]
        two = self.number >= SHORT_WORDS
        #: where each word's signs end and begin
        self.end = np.cumsum(1 + two) + grams.piece
        self.start = self.end - 1 - two
        # below the surrogates, as long as a shard has fewer than 2**28 words
        side = max(LEAST_SIDE, math.isqrt(len(often)) + 1)
        rest = self.number[two] - SHORT_WORDS
        signs = np.zeros(int(self.end[-1]) + 1, "<u2")
        signs[self.start[~two]] = 1 + self.number[~two]
        signs[self.end[two] - 1] = 1 + SHORT_WORDS + rest % side
        signs[self.start[two]] = 1 + SHORT_WORDS + side + rest // side
        self.text = signs.tobytes().decode("utf-16-le")

    def sorted(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The order of runs of words by their signs."""
        of = lambda j: np.where(first + j <= last, self.number[np.minimum(first + j, last)] + 1, 0)
        return np.lexsort([of(j) for j in range(int((last - first).max(initial=0)), -1, -1)])

    def runs(self, first: np.ndarray, last: np.ndarray) -> list[str]:
        return [self.text[i:j] for i, j in zip(self.start[first].tolist(), self.end[last].tolist(), strict=True)]


def matches(text: str, patterns: list[str]) -> np.ndarray:
    """How often each of the patterns occurs in text, overlaps included. Sorted ones are quicker to add."""
    import ahocorasick

    out = np.zeros(len(patterns), np.int64)
    for i in range(0, len(patterns), MOST_PHRASES):
        some = patterns[i : i + MOST_PHRASES]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for j, pattern in enumerate(some):
            automaton.add_word(pattern, j)
        automaton.make_automaton()
        out[i : i + len(some)] = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(some))
    return out


def counted(lang: str, body: bytes, passing: np.ndarray, most: int, width: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Phrases of the shard in passing columns, each byte as a sign, those of one beginning in a row; how often each occurs, and its hash."""
    grams = Grams(lang, body, most)
    signs = Signs(grams)

    def passes(h: np.ndarray) -> np.ndarray:
        column = h >> np.uint64(64 - width)
        return passing[np.minimum(np.searchsorted(passing, column), len(passing) - 1)] == column

    found, total = [], 0
    for k, (at, h) in grams.runs.items():
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
        hit = passes(h[order[head]])  # ascending, so quick to look up
        total += int(np.diff(head, append=len(h))[hit].sum())
        one = order[head[hit]]
        found.append((at[one], at[one] + k - 1, h[one]))
    first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = signs.sorted(first, last)
    first, last, h = first[order], last[order], h[order]
    n = matches(signs.text, signs.runs(first, last))
    if int(n.sum()) != total:  # two phrases of one hash: take each by its signs
        found = [(at[hit], at[hit] + k - 1, h[hit]) for k, (at, h) in grams.runs.items() for hit in [passes(h)]]
        first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
        one = np.array(list({run: i for i, run in enumerate(signs.runs(first, last))}.values()))
        one = one[signs.sorted(first[one], last[one])]
        first, last, h = first[one], last[one], h[one]
        n = matches(signs.text, signs.runs(first, last))
    text = body.decode("latin-1")
    return [text[i:j] for i, j in zip(grams.start[first].tolist(), grams.end[last].tolist(), strict=True)], n, h


def strings(blobs: list[bytes], lengths: list[bytes]) -> pa.Array:
    """Binary strings from what joins them and their lengths."""
    size = np.concatenate([np.frombuffer(loosened(b), np.int32) for b in lengths])
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(map(loosened, blobs)))])


def frequent(docs: DataFrame, most: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f): phrases of up to `most` words that occur `least` times or more; (lang, n): words of each language."""
    bodies = shards(docs)
    totals = bodies.groupBy("lang").agg(F.sum("n_words").alias("n"))
    grams = most * (bodies.agg(F.sum("n_words")).first()[0] or 0)
    ranges = max(4, (grams // RANGE_ENTRIES).bit_length())
    width = min(62, max(ranges + 8, grams.bit_length() + SPARE_BITS))
    names = {"range": pa.int64(), "lang": pa.string(), "phrases": pa.binary(), "lengths": pa.binary(), "counts": pa.binary()}

    def count(table: pa.Table) -> pa.Table:
        """The counts of a shard, compressed for each range of hashes: phrases of one beginning stand together."""
        blobs = [b for b in table.column("columns").to_pylist() if b is not None]
        here = table.filter(table.column("body").is_valid())
        if not blobs or not here.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        lang = here.column("lang")[0].as_py()
        passing = np.sort(np.concatenate([unpacked(b)[0] for b in blobs]))
        phrases, n, h = counted(lang, b"".join(map(loosened, here.column("body").to_pylist())), passing, most, width)
        at = (h >> np.uint64(64 - ranges)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, n, phrases = at[order], n[order], [phrases[i] for i in order.tolist()]
        size = np.array(list(map(len, phrases)), np.int32)
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=1 << 40)).tolist()
        rows = [(int(at[i]), lang, squeezed("".join(phrases[i:j]).encode("latin-1")), squeezed(size[i:j].tobytes()), squeezed(n[i:j].tobytes())) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(names.items(), zip(*rows, strict=True), strict=True)})

    def add(table: pa.Table) -> pa.Table:
        phrases, lengths, counts = (table.column(c).to_pylist() for c in ("phrases", "lengths", "counts"))
        n = [np.frombuffer(loosened(b), np.int64) for b in counts]
        langs = table.column("lang").take(pa.array(np.repeat(np.arange(len(n)), list(map(len, n)))))
        each = pa.table({"lang": langs, "phrase": strings(phrases, lengths), "n": np.concatenate(n)})
        total = each.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total.column("n_sum"), least))
        return pa.table({"lang": total.column("lang"), "phrase": total.column("phrase").cast(pa.binary()), "f": total.column("n_sum")})

    told = candidates(bodies, most, least, width, ranges).select("shard", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("body"), "columns")
    both = bodies.select("shard", "lang", "body", F.lit(None).cast("binary").alias("columns")).unionByName(told)
    found = both.groupBy("shard").applyInArrow(count, "range long, lang string, phrases binary, lengths binary, counts binary")
    summed = found.groupBy("range").applyInArrow(add, "lang string, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))
    return written(summed.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f"), "phrases"), totals


def collocations(docs: DataFrame, most: int = 3, least: int = 10, within: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language, of 2 to `most` words.

    docs: lang (null: `und`) and text (null or empty: no words); other columns are left out.
    Repeated rows count as often as they are there, long texts are shards of their own, and an
    empty table gives no rows. A phrase is left out where a longer one that holds it has at
    least `within` per cent of its occurrences. Of phrases alike in score and count the first by bytes counts.
    """
    counts, totals = frequent(docs, most, least)
    words = F.split("phrase", " ")
    several = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    # a <= l and a <= r, so the score fits a long; the products need not
    score = F.expr("CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # every shorter phrase of at least two words in a longer one, with the most occurrences of such
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    held = several.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * within))
    # the first of each share of a language, and of these the first of all: a task ranks RANKED_APART times `top` rows at most
    best = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    apart = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("place") <= top)
    first = apart.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
