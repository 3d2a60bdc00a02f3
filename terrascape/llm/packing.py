"""Best-fit packing by a plan over the histogram of lengths.

Texts are tokenised in Python, each distinct piece of a batch once, and cut where they are
longer than a sequence. Best-fit decreasing runs on the driver over (length, count), at most
2048 rows; it gives, for ranges of ranks within a length, the sequences and offsets that they
take. Pieces then get their rank within their length and join the plan.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascape.llm.common import in_small_batches, slices, written
from terrascape.llm.textops import Texts, prefix_sums, span_hash

SEQUENCE = 2048
END = 0
#: Pieces of a length whose ranks are numbered together; a length with more has more lanes than the fewest.
LANE_ROWS, FEWEST_LANES = 200_000, 16
#: Distinct pieces whose ids a worker keeps.
KEPT_PIECES = 200_000
#: Bytes of text that are tokenised at once: what a worker has beside them is many times their size.
TOKENISED_BYTES = 1 << 19

#: Code points with the Unicode property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = range(5)


def _classes() -> np.ndarray:
    if not hasattr(_classes, "made"):
        kinds = {"L": _LETTER, "N": _NUMBER, "Cn": _UNKNOWN}
        names = (unicodedata.category(chr(c)) for c in range(0x110000))
        made = np.array([kinds.get(x) or kinds.get(x[0], _OTHER) for x in names], np.uint8)
        made[_WHITE] = _SPACE
        _classes.made = made
    return _classes.made


def _byte_of() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    if not hasattr(_byte_of, "made"):
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        _byte_of.made = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    return _byte_of.made


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the vocabulary's pre-tokens begin, as flags over code points; first: places at which texts begin.

    A pre-token is a run of letters, of numbers or of other signs with one space before it, an
    English contraction, or white space without the last character before such a run.
    """
    n = len(points)
    kind = _classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    run = np.ones(n + 1, bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= opens
    start = run.copy()
    # white space before a run in the same text: its last character stands alone or joins the run
    at = np.flatnonzero(run[:n] & (kind != _SPACE))
    at = at[(at > 0) & ~opens[at]]
    at = at[kind[at - 1] == _SPACE]
    start[at - 1] = True
    joined = points[at - 1] == 32
    start[at[joined]] = False
    # contractions: an apostrophe that is a run of its own and took no space
    at = np.flatnonzero((points == 39) & run[:n] & start[:n] & run[1:])
    at = at[at + 1 < n]
    at = at[~opens[at + 1] & (kind[at + 1] == _LETTER)]
    if len(at):
        a, b = points[at + 1], points[np.minimum(at + 2, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~opens[at + 2] & (at + 2 < n) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 3] = True
    return start[:n]


def _unassigned(text: bytes) -> bool:
    """Whether a text has a code point that Python's Unicode tables don't know, but the tokenizer's may."""
    if max(text, default=0) < 0xC2:
        return False
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return bool((_classes()[points] == _UNKNOWN).any())


class Tokens:
    """Token ids of whole texts; equal to those of the tokenizer's own encode without special tokens.

    Texts that hold a special token's string, or a code point unknown here, go through that encode.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        # the same merges by their ranks, which are the ids; much quicker for single pieces
        ranks = {bytes(_byte_of()[c] for c in token): i for token, i in self.encoder.get_vocab(with_added_tokens=False).items() if all(c in _byte_of() for c in token)}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks={k: ranks[k] for k in sorted(ranks, key=ranks.get) if ranks[k] < len(ranks)}, special_tokens={}).encode_ordinary
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.known: dict[int, bytes] = {}

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        parts = [t or b"" for t in texts]
        odd = {i for i, t in enumerate(parts) if any(s.encode() in t for s in self.special) or _unassigned(t)}
        plain = [b"" if i in odd else t for i, t in enumerate(parts)]
        out = self._plain(plain)
        for i in odd:
            out[i] = np.array(self.encoder.encode(parts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return out

    def _plain(self, parts: list[bytes]) -> list[np.ndarray]:
        joined = b"".join(parts)
        if not joined:
            return [np.empty(0, np.uint32) for _ in parts]
        buf = np.frombuffer(joined, np.uint8)
        points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        if len(byte_at) != len(points) + 1:  # not UTF-8: as the decoder replaces it
            return self._plain([p.decode("utf-8", "replace").encode() for p in parts])
        begins = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(list(map(len, parts)), out=begins[1:])
        first = np.searchsorted(byte_at, begins[:-1])
        start = byte_at[:-1][piece_starts(points, first[first < len(points)])]
        end = np.append(start[1:], len(buf))
        key, where, back = np.unique(span_hash(prefix_sums(buf), start, end), return_index=True, return_inverse=True)
        ids = [self.known.get(k) for k in key.tolist()]
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            if len(self.known) + len(new) > KEPT_PIECES:
                self.known.clear()
            strings = [joined[a:b].decode() for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)]
            for i, e in zip(new, map(self.merge, strings), strict=True):
                ids[i] = array("I", e).tobytes()
            self.known.update(zip(key[new].tolist(), (ids[i] for i in new), strict=True))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(size) - size
        count = size[back]
        total = np.cumsum(count)
        place = np.arange(int(total[-1])) - np.repeat(total - count, count) + np.repeat(begin[back], count)
        every = flat[place]
        cut = np.append(0, total)[np.searchsorted(start, begins)]
        return [every[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def token_pieces(documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long and, if asked, ids array<int>, of each document's ids and `end`.

    A null text counts as empty: its one piece is `end`. Documents longer than a sequence are cut
    into whole sequences; the rest, if any, comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for batch, texts in slices(batches, limit=TOKENISED_BYTES):
            docs = batch.column("doc_id").to_pylist()
            rows = []
            for doc, ids in zip(docs, tokens.of(texts), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % sequence or sequence, len(ids) + 1, sequence)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tolist() if with_ids else None))
            columns = list(zip(*rows, strict=True))[: 6 if with_ids else 5]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return in_small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, first sequence, ranks a sequence, offset).

    Each row fills sequences that are alike: rank first + i goes to sequence first + i // ranks a
    sequence, at offset + (i % ranks a sequence) * length. The rows grow with the number of
    distinct lengths, not of documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, how many)
    sequences, rows = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = min((r for r in room if r >= length), default=None)
            if fits is None:
                each = sequence // length
                many = -(-left // each)
                room[sequence] = [(sequences, many)]
                sequences += many
                continue
            begin, many = room[fits].pop()
            if not room[fits]:
                del room[fits]
            each = fits // length
            full = min(many, left // each)
            if full:
                rows.append((length, rank, full * each, begin, each, sequence - fits))
                rank, left = rank + full * each, left - full * each
                room.setdefault(fits - each * length, []).append((begin, full))
            if left and full < many:  # fewer are left than one sequence takes
                rows.append((length, rank, left, begin + full, each, sequence - fits))
                room.setdefault(fits - left * length, []).append((begin + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                room.setdefault(fits, []).append((begin + full, many - full))
        room.pop(0, None)
    return rows


def packed(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces with sequence_id long and offset long (columns by these names are replaced), in as few sequences as best fit finds.

    pieces: (doc_id, piece, start, length, ids_crc32) and what else there is, as written (it is read
    several times); each row is placed, also where doc_id and piece are null or repeated; of rows
    that tie in both, any comes first. No rows give no rows.
    """
    spark = pieces.sparkSession
    rows = pieces.drop("sequence_id", "offset", "_lane", "_lanes")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most as many rows as a sequence has tokens
    steps = plan(counts, sequence)
    table = spark.createDataFrame(steps or [(0, 0, 0, 0, 1, 0)], "_length long, _rank0 long, _ranks long, _sequence0 long, _each long, _offset0 long")
    table = F.broadcast(table) if len(steps) <= 500_000 else table
    cut = spark.createDataFrame([(n, max(FEWEST_LANES, -(-c // LANE_ROWS))) for n, c in counts.items()] or [(0, 1)], "length long, _lanes long")
    rows = rows.join(F.broadcast(cut), "length").withColumn("_lane", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("_lanes"))).drop("_lanes")
    # a row for each lane, so one for LANE_ROWS pieces and one for each length
    lanes = rows.groupBy("length", "_lane").agg(F.count("*").alias("_n"))
    lanes = written(lanes.withColumn("_begin", F.sum("_n").over(Window.partitionBy("length").orderBy("_lane")) - F.col("_n")).drop("_n"), "lanes")
    place = F.row_number().over(Window.partitionBy("length", "_lane").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("_place", place).join(lanes, ["length", "_lane"]).withColumn("_i", F.col("_begin") + F.col("_place") - 1)
    hit = (F.col("length") == F.col("_length")) & (F.col("_i") >= F.col("_rank0")) & (F.col("_i") < F.col("_rank0") + F.col("_ranks"))
    i = F.col("_i") - F.col("_rank0")
    out = ranked.join(table, hit).withColumns({"sequence_id": F.expr("_sequence0 + (_i - _rank0) div _each"), "offset": (F.col("_offset0") + i % F.col("_each") * F.col("length")).cast("long")})
    return out.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset")


def pack(documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(written(token_pieces(documents, tokenizer, sequence, end), "token-pieces"), sequence)
