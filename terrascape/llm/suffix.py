"""Removal of long repeated byte strings, by enhanced suffix arrays over anchors.

Every string of `length` bytes holds an anchor: the least hash of its 48-byte grams, the last
of them where there are several. Equal strings have it at equal places, so what repeats meets
under its anchor's gram, and only anchors move between tasks, not suffixes of all texts. Of
anchors whose whole surroundings are equal nothing more need be known: all of it repeats. Where
the surroundings differ, one of each kind goes, with its bytes, into an enhanced suffix array of
its gram: sorted suffixes from the anchor on and their common prefixes. A scan with a stack
gives the tree of common-prefix intervals; in each interval the occurrences are told apart by
what stands before the anchor, and a second scan gives the groups that extend equally far to
the left. Groups that are maximal on both sides are the repeats, with all their occurrences:
repeat_groups() lists them, and removals() takes what they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import in_small_batches, slices, written
from terrascape.llm.graphs import cells, whole_groups
from terrascape.llm.textops import SLICE_BYTES, Texts, prefix_sums, span_hash

LENGTH = 200
GRAM = 48
#: Kinds of surroundings of one gram beyond which it is cut into cells.
MOST_TOGETHER = 4_096
#: Anchors in which a task looks for equal surroundings before they are dealt out.
MOST_HELD = 500_000
#: Occurrences that are laid out at a time, unless one interval has more.
MOST_EXPANDED = 20_000
_PLACE_BITS = np.uint64((1 << 22) - 1)


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row: from prefix and suffix minima of blocks of w."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of each anchor: its text, place in it, bytes before and after it that count, hash of its gram and of all these bytes."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "pos", "left", "right", "h", "c")}
    size = np.diff(texts.at) - 1
    reach = length - gram
    for begin in range(0, len(texts.buf), SLICE_BYTES):
        # windows that start in this slice, with what they and their anchors' surroundings need
        low, high = max(0, begin - reach), min(len(texts.buf), begin + SLICE_BYTES + 2 * length)
        buf = texts.buf[low:high]
        if len(buf) < length:
            continue
        s = prefix_sums(buf)
        at = np.arange(len(buf) - gram + 1)
        h = span_hash(s, at, at + gram)
        order = (h & ~_PLACE_BITS) | (_PLACE_BITS - at.astype(np.uint64))
        least = _PLACE_BITS - (sliding_least(order, reach + 1) & _PLACE_BITS)
        start = np.arange(begin - low, min(len(least), begin + SLICE_BYTES - low))
        text = np.searchsorted(texts.at, start + low, "right") - 1
        found = least[start].astype(np.int64)[start + low + length <= texts.at[text] + size[text]]
        found = np.unique(found)
        text = np.searchsorted(texts.at, found + low, "right") - 1
        pos = found + low - texts.at[text]
        left, right = np.minimum(pos, reach), np.minimum(size[text] - pos, length)
        out["text"].append(text)
        out["pos"].append(pos)
        out["left"].append(left)
        out["right"].append(right)
        out["h"].append(h[found])
        out["c"].append(span_hash(s, found - left, found + right) + left.astype(np.uint64))
    made = {k: np.concatenate(v) if v else np.empty(0, np.uint64 if k in "hc" else np.int64) for k, v in out.items()}
    # an anchor at a seam of slices can come from both
    _, first = np.unique(np.stack([made["text"].astype(np.int64), made["pos"].astype(np.int64)], 1), axis=0, return_index=True) if len(out["text"]) > 1 else (None, np.arange(len(made["text"])))
    return {k: v[first] for k, v in made.items()}


def _keyed(documents: DataFrame) -> DataFrame:
    """With _row, which tells apart rows of one doc_id and different texts."""
    return documents.withColumn("_row", F.xxhash64("doc_id", "text"))


_SPOT = "row long, pos int, left short, right short"


def met_anchors(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors whose gram occurs again. whole: its surroundings occur again too, so all of them repeat.

    Of each kind of surroundings of a gram that has several, one row has h and c; the others,
    where whole, have null in h.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def told() -> pa.RecordBatch:
            # of equal surroundings in this task one goes to its gram, and says so; the rest are settled
            d = {k: np.concatenate([x[k] for x in held]) for k in (*names, "h", "c")}
            order = np.lexsort((d["c"], d["h"]))
            d = {k: v[order] for k, v in d.items()}
            again = np.append(False, (d["h"][1:] == d["h"][:-1]) & (d["c"][1:] == d["c"][:-1]))
            twice = again | np.append(again[1:], False)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(d[k], t) for k, t in zip(names, types, strict=True)), pa.array(d["h"].view(np.int64), mask=again), pa.array(d["c"].view(np.int64), mask=again), pa.array(twice)], names=[*names, "h", "c", "twice"]
            )

        names, types = ["row", "pos", "left", "right"], [pa.int64(), pa.int32(), pa.int16(), pa.int16()]
        for batch, texts in slices(batches):
            a = anchors(Texts(texts), length, gram)
            a["row"] = batch.column("_row").to_numpy()[a["text"].astype(np.int64)]
            held.append(a)
            size += len(a["h"])
            if size > MOST_HELD:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by h and c; a row is judged once the next one is known, from its neighbours alone
        names = ["row", "pos", "left", "right", "h", "c", "twice"]
        held: dict[str, np.ndarray] | None = None  # the last rows: a judged one, if any, and one that isn't
        waiting: dict | None = None  # the first kind of the present gram, which goes out if there is a second

        def judge(data: dict[str, np.ndarray], skip: int, until: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            h, c = data["h"], data["c"]
            new_h = np.append(True, h[1:] != h[:-1])
            new_c = new_h | np.append(True, c[1:] != c[:-1])
            if skip:
                new_h[0] = new_c[0] = False
            whole = data["twice"] | ~new_c | np.append(~new_c[1:], False)
            if skip:
                whole[0] = False
            at = np.arange(len(h))
            mine = (at >= skip) & (at < until)
            first = np.flatnonzero(new_c & mine)
            # a kind's first row names it if its gram has another kind before or behind it
            opens = new_h[first]
            follows = np.append(first[1:], -1)
            another = np.array([f >= 0 and not new_h[f] for f in follows])
            named = ~opens | another
            out = []
            if waiting is not None and len(first) and not new_h[first[0]]:
                out.append(waiting | {"named": np.array([True])})
            if len(first):
                waiting = None
            if len(first) and opens[-1]:
                last = first[-1]
                waiting = {k: data[k][last : last + 1] for k in names} | {"whole": whole[last : last + 1]}
            keep = np.zeros(len(h), bool)
            name = np.zeros(len(h), bool)
            name[first[named]] = True
            keep[mine & whole] = True
            keep |= name
            out.append({k: data[k][keep] for k in names} | {"whole": whole[keep], "named": name[keep]})
            d = {k: np.concatenate([o[k] for o in out]) for k in (*names, "whole", "named")}
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["row"]), pa.array(d["pos"]), pa.array(d["left"]), pa.array(d["right"]), pa.array(d["h"], mask=~d["named"]), pa.array(d["c"], mask=~d["named"]), pa.array(d["whole"])], names=[*names[:6], "whole"]
            )

        for batch in batches:
            settled = batch.filter(pc.is_null(batch.column("h")))
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([*settled.columns[:6], settled.column("twice")], names=[*names[:6], "whole"])
                batch = batch.filter(pc.is_valid(batch.column("h")))
            if not batch.num_rows:
                continue
            data = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            skip = 0
            if held is not None:
                data = {k: np.append(held[k], v) for k, v in data.items()}
                skip = len(held["h"]) - 1
            n = len(data["h"])
            if n - skip > 1:
                yield from judge(data, skip, n - 1)
            held = {k: v[-2:] for k, v in data.items()}
        if held is not None:
            yield from judge(held, len(held["h"]) - 1, len(held["h"]))

    found = _keyed(in_small_batches(documents)).select("_row", "text").mapInArrow(find, f"{_SPOT}, h long, c long, twice boolean")
    dealt = found.repartition(F.coalesce("h", F.xxhash64("row", "pos"))).sortWithinPartitions("h", "c")
    return dealt.mapInArrow(sift, f"{_SPOT}, h long, c long, whole boolean")


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of a suffix array, by a scan with a stack; lcp[i]: of suffixes i and i + 1, -1 between arrays."""
    out, stack = [], []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        begin = i
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            out.append((d, begin, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))
    return out


def _common(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows a and b of m, whose first size bytes count."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 20_000):
        differs = m[a[i : i + 20_000]] != m[b[i : i + 20_000]]
        out[i : i + 20_000] = np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1])
    return np.minimum(out, np.minimum(size[a], size[b]))


def _sorted(*parts: np.ndarray) -> np.ndarray:
    """Order of rows by the bytes of the parts, then by the last part's numbers: of a string and the same with zero bytes behind it, the shorter first."""
    *texts, size = parts
    keyed = np.ascontiguousarray(np.concatenate([*texts, size.astype(">u2").view(np.uint8).reshape(-1, 2)], 1))
    return np.argsort(keyed.view(f"S{keyed.shape[1]}").ravel(), kind="stable")


def repeats(group: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal repeats of `length` bytes or more through the anchors of each group, each with all its occurrences.

    before: bytes before each anchor in reverse order, after: from it on; both padded. Yields
    arrays (repeat, occurrence, bytes before it, bytes after it). The occurrences of a
    common-prefix interval, sorted by what stands before them, have intervals of their own: as
    deep as all agree to the left, so that none extends further there. Of these, one whose
    occurrences lie in several child intervals is maximal to the right as well; in one child
    only, they are found there with a longer string.
    """
    n = len(group)
    order = _sorted(group.astype(">u4").view(np.uint8).reshape(n, 4), after, n_after)
    lcp = np.where(group[order[1:]] == group[order[:-1]], _common(after, n_after, order[1:], order[:-1]), -1)
    above = np.append(-1, lcp)
    left_rank = np.empty(n, np.int64)
    left_rank[_sorted(before, n_before)] = np.arange(n)
    nodes = [x for x in intervals(lcp) if x[0] + before.shape[1] >= length]
    told = i = 0
    while i < len(nodes):
        j, total = i, 0
        while j < len(nodes) and (j == i or total + nodes[j][2] - nodes[j][1] < MOST_EXPANDED):
            total += nodes[j][2] - nodes[j][1] + 1
            j += 1
        depth, first, last = (np.array(x) for x in zip(*nodes[i:j], strict=True))
        node, place = _expanded(first, last)
        at = order[place]
        child = np.cumsum(above[place] == depth[node])
        by_left = np.argsort(node * n + left_rank[at])
        at, node, child = at[by_left], node[by_left], child[by_left]
        common = np.where(node[1:] == node[:-1], _common(before, n_before, at[1:], at[:-1]), -1)
        common[common + depth[node[1:]] < length] = -1
        met = np.maximum(np.append(common, -1), np.append(-1, common)) >= 0
        at, node, child, common = at[met], node[met], child[met], np.append(common, -1)[met][:-1]
        i = j
        if not len(at):
            continue
        back, low, high = np.array(intervals(common)).T
        turns = np.append(0, np.cumsum(child[1:] != child[:-1]))
        diverse = turns[high] > turns[low]
        back, low, high = back[diverse], low[diverse], high[diverse]
        ends = np.cumsum(high - low + 1)
        k = 0
        while k < len(back):
            m = max(k + 1, int(np.searchsorted(ends, ends[k] + MOST_EXPANDED)))
            which, place = _expanded(low[k:m], high[k:m])
            yield told + which, at[place], back[k:m][which], depth[node[low[k:m]]][which]
            told += m - k
            k = m


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and place in it, for every place of the ranges from first to last."""
    count = last - first + 1
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count - first, count)


_FOUND = ["h", "part_a", "part_b"]


def _surroundings(documents: DataFrame, kinds: DataFrame) -> DataFrame:
    """The bytes around one anchor of each kind, dealt by gram; a gram of very many kinds by pairs of its parts."""
    spots = kinds.groupBy("row").agg(F.collect_list(F.struct("pos", "left", "right", "h", "c", "whole")).alias("spots"))
    texts = _keyed(documents).select("_row", "text")
    rows = texts.join(spots, F.col("_row") == F.col("row")).select("row", "text", "spots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            out = []
            for row, text, spots in zip(batch.column("row").to_pylist(), found, batch.column("spots").to_pylist(), strict=True):
                for s in spots:
                    p = s["pos"]
                    out.append((row, p, s["h"], s["c"], s["whole"], text[p - s["left"] : p][::-1], text[p : p + s["right"]]))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["row", "pos", "h", "c", "whole", "before", "after"])

    pieces = rows.mapInArrow(cut, "row long, pos int, h long, c long, whole boolean, before binary, after binary")
    return cells(pieces, "h", "c", MOST_TOGETHER, kinds).repartition(*_FOUND).sortWithinPartitions(*_FOUND)


def _found(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[pa.Table, Iterator]]:
    """Surroundings of whole grams, with their repeats."""
    for data in whole_groups(batches, _FOUND, 10_000):
        place = np.stack([data.column(k).to_numpy() for k in _FOUND], 1)
        group = np.cumsum(np.append(True, (place[1:] != place[:-1]).any(axis=1)))
        sides = []
        for side, width in (("before", length - gram), ("after", length)):
            parts = data.column(side).to_pylist()
            sides += [np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(-1, width), np.array(list(map(len, parts)))]
        yield data, repeats(group, *sides, length)


def edge_spans(documents: DataFrame, kinds: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, start, end) of what repeats around the named anchors that aren't whole."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, found in _found(batches, length, gram):
            row, pos, whole = (data.column(k).to_numpy() for k in ("row", "pos", "whole"))
            back, ahead = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            for _, at, b, a in found:  # all of an anchor's repeats hold the anchor, so together they are one span
                np.maximum.at(back, at, b)
                np.maximum.at(ahead, at, a)
            need = (back + ahead > 0) & ~whole.astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(row[need]), pa.array((pos - back)[need].astype(np.int32)), pa.array((pos + ahead)[need].astype(np.int32))], names=["row", "start", "end"])

    return _surroundings(documents, kinds).mapInArrow(scan, "row long, start int, end int")


def repeat_groups(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """repeat string, n_bytes, doc_id, start: the maximal repeats of `length` bytes or more, a row for each of their occurrences.

    documents: doc_id, text. repeat is the SHA-1 of the string. Maximal: not all occurrences can
    be extended by one byte to the left, nor all to the right, within the surroundings of an
    anchor (length - gram bytes before it, `length` from it on); a longer repeat gives a piece
    for each of its anchors. Of a gram with more than MOST_TOGETHER kinds of surroundings, pairs
    of parts are judged, each for itself. Nulls and texts shorter than `length` have none; equal
    rows are occurrences of each other.
    """
    met = written(met_anchors(documents, length, gram), "anchors")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, found in _found(batches, length, gram):
            h, c = data.column("h").to_numpy(), data.column("c").to_numpy()
            before, after = data.column("before"), data.column("after")
            for repeat, at, b, a in found:
                # a string counts at the anchors that it has by itself, which are the same in each occurrence
                first = np.flatnonzero(np.append(True, repeat[1:] != repeat[:-1]))
                strings = [before[i].as_py()[:x][::-1] + after[i].as_py()[:y] for i, x, y in zip(at[first].tolist(), b[first].tolist(), a[first].tolist(), strict=True)]
                mine = anchors(Texts(strings), length, gram)
                own = np.zeros(len(first), bool)
                own[mine["text"][mine["pos"] == b[first][mine["text"].astype(np.int64)]].astype(np.int64)] = True
                take = own[repeat - repeat[0]]
                at, b, a = at[take], b[take].astype(np.int32), a[take].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(c[at]), pa.array(b), pa.array(a)], names=["h", "c", "back", "ahead"])

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            a = anchors(Texts(texts), length, gram)
            row = batch.column("_row").to_numpy()[a["text"].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(a[k].astype(np.int32)) for k in ("pos", "left", "right")), *(pa.array(a[k].view(np.int64)) for k in "hc")], names=["row", "pos", "left", "right", "h", "c"])

    inner = _surroundings(documents, met.where("h IS NOT NULL")).mapInArrow(scan, "h long, c long, back int, ahead int").distinct()
    # every anchor of a kind has the kind's repeats; what is whole repeats as far as it goes
    every = _keyed(in_small_batches(documents)).select("_row", "text").mapInArrow(spot, "row long, pos int, left int, right int, h long, c long")
    ranges = every.join(inner, ["h", "c"]).select("row", (F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("ahead")).alias("end"))
    ranges = ranges.unionByName(met.where("whole").select("row", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")))
    of_row = ranges.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = _keyed(documents).select("_row", "doc_id", "text").join(of_row, F.col("_row") == F.col("row")).select("doc_id", "text", "spans")
    kind = documents.schema["doc_id"].dataType

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            spans = batch.column("spans").to_pylist()
            out = [(hashlib.sha1(text[s["start"] : s["end"]]).hexdigest(), s["end"] - s["start"], s["start"]) for text, found in zip(texts, spans, strict=True) for s in found]
            if out:
                digest, size, start = zip(*out, strict=True)
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(spans)), list(map(len, spans)))))
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(size, pa.int32()), ids, pa.array(start, pa.int32())], names=["repeat", "n_bytes", "doc_id", "start"])

    return rows.mapInArrow(name, f"repeat string, n_bytes int, doc_id {kind.simpleString()}, start int")


def removals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """documents with _spans array<struct<start, end>>: byte ranges that cover all bytes of strings of `length` bytes that start anywhere else too."""
    met = written(met_anchors(documents, length, gram), "anchors")
    edges = edge_spans(documents, met.where("h IS NOT NULL"), length, gram)
    spans = met.where("whole").select("row", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")).unionByName(edges)
    of_row = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    return _keyed(documents).join(of_row, F.col("_row") == F.col("row"), "left").drop("_row", "row")


def kept_bytes(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the maximal runs of them."""
    kept, done, runs, removed = [], 0, 0, 0
    reach = -1
    for s in sorted((s["start"], s["end"]) for s in spans or ()):
        if s[0] > reach:
            runs += 1
            kept.append(text[done : s[0]])
            removed += s[1] - s[0]
        else:
            removed += max(0, s[1] - reach)
        reach = max(reach, s[1])
        done = reach
    kept.append(text[done:])
    return b"".join(kept), removed, runs


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """documents with text less its repeated strings, and n_bytes, n_removed, n_spans long, kept_sha256 string (replaced if there).

    Strings are judged on the texts as given, so all occurrences go, the first too. A null text
    counts as empty and stays null; a text shorter than `length` stays as it is. Equal rows, also
    of one doc_id, are occurrences of each other. A character of which bytes were removed goes as
    a whole from the text, while kept_sha256 is of the exact bytes left.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = removals(documents.drop(*names, "_spans", "_row", "row"), length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = []
            for text, spans in zip(texts, batch.column("_spans").to_pylist(), strict=True):
                kept, removed, runs = kept_bytes(text or b"", spans)
                said = None if text is None else kept.decode("utf-8", "ignore") if removed else kept.decode("utf-8", "replace")
                out.append((said, len(text or b""), removed, runs, hashlib.sha256(kept).hexdigest()))
            said, *facts = zip(*out, strict=True)
            arrays = [pa.array(said, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n != "_spans"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(f, t) for f, t in zip(facts, types, strict=True))], names=[*(n for n in batch.schema.names if n != "_spans"), *names])

    from pyspark.sql.types import StructType

    schema = StructType([*(f for f in rows.schema.fields if f.name != "_spans"), *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    return rows.mapInArrow(run, schema)
