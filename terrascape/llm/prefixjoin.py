"""Exact set-similarity join of documents on word n-grams, by prefix trees.

All n-grams have one global order: by hash, but with those that very many documents hold last,
rarer ones first. Two sets that link share n-grams among the first ones of each (the prefix), so
documents meet under the n-grams of their prefixes. Prefixes are longer than one shared n-gram
asks for, by a share of the set; so a set that links meets others under as many n-grams more,
and one that doesn't is left out. Of n-grams under which the same sets meet one is enough. Sizes
and parity bitmaps, which grow with the sets, bound the overlap that is still possible there.
What may link forms blocks. In a block, the whole sets go, in the global order, into a trie; a
set is looked up by a traversal that shares the overlap with common beginnings and leaves a
subtree as soon as the n-grams that remain can't reach the threshold, or when all that lies
there is known to be linked with it.

Copies (equal sets) stand as one; links are verified on whole sets. Groups under one n-gram and
blocks that are too large for a task are cut as graphs.linked_within says.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import discard, in_small_batches, slices, written
from terrascape.llm.graphs import Forest, components, linked_within, whole_groups
from terrascape.llm.textops import Texts, mix, shingle_sets

#: Documents that must hold an n-gram for it to count as frequent, and the most n-grams that may.
FREQUENT = 64
MOST_FREQUENT = 200_000
#: Sets under one n-gram that a task takes together; larger groups are cut.
MOST_TOGETHER = 4_096
#: N-grams of the sets of a block that a task takes together; larger blocks are cut.
MOST_SHINGLES = 1_000_000
#: Rows of one set that are joined with its class in one task; the copies of a set with more are dealt over several.
COPIES_TOGETHER = 1_000
#: Bits of a set's parity bitmap: a power of two, at least the set's size and the first, at most the second of these.
FEWEST_BITS, MOST_BITS = 64, 1 << 20


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    h = mix(s ^ np.uint64(0x6A09E667F3BCC908))
    a = mix(h.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    b = mix(np.bitwise_xor.reduce(mix(h + np.uint64(1)), keepdims=True) if len(s) else np.zeros(1, np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def parity(s: np.ndarray) -> bytes:
    """Bitmap with each bit the parity of the elements that fall on it; two of one width differ in no more bits than the sets in elements."""
    width = min(MOST_BITS, max(FEWEST_BITS, 1 << max(0, len(s) - 1).bit_length()))
    bits = np.bincount((s >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def facts(documents: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_shingles, ka, kb, bitmap) of each row, th a hash of its text; (token, count) of n-grams that several texts of a task hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = count >= 4
            token, count = token[often].view(np.int64), count[often]
            none = [None] * len(token)
            empty = [pa.array(none, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*empty, pa.array(token), pa.array(count)], names=names)

        names = ["doc_id", "th", "n_shingles", "ka", "kb", "bitmap", "token", "count"]
        for batch, texts in slices(batches):
            sets = shingle_sets(Texts(texts).words(), n)
            keys = [set_key(s) for s in sets]
            none = pa.array([None] * len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(list(map(len, sets)), pa.int32()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(list(map(parity, sets))), none, none],
                names=names,
            )
            held += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                yield counted()
                held, size = [], 0
        yield counted()

    both = written(in_small_batches(_named(documents)).mapInArrow(run, "doc_id long, th long, n_shingles int, ka long, kb long, bitmap binary, token long, count long"), "shingle-facts")
    return both.where("token IS NULL").drop("token", "count"), both.where("token IS NOT NULL").select("token", "count")


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))


def frequent(counts: DataFrame) -> np.ndarray:
    """At most MOST_FREQUENT frequent n-grams, the most frequent last; any choice of them gives right results."""
    top = counts.groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)
    found = top.toPandas()
    return found.sort_values(["n", "token"])["token"].to_numpy(np.int64).view(np.uint64)


def needed(t: Fraction, size: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of two sets of sizes that sum to `size`, for a Jaccard similarity of t or more."""
    return -(-t.numerator * size // (t.numerator + t.denominator))


def spare(t: Fraction, n: int) -> int:
    """N-grams by which the prefix of a set of n is longer than for one shared n-gram: half of what may differ."""
    return (t.denominator - t.numerator) * n // (2 * t.denominator) if 3 * t >= 1 else 0


def prefixes(documents: DataFrame, n: int, t: Fraction, order: np.ndarray) -> DataFrame:
    """(token, ka, n): the n-grams of each set's prefix; a set once a task, however many copies it has."""
    shared = documents.sparkSession.sparkContext.broadcast((np.sort(order), np.argsort(order, kind="stable")))

    def prefix(s: np.ndarray) -> np.ndarray:
        size = min(len(s), len(s) - -(-t.numerator * len(s) // t.denominator) + 1 + spare(t, len(s)))
        tokens, rank = shared.value
        if not len(tokens):
            return s[:size]
        for take in (size + 32, len(s)):  # most sets have no more frequent n-grams than this among the first
            part = s[:take]
            at = np.minimum(np.searchsorted(tokens, part), len(tokens) - 1)
            often = tokens[at] == part
            rare = part[~often]
            if len(rare) >= size:
                return rare[:size]
        return np.concatenate([rare, part[often][np.argsort(rank[at[often]])]])[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in slices(batches):
            rows = []
            for s in shingle_sets(Texts(texts).words(), n):
                if len(s) and (key := set_key(s)[0]) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    p = prefix(s)
                    rows.append((p, np.full(len(p), key, np.int64), np.full(len(p), len(s), np.int32)))
            if rows:
                token, key, size = map(np.concatenate, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(key), pa.array(size)], names=["token", "ka", "n"])

    return documents.select("text").mapInArrow(run, "token long, ka long, n int")


def shared_prefixes(rows: DataFrame, t: Fraction) -> DataFrame:
    """Those of rows (token, ka, n) whose n-gram another set of a fitting size has too, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by n-gram, size and set: a neighbour that fits is enough, and of copies one
        last, told = None, False

        for batch in batches:
            data = {k: batch.column(k).to_numpy() for k in ("token", "ka", "n")}
            if not len(data["token"]):
                continue
            new = np.append(True, (data["token"][1:] != data["token"][:-1]) | (data["ka"][1:] != data["ka"][:-1]))
            if last is not None:
                new[0] = data["token"][0] != last["token"][0] or data["ka"][0] != last["ka"][0]
            data = {k: v[new] for k, v in data.items()}
            if not len(data["token"]):
                continue
            if last is not None:
                data = {k: np.append(last[k], v) for k, v in data.items()}
            token, n = data["token"], data["n"].astype(np.int64)
            link = (token[1:] == token[:-1]) & (n[1:] * t.numerator <= n[:-1] * t.denominator)
            ok = np.append(link, False) | np.append(False, link)
            if told:
                ok[0] = False
            last, told = {k: v[-1:] for k, v in data.items()}, bool(ok[-1]) or (told and len(token) == 1)
            out = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(v[out]) for v in data.values()], names=list(data))

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "ka")
    return dealt.mapInArrow(run, "token long, ka long, n int")


def meetings(rows: DataFrame, t: Fraction, rounds: int = 2) -> DataFrame:
    """What is left of shared_prefixes(rows): sets that meet others under as many n-grams as a set that links, and of n-grams with the same sets one.

    If a set of n links with a smaller one of m, their overlap is at least needed(n + m), which is
    at least t * n, as m is. Of what they share only the rest of one of them lies outside both
    prefixes, and that is at most t * n - spare(n), so they share spare(n) n-grams or more within
    their prefixes. Sets that don't go take meetings of others with them, hence rounds.
    """
    share = f"{t.denominator - t.numerator} * size DIV {2 * t.denominator}" if 3 * t >= 1 else "0"
    met = written(shared_prefixes(rows, t), "shared-prefixes")
    for _ in range(rounds):
        often = met.groupBy("ka").agg(F.count("*").alias("c"), F.first("n").cast("long").alias("size")).where(f"c >= {share}")
        left = met.join(often.select("ka"), "ka", "left_semi")
        new = written(shared_prefixes(left, t), "shared-prefixes")
        discard(met)
        met = new
    one, two = F.xxhash64("ka"), F.xxhash64(F.lit(1), "ka")
    total = lambda h: F.sum(F.pmod(h, F.lit(1 << 40)))
    who = met.groupBy("token").agg(F.count("*").alias("c"), total(one).alias("s"), total(two).alias("u"), F.min("ka").alias("v"), F.max("ka").alias("w"))
    kept = who.groupBy("c", "s", "u", "v", "w").agg(F.min("token").alias("token")).select("token")
    return met.join(kept, "token", "left_semi")


class Bitmaps:
    """Parity bitmaps of a table's sets, compared at the smaller width of two."""

    def __init__(self, column: list[bytes]):
        self.width = np.array([8 * len(b) for b in column], np.int64)
        self.column, self.at = column, {}

    def _rows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.at:
            place, found, done = np.zeros(len(self.column), np.int64), [], 0
            for w in np.unique(self.width[self.width >= width]).tolist():
                rows = np.flatnonzero(self.width == w)
                bits = np.frombuffer(b"".join([self.column[i] for i in rows]), np.uint64).reshape(len(rows), -1)
                while bits.shape[1] * 64 > width:
                    half = bits.shape[1] // 2
                    bits = bits[:, :half] ^ bits[:, half:]
                place[rows] = done + np.arange(len(rows))
                found.append(bits)
                done += len(rows)
            self.at[width] = place, np.concatenate(found)
        return self.at[width]

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, width = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(width).tolist():
            place, bits = self._rows(w)
            at = np.flatnonzero(width == w)
            for k in range(0, len(at), step := max(1, (1 << 25) // w)):
                some = at[k : k + step]
                out[some] = np.bitwise_count(bits[place[i[some]]] ^ bits[place[j[some]]]).sum(axis=1, dtype=np.int64)
        return out


def candidate_links(rows: DataFrame, t: Fraction) -> DataFrame:
    """(a, b): under each n-gram, links enough to join all sets whose bounds allow a similarity of t; rows: (token, ka, n, bitmap), as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["token", "part"]
        for data in whole_groups(batches, keys):
            token, part = (data.column(k).to_numpy() for k in keys)
            ka, n = data.column("ka").to_numpy(), data.column("n").to_numpy().astype(np.int64)
            rest = data.column("rest").to_numpy(zero_copy_only=False)
            bitmaps = Bitmaps(data.column("bitmap").to_pylist())

            def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                total = n[i] + n[j]
                least = needed(t, total)
                out = np.flatnonzero((n[i] * t.denominator >= n[j] * t.numerator) & (n[j] * t.denominator >= n[i] * t.numerator))
                return out[bitmaps.differing(i[out], j[out]) <= total[out] - 2 * least[out]]

            edge = np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]))
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(token)))
            probed = np.add.reduceat(rest, start) > 0
            group = np.repeat(np.arange(len(start)), size)
            found = []
            small = ((size <= 16) & ~probed)[group]
            for d in range(1, 16):  # pairs d apart, over all small groups at once
                i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if d < len(group) else np.empty(0, np.int64)
                if not len(i):
                    break
                i = i[possible(i, i + d)]
                found.append((ka[i], ka[i + d]))
            for g in np.flatnonzero((size > 16) | probed):
                at = np.arange(start[g], start[g] + size[g])
                own = np.arange(size[g])  # what links have joined bears one label
                firsts = int(size[g] - np.count_nonzero(rest[at]))
                for i in range(firsts):
                    js = np.flatnonzero(own[i + 1 :] != own[i]) + i + 1
                    if not len(js):
                        continue
                    js = js[possible(np.full(len(js), at[i]), at[js])]
                    new, one = np.unique(own[js], return_index=True)
                    if len(new):
                        js = js[one]
                        found.append((np.full(len(js), ka[at[i]]), ka[at[js]]))
                        own[np.isin(own, new)] = own[i]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return linked_within(rows, "token", "ka", MOST_TOGETHER, ["n", "ka"], run, "long").distinct()


class Trie:
    """Ordered sets as paths; a node holds a run of elements, its children, the sets that end there, the sizes below it, and a set below it with whether all there are joined with that."""

    __slots__ = ("run", "children", "ends", "least", "most", "one", "mixed")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends, self.least, self.most, self.one, self.mixed = run, {}, [], 1 << 60, 0, -1, False

    def _passed(self, size: int, label: int, forest: Forest) -> None:
        self.least, self.most = min(self.least, size), max(self.most, size)
        if self.one < 0:
            self.one = label
        elif not self.mixed and forest.root(self.one) != forest.root(label):
            self.mixed = True

    def add(self, s: np.ndarray, label: int, forest: Forest) -> None:
        node, at = self, 0
        while True:
            node._passed(len(s), label, forest)
            if at == len(s):
                node.ends.append(label)
                return
            child = node.children.get(int(s[at]))
            if child is None:
                child = Trie(s[at:])
                node.children[int(s[at])] = child
                child._passed(len(s), label, forest)
                child.ends.append(label)
                return
            rest = s[at : at + len(child.run)]
            differs = np.flatnonzero(child.run[: len(rest)] != rest)
            same = int(differs[0]) if len(differs) else len(rest)
            if same < len(child.run):  # the run is cut where the two part
                upper = Trie(child.run[:same])
                upper.least, upper.most, upper.one, upper.mixed = child.least, child.most, child.one, child.mixed
                upper.children[int(child.run[same])] = child
                child.run = child.run[same:]
                node.children[int(s[at])] = upper
                child = upper
            node, at = child, at + same

    def linked(self, s: np.ndarray, label: int, mark: np.ndarray, t: Fraction, forest: Forest) -> Iterator[int]:
        """Labels of sets that link with s and aren't joined with it yet; mark: flags of its elements."""
        size = len(s)
        low, high = -(-t.numerator * size // t.denominator), t.denominator * size // t.numerator
        stack = [(self, 0, 0)]  # node, depth and overlap above its run
        while stack:
            node, depth, overlap = stack.pop()
            if node.most < low or node.least > high or not node.mixed and forest.root(node.one) == forest.root(label):
                continue
            if len(node.run):
                overlap += int(np.count_nonzero(mark[node.run]))
                depth += len(node.run)
                left = size - int(np.searchsorted(s, node.run[-1], "right"))
            else:
                left = size
            smallest = max(node.least, low)
            if overlap + min(left, min(node.most, high) - depth) < needed(t, size + smallest):
                continue
            if node.ends and t.denominator * overlap >= t.numerator * (size + depth - overlap):
                yield from node.ends
            stack.extend((c, depth, overlap) for c in node.children.values())


def joined(sets: list[np.ndarray], t: Fraction, order: tuple[np.ndarray, np.ndarray] | None = None, probes: int = 0) -> Iterator[tuple[int, int]]:
    """Links enough to join all sets that links of similarity t connect; the last `probes` sets aren't compared with each other.

    order: frequent n-grams, sorted, and their ranks. The trie takes n-grams from the end of the
    global order on: the most frequent first, so that paths are shared, then the others by hash.
    """
    every = np.unique(np.concatenate(sets))
    rank = np.zeros(len(every), np.int64)
    if order is not None and len(order[0]):
        at = np.minimum(np.searchsorted(order[0], every), len(order[0]) - 1)
        often = order[0][at] == every
        rank[often] = -1 - order[1][at[often]].astype(np.int64)
    place = np.empty(len(every), np.int32)
    place[np.lexsort((every, rank))] = np.arange(len(every), dtype=np.int32)
    ordered = [np.sort(place[np.searchsorted(every, s)]) for s in sets]
    forest, trie = Forest(len(sets)), Trie(np.empty(0, np.int32))
    mark = np.zeros(len(every), bool)
    firsts = len(sets) - probes
    del sets, every, rank, place
    for i in [*sorted(range(firsts), key=lambda i: len(ordered[i])), *range(firsts, len(ordered))]:
        s = ordered[i]
        if trie.one >= 0:
            mark[s] = True
            for j in trie.linked(s, i, mark, t, forest):
                if forest.join(i, j):
                    yield i, j
            mark[s] = False
        if i < firsts:
            trie.add(s, i, forest)


def verified_links(documents: DataFrame, blocks: DataFrame, n: int, t: Fraction, order: np.ndarray) -> DataFrame:
    """(a, b) set keys: exact links enough to join what links join, within each block; blocks: (doc_id, th, key, block, n_shingles), a row for each set."""
    shared = documents.sparkSession.sparkContext.broadcast((np.sort(order), np.argsort(order, kind="stable")))
    absent = -(1 << 63)
    member = blocks.select(F.coalesce("doc_id", F.lit(absent)).alias("_doc"), F.col("th").alias("_th"), "key", "block", "n_shingles")
    rows = _named(documents)
    rows = rows.join(member, (F.coalesce("doc_id", F.lit(absent)) == F.col("_doc")) & (F.col("th") == F.col("_th"))).select("text", "key", "block", "n_shingles")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(Texts(texts).words(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("key"), batch.column("n_shingles"), pa.array(sets, pa.binary())], names=["block", "key", "n_shingles", "shingles"])

    sets = written(in_small_batches(rows).mapInArrow(shingled, "block long, key binary, n_shingles int, shingles binary"), "block-sets")
    keys = ["block", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in whole_groups(batches, keys, 2_000):
            place = np.stack([data.column(k).to_numpy() for k in keys], 1)
            edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(axis=1)))
            rest = data.column("rest").to_numpy(zero_copy_only=False)
            name = data.column("key")
            a, b = [], []
            for i, j in zip(edges, [*edges[1:], len(rest)], strict=True):
                if j - i > 1:
                    held = [np.frombuffer(x, np.uint64) for x in data.column("shingles").slice(i, j - i).to_pylist()]
                    for x, y in joined(held, t, shared.value, int(np.count_nonzero(rest[i:j]))):
                        a.append(name[int(i) + x].as_py())
                        b.append(name[int(i) + y].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    tasks = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # time, not bytes, is what a block takes
    return linked_within(sets, "block", "key", MOST_SHINGLES, ["n_shingles", "key"], run, "binary", "n_shingles", tasks)


def verified_classes(documents: DataFrame, n: int, t: Fraction | str, proposed: DataFrame, own: DataFrame | None = None, order: np.ndarray | None = None) -> DataFrame:
    """doc_id, th, n_shingles, component_id, class_key by the exact links within groups of sets that proposed links (a, b: set keys) join; own: facts(), order: frequent(), if at hand."""
    t = Fraction(t)
    own = facts(documents, n)[0] if own is None else own
    key = F.unhex(F.concat(F.lpad(F.hex("ka"), 16, "0"), F.lpad(F.hex("kb"), 16, "0")))
    sets = own.where("n_shingles > 0")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    named = sets.groupBy("ka", "kb").agg(pick.alias("pick"), F.first("n_shingles").alias("n_shingles"), F.ceil(F.count("*") / COPIES_TOGETHER).cast("int").alias("salts"))
    named = written(named.select("ka", "kb", key.alias("key"), F.col("pick.doc_id").alias("rep"), F.col("pick.th").alias("th"), "n_shingles", "salts"), "shingle-classes")
    blocks = written(components(proposed), "blocks")
    member = named.join(blocks, named.ka == blocks.node).select(F.col("rep").alias("doc_id"), "th", "key", F.col("root").alias("block"), "n_shingles")
    found = written(components(verified_links(documents, member, n, t, np.empty(0, np.uint64) if order is None else order)), "duplicate-classes")
    placed = named.select("ka", "kb", "key", "rep").join(found, F.col("key") == F.col("node"))
    least = placed.groupBy("root").agg(F.min("rep").alias("least"))
    moved = written(placed.join(least, "root").select("ka", "kb", "root", "least"), "duplicate-roots")
    reps = named.select("ka", "kb", "key", "rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(moved, ["ka", "kb"], "left")
    reps = reps.select("ka", "kb", "salt", F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component_id"), F.coalesce("root", "key").alias("class_key"))
    size = F.col("n_shingles").cast("long").alias("n_shingles")
    # the list of sets with very many copies is written, so that Spark broadcasts it if it is small
    copied = written(named.where("salts > 1").select("ka", "kb", "salts"), "copied-sets")
    sets = sets.join(copied, ["ka", "kb"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    linked = sets.join(reps, ["ka", "kb", "salt"]).select("doc_id", "th", size, "component_id", "class_key")
    return linked.unionByName(own.where("n_shingles = 0").select("doc_id", "th", size, F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("class_key")))


def classed(documents: DataFrame, n: int = 5, t: Fraction | str = "0.8") -> DataFrame:
    """What classes() returns, and for each row th, the xxhash64 of its text, and class_key, which tells classes apart whatever doc_id holds (null without shingles)."""
    t = Fraction(t)
    own, counts = facts(documents, n)
    order = frequent(counts)
    met = meetings(prefixes(documents, n, t, order), t)
    bitmaps = own.where("n_shingles > 0").groupBy("ka").agg(F.first("bitmap").alias("bitmap"))
    proposed = candidate_links(written(met.join(bitmaps, "ka"), "meetings"), t)
    return verified_classes(documents, n, t, proposed, own, order)


def classes(documents: DataFrame, n: int = 5, t: Fraction | str = "0.8") -> DataFrame:
    """doc_id, n_shingles long, component_id: the smallest doc_id that links of Jaccard similarity t or more reach.

    n_shingles: distinct n-word shingles; a text of fewer words has its whole sequence as one; a
    null or empty text, or one without words, has none and is linked with nothing, also not with
    its like. Rows of one doc_id each count; a row with a null doc_id links as any other and gets
    its class's smallest doc_id, or null where none has one. An empty table gives no rows.
    """
    return classed(documents, n, t).select("doc_id", "n_shingles", "component_id")
