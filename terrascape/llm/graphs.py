"""What the operators on links share: whole groups from a sorted partition, linking within groups of any size, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import discard, written

#: Members of a large group that all of its parts hold, by which the parts' components join.
HUBS = 32


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000, most_bytes: int = 24 << 20) -> Iterator[pa.Table]:
    """Tables of about `least` rows or `most_bytes`, more where one group has more, that end where a group of equal keys ends; the input is sorted by keys."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < least and size < most_bytes:
            continue
        data = pa.Table.from_batches(held)
        last = np.ones(rows, bool)
        for k in keys:
            column = data.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield data.slice(0, cut).combine_chunks()
            held = data.slice(cut).combine_chunks().to_batches()
            rows -= cut
            size = sum(b.nbytes for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def cells(rows: DataFrame, key: str, member: str, most: int, counted: DataFrame) -> DataFrame:
    """rows with part_a, part_b int: every two members of a key meet in exactly one or more cells (key, part_a, part_b) of about 2 * most rows.

    counted: the keys, once a row. A key of up to `most` is one cell. A larger one is cut into
    parts by the hash of its members, and each pair of parts is a cell; so no pair is lost and no
    task holds the key whole. The list of large keys is written first: Spark broadcasts it if it
    is small, so that rows of a large key aren't dealt by that key.
    """
    parts = counted.groupBy(key).agg(F.count("*").alias("_total")).where(F.col("_total") > most).select(key, F.ceil(F.col("_total") / most).cast("int").alias("_parts"))
    parts = written(parts, "large-keys")
    n = F.coalesce(F.col("_parts"), F.lit(1))
    own = F.pmod(F.xxhash64(member), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(F.col("_own"), j).alias("part_a"), F.greatest(F.col("_own"), j).alias("part_b")))
    out = rows.join(parts, key, "left").withColumn("_own", own)
    return out.select(*rows.columns, F.inline(pairs))


def linked_within(rows: DataFrame, key: str, member: str, most: int, by: list[str], kernel: Callable, link: str, weight: str | None = None, tasks: int | None = None) -> DataFrame:
    """(a, b) of type `link`: links enough to join all members of each key that kernel's links connect; rows are as written.

    kernel maps Arrow batches, sorted by (key, part, rest, *by), to links enough to join what
    links within each (key, part); rows with `rest` need not be compared with each other. A key
    of up to `most` rows (or sum of `weight`) is one part. A larger one is cut by the hash of its
    members, and a few members, the hubs, go to all of its parts. Members that hubs and parts
    leave outside the component with most members are then compared with all others of the key,
    in cells of one part of these and one of those. So a group that links makes one is never
    compared pair by pair, and none loses a link.
    """
    size = F.sum(weight) if weight else F.count("*")
    columns = rows.columns

    def run(placed: DataFrame) -> DataFrame:
        dealt = placed.repartition(tasks, key, "part") if tasks else placed.repartition(key, "part")
        return dealt.sortWithinPartitions(key, "part", "rest", *by).mapInArrow(kernel, f"a {link}, b {link}")

    large = rows.groupBy(key).agg(size.cast("double").alias("_size")).where(F.col("_size") > most).select(key, F.ceil(F.col("_size") / most).cast("int").alias("_parts"))
    large = written(large, "large-groups")
    if large.isEmpty():
        discard(large)
        return run(rows.select(*columns, F.lit(0).alias("part"), F.lit(False).alias("rest")))
    marked = rows.join(large, key, "left")
    spread = marked.where("_parts IS NOT NULL")
    own = F.pmod(F.xxhash64(member), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")
    lane = F.pmod(F.xxhash64(F.lit(1), member), F.lit(HUBS))
    hubs = written(spread.groupBy(key, lane.alias("_lane")).agg(F.min_by(member, F.xxhash64(F.lit(2), member)).alias(member)).select(key, member, F.lit(True).alias("_hub")), "hubs")
    everywhere = F.sequence(F.lit(0), F.col("_parts") - 1)
    place = F.when(F.col("_hub"), everywhere).otherwise(F.array(own))
    first = written(run(marked.join(hubs, [key, member], "left").select(*columns, F.explode(place).alias("part"), F.lit(False).alias("rest"))).distinct(), "group-links")
    roots = components(first)
    apart = written(spread.select(key, member, F.col(weight or key).alias("_w")).join(roots, F.col(member) == F.col("node"), "left").select(key, member, "_w", F.coalesce("root", member).alias("_root")), "group-roots")
    count = F.sum("_w") if weight else F.count("*")
    main = written(apart.groupBy(key, "_root").agg(F.count("*").alias("_n")).groupBy(key).agg(F.max_by("_root", "_n").alias("_main")), "group-mains")
    rest = written(apart.join(main, key).where("_root <> _main").select(key, member, "_w"), "group-rest")
    shares = written(rest.groupBy(key).agg(F.ceil(count.cast("double") / most).cast("int").alias("_shares")), "group-shares")
    if shares.isEmpty():
        return first
    spread = spread.join(shares, key)
    share = F.pmod(F.xxhash64(F.lit(3), member), F.col("_shares")).cast("int")
    others = spread.select(*columns, F.explode(F.transform(F.sequence(F.lit(0), F.col("_shares") - 1), lambda q: own + q * F.col("_parts"))).alias("part"), F.lit(True).alias("rest"))
    these = spread.join(rest.select(key, member), [key, member], "left_semi").select(*columns, F.explode(F.transform(everywhere, lambda p: p + share * F.col("_parts"))).alias("part"), F.lit(False).alias("rest"))
    return first.unionByName(run(these.unionByName(others)))


class Forest:
    """Union-find over 0 to n - 1, by least root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(links: DataFrame) -> DataFrame:
    """node, root (least node that links reach) of every node of links(a, b), by alternating large and small stars.

    Each round is two aggregations and joins, written to the shared folder; the rounds grow with
    the logarithm of the longest chain. Nodes and roots never leave the executors.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # large star: what a node's greater neighbours are linked to becomes its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours, and the node itself, are linked to the least of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        new = written(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())
        done = mark(new) == mark(edges)
        discard(edges)
        edges = new
        if done:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
