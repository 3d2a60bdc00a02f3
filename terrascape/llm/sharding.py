"""Histogram sort into shards of near equal bytes, in DataFrame functions only.

The key of a document is (hash of its text, doc_id), so copies lie side by side. Exact bytes
and rows below candidate boundaries are counted by one aggregation a round; only the bins that
still hold a splitter beyond tolerance are refined, 12 bits a time, through the text's hash and,
where one group of copies is larger than the tolerance, on through doc_id. The splitters found,
each row knows its shard, and rows move once.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascape.llm.common import written

DIGIT = 12
#: Largest difference of a splitter from its place, in parts of a shard.
TOLERANCE = 0.005
#: Rows of a shard whose slots are numbered together; a shard with more has more lanes than the fewest.
LANE_ROWS, FEWEST_LANES = 200_000, 16
_SIGN = -(1 << 63)


def _key(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(_SIGN)).cast("long").bitwiseXOR(F.lit(_SIGN))


def _bits(level: int) -> tuple[str, int, int]:
    """Of a digit's level: its column, the bits after it, its width."""
    column, at = ("h", level) if level < 6 else ("v", level - 6)
    after = max(0, 64 - DIGIT * (at + 1))
    return column, after, min(DIGIT, 64 - DIGIT * at)


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Boundaries (text hash, doc_id as unsigned keys) between shards; keys: (h, v, size).

    A boundary is the least key of the shard that it opens. None for an empty table.
    """
    total = keys.agg(F.sum("size")).head()[0] or 0
    if not total or shards < 2:
        return []
    # what each open splitter still looks for: (prefix of digits, bytes before that prefix)
    found: dict[int, int] = {}
    open_at = {k: ((), 0) for k in range(1, shards)}
    level = 0
    while open_at and level < 12:
        column, after, width = _bits(level)
        prefixes = sorted({p for p, _ in open_at.values()})
        inside = keys
        digits = []
        for i in range(level):
            c, a, w = _bits(i)
            digits.append(F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << w) - 1)))
        if level:
            number = {p: i for i, p in enumerate(prefixes)}
            label = F.create_map(*[x for p in prefixes for x in (F.lit("/".join(map(str, p))), F.lit(number[p]))])
            inside = keys.withColumn("p", F.element_at(label, F.concat_ws("/", *[d.cast("string") for d in digits]))).where("p IS NOT NULL")
        else:
            number = {(): 0}
            inside = keys.withColumn("p", F.lit(0))
        digit = F.shiftrightunsigned(column, after).bitwiseAND(F.lit((1 << width) - 1))
        # at most (shards - 1) * 4096 rows, whatever the input
        counted = inside.groupBy("p", digit.cast("int").alias("d")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        bins: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r.p, r.d)):
            bins.setdefault(r.p, []).append((r.d, r.b, r.n))
        for k, (prefix, before) in list(open_at.items()):
            aim, own = total * k / shards, bins[number[prefix]]
            edges = [before]
            for _, b, _ in own:
                edges.append(edges[-1] + b)
            j = min(max(bisect_left(edges, aim), 1), len(own))  # the bin that holds the aim
            d, _, n = own[j - 1]
            edge = min((j - 1, j), key=lambda e: abs(edges[e] - aim))
            if abs(edges[edge] - aim) <= tolerance * total / shards or n == 1 or level == 11:
                digits_at = (*prefix, own[edge][0]) if edge < len(own) else (*prefix, own[-1][0] + 1)
                key = 0
                for i in range(12):
                    key += (digits_at[i] if i < len(digits_at) else 0) << (_bits(i)[1] + (64 if i < 6 else 0))
                found[k] = key
                del open_at[k]
            else:
                open_at[k] = ((*prefix, d), edges[j - 1])
        level += 1
    return [divmod(found[k], 1 << 64) for k in sorted(found)]


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below a row's key (columns h, v as unsigned keys)."""
    low = lambda x: F.lit((x ^ (1 << 63)) - (1 << 64) if x ^ (1 << 63) >= 1 << 63 else x ^ (1 << 63))
    h, v = F.col("h").bitwiseXOR(F.lit(_SIGN)), F.col("v").bitwiseXOR(F.lit(_SIGN))
    out = F.lit(0)
    for a, b in bounds:
        # a boundary past the greatest key can't be written as one
        out = out + (F.lit(0) if a >= 1 << 64 else ((h > low(a)) | ((h == low(a)) & (v >= low(b)))).cast("int"))
    return out


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseXOR(F.lit(_SIGN)).alias("h"),
        _key("doc_id").alias("v"),
    )


def sharded(documents: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard int, slot long (0 and on in each shard), grown_shard int (null).

    size: bytes of the text plus 8; a null text has none, and counts as an empty one. Copies of a
    text share a shard unless a boundary must cut them to keep within tolerance, which it does
    between doc_ids. Rows of one doc_id and one text, and rows with a null doc_id, are rows of
    their own; where they are all a bin holds, they stay together. An empty table gives no rows.
    """
    keys = written(keyed(documents), "shard-keys")
    rows = keys.withColumn("shard", shard_of(splitters(keys, shards, tolerance)))
    counts = {r[0]: r[1] for r in rows.groupBy("shard").count().collect()}
    cut = keys.sparkSession.createDataFrame([(k, max(FEWEST_LANES, -(-n // LANE_ROWS))) for k, n in counts.items()] or [(0, 1)], "shard int, lanes long")
    rows = rows.join(F.broadcast(cut), "shard").withColumn("lane", F.pmod(F.xxhash64("v", "h"), F.col("lanes"))).drop("lanes")
    # slots: where each lane of a shard begins (a row for each shard and LANE_ROWS rows), then the place in the lane
    begins = rows.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    begins = written(begins.withColumn("begin", F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).drop("n"), "shard-lanes")
    place = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("h", "v"))
    slots = rows.withColumn("place", place).join(begins, ["shard", "lane"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def exchanged(documents: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """documents with a column shard (replaced if there), moved once so that no partition holds two shards; write it with partitionBy('shard')."""
    plain = documents.drop("shard", "h", "v")
    keys = written(keyed(documents).select("h", "v", "size"), "shard-keys")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = plain.withColumn("h", F.xxhash64(text).bitwiseXOR(F.lit(_SIGN))).withColumn("v", _key("doc_id"))
    return rows.withColumn("shard", shard_of(splitters(keys, shards, tolerance))).drop("h", "v").repartition("shard")
