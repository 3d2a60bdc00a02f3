"""WARC archives: written by Spark's own text sink, read back record by record, and indexed by an external merge.

A record ends in two CRLFs, which the sink writes between rows, so that each file is a valid
WARC file on any file system, and a lost task leaves none behind. Compressed records are gzip
members of their own, so that each can be fetched by the offset and length in the index. Pages
with equal payloads become one response and revisits of it. The index merges sorted runs, one an
archive file, with a loser tree over (URL key, timestamp) in each range of the keys.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascape.llm.common import in_small_batches, shared_dir, slices, written

#: Fixed value: the base32 alphabet of RFC 4648, in the order of conv()'s digits.
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Most records of an archive file; bytes of one, of which files are dealt half.
RECORDS_A_FILE, FILE_BYTES = 2_000, 32 << 20
#: Share of a file's bytes beyond which a record has a file of its own; bytes of a record besides its payload.
OWN_SHARE, RECORD_BYTES = 16, 512
#: Places of pages that are alike in page_id and payload.
SALTS = 16
#: Captures of a range of the index, which a task merges.
RANGE_CAPTURES = 50_000
#: Level of zlib for records (6 makes pages a 16th smaller in 2.7 times the time); bytes of an archive that are unpacked at once.
LEVEL, PIECE = 1, 64 << 10
_GZIP = b"\x1f\x8b"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Date of the first capture where pages carry none; each page_id comes a second later.
_EPOCH = 1_700_000_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 40 bits, as 8 digits, at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), *BASE32)


def facts(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload_digest and payload_bytes."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html", base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def revisits(payloads: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_digest, refers_to of pages that repeat the payload of one with a smaller page_id.

    payloads: page_id, payload_digest, payload_bytes. Payloads smaller than `least` and pages
    without a page_id don't count. Digests alone meet by payload; of a payload that very many
    pages have, one row goes out of each task, and what it says comes back as a join of which
    Spark splits the side of the pages.
    """
    known = payloads.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least)).select("page_id", "payload_digest").distinct()
    known = written(known, "payloads")
    first = known.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return written(known.join(first, "payload_digest").where("refers_to < page_id"), "revisits")


def write_archives(pages: DataFrame, path: str, least: int = 0, compression: str = "none") -> None:
    """One record a page, in WARC files below path. pages: page_id, url, html; more columns are left out.

    compression: none; gzip, which makes each file one gzip member; or record, which makes each
    record one.

    A null html is an empty payload; a null url is left out of its record, and line ends in one
    are escaped; repeated rows give a record each. Of pages with equal payloads of at least `least`
    bytes that with the smallest page_id is the response and others revisit it; smaller ones are
    all responses, as are pages without a page_id. Texts are shuffled and written once: pages are
    dealt over as many files as hold their bytes half full, and one of which more than a 16th of a
    file's bytes is written gets a file for itself.
    """
    rows, large = facts(pages), FILE_BYTES // OWN_SHARE
    payloads = written(rows.select("page_id", "payload_digest", "payload_bytes"), "payload-facts")
    again = revisits(payloads, least)
    total = payloads.agg(F.sum(F.least(F.col("payload_bytes"), F.lit(large)) + RECORD_BYTES)).head()[0] or 0
    files = max(1, -(-2 * total // FILE_BYTES))
    # rows that are alike in page and payload come in SALTS places, to each of which goes what is known of them
    salted = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).repartition(files, "page_id", "payload_digest", "_salt")
    spread = again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(files, "page_id", "payload_digest", "_salt")
    out = salted.join(spread, ["page_id", "payload_digest", "_salt"], "left").select(record().alias("value"))
    end = "\r\n\r\n"
    if compression == "record":
        # the sink writes a string's bytes as they are, and after each the byte in which all members end
        out, end, compression = members_of(out).select(F.expr("substring(value, 1, octet_length(value) - 1)").cast("string").alias("value")), "\0", "none"
    own = F.when(F.octet_length("value") > large, F.monotonically_increasing_id()).otherwise(-1)
    out.select("value", own.alias("own")).write.partitionBy("own").options(lineSep=end, compression=compression, maxRecordsPerFile=RECORDS_A_FILE).text(path)


def record() -> Column:
    """The WARC record of a row of page_id, url, html, payload_digest, payload_bytes and refers_to (null: a response)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ident = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    response = F.col("refers_to").isNull()
    block = F.when(response, F.concat(F.lit(_HTTP), F.coalesce("html", F.lit("")))).otherwise(F.lit(_HTTP))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", ident(F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        F.coalesce(line("WARC-Refers-To", ident(F.col("refers_to"))), F.lit("")),
        F.when(response, "").otherwise("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def member(content: bytes) -> bytes:
    """content as a gzip member that ends in a byte of 0, the highest of its size; from 16 MB on, an empty member after it does."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(content) + packer.flush()
    return out if out.endswith(b"\0") else out + member(b"")


def members(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty."""
    at = 0
    while at < len(archive):
        unpacker, end, parts = zlib.decompressobj(31), at, []
        while not unpacker.eof:
            if end >= len(archive):
                raise ValueError(f"the member at {at} has no end")
            parts.append(unpacker.decompress(archive[end : end + PIECE]))
            end = min(len(archive), end + PIECE)
        end -= len(unpacker.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def members_of(records: DataFrame) -> DataFrame:
    """value(string) of records without their end as value(binary), the members of whole records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in slices(batches, "value"):
            yield pa.RecordBatch.from_arrays([pa.array([member(x + b"\r\n\r\n") for x in some], pa.binary())], names=["value"])

    return in_small_batches(records).mapInArrow(run, "value binary")


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:head].decode("utf-8").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        end = head + 4 + int(headers["Content-Length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where its length says")
        yield at, end + 4 - at, headers, archive[head + 4 : end]
        at = end + 4


def held(name: str, archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """records() of an archive as write_archives writes it; of one whose records are gzip members, with the offset and length of the member."""
    if name.endswith(".gz"):
        yield from records(zlib.decompress(archive, 31))
    elif archive.startswith(_GZIP):
        for at, length, content in members(archive):
            yield from ((at, length, headers, block) for _, _, headers, block in records(content))
    else:
        yield from records(archive)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, in small letters; '' for none."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    return ",".join(reversed(host.split("."))) + ")" + parts.path + (f"?{parts.query}" if parts.query else "")


_CAPTURE = "run string, url_key string, captured string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, offset long, length long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of the archives below path; a response's payload must have the digest and length that its record states.

    offset and length are those of the record in its file, where it may be a gzip member; in a
    file that is one member as a whole, before compression.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CAPTURE.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for offset, length, h, block in held(name, content.as_py()):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name}: the payload at {offset} isn't what its record states")
                    page, to = (x and x.removeprefix("<urn:page:").removesuffix(">") for x in (h["WARC-Record-ID"], h.get("WARC-Refers-To")))
                    rows.append((name, url_key(h.get("WARC-Target-URI")), h["WARC-Date"], int(page) if page else None, h["WARC-Type"], int(to) if to else None, digest, size, offset, length))
                if not rows:
                    continue
                rows.sort(key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0, r[8]))  # the file's own run
                types = [pa.int64() if "long" in x else pa.string() for x in _CAPTURE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(run, _CAPTURE)


class Run:
    """A sorted run as an Arrow table, of which the keys at its head are read a piece at a time."""

    def __init__(self, table: pa.Table, begin: int, key: list[str], piece: int = 1_000):
        self.table, self.begin, self.key, self.piece = table, begin, key, piece
        self.at, self.held = 0, []
        self._next()

    def _next(self) -> None:
        columns = [self.table.column(k).slice(self.at, self.piece).to_pylist() for k in self.key]
        self.held = [tuple((x is not None, x) if x is not None else (False,) for x in row) for row in zip(*columns, strict=True)][::-1]

    @property
    def head(self) -> tuple | None:
        return self.held[-1] if self.held else None

    def pop(self) -> int:
        """The place of the head in all runs; the head moves on."""
        self.held.pop()
        self.at += 1
        if not self.held:
            self._next()
        return self.begin + self.at - 1


def loser_tree(runs: list) -> Iterator[int]:
    """What pop() gives of runs with head and pop(), in the order of their heads: each inner node keeps the loser of its match, and the winner climbs to the root."""
    k = len(runs)
    if k < 2:
        while k and runs[0].head is not None:
            yield runs[0].pop()
        return

    def less(a: int, b: int) -> bool:
        x, y = runs[a].head, runs[b].head
        return x is not None and (y is None or (x, a) < (y, b))

    tree = [0] * k
    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], tree[node] = (a, b) if less(a, b) else (b, a)
    best = winner[1]
    while runs[best].head is not None:
        yield runs[best].pop()
        node = (best + k) // 2
        while node:
            if less(tree[node], best):
                best, tree[node] = tree[node], best
            node //= 2


def merged_index(captures: DataFrame) -> DataFrame:
    """Capture histories: captures in the order of (url_key, captured, page_id), over all partitions and within each.

    captures: as written, since the ranges are found by a pass of its own. There are as many
    ranges as hold about RANGE_CAPTURES each, however many captures there are. They are cut by all
    three and then by place in the archives, so that neither a URL captured very often nor repeated
    captures stay together. A partition holds the parts of the sorted runs that fall into its
    range as Arrow tables, and merges them; only the keys next in line are Python values.
    """
    key = ["url_key", "captured", "page_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        name = table.column("run").combine_chunks().dictionary_encode()
        name = name.chunk(0) if isinstance(name, pa.ChunkedArray) else name
        code = name.indices.to_numpy()
        edges = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist()
        order = loser_tree([Run(table.slice(a, b - a), a, key) for a, b in zip(edges, [*edges[1:], len(code)], strict=True)])
        while len(some := np.fromiter(islice(order, 10_000), np.int64)):
            yield from table.take(pa.array(some)).combine_chunks().to_batches()

    ranges = max(1, -(-captures.count() // RANGE_CAPTURES))
    parted = captures.repartitionByRange(ranges, *key, "run").sortWithinPartitions("run", *key)
    return parted.mapInArrow(run, captures.schema)


def archived(pages: DataFrame, least: int = 0, compression: str = "record") -> DataFrame:
    """Pages through the archives and back: run, url_key, captured, page_id, record_type, refers_to, payload_digest, payload_bytes, offset, length, as merged_index orders them."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least, compression)
    return merged_index(written(read_archives(pages.sparkSession, path), "captures"))
