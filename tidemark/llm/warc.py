"""WARC records and their fixity: Merkle trees over records and ordered offset ranges.

A page is one response record. Records lie in files by ranges of page_id, in order of page_id, at offsets that follow from
their lengths. A manifest has one row per record: file, seq, offset, length, SHA-256. Above it stands a tree: a node's hash
covers the offset range and the hashes of up to FANOUT children, up to each file's root, then over files to one root.
audit() compares the roots of two replicas and goes down only below nodes that differ, to the records that do: in their bytes, or in their place.

Null html is an empty body, a null url an empty target. Records of one page_id lie beside each other, in order of a hash of their url
(of their digest where the url is null), then of their digest. Rows with a null page_id lie in file -1, before any negative page_id. Other columns are ignored. An empty table has no files and
no damage. Bodies may be long: a record is only hashed where it lies, and rows that move carry digests alone. A page_id, null too, may hold any share of
the rows: its records are numbered in slices by that hash, equal records are counted before they move, and a file's tree gets as many levels as it needs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, dropped, staged

#: Identifiers per file, children per node, levels of a file's tree at least. FILE_IDS is FANOUT to the power of FILE_LEVELS.
FILE_IDS, FANOUT, FILE_LEVELS = 4096, 16, 3
#: Date of all records, so that equal pages make equal bytes.
DATE = "2024-01-01T00:00:00Z"
BROADCAST_NODES = 1_000_000
#: Records of one page_id are numbered in 2 to the power of 64 - SLICE_SHIFT slices; equal records beyond COPIES are laid out by several tasks.
SLICE_SHIFT, COPIES = 52, 65536
#: First line of a record.
BEGIN = re.compile(rb"WARC/\d\.\d\r\n")
#: How a gzip member begins, bytes unpacked at once, and bytes of bodies in a batch.
GZIP, STEP, BATCH_BYTES = b"\x1f\x8b\x08", 1 << 16, 4 << 20


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a page's record."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, record."""
    return pages.select("page_id", "url", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], int, int, str | None]:
    """Headers (names in lower case), begin and end of the body, and what is wrong, of a record that should begin at a place."""
    end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
    if end < 0:
        return {}, at, at, "no header"
    heads = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        name = name.strip().lower()
        if name == "content-length" and name in heads:
            return heads, at, at, "two lengths"  # a header that runs into the next record's
        heads[name] = value.strip()
    n = heads.get("content-length", "")
    if not (n.isascii() and n.isdecimal() and len(n) < 19):
        return heads, at, at, "no length"
    body, stop = end + 4, end + 4 + int(n)
    if stop + 4 > len(data):
        return heads, body, len(data), "cut short"
    return heads, body, stop, None if data.startswith(b"\r\n\r\n", stop) else "wrong length"


def parsed(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes | None, str | None]]:
    """The records in a file's bytes: offset, headers, body, error. A damaged place gives one row with its error and no body, and the
    file goes on at the next place where a record begins."""
    at = 0
    while at < len(data):
        heads, body, stop, error = _record_at(data, at)
        if error is None:
            yield at, heads, data[body:stop], None
            at = stop + 4
            continue
        yield at, heads, None, error
        found = BEGIN.search(data, at + 1)
        if found is None:
            return
        at = found.start()


def members(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """Offset and content of each gzip member of a file (none for a damaged one, after which the next is sought); a file that isn't gzip is one member."""
    if not data.startswith(GZIP):
        yield 0, data
        return
    at, view = 0, memoryview(data)
    while 0 <= at < len(data):
        unpack, out, end = zlib.decompressobj(wbits=31), [], at
        try:
            while not unpack.eof and end < len(data):
                out.append(unpack.decompress(view[end : end + STEP]))
                end = min(end + STEP, len(data))
        except zlib.error:
            out = None
        if out is None or not unpack.eof:
            yield at, None
            at = data.find(GZIP, at + 1)
            continue
        yield at, b"".join(out)
        at = end - len(unpack.unused_data)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: file, offset (in gzip, of the member), url, body, error (null for a whole record; a damaged one has no body).
    Files are read by Spark, each whole in one task as such files are about 1 GB by convention, and parsed where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size, data = [], 0, data.as_py()
                plain = not data.startswith(GZIP)
                for start, content in members(data):
                    for at, heads, body, error in parsed(content) if content is not None else [(0, {}, None, "damaged gzip")]:
                        rows.append((name.as_py(), at if plain else start, heads.get("warc-target-uri"), body, error))
                        size += len(body or b"")
                        if size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    return arrow_map(spark.read.format("binaryFile").load(path).select("path", "content"), run, "file string, offset long, url string, body binary, error string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * 5
    types = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["file", "offset", "url", "body", "error"])


def manifest(pages: DataFrame) -> DataFrame:
    """One row per record: page_id, file, seq, offset, length, sha256. Numbers and offsets are sums over slices of each page_id, then over a slice's records."""
    r = F.col("record")
    rows = records(pages).select("page_id", "url", F.octet_length(r).cast("long").alias("length"), F.sha2(r, 256).alias("sha256"))
    rows = rows.select(
        F.coalesce(F.floor(F.col("page_id") / FILE_IDS), F.lit(-1)).cast("long").alias("file"), F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("own_id"),
        F.when(F.col("url").isNull(), F.xxhash64("sha256")).otherwise(F.xxhash64("url")).alias("place"), "length", "sha256",
    ).withColumn("slice", F.shiftright("place", SLICE_SHIFT))
    key = ["file", "known", "own_id", "slice"]
    equal = staged(rows.groupBy(*key, "place", "sha256").agg(F.min("length").alias("length"), F.count("*").alias("n")), "records")
    n, size = F.col("n"), F.col("n") * F.col("length")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_file, of_slice = Window.partitionBy("file").orderBy("known", "own_id", "slice"), Window.partitionBy(*key).orderBy("place", "sha256")
    slices = equal.groupBy(*key).agg(F.sum(n).alias("n"), F.sum(size).alias("size"))
    slices = slices.select(*key, before("n", of_file).alias("first"), before("size", of_file).alias("base"))
    placed = equal.select(*key, "length", "sha256", "n", before(n, of_slice).alias("rank"), before(size, of_slice).alias("ahead")).join(slices, key)
    placed = staged(placed.select(F.when(F.col("known"), F.col("own_id")).alias("page_id"), "file", (F.col("first") + F.col("rank")).alias("seq"), (F.col("base") + F.col("ahead")).alias("offset"), "length", "sha256", "n"), "placed")
    dropped(equal)
    few = placed.where(n <= COPIES).withColumn("low", F.lit(0).cast("long"))
    many = placed.where(n > COPIES).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(COPIES).cast("long")))).repartition(F.xxhash64("file", "seq", "low"))
    copy = F.explode(F.sequence(F.col("low"), F.least(n, F.col("low") + COPIES) - 1))
    laid = few.unionByName(many).withColumn("copy", copy)
    return laid.select("page_id", "file", (F.col("seq") + F.col("copy")).alias("seq"), (F.col("offset") + F.col("copy") * F.col("length")).alias("offset"), "length", "sha256")


def _above(nodes: DataFrame, file: Column, node: Column) -> DataFrame:
    """The level above nodes (file, node, low, high, hash)."""
    children = F.sort_array(F.collect_list(F.struct("file", "node", "hash")))
    return nodes.groupBy(file.alias("file"), node.alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), children.alias("c")).select(
        "file", "node", "low", "high", F.sha2(F.concat_ws("|", F.col("low").cast("string"), F.col("high").cast("string"), F.array_join(F.transform("c", lambda x: x["hash"]), "|")).cast("binary"), 256).alias("hash")
    )


def tree(records: DataFrame, top_levels: int, file_levels: int = FILE_LEVELS) -> list[DataFrame]:
    """Levels of a manifest's tree, records first, the root last. Keys of a level are file and node; above files, node is 0."""
    level = records.select("file", F.col("seq").alias("node"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"), F.col("sha256").alias("hash"))
    levels = [level]
    for _ in range(file_levels):
        levels.append(staged(_above(levels[-1], F.col("file"), F.floor(F.col("node") / FANOUT)), "tree"))
    for _ in range(top_levels):
        levels.append(staged(_above(levels[-1], F.floor(F.col("file") / FANOUT), F.lit(0).cast("long")), "tree"))
    levels.append(staged(_above(levels[-1], F.lit(0).cast("long"), F.lit(0).cast("long")), "tree"))
    return levels


def _parent(k: int, file_levels: int) -> list[Column]:
    """Key of a node's parent, for a node of level k."""
    if k < file_levels:
        return [F.col("file"), F.floor(F.col("node") / FANOUT)]
    return [F.floor(F.col("file") / FANOUT), F.lit(0).cast("long")]


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records (file, seq) of two manifests that differ or that one of them lacks."""
    reach = left.select("file", "seq").unionByName(right.select("file", "seq")).agg(F.max(F.abs("file")).alias("span"), F.max("seq").alias("last")).first()
    top, file_levels = 0, FILE_LEVELS
    while FANOUT ** (top + 1) <= (reach["span"] or 0) + 1:
        top += 1
    while FANOUT**file_levels <= (reach["last"] or 0):
        file_levels += 1
    a, b = tree(left, top, file_levels), tree(right, top, file_levels)

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("file").alias("file2"), F.col("node").alias("node2"), F.struct("low", "high", "hash").alias("other"))
        same = F.struct("low", "high", "hash").eqNullSafe(F.col("other"))
        return x.join(y, (F.col("file") == F.col("file2")) & (F.col("node") == F.col("node2")), "full").where(~same | F.col("file").isNull() | F.col("file2").isNull()).select(F.coalesce("file", "file2").alias("file"), F.coalesce("node", "node2").alias("node"))

    bad = staged(differing(a[-1], b[-1]), "differing")
    for k in range(len(a) - 2, -1, -1):
        if k == len(a) - 2:
            up = [F.lit(0).cast("long"), F.lit(0).cast("long")]
        else:
            up = _parent(k, file_levels)
        over = bad.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
        side = F.broadcast(over) if over.count() <= BROADCAST_NODES else over
        below = [x.join(side, (up[0] == F.col("up_file")) & (up[1] == F.col("up_node")), "left_semi") for x in (a[k], b[k])]
        bad = staged(differing(*below), "differing")
    return bad.withColumnRenamed("node", "seq")


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of pages: page_id, file, seq, offset, length, sha256, intact (in the replica)."""
    left, right = staged(manifest(pages), "manifest"), staged(manifest(replica), "manifest")
    bad = audit(left, right).select(F.col("file").alias("bad_file"), F.col("seq").alias("bad_seq"))
    return left.join(bad, (F.col("file") == F.col("bad_file")) & (F.col("seq") == F.col("bad_seq")), "left").select("page_id", "file", "seq", "offset", "length", "sha256", F.col("bad_file").isNull().alias("intact"))


def worn(pages: DataFrame, period: int = 1009) -> DataFrame:
    """A replica of pages whose storage has damaged some bodies: of about one page in period, by a digest of its url, the first character is lost. For drills of the audit."""
    hit = F.conv(F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 8), 16, 10).cast("long") % period == 0
    return pages.select("page_id", "url", F.when(hit & (F.length("html") > 0), F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")).alias("html"))
