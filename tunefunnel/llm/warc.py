"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record, so that any record can be
read alone.  ``build_index`` sorts the captures by reversed-host URL key (SURT
order, then page_id) into zlib-compressed blocks and keeps a sparse directory
of one entry per block.  ``read_captures`` binary-searches the directory,
opens only the blocks it needs, and reads each record by its byte range.

A payload is the page's html in UTF-8.  Of records with equal payloads of at
least ``min_bytes`` bytes the one with the largest page_id is a ``response``
and the others are ``revisit`` records that refer to it.

Recovery: every task attempt writes files of its own name, and only the rows of
the attempt that succeeded enter the index, so a repeated or lost task leaves at
most files that nothing refers to.  The captures are written before use and are
never recomputed.

Defined cases: null html is the empty payload; a null url has the empty key and
no target URI; rows that repeat a page_id are records of their own, and all rows
that carry the staying page_id are responses; null page_ids never stay before
others; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import repeats
from .common import python_ready, written
from .files import opened
from .url_rules import host_of, path_of

#: Index entries of a block.
BLOCK_ENTRIES = 1000
#: Blocks of the directory at most; beyond that the blocks grow instead, which
#: bounds the broadcast directory at MAX_BLOCKS keys of at most KEY_CHARS.
MAX_BLOCKS = 100_000
#: Longest URL key; a longer one is cut and ends in its MD5.
KEY_CHARS = 256
#: A task starts a new archive file beyond this many bytes.
FILE_BYTES = 64 << 20
#: Archive bytes that a task reads back, about.
READ_BYTES = 4 << 20
#: Date of the records: the tables carry none.
WARC_DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURES = ("urlkey string, page_id long, file string, offset long, length long, "
             "digest string, record_type string, refers_to long")
_PAYLOAD, _NO_ID = "__wa_payload", -(1 << 63)


def url_key(url: Column) -> Column:
    """Reversed-host key: ``https://a.example.net/en/1`` is ``net,example,a)/en/1``."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    key = F.when(F.instr(url, "://") > 0, F.concat(host, F.lit(")"), path_of(url), query)).otherwise(url)
    return F.when(F.length(key) <= KEY_CHARS, key).otherwise(
        F.concat(F.substring(key, 1, KEY_CHARS - 32), F.md5(key)))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, record_type: str, refers_to) -> tuple[bytes, str]:
    """One WARC/1.1 record and the base32 SHA-1 of its payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", record_type), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", WARC_DATE), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if record_type == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                 ("X-Refers-To-Page-ID", str(refers_to))]
    else:
        block += payload
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n", digest


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not the start of a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:]), payload


def _typed(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, html, record_type, refers_to; only possibly repeated
    payloads shuffle."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn(
        _PAYLOAD, F.concat(F.unhex(F.sha1("html")), F.encode(F.octet_length("html").cast("string"), "utf-8"))
    ).withColumn("own", F.struct(F.col("page_id").isNull().alias("no"),
                                 (-F.col("page_id")).alias("neg"), F.col("page_id").alias("id")))
    unique, grouped = repeats.split_repeated(rows, _PAYLOAD, "own")
    stays = F.col("page_id").eqNullSafe(F.col(f"{repeats.BEST}.id"))
    revisit = ~stays & (F.octet_length("html") >= min_bytes)
    parts = [x.select("page_id", "url", "html", revisit.alias("revisit"),
                      F.col(f"{repeats.BEST}.id").alias("best")) for x in (unique, grouped)]
    return parts[0].unionByName(parts[1]).select(
        "page_id", url_key(F.col("url")).alias("urlkey"), "url", "html",
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("revisit"), F.col("best")).alias("refers_to"))


def _writer(folder: str, file_bytes: int):
    schema = pa.schema([("urlkey", pa.string()), ("page_id", pa.int64()), ("file", pa.string()),
                        ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        name, out, at = "", None, 0
        try:
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data, digest = record(r["page_id"], r["url"], r["html"].encode("utf-8"),
                                          r["record_type"], r["refers_to"])
                    member = gzip.compress(data, compresslevel=6, mtime=0)
                    out.write(member)
                    rows.append((r["urlkey"], r["page_id"], name, at, len(member), digest,
                                 r["record_type"], r["refers_to"]))
                    at += len(member)
                columns = list(zip(*rows)) or [[] for _ in schema]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives below ``folder``; their captures (urlkey, page_id,
    file, offset, length, digest, record_type, refers_to), as a written table."""
    spark = pages.sparkSession
    python_ready(spark)
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    typed = _typed(pages, id_col, url_col, html_col, min_bytes)
    return written(typed.mapInArrow(_writer(folder, file_bytes), _CAPTURES), "captures")


class Index:
    """A built capture index: the block table and the sparse directory, whose
    entries are the first (urlkey, page_id) of each block and its number, in key
    order.  Blocks may share a first key; their numbers differ."""

    def __init__(self, blocks: DataFrame, directory: list[tuple[str, int, int]]):
        self.blocks, self.directory = blocks, directory


def _packer(entries: int):
    schema = pa.schema([("first_key", pa.string()), ("first_id", pa.int64()),
                        ("n", pa.int64()), ("bytes", pa.int64()), ("block", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def block(rows):
            data = zlib.compress("\n".join(json.dumps(x) for x in rows).encode(), 6)
            return pa.record_batch([[rows[0][0]], [rows[0][1]], [len(rows)], [sum(r[5] for r in rows)], [data]],
                                   schema=schema)

        for batch in batches:
            held += map(list, zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) >= entries:
                yield block(held[:entries])
                held = held[entries:]
        if held:
            yield block(held)

    return pack


def build_index(captures: DataFrame, block_entries: int = BLOCK_ENTRIES,
                max_blocks: int = MAX_BLOCKS) -> Index:
    """Sort the captures by key into compressed blocks and keep the directory.

    The sort is on (urlkey, page_id, file, offset), so one URL that a third of
    all rows share spreads over many partitions and blocks.  The directory
    holds one entry per block, a number bounded by ``max_blocks`` plus the
    number of partitions."""
    n = captures.count()
    entries = max(block_entries, -(-n // max_blocks))
    order = ["urlkey", "sort_id", "file", "offset"]
    parts = max(1, min(-(-n // entries), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = captures.select(
        "urlkey", F.coalesce("page_id", F.lit(_NO_ID)).alias("sort_id"), "page_id", "file",
        "offset", "length", "digest", "record_type", "refers_to")
    blocks = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .mapInArrow(_packer(entries), "first_key string, first_id long, n long, bytes long, block binary")
                     .withColumn("number", F.monotonically_increasing_id()), "capture-blocks")
    directory = sorted((r.first_key, r.first_id, r.number)
                       for r in blocks.select("first_key", "first_id", "number").collect())
    return Index(blocks, directory)


def _search(directory):
    """Requests (urlkey, sort_id) with the numbers of the blocks that can hold them."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [entry[:2] for entry in directory.value]
        numbers = [entry[2] for entry in directory.value]
        for batch in batches:
            out = []
            for want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Equal keys may reach over several blocks: all of them, and
                # the block before the first of them, which may end in the key.
                first, last = bisect.bisect_left(keys, want), bisect.bisect_right(keys, want)
                out += [(*want, number) for number in numbers[max(0, first - 1):last]]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                names=["urlkey", "sort_id", "number"])

    return search


def _from_blocks(key, requests: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    wanted = set(zip(requests["urlkey"], requests["sort_id"]))
    rows = [row for data in blocks["block"] for row in map(json.loads, zlib.decompress(data).decode().split("\n"))
            if (row[0], row[1]) in wanted]
    return pd.DataFrame([(r[3], r[4], r[5]) for r in rows], columns=["file", "offset", "length"]).astype(
        {"offset": "int64", "length": "int64"})


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                        ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if file != name:
                    name, source = file, system.open_input_file(f"{root}/{file}")
                fields, http, payload = parsed(gzip.decompress(source.read_at(length, offset)))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload at {file}:{offset} does not have its digest")
                number = lambda x: None if x is None else int(x)
                rows.append((number(fields.get("X-Page-ID")), int(http["Content-Length"]), digest, kind,
                             number(fields.get("X-Refers-To-Page-ID")), fields.get("WARC-Target-URI"),
                             payload if kind == "response" else None))
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return read


def read_captures(index: Index, folder: str, requests: DataFrame) -> DataFrame:
    """The records of the requested (urlkey, page_id) pairs: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url, payload (null
    for a revisit).  Pairs that were never captured give no row."""
    spark = requests.sparkSession
    python_ready(spark)
    directory = spark.sparkContext.broadcast(index.directory)
    wanted = requests.select("urlkey", F.coalesce("page_id", F.lit(_NO_ID)).alias("sort_id")).distinct()
    found = wanted.mapInArrow(_search(directory), "urlkey string, sort_id long, number long")
    places = (found.groupBy("number").cogroup(index.blocks.groupBy("number"))
              .applyInPandas(_from_blocks, "file string, offset long, length long"))
    # Reads are dealt by bytes: about READ_BYTES of archive a task.
    total = index.blocks.agg(F.sum("bytes")).first()[0] or 0
    placed = (places.repartition(max(1, -(-total // READ_BYTES)), "file", F.expr(f"offset div {READ_BYTES // 4}"))
              .sortWithinPartitions("file", "offset"))
    return placed.mapInArrow(
        _reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, url string, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages``, index them and read every page's record
    back by its key."""
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, folder, id_col, url_col, html_col, min_bytes)
    requests = pages.select(url_key(F.col(url_col)).alias("urlkey"),
                            F.col(id_col).cast("long").alias("page_id"))
    return read_captures(build_index(captures), folder, requests)
