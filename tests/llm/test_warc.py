import base64
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunefunnel.llm import warc
from tunefunnel.llm.files import opened
from tunefunnel.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, file string"


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"http://h{i % 7}.example.net/p/{i}?q", f"<p>{i % 30}</p>\r\n\r\nWARC/1.1\r\n") for i in range(80)]
    out += [(100, None, None), (101, "", ""), (102, "x" * 3000, "é日😀"), (103, "a\r\nb", "long" * 50_000),
            (104, "http://h1.example.net/p/1?q", "same url"), (5, "http://other/", "same id"), (None, "n", "no id"),
            (None, "m", "no id"), (110, "u", "no id")]
    out.append(out[3])
    return out


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    best = {}
    for i, _, html in rows:
        key = html or ""
        best[key] = max([best[key], i] if key in best else [i], key=lambda x: (x is not None, x or 0))
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        stays = i == best[html or ""]
        out[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
             "response" if stays else "revisit", None if stays else best[html or ""])] += 1
    return out


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip_matches_brute_force(spark, pages, rows):
    assert Counter(map(tuple, warc.round_trip(spark, pages).select(*COLUMNS).collect())) == brute(rows)


def test_small_blocks_and_files(spark, pages, rows):
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(pages, folder, file_bytes=2000)
    assert captures.select("file").distinct().count() > 3
    index = warc.build_index(captures, block_entries=4)
    assert len(index.directory) >= len(rows) // 4 and index.directory == sorted(index.directory)
    keys = captures.select("urlkey", "page_id")
    assert Counter(map(tuple, warc.read_captures(index, folder, keys).select(*COLUMNS).collect())) == brute(rows)
    one = spark.createDataFrame([(104, "http://h1.example.net/p/1?q"), (999, "http://gone/")], "page_id long, url string")
    got = warc.read_captures(index, folder, one.select(warc.url_key(F.col("url")).alias("urlkey"), "page_id")).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(104, b"same url")]


def test_records_are_valid_members(spark, pages):
    folder = scratch_path(spark, "warc-test")
    capture = warc.write_archives(pages, folder).filter("page_id = 102").first()
    system, root = opened(folder)
    data = system.open_input_file(f"{root}/{capture.file}").read()
    whole = gzip.decompress(data)  # the members make one valid stream
    record = gzip.decompress(data[capture.offset:capture.offset + capture.length])
    assert record in whole and record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    fields, http, payload = warc.parsed(record)
    assert payload == "é日😀".encode() and int(http["Content-Length"]) == len(payload)


def test_minimum_size_and_keys(spark, pages, rows):
    got = warc.round_trip(spark, pages, min_bytes=10_000_000).collect()
    assert {r.record_type for r in got} == {"response"}
    keys = [r[0] for r in spark.createDataFrame([("https://A.b.C:80/x/y?q=1#f",), ("no",), (None,)], "u string")
            .select(warc.url_key(F.col("u"))).collect()]
    assert keys == ["c:80,b,a)/x/y?q=1", "no", ""]


def test_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_repeat_one_key_fill_blocks_of_their_own(spark):
    """Equal URL and page_id, or null page_ids of one URL, over many blocks: each
    block has its own number, and every record is read once."""
    rows = [(7, "http://hot/", f"body {i % 5}") for i in range(60)] + [(None, "http://hot/", "x")] * 30 + [(8, "http://hot/z", "y")]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(4)
    folder = scratch_path(spark, "warc-test")
    index = warc.build_index(warc.write_archives(pages, folder), block_entries=4)
    firsts, numbers = [d[:2] for d in index.directory], [d[2] for d in index.directory]
    assert len(set(firsts)) < len(firsts) == len(set(numbers)) and len(firsts) >= 20
    keys = pages.select(warc.url_key(F.col("url")).alias("urlkey"), "page_id")
    assert Counter(map(tuple, warc.read_captures(index, folder, keys).select(*COLUMNS).collect())) == brute(rows)
