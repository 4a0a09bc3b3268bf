"""Slice ingestion: batch vs streaming (S-01, S-06/S-07, U-01), URI rules
(P-02, P-03), overwrite sinks (K19)."""
import tempfile

from pyspark.sql import functions as F

from tunefunnel.operators import ingest as I
from tunefunnel.sources import slices as SL
from tunefunnel.streaming.slices import ingest_slices_stream
from data_dirs import SF001


def test_stream_one_batch_per_file_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="tf-slices-")
    glob = SL.write_slices_from_tables(spark, SF001, f"{root}/src", orders_per_slice=300)
    n_files = len(spark.sparkContext.wholeTextFiles(glob).keys().collect())
    assert n_files >= 3
    batch = I.flatten_slices(SL.read_slices(spark, glob))
    q = ingest_slices_stream(spark, glob, f"{root}/sink", f"{root}/ckpt", files_per_trigger=1)
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == n_files
    streamed = spark.read.parquet(f"{root}/sink")
    assert batch.exceptAll(streamed).count() == 0 and streamed.exceptAll(batch).count() == 0
    # a restart with the same checkpoint ingests nothing twice (exactly once per file)
    ingest_slices_stream(spark, glob, f"{root}/sink", f"{root}/ckpt", files_per_trigger=1)
    assert spark.read.parquet(f"{root}/sink").count() == batch.count()


def test_uri_rules(spark):
    df = spark.createDataFrame([("spotify:track:spotify:track:7",), ("spotify:track:8",), ("9",)], ["u"])
    got = df.select(I.strip_uri_prefix(F.col("u")).alias("c"), I.last_uri_segment(F.col("u")).alias("l")).collect()
    assert [(r.c, r.l) for r in got] == [("spotify:track:7", "7"), ("8", "8"), ("9", "9")]


def test_sinks_overwrite(spark):
    path = tempfile.mkdtemp(prefix="tf-sink-") + "/t"
    df = spark.range(5)
    SL.write_table(df, path)
    SL.write_table(df, path)
    assert spark.read.parquet(path).count() == 5
