import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tunefunnel.llm import exact_dedup, repeats

BLANKS = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(BLANKS)].append(r)
    out = []
    for norm, group in groups.items():
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0]))
        sha, left = hashlib.sha256(norm.encode()).hexdigest(), 1
        for r in group:
            kept = r[0] == best[0] and left > 0
            left -= kept
            out.append((r[0], best[0], len(group), kept, sha))
    return Counter(out)


def test_groups_match_brute_force(edge_docs, edge_rows):
    got = exact_dedup.duplicate_groups(edge_docs).collect()
    assert Counter(map(tuple, got)) == brute(edge_rows)


def test_survivors_keep_whole_rows(clashing, edge_rows):
    out = exact_dedup.survivors(clashing)
    assert out.columns == clashing.columns
    kept = [(k[0], k[4]) for k in brute(edge_rows).elements() if k[3]]
    got = [(r["doc_id"], hashlib.sha256((r["text"] or "").translate(BLANKS).encode()).hexdigest())
           for r in out.collect()]
    assert Counter(got) == Counter(kept)


def test_empty_table(no_docs):
    assert exact_dedup.duplicate_groups(no_docs).count() == 0
    assert exact_dedup.survivors(no_docs).count() == 0


def test_hot_group_and_saturated_filter(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_dedup.duplicate_groups(rows)
    assert out.filter("kept").count() == 2001
    assert out.filter("group_size = 1000 and keep_id = 0").count() == 1000
    # A filter that is far too small changes no result.
    keyed = rows.withColumn("k", F.col("text"))
    unique, grouped = repeats.split_repeated(keyed, "k", "doc_id", max_bits=repeats.BUCKET_BITS)
    both = unique.unionByName(grouped)
    assert both.count() == 3000 and both.filter(f"{repeats.SIZE} = 1000").count() == 1000


def test_unique_rows_do_not_shuffle(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    keyed = rows.withColumn("k", F.col("text"))
    n_bits = repeats.filter_bits(2000)
    flagged = repeats.tested(keyed, "k", repeats.repeated_filter(keyed, "k", n_bits), n_bits, "maybe")
    assert flagged.filter("maybe").count() < 40


def test_without(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    gone = spark.createDataFrame([(2,)], "x long")
    assert {r.text for r in repeats.without(rows, "doc_id", gone).collect()} == {"a", "c"}
