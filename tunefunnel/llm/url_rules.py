"""URL filter: explicit host and path rules first, then association rules that
FP-growth mines from labelled URLs.

A URL becomes a set of tokens (host labels, path parts, query names).  Tokens
that stand on exactly the same labelled URLs form one class and one item, so the
parts of one long URL that repeats are a single item.  FP-growth over the
labelled URLs, with the label as one more item, gives the frequent combinations;
rules ``tokens -> bad`` are pruned by confidence and support, and a rule goes
when a part of its tokens is already a rule.  Rules are matched through an
inverted index on each rule's rarest class: a page meets only the rules of which
it holds a rarest token, and the other classes are then checked in place, so
tokens that nearly all pages share are never joined on.

Frequent tokens of one URL that stand on slightly differing sets of URLs remain
items of their own; FP-growth's work doubles with each one that is not a rule.

Defined cases: a null URL or one without ``://`` has empty host and path and no
tokens, hence no rule and verdict ``allow``; labels that are null are not
learned from; without labels no rule is mined; repeated rows are judged alike;
an empty table gives an empty result.  DataFrame functions and ``pyspark.ml``.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Explicit rules (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Least share of the labelled URLs that hold a rule's tokens and the bad label.
MIN_SUPPORT = 0.005
#: Least share of bad labels among the labelled URLs that hold a rule's tokens.
MIN_CONFIDENCE = 0.8
#: The item that stands for a bad label; no token starts like this.
BAD = "label=bad"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: ``h:`` host labels, ``p:`` path parts,
    ``q:`` names of query fields and ``x:`` the ending of the last path part."""
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)

    def prefixed(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), p))

    return F.array_distinct(F.concat(
        prefixed("h:", F.split(host_of(url), r"\.")),
        prefixed("p:", F.split(path_of(url), "/")),
        prefixed("x:", F.array(F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1))),
        prefixed("q:", F.transform(F.split(query, "[&;]"), lambda p: F.split(p, "=")[0]))))


def explicit_rule(host: Column, path: Column) -> Column:
    """The longest explicit rule that fits, as a struct (rule, verdict), or null."""
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    out = None
    for rule_host, rule_path, verdict in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def token_classes(rows: DataFrame, min_count: int) -> DataFrame:
    """Classes (rep, members, n, n_bad) of the tokens that stand on at least
    ``min_count`` bad rows: tokens on exactly the same rows form one class, told
    by count and 128 bits of their rows' hashes; ``rep`` is its smallest token.
    All members of a class stand on one URL, so a class is no longer than that."""
    tokens = (rows.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"),
                   F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "row")).alias("y"))
              .filter(F.col("n_bad") >= min_count))
    return (tokens.groupBy("n", "n_bad", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("members"))
            .select(F.col("members")[0].alias("rep"), "members", "n", "n_bad"))


def _minimal(sets: DataFrame, min_confidence: float) -> DataFrame:
    """The rules among the frequent ``sets`` (reps, key, n, n_bad) of which no
    proper part is a rule.  By size: a set lies over a rule if one of its parts
    that lack one token is a rule or lies over one itself."""
    sets = written(sets.withColumn("confidence", F.col("n_bad") / F.col("n")), "url-sets")
    is_rule = F.col("confidence") >= min_confidence
    kept, closed = None, None
    for size in range(1, (sets.agg(F.max(F.size("reps"))).first()[0] or 0) + 1):
        level = sets.filter(F.size("reps") == size)
        if closed is None:
            kept, closed = level.filter(is_rule), level.filter(is_rule).select("key")
            continue
        parts = level.select("key", F.explode("reps").alias("out"), "reps").select(
            "key", F.array_join(F.array_remove("reps", F.col("out")), "\x00").alias("part"))
        over = written(parts.join(closed.withColumnRenamed("key", "part"), "part").select("key").distinct(), "url-over")
        found = level.filter(is_rule).join(over, "key", "left_anti")
        kept, closed = kept.unionByName(found), over.unionByName(found.select("key"))
    return sets.limit(0) if kept is None else kept


def mine_class_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
                     min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Minimal rules (rule_id, classes, confidence, support, rarest) from rows of
    ``tokens`` and boolean ``bad``.  A URL fits a rule if it holds a token of each
    of its ``classes``; ``rarest`` is the class on the least labelled URLs, ties
    to the smaller first token.

    FP-growth sees one item for each class, and none for a class that is a rule
    by itself, since no longer set with it can be minimal.
    """
    rows = written(labelled.filter(F.size("tokens") > 0).select(
        F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"),
        F.coalesce("bad", F.lit(False)).alias("bad")), "url-rows")
    n_rows = rows.count()
    min_count = max(1, math.ceil(min_support * n_rows))
    classes = written(token_classes(rows, min_count), "url-classes")
    alone = F.col("n_bad") / F.col("n") >= min_confidence
    single = classes.filter(alone).select(F.array("rep").alias("reps"), F.col("rep").alias("key"), "n", "n_bad",
                                          (F.col("n_bad") / F.col("n")).alias("confidence"))
    items = written(rows.select("row", "bad", F.explode("tokens").alias("rep"))
                    .join(classes.filter(~alone).select("rep"), "rep")
                    .groupBy("row", "bad").agg(F.collect_list("rep").alias("reps"))
                    .select(F.when(F.col("bad"), F.concat("reps", F.array(F.lit(BAD)))).otherwise(F.col("reps")).alias("items")),
                    "url-transactions")
    # rows without an item are no transactions: the share is that of the least count
    support = min(1.0, (min_count - 0.5) / max(1, items.count()))
    frequent = FPGrowth(itemsCol="items", minSupport=support).fit(items).freqItemsets
    frequent = frequent.select(F.sort_array(F.array_remove("items", BAD)).alias("reps"), "freq",
                               F.array_contains("items", BAD).alias("bad")).filter(F.size("reps") > 0)
    sets = (frequent.groupBy(F.array_join("reps", "\x00").alias("key"))
            .agg(F.first("reps").alias("reps"), F.max(F.when(~F.col("bad"), F.col("freq"))).alias("n"),
                 F.max(F.when(F.col("bad"), F.col("freq"))).alias("n_bad")).filter("n_bad IS NOT NULL"))
    rules = _minimal(sets, min_confidence).unionByName(single)
    return (rules.withColumn("rule_id", F.xxhash64("key")).withColumn("rep", F.explode("reps"))
            .join(classes.select("rep", "members", F.col("n").alias("rows")), "rep")
            .groupBy("rule_id").agg(
                F.sort_array(F.collect_list("members")).alias("classes"), F.first("confidence").alias("confidence"),
                (F.first("n_bad") / F.lit(float(max(1, n_rows)))).alias("support"),
                F.min(F.struct("rows", "members"))["members"].alias("rarest")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``mine_class_rules`` spelt out: one row (rule_id, tokens, confidence,
    support) for each choice of a token of every class."""
    rules = mine_class_rules(labelled, min_support, min_confidence)
    chosen = F.aggregate("classes", F.array(F.array().cast("array<string>")), lambda done, members: F.flatten(
        F.transform(done, lambda d: F.transform(members, lambda m: F.concat(d, F.array(m))))))
    return rules.select("rule_id", F.explode(chosen).alias("tokens"), "confidence", "support").withColumn(
        "tokens", F.sort_array("tokens"))


def blocked_ids(pages: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """Per page that some rule matches: its id, the confidence of the best rule
    and the number of rules, through the inverted index on rarest classes."""
    postings = rules.select(F.explode("rarest").alias("token"), "rule_id", "classes", "confidence")
    return (pages.select(id_col, "tokens", F.explode("tokens").alias("token"))
            .join(postings, "token")
            .filter(F.forall("classes", lambda members: F.arrays_overlap(members, F.col("tokens"))))
            .groupBy(id_col).agg(F.max("confidence").alias("confidence"),
                                 F.count_distinct("rule_id").alias("n_rules")))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
          label_id: str = "doc_id", min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, confidence (of the best
    mined rule, null if none).  ``labels`` has quality and toxic (0 or 1); a
    toxic row or one of quality 0 is bad."""
    url = F.col(url_col)
    known = (labels.select(F.col(label_id).alias("__ur_id"),
                           ((F.coalesce(F.col("toxic"), F.lit(0)) == 1)
                            | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("bad"),
                           (F.col("toxic").isNotNull() | F.col("quality").isNotNull()).alias("known"))
             .filter("known").groupBy("__ur_id").agg(F.max("bad").alias("bad")))
    labelled = (pages.select(F.col(id_col).alias("__ur_id"), url.alias("__ur_url"))
                .join(known, "__ur_id")
                .select(tokens_of(F.col("__ur_url")).alias("tokens"), "bad"))
    rules = written(mine_class_rules(labelled, min_support, min_confidence), "url-index")
    distinct = pages.select(url.alias("__ur_url")).distinct()
    hits = blocked_ids(distinct.select("__ur_url", tokens_of(F.col("__ur_url")).alias("tokens")),
                       rules, "__ur_url").select("__ur_url", "confidence")
    explicit = explicit_rule(F.col("host"), F.col("path"))
    judged = (pages.select(F.col(id_col), url.alias("__ur_url"))
              .join(hits, "__ur_url", "left")
              .select(id_col, host_of(F.col("__ur_url")).alias("host"),
                      path_of(F.col("__ur_url")).alias("path"), "confidence")
              .withColumn("__ur_rule", explicit))
    return judged.select(
        id_col, "host", "path", F.col("__ur_rule.rule").alias("rule"),
        F.coalesce(F.col("__ur_rule.verdict"),
                   F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence")
