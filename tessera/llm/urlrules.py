"""URL filter by association rules.

URLs become sets of tokens (host labels, path words, query keys; tokens of digits alone are left out). FP-growth
over the labelled pages mines token combinations together with the item BAD; rules "tokens imply
BAD" are pruned by support, confidence and lift. Tokens that occur in the very same labelled pages
are one class and are mined as one item, as any choice among them has the same figures: so a run of
tokens that always come together gives one item, not a power set, and no rule is lost, since any
member may stand for its class when rules are matched. Matching uses an inverted index: each rule is
filed under its rarest class, so a URL meets only the rules filed under one of its tokens, and
those of whose other classes it holds a member too apply. Rules given by hand come first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize

BAD, MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = "!bad", 10, 0.0005, 0.8, 1.5
#: At most about so many labelled URLs are mined (a hash of the URL decides which).
MAX_LABELLED = 2_000_000
# The rules given by hand (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def hand_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` host labels and their dashed parts, ``p:`` path words, ``q:`` query keys; long ones by their hash."""
    short = lambda x: F.when(F.length(x) < 64, x).otherwise(F.concat(F.lit("#"), F.hex(F.xxhash64(x))))
    keep = lambda a, mark: F.transform(F.filter(a, lambda x: x.rlike("[^0-9]")), lambda x: F.concat(F.lit(mark), short(x)))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    return F.array_distinct(
        F.concat(
            keep(F.split(host_of(url), r"[.:@]"), "h:"),
            keep(F.split(host_of(url), r"[.:@_-]"), "h:"),
            keep(F.split(F.lower(path_of(url)), r"[/._~+-]"), "p:"),
            keep(F.transform(F.split(F.lower(query), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), "q:"),
        )
    )


def mine(labelled: DataFrame, min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (antecedent, members, keys, confidence, support, lift) from ``labelled(url, bad)``.

    antecedent names each class of tokens by its first; members are all of each class, keys those
    of the rarest. A null url or label is left out. Without rows, or without bad ones, there are no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and bad is not null")
    n = rows.count()
    if n > MAX_LABELLED:
        rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * MAX_LABELLED / n))
    none = spark.createDataFrame([], "antecedent array<string>, members array<array<string>>, keys array<string>, confidence double, support double, lift double")
    rows = materialize(rows.select(tokens(F.col("url")).alias("tokens"), "bad").withColumn("row", F.monotonically_increasing_id()), "items")
    n = rows.count()
    if not n:
        return none
    support = min(1.0, max(min_support, min_count / n))
    each = rows.select("row", F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64(F.lit(1), "row").cast("decimal(38,0)")).alias("y"))
    marks = marks.where(F.col("freq") >= support * n * (1 - 1e-9))
    classes = marks.groupBy("freq", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("members"))
    classes = materialize(classes.select(F.element_at("members", 1).alias("item"), "members", "freq"), "classes")
    baskets = each.join(classes.select("item", F.explode("members").alias("token")), "token").groupBy("row").agg(F.collect_set("item").alias("held"))
    none_held = F.array().cast("array<string>")
    items = rows.select("row", "bad").join(baskets, "row", "left")
    items = materialize(items.select(F.concat(F.coalesce("held", none_held), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none_held)).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") >= min_lift)).select("antecedent", "confidence", "support", "lift")
    found = materialize(found.withColumn("rule", F.concat_ws(" ", F.array_sort("antecedent"))), "rules")
    if found.isEmpty():
        return none
    filed = found.select("rule", F.explode("antecedent").alias("item")).join(classes, "item").groupBy("rule")
    filed = filed.agg(F.collect_list("members").alias("members"), F.min_by("members", F.struct("freq", "item")).alias("keys"))
    return found.join(filed, "rule").select("antecedent", "members", "keys", "confidence", "support", "lift")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``urls(url)`` to which a rule applies, with the best confidence."""
    held = urls.select("url").distinct().withColumn("tokens", tokens(F.col("url"))).withColumn("key", F.explode("tokens"))
    hits = held.join(rules.withColumn("key", F.explode("keys")), "key").where(F.forall("members", lambda m: F.arrays_overlap(m, "tokens")))
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(id, url, host, path, rule, verdict, confidence): a verdict on every row of ``pages``.

    A labelled page is bad if its quality is 0 or it is toxic. Nulls: a null url has an empty host
    and path, fits no rule and is allowed; a null id is carried; a null label counts as not bad,
    and a page with two labels is bad if one says so. Repeated rows get the same verdict. Empty
    tables: without pages no rows, without labels the rules by hand alone. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    marks = labels.select(F.col(label_id_col).cast("long").alias("id"), (F.coalesce(F.col(quality_col) == 0, F.lit(False)) | F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("bad"))
    marks = marks.where("id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    rules = materialize(mine(rows.join(marks, "id").select("url", "bad")), "mined")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = hand_rule(F.col("host"), F.col("path"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": name, "hand": verdict})
    hits = materialize(matched(rows.where("rule is null and url is not null"), rules), "hits")
    rows = rows.join(hits, "url", "left")
    verdict = F.coalesce("hand", F.when(F.col("confidence").isNotNull() & F.col("rule").isNull(), "block"), F.lit("allow"))
    return rows.select("id", "url", "host", "path", "rule", verdict.alias("verdict"), "confidence")
