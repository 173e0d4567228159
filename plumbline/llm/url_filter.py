"""URL filters: fixed host and path rules, and association rules mined from labelled pages.

FP-growth mines combinations of URL tokens (the first host label, host suffixes, path segments, query keys) from
pages with a label; combinations that lead to the label "bad" with enough support and confidence become block
rules, less those that a shorter rule at least as confident makes needless. Rules match by an inverted index
from tokens. A page is labelled by the row of `labels` with its id; it is bad with quality 0 or toxic 1.

Fixed rules come first: a rule fits its host and all subdomains where the path starts with the rule's, and the
longest wins. Defined results: a null url, or one without `://`, has empty host and path. Rows that repeat a
page_id are judged each by its url; null ids stay null and have no label. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, cut, parts

#: (host, path, verdict): fixed values of the contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Fixed rules are part of the plan; a longer list is refused.
MOST_RULES = 5_000
BAD = "#bad"
BROADCAST_ROWS = 100_000


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.translate(F.regexp_extract(url, whole, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, whole, 2).alias("path"),
    )


def _suffixes(host: str) -> str:
    """SQL for the host itself and every parent domain."""
    return f"transform(sequence(1, size(split({host}, '[.]'))), i -> substring_index({host}, '.', -i))"


def fixed_rule(rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest fitting rule, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} fixed rules; at most {MOST_RULES} are taken")
    by_host: dict[str, list] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    if not by_host:
        return F.expr("cast(null as struct<size: int, rule: string, verdict: string>)")
    entries = []
    for host, own in by_host.items():
        structs = [
            F.struct(F.lit(len(host) + len(path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(path).alias("path"))
            for path, verdict in own
        ]
        entries += [F.lit(host), F.array(*structs)]
    found = F.flatten(F.transform(F.expr(_suffixes("host")), lambda s: F.coalesce(F.try_element_at(F.create_map(*entries), s), F.array().cast("array<struct<size:int,rule:string,verdict:string,path:string>>"))))
    fits = F.filter(found, lambda r: F.col("path").startswith(r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def tokens() -> Column:
    """Distinct tokens of host and url: host suffixes and first label, path segments without digits, query keys."""
    return F.expr(
        f"""array_distinct(filter(concat(
            transform({_suffixes("host")}, x -> concat('host:', x)),
            transform(slice(split(host, '[.]'), 1, 1), x -> concat('label:', x)),
            transform(filter(split(path, '/'), x -> x <> '' and not x rlike '[0-9]'), x -> concat('path:', x)),
            transform(regexp_extract_all(url, '[?&]([^=&#]+)=', 1), x -> concat('query:', x))
        ), x -> not endswith(x, ':')))"""
    )


def mined_rules(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_pages: int = 25, min_confidence: float = 0.8) -> DataFrame:
    """rule_id, tokens, confidence and support of block rules that hold on a share and a number of labelled pages."""
    empty = pages.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.bool_or(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    baskets = cut(
        parsed(pages).join(bad, "page_id").select(F.concat(tokens(), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")).filter("size(items) > 0")
    )
    n = baskets.count()
    if n < min_pages:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_pages / n), minConfidence=min_confidence, numPartitions=parts(pages.sparkSession)).fit(baskets)
    rules = cut(
        model.associationRules.filter(F.array_contains("consequent", BAD)).select(
            F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence", "support"
        )
    )
    index = rules.select("rule_id", F.explode("tokens").alias("token"))
    part = rules.select(F.col("rule_id").alias("part_id"), F.col("confidence").alias("part_confidence"), F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    needless = (
        index.join(part, "token")
        .filter("rule_id <> part_id")
        .groupBy("rule_id", "part_id", "n", "part_confidence")
        .count()
        .filter("count = n")
        .join(rules.select("rule_id", "confidence"), "rule_id")
        .filter("part_confidence >= confidence")
        .select("rule_id")
    )
    return rules.join(needless, "rule_id", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow", **mining) -> DataFrame:
    """Every row of `pages`: page_id, host, path, rule, verdict."""
    fixed = fixed_rule(RULES if rules is None else rules)
    read = parsed(pages).withColumn("fixed", fixed)
    mined = cut(mined_rules(pages, labels, **mining))
    result = ["page_id", "host", "path", F.col("fixed.rule").alias("rule")]
    if mined.isEmpty():
        return read.select(*result, F.coalesce("fixed.verdict", F.lit(default)).alias("verdict"))
    index = mined.select("rule_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    urls = read.filter("fixed is null").select("url", "host", "path").distinct()
    blocked = (
        urls.select(F.xxhash64("url").alias("u1"), F.xxhash64("url", F.lit("url")).alias("u2"), F.explode(tokens()).alias("token"))
        .join(index, "token")
        .groupBy("u1", "u2", "rule_id", "n")
        .count()
        .filter("count = n")
        .select("u1", "u2", F.lit("block").alias("mined"))
        .distinct()
    )
    keyed = read.withColumns({"u1": F.xxhash64("url"), "u2": F.xxhash64("url", F.lit("url"))})
    return keyed.join(blocked, ["u1", "u2"], "left").select(*result, F.coalesce("fixed.verdict", "mined", F.lit(default)).alias("verdict"))
