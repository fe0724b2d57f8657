"""URL filter: prefix rules first, trust and distrust propagated over the hosts' link graph for the rest.

Native: DataFrame functions only. Seeds: a host's share of pages that a rule allows (trust) or blocks (distrust).
Trust follows links (personalised PageRank), distrust runs against them: a page that links to bad hosts is suspect.
A host without a fitting rule is blocked if its distrust exceeds its trust and THRESHOLD times the mass that a mean seed
keeps for itself.

Defined results: null urls and urls without :// have an empty host and path, fit no rule and are allowed; pages without
html have no links; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: (verdict, rule): host and path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.25
#: Parts that a host's pages are split into when they meet their host's verdict.
SALT = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null: none)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, prefix = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict)"""
    ensure_checkpoint_dir(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("by_rule", by_rule)
    bad = blocked_hosts(judged, links(pages), damping, rounds, threshold)
    # hosts with a third of all pages: their pages meet the verdict in SALT parts; ruled pages need none
    salted = bad.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit("block").alias("by_graph"))
    open_ = judged.withColumn("salt", F.when(F.col("rule").isNull(), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int")))
    return open_.join(salted, ["host", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted before they are shuffled."""
    src, _ = host_and_path(F.col("url"))
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(https?://[^/?#\"'\s>]+)"), F.lit(1)))).alias("target")
    dst, _ = host_and_path(F.col("target"))
    return pages.select(src.alias("src"), target).select("src", dst.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def blocked_hosts(judged: DataFrame, edges: DataFrame, damping: float, rounds: int, threshold: float) -> DataFrame:
    """Hosts whose propagated distrust exceeds their trust and the threshold."""
    edges = edges.checkpoint()
    forth = edges.join(edges.groupBy("src").agg(F.sum("n").alias("out")), "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("out")).alias("w"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("n").alias("into")), "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("into")).alias("w"))
    steps = forth.unionByName(back).checkpoint()
    share = judged.where("host <> ''").groupBy("host").agg(F.avg((F.col("by_rule") == "allow").cast("double")).alias("a"), F.count("by_rule").alias("ruled"), F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("good"))
    seeds = share.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("n")).alias("s")), F.struct(F.lit("distrust").alias("kind"), ((F.col("ruled") - F.col("good")) / F.col("n")).alias("s")))).alias("x")).select("host", "x.kind", "x.s").where("s > 0")
    totals = seeds.groupBy("kind").agg(F.sum("s").alias("total"), F.count("*").alias("hosts"))  # two rows
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("s") / F.col("total")).alias("seed"), "hosts").checkpoint()
    base = rank = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    if not steps.isEmpty():
        for k in range(rounds):
            moved = steps.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
            rank = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if k % 4 == 3:
                rank = rank.checkpoint()
    both = rank.join(F.broadcast(totals), "kind").groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score") * F.col("hosts"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score") * F.col("hosts"))), F.lit(0.0)).alias("distrust"),
    )
    return both.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - damping))).select("host")


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
