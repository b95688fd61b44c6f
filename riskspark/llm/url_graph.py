"""URL filters: longest-match rules, and trust and distrust spread over host links by personalised PageRank. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import ascii_lower, broadcast_within, materialize

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def parse_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty if the url is null or has no ://."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _suffixes(host: str):
    labels = F.split(F.col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule (host and path of the longest rule that fits, else null) and action. pages has host and path.

    A rule fits its host and all subdomains if the path starts with the rule's; rules of equal length rank by text, block before allow.
    Rules are looked up once for each distinct host and sent back to its pages.
    """
    hosts = pages.select("host").distinct().withColumn("suffix", F.explode(_suffixes("host")))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "action", F.concat("host", "path").alias("rule"))
    fits = hosts.join(broadcast_within(named), "suffix").groupBy("host").agg(
        F.collect_list(F.struct(F.length("rule").alias("len"), "rule", (F.col("action") == "block").alias("b"), "prefix", "action")).alias("_rules")
    )
    joined = pages.join(broadcast_within(materialize(fits, "host-rules"), 64 + 128 * F.size("_rules")), "host", "left")
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    return joined.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_rules", "_best")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, w): links between different hosts, counted over pages, and one edge each way between a host and its parent domain."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("raw"))
    links = links.select("src", F.rtrim(ascii_lower(F.regexp_extract("raw", r"^(?:[^@]*@)?([^:]*)", 1)), F.lit(".")).alias("dst"))
    links = links.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    links = materialize(links, "host-links")
    hosts = pages.where("host <> ''").select("host").union(links.select("dst")).distinct()
    tree = hosts.select(F.explode(F.filter(_suffixes("host"), lambda s: F.instr(s, ".") > 0)).alias("host")).distinct()
    tree = tree.select("host", F.regexp_replace("host", r"^[^.]*\.", "").alias("parent")).where(F.instr("parent", ".") > 0)
    up = tree.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("w"))
    both = links.union(up).union(up.select(F.col("dst"), F.col("src"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 15, every: int = 5) -> DataFrame:
    """(host, trust, distrust): personalised PageRank along the edges from trusted seeds and against them from blocked seeds.

    seeds: (host, trusted, blocked), weights of 0 or more. Mass that reaches a host without edges leaves the walk.
    """
    ways = edges.select(F.lit("t").alias("kind"), "src", "dst", "w").union(edges.select(F.lit("d"), F.col("dst"), F.col("src"), "w"))
    out = ways.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    ways = materialize(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("p")), "host-edges")
    start = seeds.select(F.lit("t").alias("kind"), "host", F.col("trusted").cast("double").alias("r")).union(seeds.select(F.lit("d"), "host", F.col("blocked").cast("double"))).where("r > 0")
    mass = start.groupBy("kind").agg(F.sum("r").alias("all"))  # two rows
    start = materialize(start.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("r") / F.col("all")).alias("r")), "host-seeds")
    rank = start
    for k in range(1, rounds + 1):
        moved = ways.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (damping * F.col("r") * F.col("p")).alias("r"))
        rank = moved.union(start.select("kind", "host", (1 - damping) * F.col("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if k % every == 0:
            rank = materialize(rank, "host-ranks")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("r")).otherwise(0.0))
    return rank.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, verdict (allow or block), trust and distrust to every page; columns of these names are replaced.

    A page that a rule fits gets the rule's verdict. Otherwise its host decides: block if distrust / (trust + distrust), rounded
    to 9 digits, is over the threshold; hosts that nothing reaches are allowed. Hosts of allowed and blocked pages are the
    seeds, weighted by pages. Pages with null urls, or urls without ://, have an empty host and are allowed unless a rule says so.
    Repeated rows are judged alike; null pages hold no links, html of any length is searched whole; an empty input gives an empty result.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "trust", "distrust", "action")
    kept = pages.columns
    ruled = apply_rules(parse_urls(pages, url), rules)
    facts = materialize(ruled.groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("trusted"), F.count_if(F.col("action") == "block").alias("blocked")).where("host <> ''"), "host-facts")
    scores = materialize(propagate(host_edges(parse_urls(pages, url), html), facts), "host-scores")
    out = ruled.join(broadcast_within(scores), "host", "left").fillna(0.0, ["trust", "distrust"])
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    by_host = F.when(F.col("trust") + F.col("distrust") > 0, F.when(share > threshold, "block").otherwise("allow")).otherwise("allow")
    return out.select(*kept, "host", "path", "rule", F.coalesce("action", by_host).alias("verdict"), "trust", "distrust")
