"""URL filter: rules first, then trust and distrust over the graph of hosts.

Rules. (host, path) fits a host and its subdomains where the url's path starts with the rule's; the longest (host and path together) wins.

Graph. Absolute and protocol-relative links of the pages give edges between hosts, weighted by the number of linking pages and counted before any shuffle of rows by host. Trust is personalised
PageRank along the links from trusted seeds, the hosts most of whose pages a rule allows; distrust is the same against the links from blocked seeds, the hosts most of
whose pages a rule blocks: who links to a bad host is bad. Seeds weigh alike. Mass that reaches a host without links goes back to the seeds: that only multiplies all ranks alike, so they are summed up without it
and divided by their sum. Rounds are DataFrame joins and sums; each `every` rounds the ranks are written to the shared folder. They end when all reachable hosts have a rank and what still
moves can't add more than `tolerance` of its rank to any host; doubles hold some 4,000 links in a row. A host is blocked if its distrust is above `threshold` times its trust, however small both are; others, such as those no seed reaches, are allowed.

Cases. A null url, or one without ://, has empty host and path; no rule fits an empty host unless a rule is empty, and the graph has no opinion on it: allow. Null html has no links. Repeated rows
get a row each and count as pages each.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, written

#: Fixed rules of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What stands behind the first ://, or null."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """df with rule (text like net/) and rule_verdict, of the longest rule that fits host and path; null without one."""
    pick = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        pick = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(pick)
    return df.withColumn("_rule", pick).withColumns({"rule": F.col("_rule.rule"), "rule_verdict": F.col("_rule.verdict")}).drop("_rule")


def host_edges(pages: DataFrame) -> DataFrame:
    """pages: host, html -> src, dst, weight: how often pages of src link to another host."""
    links = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), F.lit(1)))).alias("url"))
    dst = host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url")))
    return links.select("src", dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85, every: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """edges: src, dst, weight; seeds: host, seed (their sum is 1) -> host, rank. Hosts that no seed reaches are left out. At most `rounds` rounds, if given. Edges are merged, as written
    tables of repeated hosts take far less room than their rows do in memory, and Spark's size check would broadcast them."""
    total = edges.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("total"))
    passed = edges.hint("merge").join(total, F.col("src") == F.col("s")).select("src", "dst", (damping * F.col("weight") / F.col("total")).alias("part"), F.lit(0.0).alias("stay"))
    if not edges.limit(1).count():
        return seeds.select("host", F.col("seed").alias("rank"))
    # a step from each host to itself carries what it has, so that a round is one join
    hosts = edges.select("src").union(edges.select("dst")).union(seeds.select("host")).distinct()
    steps = written(passed.unionByName(hosts.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("part"), F.lit(1.0).alias("stay"))), "host-steps")
    rank = seeds.select("host", F.col("seed").alias("rank"), F.col("seed").alias("moved"))
    for k in itertools.count(1):
        moved = F.sum(F.col("moved") * F.col("part"))
        rank = rank.join(steps.hint("merge"), F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("stay")) + moved).alias("rank"), moved.alias("moved"))
        if k % every == 0 or k == rounds:
            rank = written(rank, "host-ranks")
            mass, moving, least = rank.agg(F.sum("rank"), F.sum("moved"), F.min("rank")).first()  # single numbers
            if k == rounds or not moving or moving * damping / (1 - damping) <= tolerance * least and not newly_reached(rank, steps):
                return rank.select("host", (F.col("rank") / (mass or 1.0)).alias("rank"))


def newly_reached(rank: DataFrame, steps: DataFrame) -> bool:
    """Whether a link leads from the hosts of rank to one that isn't among them."""
    ahead = steps.join(rank.select(F.col("host").alias("src")), "src", "left_semi").select(F.col("dst").alias("host"))
    return bool(ahead.join(rank, "host", "left_anti").limit(1).count())


def judged(pages: DataFrame, rules=RULES, threshold: float = 1.0) -> DataFrame:
    """pages: page_id, url, html -> page_id, host, path, rule, verdict, trust, distrust."""
    named = ruled(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    hosts = written(named.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad")), "hosts")
    edges = written(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")), "host-edges")
    ranks = hosts.select("host")
    for side, name, graph in (("good", "trust", edges), ("bad", "distrust", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))):
        chosen = hosts.where(2 * F.col(side) > F.col("pages"))
        seeds = chosen.select("host", F.lit(1.0 / max(chosen.count(), 1)).alias("seed"))
        ranks = ranks.join(personalised_rank(graph, seeds).select("host", F.col("rank").alias(name)), "host", "left")
    ranks = ranks.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    graph = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    out = named.join(written(ranks, "host-verdicts"), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", graph).alias("verdict"), "trust", "distrust")


def op6_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(load(spark, sf_dir, "pages"))


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph of hosts with links, which the pages lack: customers link to the suppliers they bought from, once for each line, and suppliers to the customers of their nation whose key ends
    with the same two digits. Seeds: the customers of one market segment whose key ends with 7."""
    orders, lines = (load(spark, sf_dir, t) for t in ("orders", "lineitem"))
    customer, supplier = (load(spark, sf_dir, t) for t in ("customer", "supplier"))
    c, s = F.concat(F.lit("c"), F.col("c_custkey"), F.lit(".example")), F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".example"))
    bought = lines.hint("merge").join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy(F.concat(F.lit("c"), "o_custkey", F.lit(".example")).alias("src"), F.concat(F.lit("s"), "l_suppkey", F.lit(".example")).alias("dst"))
    near = supplier.join(customer, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") % 100 == F.col("c_custkey") % 100)).select(s.alias("src"), c.alias("dst"), F.lit(2.0).alias("weight"))
    chosen = customer.where("c_mktsegment = 'BUILDING' and c_custkey % 10 = 7").select(c.alias("host"))
    seeds = chosen.withColumn("seed", F.lit(1.0 / max(chosen.count(), 1)))
    return bought.agg(F.count("*").cast("double").alias("weight")).unionByName(near), seeds


def trust_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of eight rounds over trade_graph along its links and against them."""
    edges, seeds = trade_graph(spark, sf_dir)
    edges = written(edges, "trade-edges")
    along = personalised_rank(edges, seeds, rounds=8).select("host", F.round("rank", 9).alias("trust"))
    against = personalised_rank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), seeds, rounds=8).select("host", F.round("rank", 9).alias("distrust"))
    return along.join(against, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def rounds_sql(edges: str, name: str, rounds: int = 8) -> str:
    """The rounds one by one: m0 the seeds, each next one what the last passes on; a host's rank is the sum over the rounds it was reached in, as a share of all."""
    tables = [f"{name}p AS (SELECT src, dst, 0.85::DOUBLE * weight / sum(weight) OVER (PARTITION BY src) AS part FROM {edges})", f"{name}0 AS (SELECT host, 1.0::DOUBLE / count(*) OVER () AS m FROM seeds)"]
    tables += [f"{name}{k} AS (SELECT dst AS host, sum(m * part) AS m FROM {name}{k - 1} JOIN {name}p ON src = host GROUP BY dst)" for k in range(1, rounds + 1)]
    every = " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(rounds + 1))
    return ", ".join([*tables, f"{name} AS (SELECT host, round(sum(m) / (SELECT sum(m) FROM ({every})), 9) AS rank FROM ({every}) GROUP BY host)"])


TRUST_SQL = f"""
WITH e AS (SELECT 'c' || o_custkey || '.example' AS src, 's' || l_suppkey || '.example' AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
UNION ALL SELECT 's' || s_suppkey || '.example', 'c' || c_custkey || '.example', 2.0::DOUBLE FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 100 = c_custkey % 100),
r AS (SELECT dst AS src, src AS dst, weight FROM e), seeds AS (SELECT 'c' || c_custkey || '.example' AS host FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 10 = 7),
{rounds_sql("e", "t")}, {rounds_sql("r", "d")}
SELECT host, coalesce(t.rank, 0) AS trust, coalesce(d.rank, 0) AS distrust FROM t FULL JOIN d USING (host)
"""
