"""URL filters by rules and, where no rule fits, by link-graph propagation over hosts, in DataFrame expressions only.

Trust spreads along links from hosts whose pages the rules mostly allow, distrust against the links from hosts whose pages
they mostly block: two personalised PageRanks over the same host edges. A host whose distrust outweighs its trust, and is
more than THRESHOLD times an even share, is blocked.

Edges are absolute links between hosts in the pages' href attributes, and both ways between a host and the host one label
up, if that is a page's host too and has LEAST_LABELS labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import query, table

# The contract's rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Share of a host's pages that makes it a seed; PageRank's damping, most rounds (changes shrink by DAMPING a round, so that 200
# are not reached below 1e9 hosts) and the change, in even shares, at which it ends; distrust against trust and against an even
# share at which a host is blocked; least labels of a host that counts as above its subdomains.
SEED_SHARE, DAMPING, ROUNDS, LEAST_CHANGE, OVER_TRUST, THRESHOLD, LEAST_LABELS = 0.5, 0.85, 200, 1e-5, 1.0, 0.25, 2
# Hosts up to this number are broadcast to the pages; more are joined by shuffling.
BROADCAST_HOSTS = 100_000
# Rounds between two looks at how far ranks have moved.
LOOK = 4

_HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule whose host is the url's or above it and whose path begins the url's; else NULL."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts counted, and 1 for a host and the host above it."""
    links = F.filter(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_HREF), F.lit(1)),
                     lambda x: x.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    linked = (pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.transform(
        links, lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x))))).alias("dst"))
        .filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    hosts = pages.select(host_of(F.col(url_col)).alias("src")).filter("src <> ''").distinct()
    above = (hosts.withColumn("dst", F.regexp_replace("src", r"^[^.]*\.", ""))
             .filter((F.size(F.split("dst", r"\.")) >= LEAST_LABELS) & (F.col("src") != F.col("dst")))
             .join(hosts.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1.0).alias("weight")))
    both = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, hosts: int | None = None) -> DataFrame:
    """(kind, host, rank) for edges (kind, src, dst, weight) and seeds (kind, host, share); ranks of a kind sum to 1.

    Rank that has no edge to leave by goes back to the seeds, which only scales all ranks of its kind: so a round adds the seeds'
    shares to what moves along the edges, and the sum is divided out at the end. Every round is one join and one aggregation with
    partial sums, written before the next, so that both sides of a join are plain tables whose hot hosts Spark can split. It ends
    when no rank has moved by LEAST_CHANGE of an even share over `hosts` (those of the edges and seeds, if not given) in LOOK
    rounds; a graph that has not come to rest after ROUNDS is refused.
    """
    out = land(edges.groupBy("kind", "src").agg(F.sum("weight").alias("total")), "rank-totals")
    steps = land(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share")), "rank-edges")
    seeds = land(seeds, "rank-seeds")
    if hosts is None:
        hosts = steps.select("host").unionByName(steps.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct().count()
    given = seeds.select("kind", "host", F.col("share").alias("part"))
    ranks = before = given.withColumnRenamed("part", "rank")
    for turn in range(1, ROUNDS + 1):
        moved = ranks.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("part"))
        ranks = land(moved.unionByName(given).groupBy("kind", "host").agg(F.sum("part").alias("rank")), "rank-round")
        if turn % LOOK == 1:
            both = ranks.select("kind", "host", "rank").unionByName(before.select("kind", "host", (-F.col("rank")).alias("rank")))
            change = both.groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("change")).agg(F.max("change")).first()[0]
            if (change or 0.0) < LEAST_CHANGE / max(1, hosts):
                break
            before = ranks
    else:
        raise RuntimeError(f"ranks still move after {ROUNDS} rounds")
    sums = land(ranks.groupBy("kind").agg(F.sum("rank").alias("sum")), "rank-sums")  # a row a kind
    return ranks.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("sum")).alias("rank"))


def host_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, trust, distrust, blocked) of every host with a page."""
    named = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).filter("host <> ''")
    counts = land(named.withColumn("verdict", rule_for(F.col("host"), F.col("path"), rules)["verdict"]).groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("denied")), "host-counts")
    sides = [("trust", "allowed"), ("distrust", "denied")]
    total = counts.agg(F.count("*").alias("hosts"), *[F.sum(F.when(F.col(c) > SEED_SHARE * F.col("n"), F.col(c))).alias(k) for k, c in sides]).first()
    seeds = reduce(DataFrame.unionByName, [
        counts.filter(F.col(c) > SEED_SHARE * F.col("n")).select(F.lit(k).alias("kind"), "host", (F.col(c) / F.lit(float(total[k] or 1))).alias("share"))
        for k, c in sides])
    edges = land(host_edges(pages, url_col, html_col), "host-edges")
    directed = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ranks = personalised_rank(directed, seeds, total["hosts"]).groupBy("host").agg(
        *[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k, _ in sides])
    even = THRESHOLD / max(1, total["hosts"])
    return (counts.select("host").join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
            .withColumn("blocked", (F.col("distrust") > OVER_TRUST * F.col("trust")) & (F.col("distrust") > even)))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
           html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row of `pages`.

    A NULL url, or one without `://`, has an empty host and path, no rule, and is allowed. NULL html has no links. Repeated rows
    count as pages of their own; an empty table gives no rows.
    """
    hosts = land(host_verdicts(pages, rules, url_col, html_col).filter("blocked").select("host"), "blocked-hosts")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    read = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = read.withColumn("fitting", rule_for(F.col("host"), F.col("path"), rules))
    return (ruled.join(hosts.withColumn("blocked", F.lit(True)), "host", "left")
            .select(id_col, "host", "path", F.col("fitting.rule").alias("rule"),
                    F.coalesce(F.col("fitting.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict")))


@query("op10_host_trust")
def op10(spark, sf_dir):
    """page_id, host, path, rule, verdict of every page."""
    return judged(table(spark, sf_dir, "pages"))
