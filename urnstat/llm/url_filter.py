"""URL filter: rules by host and path, and trust carried along links between hosts.

The longest rule that fits a url decides. Where none fits, its host does: trust flows
along links from trusted hosts as personalised PageRank, distrust flows against the
links from blocked hosts, and a host goes when its distrust reaches a threshold and
outweighs its trust. Hosts with an allowed section are trusted and hosts that a rule
blocks as a whole are blocked; a blocked section says nothing about its host.

Built from DataFrame functions only. Links are counted per pair of hosts before any
shuffle, so a page or host with very many links is one row a task and pair, and pages
meet their hosts in a join that adaptive execution splits where a host is hot.

A null url or one without ``://`` has an empty host and path, fits no rule and is
allowed. Null and empty pages have no links. Repeated rows are judged one by one, an
empty table gives no rows, and columns beside the three named ones are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urnstat.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of an absolute link inside markup.
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: Rounds stop where no host changes by more than ``SETTLED`` in ``STEP`` of them. What is left shrinks
#: by ``DAMPING`` a round, so ``ROUNDS`` are enough for any graph; more is an error.
ROUNDS = 400
STEP = 5
SETTLED = 1e-9
DAMPING = 0.85
#: Rounds of the oracle SQL; after them no host is further than ``SETTLED`` from where it settles.
ORACLE_ROUNDS = math.ceil(math.log(SETTLED) / math.log(DAMPING))
#: Least distrust of a host that goes; a blocked host that no other one distrusts has 1 - DAMPING.
LEAST_DISTRUST = 0.05


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: pages' absolute links between different hosts."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return found.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def fitting(hosts: DataFrame, rules: DataFrame, labels: int) -> DataFrame:
    """``host, rules``: of each host, the rules that fit it, longest first.

    Only ends of at most ``labels`` labels, as many as any rule has, are looked up.
    """
    parts = F.split("host", r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), ".")
    )
    found = hosts.select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host")
    size = F.length("rule_host") + F.length("rule_path")
    # Smallest first: longest rule, block before allow, then by name.
    order = F.struct((-size).alias("size"), (F.col("rule_verdict") != "block").alias("allows"), "rule_host", "rule_path", "rule_verdict")
    return found.groupBy("host").agg(F.array_sort(F.collect_set(order)).alias("rules"))


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` once settled, from ``host, trusted, blocked`` (0 or 1)."""
    start = hosts.select("host", *(((1 - damping) * F.col(c)).alias(v) for c, v in (("trusted", "trust"), ("blocked", "distrust"))))
    if edges.isEmpty():
        return start
    leaving = edges.groupBy("src").agg(F.sum("n").alias("all_out"))
    coming = edges.groupBy("dst").agg(F.sum("n").alias("all_in"))
    shared = edges.join(leaving, "src").join(coming, "dst")
    way = lambda kind, a, b, n: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), (F.col("n") / F.col(n)).alias("share"))
    # Trust goes to where a link points, distrust back to where it stands.
    shared = materialize(shared.select(F.inline(F.array(way("trust", "src", "dst", "all_out"), way("distrust", "dst", "src", "all_in")))), "links")
    seeds = start.select("host", F.inline(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("v")) for c in ("trust", "distrust")))))
    seeds = materialize(seeds.where("v > 0").select("kind", "host", "v"), "seeds")
    now, done = seeds, 0
    while True:
        later = now
        for _ in range(STEP):
            moved = shared.join(later, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("share") * F.col("v")).alias("v"))
            later = moved.union(seeds).groupBy("kind", "host").agg(F.sum("v").alias("v"))
        later, done = materialize(later, "trust"), done + STEP
        gone = now.select("kind", "host", F.col("v").alias("old"))
        change = later.join(gone, ["kind", "host"], "left").agg(F.max(F.abs(F.col("v") - F.coalesce("old", F.lit(0.0))))).first()[0]
        now = later
        if (change or 0.0) <= SETTLED:
            break
        if done >= rounds:
            raise RuntimeError(f"trust still changes by {change} after {done} rounds")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("v"))), F.lit(0.0)).alias(kind)
    ranks = now.groupBy("host").agg(of("trust"), of("distrust"))
    return hosts.select("host").join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = LEAST_DISTRUST) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    spark = pages.sparkSession
    rows = spark.createDataFrame([tuple(r) for r in rules], "rule_verdict string, rule_host string, rule_path string")
    labels = max((r.host.count(".") + 1 for r in rules), default=1)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = materialize(links(pages), "host-links")
    named = urls.select("host").union(edges.select("dst")).where("host != ''").distinct()
    has = lambda test: F.exists(F.coalesce("rules", F.array()), test).cast("int")
    whole = has(lambda r: (r["rule_verdict"] == "block") & (r["rule_path"] == "/"))
    allowed = has(lambda r: r["rule_verdict"] == "allow")
    hosts = named.join(fitting(named, rows, labels), "host", "left")
    hosts = materialize(hosts.select("host", "rules", whole.alias("blocked"), (allowed * (1 - whole)).alias("trusted")), "hosts")
    ranks = propagate(hosts.select("host", "trusted", "blocked"), edges)
    goes = (F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))
    known = hosts.select("host", "rules").join(ranks.select("host", goes.alias("goes")), "host")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.get(F.coalesce(fits, F.array()), F.lit(0))
    found = urls.join(known, "host", "left").withColumn("best", best)
    method = F.when(F.coalesce("goes", F.lit(False)), "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.rule_verdict", method).alias("verdict"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts in DuckDB, the rounds as a recursion from the same start."""
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    keep, give = 1 - DAMPING, DAMPING
    lower = f"translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE rules(rv, rh, rp) AS (VALUES {values}),
p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, html, {lower.format(f"regexp_extract(url, '{URL}', 1)")} AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages),
edges AS MATERIALIZED (
  SELECT host AS src, dst, count(*) AS n
  FROM (SELECT host, {lower.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM p)
  WHERE host <> '' AND host <> dst GROUP BY ALL),
weights AS MATERIALIZED (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS o, n / sum(n) OVER (PARTITION BY dst) AS i FROM edges),
names AS (SELECT host FROM p UNION SELECT dst FROM edges),
fits AS (SELECT host, rv, rh, rp FROM names JOIN rules ON host = rh OR suffix(host, '.' || rh)),
seeds AS MATERIALIZED (
  SELECT host, coalesce(blocked, 0) AS blocked, coalesce(allowed, 0) * (1 - coalesce(blocked, 0)) AS trusted
  FROM names LEFT JOIN (
    SELECT host, max(CASE WHEN rv = 'block' AND rp = '/' THEN 1 ELSE 0 END) AS blocked,
           max(CASE WHEN rv = 'allow' THEN 1 ELSE 0 END) AS allowed FROM fits GROUP BY host) USING (host)
  WHERE host <> ''),
ranks AS (
  SELECT 0 AS round, host, ({keep} * trusted)::DOUBLE AS trust, ({keep} * blocked)::DOUBLE AS distrust FROM seeds
  UNION ALL
  SELECT now.round + 1, s.host, ({keep} * trusted + {give} * coalesce(t, 0))::DOUBLE, ({keep} * blocked + {give} * coalesce(d, 0))::DOUBLE
  FROM (SELECT max(round) AS round FROM ranks) now JOIN seeds s ON now.round < {ORACLE_ROUNDS} LEFT JOIN (
    SELECT host, sum(t) AS t, sum(d) AS d FROM (
      SELECT dst AS host, k.trust * w.o AS t, 0.0::DOUBLE AS d FROM weights w JOIN ranks k ON k.host = w.src
      UNION ALL SELECT src, 0.0::DOUBLE, k.distrust * w.i FROM weights w JOIN ranks k ON k.host = w.dst) GROUP BY host
  ) m USING (host)),
best AS (
  SELECT r, rh || rp AS rule, rv FROM p JOIN fits USING (host) WHERE starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rh) + length(rp) DESC, rv <> 'block', rh, rp) = 1)
SELECT page_id, p.host, path, rule,
       coalesce(rv, CASE WHEN distrust >= {LEAST_DISTRUST} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (r) LEFT JOIN ranks k ON k.host = p.host AND k.round = {ORACLE_ROUNDS}"""
