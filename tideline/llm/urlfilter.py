"""URL filters: path rules first, then trust and distrust over the host graph.

A url that a rule fits takes the rule's verdict. The rest take their host's,
from two propagations over the links between hosts: personalised PageRank from
trusted hosts along the links, and distrust from blocked hosts against the
links, so that hosts that link to blocked ones lose. Seeds are the hosts with
pages that rules allow or block, each with the share of its pages that they
do. A host is blocked where distrust is more than ``threshold`` of the two
together; a host that neither reaches is allowed.

Edges are grouped per host pair in Spark, every step is a join and a grouped
sum, and steps end when all scores together move by no more than ``tolerance``.
The edges are partitioned by source once and by target once and stay so; only
scores move in a step. The edges of a hub are spread over several parts.

Where pages link to no other hosts (as in the given tables) there is nothing to
propagate: the seeds' own hosts keep their scores, and all others are allowed.

Defined cases
- null url or one without "://": empty host and path, no rule, allowed.
- null html: no links. Links to the own host don't count. Other links count once for each page. A link is the first target
  after ``<a``; tags that do not end and pages of any length are read in one pass.
- a host without links out keeps its rank to itself (it is not spread).
- repeated rows: each is judged, and counts as a page of its own.
- ties between rules of one length: the first in the list. Empty input: no rows.
- other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import cut, join_hot

DAMPING, TOLERANCE, MOST_STEPS, THRESHOLD = 0.85, 1e-6, 200, 0.5
#: Edges of one host in one part.
HUB = 1_000_000

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_TARGET = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one, and its verdict; nulls for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # later ones win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): on how many pages of one host there are links to another."""
    # what is before each > is looked at once, from its first <a on, so that tags that never end cost no more than others
    targets = F.transform(F.split(F.col(html_col).cast("string"), ">"), lambda p: F.regexp_extract(F.regexp_extract(p, r"(?is)<a\s(.*)", 1), _TARGET, 1))
    out = F.array_distinct(F.transform(F.filter(targets, lambda x: x != ""), lambda x: F.translate(x, _UPPER, _LOWER)))
    each = pages.filter(F.col(html_col).isNotNull()).select(host_of(F.col(url_col).cast("string")).alias("src"), F.explode(out).alias("dst"))
    return each.filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def host_scores(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = MOST_STEPS, hub: int = HUB) -> DataFrame:
    """(host, trust, distrust): fixed points of the two propagations.

    ``seeds``: host, good, bad (weights, not negative). Each kind is scaled to the sum 1.
    """
    links = cut(links)
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    scaled = seeds.select("host", (F.col("good") / F.lit(total["g"] or 1.0)).alias("g"), (F.col("bad") / F.lit(total["b"] or 1.0)).alias("b"))
    start = F.lit(1 - damping)
    first = [(start * F.col("g")).alias("trust"), (start * F.col("b")).alias("distrust")]
    if links.isEmpty():
        return scaled.na.fill(0.0).select("host", *first)
    parts = lambda side: (1 + F.floor(F.col(side) / F.lit(hub))).cast("int")
    outs = cut(links.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("_out"), F.count(F.lit(1)).alias("_o")))
    ins = cut(links.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("_in"), F.count(F.lit(1)).alias("_i")))
    each = join_hot(links, outs.withColumn("_of", parts("_o")).withColumnRenamed("host", "src"), "src", "_o")
    each = join_hot(each, ins.withColumn("_if", parts("_i")).withColumnRenamed("host", "dst"), "dst", "_i")
    edges = cut(each.select("src", "dst", "_of", "_if", (F.col("n") / F.col("_out")).alias("f"), (F.col("n") / F.col("_in")).alias("r")))
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_src = edges.select(F.col("src").alias("_at"), F.pmod(F.xxhash64("dst"), "_of").cast("int").alias("_s"), F.col("dst").alias("host"), "f").repartition(n, "_at", "_s").persist()
    by_dst = edges.select(F.col("dst").alias("_at"), F.pmod(F.xxhash64("src"), "_if").cast("int").alias("_s"), F.col("src").alias("host"), "r").repartition(n, "_at", "_s").persist()
    sizes = outs.select("host", parts("_o").alias("_of")).join(ins.select("host", parts("_i").alias("_if")), "host", "full")
    hosts = sizes.join(scaled, "host", "full").na.fill(0.0, ["g", "b"]).na.fill(0, ["_of", "_if"])
    now = cut(hosts.select("host", "_of", "_if", "g", "b", *first))
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias("_s")
    for _ in range(most):
        trust = now.filter("_of > 0").select(F.col("host").alias("_at"), "trust", spread("_of"))
        distrust = now.filter("_if > 0").select(F.col("host").alias("_at"), "distrust", spread("_if"))
        forth = by_src.join(trust, ["_at", "_s"]).groupBy("host").agg(F.sum(F.col("trust") * F.col("f")).alias("t"))
        back = by_dst.join(distrust, ["_at", "_s"]).groupBy("host").agg(F.sum(F.col("distrust") * F.col("r")).alias("d"))
        new = now.join(forth, "host", "left").join(back, "host", "left").select(
            "host",
            "_of",
            "_if",
            "g",
            "b",
            F.col("trust").alias("_t"),
            F.col("distrust").alias("_d"),
            (start * F.col("g") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (start * F.col("b") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        new = cut(new)
        moved = new.agg(F.sum(F.abs(F.col("trust") - F.col("_t")) + F.abs(F.col("distrust") - F.col("_d")))).first()[0]
        now = new.drop("_t", "_d")
        if (moved or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"the scores still move by {moved} after {most} steps")
    by_src.unpersist()
    by_dst.unpersist()
    return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD, **how: float) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust."""
    rules = RULES if rules is None else rules
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select(id_col, "host", "path", rule.alias("rule"), said.alias("_said"))
    good, bad = F.sum((F.col("_said") == "allow").cast("double")), F.sum((F.col("_said") == "block").cast("double"))
    seeds = ruled.filter("host != '' AND _said IS NOT NULL").groupBy("host").agg((good / F.count(F.lit(1))).alias("good"), (bad / F.count(F.lit(1))).alias("bad"))
    scores = host_scores(host_links(pages, url_col, html_col), cut(seeds), **how)
    # one row for each host of the pages, and how many these are: the pages of hot hosts stay where they are
    hosts = cut(ruled.groupBy("host").agg(F.count(F.lit(1)).alias("_pages")).join(scores, "host", "left"))
    bad_host = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    own = F.when(F.coalesce(bad_host, F.lit(False)), "block").otherwise("allow")
    return join_hot(ruled, hosts, "host", "_pages").select(
        id_col, "host", "path", "rule", F.coalesce("_said", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
