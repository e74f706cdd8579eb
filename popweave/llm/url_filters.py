"""URL filters: host and path rules, and link-graph propagation for urls without a rule, in DataFrame operations only.

Pages that rules allow or block are the seeds. Over the weighted host graph (links of the html, counted per pair
of hosts) three personalised PageRanks are iterated at once: trust along links from allowed pages, distrust
against links from blocked pages, and the plain rank from all pages. A host's spam share is distrust / (trust +
distrust + rank); pages without a rule are blocked where it exceeds ``threshold``.

Defined cases: a null url, or one without ``://``, has empty host and path; no rule fits an empty host; a null html
has no links, relative links stay on their host; hosts without out-links (or in-links, for distrust) give
their mass back to the seeds; without allowed (blocked) pages trust (distrust) is 0 everywhere; of fitting
rules the longest host + path wins; repeated pages are judged each; very long pages are searched whole; further columns
are ignored, whatever their names. A hub's flows are summed before the shuffle; its own row meets them in a join that adaptive
execution splits. Damping ends the iteration below the tolerance in some 90 rounds; if it does not, that is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import stored

#: (action, host, path), at most some hundreds: they become one expression.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, ITERATIONS, TOLERANCE, THRESHOLD = 0.85, 200, 1e-6, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (host, path) with rule and _action of the longest rule that fits, else null."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, action = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(action)
    return pages.withColumns({"rule": rule, "_action": action})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)).alias("dst"))
    return links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """Hosts with trust, distrust and rank. seeds: host, allowed, blocked, pages (counts); edges: src, dst, n."""
    edges = stored(edges, "edges")
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("out_n"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("in_n"))
    flows = edges.join(out.withColumnRenamed("host", "src"), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("ahead"), F.lit(0.0).alias("back"))
    flows = flows.unionByName(edges.join(into.withColumnRenamed("host", "dst"), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("ahead"), (F.col("n") / F.col("in_n")).alias("back")))
    flows = stored(flows, "flows")
    total = seeds.agg(*[F.sum(c).alias(c) for c in ("allowed", "blocked", "pages")]).first()  # three numbers
    hosts = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.lit(total[c] or 0)), F.lit(0.0))
    base = hosts.join(seeds, "host", "left").join(out, "host", "left").join(into, "host", "left")
    base = base.select("host", share("allowed").alias("s_trust"), share("blocked").alias("s_distrust"), share("pages").alias("s_rank"), F.col("out_n").isNull().alias("sink"), F.col("in_n").isNull().alias("source"))
    base = stored(base, "hosts")
    ranks = stored(base.select("*", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"), F.col("s_rank").alias("rank")), "ranks")
    if edges.isEmpty():  # no mass moves: the seeds' shares are the fixed point
        return ranks
    for _ in range(iterations):
        ends = {"trust": "sink", "distrust": "source", "rank": "sink"}
        lost = ranks.agg(*[F.sum(F.when(F.col(end), F.col(c)).otherwise(0.0)).alias(c) for c, end in ends.items()]).first()  # three numbers
        got = flows.join(ranks, "host").groupBy("to").agg(F.sum(F.col("ahead") * F.col("trust")).alias("g_trust"), F.sum(F.col("back") * F.col("distrust")).alias("g_distrust"), F.sum(F.col("ahead") * F.col("rank")).alias("g_rank"))
        new = base.join(got.withColumnRenamed("to", "host"), "host", "left").join(ranks.select("host", *[F.col(c).alias(f"o_{c}") for c in ends]), "host")
        made = {c: (1 - damping) * F.col(f"s_{c}") + damping * (F.coalesce(f"g_{c}", F.lit(0.0)) + (lost[c] or 0.0) * F.col(f"s_{c}")) for c in ends}
        moved = sum(F.abs(made[c] - F.col(f"o_{c}")) for c in made)
        new = stored(new.select(*base.columns, *[x.alias(c) for c, x in made.items()], moved.alias("moved")), "ranks")
        moved = new.agg(F.sum("moved")).first()[0] or 0.0
        ranks = new.drop("moved")
        if moved <= tolerance:
            return ranks
    raise RuntimeError("ranks did not settle")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, html, host, path, rule, spam_share (of the host) and verdict."""
    p = with_rule(pages.select("page_id", "url", "html").withColumns({"host": host_of("url"), "path": path_of("url")}), rules)
    count = lambda what: F.count_if(F.col("_action") == what)
    seeds = stored(p.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"), F.count("*").alias("pages")), "seeds")
    ranks = propagate(seeds, host_edges(p))
    spam = F.coalesce(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust") + F.col("rank")), F.lit(0.0))
    # one row per host on the right; a host with very many pages is split by adaptive execution
    out = p.join(ranks.select("host", spam.alias("spam_share")), "host", "left")
    return out.withColumn("verdict", F.coalesce("_action", F.when(F.col("spam_share") > threshold, "block").otherwise("allow"))).drop("_action")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict of every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "spam_share")


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLE_SQL: dict[str, str] = {}
