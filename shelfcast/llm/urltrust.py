"""URL filter: rules first, then trust and distrust spread over the links between hosts.

1. Each url is split into host and path; the longest rule that fits decides it.
2. Hosts with pages under allow rules are trusted seeds, hosts with pages under block rules blocked
   seeds, each weighted by its number of such pages. Links between hosts (counted per pair of hosts,
   so a page or host with very many links is a few rows) carry a personalised PageRank from trusted
   seeds forwards and one from blocked seeds backwards: who links to blocked hosts earns distrust.
3. A host is blocked if distrust is at least ``threshold`` of trust and distrust together; a host that
   neither reaches is allowed. Pages without a rule take their host's verdict.

Both walks are one table and one join each round. A walk ends when less than ``tolerance`` of its rank
is left to spread and the last round reached no new host, however far hosts are from the seeds.

Defined results: a null url or one without "://" has an empty host and path, fits no rule and is
allowed; links to the own host, to no host and relative ones don't count (those
beginning with "//" do, as do unquoted values and attributes in capitals); pages without an id are
judged like others; repeated rows are judged one by one and count again as seeds and links.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rank of a walk that may stay unspread.
TOLERANCE = 1e-4
THRESHOLD = 0.5
#: Written as a table every so many rounds, to keep lineage short.
CUT_ROUNDS = 4
#: Rules are part of the query's expressions; more than this need a table of hosts instead.
MOST_RULES = 1000
#: Links of a page: the values of href and src that name a host, quoted or not.
LINK = r"""(?i)(?<![\w-])(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without it."""
    rest = F.substring_index(_after(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end."""
    after = _after(url)
    host = F.substring_index(F.substring_index(F.substring_index(after, "/", 1), "?", 1), "#", 1)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; both null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def split_rule(kind: str, rule: str) -> Rule:
    """("block", "net/es/") as (kind, host, path)."""
    host, slash, path = rule.partition("/")
    return kind, host.lower(), slash + path


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, links): how often pages of one host link to another."""
    linked = pages.select(
        host_of(F.col(url_col)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("link"),
    )
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    pairs = linked.select("src", host_of(full).alias("dst"))
    return pairs.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of all hosts reached; seeds: host, trusted, blocked (weights)."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionAll(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "links")
    )
    total = both.groupBy("kind", "src").agg(F.sum("links").alias("total"))
    edges = stored(both.join(stored(total, "urltrust-totals"), ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("total")).alias("share")), "urltrust-edges")
    weights = seeds.select("host", F.expr("stack(2, 'trust', cast(trusted as double), 'distrust', cast(blocked as double)) as (kind, weight)")).where("weight > 0")
    sums = {r["kind"]: r["all"] for r in weights.groupBy("kind").agg(F.sum("weight").alias("all")).collect()}  # two rows
    scale = F.lit(None).cast("double")
    for kind, all_of_it in sums.items():
        scale = F.when(F.col("kind") == kind, F.col("weight") / all_of_it).otherwise(scale)
    start = stored(weights.select("kind", "host", scale.alias("rank")), "urltrust-seeds")
    # rank = (1 - d) * sum over k of d^k times the seeds moved k links on; ``moving`` is the last term.
    moving = start
    ranks = start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))
    k = 0
    while True:
        k += 1
        step = moving.join(edges, (moving["kind"] == edges["kind"]) & (moving["host"] == edges["src"])).select(edges["kind"], F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        moving = stored(step.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "urltrust-moving")
        left = {r["kind"]: r["left"] for r in moving.groupBy("kind").agg(F.sum("rank").alias("left")).collect()}  # two rows
        going = [kind for kind, x in left.items() if x >= tolerance]
        if len(going) < len(left):
            new = moving.join(ranks.select("kind", "host"), ["kind", "host"], "left_anti").select("kind").distinct()
            going = sorted({*going, *(r["kind"] for r in new.collect())})
        ranks = ranks.unionAll(moving.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank")))
        if not going:
            break
        moving = moving.where(F.col("kind").isin(going))
        if k % CUT_ROUNDS == 0:
            ranks = stored(ranks.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "urltrust-ranks")
    by_kind = {k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")}
    return ranks.groupBy("host").agg(by_kind["trust"], by_kind["distrust"])


def judged(
    pages: DataFrame,
    rules: Sequence[Rule],
    threshold: float = THRESHOLD,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict, and the host's trust and distrust (shares of the whole)."""
    url = F.col(url_col)
    named = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    named = named.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = named.where("by_rule is not null").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("trusted"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    hosts = spread(stored(host_links(pages, url_col, html_col), "urltrust-links"), stored(seeds, "urltrust-hosts"), damping, tolerance)
    hosts = stored(hosts, "urltrust-scores")
    rows = named.join(hosts, "host", "left")
    blocked = F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))
    return rows.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
