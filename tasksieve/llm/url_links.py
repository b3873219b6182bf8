"""Allow or block urls by rules, and where no rule fits by trust that spreads over the links between hosts.

Trust is a personalised PageRank from the trusted seeds along links; distrust one from the blocked seeds against them, since who links
to a blocked host is suspect. Seeds are the hosts most of whose pages an allow or a block rule decides. Both run together over one table of
weighted host edges as Spark joins and combined sums; lineage is cut by written tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tasksieve.llm.stored import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative targets of links.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for the host, its subdomains, and the paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlFilter:
    """A host is blocked if its distrust exceeds its trust and ``share`` of what one blocked seed starts with."""

    rules: Sequence[Rule]
    damping: float = 0.85
    rounds: int = 20
    cut_every: int = 5
    share: float = 0.1


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, else null."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    nothing = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(nothing, *fits)))


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: links from the pages of one host to another host; links within a host count nothing."""
    links = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("link")
    )
    targets = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    return targets.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, op: UrlFilter) -> DataFrame:
    """``(kind, host, score)`` after ``rounds`` of personalised PageRank.

    ``edges`` (kind, src, dst, share): the shares of a source add up to 1. ``seeds`` (kind, host, score): those of a kind too.
    A host without edges keeps nothing for others, so scores may add up to less than 1.
    """
    scores = seeds
    for k in range(1, op.rounds + 1):
        moved = edges.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (op.damping * F.col("score") * F.col("share")).alias("score")
        )
        restart = seeds.select("kind", "host", ((1 - op.damping) * F.col("score")).alias("score"))
        scores = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % op.cut_every == 0 or k == op.rounds:
            scores = stored(scores, "ranks")
    return scores


def host_verdicts(pages: DataFrame, op: UrlFilter) -> DataFrame:
    """``(host, trust, distrust, blocked)`` of the hosts that have any."""
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    rule = best_rule(F.col("host"), F.col("path"), op.rules)
    hosts = judged.select("host", rule["verdict"].alias("verdict")).groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), *[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")]
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (2 * F.col(v) > F.col("pages")).alias("seed")) for k, v in (("trust", "allow"), ("distrust", "block"))])
    seeds = stored(hosts.select("host", F.explode(kinds).alias("k")).where("k.seed").select("k.kind", "host"), "seeds")
    counts = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = F.coalesce(*[F.when(F.col("kind") == k, F.lit(1.0 / n)) for k, n in counts.items()], F.lit(0.0))
    seeds = seeds.select("kind", "host", start.alias("score"))
    links = stored(host_edges(pages), "host-edges")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    totals = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = stored(both.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "edge-shares")
    # Without a single edge the ranks are the seeds' restarts.
    scores = propagate(edges, seeds, op) if edges.head(1) else seeds.withColumn("score", (1 - op.damping) * F.col("score"))
    by_host = scores.groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    least = op.share * (1 - op.damping) / counts.get("distrust", 1)
    return by_host.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least))


def judge_urls(pages: DataFrame, op: UrlFilter) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for each row of ``pages`` (page_id, url, html).

    The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on to ``?``, ``#`` or the
    end; both are empty for a null url or one without ``://``. The longest rule that fits decides; else the host: blocked as
    ``UrlFilter`` says, allowed if unknown. Null html has no links; repeated rows are judged each and count as pages.
    """
    hosts = host_verdicts(pages, op)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), op.rules))
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
