"""URL filter: host and path rules, carried over redirect and canonical-link equivalence.

A page's own rule decides first. Other pages take the decision of their component: pages and link
targets are nodes; redirects, ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` are edges. A
component with an explicitly allowed url is allowed, else one with a blocked url is blocked, else
allowed. Components are found by distributed star contraction.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and no edges, and
is allowed. Null html has no links. Repeated rows are judged alike; of rules that tie in length, allow
wins. An empty table gives an empty result. Extra columns pass through, whatever their names; one named like an output is
replaced. Texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, free_name, let, small
from .components import connected_components

#: (action, host, path prefix with its slash)
Rule = tuple[str, str, str]

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'>\s]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'>\s]+)"""
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def _host(rest: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def _tail(rest: Column) -> Column:
    return F.regexp_replace(rest, r"^[^/?#]*", "")


def host(url: Column) -> Column:
    return let(_rest(url), _host)


def path(url: Column) -> Column:
    return let(_rest(url), lambda r: F.coalesce(F.regexp_extract(_tail(r), r"^[^?#]*", 0), F.lit("")))


def best_rule(host_: Column, path_: Column, rules: list[Rule]) -> Column:
    """Struct (rule, action) of the longest rule that fits, or null. The rules are a list in memory, on the driver and in the plan."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,action:string>")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    table = F.array(*[F.struct(F.lit(h).alias("h"), F.lit("." + h).alias("dot"), F.lit(p).alias("p"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")) for a, h, p in ranked])
    fits = F.get(F.filter(table, lambda r: ((host_ == r["h"]) | F.endswith(host_, r["dot"])) & F.startswith(path_, r["p"])), F.lit(0))
    return let(fits, lambda r: F.when(r.isNotNull(), F.struct(r["rule"].alias("rule"), r["action"].alias("action"))))


def alias_key(url: Column) -> Column:
    """What stays of a url when its scheme, fragment and final slash go: a node's name. Null without ``://``."""
    return let(
        _rest(url),
        lambda r: F.when(r.isNotNull(), F.regexp_replace(F.concat(_host(r), F.regexp_replace(_tail(r), r"#.*$", "")), r"/(?=$|\?)", "")),
    )


def resolve(link: Column, base: Column) -> Column:
    """A link of a page as a whole url; null if it has none."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def unescape(link: Column) -> Column:
    """``link`` with its numeric character references and those of ``NAMED`` decoded, each once."""

    def decoded(x: Column) -> Column:
        number = F.when(F.lower(x).startswith("&#x"), F.regexp_extract(x, "[0-9A-Fa-f]+", 0)).otherwise(F.hex(F.regexp_extract(x, "[0-9]+", 0).cast("long")))
        out = F.when(x.startswith("&#"), F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32"))
        for name, c in NAMED.items():
            out = out.when(x == f"&{name};", F.lit(c))
        return out.otherwise(x)

    parts = F.regexp_extract_all(link, F.lit(r"&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-z]+;|[^&]+|&"), F.lit(0))
    return F.when(link.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(link)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): the canonical and refresh links that pages declare, as whole urls."""
    u, h = F.col(url), F.coalesce(F.col(html), F.lit(""))
    links = F.concat(*[F.regexp_extract_all(h, F.lit(x), F.lit(1)) for x in (CANONICAL, REFRESH)])
    # the two substring tests spare most pages the patterns
    return (
        pages.where(u.isNotNull() & (h.contains("canonical") | h.rlike("(?i)canonical|refresh")))
        .select(u.alias("source"), F.explode(links).alias("link"))
        .where("link <> ''")
        .select("source", resolve(unescape(F.col("link")), F.col("source")).alias("target"))
        .where("target is not null")
    )


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, url: str = "url", html: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and via (rule, alias or default). ``redirects``: (source, target) urls."""
    scratch = scratch or Scratch(pages.sparkSession)
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))

    def ruled_node(u: Column) -> Column:
        action = let(u, lambda x: best_rule(host(x), path(x), rules)["action"])
        return F.struct(alias_key(u).alias("node"), action.alias("action"))

    links = scratch.write(
        links.where(F.contains("source", F.lit("://")) & F.contains("target", F.lit("://"))).select(ruled_node(F.col("source")).alias("source"), ruled_node(F.col("target")).alias("target")),
        "links",
    )
    nodes = connected_components(links.select(F.col("source.node").alias("a"), F.col("target.node").alias("b")), scratch)
    # an explicit decision on any spelling of a url counts for its node
    ruled = links.select("source.*").union(links.select("target.*")).where("action is not null")
    page_rules = pages.select(ruled_node(F.col(url)).alias("x")).select("x.*").where("action is not null")
    page_rules = page_rules.groupBy("node").agg(F.min("action").alias("action"))
    ruled = ruled.union(page_rules)
    decided = ruled.join(nodes, "node").groupBy("component").agg(F.min("action").alias("component_action"))  # allow < block
    own, other, carried, best = (free_name(pages, x) for x in ("node_of_page", "node_of_alias", "action_of_alias", "best_rule"))
    by_node = scratch.write(nodes.join(decided, "component").select(F.col("node").alias(other), F.col("component_action").alias(carried)), "decided")
    # a key has no fragment, so these match none; they keep pages without a key apart
    lone = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    out = pages.withColumn(own, F.coalesce(alias_key(F.col(url)), lone)).withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    out = out.withColumn(best, best_rule(F.col("host"), F.col("path"), rules)).join(small(by_node), F.col(own) == F.col(other), "left")
    return out.withColumns(
        {
            "rule": F.col(best)["rule"],
            "verdict": F.coalesce(F.col(best)["action"], F.col(carried), F.lit("allow")),
            "via": F.when(F.col(best).isNotNull(), "rule").when(F.col(carried).isNotNull(), "alias").otherwise("default"),
        }
    ).drop(own, other, carried, best)
