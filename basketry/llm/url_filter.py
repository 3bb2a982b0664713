"""URL rules carried over redirect and canonical-link equivalence; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.llm.graph import components
from basketry.session import spool

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix) of the registered query.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """Address that the usual server redirects lead to.

    Scheme, fragment, ``www.`` and ``m.`` hosts, a trailing slash, index pages and tracking
    parameters all redirect to one address on ordinary servers.
    """
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)") & (p != ""))
    kept = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _absolute(target: Column, url: Column) -> Column:
    """``target`` as written in a page at ``url``; only absolute and rooted links are followed."""
    root = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(from_url, to_url)`` of canonical links and refresh redirects in the markup."""
    h = F.col(html)
    canonical = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)),
                         lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"))
    refresh = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
                       lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"))
    href = lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    to = lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    found = pages.filter(F.col(url).isNotNull() & F.col(html).isNotNull()).select(
        F.col(url).alias("from_url"),
        F.explode(F.concat(F.transform(canonical, href), F.transform(refresh, to))).alias("_to"))
    return (
        found.select("from_url", _absolute(F.col("_to"), F.col("from_url")).alias("to_url"))
        .filter("to_url is not null").distinct()
    )


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("_verdict"), F.lit(h).alias("_host"), F.lit(p).alias("_prefix")) for v, h, p in rules])))


def explicit_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest rule that fits each distinct ``url``: columns ``url``, ``rule``, ``rule_verdict``.

    A host joins the rules by each of its own suffixes, so the rule list may be long.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.filter("host != ''").select("url", "path", F.explode(suffixes).alias("_host"))
    fitting = hosts.join(rules, "_host").filter(F.col("path").startswith(F.col("_prefix")))
    rule = F.concat("_host", "_prefix")
    return fitting.groupBy("url").agg(F.max(F.struct(
        F.length(rule).alias("n"), (F.col("_verdict") == "allow").alias("a"), rule.alias("rule"), F.col("_verdict").alias("v"),
    )).alias("m")).select("url", F.col("m.rule").alias("rule"), F.col("m.v").alias("rule_verdict"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None,
          page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page with ``host``, ``path``, ``rule``, ``verdict`` and its ``alias_class``.

    A url under a rule has the rule's verdict.  Any other url is blocked when its class of
    aliases holds a blocked url and no explicitly allowed one, and allowed otherwise.  Aliases
    are addresses with one canonical form, and what canonical links, refresh redirects and the
    optional table ``redirects`` (from_url, to_url) tie together, however long the chain.
    A redirect target counts with its own rule even if no page has it.

    A NULL url and one without ``://`` have an empty host and path, fit no rule and have no
    aliases: allowed.  Repeated urls and page ids keep all their rows.
    """
    spark = pages.sparkSession
    links = link_edges(pages, url, html)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    links = spool(links, "links")
    targets = links.select(F.col("from_url").alias("url")).union(links.select(F.col("to_url").alias("url")))
    urls = (
        pages.select(F.col(url).alias("url")).filter("url is not null").union(targets).distinct()
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                F.when(F.instr("url", "://") > 0, canonical_form(F.col("url"))).otherwise(F.col("url")).alias("form"))
    )
    ruled = spool(urls.join(explicit_rules(urls, rule_table(spark, rules)), "url", "left"), "ruled")
    forms = links.select(canonical_form(F.col("from_url")).alias("a"), canonical_form(F.col("to_url")).alias("b"))
    roots = components(forms, "a", "b")
    classed = ruled.join(roots, ruled["form"] == roots["node"], "left").select(
        ruled["*"], F.coalesce("root", "form").alias("alias_class"))
    decided = classed.groupBy("alias_class").agg(
        F.max((F.col("rule_verdict") == "block").cast("int")).alias("_block"),
        F.max((F.col("rule_verdict") == "allow").cast("int")).alias("_allow"),
        F.count("*").alias("n_aliases"))
    verdicts = classed.join(decided, "alias_class").select(
        F.col("url").alias("_url"), "rule", "alias_class", "n_aliases",
        F.coalesce("rule_verdict", F.when((F.col("_block") == 1) & (F.coalesce("_allow", F.lit(0)) == 0), "block"), F.lit("allow")).alias("verdict"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    return rows.join(verdicts, "_url", "left").select(
        "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), "alias_class", F.coalesce("n_aliases", F.lit(1)).alias("n_aliases"))
