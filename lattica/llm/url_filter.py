"""URL filtering by rules, with verdicts spread over redirect equivalence.

Rules name a host, with all its subdomains, and a path prefix; the longest that fits decides. Redirects (a table, or
refresh tags) and canonical links join URLs into aliases of one resource: connected components over these edges.
A URL without a rule of its own is blocked if any alias is; its own allow rule always comes first.

DataFrame functions only. Edges and components are distributed, by 64-bit keys of the URLs; where rules are few they
are matched inside the scan, without a join, else by an equi-join on the host and its parent domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import components, saved

#: Up to so many rules are compared with each URL in place; more are joined by host.
INLINE_RULES = 64
#: Up to so many joined rules are sent to all executors.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def undotted(path: Column) -> Column:
    """The path without its `.` and `..` steps (RFC 3986, 5.2.4)."""
    steps = F.split(path, "/")
    walked = F.aggregate(F.slice(steps, 2, F.size(steps)), F.lit(""), lambda to, x: F.when(x == "..", F.regexp_replace(to, r"/[^/]*$", "")).when(x == ".", to).otherwise(F.concat(to, F.lit("/"), x)))
    walked = F.concat(walked, F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(path.contains("/."), walked).otherwise(path)


def query_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^?#]*([^#]*)", 1)


def key_of(url: Column) -> Column:
    """The resource: host, path without dots, and query; neither scheme nor fragment."""
    return F.concat(host_of(url), undotted(path_of(url)), query_of(url))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


#: What holds no tags, though it may look so: comments, scripts and styles.
NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script|\z)|<style\b[^>]*>.*?(?:</style|\z)"
#: A tag of a name up to its end, over `>` in quotes.
TAG = r"""(?is)<{}\b(?:[^>"']|"[^"]*"|'[^']*')*[^>]*"""
CANONICAL = r"""(?is)[\s"']rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?:[\s/]|$))"""
REFRESH = r"""(?is)[\s"']http-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?is)[\s"']href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TO = r"""(?is)\burl\s*=\s*["']?\s*([^\s"'>]+)"""


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the URL of a page and each one that a canonical link or refresh tag of it names, made absolute, without dots.

    Every such tag counts, however long; what stands in comments, scripts and styles doesn't.
    """
    html, url, none = F.col("html"), F.col("url"), F.array().cast("array<string>")
    # Java's matcher needs possessive loops to go through a long tag without a deep stack; they match the same
    whole = lambda name: TAG.format(name).replace("[^>\"']|", "[^>\"']++|").replace(")*[", ")*+[")
    named = lambda name, kind, at: F.transform(F.filter(F.regexp_extract_all("html", F.lit(whole(name)), F.lit(0)), lambda t: t.rlike(kind)), lambda t: F.trim(F.regexp_replace(F.regexp_extract(t, at, 1), r"""^["']|["']$""", "")))
    low = F.lower(html)
    some = pages.where("url is not null and html is not null").select("url", "html", low.contains("canonical").alias("link"), low.contains("http-equiv").alias("meta")).where("link or meta")
    some = some.withColumn("html", F.when(html.contains("<!--") | low.contains("<script") | low.contains("<style"), F.regexp_replace(html, NO_TAGS, " ")).otherwise(html))
    found = some.select("url", F.explode(F.concat(F.when(F.col("link"), named("link", CANONICAL, HREF)).otherwise(none), F.when(F.col("meta"), named("meta", REFRESH, TO)).otherwise(none))).alias("to"))
    to = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^[^:]*", 0)
    absolute = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), to))
        .when(to.startswith("?") | to.startswith("#"), F.concat(scheme, F.lit("://"), host_of(url), path_of(url), to))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(url), F.regexp_extract(F.concat(path_of(url), F.when(path_of(url) == "", "/").otherwise("")), r"^.*/", 0), to))
    )
    ends = found.where("to <> ''").select(url.alias("a"), absolute.alias("b"))
    b = F.col("b")
    plain = F.concat(F.regexp_extract(b, r"^[^:]*://", 0), host_of(b), undotted(path_of(b)), query_of(b))
    return ends.select("a", F.when(b.contains("/."), plain).otherwise(b).alias("b"))


def _fitting(rules: list, host: Column, path: Column) -> Column:
    """The longest of the given rules that fits, as struct(rule, verdict); null if none does."""
    fits = []
    for r in rules:
        ok = ((host == r["host"]) | host.endswith("." + r["host"])) & path.startswith(r["path"])
        fits.append(F.when(ok, F.struct(F.lit(len(r["host"]) + len(r["path"])).alias("n"), F.lit(len(r["host"])).alias("h"), F.lit(int(r["verdict"] == "allow")).alias("a"), F.lit(r["host"] + r["path"]).alias("rule"), F.lit(r["verdict"]).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,h:int,a:int,rule:string,verdict:string>")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path, ...) with `rule` and `ruled`, the verdict of the longest rule that fits, else null.

    Of rules as long as each other the longer host wins, then allow. Null rules are left out.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    few = rules.limit(INLINE_RULES + 1).collect()
    if len(few) <= INLINE_RULES:
        best = urls.withColumn("__best", _fitting(few, F.col("host"), F.col("path")))
        return best.withColumn("rule", F.col("__best.rule")).withColumn("ruled", F.col("__best.verdict")).drop("__best")
    # hosts and paths are judged once each, whatever number of URLs share them
    distinct = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = rules.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("verdict").alias("__verdict"))
    keyed = F.broadcast(keyed) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else keyed
    size = F.length("__host") + F.length("__path")
    hit = F.max(F.struct(size.alias("n"), F.length("__host").alias("h"), (F.col("__verdict") == "allow").alias("a"), F.concat("__host", "__path").alias("rule"), F.col("__verdict").alias("verdict")))
    found = distinct.withColumn("__host", F.explode(above)).join(keyed, "__host").where(F.col("path").startswith(F.col("__path"))).groupBy("host", "path").agg(hit.alias("__best"))
    joined = urls.join(found, ["host", "path"], "left")
    return joined.withColumn("rule", F.col("__best.rule")).withColumn("ruled", F.col("__best.verdict")).drop("__best")


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """The keys (64-bit, `key`) of URLs of edges(a, b) that have a blocked alias, themselves included."""
    ends = edges.where("a is not null and b is not null").select(F.array("a", "b").alias("x"))
    pairs = ends.select(*[F.xxhash64(key_of(F.col("x")[i])).alias(c) for i, c in enumerate("ab")])
    comps = components(pairs)
    urls = ends.select(F.explode("x").alias("url")).select(F.xxhash64(key_of(F.col("url"))).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    bad = judged(urls, rules).where("ruled = 'block'").select("node").distinct()
    hit = comps.join(bad, "node", "left_semi").select("component").distinct()
    return comps.join(hit, "component", "left_semi").select(F.col("node").alias("key"))


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages(page_id, url, html).

    redirects(a, b) adds known redirects to the edges found in the pages. verdict is allow or block: the rule's; without a rule,
    block if an alias is blocked by its own rule, else allow. A null url, or one without `://`, has empty host and path, no rule and no
    aliases, and is allowed. Null html has no edges. Repeated rows each give their row; other columns are ignored.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b"))
    edges = saved(edges.where("a is not null and b is not null").distinct())
    urls = pages.select("page_id", F.xxhash64(key_of(F.col("url"))).alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    told = judged(urls, rules)
    if edges.isEmpty():
        aliased = told.withColumn("aliased", F.lit(False))
    else:
        bad = blocked_aliases(edges, rules).withColumn("aliased", F.lit(True))
        aliased = told.join(bad, "key", "left")
    method = F.when(F.col("aliased") & (F.col("host") != ""), "block").otherwise("allow")
    return aliased.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))
