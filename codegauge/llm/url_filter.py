"""URL rules, carried along redirects and canonical links. DataFrame functions only.

A URL is judged by the longest rule that fits its host (or a parent domain) and the start of its path. URLs are then
nodes, whole but for scheme and fragment, and a page is linked to the target of its canonical link and of its meta refresh (a table of
observed redirects may add more). A URL without a rule takes its component's verdict: allow if a URL there has an
allow rule, else block if one has a block rule, else allow. A URL's own rule always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: (verdict, host, path), as the contract gives them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    """What follows the first "://"; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, else nulls. Rules are a short list, part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # a longer one overrides
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


#: Attributes are found by name wherever they stand in the tag; values are quoted or bare.
_LINK = r"(?i)<link\s[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?i)<meta\s[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


#: Named references that stand in URLs; numeric ones are taken up to 127.
_NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def decoded(c: Column) -> Column:
    """An attribute's value with its character references replaced."""
    code = r"&#(?:[xX]0*[0-7]?[0-9a-fA-F]|0*(?:12[0-7]|1[01][0-9]|[0-9]{1,2}));"
    digits = F.transform(F.regexp_extract_all(c, F.lit(code), F.lit(0)), lambda x: F.regexp_replace(x, "[&#;]", ""))
    signs = F.transform(digits, lambda d: F.char(F.when(F.lower(d).startswith("x"), F.conv(F.substring(d, 2, 9), 16, 10)).otherwise(d).cast("long")))
    out = F.array_join(F.transform(F.split(c, code), lambda part, i: F.concat(part, F.coalesce(F.get(signs, i), F.lit("")))), "")
    out = F.when(c.contains("&#"), out).otherwise(c)
    for name, sign in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def without_dots(p: Column) -> Column:
    """A path without its . and .. segments (RFC 3986, 5.2.4)."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)

    def step(kept: Column, x: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(x == ".", kept).when(x == "..", up).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), F.slice(parts, 1, 1), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(r"/\.{1,2}(/|$)"), F.array_join(kept, "/")).otherwise(p)


def query(url: Column) -> Column:
    """With its question mark; empty where there is none."""
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^?#]*(\?[^#]*)", 1)


def _located(scheme: Column, h: Column, p: Column, q: Column) -> Column:
    """A node: host without its scheme's own port, path without dots, query."""
    port = F.when(F.lower(scheme) == "http", ":80").when(F.lower(scheme) == "https", ":443").otherwise(":")
    return F.concat(F.when(h.endswith(port), F.substring_index(h, ":", 1)).otherwise(h), without_dots(p), q)


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): the page's URL and its canonical link's or meta refresh's target, as nodes. Targets are resolved as RFC 3986 (5.2) says; those of other schemes than http and https are none.

    Each stage has the columns of the one before as they are, so that no expression is repeated in the code that the planner makes.
    """
    c = F.col
    hinted = pages.select("url", "html").where(c("html").rlike(r"(?i)canonical|http-equiv") & c("url").contains("://"))
    tags = hinted.select("url", F.regexp_extract("html", _LINK, 0).alias("link"), F.regexp_extract("html", _REFRESH, 0).alias("refresh"))
    found = tags.select("url", F.explode(F.array(F.regexp_extract("link", _HREF, 1), F.regexp_extract("refresh", _TARGET, 1))).alias("to")).where("to <> ''")
    ref = found.select(F.substring_index("url", "://", 1).alias("scheme"), host(c("url")).alias("host"), path(c("url")).alias("path"), query(c("url")).alias("query"), F.substring_index(decoded(c("to")), "#", 1).alias("to"))
    ref = ref.withColumn("own", F.lower(F.regexp_extract("to", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))).withColumn("rest", F.when(c("own") == "", c("to")).otherwise(c("to").substr(F.length("own") + 2, F.length("to"))))
    ref = ref.withColumns({"placed": c("rest").startswith("//"), "asks": F.regexp_extract("rest", r"^[^?]*(\?.*)", 1), "way": F.regexp_extract("rest", r"^(?://[^/?]*)?([^?]*)", 1)})
    base = F.when(c("path") == "", F.lit("/")).otherwise(F.regexp_replace("path", r"[^/]*$", ""))
    given = c("placed") | (c("own") != "")
    to_path = F.when(given | c("way").startswith("/"), c("way")).when(c("way") == "", c("path")).otherwise(F.concat(base, c("way")))
    to_query = F.when(given | (c("way") != "") | (c("asks") != ""), c("asks")).otherwise(c("query"))
    to_host = F.when(c("placed"), F.translate(F.regexp_extract("rest", r"^//([^/?]*)", 1), _UPPER, _LOWER)).when(c("own") == "", c("host")).otherwise("")
    ref = ref.select("scheme", "host", "path", "query", F.when(c("own") == "", c("scheme")).otherwise(c("own")).alias("to_scheme"), to_host.alias("to_host"), to_path.alias("to_path"), to_query.alias("to_query"))
    ref = ref.where(F.lower("to_scheme").isin("http", "https") & (c("to_host") != ""))
    return ref.select(_located(c("scheme"), c("host"), c("path"), c("query")).alias("a"), _located(c("to_scheme"), c("to_host"), c("to_path"), c("to_query")).alias("b"))


def node(url: Column) -> Column:
    """Host, path and query: what tells two URLs apart. Equal URLs have one: a scheme's own port and dots in paths are gone."""
    return _located(F.substring_index(url, "://", 1), host(url), path(url), query(url))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, via (rule, component or default).

    redirects may give observed (source_url, target_url). A null url, or one without "://", has empty host and path, no rule
    and no links, and is allowed. Null and empty html has no links. Rows that repeat are judged alike. Only
    page_id, url and html are read. An empty table gives no rows.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.where(_after(F.col("source_url")).isNotNull() & _after(F.col("target_url")).isNotNull()).select(node(F.col("source_url")), node(F.col("target_url"))))
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("own"))
    comps = shared.components(edges)
    # A node is host, path and query; a path is empty or starts with "/", a query with "?".
    own = best_rule(F.regexp_extract("node", r"^[^/?]*", 0), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), rules)[1]
    votes = comps.select("component", own.alias("v")).groupBy("component").agg(F.max(F.when(F.col("v") == "allow", 1).otherwise(0)).alias("allowed"), F.max(F.when(F.col("v") == "block", 1).otherwise(0)).alias("blocked"))
    passed = comps.join(votes, "component").where("allowed = 0 and blocked = 1").select("node")
    blocked = shared.written(passed.withColumn("hit", F.lit(True)), "blocked-aliases")
    # Only URLs without a rule look themselves up, by a key that spreads the rest.
    key = F.when(F.col("own").isNull() & (F.col("host") != ""), F.col("node"))
    both = judged.withColumn("node", key).join(blocked, "node", "left")
    return both.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("hit"), "component").otherwise("default").alias("via"),
    )
