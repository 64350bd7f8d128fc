"""URL filters with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains where the url's path begins with the
rule's, and the longest rule that fits decides (allow or block). Urls that pages declare equivalent, by a canonical
link or a refresh that redirects, are joined into components over all pages. A block decision, made by a rule on any
url of a component, reaches the component's urls that no rule decides. Explicit allows go first: an allowed url stays
allowed, and a component in which a url is explicitly allowed passes no block on.

Urls are compared without their fragment, with the scheme left out and the host in lower case. Components are found by
distributed steps on url hashes (`components`); nothing about the corpus goes through the driver.

Every canonical link and refresh of a page counts. Relative targets are resolved against the page's url, or the http url
its base element names: scheme, host, folder, "." and "..".

Edge cases: a null url or one without "://" has an empty host and path, fits no rule and is allowed; empty and non-http
targets make no link; a link of a page to itself is none; repeated pages are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import ascii_lower, staged
from turnstile.llm.components import components

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

_HEAD = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*;?\s*url\s*=\s*["']?([^"'\s>]+)"""

_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?(https?://[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _HEAD, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HEAD, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does. Of equally long ones, the first by text."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    table = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule")) for v, h, p in ranked])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, 0)


def node_of(url: Column) -> Column:
    """Hash of a url without scheme and fragment; null if it has no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.xxhash64(host_of(url), rest))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its "." and ".." segments taken out."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(done, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(done) > 0), F.lit("/")).otherwise(F.lit("")))


def resolved(target: Column, base: Column) -> Column:
    """The url that a target means on a page; null where it is not http or empty."""
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?):", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path, query = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)", 1))
    return (
        F.when(target.rlike("(?i)^https?://"), target)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (target == "") | F.startswith(target, F.lit("#")), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(base), target))
        .otherwise(F.concat(site, without_dots(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))), query))
    )


def equivalences(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """a, b: hashes of urls that a page declares to be the same."""
    targets = F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    links = pages.where(F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh")))
    named = F.regexp_extract(html, _BASE, 1)
    links = links.select(node_of(F.col(url)).alias("a"), F.when(named != "", named).otherwise(F.col(url)).alias("base"), F.explode(targets).alias("target"))
    links = links.where("a is not null").withColumn("target", F.replace("target", F.lit("&amp;"), F.lit("&")))
    return links.select("a", node_of(resolved(F.col("target"), F.col("base"))).alias("b")).where("a != b").distinct()


def judged(pages: DataFrame, rules: list[Rule], carry: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """row (the columns `carry`), host, path, rule, verdict, root (the component's least url hash, null outside one)."""
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(url).alias("url"))
    urls = urls.select("row", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    roots = staged(components(equivalences(pages, url, html)), "url-components")
    # One decision a component: an explicit allow anywhere in it keeps blocks from spreading.
    member = urls.select("node", F.col("own.verdict").alias("verdict")).where("verdict is not null").distinct().join(roots, "node")
    spread = member.groupBy("root").agg(F.min("verdict").alias("spread"))
    known = roots.join(spread, "root", "left")
    out = urls.join(known, "node", "left")
    verdict = F.coalesce("own.verdict", "spread", F.lit("allow"))
    return out.select("row", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "root")
