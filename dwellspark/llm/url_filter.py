"""URL allow and block rules, with block decisions carried to redirect aliases.

A rule (host, path, verdict) fits its host and all subdomains where the url's path
begins with the rule's; the longest fitting rule (host and path joined) decides, an
allow before a block of the same text.  Urls that no rule names take the method's
verdict: they are blocked if their connected component over redirect and
canonical-link edges holds a blocked url, else allowed.  An explicit allow keeps its
url allowed whatever its aliases are.

Links are ``link`` elements whose rel has the word canonical, and ``meta`` elements with
http-equiv refresh and a url.  Targets are resolved against the page's url (or its base
element): relative and protocol-relative ones too, with ``&amp;`` decoded.  Urls of links,
redirects and pages meet with scheme and host in lower case and without fragment.

Only DataFrame functions are used.  Null or malformed urls have empty host and path,
fit no rule (unless a rule's host is empty) and are allowed.  Repeated rows are judged
alike; an empty table gives an empty table; very long pages and urls are read whole.  Columns named like a result column are
replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import let, settle, small, without

#: Rules up to this number become one expression; more are joined by host.
INLINE_RULES = 64
#: Blocked alias urls up to this number are broadcast.
BROADCAST_ALIASES = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RESULT = ("host", "path", "rule", "verdict")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path, and the deciding rule and its verdict (null if none).

    Rules with a null field are ignored.  Up to ``INLINE_RULES`` rules are tested in one expression; more are
    joined by parent domain and path prefix, in rows that do not depend on the number of rules of a domain.
    """
    urls = without(urls, *RESULT).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    listed = rules.limit(INLINE_RULES + 1).collect()
    if len(listed) <= INLINE_RULES:
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        order = sorted(listed, key=lambda r: (-len(r.host + r.path), r.verdict, r.host + r.path, r.host))
        for r in reversed(order):
            fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
            best = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
        return urls.withColumn("__best", best).select(*[f"`{c}`" for c in urls.columns], F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict"))
    # a row per parent domain with rules and length of a rule's path there, joined by domain and path prefix
    labels = F.split("host", "\\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.groupBy(F.col("host").alias("parent")).agg(F.collect_set(F.length("path")).alias("lengths"))
    asked = urls.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("parent")).join(lengths, "parent")
    asked = asked.select("host", "path", "parent", F.explode("lengths").alias("n")).filter("n <= length(path)").withColumn("prefix", F.expr("substring(path, 1, n)"))
    ranked = rules.select(F.col("host").alias("parent"), F.col("path").alias("prefix"), F.struct((-F.length(F.concat("host", "path"))).alias("n"), "verdict", F.concat("host", "path").alias("rule")).alias("r"))
    best = asked.join(ranked, ["parent", "prefix"]).groupBy("host", "path").agg(F.min("r").alias("__best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select(*[f"`{c}`" for c in urls.columns], F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict"))


def _place(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case: what a redirect or canonical link names."""

    def placed(u: Column) -> Column:
        head = F.regexp_extract(u, "^[^/?#]*://[^/?#]*", 0)
        return let(head, lambda h: F.concat(F.translate(h, UPPER, UPPER.lower()), F.regexp_extract(u.substr(F.length(h) + 1, F.length(u)), "^[^#]*", 0)))

    return let(url, placed)


def _without_dots(path: Column) -> Column:
    """A path from / without its . and .. segments."""
    up = lambda done: F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))

    def joined(p: Column) -> Column:
        kept = let(F.split(p, "/", -1), lambda parts: F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), F.array().cast("array<string>"), step))
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(p.rlike(r"/\.\.?$") & (F.size(k) > 0), "/").otherwise("")))

    return let(path, joined)


def resolved(target: Column, base: Column) -> Column:
    """The url that ``target`` names on a page at ``base``; null for other schemes than those with ://."""

    def on_page(t: Column, b: Column) -> Column:
        origin = F.regexp_extract(b, "^[^/?#]*://[^/?#]*", 0)
        path = F.regexp_extract(b, "^[^/?#]*://[^/?#]*([^?#]*)", 1)
        folder = let(path, lambda p: F.when(p == "", "/").otherwise(F.regexp_extract(p, "^.*/", 0)))
        full = F.when(t.startswith("/"), t).otherwise(F.concat(folder, t))
        whole = lambda f, mine: F.concat(origin, _without_dots(mine), f.substr(F.length(mine) + 1, F.length(f)))
        return (
            F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(t.startswith("//"), F.concat(F.regexp_extract(b, "^[^/?#]*:(?=//)", 0), t))
            .when(t.startswith("?"), F.concat(origin, path, t))
            .when((t == "") | t.startswith("#"), b)
            .otherwise(let(full, lambda f: let(F.regexp_extract(f, "^[^?#]*", 0), lambda mine: whole(f, mine))))
        )

    return let(target, lambda t: let(base, lambda b: on_page(t, b)))


def _value(pattern: str, of: Column) -> Column:
    """What follows ``pattern``: in double quotes, in single quotes or up to a blank; empty if nothing does."""
    full = pattern + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*[F.regexp_extract(of, full, i) for i in (1, 2, 3)]))


def _attribute(tag: Column, name: str) -> Column:
    return _value(rf"""(?i)[\s"'/]{name}""", tag)


def _target(tag: Column) -> Column:
    """The url that a canonical link or meta refresh names; empty for other tags."""
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
    content = _attribute(tag, "content")
    named = let(content, lambda c: F.trim(F.concat(*[F.regexp_extract(c, r"""(?i)^[^;,]*[;,]\s*url\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s]\S*))""", i) for i in (1, 2, 3)])))
    return F.when(tag.rlike("(?i)^<link") & canonical, _attribute(tag, "href")).when(tag.rlike("(?i)^<meta") & refresh, named).otherwise("")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): page urls and the urls that their canonical links and meta redirects name."""
    body = F.col(html)
    tags = F.filter(F.regexp_extract_all(body, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: t.rlike("(?i)canonical|refresh"))
    decode = lambda t: F.regexp_replace(t, "(?i)&(?:amp|#0*38|#x0*26);", "&")
    stated = decode(_attribute(F.regexp_extract(body, r"(?i)<base\b[^>]*>", 0), "href"))
    rows = pages.filter(body.rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("url"), stated.alias("stated"), F.explode(F.transform(tags, _target)).alias("target")).filter("target <> ''")
    rows = rows.withColumn("base", F.coalesce(F.when(F.col("stated") != "", resolved(F.col("stated"), F.col("url"))), F.col("url")))
    pair = F.struct(_place(F.col("url")).alias("a"), _place(resolved(decode(F.col("target")), F.col("base"))).alias("b"))
    real = lambda e: (F.instr(e["a"], "://") > 0) & (F.instr(e["b"], "://") > 0) & (e["a"] != e["b"])
    return rows.select(F.explode(F.filter(F.array(pair), real)).alias("e")).select("e.a", "e.b").distinct()


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Edges come from ``html`` (None: not read) and from ``redirects`` (a, b), a table of
    redirects seen while crawling.
    """
    out = apply_rules(pages, rules, url)
    edges = link_edges(pages, url, html) if html else None
    if redirects is not None:
        seen = redirects.select(_place(F.col("a")).alias("a"), _place(F.col("b")).alias("b")).filter("a <> b")
        edges = seen if edges is None else edges.union(seen)
    plain = F.coalesce("verdict", F.lit("allow"))
    if edges is None:
        return out.withColumn("verdict", plain)
    edges, _ = settle(edges.distinct(), "url-edges")
    if edges.isEmpty():
        return out.withColumn("verdict", plain)
    nodes, _ = settle(connected_components(edges), "url-components")
    judged = apply_rules(nodes.select(F.col("node").alias("url"), "component"), rules)
    bad = judged.filter("verdict = 'block'").select("component").distinct()
    aliases, _ = settle(judged.filter("verdict IS NULL").join(bad, "component", "left_semi").select(F.col("url").alias("__alias_url")), "url-aliases")
    out = out.join(small(aliases, BROADCAST_ALIASES), _place(F.col(url)) == F.col("__alias_url"), "left")
    method = F.when(F.col("__alias_url").isNotNull(), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", method)).drop("__alias_url")
