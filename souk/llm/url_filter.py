"""URL filters with redirect equivalence (operator 6).

A rule is a verdict for a host with all its subdomains and a path prefix; the rule of the longest text that
fits decides. URLs that redirect to each other (a page's meta refresh, or given redirect edges) or that name
each other as canonical (link rel=canonical) are aliases: connected components over these edges. A URL that
no rule fits is blocked if a rule blocks one of its aliases and none explicitly allows one; else it is allowed.
An explicit rule always keeps its own verdict.

Everything is DataFrame operations, the components' rounds too (``few=0``: never the task that small edge sets have
elsewhere); they run over the edges alone.

Cases: a null url, or one without ``://``, has empty host and path, no rule, no aliases, and is allowed; null or
very long html is searched whole; repeated rows and null keys give one result each; an empty table gives an
empty result; tables without edges need no components; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let
from .graph import components

#: Verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_index(host_: Column, path_: Column, rules) -> Column:
    """Index in rules of the longest that fits, else null. For rule lists of up to a thousand."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    out = None
    for i in sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2])):
        _, h, p = rules[i]
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(None).cast("int") if out is None else out


def node(url: Column) -> Column:
    """What stands for a URL among aliases: without its fragment, scheme and host in lower case, a bare host
    with a slash; null where there is no host."""

    def written(x):
        rest = F.substring(x["bare"], F.length(x["head"]) + 1, F.length(x["bare"]))
        path_ = let(rest, lambda r: F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r)))
        return F.when(F.length(x["host"]) > 0, F.concat(F.translate(x["head"], UPPER, LOWER), path_))

    split = lambda bare: let(F.struct(bare.alias("bare"), F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1).alias("head"), host(bare).alias("host")), written)
    return let(F.regexp_replace(url, "(?s)#.*$", ""), split)


def resolved(target: Column, base: Column) -> Column:
    """A link's target seen from base: absolute, //host, /path, ?query or relative to base's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([^/]*//[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^/]*//[^/?#]*(?:/[^?#/]*)*?)/?[^/?#]*(?:[?#].*)?$", 1)

    def seen(t):
        return F.when(t == "", None).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(root, t)).when(t.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), t)).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None).otherwise(F.concat(folder, F.lit("/"), t))

    return let(F.trim(target), seen)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) nodes of the canonical links and meta refreshes in the pages' html."""
    html, url = F.col(html_col), F.col(url_col)
    some = pages.select(url.alias("url"), html.alias("html")).where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv"))
    href = lambda tag: F.regexp_extract(tag, "(?is)href\\s*=\\s*[\"']?([^\"'>\\s]+)", 1)
    canonical = href(F.regexp_extract("html", "(?is)<link\\b(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*>", 0))
    refresh = F.regexp_extract(F.regexp_extract("html", "(?is)<meta\\b(?=[^>]*http-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*>", 0), "(?is)url\\s*=\\s*[\"']?([^\"'>\\s;]+)", 1)
    found = some.select("url", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    return found.select(node(F.col("url")).alias("a"), node(resolved(F.regexp_replace("to", "&amp;", "&"), F.col("url"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule, alias or default) for each row of pages. redirects:
    further (src, dst) URL pairs."""
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")).where("a is not null and b is not null and a <> b"))
    edges = cut(edges.distinct())
    texts = F.array(*[F.lit(h + p) for _, h, p in rules]) if rules else F.array(F.lit(""))
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules]) if rules else F.array(F.lit(""))
    url = F.col("url")
    parts = let(F.struct(host(url).alias("host"), path(url).alias("path")), lambda x: F.struct(x["host"].alias("host"), x["path"].alias("path"), rule_index(x["host"], x["path"], rules).alias("i")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", parts.alias("x")).select("page_id", "url", "x.*")
    rows = rows.withColumn("rule", F.get(texts, F.col("i"))).withColumn("own", F.get(verdicts, F.col("i")))
    if edges.isEmpty():
        rows = rows.withColumn("alias", F.lit(None).cast("string"))
    else:
        own = let(F.struct(host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), lambda x: F.get(verdicts, rule_index(x["host"], x["path"], rules)))
        named = components(edges, few=0).withColumn("own", own)
        decided = named.groupBy("component").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed")).where("blocked and not coalesce(allowed, false)").select("component")
        # Only aliases of blocked URLs are joined; the planner broadcasts them where its size check allows.
        blocked = cut(named.join(decided, "component").where("own is null").select("node").distinct().withColumn("alias", F.lit("block")))
        rows = rows.withColumn("node", node(url)).join(blocked, "node", "left")
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"), by.alias("by"))


def op6_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def redirected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages judged with made redirects, since theirs have none: of three pages in a row each leads to the next."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    follow = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("dst"))
    redirects = pages.where("page_id % 3 <> 2").join(follow, "page_id").select(F.col("url").alias("src"), "dst")
    return judge(pages, redirects=redirects)


#: SQL for redirected_pages: aliases by recursion over the redirects.
REDIRECTED_SQL = r"""
with recursive u as (select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path, regexp_replace(url, '(?s)#.*$', '') bare from pages),
n as (select *, case when host <> '' then translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || case when rest like '/%' then rest else '/' || rest end end node
      from (select *, substr(bare, length(head) + 1) rest from (select *, regexp_extract(bare, '(?s)^(.*?://[^/?]*)', 1) head from u))),
r(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m as (select n.page_id, arg_max(r.h || r.p, length(r.h || r.p)) rule, arg_max(r.verdict, length(r.h || r.p)) verdict
      from n join r on (n.host = r.h or ends_with(n.host, '.' || r.h)) and starts_with(n.path, r.p) group by n.page_id),
d as (select a.node a, b.node b from n a join n b on b.page_id = a.page_id + 1 where a.page_id % 3 <> 2 and a.node <> b.node),
e as (select a, b from d union select b, a from d),
reach(node, c) as (select a, a from e union select e.b, reach.c from reach join e on e.a = reach.node),
g as (select node, min(c) c from reach group by 1),
o as (select distinct g.c, m.verdict from g join n using (node) join m using (page_id)),
bad as (select c from o group by c having bool_or(verdict = 'block') and not bool_or(verdict = 'allow'))
select n.page_id, n.host, n.path, m.rule, coalesce(m.verdict, case when bad.c is not null then 'block' else 'allow' end) verdict, case when m.rule is not null then 'rule' when bad.c is not null then 'alias' else 'default' end "by"
from n left join m using (page_id) left join g on g.node = n.node left join bad on bad.c = g.c
"""
#: SQL for op6 where no page has edges; the driver's pages have none.
OP6_SQL = r"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
r(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m as (select u.page_id, arg_max(r.h || r.p, length(r.h || r.p)) rule, arg_max(r.verdict, length(r.h || r.p)) verdict
      from u join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p) group by u.page_id)
select u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') verdict, case when m.rule is null then 'default' else 'rule' end "by"
from u left join m using (page_id)
"""
