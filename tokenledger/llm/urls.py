"""URL rules that hold for all aliases of a page.

Pages, their redirect targets and their canonical addresses are nodes; a redirect
or canonical link is an edge. A block decided by rule for one node holds for
every address of its component, unless a rule of its own decides otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import released, settled

# What no tag is read from: comments and elements whose content is plain text.
_HIDDEN = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<script[\s/>].*?(?:</script|\z)|<style[\s/>].*?(?:</style|\z)|<textarea[\s/>].*?(?:</textarea|\z)|<title[\s/>].*?(?:</title|\z)"
# A whole tag: a quoted value may hold ``>``; a quote that never closes makes no tag.
_TAG = r"""(?is)</?[a-z][^\s/>]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)|[^>=]++)*+(?:=\s*+)?+>"""
_ATTRIBUTE = r"""(?is)[^\s"'>/=]+\s*(?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
_REFRESH = r"""(?is)^\s*(?:[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?|url\s*=\s*)(?:"([^"]*)|'([^']*)|([^"'].*))"""
# Basic HTML entities; the ampersand comes last, so nothing is decoded twice.
_ENTITIES = ((r"&(lt|#0*60|#[xX]0*3[cC]);", "<"), (r"&(gt|#0*62|#[xX]0*3[eE]);", ">"), (r"&(quot|#0*34|#[xX]0*22);", '"'), (r"&(apos|#0*39|#[xX]0*27);", "'"), (r"&(#0*47|#[xX]0*2[fF]);", "/"), (r"&(amp|#0*38|#[xX]0*26);", "&"))
# Host and port without user info, without a port that is empty or the scheme's own.
_AUTHORITY = r"(?is)^(?:http://(?:.*@)?(.*?)(?::(?:80)?)?|https://(?:.*@)?(.*?)(?::(?:443)?)?|.*?://(?:.*@)?(.*?):?)\z"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _straight(p: Column) -> Column:
    """A path without ``.`` and ``..``, which goes no higher than the root (RFC 3986, 5.2.4)."""
    steps = F.split(p, "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))  # noqa: E731  # the first is the empty one before the root
    walk = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    last = F.element_at(steps, -1)
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(kept, F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))).otherwise(p)


def _decoded(link: Column) -> Column:
    for entity, c in _ENTITIES:
        link = F.regexp_replace(link, entity, c)
    return link


def address(url: Column) -> Column:
    """The node of a url: host in lower case, path without dot segments, and query.

    Scheme, user info, fragment and the scheme's own port don't count; an empty
    path is ``/`` (RFC 3986, 6.2.3). Null without ``://``.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    place = F.regexp_replace(F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host(url)), _AUTHORITY, "$1$2$3")
    steps = F.when(path(url) == "", F.lit("/")).otherwise(_straight(path(url)))
    return F.when(F.instr(url, "://") > 0, F.concat(place, steps, query))


def _resolved(base: Column, link: Column) -> Column:
    """A link as written in a page, as a url with scheme; null for schemes without hosts, like ``mailto:``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(root, path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def rule_of(url: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of a url, both null if no rule fits.

    ``rules`` are (``host/path``, verdict). A rule fits its host and subdomains
    where the url's path starts with the rule's; the longest wins, among equally
    long ones the first in alphabetical order.
    """
    h, p = host(url), path(url)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last that fits stays
        domain, slash, rest = rule.partition("/")
        fits = ((h == domain) | h.endswith("." + domain)) & p.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _attribute(parts: Column, name: str) -> Column:
    """The first attribute of that name, decoded; empty without one."""
    first = F.get(F.filter(parts, lambda x: x.rlike(rf"(?is)^{name}\s*(?:=|\z)")), F.lit(0))
    text = F.regexp_extract(F.coalesce(first, F.lit("")), r"(?s)=\s*(.*)\z", 1)
    return _decoded(F.when(text.rlike("^[\"']"), text.substr(F.lit(2), F.length(text) - 2)).otherwise(text))


def _tag(tag: Column) -> Column:
    """Kind and link of a tag: ``base``, or ``goes`` for canonical links and refreshes; other tags have no link."""
    parts = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    href, content = _attribute(parts, "href"), _attribute(parts, "content")
    refresh = F.concat(*(F.regexp_extract(content, _REFRESH, k) for k in (1, 2, 3)))
    canonical = F.array_contains(F.split(F.lower(_attribute(parts, "rel")), r"\s+"), "canonical")
    link = (
        F.when(tag.rlike(r"(?i)^<base"), href)
        .when(tag.rlike(r"(?i)^<link"), F.when(canonical, href))
        .when(F.lower(F.trim(_attribute(parts, "http-equiv"))) == "refresh", refresh)
    )
    clean = F.regexp_replace(F.regexp_replace(link, r"^\s+|\s+$", ""), r"[\t\r\n]", "")
    return F.struct(F.when(tag.rlike(r"(?i)^<base"), F.lit("base")).otherwise(F.lit("goes")).alias("kind"), clean.alias("link"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``a, b`` between the nodes of pages and of what they redirect or point to as canonical.

    ``rel`` may hold several words, a relative link starts from the page's first
    ``<base href>``, and comments, scripts, styles, titles and text areas hold no
    tags. Null urls and texts have no edges.
    """
    rows = pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")).filter(F.instr("url", "://") > 0)
    told = rows.filter(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", F.regexp_replace("html", _HIDDEN, " ").alias("html"))
    wanted = F.filter(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)), lambda tag: tag.rlike(r"(?i)^<(?:link|meta|base)[\s/]"))
    tags = told.select("url", F.transform(wanted, _tag).alias("tags"))
    written = F.get(F.filter("tags", lambda t: (t["kind"] == "base") & (t["link"] != "")), F.lit(0))["link"]
    based = tags.select("url", F.coalesce(_resolved(F.col("url"), written), F.col("url")).alias("base"), F.explode(F.filter("tags", lambda t: (t["kind"] == "goes") & (t["link"] != ""))["link"]).alias("link"))
    return based.select(address(F.col("url")).alias("a"), address(_resolved(F.col("base"), F.col("link"))).alias("b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``.

    A rule of the page's own decides, an allowing one also against blocked
    aliases. Otherwise a page is blocked if any address of its component is
    blocked by rule, its own plain address included, and allowed if none is.
    Pages without url, and pages without rule and link, are allowed; a page whose
    html is null or empty has no link of its own, but others may link to it.
    Repeated pages stay repeated. Html of any length is read whole.
    """
    own = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"))
    rule, verdict = rule_of(F.col("url"), rules)
    judged = own.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), rule.alias("rule"), verdict.alias("_own"), address(F.col("url")).alias("_node"))
    edges = settled(links(pages, url, html), "links")
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    tied = components(edges).unionByName(loops)
    _, blocked = rule_of(F.concat(F.lit("x://"), F.col("node")), rules)
    bad = tied.filter(blocked == "block").select("component").distinct()
    # Nodes of components that hold a blocked address; every other page needs no join partner.
    aliases = settled(tied.join(bad, "component", "left_semi").select(F.col("node").alias("_node")).distinct(), "blocked-aliases").withColumn("_alias", F.lit(True))
    released(edges)
    return judged.join(aliases, "_node", "left").select(
        "id", "host", "path", "rule", F.coalesce("_own", F.when(F.col("_alias"), F.lit("block")), F.lit("allow")).alias("verdict")
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    """A pattern as an SQL text; DuckDB's patterns never give back what they took, so need no possessive marks."""
    return "'" + pattern.replace("*+", "*").replace("++", "+").replace("?+", "?").replace("'", "''") + "'"


def _address_sql(url: str) -> str:
    h = _LOWER.format(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")
    p = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    place = rf"regexp_replace(regexp_extract({url}, '(?s)^(.*?://)', 1) || {h}, {_quoted(_AUTHORITY)}, '\1\2\3')"
    return rf"{place} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || regexp_extract({url}, '(?s)^.*?://[^?#]*(\?[^#]*)', 1)"


def _attribute_sql(name: str) -> str:
    first = rf"coalesce(list_filter(parts, lambda x: regexp_matches(x, '(?is)^{name}\s*(?:=|\z)'))[1], '')"
    text = rf"regexp_extract({first}, '(?s)=\s*(.*)\z', 1)"
    out = f"CASE WHEN regexp_matches({text}, '^[\"'']') THEN substr({text}, 2, length({text}) - 2) ELSE {text} END"
    for entity, c in _ENTITIES:
        out = f"regexp_replace({out}, {_quoted(entity)}, {_quoted(c)}, 'g')"
    return out


def _resolved_sql(base: str, link: str) -> str:
    root, at = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    folder = f"regexp_replace({at}, '[^/]*$', '')"
    return f"""CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link}
      WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN starts_with({link}, '//') THEN regexp_extract({base}, '(?s)^(.*?)://', 1) || ':' || {link}
      WHEN starts_with({link}, '/') THEN {root} || {link}
      WHEN regexp_matches({link}, '^[?#]') THEN {root} || {at} || {link}
      ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {link} END"""


def sql(pages: str = "SELECT page_id, url, html FROM pages") -> str:
    """The judgement of ``pages`` under the contract's rules, for links without dot segments."""
    return rf"""
WITH RECURSIVE input AS ({pages}), page AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    CASE WHEN contains(url, '://') THEN {_address_sql("url")} END AS node
  FROM input
), tags AS (
  SELECT page_id, url, node, row_number() OVER () AS n, regexp_extract_all(regexp_replace(html, {_quoted(_HIDDEN)}, ' ', 'g'), {_quoted(_TAG)}) AS tags
  FROM page WHERE node IS NOT NULL
), tag AS (SELECT n, url, node, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM tags
), part AS (
  SELECT *, regexp_extract_all(tag, {_quoted(_ATTRIBUTE)}) AS parts FROM tag WHERE regexp_matches(tag, '(?i)^<(?:link|meta|base)[\s/]')
), said AS (
  SELECT n, url, node, k, lower(substr(tag, 2, 4)) AS kind, {_attribute_sql("href")} AS href, lower({_attribute_sql("rel")}) AS rel,
    lower(trim({_attribute_sql("http-equiv")})) AS equiv, {_attribute_sql("content")} AS content FROM part
), told AS (
  SELECT n, url, node, k, kind, regexp_replace(regexp_replace(CASE kind WHEN 'base' THEN href
      WHEN 'link' THEN CASE WHEN list_contains(string_split_regex(rel, '\s+'), 'canonical') THEN href END
      ELSE CASE WHEN equiv = 'refresh' THEN regexp_extract(content, {_quoted(_REFRESH)}, 1) || regexp_extract(content, {_quoted(_REFRESH)}, 2) || regexp_extract(content, {_quoted(_REFRESH)}, 3) END
    END, '^\s+|\s+$', '', 'g'), '[\t\r\n]', '', 'g') AS link FROM said
), base AS (SELECT n, arg_min(link, k) AS written FROM told WHERE kind = 'base' AND link <> '' GROUP BY n
), based AS (
  SELECT node, link, coalesce({_resolved_sql("url", "written")}, url) AS base
  FROM told LEFT JOIN base USING (n) WHERE kind <> 'base' AND link <> ''
), target AS (SELECT node, {_resolved_sql("base", "link")} AS link FROM based
), edge AS (SELECT node AS a, {_address_sql("link")} AS b FROM target WHERE contains(link, '://')
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge
), rules(host, path, rule, verdict) AS (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')
), node AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/]*') AS host, regexp_extract(a, '^[^/]*([^?]*)', 1) AS path FROM both_ways
), bad AS (
  SELECT node FROM node LEFT JOIN rules r ON (node.host = r.host OR ends_with(node.host, '.' || r.host)) AND starts_with(node.path, r.path)
  GROUP BY node HAVING arg_max(verdict, length(rule)) = 'block'
), reached AS (SELECT node FROM bad UNION SELECT b FROM reached JOIN both_ways ON a = node
), numbered AS (SELECT *, row_number() OVER () AS row FROM page
), decided AS (
  SELECT page_id, p.host, p.path, node, row, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS own
  FROM numbered p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id, p.host, p.path, node, row
)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN node IN (SELECT node FROM reached) THEN 'block' END, 'allow') AS verdict
FROM decided
"""


SQL = sql()
