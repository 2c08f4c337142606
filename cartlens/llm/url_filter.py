"""URL filter rules with redirect equivalence.

A URL is judged by the longest rule that fits its host and path.  URLs that lead to the same
page are aliases: a page and its plain form (no scheme, fragment, tracking parameters, "www.",
default port or closing slash), the target of its canonical link, and the target of its
refresh redirect.  Aliases hang together as connected components, worked out on the cluster.
A page without a rule of its own is blocked if an alias is blocked and none is allowed by rule;
a rule of its own always comes first.
"""

from pyspark.sql import functions as F

from cartlens.llm.common import ascii_lower, components
from cartlens.session import materialise

# (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
TRACKING = "(^|&)(utm_[a-z]+|gclid|fbclid|ref)=[^&]*"


def host_of(url):
    """What stands between the first "://" and the next "/", "?" or "#", in lower case."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url):
    """What follows the host up to "?" or "#"; empty, as the host, without "://" or for null."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def plain(url):
    """The plain form of a URL, to which its other spellings lead; null without "://"."""
    rest = _rest(url)
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "(/index)?\\.html?$", ""), "/+$", "")
    query = F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def best_rule(host, path, rules=RULES):
    """A struct ``rule, verdict`` of the longest rule that fits, or null.

    ``rules`` is a short list held in the plan.  Of rules of equal length one that allows wins,
    then the first by name.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2]))
    for verdict, rule_host, rule_path in ordered:  # the last that fits is the longest
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(
            F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")
        )
        chosen = F.when(fits, found).otherwise(chosen)
    return chosen


def _target(url, href):
    """The address that ``href`` means on the page ``url``; null where there is none."""
    site = F.regexp_extract(url, "^[^/?#]*://[^/?#]*", 0)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, "^[^:]*:", 0), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(
            (href != "") & ~href.rlike("^([?#]|[A-Za-z][A-Za-z0-9+.-]*:)"),
            F.concat(site, F.regexp_extract(path_of(url), "^(.*/)?", 0), href),
        )
    )


def link_targets(url, html):
    """The array of canonical and redirect targets that a page names."""
    link = F.regexp_extract(html, "(?i)<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>", 0)
    canonical = F.regexp_extract(link, "(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
    meta = F.regexp_extract(html, "(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>", 0)
    redirect = F.regexp_extract(meta, "(?i)\\burl\\s*=\\s*['\"]?([^\"'\\s>]+)", 1)
    return F.filter(F.array(_target(url, canonical), _target(url, redirect)), lambda t: t.isNotNull())


def _node(url):
    """128 bits that name a URL."""
    return F.struct(F.xxhash64(url).alias("h1"), F.xxhash64(F.lit("url"), url).alias("h2"))


def judged(pages, rules=RULES):
    """``page_id, host, path, rule, verdict, inherited`` for each row of ``pages``.

    ``inherited`` tells that an alias decided.  Null URLs and URLs without "://" have no rule
    and no alias and are allowed; null HTML names no target.  Repeated rows are judged alike.
    URLs and HTML of any length are read whole; other columns, whatever their names, are not read.
    """
    url = F.col("url")
    seen = materialise(
        pages.select("page_id", "url", link_targets(url, F.coalesce("html", F.lit(""))).alias("targets")),
        "page-links",
    )
    read = seen.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.when(plain(url).isNotNull(), _node(url)).alias("node"),
    ).withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    named = seen.where(plain(url).isNotNull())
    targets = named.select("url", F.explode("targets").alias("target"))
    edges = (
        named.select(_node(url).alias("a"), _node(plain(url)).alias("b"))
        .unionByName(targets.select(_node(url).alias("a"), _node(F.col("target")).alias("b")))
        .unionByName(
            targets.where(plain(F.col("target")).isNotNull()).select(
                _node(F.col("target")).alias("a"), _node(plain(F.col("target"))).alias("b")
            )
        )
    )
    classes = components(edges, "url-classes")
    # Targets are judged too, whether or not they are pages themselves.
    target_rule = best_rule(host_of(F.col("target")), path_of(F.col("target")), rules)
    decided = (
        read.where("node is not null").select("node", "own.verdict")
        .unionByName(targets.select(_node(F.col("target")).alias("node"), target_rule["verdict"].alias("verdict")))
        .where("verdict is not null")
        .groupBy("node")
        .agg(
            F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"),
            F.max((F.col("verdict") == "block").cast("int")).alias("blocked"),
        )
    )
    # Classes and verdicts are stored before they meet: a class with very many URLs is then a
    # skewed shuffle that AQE splits, or its verdicts are small enough to be sent to the URLs.
    classes = materialise(classes, "url-members")
    by_class = materialise(
        decided.join(classes, "node")
        .groupBy("root")
        .agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        .where("blocked = 1 and allowed = 0"),
        "blocked-classes",
    )
    blocked = materialise(
        classes.join(by_class, "root").select(
            "node", F.lit(True).alias("inherited")
        ),
        "blocked-aliases",
    )
    read = materialise(read, "page-rules")
    inherited = F.coalesce(F.col("inherited") & F.col("own").isNull(), F.lit(False))
    # Two stored tables: AQE splits the shuffle of a URL that very many rows share.
    return read.join(blocked, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(inherited, F.lit("block")), F.lit("allow")).alias("verdict"),
        inherited.alias("inherited"),
    )


def query(pages):
    return judged(pages)


_SQL_REST = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"


def _sql_host(u):
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"translate(regexp_extract({_SQL_REST.format(u=u)}, '^[^/?#]*'), {letters})"


def _sql_path(u):
    return f"regexp_extract({_SQL_REST.format(u=u)}, '^[^/?#]*([^?#]*)', 1)"


def _sql_plain(u):
    host = f"regexp_replace(regexp_replace({_sql_host(u)}, '^www\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_replace({_sql_path(u)}, '(/index)?\\.html?$', ''), '/+$', '')"
    query = f"regexp_extract({_SQL_REST.format(u=u)}, '^[^?#]*\\?([^#]*)', 1)"
    query = f"regexp_replace(regexp_replace({query}, '{TRACKING}', '', 'g'), '^&', '')"
    return (
        f"CASE WHEN strpos({u}, '://') > 0 THEN {host} || {path}"
        f" || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
    )


def _sql_rule(u, rules=RULES):
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2]))
    cases = []
    for verdict, host, path in reversed(ordered):
        fits = (
            f"({_sql_host(u)} = '{host}' OR suffix({_sql_host(u)}, '.{host}'))"
            f" AND prefix({_sql_path(u)}, '{path}')"
        )
        cases.append(f"WHEN {fits} THEN '{verdict} {host}{path}'")
    return f"CASE {' '.join(cases)} END"


SQL = f"""
WITH RECURSIVE read AS (
    SELECT page_id, url, {_sql_host('url')} AS host, {_sql_path('url')} AS path,
        {_sql_plain('url')} AS plain, {_sql_rule('url')} AS own,
        regexp_extract(regexp_extract(coalesce(html, ''),
            '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'),
            '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS canonical,
        regexp_extract(regexp_extract(coalesce(html, ''),
            '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'),
            '(?i)\\burl\\s*=\\s*[''"]?([^"''\\s>]+)', 1) AS redirect
    FROM pages
), hrefs AS (
    SELECT url, canonical AS href FROM read UNION SELECT url, redirect FROM read
), targets AS (
    SELECT DISTINCT url, CASE
        WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
        WHEN prefix(href, '//') THEN regexp_extract(url, '^[^:]*:') || href
        WHEN prefix(href, '/') THEN regexp_extract(url, '^[^/?#]*://[^/?#]*') || href
        WHEN href <> '' AND NOT regexp_matches(href, '^([?#]|[A-Za-z][A-Za-z0-9+.-]*:)')
            THEN regexp_extract(url, '^[^/?#]*://[^/?#]*')
                || regexp_extract({_sql_path('url')}, '^(.*/)?') || href END AS target
    FROM hrefs
), edges AS (
    SELECT DISTINCT a, b FROM (
        SELECT 'u' || url AS a, 'u' || plain AS b FROM read WHERE plain IS NOT NULL
        UNION ALL SELECT 'u' || url, 'u' || target FROM targets
            WHERE target IS NOT NULL AND strpos(url, '://') > 0
        UNION ALL SELECT 'u' || target, 'u' || {_sql_plain('target')} FROM targets
            WHERE target IS NOT NULL AND strpos(url, '://') > 0 AND strpos(target, '://') > 0
    ) WHERE a <> b
), both_ways AS (
    SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
    SELECT DISTINCT a AS node, a AS other FROM both_ways
    UNION
    SELECT node, b FROM reach JOIN both_ways ON other = a
), decided AS (
    SELECT 'u' || url AS node, split_part(own, ' ', 1) AS verdict FROM read WHERE own IS NOT NULL
    UNION ALL
    SELECT 'u' || target, split_part({_sql_rule('target')}, ' ', 1) FROM targets
    WHERE strpos(url, '://') > 0 AND {_sql_rule('target')} IS NOT NULL
), blocked AS (
    SELECT reach.node FROM reach JOIN decided d ON d.node = other GROUP BY reach.node
    HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
)
SELECT page_id, host, path, split_part(own, ' ', 2) AS rule,
    CASE WHEN own IS NOT NULL THEN split_part(own, ' ', 1)
        WHEN 'u' || url IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END AS verdict,
    coalesce(own IS NULL AND 'u' || url IN (SELECT node FROM blocked), false) AS inherited
FROM read
"""
