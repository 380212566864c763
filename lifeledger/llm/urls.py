"""URL filter: rules by host and path, and block decisions that follow redirects and canonical links.

A rule fits a host and all its subdomains if the path starts with the rule's path; the longest rule
wins. Addresses that redirect to each other, or name the same canonical address, are aliases: their
connected components are found by distributed star rounds. Inside a component an explicit allow takes
precedence: an address without a rule of its own is allowed if any alias is allowed by a rule, else
blocked if any alias is blocked, else allowed. An address with a rule keeps the rule's verdict.

Edges come from the pages (every canonical link and every refresh redirect outside comments, scripts and
other raw text; character references are decoded and targets resolved against the page's ``base`` element
or url) and from a table of redirects if there is one. Two addresses are the same node only if they differ
in scheme, fragment, the case of the host, or an empty path in place of ``/``. Null urls, or urls without ``://``, have an empty host and
path and no alias; no rule fits them and they are allowed. Repeated rows are judged one by one.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import named
from lifeledger.llm.components import components

# The rules, host, path and verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The address without scheme and fragment, its host in lower case; null for what is no address."""
    path = F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/"))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path, query))


def decoded(text: Column) -> Column:
    """The text with its character references decoded: numbers, and names of HTML 4 with their semicolon."""
    names = F.create_map(*[F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, chr(code))])

    def piece(part: Column, i: Column) -> Column:
        decimal, hexadecimal, name = (
            F.regexp_extract(part, pattern, 1) for pattern in ("^#([0-9]{1,7})", "^#[xX]([0-9a-fA-F]{1,6})", "^([A-Za-z][A-Za-z0-9]*);")
        )
        code = F.when(decimal != "", decimal.cast("int")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("int"))
        good = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        symbol = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code)), 8, "0")), "UTF-32")
        numbered = F.concat(symbol, F.regexp_replace(part, "^#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", ""))
        named = F.concat(F.try_element_at(names, name), F.regexp_replace(part, "^[A-Za-z0-9]*;", ""))
        return F.when(i == 0, part).otherwise(F.coalesce(numbered, named, F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(F.split(text, "&", -1), piece), "")


def resolved(target: Column, base: Column) -> Column:
    """The full address of a target on a page; null for what is none, as of other schemes without ``://``."""
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    start = F.regexp_extract(base, r"(?s)^.*?://[^?#]*", 0)
    query = F.regexp_extract(base, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), "(?s)^.*/", 0), F.lit("")), F.lit("/"))
    own = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    path = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    # A final . or .. stands for a folder.
    steps = F.split(F.regexp_replace(path, r"(?s)/(\.\.?)$", "/$1/"), "/", -1)
    walked = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    ).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    walk = F.concat(F.lit("/"), F.array_join(walked, "/"))
    out = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (host_of(base) == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), target))
        .when(own != "", F.concat(origin, walk, rest))
        .when(target.startswith("?"), F.concat(start, rest))
        .otherwise(F.concat(start, query, rest))
    )
    return out


#: Text that holds no tags: comments, and elements whose content is raw.
MASKED = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{n}\b.*?(?:</{n}\s*>|\z)" for n in ("script", "style", "textarea", "title", "xmp", "template"))
ATTRIBUTES = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
REFRESH = r"""(?is)^[^;,]*[;,]?\s*url\s*=\s*["']?([^"'\s]+)"""


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of exactly this name; null if there is none."""
    named_so = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTES), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(named_so, F.lit(0)), r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of each page's url with its canonical links and its refresh targets."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), MASKED, "")
    tags = F.regexp_extract_all(plain, F.lit(r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))

    def target(tag: Column) -> Column:
        rel = F.split(F.lower(F.coalesce(attribute(tag, "rel"), F.lit(""))), r"\s+")
        link = tag.rlike("(?i)^<link") & F.array_contains(rel, "canonical")
        refresh = tag.rlike("(?i)^<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
        moved = F.regexp_extract(decoded(attribute(tag, "content")), REFRESH, 1)
        return F.when(link, F.trim(decoded(attribute(tag, "href")))).when(refresh, moved)

    # Named inside one expression, so that filters pushed below the columns do not copy them.
    def found(all_tags: Column) -> Column:
        targets = F.filter(F.transform(all_tags, target), lambda t: t.isNotNull() & (t != ""))
        bases = F.filter(all_tags, lambda t: t.rlike("(?i)^<base") & attribute(t, "href").isNotNull())
        own = named(decoded(attribute(F.get(bases, F.lit(0)), "href")), lambda h: F.coalesce(resolved(h, F.col("url")), "url"))
        return F.when(F.size(targets) > 0, named(own, lambda page: F.filter(
            F.transform(targets, lambda t: resolved(t, page)), lambda t: t.isNotNull()
        )))

    return pages.select(F.col("url").alias("a"), F.explode(named(tags, found)).alias("b"))


def decide(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; nulls if none does."""
    # Strings of equal length cannot both fit, unless they are equal: then the first rule counts.
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. ``redirects`` has columns (a, b) of urls."""
    pages = pages.select("page_id", "url", "html")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b"))
    judged = lambda url: decide(host_of(url), path_of(url), rules)
    # Each side of a link stands for its address; only links between different addresses need rounds.
    form = lambda name: address(F.col(name))
    nodes = components(edges.select(form("a").alias("a"), form("b").alias("b")))
    known = pages.select("url").unionByName(edges.select(F.col("a").alias("url"))).unionByName(
        edges.select(F.col("b").alias("url"))
    ).distinct()
    group = F.coalesce("component", "node")
    votes = known.select(form("url").alias("node"), judged(F.col("url"))["verdict"].alias("v")).where(
        "node IS NOT NULL AND v IS NOT NULL"
    ).distinct().join(nodes, "node", "left").groupBy(group.alias("group")).agg(
        F.max(F.col("v") == "allow").alias("allowed")
    )
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        judged(F.col("url")).alias("own"), form("url").alias("node"),
    ).join(nodes, "node", "left").withColumn("group", group).join(votes, "group", "left")
    alias = F.when(F.col("allowed"), "allow").when(F.col("allowed").isNotNull(), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", alias).alias("verdict")
    )


def sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The result of ``judge`` without a table of redirects, as SQL."""
    quoted = lambda text: text.replace("'", "''")
    cases = lambda pick: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(h, p, v)}'"
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ) + " END"
    names = "MAP {" + ", ".join("'" + n + "': chr(" + str(c) + ")" for n, c in {**name2codepoint, "apos": 39}.items()) + "}"

    def value(tag: str, name: str) -> str:
        """First attribute of exactly this name, without its quotation marks."""
        own = f"list_filter(regexp_extract_all({tag}, '{quoted(ATTRIBUTES)}'), lambda a: lower(regexp_extract(a, '^[^\\s=]+')) = '{name}')[1]"
        bare = f"regexp_extract({own}, '(?s)^[^\\s=]+\\s*=\\s*(.*)$', 1)"
        return f"""regexp_replace(regexp_replace({bare}, '(?s)^"(.*)"$', '\\1'), '(?s)^''(.*)''$', '\\1')"""

    def decode(text: str) -> str:
        """Character references of a text."""
        decimal, hexadecimal = "regexp_extract(p, '^#([0-9]{1,7})', 1)", "regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,6})', 1)"
        code = f"coalesce(try_cast(nullif({decimal}, '') AS INTEGER), try_cast('0x' || nullif({hexadecimal}, '') AS INTEGER))"
        good = f"({code} > 0 AND {code} < 55296 OR {code} > 57343 AND {code} <= 1114111)"
        name = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)"
        return f"""array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p
          WHEN {good} THEN chr({code}) || regexp_replace(p, '^#([xX][0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});?', '')
          WHEN {names}[{name}] IS NOT NULL THEN {names}[{name}] || regexp_replace(p, '^[A-Za-z0-9]*;', '') ELSE '&' || p END), '')"""

    def resolve(t: str, base: str) -> str:
        """The full address of a target on a page."""
        host = f"coalesce(regexp_extract({base}, '^.*?://([^/?#]*)', 1, 's'), '')"
        folder = f"coalesce(nullif(regexp_extract(regexp_extract({base}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '^.*/', 0, 's'), ''), '/')"
        own, rest = f"regexp_extract({t}, '^[^?#]*', 0, 's')", f"regexp_extract({t}, '^[^?#]*(.*)$', 1, 's')"
        path = f"CASE WHEN starts_with({own}, '/') THEN {own} ELSE {folder} || {own} END"
        steps = f"string_split(regexp_replace({path}, '/(\\.\\.?)$', '/\\1/'), '/')"
        walk = f"""list_reduce({steps}, lambda x, y: CASE WHEN y = '..' THEN regexp_replace(x, '/[^/]*$', '', 's')
          WHEN y = '.' THEN x ELSE x || '/' || y END)"""
        scheme, other = "^[A-Za-z][A-Za-z0-9+.-]*://", "^[A-Za-z][A-Za-z0-9+.-]*:"
        return f"""CASE WHEN regexp_matches({t}, '{scheme}') THEN {t} WHEN {t} = '' OR regexp_matches({t}, '{other}') OR {host} = '' THEN NULL
          WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^(.*?:)//', 1, 's') || {t}
          WHEN {own} <> '' THEN regexp_extract({base}, '^.*?://[^/?#]*', 0, 's') || coalesce(nullif({walk}, ''), '/') || {rest}
          WHEN starts_with({t}, '?') THEN regexp_extract({base}, '^.*?://[^?#]*', 0, 's') || {rest}
          ELSE regexp_extract({base}, '^.*?://[^?#]*', 0, 's') || regexp_extract({base}, '^.*?://[^?#]*(\\?[^#]*)', 1, 's') || {rest} END"""

    return f"""
WITH RECURSIVE pages_tags AS (
  SELECT row_number() OVER () AS no, url, regexp_extract_all(regexp_replace(coalesce(html, ''), '{quoted(MASKED)}', '', 'g'),
    '(?is)<(?:link|meta|base)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS tags FROM pages
), tags AS (SELECT no, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM pages_tags
), raw AS (
  SELECT no, url, place, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) AS kind, {value("tag", "rel")} AS rel, {value("tag", "href")} AS href,
    {value("tag", "http-equiv")} AS equiv, {value("tag", "content")} AS content FROM tags
), bases AS (
  SELECT no, arg_min(h, place) AS h FROM (SELECT no, place, {decode("href")} AS h FROM raw WHERE kind = 'base' AND href IS NOT NULL) b GROUP BY no
), pages_base AS (SELECT raw.no, coalesce({resolve("h", "url")}, url) AS base FROM raw LEFT JOIN bases USING (no) GROUP BY raw.no, h, url
), targets AS (
  SELECT no, url, trim({decode("href")}) AS t FROM raw WHERE kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\\s+'), 'canonical')
  UNION ALL SELECT no, url, regexp_extract({decode("content")}, '{quoted(REFRESH)}', 1) FROM raw WHERE kind = 'meta' AND lower(trim(equiv)) = 'refresh'
), links AS (SELECT url AS a, {resolve("t", "base")} AS b FROM targets JOIN pages_base USING (no) WHERE t <> ''
), edges AS (SELECT a, b FROM links WHERE b IS NOT NULL
), known AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a FROM edges UNION ALL SELECT b FROM edges)
), parts AS (
  SELECT url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_extract(url, '^.*?://[^?#]*(\\?[^#]*)', 1, 's') AS query
  FROM known
), judged AS (
  SELECT url, host, path, {cases(lambda h, p, v: h + p)} AS rule, {cases(lambda h, p, v: v)} AS own,
    CASE WHEN host <> '' THEN host || coalesce(nullif(path, ''), '/') || query END AS node
  FROM parts
), pairs AS (
  SELECT x.node AS a, y.node AS b FROM edges JOIN judged x ON x.url = edges.a JOIN judged y ON y.url = edges.b
), both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach(node, other) AS (
  SELECT node, node FROM judged WHERE node IS NOT NULL
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
), votes AS (
  SELECT reach.node, bool_or(own = 'allow') AS allowed FROM reach JOIN judged ON judged.node = reach.other
  WHERE own IS NOT NULL GROUP BY reach.node
)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN judged ON pages.url IS NOT DISTINCT FROM judged.url LEFT JOIN votes ON votes.node = judged.node
"""
