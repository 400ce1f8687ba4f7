"""URL filtering with redirect equivalence.

Rules decide by host and path. Redirects and canonical links make URLs aliases
of each other: connected components over these edges carry a block decision to
every alias, except to URLs that a rule allows explicitly.

Links are read from ``link`` tags with ``canonical`` among their ``rel`` values and
from ``meta`` refresh tags, resolved against the page's first ``base`` or its URL: by
scheme, host, path or query, with dot segments removed. The first value of an
attribute counts, quoted or not; ``&amp;`` and its numeric forms stand for ``&``.

Defined cases: a null url, or one without ``://``, has empty host and path and no
aliases; null html has no links, html and tags of any length are read whole; a link without a target, to a fragment or to a scheme without
``://`` is no link; of rules that fit, the longest wins, and of the same rule stated
twice ``allow``; repeated pages, and pages that share an id, each get their own answer;
an empty table gives an empty result; extra columns of ``pages``, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.components import components
from codeweft.llm.salting import salted_join
from codeweft.sources.scratch import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node(url: Column) -> Column:
    """What a URL names: scheme and host in lower case, without the fragment; null if there is no host."""
    bare = F.substring_index(F.trim(url), "#", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    rest = bare.substr(F.length(head) + 1, F.length(bare))
    return F.when(head != "", F.concat(F.translate(head, UPPER, LOWER), rest))


_TAG = r"""(?i)(<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_REFRESH = r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(.*?)\s*$"""


def _attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute, without its quotes; null if there is none."""
    names, values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), i) for i in (1, 2))
    mine = F.filter(F.zip_with(names, values, lambda n, v: F.when(F.lower(n) == name, v)), lambda v: v.isNotNull())
    return F.trim(F.regexp_replace(F.get(mine, 0), r"""^["']|["']$""", ""))


def _target(content: Column) -> Column:
    """The target of a refresh: up to the closing quote if it begins with one."""
    target = F.regexp_extract(content, _REFRESH, 1)
    inner = F.regexp_extract(target, r"""(?s)^(["'])(.*?)(?:\1.*)?$""", 2)
    return F.when(target.rlike(r"""^["']"""), inner).otherwise(target)


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out."""
    parts = F.split(path, "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def resolve(base: Column, ref: Column) -> Column:
    """The URL that ``ref`` names on a page at ``base``; null if it names none, or none but the page."""
    ref = F.substring_index(F.trim(ref), "#", 1)
    bare = F.substring_index(base, "#", 1)
    scheme = F.regexp_extract(bare, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    path = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*([^?]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/")
    ref_path, ref_query = F.substring_index(ref, "?", 1), F.regexp_extract(ref, r"(?s)([?].*)$", 1)
    return (
        F.when((ref == "") | ref.isNull() | (origin == ""), None)
        .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(ref.contains("://"), ref))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, without_dots(ref_path), ref_query))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, ref_path)), ref_query))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``(a, b)`` nodes that pages declare to be the same: canonical links and refresh redirects."""
    tags = F.regexp_extract_all("html", F.lit(_TAG), 1)
    found = pages.select("url", _once(F.filter(tags, lambda t: t.rlike("(?i)canonical|refresh|^<base")).alias("tags"))).where("size(tags) > 0")
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: _attribute(t, "href")), lambda h: h.isNotNull())
    found = found.select("url", "tags", _once(_plain(F.get(bases, 0)).alias("base")))
    found = found.select("url", "tags", _once(F.coalesce(resolve(F.col("url"), F.col("base")), F.col("url")).alias("from")))
    found = found.select("url", "from", F.explode("tags").alias("tag"))
    tag = F.col("tag")
    canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    to = F.when(canonical, _attribute(tag, "href")).when(refresh, _attribute(tag, "content"))
    named = found.select("url", "from", _once(to.alias("to"), refresh.alias("refresh")))
    named = named.select("url", "from", _once(_plain(F.when(F.col("refresh"), _target(F.col("to"))).otherwise(F.col("to"))).alias("to")))
    named = named.select("url", _once(resolve(F.col("from"), F.col("to")).alias("to")))
    return named.select(_once(node(F.col("url")).alias("a"), node(F.col("to")).alias("b"))).where("a <> b")


def _once(*values: Column) -> Column:
    """Columns that later expressions take as they are: neither projections nor filters are merged across a generator."""
    return F.inline(F.array(F.struct(*values)))


def _plain(ref: Column) -> Column:
    return F.regexp_replace(ref, "&(?:amp|#38|#x26);", "&")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(rule, rule_host, rule_path, rule_verdict)``; a rule is a host, then a path from its first slash on."""
    fold = str.maketrans(UPPER, LOWER)
    split = [(v, r, r.partition("/")[0]) for v, r in rules]
    rows = [(r, h.translate(fold), r[len(h) :], v) for v, r, h in split]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, rule_verdict string")


def decide(urls: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """``(key, host, path)`` rows to ``(key, rule, rule_verdict)``: the longest rule that fits; no row if none does.

    Hosts meet rules on equal host suffixes, so the work is the number of labels
    of a host, not the number of rules. ``small``: the rules are known to fit a broadcast.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    parts = urls.select("key", "path", F.explode(suffix).alias("rule_host"))
    fits = parts.join(F.broadcast(rules), "rule_host") if small else salted_join(parts, rules, "rule_host")
    best = F.min_by(F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), "rule", "rule_verdict")).alias("r")
    return fits.where(F.startswith("path", "rule_path")).groupBy("key").agg(best).select("key", "r.rule", "r.rule_verdict")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """A verdict for each page: ``page_id, host, path, rule, verdict, aliased``.

    ``redirects(a, b)`` adds known redirects between URLs to the links that pages
    declare. A page without a rule is blocked if an alias of it is blocked by a
    rule, whether or not that alias is a page itself; else it is allowed.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "urls")
    table, small = rule_table(spark, rules), len(rules) <= 10_000
    pages = pages.select("page_id", "url", "html")
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select(node(F.col("a")), node(F.col("b"))))
    # Written, so that the keys that tell rows apart stay as they are; a URL that names no node is one by its key.
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("id"))
    judged = ws.put(judged.withColumn("key", F.monotonically_increasing_id()).withColumn("id", F.coalesce("id", F.col("key").cast("string"))))
    out = judged.join(decide(judged, table, small), "key", "left")
    blocked = _blocked_aliases(ws.put(links.where("a <> b").distinct()), table, small, ws)
    if blocked is None:
        out = out.withColumn("aliased", F.lit(False))
    else:
        out = salted_join(out, blocked.withColumn("aliased", F.lit(True)), "id", "left", salt=F.col("key"))
    aliased = F.coalesce("aliased", F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(aliased, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), aliased.alias("aliased"))


def _blocked_aliases(links: DataFrame, rules: DataFrame, small: bool, ws: Workspace) -> DataFrame | None:
    """Nodes whose component holds a node that a rule blocks; None if there are no links."""
    if links.isEmpty():
        return None
    member = ws.put(components(links, ws))
    named = member.select(F.col("id").alias("key"), host(F.col("id")).alias("host"), path(F.col("id")).alias("path"))
    bad = decide(named, rules, small).where("rule_verdict = 'block'").select(F.col("key").alias("id"))
    bad = member.join(bad, "id").select("component").distinct()
    return ws.put(salted_join(member, bad, "component").select("id"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _node_sql(url: str) -> str:
    bare = f"split_part(trim({url}), '#', 1)"
    head = f"regexp_extract({bare}, '(?s)^(.*?://[^/?]*)', 1)"
    fold = f"translate({head}, '{UPPER}', '{LOWER}')"
    return f"CASE WHEN {head} <> '' THEN {fold} || substr({bare}, length({head}) + 1) END"


def _parts_sql(url: str) -> str:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return (
        f"coalesce(translate(regexp_extract({url}, '{pattern}', 1), '{UPPER}', '{LOWER}'), '') AS host, "
        f"coalesce(regexp_extract({url}, '{pattern}', 2), '') AS path"
    )


_RULES_SQL = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
_BEST_SQL = "(SELECT max_by({0}, length(rule)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))"

def _attr_sql(name: str) -> str:
    """An attribute's first value, among all attributes of a tag."""
    every = """regexp_extract_all(tag, '[^\\s"''<>/=]+\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+)')"""
    one = f"list_filter({every}, lambda x: lower(trim(split_part(x, '=', 1))) = '{name}')[1]"
    return f"""trim(trim(regexp_replace({one}, '^[^=]*=\\s*', ''), '"'''))"""


def _resolve_sql() -> str:
    """The reference ``r`` on a page at ``f``."""
    bare = "split_part(f, '#', 1)"
    path = f"regexp_extract({bare}, '(?s)^.*?://[^/?]*([^?]*)', 1)"
    origin = f"regexp_extract({bare}, '(?s)^(.*?://[^/?]*)', 1)"
    folder = f"(CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '[^/]*$', '') ELSE '/' END)"
    query, own = "regexp_extract(r, '(?s)([?].*)$', 1)", "split_part(r, '?', 1)"

    def plain(p: str) -> str:
        parts = f"string_split({p}, '/')"
        fold = "lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE a || x END"
        kept = f"list_reduce(list_transform({parts}, lambda s: [s]), {fold})"
        return f"(array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END)"

    return (
        f"CASE WHEN r IS NULL OR r = '' OR {origin} = '' THEN NULL"
        " WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(r, '://') THEN r END"
        f" WHEN starts_with(r, '//') THEN regexp_extract({bare}, '(?s)^(.*?)://', 1) || ':' || r"
        f" WHEN starts_with(r, '/') THEN {origin} || {plain(own)} || {query}"
        f" WHEN starts_with(r, '?') THEN {origin} || {path} || r"
        f" ELSE {origin} || {plain(folder + ' || ' + own)} || {query} END"
    )


_TAG_SQL = """(?i)<(?:link|meta|base)\\b(?:[^>"'']+|"[^"]*"|''[^'']*'')*>"""

OP10_SQL = f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {_RULES_SQL}) v(verdict, rule, rh, rp)),
tags AS (
  SELECT k, url, unnest(t) AS tag, generate_subscripts(t, 1) AS o
  FROM (SELECT row_number() OVER () AS k, url, regexp_extract_all(html, '{_TAG_SQL}') AS t FROM pages)
),
attrs AS (
  SELECT k, url, o, lower(regexp_extract(tag, '^<([A-Za-z]+)', 1)) AS kind, lower({_attr_sql('rel')}) AS rel, {_attr_sql('href')} AS href,
         lower({_attr_sql('http-equiv')}) AS equiv, {_attr_sql('content')} AS content
  FROM tags
),
wanted AS (
  SELECT k, url, o, kind,
         CASE WHEN kind = 'base' THEN href
              WHEN kind = 'link' AND list_contains(regexp_split_to_array(rel, '\\s+'), 'canonical') THEN href
              WHEN kind = 'meta' AND equiv = 'refresh' THEN regexp_extract(content, '(?is)^\\s*[0-9.]*\\s*[;,]?\\s*url\\s*=\\s*(.*)$', 1) END AS r
  FROM attrs
),
refs AS (
  SELECT k, url, o, kind,
         split_part(trim(regexp_replace(CASE WHEN kind = 'meta' AND r[1] IN ('"', '''') THEN split_part(r[2:], r[1], 1) ELSE r END, '&(amp|#38|#x26);', '&', 'g')), '#', 1) AS r
  FROM wanted WHERE r IS NOT NULL
),
based AS (
  SELECT k, {_resolve_sql()} AS f
  FROM (SELECT k, any_value(url) AS f, arg_min(r, o) AS r FROM refs WHERE kind = 'base' GROUP BY k)
),
found AS (
  SELECT url, {_resolve_sql()} AS t
  FROM (SELECT refs.url, coalesce(based.f, refs.url) AS f, refs.r FROM refs LEFT JOIN based ON based.k = refs.k WHERE refs.kind <> 'base')
),
links AS (SELECT {_node_sql('url')} AS a, {_node_sql('t')} AS b FROM found WHERE t IS NOT NULL),
pairs AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
nodes AS (SELECT DISTINCT a AS id, {_parts_sql('a')} FROM pairs),
bad AS (
  SELECT id FROM nodes WHERE {_BEST_SQL.format('verdict')} = 'block'
  UNION SELECT pairs.b FROM bad JOIN pairs ON pairs.a = bad.id
),
parsed AS (SELECT page_id, {_node_sql('url')} AS id, {_parts_sql('url')} FROM pages),
ruled AS (SELECT page_id, id, host, path, {_BEST_SQL.format('rule')} AS rule, {_BEST_SQL.format('verdict')} AS rv FROM parsed)
SELECT page_id, host, path, rule,
       coalesce(rv, CASE WHEN id IN (SELECT id FROM bad) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(id IN (SELECT id FROM bad), false) AS aliased
FROM ruled
"""
