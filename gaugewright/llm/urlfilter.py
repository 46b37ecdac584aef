"""URL filters with DataFrame functions: block decisions spread over redirects and canonical links.

Rules name a host with its subdomains and a path prefix. Pages that no rule fits take the decision
of their aliases: URLs that redirects (also ``refresh`` in a page's head) and canonical links
connect. A component with an explicitly allowed member is allowed; else, with a blocked member, it
is blocked; else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.operators.components import connected_components
from gaugewright.session import checkpointed

#: verdict, host, path
Rule = tuple[str, str, str]

#: Up to so many rules are tested one by one; more are joined by host.
CHAIN_RULES = 64

_BLANK = " \t\r\n\f"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to /, ?, # or the end, in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _plain(path: Column) -> Column:
    """A path without dot segments; an empty one is /."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    left = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), empty, step)
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(left) > 0), "/").otherwise("")
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(left, "/"), end)).otherwise(path)


def key_of(url: Column) -> Column:
    """A URL's node: host, path without dot segments and query, without scheme and fragment; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), _plain(path_of(url)), query))


def _strength(length: int, kind: str, rule: str) -> tuple[int, bool, str]:
    """What makes one of several fitting rules win: its length, then allow before block, then the greater name."""
    return length, kind == "allow", rule


def match_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """urls (with host and path) with ``rule`` (host and path of the longest that fits) and ``by_rule`` (its verdict), else null.

    Of rules of equal length an allowing one wins, then the one of the greater name, however many rules there are.
    """
    if len(rules) <= CHAIN_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for kind, host, path in sorted(rules, key=lambda r: _strength(len(r[1] + r[2]), r[0], r[1] + r[2])):
            fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
            rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
        return urls.withColumns({"rule": rule, "by_rule": verdict})
    known = urls.sparkSession.createDataFrame([(h, p, k, _strength(len(h + p), k, h + p)) for k, h, p in rules], "r_host string, r_path string, by_rule string, strength struct<n:int,allows:boolean,rule:string>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = urls.select("host", "path").distinct()
    fits = own.select("host", "path", F.explode(suffixes).alias("r_host")).join(known, "r_host").where(F.startswith(F.col("path"), F.col("r_path")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("strength.rule", "by_rule"), "strength").alias("m")).select("host", "path", "m.rule", "m.by_rule")
    return urls.join(best, ["host", "path"], "left")


def _resolve(target: Column, url: Column) -> Column:
    """An absolute URL for a link's target, resolved against the page's own; null for other schemes such as mailto and for a mere fragment."""
    target = F.btrim(target, F.lit(_BLANK))
    root = F.concat(F.lit("http://"), host_of(url))
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)?", 1))
    found = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target)).when(F.startswith(target, F.lit("/")), F.concat(root, target))
    found = found.when((target == "") | F.startswith(target, F.lit("#")) | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
    return found.when(F.startswith(target, F.lit("?")), F.concat(root, path_of(url), target)).otherwise(F.concat(root, folder, target))


#: What a page's reader doesn't take for markup: comments (also unclosed ones) and the text of these elements.
_HIDDEN = r"(?is)<!--(?:>|->|.*?(?:--!?>|$))|<(script|style|textarea|title|template|noframes|xmp)\b[^>]*>.*?(?:</\1\s*>|$)"
#: A link, meta or base tag; what is quoted may hold ``>``.
_TAG = r"""(?is)<(?:link|meta|base)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""
#: An attribute: name, then the value as it stands.
_ATTRIBUTE = r"""(?is)([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
#: A character reference by number.
_NUMBERED = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"


def _decoded(value: Column) -> Column:
    """Text with its character references by number, and those of &, quotes, < and >, replaced; other names stay."""
    signs = F.array_distinct(F.regexp_extract_all(value, F.lit(_NUMBERED), F.lit(1)))

    def put(text: Column, sign: Column) -> Column:
        digits = F.when(sign.rlike("^[xX]"), F.conv(F.substring(sign, 2, 6), 16, 10)).otherwise(sign).cast("int")
        real = digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        code = F.when(real, digits).otherwise(0xFFFD)
        return F.replace(text, F.concat(F.lit("&#"), sign, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    out = F.when(F.size(signs) > 0, F.aggregate(signs, value, put)).otherwise(value)
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def _plainly(value: Column) -> Column:
    """An attribute's value without its quotes."""
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def _attribute(name: str) -> Column:
    """The first value of an attribute among a tag's ``names`` and ``values``, as it stands; null if the tag has none."""
    return F.get("values", F.array_position("names", name).cast("int") - 1)


def alias_edges(pages: DataFrame) -> DataFrame:
    """src and dst nodes of the canonical links and refreshes in pages (url, html).

    Tags inside comments, scripts and other text that a browser doesn't read as markup don't count.
    A link is canonical if ``canonical`` is among the words of its rel. Targets are resolved against
    the page's first ``base`` with a target, itself resolved against the page's URL.
    """
    marked = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    shown = marked.select("url", F.regexp_replace("html", _HIDDEN, " ").alias("html"))
    # one step after another: an expression that uses its input often is given it as a column
    tags = shown.select("url", F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)).alias("tags"))
    names, values = (lambda t: F.transform(F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)), (lambda t: F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(2)))
    places = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: F.get(values(t), F.array_position(names(t), "href").cast("int") - 1)), lambda v: v.isNotNull())
    tag = tags.select("url", F.get(places, F.lit(0)).alias("base"), F.explode("tags").alias("tag"))
    tag = tag.select("url", "base", F.lower(F.substring("tag", 2, 4)).alias("kind"), names("tag").alias("names"), values("tag").alias("values")).where("kind <> 'base'")
    tag = tag.select("url", _plainly(F.col("base")).alias("base"), "kind", *[_plainly(_attribute(n)).alias(n.replace("-", "_")) for n in ("href", "rel", "http-equiv", "content")])
    told = (F.lower(F.trim("http_equiv")) == "refresh") & (F.col("kind") == "meta")
    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower(F.btrim("rel", F.lit(_BLANK))), r"\s+"), "canonical")
    tag = tag.select("url", "base", "kind", F.when(canonical, F.col("href")).when(told, F.col("content")).alias("value"))
    tag = tag.select("url", "kind", _decoded(F.col("base")).alias("base"), _decoded(F.col("value")).alias("value"))
    after = F.btrim(F.regexp_extract("value", r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*("[^"]*"?|'[^']*'?|.*)$""", 1), F.lit("\"'"))
    tag = tag.select("url", "base", F.when(F.col("kind") == "meta", after).otherwise(F.col("value")).alias("value"))
    linked = tag.select("url", "value", F.coalesce(_resolve(F.col("base"), F.col("url")), F.col("url")).alias("from"))
    linked = linked.select("url", _resolve(F.col("value"), F.col("from")).alias("target"))
    # a condition here would be pushed through all steps above, each time with their whole expressions
    edges = checkpointed(linked.select(key_of(F.col("url")).alias("src"), key_of(F.col("target")).alias("dst")))
    return edges.where("src is not null and dst is not null and src <> dst")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block) and by (rule, alias or default).

    ``pages`` has page_id, url and html; ``redirects``, if given, src and dst URLs. Other columns are
    ignored. A page's own rule always holds. A null url, or one without ``://``, has an empty host and
    path, fits no rule, has no aliases and is allowed. A null html has no links. Repeated rows get a
    row each; no pages give no rows.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst")).where("src <> dst"))
    aliases = connected_components(edges)
    nodes = aliases.withColumns({"host": F.regexp_extract("node", "(?s)^([^/?]*)", 1), "path": F.regexp_extract("node", "(?s)^[^/?]*([^?]*)", 1)})
    spread = match_rules(nodes, rules).groupBy("component").agg(F.max(F.col("by_rule") == "allow").alias("allowed"), F.max(F.col("by_rule") == "block").alias("blocked"))
    decided = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    by_alias = aliases.join(spread.select("component", decided.alias("by_alias")).where("by_alias is not null"), "component").select(F.col("node").alias("key"), "by_alias")
    # rows without a node, which may be many, are dealt by their id: no node begins with a blank
    node = F.coalesce(key_of(F.col("url")), F.concat(F.lit(" "), F.xxhash64("page_id", F.monotonically_increasing_id()).cast("string")))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node.alias("key"))
    judged = match_rules(own, rules).join(by_alias, "key", "left")
    verdict = F.coalesce("by_rule", "by_alias", F.lit("allow"))
    by = F.when(F.col("by_rule").isNotNull(), "rule").when(F.col("by_alias").isNotNull(), "alias").otherwise("default")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("by"))

