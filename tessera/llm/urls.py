"""URL filters with redirect equivalence (operator 9). DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import materialize, require

#: The rules of the op9 query.
PRODUCTION_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")

#: More rules than this are joined to the hosts instead of being compiled into one expression.
COMPILED_RULES = 64


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[UrlRule]:
    """'block com/en/': a verdict, then a host and the start of a path. A host's
    letters are lower-cased; an empty host or another verdict is an error."""
    out = []
    for line in lines:
        verdict, _, rest = line.strip().partition(" ")
        host, slash, path = rest.strip().partition("/")
        if verdict not in ("block", "allow") or not host:
            raise ValueError(f"not a rule: {line!r}")
        out.append(UrlRule(verdict, host.lower(), slash + path))
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _node(url: Column) -> Column:
    """A URL as a node of the alias graph: scheme and host in lower case, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = lower_ascii(F.regexp_extract(bare, r"(?s)^(.*?://)[^/?#]*", 1))
    return F.when(F.instr(bare, "://") > 0, F.concat(scheme, host_of(bare), F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; it starts with / and can't leave the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    closed = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), closed)


def resolve(target: Column, base: Column) -> Column:
    """`target` as a URL with ://, seen from the URL `base`: absolute, //host/path, /path, path, ?query or
    #fragment. Null for an empty target, for one of another scheme (mailto:) and for a relative one if the base has no ://."""
    bare = F.regexp_replace(base, r"(?s)#.*$", "")
    origin = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(path_of(bare), r"(?s)^/|[^/]*$", ""))
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(origin, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("#"), bare)
        .when(target.startswith("?"), F.concat(origin, path_of(bare), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): from each page's URL to the targets of all its canonical links and meta
    refreshes, seen from its <base href> or else its URL, with &amp; decoded. Null html has none."""
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
    href = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
    refresh = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    target = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
    base = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"
    decoded = lambda c: F.regexp_replace(c, r"(?i)&(?:amp|#38|#x26);", "&")
    found = pages.select(
        F.col(url_col).alias("page"),
        decoded(F.regexp_extract(F.regexp_extract(html_col, base, 0), href, 1)).alias("base"),
        F.concat(
            F.transform(F.regexp_extract_all(html_col, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, href, 1)),
            F.transform(F.regexp_extract_all(html_col, F.lit(refresh), F.lit(0)), lambda x: F.regexp_extract(x, target, 1)),
        ).alias("to"),
    )
    seen = found.select("page", F.coalesce(resolve(F.col("base"), F.col("page")), F.col("page")).alias("base"), F.explode("to").alias("to"))
    edges = seen.select(_node(F.col("page")).alias("src"), _node(resolve(decoded(F.col("to")), F.col("base"))).alias("dst"))
    return edges.where("src <> dst")


def _compiled(rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits (ties: the last by name and verdict, so allow gives way), as
    a struct; null if none does."""
    fits = [
        F.when(
            ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def with_rule(pages: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """`pages` (with host and path) with `hit`: the longest rule that fits the host or one
    of its parent domains and starts the path. Up to COMPILED_RULES rules are one
    expression. More are joined: every distinct host and path, found map-side first, is cut to the
    lengths that the rules of each of its parent domains have, and what is left is equal to a
    rule's path or not. No rules are gathered, however many a domain has; of each
    domain only the distinct lengths are. Pages meet their URL's rule in a join that may split hot URLs."""
    if len(rules) <= COMPILED_RULES:
        return pages.withColumn("hit", _compiled(rules))
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, len(r.name), r.name, r.verdict) for r in rules], "rh string, rp string, n int, rule string, verdict string")
    lengths = table.groupBy(F.col("rh").alias("domain")).agg(F.collect_set(F.char_length("rp")).alias("lengths"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    seen = pages.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(parents).alias("parent"))
    fit = F.filter("lengths", lambda k: k <= F.char_length("path"))
    cut = seen.join(lengths, F.col("parent") == F.col("domain")).select("host", "path", "parent", F.explode(fit).alias("length"))
    cut = cut.select("host", "path", "parent", F.left(F.col("path"), F.col("length")).alias("start"))
    met = cut.join(table, (F.col("parent") == F.col("rh")) & (F.col("start") == F.col("rp")))
    best = met.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max(F.struct("n", "rule", "verdict")).alias("hit"))
    best = materialize(best, "url-rules")
    return pages.join(best, (F.col("host") == F.col("rule_host")) & (F.col("path") == F.col("rule_path")), "left").drop("rule_host", "rule_path")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[str] = PRODUCTION_RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, url, host, path, rule, verdict, component) of every row of `pages`.

    A page that a rule fits has the verdict of the longest one. The others have
    the verdict of their aliases: pages joined by redirects (an optional table src,
    dst of URLs; meta refresh counts too) and canonical links form components; if a
    rule allows a URL of the component, or none blocks one, they are
    allowed, else blocked. Targets that aren't pages are judged by the rules too. A page without an alias is
    allowed. Null URLs and those without :// have empty host and path, no rule, no
    alias, and are allowed. Repeated rows are judged alike. Only URLs on an edge enter the graph, so its size is
    that of the links, and a page meets its component's verdict in a join by URL.
    """
    require(pages, id_col, url_col, html_col)
    parsed = parse_rules(rules)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = with_rule(base, parsed).withColumn("node", _node(F.col("url")))
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst")))
    groups = materialize(connected_components(edges), "aliases")
    spots = with_rule(groups.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), parsed)
    decided = spots.groupBy("component").agg(
        F.max(F.when(F.col("hit.verdict") == "block", 1).otherwise(0)).alias("blocked"),
        F.max(F.when(F.col("hit.verdict") == "allow", 1).otherwise(0)).alias("allowed"),
    )
    verdicts = materialize(
        groups.join(decided, "component").select(
            F.col("node").alias("alias"), "component", F.when((F.col("blocked") == 1) & (F.col("allowed") == 0), "block").otherwise("allow").alias("shared")
        ),
        "alias-verdicts",
    )
    joined = judged.join(verdicts, F.col("node") == F.col("alias"), "left")
    return joined.select(
        F.col("id").alias(id_col), "url", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("shared"), F.lit("allow")).alias("verdict"), "component",
    )
