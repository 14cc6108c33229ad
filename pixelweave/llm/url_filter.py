"""URL filters: host and path rules, and block decisions that spread along redirects and canonical links.

A rule fits its host and all subdomains, where the path starts with the rule's; of those that fit, the longest
wins, and its verdict is final for the url itself. Urls joined by redirect or canonical-link edges are aliases: the
components of these edges are found distributedly, and within one a url without a rule of its own takes allow if
any member is explicitly allowed (allow has precedence), else block if any is blocked, else allow. Targets that are
no rows themselves count as members.

Edges come from the pages (canonical links, refresh redirects) or from a table (src, dst), such as a crawler's log
of HTTP redirects. With variants, which is a guess and so not the default, they also come from the redirects that sites make as a
rule: from a url to the one without tracking parameters, a slash, index page or .html at the path's end, and a default port,
by https. A path is only shortened where something is left of it.

Cases: a null url, or one without '://', has empty host and path, fits no rule and is allowed; null html has no
edges; repeated rows are judged each; an empty table gives an empty result; columns of other names are ignored, whatever
they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches
from .components import connected_components

#: (verdict, host, path)
Rule = tuple[str, str, str]
LOWER = {c: c + 32 for c in range(65, 91)}
LINK = re.compile(r"<link\s[^<>]*>", re.I)  # an unclosed tag ends at the next, so each character is read once
META = re.compile(r"<meta\s[^<>]*>", re.I)
TRACKING = re.compile(r"(?:utm_\w*|fbclid|gclid|msclkid|ref)(?:=|$)", re.I)
PORT = re.compile(r":(?:80|443)$")
LAST = re.compile(r"(?:/index\.html?|\.html?|/)$", re.I)
CANONICAL = re.compile(r"""\srel\s*=\s*["']?canonical\b""", re.I)
HREF = re.compile(r"""\shref\s*=\s*["']?([^"'\s>]+)""", re.I)
REFRESH = re.compile(r"""http-equiv\s*=\s*["']?refresh\b""", re.I)
TARGET = re.compile(r"""url\s*=\s*["']?([^"'\s>]+)""", re.I)
REST = re.compile(r"([^/?#]*)([^?#]*)([^#]*)", re.S)


def parts(url: str | None) -> tuple[str, str, str | None]:
    """Host, path and node of a url; the node is the url without fragment, host in lower case, an empty path as '/'."""
    scheme, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None
    host, path, query = REST.match(rest).groups()
    host = host.translate(LOWER)
    return host, path, f"{scheme.translate(LOWER)}://{host}{path or '/'}{query}"


def usual(url: str | None) -> str | None:
    """The node that sites redirect a url's variants to."""
    node = parts(url)[2]
    if node is None:
        return None
    host, path, query = REST.match(node.partition("://")[2]).groups()
    kept = "&".join(x for x in query[1:].split("&") if x and not TRACKING.match(x))
    return f"https://{PORT.sub('', host)}{LAST.sub('', path) or '/'}{'?' + kept if kept else ''}"


def rule_of(host: str, path: str, rules: Sequence[Rule]) -> tuple[str | None, str | None]:
    """The longest rule that fits and its verdict, or nulls."""
    best = None
    for r in rules:
        verdict, h, p = r
        if path.startswith(p) and (host == h or host.endswith("." + h)) and (best is None or len(h) + len(p) > len(best[1]) + len(best[2])):
            best = r
    return (best[1] + best[2], best[0]) if best else (None, None)


def targets(url: str | None, html: str | None) -> list[str]:
    """Nodes of the canonical links and refresh redirects in a page; relative ones are resolved against its url."""
    found = [HREF.search(x) for x in LINK.findall(html or "") if CANONICAL.search(x)]
    found += [TARGET.search(x) for x in META.findall(html or "") if REFRESH.search(x)]
    out = []
    for m in found:
        if m:
            try:
                node = parts(urljoin(url or "", m[1]))[2]
            except ValueError:  # not a url, such as an unclosed bracket in the host
                continue
            if node:
                out.append(node)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, variants: bool = False, id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict, component of each row of pages (url, and html unless edges are given)."""
    small_batches(pages.sparkSession)
    with_html = edges is None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(1).to_pylist()
            htmls = b.column(2).to_pylist()
            split = [parts(u) for u in urls]
            ruled = [rule_of(h, p, rules) for h, p, _ in split]
            cols = [[x[0] for x in split], [x[1] for x in split], [x[2] for x in split], [x[0] for x in ruled], [x[1] for x in ruled]]
            links = pa.array([targets(u, h) + [x for x in (variants and usual(u),) if x] for u, h in zip(urls, htmls, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols), links], names=names)

    def rule_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdicts = [rule_of(*parts(n)[:2], rules)[1] for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(verdicts, pa.string())], names=["node", "component", "said"])

    strings = [T.StructField(c, T.StringType()) for c in ("host", "path", "node", "rule", "own")]
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), *strings, T.StructField("links", T.ArrayType(T.StringType()))])
    names = schema.names
    html = F.col("html") if with_html else F.lit(None).cast("string").alias("html")
    own = cut(pages.select(id_col, "url", html).mapInArrow(parse, schema), "pages")
    found = own.where("node is not null").select(F.col("node").alias("u"), F.explode("links").alias("v"))
    if edges is not None:
        found = found.unionByName(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    aliases = connected_components(found)
    ruled = cut(aliases.mapInArrow(rule_nodes, "node string, component string, said string"), "aliases")
    spread = F.when(F.bool_or(F.col("said") == "allow"), "allow").when(F.bool_or(F.col("said") == "block"), "block")
    said = ruled.groupBy("component").agg(spread.alias("spread"))
    by_node = ruled.join(said, "component").select(F.col("node").alias("n"), "component", "spread")
    out = own.join(by_node, F.col("node") == F.col("n"), "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"), "component")
