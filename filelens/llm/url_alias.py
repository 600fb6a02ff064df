"""URL filters with redirect equivalence.

A rule names a host and a path prefix, and blocks or allows its host with all
subdomains; the longest rule that fits an address decides. Addresses without a
rule take the decision of their aliases: connected components over redirect
and canonical-link edges, in which an explicit allow goes before a block.

Edges come from the pages themselves (``<link rel="canonical">`` and
``<meta http-equiv="refresh">``) and from any table of redirects. An address
is a node by host, path and query; scheme, fragment and the letter case of
the host do not matter. Targets may be relative.

Defined cases: a null address, or one without ``://``, has an empty host and
path, fits no rule, is no node and is allowed; a null page has no edges;
repeated rows get the same verdict each; an edge to an address that no page
has still links its aliases, and passes on its own rule's decision; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.operators.common import materialized

from . import components
from .common import col, fresh

# (action, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_AFTER = r"(?s)^.*?://(.*)$"


def _lower(s: Column) -> Column:
    """A-Z only, as hosts are compared byte by byte."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query (with its ``?``) of an address."""
    rest = F.coalesce(F.regexp_extract(url, _AFTER, 1), F.lit(""))
    after = F.regexp_replace(rest, r"^[^/?#]*", "")
    return (_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(after, r"^[^?#]*", 0),
            F.regexp_extract(after, r"^[^?#]*(\?[^#]*)?", 1))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. The rule
    table is a parameter of the job: it becomes one expression."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def node(url: Column) -> Column:
    """An address as a node: host, path and query; null without a host."""
    host, path, query = split_url(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


# What declares nothing, and the tags that may
_SILENT = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style|template)\b.*?(?:</\1\s*>|$)")
_TAG = re.compile(r"""(?is)<(link|meta)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""(?s)([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_REFRESH = re.compile(r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['"]?([^'"]*)""")


def declared(url: str, page: str) -> list[str]:
    """Absolute targets of a page's canonical links and refreshes."""
    found = []
    for m in _TAG.finditer(_SILENT.sub(" ", page)):
        at = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m[2])}
        if m[1].lower() == "link":
            target = at.get("href") if "canonical" in at.get("rel", "").lower().split() else None
        else:
            refresh = at.get("http-equiv", "").strip().lower() == "refresh" and _REFRESH.match(at.get("content", ""))
            target = refresh[1] if refresh else None
        if target and target.strip():
            try:
                found.append(urljoin(url, target.strip()))
            except ValueError:  # not an address
                continue
    return found


def _edges(batches):
    for b in batches:
        src, dst = [], []
        for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
            t = declared(u, h)
            src += [u] * len(t)
            dst += t
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses of canonical links and redirects that pages (url,
    html) declare; only pages that name either reach Python."""
    return pages.where(col("url").isNotNull() & col("html").rlike(r"(?i)canonical|http-equiv")) \
        .select(col("url"), col("html")).mapInArrow(_edges, "src string, dst string")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, alias_of) per row of ``pages``
    (page_id, url, html): ``alias_of`` is the component's least address, null
    if the address has no alias."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = edges.select(node(F.col("src")).alias("u"), node(F.col("dst")).alias("v")).where("u <> v")
    member = materialized(components.classes(edges, "u", "v", "alias_of"), "url-classes")
    # the decision of a component: an explicit allow, else a block, else none;
    # its nodes have their own rules whether or not they are pages
    n = F.col("node")
    own = rule_for(F.regexp_extract(n, r"^[^/?]*", 0), F.regexp_extract(n, r"^[^/?]*([^?]*)", 1), rules)["verdict"]
    decided = member.groupBy("alias_of").agg(F.min(own).alias("_group_verdict"))  # allow < block, nulls aside
    known = materialized(member.join(decided, "alias_of").withColumnRenamed("node", "_node"), "url-verdicts")
    host, path, _ = split_url(col("url"))
    out = pages.select(col("page_id"), col("url"), host.alias("host"), path.alias("path"), node(col("url")).alias("_n"))
    out = out.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    return out.join(known, F.col("_n") == F.col("_node"), "left").select(
        "page_id", "url", "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.col("_group_verdict"), F.lit("allow")).alias("verdict"), "alias_of")


def keep_allowed(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The rows of ``pages`` whose address is allowed, with all columns."""
    verdict = fresh("url_verdict", pages)
    bad = judge(pages, redirects, rules).where("verdict = 'block'").select(col("url").alias(verdict)).distinct()
    return pages.join(bad, col("url") == F.col(verdict), "left_anti")
