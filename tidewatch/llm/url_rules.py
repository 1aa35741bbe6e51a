"""URL filters over redirect equivalence.

Urls that redirect to each other, or name each other as canonical, are one resource: connected
components over those links. A rule decides for the urls it fits; a block of any url in a component
spreads to its aliases for which no rule speaks. An alias that a rule allows stays allowed.

Rules are looked up, never compared one by one with urls: a url offers the endings of its host, a
known host says which lengths of path it has rules for, and those prefixes of the path are joined.
"""

from __future__ import annotations

import html as html_text
import re
import string
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, travels_with_tasks
from tidewatch.llm.components import connected_components
from tidewatch.session import configure, settle

travels_with_tasks(__name__)

# Comments and raw text are read over as a whole; an unclosed one reaches to the end.
TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b.*?(?:</\1|\Z)"
    r"|<(link|meta|base)[\s/]([^<>]*)>",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+))""")
REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"']+)""", re.IGNORECASE)

# The rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What stands between the host and ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def resource_key(url: Column) -> Column:
    """A digest of the url without its fragment, scheme and host in lower case; null of no url."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    tail = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    whole = F.concat(scheme, F.lit("://"), host_of(url), tail)
    return F.when(F.instr(url, "://") > 0, F.unhex(F.sha2(whole, 256)))


def declared_aliases(url: str, page: str) -> list[str]:
    """Absolute urls that a page names as canonical or sends its readers on to."""
    base, found = url, []
    for match in TAGS.finditer(page):
        tag = (match[2] or "").lower()
        if not tag:
            continue
        values = {
            name.lower(): html_text.unescape(a or b or c).strip()
            for name, a, b, c in reversed(ATTRIBUTES.findall(match[3]))
        }
        target = None
        if tag == "base" and base == url:
            base = _joined(url, values.get("href")) or url
        elif tag == "link" and "canonical" in values.get("rel", "").lower().split():
            target = values.get("href")
        elif tag == "meta" and values.get("http-equiv", "").lower() == "refresh":
            sent = REFRESH.match(values.get("content", ""))
            target = sent[1].strip() if sent else None
        target = _joined(base, target)
        if target and "://" in target:
            found.append(target)
    return found


def _joined(base: str, target: str | None) -> str | None:
    try:
        return urljoin(base, target) if target else None
    except ValueError:  # not a url at all
        return None


def page_links(pages: DataFrame) -> DataFrame:
    """``url, target`` of every canonical link and refresh in ``html`` of pages that have a url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [
                (url.as_py(), target)
                for url, page in zip(*batch.columns, strict=True)
                for target in declared_aliases(url.as_py(), page.as_py())
            ]
            columns = [pa.array([p[i] for p in pairs], type=pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["url", "target"])

    telling = pages.where(
        F.contains("url", F.lit("://")) & F.col("html").rlike("(?i)canonical|http-equiv")
    )
    return telling.select("url", "html").mapInArrow(run, "url string, target string")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``action, host, path`` rows of rules."""
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def decide(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of all distinct hosts and paths in ``places`` that a rule fits.

    A rule fits its host and all subdomains of it if the path starts with the rule's; the longest
    rule wins, of equally long ones an allowance. Of a rule both allowed and blocked the allowance counts. Rules with a null or an
    empty host, or another action than ``allow`` and ``block``, fit nothing; a null path is empty.
    """
    known = settle(
        rules.where("host != '' and action in ('allow', 'block')")
        .groupBy("host", F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.min("action").alias("verdict"))
        .withColumnsRenamed({"host": "rule_host", "path": "rule_path"})
    )
    lengths = settle(
        known.groupBy("rule_host").agg(
            F.collect_set(F.length("rule_path")).alias("lengths"),
            F.first(F.length(F.regexp_replace("rule_host", "[^.]", ""))).alias("dots"),
        )
    )
    # Labels in a rule's host: DNS allows 127, so this list is short whatever the number of rules.
    depths = [row["dots"] + 1 for row in lengths.select("dots").distinct().collect()]
    if not depths:
        return known.select(
            F.col("rule_host").alias("host"), F.col("rule_path").alias("path"),
            F.lit("").alias("rule"), "verdict",
        )
    endings = F.array_distinct(F.array(*(F.substring_index("host", ".", -d) for d in depths)))
    asked = places.where("host != ''").select("host", "path").distinct()
    offered = (
        asked.withColumn("rule_host", F.explode(endings))
        .join(lengths, "rule_host")
        .withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
        .withColumn("rule_path", F.expr("left(path, length)"))
    )
    fits = offered.join(known, ["rule_host", "rule_path"])
    size = F.length("rule_host") + F.length("rule_path")
    rank = F.struct(size, F.col("verdict") == "allow", F.length("rule_host"))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank)
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")


def blocked_resources(links: DataFrame, rules: DataFrame) -> DataFrame:
    """``key`` of every resource in a component of ``url, target`` links that holds a blocked url."""
    urls = links.select("url").union(links.select("target"))
    ends = settle(
        urls.select(
            resource_key(F.col("url")).alias("key"), host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
        ).where("key is not null").distinct()
    )
    edges = links.select(
        resource_key(F.col("url")).alias("a"), resource_key(F.col("target")).alias("b")
    ).where("a is not null and b is not null")
    hung = connected_components(edges).select(F.col("node").alias("key"), "component")
    # The node that names a component hangs on none.
    member = settle(hung.union(hung.select("component", "component").distinct()))
    named = ends.join(decide(ends, rules).where("verdict = 'block'"), ["host", "path"])
    blocked = named.select("key").distinct().join(member, "key").select("component").distinct()
    return settle(member.join(blocked, "component").select("key"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """A verdict on every row of ``pages`` (``page_id, url, html``; other columns are ignored).

    ``redirects`` may add ``url, target`` pairs to those that pages declare. Returns ``page_id, host,
    path, rule, verdict``: the rule's verdict where one fits; else ``block`` if a url joined to this
    one by links is blocked; else ``allow``. Urls that differ in their fragment only are one resource.
    Null urls and urls without ``://`` have an empty host and path, fit no rule and have no aliases;
    null or empty pages declare none, nor do links that are no urls. Long pages are read whole.
    Repeated rows and null ids are judged like any others. No pages give no rows.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("url", "target").where("url is not null"))
    links = settle(links.where("target is not null").distinct())
    url = F.col("url")
    places = settle(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"),
            path_of(url).alias("path"), resource_key(url).alias("key"),
        )
        .withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    )
    ruled = settle(decide(places, rules))
    tainted = blocked_resources(links, rules).withColumn("tainted", F.lit(True))
    told = places.join(ruled, ["host", "path"], "left").join(tainted, "key", "left")
    verdict = F.coalesce("verdict", F.when(F.col("tainted"), "block"), F.lit("allow"))
    return told.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
