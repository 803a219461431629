"""Line dedup by frequency within a site.

Pages are grouped by host. A line that stands on more than `ratio` of its
host's pages is boilerplate and dropped from all of them. A line is what a
reader sees as one: text between block tags, with inline tags left out, white
space (line feeds of the source too) as one space, and the common character
references decoded; other references stay as written. A line must stand on
`min_pages` pages at least, by default two: on a host of one page every line
stands on all pages, but none is repeated. From `often` pages on, a lower ratio
is enough: what ten pages of a large site repeat word for word is site text
even if most of its pages lack it, while two of a small site's ten pages may be
copies of one another.

A line is counted once a page, by a hash, and counts are
summed before they are dealt out, so a host with any share of the pages costs
one row per task and line. A host has few such lines: each stands on more than
`ratio` of its pages, so there are at most a mean page's lines over the lower ratio.
They come to the pages as one array per host.

Rows: a null page has no lines, a url without a host belongs to the host "",
repeated rows count as pages of their own, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.session import durable

#: Share of a host's pages, and pages, above and from which a line is boilerplate; and the same for lines that stand often.
RATIO, MIN_PAGES = 0.5, 2
OFTEN_RATIO, OFTEN = 0.1, 10
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)"
UNSEEN = r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->)"
#: Tags that do not end a line, and references that are decoded, in this order.
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
INLINE_TAG = r"(?i)</?(?:" + "|".join(INLINE) + r")(?:[ /][^>]*)?>"
REFERENCES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
#: Bytes of hosts and hashes up to which the boilerplate is broadcast; beyond that the join is salted.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def lines_of(html: Column) -> Column:
    """Runs of text between block tags, white space inside as one space, without empty ones."""
    # single spaces, by far the most, match nothing
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "<br>"), r"[\x09-\x0D]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, INLINE_TAG, ""), r"<[^>]*>", "\n")
    for written, meant in REFERENCES.items():
        text = F.replace(text, F.lit(written), F.lit(meant))
    lines = F.split(F.regexp_replace(text, "  +", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(sites: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, often_ratio: float = OFTEN_RATIO, often: int = OFTEN) -> DataFrame:
    """(host, bad array<bigint>) of rows (host, lines): hashes of the lines to drop, kept in the shared folder."""
    # outer, for else the optimiser computes the lines twice; a null hash stands for the page itself
    marks = F.concat(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))), F.array(F.lit(None).cast("long")))
    counts = sites.select("host", F.explode_outer(marks).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = durable(counts.filter(F.col("line").isNull() | (F.col("n") >= min(min_pages, often))))
    totals = counts.filter(F.col("line").isNull()).select("host", F.col("n").alias("pages"))
    bad = counts.filter(F.col("line").isNotNull()).join(totals, "host")
    bad = bad.filter((F.col("n") >= min_pages) & (F.col("n") > ratio * F.col("pages")) | (F.col("n") >= often) & (F.col("n") > often_ratio * F.col("pages")))
    return durable(bad.groupBy("host").agg(F.collect_list("line").alias("bad")))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, often_ratio: float = OFTEN_RATIO, often: int = OFTEN, key: str = "page_id") -> DataFrame:
    """A row for each row of pages: `key`, host, n_lines, n_dropped, text (the lines that stay)."""
    # kept in the shared folder, since cutting a page costs more than writing its lines
    sites = durable(pages.select(key, host_of(pages["url"]).alias("host"), lines_of(pages["html"]).alias("lines")))
    bad = boilerplate(sites.select("host", "lines"), ratio, min_pages, often_ratio, often)
    size = bad.agg(F.coalesce(F.sum(F.octet_length("host") + 8 * F.size("bad") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = sites.join(F.broadcast(bad), "host", "left")
    else:
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sites.withColumn("salt", F.pmod(F.hash(key, "lines"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")
    none = F.array().cast("array<bigint>")
    # the page's own boilerplate, found by hashing; few lines of a page are searched in a host's whole list
    own = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), F.coalesce("bad", none))
    full = joined.select(key, "host", "lines", F.when(F.size("bad") > 0, own).otherwise(none).alias("bad"))
    kept = full.select(key, "host", F.size("lines").cast("long").alias("n_lines"), F.filter("lines", lambda x: ~F.array_contains("bad", F.xxhash64(x))).alias("kept"))
    text = F.array_join("kept", "\n")
    return kept.select(key, "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), text.alias("text"))
