"""Line dedup by site-relative frequency; DataFrame functions only.

A line's frequency at a site is the number of the site's pages that contain it, divided by all pages
of the site. Lines above a ratio are boilerplate and go from all pages of that site.

Lines are counted as 128 hash bits per (site, line), combined before the shuffle, so a line on a third of
all pages is one row per task. Only lines that pass the ratio are kept: a site has at most
(mean lines of a page / ratio) of them, one row per site in a written table. Up to ``MOST_KEYS`` lines in all they are broadcast, and
the pages are not moved; beyond, both sides are and the engine splits a hot site's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.sources.folders import stored

RATIO = 0.1
MOST_KEYS = 1_000_000  # boilerplate lines of all sites that may be broadcast: 16 bytes each
MIN_PAGES = 5  # a line must also stand on this many pages: a site of two pages has no boilerplate


def _key(line: Column) -> Column:
    # The constant comes first: after the line it would only hash a once more.
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site -> array of the keys of its boilerplate lines; reads columns ``site`` and ``lines`` (array)."""
    per_page = F.array_distinct(F.transform(F.filter("lines", lambda x: F.length(F.trim(x)) > 0), _key))
    counts = (pages.select("site", F.explode(per_page).alias("key")).groupBy("site", "key")
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    return (counts.join(totals, "site").filter(F.col("n") > F.col("total") * F.lit(ratio))
            .groupBy("site").agg(F.collect_list("key").alias("boilerplate")))


def split_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Add ``kept`` (array of the remaining lines, in order) and ``n_dropped`` to pages with ``site`` and ``lines``.

    Lines without a visible character are neither counted nor dropped. ``site`` must not be null; see
    the callers for what stands in for a null. Null ``lines`` give null ``kept`` and 0 dropped.
    """
    # Where all boilerplate is small, checked on the written table, it goes to the pages and they stay where they are.
    found = stored(boilerplate(pages.select("site", "lines"), ratio, min_pages), "boilerplate")
    keys = found.agg(F.coalesce(F.sum(F.size("boilerplate")), F.lit(0))).first()[0]
    found = F.broadcast(found) if keys <= MOST_KEYS else found
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    joined = pages.join(found, "site", "left").withColumn("boilerplate", F.coalesce("boilerplate", none))
    # First hashes are intersected by hashing, so a page costs its lines plus the site's boilerplate, not their product;
    # what is left is compared on both hashes.
    firsts = F.array_intersect(F.transform("lines", lambda x: _key(x)["a"]), F.transform("boilerplate", lambda k: k["a"]))
    joined = joined.withColumn("hits", firsts).withColumn("boilerplate", F.filter("boilerplate", lambda k: F.array_contains("hits", k["a"])))
    kept = F.when(F.size("boilerplate") == 0, F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.length(F.trim(x)) == 0) | ~F.array_contains("boilerplate", _key(x))))
    return (joined.withColumn("kept", kept)
            .withColumn("n_dropped", F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("bigint")).drop("boilerplate", "hits"))


def dedup_documents(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                    min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of ``docs`` with all their columns, boilerplate lines taken out of ``text_col``.

    Lines are parts between newlines. A null site is a site of its own; a null text stays null and counts
    as a page without lines; a text whose lines all go is the empty text; repeated rows are pages each;
    an empty table stays empty. Columns may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # The leading mark keeps a null site apart from every real name.
    site = F.coalesce(F.concat(F.lit("="), F.col(f"`{site_col}`").cast("string")), F.lit("null"))
    pages = docs.select(site.alias("site"), F.split(F.col(f"`{text_col}`"), "\n", -1).alias("lines"), row.alias("row"))
    done = split_pages(pages, ratio, min_pages)
    text = F.when(F.col("n_dropped") == 0, F.col(f"row.`{text_col}`")).otherwise(F.array_join("kept", "\n"))
    return done.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


# Tags after which a page's text goes on in a new line.
BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|" \
             "li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
UNSEEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAKS = rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/:?#]*)"


def html_lines(html: Column) -> Column:
    """Visible lines of a raw page: scripts, styles and comments go, block tags break lines, other tags go."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BREAKS, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def dedup_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, host, n_lines, n_dropped, text (the remaining lines, newline-joined).

    The host is the lower-cased authority of the URL without user and port; a null or odd URL has the
    empty host, a site like any other. A null page has no lines and an empty text.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), HOST, 2))
    read = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("site"),
                        F.coalesce(html_lines(F.col(f"`{html_col}`")), F.array().cast("array<string>")).alias("lines"))
    return split_pages(read, ratio, min_pages).select(
        "page_id", F.col("site").alias("host"), F.size("lines").cast("bigint").alias("n_lines"), "n_dropped",
        F.array_join("kept", "\n").alias("text"))


def pages_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same for DuckDB over the table ``pages`` with page_id, url, html."""
    unseen, breaks = UNSEEN.removeprefix("(?is)"), BREAKS.removeprefix("(?i)")
    return rf"""
    WITH read AS (
        SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 2)) AS host,
               coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
                   html, '{unseen}', '', 'gis'), '{breaks}', chr(10), 'gi'), '<[^>]*>', '', 'g'), chr(10)),
                   lambda x: trim(x)), lambda x: x <> ''), []) AS lines
        FROM pages),
    counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM read) GROUP BY ALL),
    totals AS (SELECT host, count(*) AS total FROM read GROUP BY host),
    bad AS (SELECT host, list(line) AS bad FROM counts JOIN totals USING (host)
            WHERE n >= {min_pages} AND n > total * {ratio}::DOUBLE GROUP BY host),
    done AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
             FROM read LEFT JOIN bad USING (host))
    SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
           coalesce(array_to_string(kept, chr(10)), '') AS text
    FROM done"""
