"""Line deduplication by site-relative frequency (DataFrame functions only).

A site's boilerplate is what stands on many of its pages: pages are grouped by
site, each line's share is pages holding it / pages of the site, and lines above
`ratio` (held by `min_pages` pages at least) are dropped from every page of it.

Counting explodes 64-bit line hashes, once per page and line, and combines them
before the shuffle, so a line on a third of all pages costs one row per task.
A site has at most (lines per page / ratio) boilerplate lines; they come back
as one array per site, broadcast only while their number is below
`broadcast_lines`, by a shuffle join beyond it.

Defined results: null text stays null and counts as a page without lines; null
site is a site of its own; lines without a non-space character are never
counted nor dropped; a line repeated in a page counts once; repeated rows are
separate pages; an empty table gives no rows; all other columns pass through.
Two different lines count as one only if their 64-bit hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, if_small, settle

#: Between what ordinary lines of a site reach (under 5 % of its pages on the given tables) and what its boilerplate does (8 % and more).
RATIO = 0.065
MIN_PAGES = 3
BROADCAST_LINES = 200_000


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, " \t\r\x0b\x0c", "")) > 0


def boilerplate(pages: DataFrame, *, site_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line): hashes of the lines that exceed the ratio on their site."""
    hashes = F.array_distinct(F.transform(F.filter(F.split(F.col(text_col), "\n"), _has_word), lambda x: F.xxhash64(x)))
    # A null in front of the page's lines counts the page itself.
    rows = pages.select(F.col(site_col).alias("site"), F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(hashes, F.array().cast("array<long>")))).alias("line"))
    counts = settle(rows.groupBy("site", "line").count().where(F.col("line").isNull() | (F.col("count") >= min_pages)), "lines")
    c, s = counts.where("line is not null").alias("c"), counts.where("line is null").alias("s")
    share = F.col("c.count") / F.col("s.count")
    return c.join(s, F.col("c.site").eqNullSafe(F.col("s.site"))).where(share > ratio).select("c.site", "c.line")


def drop_boilerplate(pages: DataFrame, *, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, counts: bool = False) -> DataFrame:
    """The pages with boilerplate lines cut from `text_col`; with `counts` also n_lines and n_dropped (with _ behind where the pages have such columns)."""
    found = settle(boilerplate(pages, site_col=site_col, text_col=text_col, ratio=ratio, min_pages=min_pages), "boiler")
    per_site = found.groupBy("site").agg(F.collect_set("line").alias("drop"))
    site, drop, lines, kept = (free_name(pages, f"_line_{x}") for x in ("site", "drop", "all", "kept"))
    per_site = per_site.select(F.col("site").alias(site), F.col("drop").alias(drop))
    out = pages.join(if_small(per_site, broadcast_lines), pages[site_col].eqNullSafe(per_site[site]), "left")
    out = out.withColumn(lines, F.split(F.col(text_col), "\n"))
    # The page's own boilerplate lines, by one hash set: few, whatever the site has.
    own = free_name(pages, "_line_own")
    out = out.withColumn(own, F.array_intersect(F.transform(F.col(lines), lambda x: F.xxhash64(x)), F.col(drop)))
    keep = F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, F.col(lines)).otherwise(F.filter(F.col(lines), lambda x: ~(F.array_contains(F.col(own), F.xxhash64(x)) & _has_word(x))))
    out = out.withColumn(kept, keep)
    columns = [F.array_join(F.col(kept), "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    if counts:
        n = F.coalesce(F.size(F.col(lines)), F.lit(0))
        columns += [n.cast("long").alias(free_name(pages, "n_lines")), (n - F.coalesce(F.size(F.col(kept)), F.lit(0))).cast("long").alias(free_name(pages, "n_dropped"))]
    return out.select(*columns)


def line_digest(docs: DataFrame) -> DataFrame:
    out = drop_boilerplate(docs.select("doc_id", "source", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a leading www.; empty if there is none, null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def visible_lines(html: Column) -> Column:
    """Text between tags, a line each; scripts and styles go."""
    return F.regexp_replace(html, MARKUP, "\n")


HOST = r"^[A-Za-z]+://(?:[^/@]*@)?(?:[wW]{3}\.)?([^/:?#]+)"
MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>"


def host_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Web pages by host: lines of visible text on too large a share of the host's pages go."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("text"))
    out = drop_boilerplate(rows, site_col="host", counts=True)
    return out.select("page_id", "host", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def host_line_sql() -> str:
    rows = f"(SELECT page_id AS doc_id, lower(regexp_extract(url, '{HOST}', 1)) AS source, regexp_replace(html, '{MARKUP}', chr(10), 'g') AS text FROM pages)"
    return f"WITH o AS ({line_sql(rows, keep='source,')}) SELECT doc_id AS page_id, source AS host, n_lines, n_dropped, kept_md5 FROM o"


def line_sql(documents: str = "documents", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: str = "") -> str:
    word = "length(translate(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12), '')) > 0"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS ls FROM {documents}),
site AS (SELECT source, count(*) AS n FROM d GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_filter(ls, lambda x: {word}))) AS line FROM d),
c AS (SELECT source, line, count(*) AS k FROM l GROUP BY source, line),
b AS (SELECT c.source, list(c.line) AS drops FROM c JOIN site ON c.source IS NOT DISTINCT FROM site.source
      WHERE k >= {min_pages} AND k / n > {ratio} GROUP BY c.source),
k AS (SELECT d.doc_id, d.source, d.ls, CASE WHEN b.drops IS NULL THEN d.ls ELSE list_filter(d.ls, lambda x: NOT (list_contains(b.drops, x) AND {word})) END AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, {keep} CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
  CASE WHEN kept IS NULL THEN NULL ELSE md5(coalesce(array_to_string(kept, chr(10)), '')) END AS kept_md5 FROM k"""
