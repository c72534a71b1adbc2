"""Line dedup by site-relative frequency: drop lines that stand on too many pages of a site.

For every site, the pages that contain a line are divided by all pages of the site; a line
over ``ratio`` that stands on at least ``least`` pages is boilerplate there. Lines are
compared without the spaces around them; blank lines are never boilerplate.

A page counts a line once before anything is shuffled, and only the line's MD5 travels, with
partial counts. A site can have at most (lines per page) / ratio boilerplate lines, so these
fit into one array per site. The arrays are written to the shared folder first: where their
table is below Spark's broadcast threshold the pages aren't shuffled at all, else they join
by shuffle and AQE splits the partitions of a hot site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callboard.llm import workspace
from callboard.llm.blocks import free_names
from callboard.operators import joins

#: A line on more than this share of a site's pages is boilerplate ...
RATIO = 0.1
#: ... if it is on so many pages at least.
LEAST = 5


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(_site, _drop): per site the digests of its boilerplate lines; sites without any are left out."""
    total = pages.groupBy(F.col(site).alias("_site")).agg(F.count(F.lit(1)).alias("_pages"))
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), F.trim))
    each = pages.where(F.col(site).isNotNull()).select(F.col(site).alias("_site"), F.explode(lines).alias("_line"))
    counted = each.where("_line <> ''").groupBy("_site", _digest(F.col("_line")).alias("_line")).agg(F.count(F.lit(1)).alias("_n"))
    frequent = joins.join_on(counted.where(F.col("_n") >= least), total, {"_site": "_site"}, "inner", ["_pages"], spread=True)
    return frequent.where(F.col("_n") > F.col("_pages") * ratio).groupBy("_site").agg(F.collect_list("_line").alias("_drop"))


def without_boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST,
    n_lines: str | None = None, n_dropped: str | None = None,
) -> DataFrame:
    """All rows and columns, the text without its site's boilerplate lines.

    ``n_lines`` and ``n_dropped`` name columns for the numbers of lines and dropped lines.
    Null text stays null, with 0 lines; a page of boilerplate only keeps an empty text; rows
    without a site are left alone; repeated rows count as pages of their own; an empty table
    stays empty.
    """
    found = boilerplate(pages, site, text, ratio, least)
    found = workspace.written(found, workspace.folder(pages.sparkSession, "lines"))
    drop, kept_lines = free_names([*pages.columns, *filter(None, (n_lines, n_dropped))], "drop_", "stay_")
    marked = joins.lookup(pages, found.withColumnRenamed("_drop", drop), {site: "_site"}, [drop], spread=True)
    lines = F.split(F.col(text), "\n")
    stay = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(drop, _digest(x)), F.lit(False)))
    some = F.col(drop).isNotNull() & F.col(text).isNotNull()
    marked = marked.withColumn(kept_lines, F.when(some, stay))
    counts = {}
    if n_lines:
        counts[n_lines] = F.coalesce(F.size(lines), F.lit(0)).cast("bigint")
    if n_dropped:
        counts[n_dropped] = F.when(some, F.size(lines) - F.size(kept_lines)).otherwise(0).cast("bigint")
    kept = [F.when(F.col(kept_lines).isNotNull(), F.array_join(kept_lines, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in pages.columns if c not in counts]
    return marked.select(*kept, *[F.when(F.col(text).isNull(), 0).otherwise(v).cast("bigint").alias(c) for c, v in counts.items()])


def reference_sql(columns: str, ratio: float = RATIO, least: int = LEAST) -> str:
    """The same over ``documents`` by ``source``, for DuckDB; ``columns`` picks from text, n_lines, n_dropped and the table's."""
    return f"""
WITH line AS (
  SELECT source, l, count(*) AS n
  FROM (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS l
        FROM documents WHERE source IS NOT NULL)
  WHERE l <> '' GROUP BY source, l),
page AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boiler AS (
  SELECT line.source, list(l) AS dropped FROM line JOIN page ON line.source = page.source
  WHERE n >= {least} AND n > pages * CAST({ratio} AS DOUBLE) GROUP BY line.source),
split AS (
  SELECT d.*, string_split(d.text, chr(10)) AS all_lines, b.dropped,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(b.dropped, trim(x)), false)) AS stay
  FROM documents d LEFT JOIN boiler b ON d.source = b.source),
cleaned AS (
  SELECT split.* EXCLUDE (text),
    CASE WHEN text IS NULL OR dropped IS NULL THEN text ELSE array_to_string(stay, chr(10)) END AS text,
    CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines,
    CAST(CASE WHEN text IS NULL OR dropped IS NULL THEN 0 ELSE len(all_lines) - len(stay) END AS BIGINT) AS n_dropped
  FROM split)
SELECT {columns} FROM cleaned"""
