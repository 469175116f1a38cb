"""Line dedup by site-relative frequency.

For every host, the pages that hold a line are divided by the host's pages. A
line above the boilerplate ratio, on enough pages, is dropped from all pages of
that host; elsewhere it stays. Lines are counted once a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_BYTES, fresh, stored

#: Share of a host's pages above which a line is boilerplate, and the least pages that hold it: on a host of
#: fewer than 50 pages a line of one page is above 2 % too, and without this bound every line of it would go.
RATIO, PAGES = 0.02, 3


def boilerplate(docs: DataFrame, ratio: float = RATIO, pages: int = PAGES, host: str = "source") -> DataFrame:
    """(host, line): keys of the lines to drop on each host. Blank lines are no lines."""
    texts = docs.where("text IS NOT NULL").select(F.col(host).alias("_host"), "text")
    total = stored(texts.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")), "pages")
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    counts = texts.select("_host", F.explode(keys).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= pages)
    same = counts["_host"].eqNullSafe(total["_host"])
    return counts.join(F.broadcast(total) if total.count() * 64 <= BROADCAST_BYTES else total, same).where(F.col("_n") > ratio * F.col("_pages")).select(counts["_host"], "_line")


def cleaned(docs: DataFrame, ratio: float = RATIO, pages: int = PAGES, host: str = "source") -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`, and `n_dropped`, the lines taken out.

    A null host is a host of its own. A null text stays null with 0 dropped; the empty
    text and blank lines stay as they are. Every row counts as one page, rows that repeat an id
    too, and each loses the lines. An empty table gives no row. A column named `n_dropped` in the input is replaced;
    other columns stay, whatever their names.
    """
    found = stored(boilerplate(docs, ratio, pages, host), "boilerplate")
    columns = [c for c in docs.columns if c.lower() != "n_dropped"]
    if found.count() * 24 > BROADCAST_BYTES:
        return _by_rows(docs, found, host, columns)
    site, bad, left = fresh(docs, "host_of_list", "boilerplate", "lines_left")
    lists = found.groupBy(F.col("_host").alias(site)).agg(F.collect_set("_line").alias(bad))
    joined = docs.select(*columns).join(F.broadcast(lists), F.col(host).eqNullSafe(F.col(site)), "left")
    some = F.col(bad).isNotNull() & F.col("text").isNotNull()
    lines = F.split("text", "\n")
    # a line that is blank has no key in any list
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bad), _key(x)))
    out = joined.withColumn(left, F.when(some, kept))
    text = F.when(some, F.array_join(left, "\n")).otherwise(F.col("text"))
    dropped = F.when(some, F.size(lines) - F.size(left)).otherwise(F.lit(0)).cast("long")
    return out.withColumn("n_dropped", dropped).withColumn("text", text).select(*columns, "n_dropped")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("one"), F.xxhash64(F.concat(F.lit("|"), line), F.lit(7)).alias("two"))


def _by_rows(docs: DataFrame, found: DataFrame, host: str, columns: list[str]) -> DataFrame:
    """The same where the keys are too many to send: each line is joined with them."""
    row, gone, left = fresh(docs, "row_number", "gone", "lines_left")
    rows = stored(docs.select("*", F.monotonically_increasing_id().alias(row)), "rows")  # numbers must not change between the two readings
    lines = rows.select(row, F.col(host).alias("_site"), F.posexplode(F.split("text", "\n")).alias("_at", "_x")).withColumn("_key", _key(F.col("_x")))
    marked = lines.join(found.withColumn("_hit", F.lit(1)), lines["_site"].eqNullSafe(found["_host"]) & (lines["_key"] == found["_line"]), "left")
    whole = marked.groupBy(row).agg(F.sort_array(F.collect_list(F.when(F.col("_hit").isNull(), F.struct("_at", "_x")))).alias(left), F.count("_hit").alias(gone))
    joined = rows.join(whole, row, "left")
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform(left, lambda x: x["_x"]), "\n"))
    return joined.withColumn("n_dropped", F.coalesce(gone, F.lit(0)).cast("long")).withColumn("text", text).select(*columns, "n_dropped")


SQL = f"""
WITH t AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
n AS (SELECT source, count(*) AS pages FROM t GROUP BY source),
c AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_filter(lines, lambda x: trim(x) <> ''))) AS line FROM t) GROUP BY ALL),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE c.n >= {PAGES} AND c.n > {RATIO} * n.pages GROUP BY c.source),
k AS (SELECT d.doc_id, d.text, t.lines, list_filter(t.lines, lambda x: NOT coalesce(list_contains(b.bad, x), false)) AS kept
      FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped FROM k
"""
