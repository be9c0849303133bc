"""Text of paged documents: page frames out, tables rebuilt over page breaks, sections in order.

Works on text that was extracted page by page (``doc, page, text``); frames are told by
recurrence over the pages of a document, not by lists of phrases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Lines that say nothing: leaders of a table of contents, bare numbers and dates, rules, marks of a table that goes on, bit positions and access rows of register drawings.
_NOISE = r"\.(?:\s*\.){4,}|^\d{1,3}$|^\d{4}-\d{2}-\d{2}$|^-{3,}$|(?i)^\**\(table continues\.*\s*\)\**$|(?i)^\**table\s+\d+\**\s+\**\(continued\)\**$|(?i)^(?:#+\s+)?\**contents\**$|^(?:\d{1,2}\s+){4,}\d{1,2}$|^(?:r|rw|rh|rwh|w)(?:\s+(?:r|rw|rh|rwh|w))*$"


def page_lines(pages: DataFrame, edge: int = 3, least: int = 3, share: float = 0.5) -> DataFrame:
    """``doc, page, line_no, line`` without page frames and noise.

    A line within ``edge`` lines of a page's top or bottom is a frame if it stands, whatever its numbers, so
    near the edge of at least ``least`` of the document's pages and ``share`` of them.  Empty pages and null texts have no lines.
    """
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != "")
    rows = pages.filter(C("text").isNotNull()).select("doc", "page", lines.alias("_l")).filter(F.size("_l") > 0)
    marked = F.transform("_l", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), ((i < edge) | (i >= F.size("_l") - edge)).alias("edge")))
    each = rows.select("doc", "page", F.explode(marked).alias("_m")).select("doc", "page", "_m.*").withColumn("_shape", F.regexp_replace(F.trim("line"), r"\d+", "#"))
    total = rows.groupBy("doc").agg(F.count_distinct("page").alias("_pages"))
    often = each.filter("edge").groupBy("doc", "_shape").agg(F.count_distinct("page").alias("_n")).join(total, "doc").filter((C("_n") >= least) & (C("_n") >= share * C("_pages"))).select("doc", "_shape", F.lit(True).alias("edge"))
    return each.join(often, ["doc", "_shape", "edge"], "left_anti").filter(~F.trim("line").rlike(_NOISE)).select("doc", "page", "line_no", "line")


def tables(lines: DataFrame) -> DataFrame:
    """``doc, table_no, page, row_no, cells`` of tables drawn with bars, joined over page breaks.

    A table that ends a page and one of as many columns that starts the next page are one; a header that is repeated there, and
    rows of rules, are left out.
    """
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("_bar", F.trim("line").rlike(r"^\|.*\|$")).withColumn("_cells", F.when(C("_bar"), cells)).withColumn("_width", F.size("_cells"))
    before = F.lag(F.struct("_bar", "_width")).over(order)
    rows = rows.withColumn("_opens", C("_bar") & (before.isNull() | ~F.coalesce(before["_bar"], F.lit(False)) | (before["_width"] != C("_width"))))
    rows = rows.withColumn("table_no", F.sum(C("_opens").cast("int")).over(order)).filter("_bar").filter(~F.forall("_cells", lambda x: x.rlike("^:?-*:?$")))
    own = Window.partitionBy("doc", "table_no").orderBy("page", "line_no")
    head = rows.withColumn("_head", F.first("_cells").over(own)).withColumn("_k", F.row_number().over(own))
    kept = head.filter((C("_k") == 1) | (C("_cells") != C("_head")))
    return kept.select("doc", "table_no", "page", (F.row_number().over(own) - 1).alias("row_no"), C("_cells").alias("cells"))


def numbered_sections(lines: DataFrame) -> DataFrame:
    """``doc, number, title, level, page, page_end, content, after``: sections by numbered headings, in order, each with the number of the one before it.

    A heading is a line with a dotted number and a title, marked or bold or not; a number must be new and
    follow the one before it in order, so that numbers inside the text open nothing.
    """
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    pattern = r"^(?:#{1,6}\s+)?\**(\d{1,3}(?:\.\d{1,3})*)\**\s+\**([A-Z][^|]{1,118}?)\**$"
    number = F.regexp_extract(F.trim("line"), pattern, 1)
    key = F.transform(F.split(number, r"\."), lambda x: x.cast("int"))
    rows = lines.withColumn("number", F.when(number != "", number)).withColumn("_key", F.when(number != "", key))
    highest = F.max("_key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = C("_key").isNotNull() & (highest.isNull() | (C("_key") > highest))
    rows = rows.withColumn("_o", F.coalesce(opens, F.lit(False))).withColumn("_section", F.sum(C("_o").cast("int")).over(order)).filter(C("_section") > 0)
    text = F.transform(F.array_sort(F.collect_list(F.when(~C("_o"), F.struct("page", "line_no", "line")))), lambda x: x["line"])
    grouped = rows.groupBy("doc", "_section").agg(F.first(F.when(C("_o"), C("number")), ignorenulls=True).alias("number"), F.first(F.when(C("_o"), F.regexp_extract(F.trim("line"), pattern, 2)), ignorenulls=True).alias("title"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.array_join(text, "\n").alias("content"))
    after = F.lag("number").over(Window.partitionBy("doc").orderBy("_section"))
    return grouped.select("doc", "number", "title", F.size(F.split("number", r"\.")).alias("level"), "page", "page_end", "content", after.alias("after"))
