"""Token budgets and the budgeted repository map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RESERVE = 40


def prefix_admit(rows: DataFrame, group: list[str], order: list[Column], cost: Column, budget: Column | int, reserve: int = RESERVE) -> DataFrame:
    """Rows from the start of each group's order while their costs fit the budget less the reserve; the first that doesn't fit ends it."""
    w = Window.partitionBy(*group).orderBy(*order)
    room = (budget if isinstance(budget, Column) else F.lit(budget)) - reserve
    return rows.withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("spent") <= room)


def admit_with_citations(rows: DataFrame, group: list[str], order: Column, citation: Column, body: Column, budget: int, reserve: int = RESERVE) -> DataFrame:
    """group, shown: array<struct<citation, body>>: each citation that fits, with its body where that fits too. What is admitted depends on
    what was before, so each group's rows (a page of hits) are folded in order."""
    item = F.struct(order.alias("o"), citation.alias("c"), body.alias("b"), T.token_estimate(citation).alias("cc"), T.token_estimate(body).alias("cb"))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.lit(False).alias("full"), F.array().cast("array<struct<citation:string,body:string>>").alias("shown"))
    room = budget - reserve

    def step(acc: Column, x: Column) -> Column:
        whole, cited = acc["spent"] + x["cc"] + x["cb"] <= room, acc["spent"] + x["cc"] <= room
        return F.when(acc["full"] | ~cited, F.struct(acc["spent"].alias("spent"), F.lit(True).alias("full"), acc["shown"].alias("shown"))).otherwise(
            F.struct((acc["spent"] + x["cc"] + F.when(whole, x["cb"]).otherwise(F.lit(0))).alias("spent"), F.lit(False).alias("full"), F.array_append(acc["shown"], F.struct(x["c"].alias("citation"), F.when(whole, x["b"]).alias("body"))).alias("shown"))
        )

    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items")).select(*group, F.aggregate("items", start, step)["shown"].alias("shown"))


def headline_declarations(decls: DataFrame, most: int = 6) -> DataFrame:
    """The `most` weightiest declarations of each path: types, then functions, then others, in source order."""
    weight = F.when(F.col("kind").isin("type", "interface", "enumeration"), 0).when(F.col("kind") == "function", 1).otherwise(2)
    return decls.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(weight, "line", "name"))).where(F.col("n") <= most).drop("n")


def footer(shown: Column, total: Column) -> Column:
    return F.when(shown < total, F.format_string("— shown %d of %d (truncated).", shown, total)).otherwise("")


def repo_map(ranks: DataFrame, decls: DataFrame, budget: int = 3000, most: int = 6) -> DataFrame:
    """position, directory, path, line of text: files by rank under their directories (in the order of first appearance), each with its
    headline declarations, while the text fits the budget. ranks: path, rank; decls: path, kind, name, line."""
    shown = headline_declarations(decls, most).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]), ", ").alias("names"))
    rows = ranks.join(shown, "path", "left").withColumn("directory", T.folder(F.col("path")))
    first = Window.partitionBy("directory")
    rows = rows.withColumn("dir_rank", F.max(F.round("rank", 9)).over(first))
    line = F.concat(F.lit("  "), F.element_at(F.split("path", "/"), -1), F.when(F.col("names").isNotNull(), F.concat(F.lit(": "), F.col("names"))).otherwise(""))
    rows = rows.withColumn("text", line).withColumn("all", F.lit(0))
    # one repository's map: a page of text, cut by the budget; files that cannot fit any more are dropped before the one ordered window
    kept = rows.orderBy(F.col("dir_rank").desc(), "directory", F.round("rank", 9).desc(), "path").limit(budget)
    order = [F.col("dir_rank").desc(), F.col("directory"), F.round("rank", 9).desc(), F.col("path")]
    admitted = prefix_admit(kept, ["all"], order, T.token_estimate(F.col("text")), budget)
    return admitted.select(F.row_number().over(Window.orderBy(*order)).alias("position"), "directory", "path", "text")


def repo_map_page(ranks: DataFrame, decls: DataFrame, budget: int, header: str, most: int = 6) -> DataFrame:
    """position, text: the header, then a line `directory/` where a directory begins and a line a file, while they fit, and the footer.

    Directories come in the order of their best file, files by rank within; the first line that doesn't fit ends the page.
    """
    names = lambda x: F.concat(x["name"], F.lit(":"), x["line"])
    shown = headline_declarations(decls, most).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), names), " ").alias("names"))
    rows = ranks.join(shown, "path", "left").withColumn("directory", F.coalesce(F.nullif(T.folder(F.col("path")), F.lit("")), F.lit(".")))
    best = rows.groupBy("directory").agg(F.max(F.round("rank", 9)).alias("top"), F.min_by("path", F.struct(-F.round("rank", 9), "path")).alias("lead"))
    block = F.concat(F.lit("  "), F.element_at(F.split("path", "/"), -1), F.when(F.col("names").isNotNull(), F.concat(F.lit("  "), F.col("names"))).otherwise(""))
    files = rows.join(best, "directory").select("top", "lead", "directory", F.lit(1).alias("is_file"), (-F.round("rank", 9)).alias("r"), "path", block.alias("text"))
    heads = best.select("top", "lead", "directory", F.lit(0).alias("is_file"), F.lit(0.0).alias("r"), F.lit("").alias("path"), F.concat("directory", F.lit("/")).alias("text"))
    order = [F.col("top").desc(), F.col("lead"), F.col("directory"), F.col("is_file"), F.col("r"), F.col("path")]
    lines = files.unionByName(heads).orderBy(*order).limit(budget).withColumn("g", F.lit(0))  # a line costs a token at least
    kept = prefix_admit(lines, ["g"], order, T.token_estimate(F.col("text")), budget - max(1, -(-len(header.encode()) // 3)))
    kept = kept.select(F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("position"), "text", "is_file")
    total = ranks.agg(F.count(F.lit(1)).alias("total"))
    foot = kept.agg(F.coalesce(F.sum("is_file"), F.lit(0)).alias("shown"), F.count(F.lit(1)).alias("n")).crossJoin(total).where("shown < total").select((F.col("n") + 1).cast("int").alias("position"), footer(F.col("shown"), F.col("total")).alias("text"))  # one row each
    head = ranks.sparkSession.createDataFrame([(0, header)], "position int, text string")
    return head.unionByName(kept.select("position", "text")).unionByName(foot)
