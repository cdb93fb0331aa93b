"""Review of learning paths: every kind of warning as rows, the ways out of a cycle, and approval of an exact version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import graph, paths

#: Reasons why an approval is refused, in the order in which they are looked for.
SCHEMA, VERSION, OPEN, ORDER = "schema_version", "plan_version", "unresolved_warnings", "cycle_order"


def _numbered(kind: str | Column, number: Column) -> Column:
    return F.format_string("%s-%02d", F.lit(kind) if isinstance(kind, str) else kind, number)


def _rows(found: DataFrame, by: str, number: Column, kind: str, books: Column) -> DataFrame:
    return found.select(by, _numbered(kind.split("_")[0], number).alias("warning_id"), F.lit(kind).alias("kind"), books.alias("book_ids"))


def _listed(order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, "book_id"))), lambda x: x["book_id"])


def warnings(books: DataFrame, proposals: DataFrame, chapters: DataFrame, *, by: str = "collection_id") -> DataFrame:
    """(by, warning_id, kind, book_ids) of each collection; every one of them blocks approval until it is overridden.

    ``books`` has book_id, title, edition, upload_order; ``proposals`` what ``paths.checked`` returns with
    proposal_no; ``chapters`` (by, book_id, title). Books that no accepted proposal names are reported where
    there are proposals at all. Collections hold tens of books.
    """
    said = proposals.select(by, "proposal_no", F.explode("warnings").alias("kind"), F.array("prerequisite", "dependent").alias("book_ids"))
    found = [said.select(by, _numbered(F.col("kind"), F.col("proposal_no")).alias("warning_id"), "kind", "book_ids")]

    edges = proposals.where("accepted").select(by, "prerequisite", "dependent")
    stuck = paths.ordered(books, edges, by=by).where("cyclic").groupBy(by).agg(_listed("position").alias("ids"))
    found.append(_rows(stuck, by, F.lit(1), "cycle", F.col("ids")))

    alone = paths.disconnected(books.join(proposals.select(by).distinct(), by, "left_semi"), edges)
    found.append(_rows(alone.groupBy(by).agg(_listed("upload_order").alias("ids")), by, F.lit(1), "disconnected_books", F.col("ids")))

    same = books.groupBy(by, F.lower("title").alias("t"), "edition").agg(F.min("upload_order").alias("first"), _listed("upload_order").alias("ids")).where(F.size("ids") > 1)
    found.append(_rows(same, by, F.row_number().over(Window.partitionBy(by).orderBy("first")), "duplicate_edition", F.col("ids")))

    heads = chapters.select(by, "book_id", F.lower(F.trim("title")).alias("t")).distinct().join(books.select(by, "book_id", "upload_order"), [by, "book_id"])
    x, y = heads.alias("x"), heads.alias("y")
    met = x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.upload_order") < F.col("y.upload_order")))
    pairs = met.select(F.col(f"x.{by}").alias(by), F.col("x.upload_order").alias("i"), F.col("y.upload_order").alias("j"), F.array("x.book_id", "y.book_id").alias("ids")).distinct()
    found.append(_rows(pairs, by, F.row_number().over(Window.partitionBy(by).orderBy("i", "j")), "overlap", F.col("ids")))
    return reduce(DataFrame.unionByName, found)


def cycle_alternatives(books: DataFrame, edges: DataFrame, *, by: str = "collection_id", order: str = "proposal_no") -> DataFrame:
    """(by, alternative_no, book_ids): the orders that dropping one edge of a cycle allows, of the collections that have one; the given order where none does.

    Every edge between books on a cycle or below one makes a variant of its collection without it; all variants are layered at once.
    """
    given = books.select(by, "book_id", "upload_order")
    stuck = cut(paths.ordered(books, edges, by=by).where("cyclic").select(by, "book_id"))
    numbered = edges.select(by, "dependent", "prerequisite", F.row_number().over(Window.partitionBy(by).orderBy(order, "dependent", "prerequisite")).alias("__no"))
    role = lambda c: stuck.withColumnRenamed("book_id", c)
    dropped = numbered.join(role("dependent"), [by, "dependent"], "left_semi").join(role("prerequisite"), [by, "prerequisite"], "left_semi").select(by, F.col("__no").alias("__drop"))
    rest = numbered.join(dropped, by).where("__no <> __drop")
    book = lambda c: F.struct(F.col(by).alias("by"), F.col("__drop").alias("drop"), F.col(c).alias("book"))
    deep = graph.layers(rest.select(book("dependent").alias("child"), book("prerequisite").alias("parent")), given.join(dropped, by).select(book("book_id").alias("node")))
    placed = deep.select(F.col("node.by").alias(by), F.col("node.drop").alias("__drop"), F.col("node.book").alias("book_id"), "level").join(given, [by, "book_id"])
    listed = lambda *o: F.transform(F.array_sort(F.collect_list(F.struct(*o, "book_id"))), lambda x: x["book_id"]).alias("book_ids")
    fine = placed.groupBy(by, "__drop").agg(F.bool_and(F.col("level").isNotNull()).alias("__fine"), listed("level", "upload_order")).where("__fine")
    ways = fine.groupBy(by, "book_ids").agg(F.min("__drop").alias("__first"))
    ways = ways.select(by, F.row_number().over(Window.partitionBy(by).orderBy("__first")).alias("alternative_no"), "book_ids")
    none = given.join(stuck.select(by).distinct(), by, "left_semi").join(ways.select(by), by, "left_anti").groupBy(by).agg(listed("upload_order"))
    return ways.unionByName(none.select(by, F.lit(1).alias("alternative_no"), "book_ids"))


def reviewed(requests: DataFrame, plans: DataFrame, found: DataFrame, alternatives: DataFrame, *, by: str = "collection_id") -> DataFrame:
    """``requests`` with ``approved`` and the first reason why not.

    A request names the schema and the version of the exact plan (by, schema_version, plan_version), overrides
    every warning by its id, and picks a listed order of books (``chosen``) where there is a cycle.
    """
    open_ = found.groupBy(by).agg(F.collect_set("warning_id").alias("__ids"), F.bool_or(F.col("kind") == "cycle").alias("__cycle"))
    ways = alternatives.groupBy(by).agg(F.collect_list("book_ids").alias("__ways"))
    plan = plans.select(by, F.col("schema_version").alias("__schema"), F.col("plan_version").alias("__version"))
    rows = requests.join(plan, by, "left").join(open_, by, "left").join(ways, by, "left")
    left = F.array_except(F.coalesce("__ids", F.array().cast("array<string>")), F.coalesce("overrides", F.array().cast("array<string>")))
    listed = F.coalesce(F.array_contains("__ways", F.col("chosen")), F.lit(False))
    reason = (
        F.when(~F.col("schema_version").eqNullSafe(F.col("__schema")), SCHEMA).when(~F.col("plan_version").eqNullSafe(F.col("__version")), VERSION)
        .when(F.size(left) > 0, OPEN).when(F.coalesce("__cycle", F.lit(False)) & ~listed, ORDER)
    )
    return rows.withColumns({"approved": reason.isNull(), "reason": reason}).drop("__schema", "__version", "__ids", "__cycle", "__ways")


def renumbered(path: DataFrame, decisions: DataFrame, *, by: str = "collection_id") -> DataFrame:
    """Books (book_id, position, week_count) in the approved order with their global weeks; other collections keep theirs."""
    chosen = decisions.where("approved AND chosen IS NOT NULL").select(by, F.posexplode("chosen").alias("__at", "book_id"))
    moved = path.join(chosen, [by, "book_id"], "left").withColumn("position", F.coalesce(F.col("__at") + 1, "position")).drop("__at")
    return paths.offsets(moved, by=by)


def kept_edges(edges: DataFrame, path: DataFrame, *, by: str = "collection_id") -> DataFrame:
    """Edges that the order of books fulfils: an approved way out of a cycle overrides the others."""
    at = lambda role: path.select(by, F.col("book_id").alias(role), F.col("position").alias(f"__{role}"))
    return edges.join(at("prerequisite"), [by, "prerequisite"]).join(at("dependent"), [by, "dependent"]).where("__prerequisite < __dependent").drop("__prerequisite", "__dependent")
