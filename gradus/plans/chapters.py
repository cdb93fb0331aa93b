"""Chapters of books: discovery in pages, boundaries, sizes, and the weeks of a course."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

EXPLICIT, LISTED, WHOLE = 0.95, 0.80, 0.35
#: Patterns of chapter headings, contents pages and their entries, and what is stripped from titles.
CHAPTER = r"(?i)^chapter\s+(\d+|[ivxlcdm]+)\s*[:.\-–—]?\s*([^.]{0,100})$"
NUMBERED = r"^(\d{1,3})[.:\-]\s+([A-Z][^.!?]{2,90})$"
CONTENTS = r"(?i)^(?:\S+\s+){0,3}(?:table\s+of\s+)?contents\s*:?$"
ITEM = r"^(?:\d{1,3}[.)]|[•·▪◦*\-–—])\s+(.+?)\s*[.]?$"
CHAPTER_EDGE = " :-–—"
TITLE_EDGE = " .:-–—"
HEADING_STOP = ("a", "an", "and", "for", "is", "of", "the", "to", "when")
#: Lines of a page that may hold headings, contents entries, and the heading that an entry names.
HEADING_LINES, CONTENTS_LINES, OPENING_LINES = 8, 30, 3
#: Dice from which a line is the entry's heading, and the sequence ratio that forgives misspelling.
LIKELY, SPELT = 0.65, 0.80
#: White space of any kind, as Unicode has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _stripped(title: Column, edge: str) -> Column:
    return F.btrim(title, F.lit(edge))


def _heading_words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.upper(line)), F.lit("[a-z0-9]+"), F.lit(0))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def _alike(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (title, line and more) whose subject words agree, or that are nearly spelt alike.

    ``x`` and ``y`` are the words of both; what neither way can find goes before anything is kept or compared.
    """
    stops = F.array(*map(F.lit, HEADING_STOP))
    rows = pairs.where("size(x) > 0 AND size(y) > 0")
    rows = rows.withColumns({"p": F.array_except("x", stops), "q": F.array_except("y", stops)})
    subject = (F.size("p") > 0) & (F.size("q") > 0)
    sure = subject & (2 * F.size(F.array_intersect("p", "q")) >= LIKELY * (F.size("p") + F.size("q")))
    rows = rows.withColumns({"sure": sure, "x": F.array_join("x", " "), "y": F.array_join("y", " "), "least": F.when(subject, SPELT).otherwise(LIKELY)}).drop("p", "q")
    # the ratio is at most that of equal letters as many as the shorter has
    rows = cut(rows.where(F.col("sure") | (2 * F.least(F.length("x"), F.length("y")) >= F.col("least") * (F.length("x") + F.length("y")))))
    spelt = rows.where("NOT sure").withColumn("ratio", _ratio("x", "y")).where("ratio >= least").drop("ratio")
    return rows.where("sure").unionByName(spelt).drop("sure", "least", "x", "y")


def _explicit(lines: DataFrame) -> DataFrame:
    """(book, start_page, title) of headings "Chapter N": on each page the first whose number and title no earlier page took."""
    number = F.upper(F.regexp_extract("line", CHAPTER, 1))
    title = _stripped(F.regexp_extract("line", CHAPTER, 2), CHAPTER_EDGE)
    hits = lines.where((F.col("at") < HEADING_LINES) & F.col("line").rlike(CHAPTER)).select(
        "book", "page", "at", F.concat(number, F.lit(":"), F.lower(title)).alias("label"), F.when(title == "", F.concat(F.lit("Chapter "), number)).otherwise(title).alias("title")
    )
    by_page = hits.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("at", "label", "title"))).alias("hits"))
    books = by_page.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page", "hits"))).alias("pages"))

    def take(state: Column, page: Column) -> Column:
        new = F.get(F.filter(page["hits"], lambda h: ~F.exists(state, lambda s: s["label"] == h["label"])), F.lit(0))
        return F.when(new.isNull(), state).otherwise(F.concat(state, F.array(F.struct(page["page"].alias("start_page"), new["label"].alias("label"), new["title"].alias("title")))))

    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("start_page", lines.schema["page"].dataType), T.StructField("label", T.StringType()), T.StructField("title", T.StringType())])))
    return books.select("book", F.inline(F.aggregate("pages", none, take))).drop("label")


def _numbered(lines: DataFrame) -> DataFrame:
    """(book, start_page, title) of pages with one numbered heading each, in books whose numbers are 1, 2, 3, ... without a gap."""
    hits = lines.where((F.col("at") < HEADING_LINES) & F.col("line").rlike(NUMBERED)).groupBy("book", F.col("page").alias("start_page")).agg(
        F.count("*").alias("n"), F.min(F.regexp_extract("line", NUMBERED, 1).cast("int")).alias("number"), F.min(_stripped(F.regexp_extract("line", NUMBERED, 2), TITLE_EDGE)).alias("title")
    )
    own = Window.partitionBy("book")
    placed = hits.where("n = 1").withColumn("place", F.row_number().over(own.orderBy("start_page")))
    whole = placed.withColumns({"gapless": F.bool_and(F.col("number") == F.col("place")).over(own), "k": F.count("*").over(own)})
    return whole.where("gapless AND k >= 2").select("book", "start_page", "title")


def _listed(lines: DataFrame, openings: DataFrame) -> DataFrame:
    """(book, start_page, title) of contents entries, each on the first likely page after that of the entry before; two at least."""
    heads = lines.where(F.col("line").rlike(CONTENTS)).groupBy("book", F.col("page").alias("listing")).agg(F.min("at").alias("head"))
    under = lines.withColumnRenamed("page", "listing").join(heads, ["book", "listing"]).where("at > head").where(F.col("line").rlike(ITEM))
    entries = under.select("book", "listing", "at", _stripped(F.regexp_extract("line", ITEM, 1), TITLE_EDGE).alias("title"))
    entries = entries.withColumn("k", F.count("*").over(Window.partitionBy("book", "listing"))).where("k >= 2").drop("k")
    entries = cut(entries.withColumn("x", _heading_words(F.col("title"))))
    # a line of more words and of more letters than the longest title allows is like none: it goes before the join
    subject = lambda c: F.array_except(c, F.array(*map(F.lit, HEADING_STOP)))
    words, letters = entries.agg(F.max(F.size(subject(F.col("x")))), F.max(F.length(F.array_join("x", " ")))).first()
    allowed = lambda most: (most or 0) * (2 - LIKELY) / LIKELY + 1e-6
    openings = openings.select("book", "page", _heading_words(F.col("line")).alias("y"))
    openings = openings.where((F.size(subject(F.col("y"))) <= allowed(words)) | (F.length(F.array_join("y", " ")) <= allowed(letters)))
    pairs = entries.join(openings, "book").where("page > listing")
    met = _alike(pairs).groupBy("book", "listing", "at", "title").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    lists = met.groupBy("book", "listing").agg(F.array_sort(F.collect_list(F.struct("at", "title", "pages"))).alias("entries"))
    kind = lines.schema["page"].dataType
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("start_page", kind), T.StructField("title", T.StringType())])))

    def place(state: Column, entry: Column) -> Column:
        page = F.get(F.filter(entry["pages"], lambda n: n > F.coalesce(F.get(state, F.size(state) - 1)["start_page"], F.col("listing"))), F.lit(0))
        return F.when(page.isNull(), state).otherwise(F.concat(state, F.array(F.struct(page.alias("start_page"), entry["title"].alias("title")))))

    found = lists.select("book", "listing", F.aggregate("entries", none, place).alias("found")).where("size(found) >= 2")
    return found.groupBy("book").agg(F.min_by("found", "listing").alias("found")).select("book", F.inline("found"))


def discovered(pages: DataFrame, *, book: str = "book_id", number: str = "page_no", body: str = "text", title: str = "Uploaded book") -> DataFrame:
    """(book, chapter_no, title, start_page, end_page, confidence): by explicit headings, else contents, else numbers, else the whole book.

    The first lines of all pages become rows; only what looks like a heading, a contents page or an entry is kept and made distinct, and each way is a plan over that; headings and entries that
    matched are folded, in arrays of a book. Pages of null text hold no line; repeated pages count once.
    """
    given = pages.select(F.col(book).alias("book"), F.col(number).alias("page"), F.col(body).alias("text"))
    parts = F.slice(F.split(F.coalesce("text", F.lit("")), _BREAK), 1, CONTENTS_LINES)
    lines = given.select("book", "page", F.posexplode(parts).alias("at", "line")).withColumn("line", F.btrim("line", F.lit(WHITE))).where("line <> ''")
    # what may be a heading, a contents page or its entry is found in one pass; openings are read again, for books with entries alone
    line, heads = F.col("line"), F.col("at") < HEADING_LINES
    said = cut(lines.where((heads & (line.rlike(CHAPTER) | line.rlike(NUMBERED))) | (F.contains(F.lower(line), F.lit("contents")) & line.rlike(CONTENTS)) | line.rlike(ITEM)).distinct())
    listed = lambda x: _listed(x, lines.where(F.col("at") < OPENING_LINES))
    ways = ((_explicit, EXPLICIT), (listed, LISTED), (_numbered, LISTED))
    starts = reduce(DataFrame.unionByName, (way(said).withColumns({"way": F.lit(i), "confidence": F.lit(c)}) for i, (way, c) in enumerate(ways)))
    starts = starts.withColumn("best", F.min("way").over(Window.partitionBy("book"))).where("way = best").select("book", "start_page", "title", "confidence")
    spans = given.groupBy("book").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    chapters = bounded(starts, spans, book="book")
    columns = ["book", "chapter_no", "title", "start_page", "end_page", "confidence"]
    whole = spans.join(starts.select("book").distinct(), "book", "left_anti").select(
        "book", F.lit(1).alias("chapter_no"), F.lit(title).alias("title"), F.col("first_page").alias("start_page"), F.col("last_page").alias("end_page"), F.lit(WHOLE).alias("confidence")
    )
    return chapters.select(*columns).unionByName(whole).withColumnRenamed("book", book)


def bounded(starts: DataFrame, spans: DataFrame, *, book: str = "book_id", start: str = "start_page") -> DataFrame:
    """Chapters from their first pages: repeats go, the first chapter opens the book, each ends before the next, the last closes the book."""
    order = Window.partitionBy(book).orderBy(start)
    rows = starts.dropDuplicates([book, start]).join(spans, book)
    rows = rows.withColumns({"chapter_no": F.row_number().over(order), "end_page": F.coalesce(F.lead(start).over(order) - 1, F.col("last_page"))})
    return rows.withColumn(start, F.when(F.col("chapter_no") == 1, F.col("first_page")).otherwise(F.col(start))).drop("first_page", "last_page")


def size_class(pages: Column, median: Column, count: Column) -> Column:
    return (
        F.when(pages <= F.greatest(F.lit(3.0), median * 0.35), "tiny").when(pages <= F.greatest(F.lit(6.0), median * 0.65), "small")
        .when((pages >= 80) & ((count == 1) | (pages >= median * 1.65)), "large").otherwise("standard")
    )


def sized(chapters: DataFrame, *, book: str = "book_id", pages: str = "page_count") -> DataFrame:
    own = chapters.groupBy(book).agg(F.median(pages).alias("__median"), F.count("*").alias("__count"))
    return chapters.join(own, book).withColumn("size", size_class(F.col(pages), F.col("__median"), F.col("__count"))).drop("__median", "__count")


def pages_of(weeks: DataFrame, pages: DataFrame, *, book: str = "book_id") -> DataFrame:
    """Pages inside the closed range of each week: an equi-join on the book whose range condition prunes."""
    return weeks.join(pages, (weeks[book] == pages[book]) & pages["page_no"].between(weeks["start_page"], weeks["end_page"])).drop(pages[book])


def bucket(i: Column, n: Column, k: Column) -> Column:
    """The bucket (from 0) of item i (from 0) where n items are dealt in order over k buckets, bucket b holding b n / k to (b + 1) n / k."""
    return F.floor(((i + 1) * k - 1) / n).cast("int")


def term_weeks(chapters: Column) -> Column:
    """Weeks of a term of so many chapters: one each up to 8, 8 up to 12, else 12."""
    return F.when(chapters <= 8, chapters).when(chapters <= 12, F.lit(8)).otherwise(F.lit(12)).cast("int")


def scheduled(books: DataFrame, *, book: str = "book_id", chapters: str = "n_chapters") -> DataFrame:
    """(book, chapter, semester, week, semester_week): chapters dealt to terms of 20 at most, then to the weeks of each."""
    n = F.col(chapters).cast("int")
    rows = books.where(n >= 1).select(book, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    terms = F.ceil(F.col("n") / 20).cast("int")
    rows = rows.withColumn("k", terms).withColumn("s", bucket(F.col("i"), F.col("n"), F.col("k")))
    at = lambda s: F.floor(s * F.col("n") / F.col("k")).cast("int")
    rows = rows.withColumns({"first": at(F.col("s")), "own": at(F.col("s") + 1) - at(F.col("s"))}).withColumn("weeks", term_weeks(F.col("own")))
    rows = rows.withColumn("w", bucket(F.col("i") - F.col("first"), F.col("own"), F.col("weeks")))
    # terms differ by one chapter at most; weeks of earlier terms are summed from their sizes
    earlier = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("s") - 1, F.lit(0))), lambda t: F.when(t < F.col("s"), term_weeks(at(t + 1) - at(t))).otherwise(0)),
        F.lit(0), lambda a, b: a + b,
    )
    return rows.select(book, (F.col("i") + 1).alias("chapter"), (F.col("s") + 1).alias("semester"), (earlier + F.col("w") + 1).alias("week"), (F.col("w") + 1).alias("semester_week"))


def midterm(weeks: Column) -> Column:
    return F.floor((weeks + 1) / 2).cast("int")


def plan_problems(scheduled_chapters: DataFrame, inventory: DataFrame, *, book: str = "book_id") -> DataFrame:
    """(book, chapter, problem): chapters that the plan lacks, has beyond the inventory, or has twice."""
    keys = [book, "chapter"]
    lacking = inventory.select(*keys).join(scheduled_chapters, keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = scheduled_chapters.select(*keys).distinct().join(inventory, keys, "left_anti").withColumn("problem", F.lit("unknown"))
    twice = scheduled_chapters.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("repeated").alias("problem"))
    return lacking.unionByName(extra).unionByName(twice)
