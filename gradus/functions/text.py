"""Column expressions on text: tokens, headings, HTML, citations. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no subject.
STOPWORDS = (
    "the and for with that this from into their there here what when where which "
    "who whom whose how why are was were been being have has had does did done "
    "not but you your they them then than also such some any all can could should "
    "would may might must shall will about above after again against because "
    "before below between both during each few further more most other over same "
    "under until while these those very own too its introduction chapter "
    "section overview summary example examples use used using topic topics"
).split()

TOKEN = r"[a-z0-9]+"
TERM = r"[a-z][a-z0-9+#-]{2,}"
WHITE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, WHITE, "")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def content_terms(text: Column) -> Column:
    """Distinct subject words: three characters or more, no stopword."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def term_coverage(query: Column, passage: Column) -> Column:
    """Share of the query's terms (array columns) that the passage has; 0 for a query without terms."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, passage)) / F.size(query))


def token_score(overlap: Column, query_size: Column, passage_size: Column) -> Column:
    return overlap / F.sqrt(query_size * F.greatest(passage_size, F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def clean_heading(text: Column) -> Column:
    """A heading without emphasis marks and stray hashes; underscores stay."""
    return strip(F.regexp_replace(strip(F.regexp_replace(text, r"\*+|`+|~~", "")), r"^#+|#+$", ""))


UNDERLINE = r"^[=-]{3,}\s*$"
ATX = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"


def headings(text: Column) -> Column:
    """Cleaned ATX and underlined (setext) headings, in order."""
    lines = F.split(text, "\n")
    at = F.sequence(F.lit(0), F.size(lines) - 1)

    def heading(i: Column) -> Column:
        line, following = F.get(lines, i), F.get(lines, i + 1)
        atx = F.regexp_extract(line, ATX, 1)
        under = F.coalesce(following.rlike(UNDERLINE), F.lit(False)) & line.rlike(r"\S")
        return clean_heading(F.when(atx != "", atx).when(under, line).otherwise(""))

    return F.filter(F.transform(at, heading), lambda x: x != "")


def leading_heading(text: Column) -> Column:
    """The heading with which a text opens, front matter aside; null without."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", ""), r"^\s+", "")
    line, following = F.substring_index(body, "\n", 1), F.get(F.split(body, "\n"), F.lit(1))
    atx = F.regexp_extract(line, ATX, 1)
    found = clean_heading(F.when(atx != "", atx).when(F.coalesce(following.rlike(UNDERLINE), F.lit(False)), line).otherwise(""))
    return F.when(found != "", found)


def title_from_name(name: Column) -> Column:
    """A title made of a file name: no extension, underscores and dashes as spaces."""
    return F.trim(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "))


#: The named entities that are decoded, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    for name, plain in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def html_text(html: Column) -> Column:
    """The visible text of a page: no script, style or comment, tags as spaces, entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return strip(F.regexp_replace(decode_entities(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def html_title(html: Column) -> Column:
    return strip(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def clean_page(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def word_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^0-9A-Za-z_]+", ""))


def locator(page: Column, estimated: Column, section: Column, index: Column) -> Column:
    """``p. 3 (est.) § Title``; the chunk where neither is known."""
    known = F.concat_ws(
        " ",
        F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string"), F.when(estimated, F.lit(" (est.)")).otherwise(F.lit("")))),
        F.when(F.trim(section) != "", F.concat(F.lit("§ "), section)),
    )
    return F.when(known != "", known).when(index.isNotNull(), F.concat(F.lit("chunk "), index.cast("string"))).otherwise("location unknown")


def label(title: Column, place: Column) -> Column:
    return F.concat(title, F.lit(" — "), place)


def shown_score(score: Column) -> Column:
    """A score at the four digits that are shown: halves go by the double's own value times 10,000, not by the digits that it is written with."""
    return F.round(score * 10_000.0) / 10_000.0


def citation_line(rank: Column, title: Column, page: Column, section: Column, index: Column, total: Column, score: Column) -> Column:
    """``[1] Source: Title | Page: 3 | Section: Sorting | Chunk: 0/9 | Score: 0.5000``; page and section where known."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), rank.cast("string"), F.lit("] Source: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown source"))),
        F.when(page.isNotNull(), F.concat(F.lit("Page: "), page.cast("string"))),
        F.when(section != "", F.concat(F.lit("Section: "), section)),
        F.concat(F.lit("Chunk: "), shown(index), F.lit("/"), shown(total)),
        F.concat(F.lit("Score: "), F.format_string("%.4f", score)),
    )


def clipped(text: Column, most: int) -> Column:
    """Text of at most ``most`` characters, an ellipsis in place of the rest."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


def missing(value: Column) -> Column:
    """Null for what payloads use as missing: blank, or the word None."""
    return F.when(F.trim(value).isin("", "None"), None).otherwise(value)


def escape_markup(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def data_block(label: str, text: Column, most: int = 80_000) -> Column:
    """Untrusted text as an escaped, labelled block; longer texts than ``most`` are an error."""
    if not label.replace("_", "").isalnum():
        raise ValueError("a label holds letters, digits and underscores only")
    clean = escape_markup(F.replace(text, F.lit("\x00"), F.lit("")))
    block = F.concat(F.lit(f'<untrusted_data label="{label}">\n'), clean, F.lit("\n</untrusted_data>"))
    return F.when(F.length(text) > most, F.raise_error(F.lit(f"{label} is longer than {most} characters"))).otherwise(block)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "")


def fenced_json(text: Column) -> Column:
    """The one JSON document of a reply, out of one optional code fence."""
    fenced = F.regexp_extract(strip(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(fenced != "", fenced).otherwise(strip(text))


def even_seeds(headings: Column, title: Column, most: int = 10) -> Column:
    """Distinct headings (case aside), evenly thinned to ``most``, and the title if none of them is it."""
    clean = F.filter(F.transform(headings, lambda h: F.regexp_replace(strip(h), r"\s+", " ")), lambda h: h != "")
    lows = F.transform(clean, lambda h: F.lower(h))
    distinct = F.filter(clean, lambda h, i: F.array_position(lows, F.lower(h)) == i + 1)
    stride = F.size(distinct) / F.lit(float(most))
    thin = F.when(F.size(distinct) > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(distinct, F.floor(i * stride).cast("int")))).otherwise(distinct)
    name = F.regexp_replace(strip(title), r"\s+", " ")
    return F.when((name != "") & ~F.exists(thin, lambda h: F.lower(h) == F.lower(name)), F.concat(thin, F.array(name))).otherwise(thin)
