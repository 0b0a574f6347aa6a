"""Captured pages: links, headings, text, status and prices as columns; every page is read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

MONEY = r"R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d+(?:,\d{2})?)"


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href: all links in order."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def distinct_links(pages: DataFrame, most: int) -> DataFrame:
    """page_id, href, place: the first `most` distinct links of each page."""
    one = links(pages).groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("place") <= most).drop("pos")


def heading(html: Column) -> Column:
    return S.clean(F.regexp_replace(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "))


def title(html: Column) -> Column:
    return S.clean(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1))


def without_boilerplate(html: Column) -> Column:
    """HTML without scripts, styles, navigation, footers and asides."""
    out = html
    for tag in ("script", "style", "nav", "footer", "aside"):
        out = F.regexp_replace(out, rf"(?s)<{tag}[^>]*>.*?</{tag}>", " ")
    return out


def text(html: Column) -> Column:
    """Plain text of a fragment: tags become spaces, entities their characters."""
    return S.clean(S.unescaped(F.regexp_replace(html, "<[^>]+>", " ")))


def status(page_title: Column, body: Column, url: Column | None = None) -> Column:
    """BLOCKED, ERROR or OK, by title, whole body and, if given, URL."""
    told = F.lower(F.concat_ws(" ", page_title, body, *([] if url is None else [url])))
    blocked = told.rlike("captcha|access denied|verify you are human|unusual traffic")
    return F.when(blocked, "BLOCKED").when(told.rlike("page not found|not found \\(404\\)|error 404"), "ERROR").otherwise("OK")


def money(c: Column) -> Column:
    """The first amount in reais."""
    return S.price_text(F.concat(F.regexp_replace(S.blank_to_null(F.regexp_extract(c, MONEY, 1)), r",\d{2}$", ""), F.lit(","), F.coalesce(S.blank_to_null(F.regexp_extract(F.regexp_extract(c, MONEY, 1), r",(\d{2})$", 1)), F.lit("00"))))


def drop_repeated_lines(c: Column) -> Column:
    """Lines of a text without those that stand above already; order kept."""
    lines = F.split(c, "\n")
    return F.array_join(F.array_distinct(lines), "\n")


def answers(responses: DataFrame) -> DataFrame:
    """record_id, field, value of `Field: value` lines (bullets allowed): the first of each field."""
    line = F.posexplode(F.split("response_text", "\n")).alias("pos", "line")
    pattern = r"^\s*(?:[-*•]\s*)?([^:|]{1,80}?)\s*:\s*(.+?)\s*$"
    rows = responses.select("record_id", line).select("record_id", "pos", S.token(F.regexp_extract("line", pattern, 1)).alias("field"), S.clean(F.regexp_extract("line", pattern, 2)).alias("value"))
    rows = S.apart(rows).where(F.col("field").isNotNull() & F.col("value").isNotNull() & ~F.lower("value").isin("null", "none", "n/a", "-"))
    return rows.groupBy("record_id", "field").agg(F.min_by("value", "pos").alias("value"))


def technical(name: Column) -> Column:
    """Whether an attribute name is technical: not a rating, price, delivery, seller or stock line."""
    return ~F.coalesce(S.spaced(name), F.lit("")).rlike(r"\b(avaliacao|avaliacoes|rating|ranking|preco|price|frete|shipping|vendedor|seller|estoque|stock|script)\b")


#: Lines that only call to buy.
CALLS = "(?iu)^(?:compre agora|aproveite a oferta|oferta imperd[ií]vel|clique aqui|siga nossa loja|curta nossa loja)[!.\\s]*$"


def without_calls(c: Column) -> Column:
    """A description's trimmed lines without those that only call to buy and without repeated ones, in order; blank lines are kept, but one at a time."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: ~x.rlike(CALLS))
    kept = S.let(lines, lambda ls: F.filter(ls, lambda x, i: (x == "") | (F.array_position(ls, x) == i + 1)))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")
