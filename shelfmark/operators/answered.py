"""Answers in words or JSON as fields: objects, Markdown tables, and lines of `Field: value` or `Field - value` with any bullet or number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import discovery

#: Objects that hold the fields inside an answer's object, headings of tables, words that say that nothing is known.
HOLDERS = ("payload", "especificacoes", "especificacoesEncontradas")
HEADINGS = ("campo", "field", "especificacao", "specification")
UNKNOWN = ("null", "none", "na", "naoinformado", "naodisponivel", "desconhecido", "unknown", "notavailable", "notinformed", "semconfirmacao")
#: Fixed patterns: what stands before a line's text, and how a line parts its name and value, the first that fits.
BULLET = r"^[\s\-–—•*▪◦·>\d.)]+"
PARTED = (r"^([^:]{1,140})\s*:\s*(.{1,600})$", r"^([^–—]{1,140})\s+[–—]\s+(.{1,600})$", r"^(.{1,140}?)\s+-\s+(.{1,600})$")
LONGEST_LINE = 800


def _pair(name: Column, value: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"^[*_`\s]+|[*_`\s]+$", "")
    return F.struct(S.blank_to_null(bare(name)).alias("name"), S.blank_to_null(bare(value)).alias("value"))


def _row(line: Column) -> Column:
    """The pair of a row of a Markdown table; null for headings and rules."""
    def read(cells: Column) -> Column:
        ruled = F.get(cells, F.lit(0)).rlike("^:?-{2,}:?$") & F.get(cells, F.lit(1)).rlike("^:?-{2,}:?$")
        return F.when((F.size(cells) >= 2) & ~ruled & ~F.coalesce(S.key(F.get(cells, F.lit(0))).isin(*HEADINGS), F.lit(False)), _pair(F.get(cells, F.lit(0)), F.get(cells, F.lit(1))))

    return S.let(F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(F.regexp_replace(c, "[*_`]", ""))), read)


def _line(line: Column) -> Column:
    """The pair of a line; null if it has none."""
    parted = lambda t: F.coalesce(*(F.when(t.rlike(p), _pair(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2))) for p in PARTED))
    return S.let(F.regexp_replace(F.regexp_replace(line, BULLET, ""), "^[` ]+|[` ]+$", ""), lambda t: F.when(F.length(t) <= LONGEST_LINE, S.let(F.regexp_replace(t, r"\*\*|__", ""), parted)))


def pairs(text: Column) -> Column:
    """An array of structs (name, value) of an answer, in order: an object's members (fenced or not, out of the holders inside it), else its lines' pairs."""
    def read(t: Column) -> Column:
        found = F.when(t.rlike(r"(?s)^\{.*\}$"), F.from_json(t, "map<string,string>"))
        for holder in HOLDERS:
            found = S.let(found, lambda m: F.coalesce(F.from_json(F.try_element_at(m, F.lit(holder)), "map<string,string>"), m))
        lines = F.filter(F.transform(F.split(t, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
        told = F.transform(lines, lambda x: F.when(x.startswith("|") & x.endswith("|"), _row(x)).otherwise(_line(x)))
        members = S.let(found, lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
        return F.filter(F.coalesce(members, told), lambda p: p["name"].isNotNull() & p["value"].isNotNull())

    return S.let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")), read)


def fields(responses: DataFrame, aliases: DataFrame) -> DataFrame:
    """record_id, field, value of answers (record_id, category, response_text): of each field the first value told under its name or an alias.

    aliases: category, field, alias; a field's own name is given as one of them. Names are met as keys, in one equi-join. Values that say
    that nothing is known, or hold no letter and no digit, are left out; links and citations at their ends go. Blank, null and other texts give no row.
    """
    told = responses.select("record_id", F.upper(F.trim("category")).alias("category"), F.posexplode(pairs(F.col("response_text"))).alias("pos", "p"))
    value = S.blank_to_null(discovery.bare_value(F.col("p.value")))
    rows = S.apart(told.select("record_id", "category", "pos", S.key(F.col("p.name")).alias("k"), value.alias("value"))).where("k is not null and value is not null")
    known = aliases.select(F.upper("category").alias("category"), "field", S.key(F.col("alias")).alias("k")).distinct()
    said = rows.where(~F.coalesce(S.key(F.col("value")).isin(*UNKNOWN), F.lit(True))).join(F.broadcast(known), ["category", "k"])
    return said.groupBy("record_id", "field").agg(F.min_by("value", F.struct("pos", "value")).alias("value"))
