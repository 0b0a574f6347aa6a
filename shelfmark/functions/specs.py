"""Typed specifications of a record by its category: rules compiled into one projection, without a join or a shuffle.

A category is a list of fields. A field lists ways to find its value, the most trusted first: under attribute names, behind a label
in the text, by a word in the text. A way gives a raw text, a converter a value or null, and the first value wins.
Attribute names are compared as tokens, exactly; nothing is guessed from parts of a name.

Values are text in one form each: whole numbers without a fraction, others with a decimal point, `true` and `false`, lists joined by `, `.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars as S

#: Flags of all patterns: case and Unicode letters as in the shops' languages, `.` across lines.
FLAGS = "(?isU)"


@dataclass(frozen=True)
class Names:
    """The value under the first of these attribute names (tokens) that a record has; find: a part of it."""

    tokens: str
    find: str = ""
    convert: str = ""


@dataclass(frozen=True)
class Text:
    """What the first of these patterns captures in the text."""

    patterns: tuple[str, ...]
    convert: str = ""

    def __init__(self, *patterns: str, convert: str = ""):
        object.__setattr__(self, "patterns", patterns)
        object.__setattr__(self, "convert", convert)


@dataclass(frozen=True)
class Words:
    """false where the text has one of `no`, true where it has one of `yes`."""

    yes: tuple[str, ...] = ()
    no: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole:
    """The value under the first of these names, else the whole text."""

    tokens: str = ""


@dataclass(frozen=True)
class Part:
    """What the first of the patterns captures in the value under these names, or, where there is none, in the text."""

    tokens: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class Joined:
    """The values under all of these names together, else the whole text."""

    tokens: str


@dataclass(frozen=True)
class Every:
    """All that the patterns capture in the values under these names and in the text, parted by spaces."""

    tokens: str
    patterns: tuple[str, ...]
    convert: str = ""


@dataclass(frozen=True)
class Told:
    """A value where the text has the pattern."""

    pattern: str
    value: str


@dataclass(frozen=True)
class Total:
    """The sum of the counts that the pattern captures in the value under these names, else in the text."""

    tokens: str
    pattern: str


@dataclass(frozen=True)
class Sum:
    """The sum of the positive counts under several groups of names."""

    groups: tuple[str, ...]


@dataclass(frozen=True)
class Counted:
    """The labels whose count is positive; empty, and no other way is asked, where all counts are none. One: only the first."""

    labels: tuple[tuple[str, str], ...]
    one: bool = False


@dataclass(frozen=True)
class Held:
    """Names in the order given whose pattern the source (an attribute, else the text) has, as a list."""

    names: tuple[tuple[str, str], ...]
    tokens: str = ""


@dataclass(frozen=True)
class Made:
    """A value worked out of other fields."""

    make: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Field:
    """A field; one whose name begins with _ serves others only. only: (field, value) without which it has none."""

    name: str
    convert: str
    ways: tuple
    only: tuple = ()

    def __init__(self, name: str, convert: str, *ways, only: tuple = ()):
        for k, v in (("name", name), ("convert", convert), ("ways", ways), ("only", only)):
            object.__setattr__(self, k, v)


def first_number(c: Column) -> Column:
    """The first number; a comma is a decimal one."""
    return F.replace(F.regexp_extract(c, r"-?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def _scaled(c: Column, units: dict[str, float], digits: int | None, bare: Callable[[Column], Column] = lambda n: n) -> Column:
    """The first number times the factor of the first of the units that the text names."""
    def scale(x: Column) -> Column:
        out = bare(x.n)
        for unit, factor in reversed(units.items()):
            scaled = x.n * factor if factor >= 1 else x.n / (1 / factor)
            out = F.when(F.contains(x.low, F.lit(unit)), scaled if digits is None or factor >= 1 else F.round(scaled, digits)).otherwise(out)
        return out

    return S.let(F.struct(first_number(c).alias("n"), F.lower(c).alias("low")), scale)


def shown(n: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(n == F.rint(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def _whole(n: Column) -> Column:
    return F.rint(n).cast("long").cast("string")


def grouped(c: Column) -> Column:
    """A whole number whose thousands may be grouped by dots or commas."""
    def read(t: Column) -> Column:
        mixed = F.when(F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), "."), F.translate(t, ".,", "@.")).otherwise(F.replace(t, F.lit(","), F.lit("")))
        both = (F.instr(t, ",") > 0) & (F.instr(t, ".") > 0)
        return F.when(t.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(t, "[.,]", "")).when(both, F.replace(mixed, F.lit("@"), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))

    return _whole(S.let(F.regexp_extract(c, r"\d[\d.,]*", 0), read).try_cast("double"))


def _flag(c: Column) -> Column:
    return F.when(F.trim(c).isin("✓", "✔", "✅"), "true").when(F.trim(c).isin("✗", "✘", "❌"), "false").otherwise(S.let(S.token(c), lambda t: F.when(t.isin(*YES), "true").when(t.isin(*NO), "false")))


def _vocabulary(table: tuple[tuple[str, str], ...], c: Column, of: Callable[[Column], Column] = S.token) -> Column:
    """The value of the first pattern of the table that the token has."""
    def choose(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, value in reversed(table):
            out = F.when(t.rlike(pattern), value).otherwise(out)
        return out

    return S.let(of(c), choose)


def _socket(c: Column) -> Column:
    def read(t: Column) -> Column:
        lga, other = F.regexp_extract(t, r"(?i)(?:FC)?LGA\s*(\d{3,4})", 1), F.regexp_extract(t, r"(?i)\b(AM[2345]|TR4|sTRX4|sTR5|sWRX8)\b", 1)
        bare = F.upper(F.regexp_replace(F.regexp_replace(t, r"(?i)^(?:socket|soquete)\s*", ""), r"\s+", ""))
        return F.when(lga != "", F.concat(F.lit("LGA"), lga)).when(other != "", F.upper(other)).otherwise(S.blank_to_null(bare))

    return S.let(S.clean(c), read)


def _memory_types(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"\bDDR\s*([345])\b"), 1))
    return S.blank_to_null(F.array_join(F.transform(found, lambda x: F.concat(F.lit("DDR"), x)), ", "))


def _only_type(c: Column) -> Column:
    return S.let(_memory_types(c), lambda t: F.when(~F.contains(t, F.lit(",")), t))


def _interface(c: Column) -> Column:
    has = lambda p: F.regexp_instr(c, F.lit(FLAGS + p)) > 0
    return F.when(has(r"\bNVMe\b") | (has(r"\bPCIe?\b|PCI\s*Express") & ~has(r"\bSATA\b")), "NVME_PCIE").when(has(r"\bSAS\b"), "SAS").when(has(r"\bSATA\b"), "SATA")


def _storage_format(c: Column) -> Column:
    return F.when(S.token(c).rlike(r"m_2|^m2$") | F.coalesce(c, F.lit("")).rlike(r"\b22(?:30|42|60|80|110)\b"), "M2").otherwise(_vocabulary(STORAGE_FORMATS, c))


def _each(c: Column, by: str, read: Callable[[Column], Column]) -> Column:
    """What the parts of a list give, each once, as a list."""
    return S.blank_to_null(F.array_join(F.array_distinct(F.array_compact(F.transform(F.split(c, by), read))), ", "))


def _sockets(c: Column) -> Column:
    """All sockets named, and the numbers behind `Intel:`, which are LGA ones."""
    named = F.transform(F.regexp_extract_all(c, F.lit(FLAGS + r"\b(AM[2345]|TR4|sTRX4|sTR5|LGA\s*(?:\d{3,4}|115X))\b"), 1), lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    intel = F.regexp_extract_all(F.regexp_extract(c, FLAGS + r"Intel\s*:\s*(.+?)(?=\s*(?:\||AMD\s*:|$))", 1), F.lit(r"(?i)(?:LGA\s*)?(115X|\d{4})"), 1)
    return S.blank_to_null(F.array_join(F.array_distinct(F.concat(named, F.transform(intel, lambda x: F.concat(F.lit("LGA"), F.upper(x))))), ", "))


def _places(pattern: str, shown_as: Callable[..., Column]) -> Callable[[Column], Column]:
    """A list of places with their sizes, each as `shown_as` writes what the pattern captures."""
    def read(c: Column) -> Column:
        groups = [F.regexp_extract_all(c, F.lit(FLAGS + pattern), i) for i in range(1, pattern.replace("(?:", "").count("(") + 1)]
        rows = F.transform(groups[0], lambda p, i: shown_as(_vocabulary(PLACES, p), *(F.get(g, i) for g in groups[1:])))
        return S.blank_to_null(F.array_join(rows, ", "))

    return read


def _side(i: int, card: bool = False) -> Callable[[Column], Column]:
    """The i-th of three lengths in mm; of a card three that are all below 100 are in cm."""
    small = lambda t: F.when(F.array_max(t) < 100, t[i] * 10).otherwise(t[i]) if card else t[i]
    return lambda c: S.let(S.triplet_mm(c), lambda t: shown(small(t)))


#: Words for yes and no of attribute values; forms, formats and classes by their tokens.
YES = ("sim", "yes", "true", "possui", "incluso", "incluido", "com", "compativel")
NO = ("nao", "no", "false", "sem", "nao_possui", "nao_incluso", "nao_incluido")
BOARD_FORMS = (("mini_itx|^itx$", "MINI_ITX"), ("micro_atx|microatx|^m_?atx$", "MICRO_ATX"), ("e_atx|eatx|extended_atx", "E_ATX"), ("^atx$|formato_atx|^atx_", "ATX"))
SUPPLY_FORMS = (("sfx_?l", "SFX_L"), ("^sfx$|formato_sfx", "SFX"), ("flex_atx", "FLEX_ATX"), ("^tfx$|formato_tfx", "TFX"), ("^atx$|formato_atx|^atx_|_atx_", "ATX"))
STORAGE_FORMATS = (("2_5", "POLEGADAS_2_5"), ("3_5", "POLEGADAS_3_5"), ("pcie.*(?:placa|add_in)|(?:placa|add_in).*pcie", "PLACA_PCIE"))
STORAGE_TYPES = (("ssd|nvme", "SSD"), ("hdd|disco_rigido", "HDD"))
MODULE_FORMS = (("so_dimm|sodimm", "SO_DIMM"), ("dimm", "DIMM"))
MODULARITY = (("^nao$|^no$|^false$|modular_nao|nao_modular|non_modular", "NAO_MODULAR"), ("semi_modular", "SEMI_MODULAR"), ("^sim$|^yes$|^true$|^completamente$|^totalmente$|modular", "MODULAR"))
M2_KEYS = ((r"b_?m\b|b_m_key|key_b_m", "B_M"), (r"(?:^|_)m(?:_|$)", "M"), (r"(?:^|_)b(?:_|$)", "B"))

CASE_SIZES = (("full_tower", "FULL_TOWER"), ("mid_?tower", "MID_TOWER"), ("mini_?tower", "MINI_TOWER"), ("^sff$|^small_form_factor$", "SFF"), ("open_frame", "OPEN_FRAME"))
COOLERS = (("water_cooler|(?:^|_)aio(?:_|$)", "WATER_COOLER"), ("air_?cooler|tower_cooler", "AIR_COOLER"))
FAN_PLUGS = (("4_pin|pwm", "PWM_4_PINOS"), ("3_pin", "DC_3_PINOS"), ("molex", "MOLEX"), ("propriet", "PROPRIETARIO"))
PLACES = (("^sup|^top", "TOPO"), ("^tras|^rear", "TRASEIRA"), ("^inf|^bottom", "INFERIOR"), ("^fr", "FRENTE"), ("^lat|^side", "LATERAL"))
HANDS = (("destro", "Destro"), ("canhoto", "Canhoto"), ("ambidestro", "Ambidestro"))
SCREENS = ("4K", "UHD", "QHD", "WQHD", "FHD", "FULL HD", "HD")

CONVERTERS: dict[str, Callable[[Column], Column]] = {
    "text": S.clean, "upper": lambda c: F.upper(S.clean(c)), "number": lambda c: shown(first_number(c)), "integer": lambda c: _whole(first_number(c)), "grouped": grouped,
    "mhz": lambda c: _whole(_scaled(c, {"ghz": 1000, "mhz": 1}, None, lambda n: F.when(n < 20, n * 1000).otherwise(n))),
    "gb": lambda c: _whole(_scaled(c, {"tb": 1024, "mb": 1 / 1024}, None)), "mb": lambda c: shown(_scaled(c, {"kb": 1 / 1024, "gb": 1024}, 3)),
    "mm": lambda c: shown(_scaled(c, {"cm": 10, "mm": 1}, None)), "flag": _flag, "socket": _socket, "memory_types": _memory_types, "memory_type": _only_type,
    "board_form": lambda c: _vocabulary(BOARD_FORMS, c), "supply_form": lambda c: _vocabulary(SUPPLY_FORMS, c), "storage_type": lambda c: _vocabulary(STORAGE_TYPES, c), "storage_format": _storage_format,
    "interface": _interface, "module_form": lambda c: _vocabulary(MODULE_FORMS, c), "modularity": lambda c: _vocabulary(MODULARITY, c), "m2_length": lambda c: S.m2_length(c).cast("string"),
    "m2_key": lambda c: _vocabulary(M2_KEYS, c), "side_1": _side(0), "side_2": _side(1), "side_3": _side(2), "card_1": _side(0, True), "card_2": _side(1, True), "card_3": _side(2, True),
    "sum": lambda c: S.let(F.transform(F.split(c, " "), lambda x: F.rint(first_number(x))), lambda ns: F.when(F.exists(ns, lambda n: n > 0), _whole(F.aggregate(F.filter(ns, lambda n: n > 0), F.lit(0.0), lambda a, n: a + n)))),
    "case_size": lambda c: _vocabulary(CASE_SIZES, c), "cooler_type": lambda c: _vocabulary(COOLERS, c), "fan_plug": lambda c: _vocabulary(FAN_PLUGS, c), "present": lambda c: F.when(c != "", "true"), "sockets": _sockets,
    "board_forms": lambda c: _each(c, "[/,|;]+", lambda x: _vocabulary(BOARD_FORMS, x)), "supply_forms": lambda c: _each(c, "[/,|;]+", lambda x: _vocabulary(SUPPLY_FORMS, x)),
    "fan_places": _places(r"(Superior|Topo|Traseir[oa]|Inferior|Frente|Frontal|Lateral)\s*:\s*(\d+)\s*x\s*(\d+)\s*mm", lambda place, n, size: F.concat(place, F.lit(" "), n, F.lit("x"), size)),
    "radiator_places": _places(r"(Top|Topo|Front|Frente|Frontal|Rear|Traseir[oa]|Bottom|Inferior|Side|Lateral)\s*:?\s*(?:up\s+to\s*)?(120|140|240|280|360|420)\s*mm", lambda place, size: F.concat(place, F.lit(" "), size)),
    "unbracketed": lambda c: S.clean(F.regexp_replace(c, r"(?iU)\s*\([^)]*(?:microfone|computador)[^)]*\)", "")), "highest": lambda c: shown(F.array_max(F.transform(F.split(c, " "), first_number))),
    "greatest": lambda c: F.array_max(F.transform(F.split(c, " "), lambda x: x.try_cast("int"))).cast("string"), "hand": lambda c: _vocabulary(HANDS, c),
    "screen": lambda c: S.let(F.regexp_extract(c, r"(?i)(\d{3,5}\s*[x×]\s*\d{3,5})", 1), lambda wh: F.when(wh != "", F.regexp_replace(F.lower(wh), r"\s*[x×]\s*", "x")).otherwise(F.coalesce(*(F.when(F.contains(F.upper(c), F.lit(n)), n) for n in SCREENS), S.clean(c)))),
    "mount": lambda c: F.regexp_replace(F.regexp_replace(S.clean(c), r"(?i)(\d)\s*[x×]\s*(\d)", "$1x$2"), r"(?i)\s*mm\b", ""), "grams": lambda c: shown(F.when(c.rlike(r"(?i)\bkg\b"), first_number(c) * 1000).otherwise(first_number(c))),
    "absent": lambda c: F.when(c != "", "false"), "unless_none": lambda c: S.let(S.token(c), lambda t: F.when(t.isNotNull(), F.when(t.isin("nao", "nenhum", "sem", "nao_incluso"), "false").otherwise("true"))),
    "percent": lambda c: F.when(F.contains(c, F.lit("%")), shown(first_number(c))),
}


def _has(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike(FLAGS + "|".join(f"(?:{p})" for p in patterns))


class Row:
    """The columns of a record that rules read: keys and vals of its attributes, and its text.

    A way becomes candidates (raw text, converter), each of one look-up or one pattern, so that the whole expression grows with the rules
    and no faster: what is used more than once is read from a candidate, never worked out again.
    """

    def __init__(self, keys: str, vals: str, text: str):
        self.keys, self.vals, self.text = keys, vals, F.col(text)

    def under(self, tokens: str) -> Column:
        at = (f"get({self.vals}, cast(array_position({self.keys}, '{t}') as int) - 1)" for t in tokens.split())
        return F.expr(f"coalesce({', '.join(at)}, null)")

    def source(self, tokens: str) -> Column:
        return F.coalesce(self.under(tokens), self.text) if tokens else self.text

    def candidates(self, way: object, convert: str) -> list[tuple[Column, str]]:
        part = lambda c, pattern: F.regexp_extract(c, FLAGS + pattern, 1)
        if isinstance(way, Names):
            raw = self.under(way.tokens)
            return [(part(raw, way.find) if way.find else raw, way.convert or convert)]
        if isinstance(way, Text):
            return [(part(self.text, p), way.convert or convert) for p in way.patterns]
        if isinstance(way, Part):
            return [(part(self.source(way.tokens), p), convert) for p in way.patterns]
        if isinstance(way, Whole):
            return [(self.source(way.tokens), convert)]
        if isinstance(way, Joined):
            told = F.concat_ws(" | ", *map(self.under, way.tokens.split()))
            return [(F.when(told != "", told).otherwise(self.text), convert)]
        if isinstance(way, Every):
            all_ = F.concat_ws(" | ", *map(self.under, way.tokens.split()), self.text)
            return [(S.let(all_, lambda t: F.array_join(F.concat(*(F.regexp_extract_all(t, F.lit(FLAGS + p), 1) for p in way.patterns)), " ")), way.convert or convert)]
        if isinstance(way, Words):
            return [(F.when(_has(self.text, patterns), told), "text") for patterns, told in ((way.no, "false"), (way.yes, "true")) if patterns]
        if isinstance(way, Told):
            return [(F.when(_has(self.text, (way.pattern,)), way.value), "text")]
        if isinstance(way, Held):
            return [(F.concat_ws(", ", *(F.when(self.source(way.tokens).rlike(FLAGS + p), F.lit(n)) for n, p in way.names)), "text")]
        if isinstance(way, Total):
            return [(F.array_join(F.regexp_extract_all(self.source(way.tokens), F.lit(FLAGS + way.pattern), 1), " "), "sum")]
        if isinstance(way, Sum):
            return [(F.concat_ws(" ", *map(self.under, way.groups)), "sum")]
        assert isinstance(way, Counted)
        counts = F.array(*(F.struct(F.lit(label).alias("label"), first_number(self.under(tokens)).alias("n")) for label, tokens in way.labels))
        labels = lambda counts: F.transform(F.filter(counts, lambda x: F.rint(x["n"]) > 0), lambda x: x["label"])
        told = lambda counts: F.get(labels(counts), F.lit(0)) if way.one else F.when(F.exists(counts, lambda x: x["n"].isNotNull()), F.array_join(labels(counts), ", "))
        return [(S.let(counts, told), "as_is")]

    def all(self, fields: tuple[Field, ...]) -> Column:
        """array<field, convert, raw>: the candidates of all fields, those of a field together, the most trusted first."""
        found = ((f.name, convert, raw) for f in fields for way in f.ways if not isinstance(way, Made) for raw, convert in self.candidates(way, f.convert))
        return F.array(*(F.struct(F.lit(name).alias("field"), F.lit(convert).alias("convert"), raw.alias("raw")) for name, convert, raw in found))


def _converted(c: Column) -> Column:
    """The value of a candidate, by its converter; null if it is not readable."""
    out = F.when(c["convert"] == "as_is", c["raw"])
    for name, convert in CONVERTERS.items():
        out = out.when(c["convert"] == name, convert(c["raw"]))
    return out


def _finished(found: Column, fields: tuple[Field, ...]) -> Column:
    """The map of found values with those made of others, without helpers and fields that another one rules out."""
    get = lambda name: F.try_element_at(found, F.lit(name))
    made = {f.name: (get(f.name), w.make(get)) if i else (w.make(get), get(f.name)) for f in fields for i, w in enumerate(f.ways) if isinstance(w, Made)}
    out = F.map_filter(found, lambda k, v: (v != "") & ~k.startswith("_") & (~k.isin(*made) if made else F.lit(True)))
    for (other, value), names in {f.only: [g.name for g in fields if g.only == f.only] for f in fields if f.only}.items():
        out = F.map_filter(out, lambda k, v: ~k.isin(*names) | F.coalesce(get(other) == value, F.lit(False)))  # noqa: B023
    if not made:
        return out
    entries = F.array(*(F.struct(F.lit(name).alias("key"), F.coalesce(*values).alias("value")) for name, values in made.items()))
    return F.map_concat(out, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def extract(records: DataFrame, categories: dict[str, tuple[Field, ...]], category: str = "category", attributes: str = "attributes", text: str = "text", to: str = "specs") -> DataFrame:
    """The records with `to`, a map of the fields that their category's rules find; empty for other categories.

    attributes: an array of structs with name, value and, if they have one, id, which counts as a name too. Of several attributes of one
    name the first with a value counts.
    """
    a = F.filter(F.coalesce(F.col(attributes), F.array().cast(records.schema[attributes].dataType)), lambda x: S.clean(x["value"]).isNotNull())
    has_id = "id" in records.schema[attributes].dataType.elementType.fieldNames()
    both = F.flatten(F.transform(a, lambda x: F.array(*(F.struct(S.token(x[n]).alias("k"), S.clean(x["value"]).alias("v")) for n in (["id", "name"] if has_id else ["name"])))))
    rows = records.withColumns({"_pairs": F.filter(both, lambda x: x["k"].isNotNull()), "_text": F.coalesce(F.col(text), F.lit(""))})
    rows = rows.withColumns({"_keys": F.transform("_pairs", lambda x: x["k"]), "_vals": F.transform("_pairs", lambda x: x["v"])})
    row, kind = Row("_keys", "_vals", "_text"), F.col(category)
    candidates = F.coalesce(*(F.when(kind == name, row.all(fields)) for name, fields in categories.items()))
    told = F.filter(candidates, lambda c: c["raw"].isNotNull() & ((c["raw"] != "") | (c["convert"] == "as_is")))  # converters give nothing of nothing
    rows = rows.withColumn("_found", F.transform(told, lambda c: F.struct(c["field"].alias("key"), _converted(c).alias("value"))))
    rows = rows.withColumn("_found", F.filter("_found", lambda x: x["value"].isNotNull()))
    first = F.filter("_found", lambda x, i: (i == 0) | (F.get("_found", i - 1)["key"] != x["key"]))  # a field's candidates stand together
    rows = S.apart(rows.withColumn("_map", F.map_from_entries(first)).drop("_pairs", "_text", "_keys", "_vals", "_found"))
    none = F.create_map().cast("map<string,string>")
    done = F.coalesce(*(F.when(kind == name, _finished(F.col("_map"), fields)) for name, fields in categories.items()), none)
    return S.apart(rows.withColumn(to, done).drop("_map"))


def long(extracted: DataFrame, key: str = "record_id", specs: str = "specs") -> DataFrame:
    """key, field, value: a row a field."""
    return extracted.select(key, F.explode(specs).alias("field", "value"))
