"""Attribute lists inside a row (array of structs with name and value): lookups, the identity they tell, and those that are of the product itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: The labels under which a page tells a part of a product's identity, best first.
LABELS = {
    "brand": ("marca", "manufacturer"), "visible": ("modelo",), "number": ("número do processador", "numero do processador"), "traits": ("características", "caracteristicas"), "reference": ("referência", "referencia"),
    "code": ("mpn", "part number", "part number do fabricante", "código do fabricante", "codigo do fabricante"), "other_model": ("model", "model name"), "line": ("linha", "line"), "gtin": ("gtin", "ean", "ean/gtin", "gtin/ean", "código de barras", "codigo de barras", "código ean", "codigo ean", "ean 13", "ean13"),
}
#: What stands in names of attributes of the sale rather than of the product.
OF_THE_SALE = ("vendido por", "vendedor", "seller", "entregue por", "entrega", "frete", "prazo", "cep", "parcel", "pagamento", "cartão", "cartao", "pix", "total", "preço", "preco", "sacola")
#: Fixed patterns: commercial names of processors and graphics chips in titles, a code at a title's end, codes inside a list of traits.
PROCESSORS = (r"(?i)\bRyzen\s+[3579]\s+([0-9]{4}[A-Z0-9]+)\b", r"(?i)\bCore\s+(i[3579][ -]?[0-9]{4,5}[A-Z0-9]*)\b", r"(?i)\bCore\s+Ultra\s+[3579]\s+([0-9]{3}[A-Z0-9]*)\b")
GRAPHICS = (r"(?i)\b(RX\s*[0-9]{4}\s*(?:XTX|XT|GRE)?)\b", r"(?i)\b((?:RTX|GTX)\s*[0-9]{3,4}(?:\s*(?:TI|SUPER))?)\b")
LAST_CODE = r"(?i)\s-\s([A-Z0-9][A-Z0-9._/+() -]{1,35})$"
PART_IN_TRAITS, MODEL_IN_TRAITS = r"(?i)(?:Part\s*Number|P/N|MPN)\s*:\s*([^|;]+)", r"(?i)(?:^|\|)\s*Modelo\s*:\s*([^|;]+)"


def first_each(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first of the values of each key, in order. Sorted by key and place, so long lists cost n log n."""
    keyed = F.array_sort(F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))))
    kept = S.let(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"])))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"])


def present(attributes: Column) -> Column:
    """name and value of the attributes that have both, white space collapsed; an empty array for null."""
    tidy = F.transform(attributes, lambda a: F.struct(S.clean(a["name"]).alias("name"), S.clean(a["value"]).alias("value")))
    kept = F.filter(tidy, lambda a: a["name"].isNotNull() & a["value"].isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<name:string,value:string>>"))


def lookup(attributes: Column) -> Column:
    """A map from names in lower case to the last value given under each."""
    return F.map_from_entries(F.transform(first_each(F.reverse(present(attributes)), lambda a: F.lower(a["name"])), lambda a: F.struct(F.lower(a["name"]), a["value"])))


def code_like(c: Column) -> Column:
    """Whether a text looks like a maker's part number: letters and digits, and a hyphen, a slash or eight places without a space."""
    joined = c.rlike("[-/]") | ((F.length(c) >= 8) & ~c.rlike(r"\s"))
    return F.coalesce((F.length(c) >= 5) & c.rlike("[A-Za-z]") & c.rlike("[0-9]") & joined, F.lit(False))


def _found(text: Column, *patterns: str) -> Column:
    """What the first pattern that fits captures, white space collapsed."""
    return F.coalesce(*(S.clean(F.regexp_extract(text, p, 1)) for p in patterns))


def refined(title: Column, brand: Column, model: Column, mpn: Column, attributes: Column) -> Column:
    """Struct (brand, model, mpn): a record's identity by its title, what a reader told, and its attributes.

    Brand: the told one if the title names it, else the labelled one. Part number: the labelled code, a reference or a code among the
    traits that looks like one, the told one, else a labelled model that does and that the title names (or that stands beside a
    processor's number). Model: the processor's number, the labelled model unless it is the part number, the told one, a code at the
    title's end. One that is missing or repeats the part number gives way to a commercial name in the title, then to the line.
    """
    def read(x: Column) -> Column:
        told = {k: F.coalesce(*(F.try_element_at(x.by, F.lit(name)) for name in names)) for k, names in LABELS.items()}
        return F.struct(*(v.alias(k) for k, v in told.items()), x.title.alias("title"), x.brand.alias("told_brand"), x.model.alias("told_model"), x.mpn.alias("told_mpn"))

    def part_number(t: Column) -> Column:
        fits = lambda c: F.when(code_like(c), c)
        inside = _found(t.traits, MODEL_IN_TRAITS)
        in_title = F.when(code_like(inside) & ~inside.eqNullSafe(t.visible) & F.contains(t.title, inside), inside)
        known = F.coalesce(t.code, fits(t.reference), fits(_found(t.traits, PART_IN_TRAITS)), in_title, t.told_mpn)
        visible = F.when(code_like(t.visible) & (t.number.isNotNull() | F.contains(t.title, t.visible)), t.visible)
        last = _found(t.title, LAST_CODE)
        model = F.coalesce(t.number, F.when(~t.visible.eqNullSafe(known), t.visible), t.told_model, t.visible, t.other_model, F.when(last.rlike("[A-Za-z]") & last.rlike("[0-9]"), last))
        return F.struct(t.alias("t"), F.coalesce(known, visible).alias("mpn"), model.alias("model"))

    def commercial(x: Column) -> Column:
        t, dull = x.t, x.model.isNull() | F.coalesce(x.model == x.mpn, F.lit(False))
        chip = F.upper(_found(t.title, *GRAPHICS))
        intel = F.regexp_replace(_found(t.title, PROCESSORS[1]), " ", "")
        name = F.coalesce(F.upper(_found(t.title, PROCESSORS[0])), intel, F.upper(_found(t.title, PROCESSORS[2])), F.when(chip.isNotNull(), F.concat_ws(" ", t.line, chip)))
        model = F.when(dull, F.coalesce(name, F.when(x.mpn.isNotNull(), t.line), x.model)).otherwise(x.model)
        brand = F.when(F.contains(F.lower(t.title), F.lower(t.told_brand)), t.told_brand).otherwise(F.coalesce(t.brand, t.told_brand))
        return F.struct(brand.alias("brand"), model.alias("model"), x.mpn.alias("mpn"))

    given = F.struct(lookup(attributes).alias("by"), F.coalesce(S.clean(title), F.lit("")).alias("title"), S.clean(brand).alias("brand"), S.clean(model).alias("model"), S.clean(mpn).alias("mpn"))
    return S.let(S.let(S.let(given, read), part_number), commercial)


def labelled_gtin(attributes: Column, otherwise: Column) -> Column:
    """A GTIN with a right check digit of the attributes, else the other one's digits if theirs is right."""
    return F.coalesce(S.let(lookup(attributes), lambda by: F.coalesce(*(S.gtin(F.try_element_at(by, F.lit(name))) for name in LABELS["gtin"]))), S.gtin(otherwise))


def of_product(attributes: Column, identity: Column) -> Column:
    """The attributes of the product itself: none of the sale, no brand other than the identity's, a model that is the part number named MPN, each once."""
    of_sale = lambda name: F.greatest(*(F.contains(F.lower(name), F.lit(w)) for w in OF_THE_SALE))
    same = lambda a, b: F.lower(a) == F.lower(b)

    def named(a: Column) -> Column:
        code = F.lower(a["name"]).isin("modelo", "model") & same(a["value"], identity["mpn"]) & ~F.lower(identity["model"]).eqNullSafe(F.lower(identity["mpn"]))
        return F.struct(F.when(F.coalesce(code, F.lit(False)), "MPN").otherwise(a["name"]).alias("name"), a["value"].alias("value"))

    other_brand = lambda a: F.coalesce(F.lower(a["name"]).isin("marca", "manufacturer") & ~same(a["value"], identity["brand"]), F.lit(False))
    kept = F.filter(present(attributes), lambda a: ~of_sale(a["name"]) & ~other_brand(a))
    return first_each(F.transform(kept, named), lambda a: F.struct(F.lower(a["name"]), F.lower(a["value"])))
