"""Product identity: the ladder GTIN, brand and part number, brand and specific model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Words that name no model, and adjectives of listings that tell no variant.
GENERIC = ("gaming", "gamer", "pro", "plus", "ultra", "series", "serie", "desktop", "notebook", "monitor", "mouse", "teclado", "headset", "ssd", "hdd", "ram", "memoria", "fonte", "gabinete", "cooler")
ADJECTIVES = ("wireless", "black", "white", "preto", "branco", "rgb", "usb", "bluetooth", "sem", "fio")


def model_is_specific(model: Column) -> Column:
    """A digit or a code, or two words of which one has four letters and isn't generic."""
    value = S.clean(model)
    low = F.lower(value)
    tokens = F.regexp_extract_all(low, F.lit("[a-z]+"), 0)
    telling = F.exists(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC, *ADJECTIVES))
    return F.coalesce((F.length(value) >= 3) & ~low.isin(*GENERIC) & (value.rlike(r"\d|[-_/]") | ((F.size(tokens) >= 2) & telling)), F.lit(False))


def identity_ladder(rows: DataFrame) -> DataFrame:
    """rows (brand, model, mpn, gtin) with id_method, id_confidence and id_key."""
    brand, model, mpn, gtin = S.clean(F.col("brand")), S.clean(F.col("model")), S.clean(F.col("mpn")), S.digits(F.col("gtin"))
    by_gtin, by_mpn = F.length(gtin).isin(8, 12, 13, 14), brand.isNotNull() & mpn.isNotNull()
    by_model = brand.isNotNull() & model_is_specific(model)
    pair = lambda other: F.concat(F.coalesce(S.key(brand), F.lit("")), F.lit("|"), F.coalesce(S.key(other), F.lit("")))
    return rows.withColumns({
        "id_method": F.when(by_gtin, "GTIN").when(by_mpn, "BRAND_MPN").when(by_model, "BRAND_MODEL"),
        "id_confidence": F.when(by_gtin | by_mpn, "VERY_HIGH").when(by_model, "HIGH").otherwise("INSUFFICIENT"),
        "id_key": F.when(by_gtin, gtin).when(by_mpn, pair(mpn)).when(by_model, pair(model)),
    })


def comparison_keys(rows: DataFrame) -> DataFrame:
    """rows with gtin_key, mpn_key and model_key (plain lower case)."""
    low = lambda c: F.lower(S.clean(F.col(c)))
    return rows.withColumns({"gtin_key": S.digits(F.col("gtin")), "mpn_key": F.concat(low("brand"), F.lit("|"), low("mpn")), "model_key": F.concat(low("brand"), F.lit("|"), low("model"))})


def search_query(brand: Column, model: Column, mpn: Column, gtin: Column) -> Column:
    """What to search a store for: brand and the quoted part number, else the GTIN, else the model."""
    strong = F.coalesce(F.concat(F.lit('"'), F.replace(mpn, F.lit('"'), F.lit("")), F.lit('"')), gtin, model)
    return S.blank_to_null(F.concat_ws(" ", brand, strong))
