"""Offers: field aliases, price and availability changes, patches, price order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

TOLERANCE = 0.009


def normalize_offers(rows: DataFrame, fields: str | None = None) -> DataFrame:
    """Batch rows of strings under any of their aliases as offer_id, product_id, name, url, price, available, status.

    Between the aliases of price and availability the presence of a key decides, even where its value is null: row by row where
    `fields` names a map column (a key that a row doesn't have is absent), else by the columns of the frame.
    """
    if fields is None:
        have = {c: F.col(c).cast("string") for c in rows.columns}
        get, there = (lambda n: have.get(n, F.lit(None).cast("string"))), (lambda n: F.lit(n in have))
    else:
        get, there = (lambda n: F.try_element_at(fields, F.lit(n))), (lambda n: F.map_contains_key(fields, n))
    first = lambda *names: F.coalesce(*(S.blank_to_null(get(n)) for n in names))
    present = lambda one, other: F.when(there(one), get(one)).otherwise(get(other))
    status = first("statusAtual", "status")
    told = S.yes_no(present("disponivelAtual", "disponivel"))
    return rows.select(
        first("ofertaId", "id").alias("offer_id"),
        first("produtoId").alias("product_id"),
        first("nome", "produto").alias("name"),
        first("urlOriginal", "url", "link", "urlAfiliada", "urlAfiliado").alias("url"),
        S.price_text(present("precoAtual", "preco")).alias("price"),
        F.coalesce(told, F.when(status == "ATIVA", True).when(status == "INDISPONIVEL", False)).alias("available"),
        status.alias("status"),
    )


def price_moved(old: Column, new: Column) -> Column:
    return F.coalesce(new.isNotNull() & (old.isNull() | (F.abs(new - old) > TOLERANCE)), F.lit(False))


def price_changes(current: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Current offers (keys, price, available) against observed ones (keys, ok, price, available): keys, status, new_price, new_available.

    status: ERROR where nothing was observed, UPDATE where price or availability changed (an unknown stored value is filled), else
    UNCHANGED. new_price and new_available are the patch: null where nothing changes. One join on the keys.
    """
    seen = observed.select(*keys, "ok", S.positive(F.col("price")).alias("seen_price"), F.col("available").alias("seen_available"))
    rows = current.select(*keys, S.positive(F.col("price")).alias("price"), "available").join(seen.hint("merge"), keys, "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    price = ok & price_moved(F.col("price"), F.col("seen_price"))
    available = ok & F.col("seen_available").isNotNull() & ~F.col("seen_available").eqNullSafe(F.col("available"))
    return rows.select(
        *keys,
        F.when(~ok, "ERROR").when(price | available, "UPDATE").otherwise("UNCHANGED").alias("status"),
        F.when(price, F.col("seen_price")).alias("new_price"),
        F.when(available, F.col("seen_available")).alias("new_available"),
    )


def price_summary(changes: DataFrame) -> DataFrame:
    """One row: total, updates, unchanged, errors."""
    count = lambda s: F.count_if(F.col("status") == s)
    return changes.agg(F.count("*").alias("total"), count("UPDATE").alias("updates"), count("UNCHANGED").alias("unchanged"), count("ERROR").alias("errors"))


def offer_patch(rows: DataFrame, price: str, status: str, seen_price: str, seen_available: str) -> DataFrame:
    """rows with patch_price and patch_status: an offer is only reactivated from INDISPONIVEL; the sign of a price isn't tested."""
    p = F.when(F.col(seen_price).isNotNull() & (F.col(price).isNull() | (F.abs(F.col(seen_price) - F.col(price)) > TOLERANCE)), F.col(seen_price))
    gone = (F.col(seen_available) == False) & ~F.col(status).eqNullSafe("INDISPONIVEL")  # noqa: E712
    s = F.when(gone, "INDISPONIVEL").when((F.col(seen_available) == True) & (F.col(status) == "INDISPONIVEL"), "ATIVA")  # noqa: E712
    return rows.withColumns({"patch_price": p, "patch_status": s})


def ordered_prices(current: Column, previous: Column) -> tuple[Column, Column]:
    """(current, previous) with a previous price below the current one swapped, and an equal one dropped."""
    swap = previous < current
    return F.when(swap, previous).otherwise(current), F.when(swap, current).when(previous > current, previous)
