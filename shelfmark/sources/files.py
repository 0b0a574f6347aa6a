"""Reading offer batches and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.offers import normalize_offers

ALIASES = ("ofertaId", "id", "produtoId", "nome", "produto", "urlOriginal", "url", "link", "urlAfiliada", "urlAfiliado", "precoAtual", "preco", "disponivelAtual", "disponivel", "statusAtual", "status")


def read_offer_batch(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Offers of a batch as `normalize_offers` returns them. kind: json (a file is a list, or a list under ofertas, itens or items), csv (with header), txt (a URL a line; blank lines and those with # are skipped)."""
    if kind == "json":
        # As maps, so that a key that a row doesn't have is told from one that is null.
        whole = spark.read.text(path, wholetext=True)
        many, named = F.from_json("value", "array<map<string,string>>"), F.from_json("value", "map<string,array<map<string,string>>>")
        listed = F.coalesce(*(F.try_element_at(named, F.lit(n)) for n in ("ofertas", "itens", "items")))
        rows = whole.select(F.explode(F.when(F.ltrim("value").startswith("["), many).otherwise(listed)).alias("fields"))
        return normalize_offers(rows, "fields")
    if kind == "csv":
        rows = spark.read.option("header", True).csv(path)
        rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    elif kind == "txt":
        rows = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")
    else:
        raise ValueError(f"unknown kind {kind}")
    return normalize_offers(rows.select(*(c for c in rows.columns if c in ALIASES)))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested cells as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.option("header", True).csv(path)
