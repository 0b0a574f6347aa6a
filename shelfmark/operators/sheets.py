"""Spec sheets as rows (record_id, category, field, value): normalised by a schema, and checked for contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folding, scalars as S


def _joined(values: Column) -> Column:
    """A list as JSON; null stays null."""
    return F.when(values.isNotNull(), F.to_json(values))


def _number(x: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.coalesce(S.integral(x).cast("string"), x.cast("string"))


#: Of each kind of field, how its text is normalised (to text; lists are JSON).
KINDS = {
    "text": S.clean, "number": lambda c: _number(S.number(c)), "integer": lambda c: S.integral(S.number(c)).cast("string"), "flag": lambda c: S.yes_no(c).cast("string"), "date": S.iso_date,
    "mhz": lambda c: _number(S.mhz(c)), "gb": lambda c: _number(S.gigabytes(c)), "mb": lambda c: _number(S.megabytes(c)), "mm": lambda c: _number(S.millimetres(c)), "watts": lambda c: _number(S.watts(c)),
    "pcie": S.pcie_version, "resolution": S.resolution, "gtin": S.gtin,
    "memory_type": lambda c: folding.only(folding.memory_types(c)), "memory_types": lambda c: _joined(folding.memory_types(c)), "sockets": lambda c: _joined(folding.sockets(c)), "socket": lambda c: folding.only(folding.sockets(c)),
    "texts": lambda c: _joined(folding.texts(c)), "integers": lambda c: _joined(folding.integers(c)), "frequencies": lambda c: _joined(folding.frequencies(c)),
    "m2_length": lambda c: S.m2_length(c).cast("string"), "m2_slots": lambda c: _joined(folding.m2_slots(c)),
    **{name: (lambda c, name=name: folding.enum(name, c)) for name in folding.ENUMS},
    **{f"{name}s": (lambda c, name=name: _joined(folding.enum_list(name, c))) for name in ("board_form", "psu_format", "memory_form")},
}


def normalise(sheet: DataFrame, schema: DataFrame) -> DataFrame:
    """record_id, category, field, kind, value of the fields that the schema (category, field, kind) knows and whose value can be read.

    Null and blank values, and those that are unreadable or ambiguous, give no row; repeated rows stay. One join with the schema,
    whose size Spark judges, then one pass.
    """
    rows = sheet.join(F.broadcast(schema.select("category", "field", "kind")), ["category", "field"])
    made = F.coalesce(*(F.when(F.col("kind") == kind, rule(F.col("value"))) for kind, rule in KINDS.items()))
    return S.apart(rows.select("record_id", "category", "field", "kind", made.alias("value"))).where("value is not null")


#: The categories whose records always name the kinds of memory that they take, and the field that does.
MEMORY_OF, MEMORY_FIELD = ("PROCESSADOR", "PLACA_MAE"), "tiposMemoriaSuportados"


def payload(records: DataFrame, normalised: DataFrame) -> DataFrame:
    """record_id, category, fields (a map, by name in order): what a record (record_id, category) sends on of its rows of `normalise`.

    Fields that have no value are left out; of a field that stands several times in a record the least value counts. Processors
    and boards always have MEMORY_FIELD, an empty list if none is known. Records without rows have an empty map; repeated
    records stay repeated. One aggregation by record, on as many entries as the schema has fields, and one join.
    """
    least = normalised.groupBy("record_id", "category", "field").agg(F.min("value").alias("value"))
    maps = least.groupBy("record_id", "category").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("entries"))
    joined = records.select("record_id", "category").join(maps.hint("merge"), ["record_id", "category"], "left")
    none = F.array().cast("array<struct<field:string,value:string>>")
    had = F.coalesce("entries", none)
    lacks = F.col("category").isin(*MEMORY_OF) & ~F.exists(had, lambda e: e.field == MEMORY_FIELD)
    added = F.concat(had, F.array(F.struct(F.lit(MEMORY_FIELD).alias("field"), F.lit("[]").alias("value"))))
    return joined.select("record_id", "category", F.map_from_entries(F.array_sort(F.when(lacks, added).otherwise(had))).alias("fields"))


#: By category fields of which the first may not be above the second; and endings of fields that can't be 0.
PAIRS = (("PROCESSADOR", "frequenciaBaseMhz", "frequenciaTurboMhz"), ("PROCESSADOR", "nucleos", "threads"), ("PLACA_VIDEO", "clockBaseMhz", "clockBoostMhz"), ("VENTOINHA", "rpmMinima", "rpmMaxima"))
LENGTHS = "(alturaMm|larguraMm|profundidadeMm|comprimentoMm)$"


def check(sheet: DataFrame, kits: DataFrame | None = None) -> DataFrame:
    """sheet (record_id, category, field, value) with reason: why a value can't be right, else null.

    kits: record_id, total_gb, the capacities that records name for a whole memory kit. Numbers are judged alone, then
    against the other fields of the record that are left: at most one row a record is joined back. A field that stands several times
    in a record is judged row by row, and by its least value against others. Texts that are no number are not judged.
    """
    n = F.col("value").try_cast("double")
    alone = F.when(F.isnan(n) | (F.abs(n) == float("inf")) | (n < 0), "VALOR_NUMERICO_INVALIDO").when((n == 0) & F.col("field").rlike(LENGTHS), "DIMENSAO_NULA")
    rows = sheet.withColumn("alone", alone)
    of = lambda category, field: F.min(F.when((F.col("category") == category) & (F.col("field") == field) & F.col("alone").isNull(), F.col("value").try_cast("double")))
    pairs = [of(c, low) > of(c, high) for c, low, high in PAIRS]
    form = F.min(F.when((F.col("category") == "PLACA_MAE") & (F.col("field") == "formato"), F.col("value")))
    slots = (form == "MINI_ITX") & (of("PLACA_MAE", "slotsMemoria") > 2)
    modules = of("MEMORIA_RAM", "quantidadeModulos")
    bad_modules = ~((modules == F.floor(modules)) & modules.between(1, 16))
    made = modules * of("MEMORIA_RAM", "capacidadePorModuloGb")
    totals = rows.groupBy("record_id").agg(*(p.alias(f"p{i}") for i, p in enumerate(pairs)), slots.alias("slots"), bad_modules.alias("bad_modules"), made.alias("made"))
    if kits is not None:
        told = kits.groupBy("record_id").agg(F.collect_set("total_gb").alias("told"))  # what one record names
        totals = totals.join(told.hint("merge"), "record_id", "left")
    else:
        totals = totals.withColumn("told", F.array().cast("array<double>"))
    kit = F.exists("told", lambda t: t != F.col("made"))
    is_ = lambda category, *fields: (F.col("category") == category) & F.col("field").isin(*fields)
    together = F.coalesce(
        *(F.when(F.col(f"p{i}") & is_(c, low, high), "INTERVALO_INCONSISTENTE") for i, (c, low, high) in enumerate(PAIRS)),
        F.when(F.col("slots") & is_("PLACA_MAE", "slotsMemoria"), "SLOTS_INCOMPATIVEIS_COM_FORMATO"),
        F.when(F.col("bad_modules") & is_("MEMORIA_RAM", "quantidadeModulos"), "QUANTIDADE_MODULOS_INVALIDA"),
        F.when(~F.coalesce(F.col("bad_modules"), F.lit(False)) & kit & is_("MEMORIA_RAM", "capacidadePorModuloGb", "quantidadeModulos"), "CAPACIDADE_KIT_INCONSISTENTE"),
    )
    return rows.join(totals.hint("merge"), "record_id").select(*sheet.columns, F.coalesce("alone", together).alias("reason"))
