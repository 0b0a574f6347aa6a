"""The quality gate: whether a researched sheet can be marked ready, from its essential fields, their scores, confirmations and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import present

#: Reasons in the order in which they are told; the weight of essential fields; least score and coverage.
REASONS = (
    "PAYLOAD_INVALIDO_PARA_CADASTRO", "CAMPOS_OBRIGATORIOS_AUSENTES", "CAMPOS_ESSENCIAIS_AUSENTES", "CAMPOS_ESSENCIAIS_SEM_PROVENIENCIA",
    "CAMPOS_ESSENCIAIS_COM_CONFIANCA_BAIXA", "CONFLITOS_NAO_RESOLVIDOS", "COBERTURA_TECNICA_INSUFICIENTE",
)
ESSENTIAL, LEAST_SCORE, LEAST_COVERAGE = 3, 0.80, 0.80


def quality_gate(records: DataFrame, schema: DataFrame, values: DataFrame, scores: DataFrame, confirmations: DataFrame, conflicts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """record_id, status, ready, coverage, reasons, review, resolved of each record (record_id, category, n_issues).

    schema: category, field, pos, weight, required. values: record_id, field, original, final. scores and confirmations: record_id, field, score, of
    which the highest counts. conflicts: record_id, field, verified (true where an independent check found it). A conflict of a field that was filled
    automatically is closed by a confirmation of at least `least`, unless the check itself found it. A value that stood in the original
    needs no score. review: essential fields to look at, in the schema's order; resolved: conflicts closed.

    All facts of a field are united and aggregated once by (record_id, field), then by record; a record has as many rows as facts.
    """
    text, number, flag = "cast(null as string)", "cast(null as double)", "cast(null as boolean)"
    expected = records.select("record_id", "category").join(F.broadcast(schema), "category")
    columns = ("pos", "weight", "required", "original", "final", "score", "confirmed", "disputed", "verified")
    empty = {"pos": "cast(null as long)", "weight": "cast(null as long)", "required": flag, "original": text, "final": text, "score": number, "confirmed": number, "disputed": "0L", "verified": "0L"}

    def facts(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select("record_id", "field", *(given[c].alias(c) if c in given else F.expr(empty[c]).alias(c) for c in columns))

    united = facts(expected, pos=F.col("pos").cast("long"), weight=F.col("weight").cast("long"), required=F.col("required"))
    for part in (
        facts(values, original=F.col("original"), final=F.col("final")), facts(scores, score=F.col("score").cast("double")), facts(confirmations, confirmed=F.col("score").cast("double")),
        facts(conflicts, disputed=(~F.col("verified")).cast("long"), verified=F.col("verified").cast("long")),
    ):
        united = united.unionByName(part)
    each = united.groupBy("record_id", "field").agg(
        F.max("pos").alias("pos"), F.max("weight").alias("weight"), F.max("required").alias("required"), F.max("original").alias("original"), F.max("final").alias("final"),
        F.max("score").alias("score"), F.max("confirmed").alias("confirmed"), F.sum("disputed").alias("disputed"), F.sum("verified").alias("verified"),
    )
    has, own = present(F.col("final")), present(F.col("original"))
    essential = F.coalesce(F.col("weight") == ESSENTIAL, F.lit(False))
    closed = ~own & F.coalesce(F.col("confirmed") >= least, F.lit(False))
    open_ = ((F.col("disputed") > 0) & ~closed) | (F.col("verified") > 0)
    automatic = essential & has & ~own
    unknown = automatic & F.col("score").isNull() & F.col("confirmed").isNull()
    low = automatic & ~unknown & (F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("confirmed", F.lit(0.0))) < least)
    known = F.col("weight").isNotNull()
    count = lambda c: F.count_if(c)
    summed = each.groupBy("record_id").agg(
        count(known & F.col("required") & ~has).alias("lacking"), count(essential & ~has).alias("absent"), count(unknown).alias("unknown"), count(low).alias("low"), count(open_).alias("open"),
        F.sum(F.when(known & has, F.col("weight")).otherwise(0)).alias("got"), F.sum(F.when(known, F.col("weight")).otherwise(0)).alias("of"),
        F.sum(F.when(closed & (F.col("disputed") > 0), F.col("disputed")).otherwise(0)).alias("resolved"),
        F.transform(F.array_sort(F.collect_list(F.when(essential & (~has | unknown | low | open_), F.struct("pos", "field")))), lambda x: x["field"]).alias("review"),
    )
    rows = records.select("record_id", F.coalesce("n_issues", F.lit(0)).alias("issues")).join(summed.hint("merge"), "record_id", "left").na.fill(0)
    coverage = F.when(F.col("of") > 0, F.round(F.col("got") / F.col("of"), 4)).otherwise(F.lit(0.0))
    held = (F.col("issues") > 0, F.col("lacking") > 0, F.col("absent") > 0, F.col("unknown") > 0, F.col("low") > 0, F.col("open") > 0, coverage < LEAST_COVERAGE)
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in zip(held, REASONS, strict=True))))
    none = F.array().cast("array<string>")
    bare = F.col("of") == 0
    status = F.when(bare, "SEM_SCHEMA").when((F.col("issues") > 0) | (F.col("lacking") > 0), "BLOQUEADO_POR_PAYLOAD").when(F.size(reasons) > 0, "PRECISA_REVISAO").otherwise("APROVADO")
    return rows.select(
        "record_id", status.alias("status"), (status == "APROVADO").alias("ready"), coverage.alias("coverage"), F.when(bare, F.array(F.lit("CATEGORIA_SEM_SCHEMA_TECNICO"))).otherwise(reasons).alias("reasons"),
        F.when(bare, none).otherwise(F.coalesce("review", none)).alias("review"), F.when(bare, 0).otherwise(F.col("resolved")).cast("long").alias("resolved"),
    )
