"""Which researched values can be trusted: their origin, the variant they speak of, cached ones, and claims that must stand in collected passages.

Rows are (record_id, field, ...). Nothing is dropped unseen: refused rows carry a reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import cross
from .resolve import present, source_confidence, value_key

#: Fields that a graphics chip decides, and those that a notebook's or phone's configuration decides.
CHIP_FIELDS = ("gpu", "chipset", "arquitetura", "memoriaVideoGb", "tipoMemoriaVideo", "barramentoBits", "geracaoPcie", "larguraPcie")
CONFIGURED = {
    "NOTEBOOK": ("processadorNome", "processadorMarca", "processadorGeracao", "nucleos", "threads", "clockBaseMhz", "clockTurboMhz", "tdpWatts", "gpuNome", "gpuIntegrada", "gpuDedicada", "vramGb", "tgpWatts", "ramInstaladaGb", "ramSoldadaGb", "armazenamentoGb", "sistemaOperacional"),
    "CELULAR": ("ramGb", "armazenamentoGb", "cor"),
}
#: Specs without which a captured record is not registered, and words that stand for none.
LEAST_SPECS = {
    "PROCESSADOR": ("socket", "nucleos"), "PLACA_MAE": ("socket", "chipset"), "MEMORIA_RAM": ("tipo", "capacidadePorModuloGb"), "PLACA_VIDEO": ("gpu", "memoriaVideoGb"), "ARMAZENAMENTO": ("tipo", "capacidadeGb"),
    "FONTE": ("formato", "potenciaWatts"), "GABINETE": ("tamanho",), "COOLER": ("tipo",), "VENTOINHA": ("tamanhoMm",),
}
UNKNOWN_WORDS = ("n/a", "não informado", "nao informado", "desconhecido", "unknown")
#: Attribute names that are no metadata, and those that are reserved.
NO_METADATA = r"(?i)pre[cç]o|price|frete|shipping|vendedor|seller|loja|store|garantia|warranty|pagamento|payment|parcel|avalia[cç]|rating|estoque|stock|disponibilidade|descri[cç]|description|hist[oó]ria|history|^url$"
RESERVED = ("__proto__", "constructor", "prototype", "nome", "name", "marca", "brand", "modelo", "model", "mpn", "gtin", "ean")


def suffixes(host: Column) -> Column:
    """A host and the domains it is under."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def trusted(claims: DataFrame, domains: DataFrame) -> DataFrame:
    """claims (claim_id, source, url, passage, method, confirmed, ...) with trusted: a passage, a method that extracts it or a
    confirmation, and an http(s) URL without credentials whose host is under one of the source's domains (source, domain).

    An equi-join of (source, domain suffix); a claim has as many suffixes as its host has labels. Null and repeated claims
    are judged like others; claim_id must tell rows apart.
    """
    fine = present(F.col("passage")) & ((F.col("method") == "EXTRACAO_DETERMINISTICA") | F.col("confirmed")) & F.col("url").rlike(r"(?i)^https?://[^/?#@]+(?:[/?#]|$)")
    asked = claims.where(F.coalesce(fine, F.lit(False))).select("claim_id", F.upper("source").alias("source"), F.explode(suffixes(S.host(F.col("url")))).alias("domain"))
    known = domains.select(F.upper("source").alias("source"), F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain")).distinct()
    good = asked.join(known, ["source", "domain"], "left_semi").select("claim_id").distinct().withColumn("trusted", F.lit(True))
    return claims.join(good.hint("merge"), "claim_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def specific_for(category: Column, method: Column, model: Column) -> Column:
    """Whether an identity names one product for its category: by code always; boards need more than a chipset, memory, storage and power supplies a code beside measures."""
    rest = F.regexp_replace(F.coalesce(model, F.lit("")), r"(?i)\bDDR[345]\b|\b\d+(?:[.,]\d+)?\s*(?:GB|TB|W|MHz|MT/s)\b", "")
    coded = rest.rlike(r"[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z][-_/][A-Za-z0-9]")
    return F.when(method.isin("GTIN", "MARCA_MPN"), True).when(category == "PLACA_MAE", ~F.coalesce(model, F.lit("")).rlike(r"(?i)^[ABHXZ]\d{3}[ME]?$")).when(category.isin("MEMORIA_RAM", "ARMAZENAMENTO", "FONTE"), coded).otherwise(True)


def refusal(category: Column, scope: Column, method: Column, field: Column, conflicting: Column, is_trusted: Column) -> Column:
    """Why a researched value is not taken: the chip says nothing of this field of the card; a conflict, a configuration or an origin that is not confirmed. Null: taken."""
    chip = (scope == "CHIP_GRAFICO") & ~field.isin(*CHIP_FIELDS)
    configured = F.lit(False)
    for name, fields in CONFIGURED.items():
        configured = configured | ((category == name) & (method == "MARCA_MODELO") & field.isin(*fields))
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(no(chip), "VARIANTE_DA_PLACA_NAO_CONFIRMADA").when(no(configured) | no(conflicting) | ~no(is_trusted), "CONFLITO_OU_EVIDENCIA_NAO_CONFIRMADA")


def intake(before: DataFrame, proposed: DataFrame) -> DataFrame:
    """record_id, field, value, reason of the proposed values of fields that are empty before; reason null: taken.

    before: record_id, category, scope, method, field, value (null if empty). proposed: record_id, field, value, conflicting,
    trusted. Proposals for filled fields and blank ones give no row. One equi-join on (record_id, field).
    """
    rows = before.where(~present(F.col("value"))).select("record_id", "category", "scope", "method", "field").join(proposed.where(present(F.col("value"))).hint("merge"), ["record_id", "field"])
    return rows.select("record_id", "field", "value", refusal(F.col("category"), F.col("scope"), F.col("method"), F.col("field"), F.col("conflicting"), F.col("trusted")).alias("reason"))


def reusable(cached: DataFrame, least: float = 0.80) -> DataFrame:
    """cached (record_id, field, value, score, source, conflicting) of present values with reason why it is not used again, else null."""
    reason = F.when(F.coalesce("conflicting", F.lit(False)), "CONFLITO_NAO_RESOLVIDO").when(F.col("score").isNull() | ~present(F.trim("source")), "SEM_PROVENIENCIA").when(F.col("score") < least, "CONFIANCA_ABAIXO_DO_LIMIAR")
    return cached.where(present(F.col("value"))).withColumn("reason", reason)


def cache_conflicts(conflicts: DataFrame, current: DataFrame) -> DataFrame:
    """conflicts (record_id, field, pos, value, source) with resolved: a cached value gives way to one of a more trusted source.

    current: record_id, field, source, cached (the value came from the cache, and the record had none of its own). In the order of pos a
    value counts if its source is trusted more than the cached one and all that counted before: more than the largest before it.
    """
    rows = conflicts.join(current.select("record_id", "field", F.col("source").alias("had"), "cached").hint("merge"), ["record_id", "field"], "left")
    fit = F.coalesce("cached", F.lit(False)) & present(F.col("value"))
    rows = rows.withColumn("score", F.when(fit, source_confidence(F.col("source"))))
    before = F.max("score").over(Window.partitionBy("record_id", "field").orderBy("pos", "source", "value").rowsBetween(Window.unboundedPreceding, -1))
    bar = F.greatest(before, source_confidence(F.coalesce("had", F.lit(""))))
    return rows.withColumn("resolved", F.coalesce(F.col("score") > bar, F.lit(False))).select(*conflicts.columns, "resolved")


def resolved_values(conflicts: DataFrame) -> DataFrame:
    """record_id, field, value, source of the last resolved row of `cache_conflicts`: what replaces the cached value."""
    last = conflicts.where("resolved").groupBy("record_id", "field").agg(F.max_by(F.struct("value", "source"), "pos").alias("w"))
    return last.select("record_id", "field", "w.*")


def named_value(field: Column, passage: Column) -> Column:
    """What a passage of the form `Field: value` says of a field."""
    parts = r"^\s*([^:]{1,80}?)\s*:\s*(.+?)\s*$"
    return F.when(S.token(F.regexp_extract(passage, parts, 1)) == S.token(field), S.clean(F.regexp_extract(passage, parts, 2)))


def grounded(claims: DataFrame, passages: DataFrame, read: Callable[[Column, Column], Column] = named_value, longest: int = 1200) -> DataFrame:
    """claims (claim_id, field, value, url, passage) with grounded: the claimed passage stands in a passage (url, line) collected from
    its URL, whatever the case and white space, and the value read from it is the claimed one.

    Claims whose own passage doesn't give the value, or is blank or longer than `longest`, are refused first. A passage of three words
    and more meets the lines that hold the rarest run of its inner words (the outer ones may be parts of words there), so the claims of an
    address with many passages are not laid beside all of them; only shorter passages are. Lines travel as hashes until they have met a claim.
    """
    told = read(F.col("field"), F.col("passage"))
    fine = present(F.trim("passage")) & (F.length(F.trim("passage")) <= longest) & (value_key(told) == value_key(F.col("value")))
    asked = claims.where(F.coalesce(fine, F.lit(False))).select("claim_id", "url", value_key(F.col("passage")).alias("p"))
    words = F.split("p", " ")
    asked = asked.withColumn("inner", F.when(F.size(words) >= 3, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")))
    seen = passages.where("line is not null").select("url", value_key(F.col("line")).alias("l")).distinct().withColumn("h", F.xxhash64("l"))
    runs = cross.rarest_run(asked, "inner", "url")
    met = seen.select("url", "h", F.explode(cross.word_runs(F.split("l", " "))).alias("run")).join(runs, ["url", "run"]).select("url", "inner", "h").distinct()
    long = asked.join(met, ["url", "inner"]).join(seen, ["url", "h"])
    short = asked.where("inner is null").join(seen, "url")
    good = long.select("claim_id", "p", "l").union(short.select("claim_id", "p", "l")).where(F.contains("l", "p")).select("claim_id").distinct().withColumn("grounded", F.lit(True))
    return claims.join(good.hint("merge"), "claim_id", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def least_specs_missing(category: Column, specs: Column) -> Column:
    """The specs (a map) that a captured record of the category lacks, in order."""
    def lacks(field: str) -> Column:
        value = F.coalesce(F.try_element_at(specs, F.lit(field)), F.lit(""))
        return F.when((value == "") | F.lower(F.trim(value)).isin(*UNKNOWN_WORDS), F.lit(field))

    none = F.array().cast("array<string>")
    by_category = [F.when(category == name, F.filter(F.array(*map(lacks, fields)), lambda x: x.isNotNull())) for name, fields in LEAST_SPECS.items()]
    return F.coalesce(*by_category, none)


def metadata_name(name: Column, value: Column) -> Column:
    """Whether an attribute is kept as metadata: both short enough and present, no commercial or reserved name."""
    fit = present(name) & present(value) & (F.length(name) <= 80) & (F.length(value) <= 180)
    return F.coalesce(fit & ~name.rlike(NO_METADATA) & ~F.lower(name).isin(*RESERVED), F.lit(False))


def should_enrich(method: Column, missing: Column) -> Column:
    """Whether research pays: a strong identity, and a field (array) that is missing."""
    return F.coalesce(method.isin("GTIN", "MARCA_MPN", "MARCA_MODELO") & (F.size(missing) > 0), F.lit(False))
