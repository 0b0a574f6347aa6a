"""What may be sent: values outside the contract leave, edits by hand go to known fields only, and what is left to review is listed.

Sheets are rows (record_id, category, field, value) of texts, with lists as JSON; root fields have plain names, specs
`sheet.field`. Null and blank values are missing. Repeated rows stay repeated unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import present

#: The longest optional root texts; bounds of a power supply's numbers, counts, texts and lists.
LONGEST = {"descricao": 5000, "mpn": 150, "gtin": 32, "imagemUrl": 500, "imagemHoverUrl": 500, "especificacaoFonte.certificacao": 100, "especificacaoFonte.padraoAtx": 50, "especificacaoFonte.tensaoEntrada": 100}
NUMBERS = {**dict.fromkeys(("comprimentoMm", "larguraMm", "alturaMm", "correnteLinha12vAmperes"), 1_000_000), "eficienciaPercentual": 100}
COUNTS = ("conectoresAtx24Pinos", "conectoresEpsCpu", "conectoresPcie6Pinos", "conectoresPcie8Pinos", "conectores12vhpwr", "conectores12v2x6", "conectoresSata", "conectoresMolex")
MODULAR = ("NAO_MODULAR", "SEMI_MODULAR", "MODULAR")
PSU_FORMATS = ("ATX", "SFX", "SFX_L", "TFX", "FLEX_ATX")
ROOT = {"nome": (2, 200), "marca": (1, 100), "modelo": (1, 150)}
CORE = {"MONITOR": ("tamanhoPolegadas", "resolucao", "taxaAtualizacaoHz", "tipoPainel"), "MOUSE": ("sensor", "dpiMaximo", "conexao"), "TECLADO": ("tipo", "layout", "conexao")}
OPTIONS = {"especificacaoFonte.formato": PSU_FORMATS, "especificacaoArmazenamento.chaveM2": ("M", "B", "B_M"), "especificacaoArmazenamento.interface": ("NVME_PCIE", "SATA")}
#: Fields that are yes or no, and parts of names of fields that hold whole and other numbers.
FLAGS = ("hdr", "adaptiveSync", "gSync", "freeSync", "bluetooth", "wireless", "cabo", "rgb", "abnt2", "usb", "hotSwap", "microfone", "cincoG", "nfc", "dualSim", "esim")
WHOLE_HINTS = ("Watts", "Mhz", "Hz", "Gb", "Mb", "Mm", "Nits", "Gramas", "Dpi", "Portas", "Slots", "Quantidade")
NUMBER_HINTS = ("Polegadas", "Ms", "Volts", "Amperes", "Percentual", "Kg", "Cm")
MEMORY_KINDS = ("DDR3", "DDR4", "DDR5")
MEMORY_SHEETS = {"PROCESSADOR": "especificacaoProcessador", "PLACA_MAE": "especificacaoPlacaMae"}
_PSU = "especificacaoFonte."


def _inside(value: Column, most: float, whole: bool = False) -> Column:
    n = value.try_cast("double")
    fits = (n >= 0) & (n <= most)
    return F.coalesce(fits & (n == F.floor(n)) if whole else fits, F.lit(False))


def protections(value: Column, longest: int = 80, most: int = 32) -> Column:
    """A JSON list of texts trimmed, without blank, long and repeated ones (case aside), the first `most`; null if none is left or it is no list."""
    items = F.transform(F.from_json(F.when(value.rlike(r"^\s*\["), value), "array<string>"), lambda x: F.trim(x))
    kept = F.filter(items, lambda x: x.isNotNull() & (x != "") & (F.length(x) <= longest))
    keys = F.transform(kept, F.lower)
    first = F.slice(F.filter(kept, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, most)
    return F.when(F.size(first) > 0, F.to_json(first))


def guard(sheet: DataFrame) -> DataFrame:
    """The sheet without optional values that the contract refuses; the list of protections is cleaned. Required ones stay, to be reviewed."""
    field, value = F.col("field"), F.col("value")
    psu = F.coalesce(F.col("category") == "FONTE", F.lit(False))
    fits = F.lit(True)
    for name, most in LONGEST.items():
        fits = F.when((field == name) & (F.lit(not name.startswith(_PSU)) | psu), F.length(value) <= most).otherwise(fits)
    bounds = [F.when(field == _PSU + n, _inside(value, m)) for n, m in NUMBERS.items()] + [F.when(field.isin(*(_PSU + c for c in COUNTS)), _inside(value, 128, whole=True)), F.when(field == _PSU + "modularidade", value.isin(*MODULAR))]
    made = F.when(psu & (field == _PSU + "protecoes"), protections(value)).otherwise(value)
    kept = sheet.where(value.isNull() | (fits & (~psu | F.coalesce(*bounds, F.lit(True)))))
    return kept.withColumn("_made", made).where(value.isNull() | F.col("_made").isNotNull()).withColumn("value", F.col("_made")).drop("_made")


def issues(category: Column, fields: Column) -> Column:
    """What keeps a record (fields: a map of texts) from being registered, in order, each issue once."""
    at = lambda name: F.try_element_at(fields, F.lit(name))
    when = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), F.lit(text))
    found = []
    for name, sheet in MEMORY_SHEETS.items():
        path = f"{sheet}.tiposMemoriaSuportados"
        kinds = F.from_json(F.when(at(path).rlike(r"^\s*\["), at(path)), "array<string>")
        here = category == name
        found += [when(here & at(path).isNull(), f"{path} ausente"), when(here & at(path).isNotNull() & kinds.isNull(), f"{path} deve ser array")]
        found.append(when(here & F.exists(kinds, lambda k: ~F.coalesce(k.isin(*MEMORY_KINDS), F.lit(False))), f"{path} contém valor inválido"))
    for name, (least, most) in ROOT.items():
        found.append(when(~F.coalesce(F.length(F.trim(at(name))).between(least, most), F.lit(False)), f"{name} ausente ou fora do formato aceito"))
    drive = "especificacaoArmazenamento."
    m2 = (category == "ARMAZENAMENTO") & (at(drive + "formato") == "M2")
    unsure = lambda good: ~F.coalesce(good, F.lit(False))
    found += [
        when(m2 & unsure(at(drive + "tamanhoM2Mm").isin("30", "42", "60", "80", "110")), drive + "tamanhoM2Mm não confirmado"), when(m2 & unsure(at(drive + "chaveM2").isin("B", "M", "B_M")), drive + "chaveM2 não confirmada"),
        when(m2 & unsure(at(drive + "interface").isin("SATA", "NVME_PCIE")), drive + "interface não confirmada"),
        when((category == "FONTE") & unsure(at(_PSU + "formato").isin(*PSU_FORMATS)), _PSU + "formato não confirmado"),
        when((category == "FONTE") & unsure((at(_PSU + "potenciaWatts").try_cast("double") >= 1) & _inside(at(_PSU + "potenciaWatts"), 100_000, whole=True)), _PSU + "potenciaWatts não confirmada"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def manual_edits(sheet: DataFrame, edits: DataFrame, allowed: DataFrame, most: int = 48, longest: int = 500, longest_description: int = 30000) -> DataFrame:
    """The sheet with edits by hand (record_id, pos, field, value) laid over it: of each record's first `most` by pos, those to allowed
    fields (category, field) with a value, trimmed and cut; of several to one field the last counts. Edits of records without a row are left out.

    An edit finds its category by the record; one window by record over the edits, equi-joins otherwise.
    """
    first = edits.withColumn("n", F.row_number().over(Window.partitionBy("record_id").orderBy("pos", "field", "value"))).where(F.col("n") <= most)
    of = sheet.groupBy("record_id").agg(F.max("category").alias("category"))
    name = F.trim("field")
    cut = F.when(name == "descricao", F.left(F.trim("value"), F.lit(longest_description))).otherwise(F.left(F.trim("value"), F.lit(longest)))
    made = first.where(present(F.trim("value"))).select("record_id", "n", name.alias("field"), cut.alias("edited")).join(of.hint("merge"), "record_id")
    made = made.join(allowed.select("category", "field").distinct(), ["category", "field"], "left_semi")
    last = made.groupBy("record_id", "category", "field").agg(F.max_by("edited", "n").alias("edited"))
    kept = sheet.join(last.select("record_id", "field").hint("merge"), ["record_id", "field"], "left_anti").select("record_id", "category", "field", "value")
    return kept.unionByName(last.select("record_id", "category", "field", F.col("edited").alias("value")))


def field_type(field: Column) -> Column:
    """The kind of input that a field takes, by its name."""
    name = F.regexp_extract(field, r"([^.]*)$", 1)
    hints = lambda words: name.rlike("(?i)" + "|".join(words))
    return (
        F.when(field == "descricao", "textarea").when(field == "especificacaoArmazenamento.tamanhoM2Mm", "integer").when(name.isin(*FLAGS), "boolean")
        .when(hints(WHOLE_HINTS), "integer").when(hints(NUMBER_HINTS), "number").otherwise("text")
    )


def review(records: DataFrame, sheet_of: dict[str, str]) -> DataFrame:
    """record_id, pos, field, type, options of what is left to fill in: root fields, then core specs of the category, then fields that `issues` names.

    records: record_id, category, fields (a map of texts); sheet_of: the sheet's name by category. A field stands once. One pass without a shuffle.
    """
    category, fields = F.col("category"), F.col("fields")
    lacks = lambda path: F.when(~F.coalesce(present(F.trim(F.try_element_at(fields, F.lit(path)))), F.lit(False)), F.lit(path))
    core = [F.when(category == c, lacks(f"{sheet_of[c]}.{f}")) for c, fs in CORE.items() if c in sheet_of for f in fs]
    named = F.transform(issues(category, fields), lambda i: F.regexp_extract(i, r"^([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)", 1))
    paths = F.array_distinct(F.filter(F.concat(F.array(*map(lacks, ROOT), *core), named), lambda x: x.isNotNull() & (x != "")))
    options = F.create_map(*(x for k, v in OPTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = records.select("record_id", F.posexplode(paths).alias("pos", "field"))
    return rows.select("record_id", "pos", "field", field_type(F.col("field")).alias("type"), F.try_element_at(options, F.col("field")).alias("options"))
