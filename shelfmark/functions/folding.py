"""Folding of free text into the closed vocabularies of product data: enums, lists, slots, sites, kinds of item.

Rules are ordered tables; each becomes one chain of conditions over a folded text, so nothing is joined. What no rule
covers is null, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Of each vocabulary, in order, the pattern over the folded token (words joined by _) and the value.
ENUMS: dict[str, tuple[tuple[str, str], ...]] = {
    "board_form": (("mini_itx|^itx$", "MINI_ITX"), ("micro_atx|microatx|^m_?atx$", "MICRO_ATX"), ("e_atx|eatx|extended_atx", "E_ATX"), ("^atx(_|$)", "ATX")),
    "psu_format": (("sfx_l|sfxl", "SFX_L"), ("^sfx(_|$)", "SFX"), ("flex_atx", "FLEX_ATX"), ("^tfx(_|$)", "TFX"), ("^atx(_|$)|_atx_", "ATX")),
    "case_size": (("full_tower", "FULL_TOWER"), ("mid_?tower", "MID_TOWER"), ("mini_?tower", "MINI_TOWER"), ("^(sff|small_form_factor)$", "SFF"), ("open_frame", "OPEN_FRAME")),
    "storage_type": (("ssd|solid_state|nvme", "SSD"), ("^hdd$|hard_disk|hard_drive|disco_rigido", "HDD")),
    "storage_format": (("m_2|^m2$|(^|_)22(30|42|60|80|110)(_|$)", "M2"), ("2_5", "POLEGADAS_2_5"), ("3_5", "POLEGADAS_3_5"), ("pcie.*(placa|add_in|aic)|(placa|add_in|aic).*pcie", "PLACA_PCIE")),
    "storage_interface": (("(^|_)nvme(_|$)", "NVME_PCIE"), ("^(?!.*(^|_)sata(_|$)).*((^|_)pcie?(_|$)|pci_?express)", "NVME_PCIE"), ("(^|_)sas(_|$)", "SAS"), ("(^|_)sata(_|$)", "SATA")),
    "modularity": (("^(nao|no|false)$|(^|_)(non|nao)_?modular(_|$)", "NAO_MODULAR"), ("semi_?modular", "SEMI_MODULAR"), ("^(modular|sim|yes|true)$|(^|_)(full|totalmente|completamente)_modular(_|$)", "MODULAR")),
    "cooler_type": (("^(air|cooler_a_ar)$|air_cooler|tower_cooler", "AIR_COOLER"), ("^(water|aio)$|water_cooler|liquid_cooler", "WATER_COOLER")),
    "fan_connector": (("4_pinos|4_pin|pwm", "PWM_4_PINOS"), ("3_pinos|3_pin", "DC_3_PINOS"), ("molex", "MOLEX"), ("propriet", "PROPRIETARIO")),
    "memory_form": (("so_?dimm", "SO_DIMM"), ("dimm", "DIMM")),
    "m2_key": (("(^|_)b_m(_|$)|^bm$|^b_(and|plus)_m$", "B_M"), ("^m$|(^|_)m_?key(_|$)|(^|_)(key|chave)(_m_?2)?_m(_|$)", "M"), ("^b$|(^|_)b_?key(_|$)|(^|_)(key|chave)(_m_?2)?_b(_|$)", "B")),
}

#: Hosts of stores, the platform and how it is integrated.
SITES = (
    ("mercadolivre.com.br", "MERCADO_LIVRE", "API_OFICIAL"), ("mercadolibre.com", "MERCADO_LIVRE", "API_OFICIAL"), ("kabum.com.br", "KABUM", "PAGINA_ESTRUTURADA"), ("pichau.com.br", "PICHAU", "PAGINA_ESTRUTURADA"),
    ("terabyteshop.com.br", "TERABYTE", "PAGINA_ESTRUTURADA"), ("amazon.com.br", "AMAZON", "PAGINA_ESTRUTURADA"), ("magazineluiza.com.br", "MAGALU", "EXTRATOR_ESPECIFICO"), ("magazinevoce.com.br", "MAGALU", "EXTRATOR_ESPECIFICO"),
    ("magalu.com", "MAGALU", "EXTRATOR_ESPECIFICO"), ("shopee.com.br", "SHOPEE", "API_OFICIAL"), ("aliexpress.com", "ALIEXPRESS", "PAGINA_ESTRUTURADA"),
)
OTHER_SITE = "OUTRO_SITE"

#: What the error text of a source says about it, in order.
OUTCOMES = (
    ("403|401|429|BLOQUEADO|CAPTCHA", "BLOQUEADO"), ("TIMEOUT|CONNECTION|HTTP_502|HTTP_503|HTTP_504", "FALHA_TEMPORARIA"), ("IDENTIDADE|DIVERGENTE", "MODELO_DIVERGENTE"),
    ("NAO_ENCONTRADO|404", "NAO_ENCONTRADO"), ("SEM_DADOS", "SEM_DADOS"),
)


def enum(name: str, c: Column) -> Column:
    """The value of the first rule of a vocabulary that fits."""
    return S.let(S.token(c), lambda t: F.coalesce(*(F.when(t.rlike(pattern), value) for pattern, value in ENUMS[name])))


def distinct(values: Column) -> Column:
    """The first of values that differ in case only, in order; nulls and blanks are left out; null if none is left."""
    return S.let(S.distinct_folded(values), lambda v: F.when(F.size(v) > 0, v))


def enum_list(name: str, c: Column, parts: str = "[,;/|]+") -> Column:
    """The values named in a list of texts parted by separators."""
    return distinct(F.transform(F.split(c, parts), lambda x: enum(name, x)))


def memory_types(c: Column) -> Column:
    return distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\bDDR\s*[-_ ]?([345])\b"), 1), lambda x: F.concat(F.lit("DDR"), x)))


def only(values: Column) -> Column:
    """The one value of a list; several are ambiguous."""
    return F.when(F.size(values) == 1, values[0])


def sockets(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?i)(?:FC)?LGA\s*\d{3,4}|AM[2345]|TR4|sTRX4|sTR5|sWRX8"), 0)
    return distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(F.regexp_replace(x, "(?i)^FC", ""), r"\s+", ""))))


def texts(c: Column) -> Column:
    return distinct(F.split(c, r"[,;|\n]+"))


def integers(c: Column) -> Column:
    return distinct(F.transform(F.split(c, r"[,;/|\s]+"), lambda x: S.integral(S.number(x)).cast("string")))


def frequencies(c: Column, least: int = 400, most: int = 20000) -> Column:
    """Memory clocks: numbers of three to five digits within bounds."""
    found = F.regexp_extract_all(c, F.lit(r"\b(\d{3,5})\b"), 1)
    return distinct(F.transform(F.filter(found, lambda x: x.cast("int").between(least, most)), lambda x: x.cast("int").cast("string")))


def m2_slots(c: Column, most: int = 16) -> Column:
    """A count of slots as that many structs with nothing known but their code; what is no small count is null."""
    n = F.regexp_extract(c, r"^\s*(\d{1,2})\s*$", 1).try_cast("int")
    none = F.array().cast("array<string>")
    slot = lambda i: F.struct(F.concat(F.lit("M2_"), i).alias("code"), none.alias("interfaces"), none.alias("keys"), none.alias("lengths_mm"))
    return F.when(n == 0, F.array().cast("array<struct<code:string,interfaces:array<string>,keys:array<string>,lengths_mm:array<string>>>")).when(n.between(1, most), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), slot))


def site(url: Column) -> Column:
    """Struct (platform, host, mode) of a URL."""
    def fit(h):
        rules = [F.when((h == domain) | h.endswith("." + domain), F.struct(F.lit(name).alias("platform"), h.alias("host"), F.lit(mode).alias("mode"))) for domain, name, mode in SITES]
        return F.coalesce(*rules, F.struct(F.lit(OTHER_SITE).alias("platform"), h.alias("host"), F.lit("PAGINA_ESTRUTURADA").alias("mode")))

    return S.let(F.lower(F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), lambda h: fit(S.blank_to_null(h)))


def shopee_ids(url: Column) -> Column:
    """Struct (shop, item) from one of the three forms of a link; nulls for other stores."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    forms = (r"(?i)/product/(\d+)/(\d+)(?:/|$)", r"(?i)(?:^|[-/])i\.(\d+)\.(\d+)(?:[/?#.-]|$)", r"/(\d+)/(\d+)(?:/|$)")
    part = lambda i: F.when(site(url).platform == "SHOPEE", F.coalesce(*(S.blank_to_null(F.regexp_extract(path, f, i)) for f in forms)).cast("long"))
    return F.struct(part(1).alias("shop"), part(2).alias("item"))


def mercadolivre_item(url: Column) -> Column:
    """The item id named in the query or fragment, else in the path; a shared catalogue page (/p/MLB...) has none."""
    h = S.host(url)
    ours = F.lit(False)
    for domain in ("mercadolivre.com.br", "mercadolivre.com", "mercadolibre.com"):
        ours = ours | (h == domain) | h.endswith("." + domain)
    path, rest = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), F.try_url_decode(F.regexp_extract(url, r"([?#].*)$", 1))
    told = F.coalesce(*(S.blank_to_null(F.regexp_extract(rest, p, 1)) for p in (r"(?i)[?&#](?:item_id|wid)=[^&#]*?\bMLB-?(\d{6,})\b", r"(?i)[?&#]pdp_filters=[^&#]*?item_id\s*:\s*MLB-?(\d{6,})\b")))
    own = F.when(~path.rlike(r"(?i)/p/MLB\d+"), S.blank_to_null(F.regexp_extract(path, r"(?i)/MLB-?(\d{6,})(?:[-/]|$)", 1)))
    return F.when(ours, F.concat(F.lit("MLB"), F.coalesce(told, own)))


def outcome(ok: Column, has_data: Column, error: Column) -> Column:
    """What became of a source: collected, or a diagnosis from its error text."""
    e = F.upper(F.coalesce(error, F.lit("")))
    return F.when(ok & has_data, "COLETADO").when(ok, "SEM_DADOS").otherwise(F.coalesce(*(F.when(e.rlike(p), v) for p, v in OUTCOMES), F.lit("ERRO_COLETA")))
