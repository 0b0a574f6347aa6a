"""Which product a name or a page speaks of, whether an offer sells the identical one, and what parts a listing names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent, scalars as S
from .listings import of_variant, variant

#: Words that name a maker of graphics chips, words of a category that are no model, words that tell no model apart, variants.
CHIP_MAKERS = (("geforce", "NVIDIA"), ("quadro", "NVIDIA"), ("tesla", "NVIDIA"), ("nvidia", "NVIDIA"), ("radeon", "AMD"), ("firepro", "AMD"), ("amd", "AMD"), ("intel arc", "Intel"), ("arc ", "Intel"))
NOISE = {
    "PROCESSADOR": ("processor", "processador", "cpu"), "PLACA_VIDEO": ("graphics card", "video card", "placa de video", "gpu"), "PLACA_MAE": ("motherboard", "placa mae"), "MEMORIA_RAM": ("memory", "memoria ram", "ram"),
    "ARMAZENAMENTO": ("ssd", "nvme", "storage"), "FONTE": ("power supply", "psu", "fonte"), "GABINETE": ("pc case", "case", "gabinete"), "COOLER": ("cpu cooler", "cooler"), "VENTOINHA": ("pc fan", "fan", "ventoinha"),
}
PAGE_WORDS = ("specifications", "specs", "review")
NO_IDENTITY = ("spec", "specs", "rebrand", "series", "serie", "kit", "of", "the", "memory", "ram", "graphics", "card", "gpu", "processor", "cpu", "desktop", "notebook", "gaming", "gamer")
TOLD_VARIANTS = ("wifi", "oc", "ti", "super", "xt", "xtx")
RYZEN = r"(?i)\b(Ryzen\s+(?:[3579]\s+)?(?:PRO\s+)?\d{4,5}[A-Z0-9]*)\b"
CORE = r"(?i)\b((?:Core\s+)?(?:i[3579][ -]+\d{4,5}[A-Z]*|Core\s+Ultra\s+[579]\s+\d{3}[A-Z]*))\b"
CHIP = r"(?i)\b((?:GeForce\s+)?(?:RTX|GTX)\s+\d{3,4}(?:\s+(?:Ti|SUPER))?\b|(?:Radeon\s+)?RX\s+\d{3,4}(?:\s+(?:XT|XTX))?\b|Arc\s+[AB]\d{3}\b)"
#: Chipsets of boards.
CHIPSETS = (
    "a320", "b350", "x370", "b450", "x470", "a520", "b550", "x570", "a620", "b650", "x670", "b840", "b850", "x870",
    "h410", "b460", "h470", "z490", "h510", "b560", "h570", "z590", "h610", "b660", "h670", "z690", "h710", "b760", "h770", "z790", "h810", "b860", "z890",
)
#: Categories of parts in order, and the words that name them; words of kits, of computers, of what is missing, and of doubt.
PARTS = (
    ("PROCESSADOR", r"(?i)\b(?:processador|cpu|ryzen\s*[3579]|core\s*i[3579]|intel\s+core|xeon)\b"),
    ("PLACA_MAE", r"(?iU)\b(?:placa[ -]?m[aã]e|motherboard|(?:" + "|".join(CHIPSETS) + r")\w*)\b"),
    ("MEMORIA_RAM", r"(?iU)\b(?:mem[oó]ria(?:\s*ram)?|ram|ddr[345])\b"), ("PLACA_VIDEO", r"(?iU)\b(?:placa\s*de\s*v[ií]deo|gpu|geforce|radeon\s*(?:rx)?|(?:rtx|gtx|rx)\s*\d{3,4}(?:\s*(?:ti|super|xt|xtx))?)\b"),
    ("ARMAZENAMENTO", r"(?iU)\b(?:ssd|hdd|hd\s+\d|disco\s*r[ií]gido|armazenamento|nvme)\b"), ("FONTE", r"(?iU)\bfonte\b|\bpsu\b"), ("GABINETE", r"(?i)\b(?:gabinete|chassi\s*(?:atx|gamer))\b"),
    ("COOLER", r"(?i)\b(?:water\s*cooler|air\s*cooler|cooler\s*(?:para\s*cpu|processador))\b"), ("VENTOINHA", r"(?i)\b(?:ventoinha|fans?\s*(?:rgb|argb|\d{2,3}\s*mm))\b"),
)
PART_BREAK = r"(?iU)[\n;|]+|,\s*(?=(?:processador|cpu|placa[ -]?m[aã]e|mem[oó]ria|ram|placa\s*de\s*v[ií]deo|gpu|ssd|hdd|armazenamento|fonte|gabinete|cooler|water\s*cooler|ventoinha)\b)"
KIT = r"(?iU)\b(?:kit\s*(?:de\s*)?(?:upgrade|atualiza[cç][aã]o|processador|placa[ -]?m[aã]e)|combo\s*(?:upgrade|processador))\b"
COMPUTER = r"(?i)\b(?:pc\s+computador|computador\s*(?:completo|gamer|montado)?|pc\s*(?:montado|completo|gamer)|desktop\s*(?:completo|gamer|montado)?|setup\s*completo)\b"
WHOLE = r"(?i)\b(?:computador|pc|desktop)\s+(?:completo|montado|gamer)\b"
WITHOUT = r"(?iU)\b(?:sem\s*gabinete|n[aã]o\s*(?:inclui|acompanha)\s*(?:gabinete|fonte)|somente\s*(?:placa[ -]?m[aã]e|processador))\b"


def literal(c: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(c, r"([^\p{L}\p{N} ])", r"\\$1")


def inferred(name: Column, category: Column, brand: Column, brands: list[str]) -> Column:
    """Struct (brand, model, key) of a name: the given brand, of graphics cards the chip's maker, else the longest known brand it names;
    the model is the rest without words of its category; key where it has a digit. brands: a bounded list of the caller."""
    head = F.trim(F.regexp_replace(F.get(F.split(S.clean(name), r"\s+[|–—]\s+"), F.lit(0)), r"(?i)\s+-\s+(?:Specs?|Specifications?)\b.*$", ""))

    def read(t: Column) -> Column:
        low = F.lower(t)
        maker = F.coalesce(*(F.when((category == "PLACA_VIDEO") & F.contains(low, F.lit(w)), F.lit(b)) for w, b in CHIP_MAKERS))
        known = F.coalesce(*(F.when(F.regexp_like(low, F.concat(F.lit(r"\b"), literal(F.lit(b.lower())), F.lit(r"\b"))), F.lit(b)) for b in sorted(brands, key=lambda b: (-len(b), b))), F.lit(None).cast("string"))

        def model(b: Column) -> Column:
            rest = F.coalesce(F.regexp_replace(t, F.concat(F.lit(r"(?i)^\s*"), literal(b), F.lit(r"\s+")), F.lit("")), t)
            for c, words in NOISE.items():
                rest = F.when(category == c, F.regexp_replace(rest, rf"(?i)\b(?:{'|'.join((*words, *PAGE_WORDS))})\b", " ")).otherwise(rest)
            m = F.coalesce(S.blank_to_null(F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^[ \-|–—]+|[ \-|–—]+$", "")), t)
            return S.let(m, lambda m: F.struct(b.alias("brand"), m.alias("model"), F.when(b.isNotNull() & m.rlike(r"\d"), F.concat_ws("|", S.key(b), S.key(m))).alias("key")))

        return S.let(F.coalesce(S.clean(brand), maker, known), model)

    return S.let(head, read)


def research_identity(category: Column, name: Column, brand: Column) -> Column:
    """Struct (brand, model, scope) that a processor's or graphics chip's name gives; null for others. A chip names no card of its own."""
    ryzen, core, chip = (S.blank_to_null(F.regexp_extract(name, p, 1)) for p in (RYZEN, CORE, CHIP))
    made = lambda b, m, scope: F.struct(F.coalesce(S.clean(brand), b).alias("brand"), m.alias("model"), F.lit(scope).alias("scope"))
    maker = F.when(name.rlike(r"(?i)\bRX\s*\d{3,4}"), "AMD").when(name.rlike(r"(?i)\b(?:RTX|GTX)\s*\d{3,4}"), "NVIDIA")
    cpu, gpu = category == "PROCESSADOR", category == "PLACA_VIDEO"
    intel = F.when(F.lower(core).startswith("core"), core).otherwise(F.concat(F.lit("Core "), core))
    of_chip = F.upper(F.coalesce(S.clean(brand), maker)).isin("AMD", "NVIDIA", "INTEL")
    return F.when(cpu & ryzen.isNotNull(), made(F.lit("AMD"), ryzen, "MODELO_EXATO")).when(cpu & core.isNotNull(), made(F.lit("Intel"), intel, "MODELO_EXATO")).when(gpu & of_chip & chip.isNotNull(), made(maker, chip, "CHIP_GRAFICO"))


def code_in(code: Column, text: Column) -> Column:
    """Whether a text holds a whole code, whatever the punctuation between its parts, but no longer code."""
    parts = F.regexp_extract_all(F.lower(code), F.lit("[a-z0-9]+"), 0)
    pattern = F.concat(F.lit("(?<![a-z0-9])"), F.array_join(parts, r"[\s_./-]*"), F.lit("(?![a-z0-9])"))
    return F.coalesce((F.size(parts) > 0) & F.regexp_like(F.lower(text), pattern), F.lit(False))


def text_names(method: Column, brand: Column, model: Column, mpn: Column, gtin: Column, text: Column) -> Column:
    """Whether a text names an identity: its GTIN; its brand with its part number; its brand with its model, whole or all of its telling words, one of them strong."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    telling = F.filter(words(model), lambda w: ~w.isin(*NO_IDENTITY) & (F.length(w) >= 2) & ~F.coalesce(w.try_cast("int") <= 8, F.lit(False)))
    strong = F.filter(telling, lambda w: w.rlike(r"\d") | (F.length(w) >= 5))
    all_told = (F.size(telling) > 0) & (F.size(F.array_except(telling, words(text))) == 0) & (F.size(F.array_intersect(strong, words(text))) > 0)
    branded = S.key(brand).isNull() | F.contains(F.coalesce(S.key(text), F.lit("")), S.key(brand))
    by_gtin = F.regexp_like(text, F.concat(F.lit(r"(?<!\d)"), gtin, F.lit(r"(?!\d)")))
    fits = F.when(method == "GTIN", by_gtin).when(method == "MARCA_MPN", branded & code_in(mpn, text)).when(method == "MARCA_MODELO", branded & (code_in(model, text) | all_told))
    return F.coalesce(fits, F.lit(False))


def _kit(c: Column) -> Column:
    found = r"(?i)(?:kit\s+(?:of\s+)?(\d+)|(\d+)\s*[x×]\s*\d+\s*gb)"
    return F.coalesce(S.blank_to_null(F.regexp_extract(c, found, 1)), S.blank_to_null(F.regexp_extract(c, found, 2)))


def page_fits(wanted: Column, page: Column, text: Column) -> Column:
    """Whether a page (struct brand, title, model, mpn, gtin) is of the wanted identity (struct method, brand, model, mpn, gtin): no other code; the
    same code if both have one; the same size of kit and variants in the title; then what its heading or, without a model's title, its text names."""
    same = lambda f: S.key(wanted[f]) == S.key(page[f])
    words = lambda c: F.regexp_extract_all(F.regexp_replace(F.lower(c), "wi[ -]?fi", "wifi"), F.lit("[a-z0-9]+"), 0)
    title = F.coalesce(S.clean(page["title"]), S.clean(page["model"]))
    kit_fits = _kit(wanted["model"]).isNull() | F.coalesce(_kit(wanted["model"]) == _kit(title), F.lit(False))
    variants = F.array(*map(F.lit, TOLD_VARIANTS))
    variant_fits = F.array_sort(F.array_intersect(variants, words(title))) == F.array_sort(F.array_intersect(variants, words(wanted["model"])))
    named = lambda t: text_names(wanted["method"], wanted["brand"], wanted["model"], wanted["mpn"], wanted["gtin"], t)
    heading = F.concat_ws(" ", *(page[f] for f in ("brand", "title", "model", "mpn", "gtin")))
    by_title = F.when(S.key(wanted["mpn"]).isNotNull() & S.key(page["mpn"]).isNotNull(), True).when(S.key(wanted["gtin"]).isNotNull() & S.key(page["gtin"]).isNotNull(), True)
    by_title = by_title.when(S.clean(wanted["model"]).isNotNull() & ~F.coalesce(kit_fits & variant_fits, F.lit(False)), False).when(wanted["method"] == "MARCA_MODELO", named(heading)).otherwise(named(text))
    contradicts = F.coalesce(~same("mpn"), F.lit(False)) | F.coalesce(~same("gtin"), F.lit(False))
    return ~contradicts & F.when(title.isNotNull(), by_title).otherwise(named(text))


def _title_words(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+|[0-9]+"), 0), " ")


def sought(wanted: Column) -> Column:
    """What `identical` looks for of a wanted product (struct name, brand, model, mpn, gtin): all that needs no offer, worked out once a product."""
    run = lambda f, least: F.when(F.length(S.key(wanted[f])) >= least, S.blank_to_null(_title_words(wanted[f])))
    return F.struct(
        wanted["name"].alias("name"), S.digits(wanted["gtin"]).alias("gtin"), S.key(wanted["mpn"]).alias("mpn"), S.key(wanted["model"]).alias("model"), S.key(wanted["brand"]).alias("brand"), run("mpn", 5).alias("mpn_run"),
        run("model", 4).alias("model_run"), S.let(intent.search_text(wanted["name"]), intent.kind).alias("kind"), variant(F.concat_ws(" ", wanted["name"], wanted["model"])).alias("variant"),
    )


def sells(w: Column, offer: Column) -> Column:
    """By what an offer (struct title, brand, model, mpn, gtin) sells the wanted product (`sought`); null if it may be another.

    Another kind of item or another GTIN or part number never fits. Then GTIN, part number and brand, and, with the same variant, the
    title's GTIN, its part number or model as a run of words with the brand. A title that is the wanted name is of its kind.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    title = F.coalesce(offer["title"], F.lit(""))
    run_of = lambda run: S.let(run, lambda r: no(F.contains(F.concat(F.lit(" "), _title_words(title), F.lit(" ")), F.concat(F.lit(" "), r, F.lit(" ")))))

    def judge(x: Column) -> Column:
        in_title = no(F.contains(F.coalesce(S.key(title), F.lit("")), w["brand"]))
        branded = w["brand"].isNull() | no(S.key(offer["brand"]) == w["brand"]) | in_title
        by_code = F.when(no(w["gtin"] == x.gtin), "GTIN").when(no(w["mpn"] == x.mpn) & branded, "MPN_MARCA")
        by_title = F.when((F.length(w["gtin"]) >= 8) & F.contains(title, w["gtin"]) & F.regexp_like(title, F.concat(F.lit(r"(?<!\d)"), w["gtin"], F.lit(r"(?!\d)"))), "GTIN_TITULO").when((w["brand"].isNull() | in_title) & run_of(w["mpn_run"]), "MPN_MARCA_TITULO")
        by_model = F.when(no(F.length(w["model"]) >= 4) & branded & (no(x.model == w["model"]) | run_of(w["model_run"])), "MARCA_MODELO")
        fits = ~no(w["model"] != x.model) & of_variant(w["variant"], title)
        return F.when(~no(w["gtin"] != x.gtin) & ~no(w["mpn"] != x.mpn), F.coalesce(by_code, S.let(F.coalesce(by_title, by_model), lambda by: F.when(by.isNotNull() & fits, by))))

    read = F.struct(S.digits(offer["gtin"]).alias("gtin"), S.key(offer["mpn"]).alias("mpn"), S.key(offer["model"]).alias("model"))
    alike = no(w["name"] == title) | S.let(intent.search_text(title), lambda t: intent.of_kind(w["kind"], t))
    return S.let(S.let(read, judge), lambda by: F.when(by.isNotNull() & alike, by))


def identical(wanted: Column, offer: Column) -> Column:
    """By what an offer sells the wanted product (struct name, brand, model, mpn, gtin), as `sells` tells it."""
    return S.let(sought(wanted), lambda w: sells(w, offer))


def parts_named(listings: DataFrame, most: int = 6, longest: int = 350) -> DataFrame:
    """record_id, category, passages of the parts that listings (record_id, title, description) name: the description's passages first, then the title's, each once, the first `most`.

    One pass: the texts are cut into passages inside a row, and of each category the fitting ones are kept.
    """
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), PART_BREAK), lambda p: F.regexp_replace(p, r"^[ :\n;\-|]+|[ :\n;\-|]+$", "")), lambda p: p != "")
    found = lambda source, pattern: F.slice(F.array_distinct(F.transform(F.filter(F.col(source), lambda p: p.rlike(pattern)), lambda p: F.left(p, F.lit(longest)))), 1, most)
    rows = listings.select("record_id", cut("description").alias("d"), cut("title").alias("t"))
    kinds = F.array(*(F.struct(F.lit(name).alias("category"), F.array_distinct(F.concat(found("d", p), found("t", p))).alias("passages")) for name, p in PARTS))
    return rows.select("record_id", F.inline(F.filter(kinds, lambda k: F.size(k.passages) > 0)))


def listing_type(title: Column, description: Column, categories: Column) -> Column:
    """KIT_UPGRADE, PC_MONTADO, HARDWARE_INDIVIDUAL or INDEFINIDO, by what a listing says and the categories (array) of its parts."""
    text = F.concat_ws("\n", title, description)
    has = lambda *names: F.size(F.array_intersect(categories, F.array(*map(F.lit, names)))) == len(names)
    boxed = F.arrays_overlap(categories, F.array(F.lit("GABINETE"), F.lit("FONTE")))
    computer = text.rlike(COMPUTER) & ((F.size(categories) >= 2) | text.rlike(WHOLE)) & ~text.rlike(WITHOUT)
    kit = has("PROCESSADOR", "PLACA_MAE") & (F.size(categories) >= 3) & ~boxed
    return F.when(text.rlike(KIT), "KIT_UPGRADE").when(computer, "PC_MONTADO").when(kit, "KIT_UPGRADE").when(has("PROCESSADOR", "PLACA_MAE", "GABINETE", "FONTE"), "PC_MONTADO").when(F.size(categories) <= 1, "HARDWARE_INDIVIDUAL").otherwise("INDEFINIDO")


def source_order(asked: DataFrame, hints: DataFrame, base: DataFrame, first: str = "FABRICANTE_OFICIAL", last: str = "PC_KOMBO") -> DataFrame:
    """record_id, pos, source: the sources to ask for a record's missing fields (record_id, category, field): `first`, those that hints
    (category, field, pos, source) name by pos, then the category's base (category, pos, source); each once, `last` at the end if the base has it.

    Two equi-joins and one aggregation by (record, source); a record has as many rows as there are sources.
    """
    records = asked.select("record_id", "category").distinct()
    by_hint = asked.join(hints, ["category", "field"]).where(F.col("source") != last).select("record_id", "source", F.lit(1).alias("tier"), "pos")
    by_base = records.join(base, "category").select("record_id", "source", F.when(F.col("source") == last, 3).otherwise(2).alias("tier"), "pos")
    all_ = by_hint.union(by_base).union(records.select("record_id", F.lit(first), F.lit(0), F.lit(0)))
    best = all_.groupBy("record_id", "source").agg(F.min(F.struct("tier", "pos")).alias("at"))
    return best.select("record_id", "source", F.row_number().over(Window.partitionBy("record_id").orderBy("at", "source")).alias("pos"))
