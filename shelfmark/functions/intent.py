"""Whether a listing sells the item that a search means: its category, its kind (an accessory or the item itself), its words and its graphics model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import categories
from . import scalars as S

#: Words that name accessories and main items, words that a title may lack, and suffixes of graphics models.
ACCESSORY = r"\b(adaptador|suporte|cabo|capa|pelicula|carcaca|waterblock|backplate|cooler|ventoinha|dissipador|fan|carregador|estojo|almofadas?|espumas?|earpads?|bolsa|protetor|parafuso|bracket|riser|extensor|teclado|mouse|refil|recarga|pecas?|reposicao|reparo|conector|bateria|fonte|placa\s+logica|kit\s+(?:de\s+)?upgrade)\b"
MAIN = r"placa\s+(?:de\s+video|mae)|processador|memoria(?:\s+ram)?|notebook|computador|pc\s+gamer|ssd|cartucho|toner|impressora|monitor|mouse|teclado|headset|celular|smartphone|fonte|rtx\s*\d|gtx\s*\d|radeon|ryzen|geforce|\brx\s*\d|\bb\d{3}"
STOP_WORDS = "de da do para com e um uma o a os as em no na novo nova original gamer gaming placa video memoria ram processador computador pc desktop".split()
SUFFIXES = "(?:ti|super|xtx|xt|gre)"


def search_text(c: Column) -> Column:
    """Folded words parted by one space, with models, suffixes and units on their own; null is empty."""
    t = S.fold(F.coalesce(c, F.lit("")))
    for pattern, by in ((r"\b(rtx|gtx|rx|ddr)(?=\d)", "$1 "), (rf"\b((?:rtx|gtx|rx)\s*\d{{3,4}})\s*({SUFFIXES[3:-1]})\b", "$1 $2"), (r"(\d)\s*(gb|tb|mhz|ghz)\b", "$1 $2"), ("[^a-z0-9]+", " ")):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def accessory(t: Column) -> Column:
    """The accessory that a search_text sells: the one it names, if no main item stands before it."""
    at, main = F.regexp_instr(t, F.lit(ACCESSORY)), F.regexp_instr(t, F.lit(MAIN))
    return F.when((at > 0) & ((main == 0) | (at <= main)), F.regexp_extract(t, ACCESSORY, 1))


def kind(q: Column) -> Column:
    """Struct (blank, category, accessory) of the search_text of what is wanted."""
    category = F.coalesce(categories.category(q), F.when(q.rlike(r"\bpc\b"), F.lit("PC_MONTADO")))
    return F.struct((q == "").alias("blank"), category.alias("category"), accessory(q).alias("accessory"))


def of_kind(k: Column, t: Column) -> Column:
    """Whether a search_text sells the `kind` that is wanted; categories count where both have one, and empty texts fit all."""
    differ = F.when(k["category"].isNotNull(), F.coalesce(k["category"] != categories.category(t), F.lit(False))).otherwise(F.lit(False))
    return k["blank"] | (t == "") | (~differ & k["accessory"].eqNullSafe(accessory(t)))


def same_kind(q: Column, t: Column) -> Column:
    """Whether two search_texts sell the same kind of item."""
    return of_kind(kind(q), t)


def _models(t: Column) -> Column:
    """(series and number, suffixes) of the graphics models in a search_text, in order."""
    found = F.regexp_extract_all(t, F.lit(rf"\b(?:rtx|gtx|rx)\s*\d{{3,4}}\s*(?:{SUFFIXES}\b\s*)*"), 0)
    return F.transform(found, lambda m: F.struct(F.regexp_replace(F.regexp_extract(m, r"^\D+\d{3,4}", 0), " ", "").alias("model"), F.trim(F.regexp_replace(m, r"^\D+\d{3,4}", "")).alias("suffix")))


def matches(query: Column, title: Column) -> Column:
    """Whether a title is what a query searches for; false for empty ones."""
    def judge(x: Column) -> Column:
        words = F.array_except(F.split(x.q, " "), F.array(*map(F.lit, STOP_WORDS)))
        offered = _models(x.t)
        first = lambda m: F.get(F.filter(offered, lambda o: o.model == m.model), F.lit(0)).suffix
        models = F.forall(_models(x.q), lambda m: F.coalesce(first(m) == m.suffix, F.lit(False)))
        return (x.q != "") & (x.t != "") & same_kind(x.q, x.t) & (F.size(F.array_except(words, F.split(x.t, " "))) == 0) & models

    return S.let(F.struct(search_text(query).alias("q"), search_text(title).alias("t")), judge)
