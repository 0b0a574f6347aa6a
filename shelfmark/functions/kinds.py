"""What kind of item a title sells, and whether it is what a query asks for.

The first kind named in a text is the one on sale: a cable for a monitor is a cable. A title fits a query if it sells the
same kind, names the other kinds that the query names, has the same graphics model with the same suffix, and all
words of the query that don't just name a kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Kinds of item in order, and the words that name them.
KINDS = (
    ("SUPPORT", r"\b(?:suportes?|apoios?|brackets?|braco\s+(?:articulado|para)|base\s+para)\b"),
    ("CABLE", r"\b(?:cabos?|risers?|extensor(?:es)?|extensoes)\b"),
    ("ADAPTER", r"\b(?:adaptador(?:es)?|conversor(?:es)?|hubs?|docks?|docking\s+station)\b"),
    ("COVER", r"\b(?:capas?|capinhas?|cases?\s+(?:para|de)|bolsas?|peliculas?|protetor(?:es)?)\b"),
    ("PASTE", r"\b(?:pasta\s+termica|thermal\s+paste|thermal\s+pad)\b"),
    ("BATTERY", r"\b(?:baterias?|pilhas?)\b"),
    ("CHARGER", r"\b(?:carregador(?:es)?|fonte\s+(?:para|de)\s+(?:notebook|laptop|celular))\b"),
    ("KIT", r"\b(?:kit\s+(?:upgrade|atualizacao|placa[ -]?mae|processador|ryzen)|combo\s+(?:upgrade|placa[ -]?mae|processador|ryzen))\b"),
    ("PC", r"\b(?:pc(?!\s+case\b)(?:\s+(?:gamer|montado|completo))?|computador(?:es)?|desktop)\b"),
    ("NOTEBOOK", r"\b(?:notebooks?|laptops?|macbooks?)\b"),
    ("MOTHERBOARD", r"\b(?:placas?[ -]?mae|motherboards?)\b"),
    ("GPU", r"\b(?:placas?\s+(?:de\s+)?video|gpu|geforce|radeon|(?:rtx|gtx|rx|gt)\s*\d{3,4}|arc\s+[ab]\d{3})\b"),
    ("CPU", r"\b(?:processador(?:es)?|cpu|ryzen|(?:core\s+)?i[3579](?:[ -]\d{3,5}[a-z]*)?|xeon|athlon|celeron|pentium)\b"),
    ("MEMORY_CARD", r"\b(?:cartao\s+(?:de\s+)?memoria|micro\s*sd|sd\s*card)\b"),
    ("USB_DRIVE", r"\b(?:pen\s*drive|usb\s+flash\s+drive)\b"),
    ("RAM", r"\b(?:memorias?(?:\s+ram)?|ram|ddr\s*[345])\b"),
    ("SSD", r"\b(?:ssd|nvme)\b"),
    ("HDD", r"\b(?:hdd|hd|disco\s+rigido|hard\s+drive)\b"),
    ("CASE", r"\b(?:gabinetes?|computer\s+case|pc\s+case)\b"),
    ("PSU", r"\b(?:fontes?(?:\s+(?:de\s+)?alimentacao)?|psu|power\s+supply)\b"),
    ("COOLER", r"\b(?:water\s*cooler|air\s*cooler|coolers?|waterblocks?|dissipador(?:es)?|heatsinks?)\b"),
    ("FAN", r"\b(?:ventoinhas?|fans?)\b"),
    ("MONITOR", r"\b(?:monitor(?:es)?)\b"),
    ("TV", r"\b(?:televisor(?:es)?|televisao|smart\s*tv|tv)\b"),
    ("MOUSEPAD", r"\b(?:mouse\s*pad|desk\s*mat)\b"),
    ("MOUSE", r"\b(?:mouses?|mouse|ratos?)\b"),
    ("KEYBOARD", r"\b(?:teclados?|keyboards?)\b"),
    ("HEADSET", r"\b(?:headsets?|headphones?|fones?(?:\s+de\s+ouvido)?|earphones?|earbuds?)\b"),
    ("MICROPHONE", r"\b(?:microfones?|microphones?)\b"),
    ("SPEAKER", r"\b(?:caixas?\s+(?:de\s+)?som|alto[ -]?falantes?|speakers?|soundbars?)\b"),
    ("WEBCAM", r"\b(?:webcams?|web\s+camera)\b"),
    ("PHONE", r"\b(?:celular(?:es)?|smartphones?|iphones?)\b"),
    ("TABLET", r"\b(?:tablets?|ipads?)\b"),
    ("CHAIR", r"\b(?:cadeiras?|chairs?)\b"),
    ("CONTROLLER", r"\b(?:controles?|controllers?|gamepads?|joysticks?)\b"),
    ("CONSOLE", r"\b(?:consoles?|playstation|xbox|nintendo\s+switch)\b"),
    ("PRINTER", r"\b(?:impressoras?|printers?)\b"),
    ("ROUTER", r"\b(?:roteador(?:es)?|routers?)\b"),
)
#: Kinds that go with another item; words that say nothing; words that stand for others.
ACCESSORIES = ("SUPPORT", "CABLE", "ADAPTER", "COVER", "PASTE", "BATTERY", "CHARGER", "KIT")
STOP_WORDS = "de da do das dos para por com em e ou um uma o a os as ao no na the for of and novo nova novos novas produto produtos original originais oferta ofertas comprar".split()
SAME_WORDS = {"gaming": "gamer", "wireless": "semfio", "mecanico": "mecanica", "mecanicos": "mecanica", "mecanicas": "mecanica", "watts": "w", "watt": "w"}
MODEL = r"\b(rtx|gtx|rx|gt)\s*(\d{3,4})(?:\s*(ti|super|xtx|xt|gre))?\b"


def title_text(c: Column) -> Column:
    """Folded text with models, capacities and screen names parted from their numbers; null is empty."""
    t = S.fold(F.coalesce(c, F.lit("")))
    for pattern, by in (
        (r"\b(rtx|gtx|rx|gt|ryzen|ddr)\s*(\d+)", "$1 $2"), (r"(\b(?:rtx|gtx|rx|gt)\s+\d{3,4})\s*(ti|super|xtx|xt|gre)\b", "$1 $2"),
        (r"\bfull\s*hd\b", "fhd"), (r"\bultra\s*hd\b", "uhd"), (r"\bquad\s*hd\b", "qhd"), (r"(\d)\s*(gb|tb|mb|mhz|ghz|hz|watts?|w)\b", "$1 $2"),
    ):
        t = F.regexp_replace(t, pattern, by)
    return t


def _named(t: Column) -> Column:
    """Structs (pos, n, kind) of the kinds that a title_text names, first ones first."""
    found = F.array(*(F.struct(F.regexp_instr(t, F.lit(p)).alias("pos"), F.lit(i).alias("n"), F.lit(kind).alias("kind")) for i, (kind, p) in enumerate(KINDS)))
    return F.array_sort(F.filter(found, lambda x: x.pos > 0))


def first_kind(c: Column) -> Column:
    """The kind that a text names first."""
    return F.get(_named(title_text(c)), F.lit(0)).kind


def _words(t: Column) -> Column:
    same = F.create_map(*(F.lit(x) for pair in SAME_WORDS.items() for x in pair))
    found = F.regexp_extract_all(F.regexp_replace(t, r"\bsem\s+fio\b", "semfio"), F.lit("[a-z0-9]+"), 0)
    found = F.transform(F.array_except(found, F.array(*map(F.lit, STOP_WORDS))), lambda w: F.coalesce(F.try_element_at(same, w), w))
    return F.array_distinct(F.transform(found, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)))


def relevant(query: Column, title: Column) -> Column:
    """Whether a title is what a query asks for; a query without words fits all."""
    def judge(wanted, offered, read):
        asked, told, words, has = read["asked"], read["told"], read["words"], read["has"]
        kind, sold = F.get(asked, F.lit(0)).kind, F.get(told, F.lit(0))
        same_kind = kind.isNull() | F.coalesce(sold.kind == kind, F.lit(False))
        places = F.filter(F.transform(words, lambda w: F.regexp_instr(offered, F.concat(F.lit(r"\b"), w, F.lit(r"\b")))), lambda p: p > 0)
        an_accessory = kind.isNull() & F.coalesce(sold.kind.isin(*ACCESSORIES), F.lit(False))
        names_it_first = ~an_accessory | F.coalesce(sold.pos >= F.array_min(places), F.lit(False))
        others = F.size(F.array_except(F.transform(asked, lambda x: x.kind), F.concat(F.transform(told, lambda x: x.kind), F.array(kind)))) == 0
        series, number, suffix = (F.regexp_extract(wanted, MODEL, i) for i in (1, 2, 3))
        signature = F.concat(F.lit(r"\b"), series, F.lit(r"\s*"), number, F.when(suffix != "", F.concat(F.lit(r"\s*"), suffix, F.lit(r"\b"))).otherwise(F.lit(r"(?!\s*(?:ti|super|xtx|xt|gre)\b)\b")))
        same_model = (series == "") | F.regexp_like(offered, signature)
        rest = F.regexp_replace(wanted, "|".join(p for _, p in KINDS), " ")
        required = F.array_union(_words(rest), F.filter(words, lambda w: w.rlike("[0-9]")))
        return (F.trim(wanted) == "") | (same_kind & names_it_first & others & same_model & (F.size(F.array_except(required, has)) == 0))

    def bound(x: Column) -> Column:
        read = F.struct(_named(x.q).alias("asked"), _named(x.t).alias("told"), _words(x.q).alias("words"), _words(x.t).alias("has"))
        return S.let(read, lambda r: judge(x.q, x.t, r))

    return S.let(F.struct(title_text(query).alias("q"), title_text(title).alias("t")), bound)
