"""The category of what a text sells: by forced name, by the title of a whole computer, by ordered rules, and by layers of a record.

The item named at the start of a text says most; pieces and machines named later are often only what it fits. So rules on
the head of a text go before rules on all of it, and of each set the first that fits wins. Rules run over whole texts as one
short-circuit chain; texts are folded once. Null and empty texts have no category.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Names that stand for a category; other names are categories by themselves.
ALIASES = {
    "CPU": "PROCESSADOR", "PROCESSADORES": "PROCESSADOR", "PLACAMAE": "PLACA_MAE", "MOTHERBOARD": "PLACA_MAE", "RAM": "MEMORIA_RAM", "MEMORIA": "MEMORIA_RAM", "GPU": "PLACA_VIDEO",
    "PLACA DE VIDEO": "PLACA_VIDEO", "SSD": "ARMAZENAMENTO", "HDD": "ARMAZENAMENTO", "PSU": "FONTE", "CASE": "GABINETE", "FAN": "VENTOINHA", "MOUSE PAD": "MOUSEPAD", "DESK MAT": "MOUSEPAD",
    "FONES": "FONE", "FONE DE OUVIDO": "FONE", "FONES DE OUVIDO": "FONE", "HEADPHONE": "FONE", "HEADPHONES": "FONE", "EARPHONE": "FONE", "EARBUDS": "FONE", "SMARTPHONE": "CELULAR",
    "SUPORTE DE MONITOR": "SUPORTE_MONITOR", "BRACO MONITOR": "SUPORTE_MONITOR", "SMARTWATCH": "RELOGIO_INTELIGENTE", "VIDEO GAME": "VIDEOGAME", "CONSOLE": "VIDEOGAME", "ASPIRADOR": "ASPIRADOR_PO",
    "ASPIRADOR DE PO": "ASPIRADOR_PO", "CAMERA DE SEGURANCA": "CAMERA_SEGURANCA", "CAMERA DE ACAO": "CAMERA_ACAO",
}

#: Characters of a text that count as its head, for rules and for whole computers.
HEAD, COMPUTER_HEAD = 320, 420
#: Categories that a text names at its very start, before all other rules.
STARTS = (
    ("MEMORIA_RAM", r"^\s*(?:memoria(?:\s+ram)?|ram|kit\s+(?:de\s+)?(?:memoria|ram))\b"),
    ("PLACA_VIDEO", r"^\s*(?:placa\s+de\s+video|gpu|geforce|radeon)\b"),
    ("PLACA_MAE", r"^\s*(?:placa[- ]mae|motherboard)\b"),
)
#: A head that starts so is of another item, whatever board, graphics card or memory it names (rules marked True).
OTHER_ITEM = r"^\s*(?:monitor|notebook|laptop|ultrabook|processador|cpu|gabinete|cooler|water\s*cooler|air\s*cooler|ventoinha|fan|fonte|ssd|hdd|mouse|teclado|headset|fone|suporte|cabo|adaptador|computador|pc|desktop)\b"
#: Rules on the head of a text, in order.
HEADLINES = (
    ("VENTOINHA", r"^\s*(?:(?:kit\s+com\s+\d+\s+)?ventoinhas?|fans?)\b", False),
    ("NOTEBOOK", r"^\s*(?:notebook|laptop|ultrabook)\b", False),
    ("PC_MONTADO", r"^\s*(?:(?:pc|computador)\s+gamer|(?:pc|computador)\s+(?:gamer\s+)?(?:completo|montado)|desktop\s+(?:gamer|montado))\b", False),
    ("PLACA_MAE", r"\b(?:a320|a520|a620|b350|b450|b550|b650|b850|x370|x470|x570|x670|x870|h410|h510|h610|h710|h810|b460|b560|b660|b760|b860|z490|z590|z690|z790|z890)(?:m|e|i)?(?:[- ]|$)", True),
    ("PLACA_VIDEO", r"\b(?:geforce\s+)?(?:rtx|gtx)\s*\d{3,4}\b|\bradeon\s+rx\s*\d{3,4}\b|\bintel\s+arc\s+[ab]\d{3}\b", True),
    ("PROCESSADOR", r"^\s*(?:processador|cpu)\b", False),
    ("MEMORIA_RAM", r"\b(?:kingston\s+fury|corsair\s+vengeance|g[.]?skill\s+(?:trident|ripjaws)|xpg\s+(?:lancer|gammix)|teamgroup\s+t[- ]?force)\b.{0,100}\b\d+\s*gb\b.{0,50}\b\d{4,5}\s*mhz\b", True),
    ("MEMORIA_RAM", r"\b(?:4|8|16|24|32|48|64|96|128)\s*gb\b.{0,45}\bddr[345]\b.{0,35}\b(?:\d{4,5})\s*mhz\b", True),
    ("MEMORIA_RAM", r"\bddr[345]\b.{0,45}\b(?:4|8|16|24|32|48|64|96|128)\s*gb\b.{0,35}\b(?:\d{4,5})\s*mhz\b|\b(?:so[- ]?dimm|udimm|dimm)\b.{0,45}\bddr[345]\b", True),
    ("ARMAZENAMENTO", r"^\s*(?:ssd|hdd|hd\s+)\b", False),
    ("FONTE", r"^\s*(?:fonte|power\s+supply)\b", False),
    ("GABINETE", r"^\s*(?:gabinete|computer\s+case)\b", False),
    ("COOLER", r"^\s*(?:(?:water|air)\s*)?cooler\b", False),
    ("MONITOR", r"^\s*monitor\b", False),
    ("TECLADO", r"^\s*(?:teclado|keyboard)\b", False),
    ("MOUSEPAD", r"^\s*(?:mouse[\s_-]*(?:(?:gamer|gaming)\s+)?pads?|desk[\s_-]*(?:mat|pad)|(?:tapete|base)\s+(?:(?:para|de)\s+)?(?:o\s+)?mouse)\b", False),
    ("MOUSE", r"^\s*mouse\b", False),
    ("HEADSET", r"^\s*(?:headset|fones?\b.{0,70}\bheadset)\b", False),
    ("FONE", r"^\s*(?:fones?|headphones?|earphones?|ear[\s-]?buds?)\b|\b(?:air\s*pods?|galaxy\s+buds|wave\s+buds)\d*\b", False),
    ("MICROFONE", r"^\s*(?:microfone|microphone)\b", False),
)
#: Rules on whole texts, in order; things made of pieces come before the pieces.
GENERAL = (
    ("NOTEBOOK", r"\b(?:notebook|laptop|ultrabook)\b"),
    ("PC_MONTADO", r"\b(?:(?:pc|computador)\s+gamer|(?:pc|computador)\s+(?:gamer\s+)?(?:completo|montado)|desktop\s+(?:gamer|montado))\b"),
    ("CELULAR", r"\b(?:smartphone|celular|iphone|redmi|poco|moto\s+g)\b|\bgalaxy\s+[asz]\d"),
    ("ROBO_ASPIRADOR", r"\b(?:robo\s+aspirador|aspirador\s+robo|robot\s+vacuum)\b"),
    ("ASPIRADOR_PO", r"\b(?:aspirador|vacuum\s+cleaner)\b"),
    ("CAMERA_SEGURANCA", r"\bcamera\b.{0,25}\b(?:seguranca|vigilancia|ip|cftv)\b"),
    ("CAMERA_ACAO", r"\b(?:camera\s+de\s+acao|action\s+camera|gopro)\b"),
    ("SMART_SPEAKER", r"\b(?:smart\s+speaker|echo\s+(?:dot|show|pop)|homepod|nest\s+audio)\b"),
    ("LAMPADA_INTELIGENTE", r"\b(?:lampada\s+inteligente|smart\s+bulb)\b"),
    ("TOMADA_INTELIGENTE", r"\b(?:tomada\s+inteligente|smart\s+plug)\b"),
    ("FECHADURA_INTELIGENTE", r"\b(?:fechadura\s+(?:digital|inteligente|smart)|smart\s+lock)\b"),
    ("E_READER", r"\b(?:e[- ]?reader|kindle|kobo)\b"),
    ("DRONE", r"\b(?:drone|quadricoptero)\b"),
    ("SOUNDBAR", r"\bsoundbar\b"),
    ("HOME_THEATER", r"\bhome\s+theater\b"),
    ("AIR_FRYER", r"\b(?:air\s*fryer|fritadeira\s+eletrica)\b"),
    ("CAFETEIRA", r"\b(?:cafeteira|coffee\s+maker)\b"),
    ("LIQUIDIFICADOR", r"\b(?:liquidificador|blender)\b"),
    ("CLIMATIZADOR", r"\b(?:climatizador|air\s+cooler\s+portatil)\b"),
    ("VENTILADOR", r"\bventilador\b"),
    ("PROJETOR", r"\b(?:projetor|projector)\b"),
    ("CALCULADORA", r"\bcalculadora\b"),
    ("TELEFONE", r"\btelefone\b"),
    ("IMPRESSORA_3D", r"\bimpressora\s+3d\b"),
    ("IMPRESSORA", r"\b(?:impressora|printer)\b"),
    ("SCANNER", r"\bscanner\b"),
    ("CAIXA_DE_SOM", r"\b(?:caixa\s+de\s+som|speaker)\b"),
    ("ROTEADOR", r"\b(?:roteador|router)\b"),
    ("REPETIDOR_WIFI", r"\brepetidor\b.{0,20}\bwi-?fi\b"),
    ("SWITCH_REDE", r"\bswitch\b.{0,20}\brede\b"),
    ("NOBREAK", r"\b(?:nobreak|ups)\b"),
    ("ESTABILIZADOR", r"\bestabilizador\b"),
    ("FILTRO_DE_LINHA", r"\bfiltro\s+de\s+linha\b"),
    ("TABLET", r"\b(?:tablet|ipad)\b"),
    ("KIT_ARDUINO_ROBOTICA", r"\bkit\b.{0,30}\b(?:arduino|robotica)\b|\bkit\s+de\s+robotica\b"),
    ("MICROCONTROLADOR", r"\b(?:microcontrolador|esp32|esp8266|arduino)\b"),
    ("MINI_COMPUTADOR", r"\b(?:mini\s*(?:pc|computador)|ras?pb?erry\s+pi)\b"),
    ("RELOGIO_INTELIGENTE", r"\b(?:smartwatch|relogio\s+inteligente)\b"),
    ("VOLANTE", r"\bvolante\b.{0,25}\b(?:gamer|jogo|simulador)\b"),
    ("JOYSTICK", r"\bjoystick\b"),
    ("CONTROLE_VIDEO_GAME", r"\bcontrole\b.{0,30}\b(?:xbox|playstation|ps[345]|switch|videogame|console)\b|\bgamepad\b"),
    ("VIDEOGAME", r"\b(?:videogame|console|playstation\s*[345]|xbox|nintendo\s+switch|steam\s+deck)\b"),
    ("SMART_TV", r"\bsmart\s*tv\b"),
    ("TV", r"\b(?:tv|televisao)\b.{0,30}\b(?:led|qled|oled|mini[- ]?led|4k|8k|uhd)\b"),
    ("CAMERA", r"\bcamera\b.{0,20}\b(?:digital|mirrorless|dslr|fotografica)\b|\bmaquina\s+fotografica\b"),
    ("POWER_BANK", r"\bpower\s*bank\b"),
    ("HUB_USB", r"\bhub\s+usb\b"),
    ("DOCK_STATION", r"\bdock(?:ing)?\s+station\b"),
    ("PEN_DRIVE", r"\bpen\s*drive\b"),
    ("CARTAO_MEMORIA", r"\b(?:cartao\s+de\s+memoria|microsd)\b"),
    ("ARMAZENAMENTO_EXTERNO", r"\b(?:hd|ssd)\s+externo\b"),
    ("SUPORTE_MONITOR", r"\b(?:suporte|braco)\b.{0,30}\bmonitor\b"),
    ("WEBCAM", r"\bwebcam\b|camera\s+para\s+pc"),
    ("CONTROLE", r"\bcontrole\s+(?:sem\s+fio|gamer|bluetooth|para\s+pc)\b"),
    ("CADEIRA", r"\bcadeira\s+(?:gamer|ergonomica|escritorio)\b"),
    ("MOUSEPAD", r"\b(?:mouse[\s_-]*(?:(?:gamer|gaming)\s+)?pads?|desk[\s_-]*(?:mat|pad)|(?:tapete|base)\s+(?:(?:para|de)\s+)?(?:o\s+)?mouse)\b"),
    ("MESA", r"\bmesa\s+(?:gamer|escritorio|computer)\b"),
    ("ILUMINACAO", r"\b(?:fita\s+led|iluminacao\s+(?:rgb|led)|light\s*bar)\b"),
    ("ORGANIZADOR_CABOS", r"\b(?:organizador(?:es)?\s+de\s+cabos?|cable\s+management)\b"),
    ("ACESSORIO", r"\bacessorio\s+(?:para\s+pc|gamer|de\s+setup)\b"),
    ("PLACA_MAE", r"placa[- ]mae|\bmotherboard\b"),
    ("PLACA_VIDEO", r"placa de video|\bgeforce\b|\bradeon\s+rx\b|\brtx\s*\d|\brx\s*\d"),
    ("PROCESSADOR", r"\b(?:processador|ryzen|core\s+(?:ultra\s+)?i?[3579]|intel\s+core)\b"),
    ("MEMORIA_RAM", r"memoria\s+ram|\bddr[345]\b.{0,40}\b(?:4|8|16|24|32|48|64|96|128)\s*gb\b|\b(?:4|8|16|24|32|48|64|96|128)\s*gb\b.{0,40}\bddr[345]\b|\b(?:so[- ]?dimm|udimm|dimm)\b.{0,40}\bddr[345]\b"),
    ("ARMAZENAMENTO", r"\b(?:ssd|nvme|hdd)\b|disco\s+rigido"),
    ("FONTE", r"\bfonte\b.{0,45}\b\d{3,4}\s*w\b|\b(?:power\s+supply|psu)\b"),
    ("GABINETE", r"\b(?:gabinete|computer\s+case|pc\s+case)\b"),
    ("COOLER", r"\b(?:water\s*cooler|air\s*cooler|aio\s+\d{3})\b|cooler.{0,20}\bcpu\b"),
    ("VENTOINHA", r"\b(?:ventoinha|cooler\s+fan|fan\s+(?:rgb|argb|pwm|120|140))\b"),
    ("MONITOR", r"\bmonitor\b"),
    ("TECLADO", r"\b(?:teclado|keyboard)\b"),
    ("MOUSE", r"\bmouse\b"),
    ("HEADSET", r"\bheadset\b"),
    ("FONE", r"\b(?:fones?|headphones?|earphones?|ear[\s-]?buds?|air\s*pods?\d*|(?:galaxy|wave)\s+buds\d*|tws|in[\s-]ear|over[\s-]ear|on[\s-]ear)\b"),
    ("MICROFONE", r"\b(?:microfone|microphone)\b"),
)
#: Of whole computers, what rules them out, what names one, words for one, and what its parts look like.
NO_COMPUTER = (
    r"\b(?:mini[- ]?pc|mini\s+computador|notebook|laptop|ultrabook)\b",
    r"^\s*(?:kit\s+(?:upgrade|de\s+upgrade)|processador|cpu|placa[- ]mae|motherboard|placa\s+de\s+video|gpu|memoria(?:\s+ram)?|ram|ssd|hdd|fonte|psu|gabinete|case|cooler|water\s*cooler|air\s*cooler|ventoinha|fan)\b",
    r"\b(?:kit\s+(?:de\s+)?upgrade|combo\s+upgrade)\b",
)
COMPUTER = r"\b(?:computador|pc|desktop)\s+(?:de\s+mesa\b|gamer\b|montado\b|completo\b|all[- ]?in[- ]?one\b|intel\b|amd\b|core\b|ryzen\b|celeron\b|pentium\b|(?:i[3579])\s*[- ]?\d{3,5}\b)"
COMPUTER_WORD = r"\b(?:computador|pc|desktop)\b"
PARTS = (
    r"\b(?:ryzen\s*[3579]?\s*\d{3,5}[a-z]{0,2}|(?:intel\s+)?core\s+i[3579][ -]?\d{3,5}[a-z]{0,2}|i[3579][ -]?\d{3,5}[a-z]{0,2}|xeon\s+\w+)\b",
    r"\b(?:4|8|12|16|24|32|48|64|96|128)\s*gb\b.{0,18}\b(?:ram|ddr[345])\b|\b(?:ram|ddr[345])\b.{0,18}\b(?:4|8|12|16|24|32|48|64|96|128)\s*gb\b",
    r"\b(?:ssd|nvme|hdd|hd)\b.{0,18}\b\d+(?:[.,]\d+)?\s*(?:gb|tb)\b|\b\d+(?:[.,]\d+)?\s*(?:gb|tb)\b.{0,18}\b(?:ssd|nvme|hdd|hd)\b",
    r"\b(?:rtx|gtx)\s*\d{3,4}(?:\s*ti|\s*super)?\b|\bradeon\s*(?:rx)?\s*\d{3,4}\b",
)
#: What the last part of a URL's path names, in order, before the rules on texts.
SLUGS = (
    ("CELULAR", r"\b(?:smartphone|celular|iphone)\b"), ("TABLET", r"\btablet\b"), ("VIDEOGAME", r"\b(?:videogame|console|playstation|xbox|nintendo switch)\b"), ("SMART_TV", r"\bsmart tv\b"),
    ("CAMERA", r"\b(?:camera|maquina fotografica)\b"), ("ROBO_ASPIRADOR", r"\brobo aspirador\b"), ("ASPIRADOR_PO", r"\baspirador\b"), ("NOTEBOOK", r"\bnotebook\b"), ("MONITOR", r"\bmonitor\b"),
    ("MEMORIA_RAM", r"\b(?:memoria(?: ram)?|kit (?:de )?(?:memoria|ram)|ram)\b|\b(?:4|8|16|24|32|48|64|96|128) gb\b.{0,45}\bddr[345]\b"),
)
#: Names of attributes that tell the type of an item.
TYPE_NAMES = ("tipo de produto", "tipo do produto", "product type")


def _like(t: Column, pattern: str) -> Column:
    return t.rlike(f"(?sU){pattern}")


def _first(t: Column, rules: Iterable[tuple[str, str]]) -> list[Column]:
    return [F.when(_like(t, pattern), F.lit(category)) for category, pattern in rules]


def forced_category(c: Column) -> Column:
    """The category that a name stands for, whatever its case, marks, hyphens and spaces; null and blank give null."""
    name = S.clean(F.replace(F.upper(S.fold(c)), F.lit("-"), F.lit(" ")))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), F.replace(name, F.lit(" "), F.lit("_")))


def _computer(t: Column) -> Column:
    """Of a folded head, whether it sells a whole computer."""
    parts = sum((_like(t, p).cast("int") for p in PARTS), F.lit(0))
    return ~_like(t, "|".join(NO_COMPUTER)) & (_like(t, COMPUTER) | (_like(t, COMPUTER_WORD) & (parts >= 2)))


def whole_computer(c: Column) -> Column:
    """Whether a title sells a whole computer: it says so, or names one and at least two kinds of parts. False for null."""
    return S.let(F.left(S.fold(F.coalesce(c, F.lit(""))), F.lit(COMPUTER_HEAD)), _computer)


def category(c: Column) -> Column:
    """The category of a text, null if no rule fits."""
    def judge(t: Column) -> Column:
        starts = S.let(F.left(t, F.lit(HEAD)), lambda h: F.coalesce(*_first(h, STARTS), S.let(_like(h, OTHER_ITEM), lambda other: F.coalesce(
            *(F.when((~other if guarded else F.lit(True)) & _like(h, pattern), F.lit(name)) for name, pattern, guarded in HEADLINES)
        ))))
        return F.coalesce(F.when(_computer(F.left(t, F.lit(COMPUTER_HEAD))), F.lit("PC_MONTADO")), starts, *_first(t, GENERAL))

    return S.let(S.fold(F.coalesce(c, F.lit(""))), judge)


def slug_category(url: Column) -> Column:
    """The category that the last part of a URL's path, before any /p/ code, names."""
    path = F.coalesce(F.try_url_decode(F.regexp_replace(F.parse_url(url, F.lit("PATH")), r"\+", "%2B")), F.lit(""))
    slug = F.regexp_extract(F.regexp_replace(path, "(?is)/p/.*$", ""), "([^/]*)/*$", 1)

    def judge(text: Column) -> Column:
        return S.let(category(text), lambda c: F.coalesce(F.when(c == "PC_MONTADO", c), *_first(S.fold(text), SLUGS), c))

    return S.let(F.regexp_replace(slug, "[-_]+", " "), judge)


def record_category(title: Column, attributes: Column, attributes_text: Column, all_text: Column, url: Column, blocked: Column, forced: Column) -> Column:
    """The category of a record: forced; of a blocked page the URL's; the type among its attributes (array of name, value); the title's; the attributes'; all text's.

    The first type attribute that names a category counts. It doesn't turn a mouse pad into a mouse, nor headphones and
    headsets into each other. All text counts only where there are attributes. Null in any column is as if it were not there.
    """
    known = F.filter(F.coalesce(attributes, F.array().cast("array<struct<name:string,value:string>>")), lambda a: F.lower(F.trim(a["name"])).isin(*TYPE_NAMES))
    types = F.filter(F.transform(known, lambda a: category(a["value"])), lambda c: c.isNotNull())
    ears = ("FONE", "HEADSET")

    def layered(x: Column) -> Column:
        unclear = F.coalesce(((x.named == "MOUSEPAD") & (x.type == "MOUSE")) | (x.named.isin(*ears) & x.type.isin(*ears)), F.lit(False))
        return F.coalesce(F.when(~unclear, x.type), x.named)

    told = S.let(F.struct(category(title).alias("named"), F.get(types, F.lit(0)).alias("type")), layered)
    rest = F.when(F.size(F.coalesce(attributes, F.array().cast("array<struct<name:string,value:string>>"))) > 0, category(all_text))
    return F.coalesce(forced_category(forced), F.when(F.coalesce(blocked, F.lit(False)), slug_category(url)).otherwise(F.coalesce(told, category(attributes_text), rest)))
