"""The rules of cases, cooling, screens and devices; see `spec_rules`.

Fixed values throughout: names of attributes, labels and patterns are those under which shops and manufacturers give these data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .specs import Every, Field, Joined, Made, Names, Part, Text, Told, Whole, Words

_MM, _AXES = r"([0-9]+(?:[.,][0-9]+)?\s*(?:mm|cm))", r"\bL\s*([0-9.,]+)\s*mm\s*[x×]\s*W\s*([0-9.,]+)\s*mm\s*[x×]\s*H\s*([0-9.,]+)\s*mm"


def _axis(place: int) -> str:
    """The pattern of labelled axes with only one of its lengths captured."""
    parts = _AXES.split("([0-9.,]+)")
    return "".join(part + ("([0-9.,]+)" if i == place else "[0-9.,]+") * (i < 3) for i, part in enumerate(parts))


def _measure(tokens: str, *labels: str, unit: str = "mm") -> tuple:
    """A number under these names, or behind one of these labels."""
    return (Names(tokens), *(Text(rf"{label}\s*:?\s*([0-9.,]+)\s*{unit}") for label in labels))


CASE = (
    Field("tamanho", "case_size", Whole("case_type tower_type tamanho")),
    Field("alturaMm", "mm", Names("height altura"), Text(rf"Altura\s*:?\s*{_MM}"), Text(_axis(2), convert="number")), Field("larguraMm", "mm", Names("width largura"), Text(rf"Largura\s*:?\s*{_MM}"), Text(_axis(1), convert="number")),
    Field("profundidadeMm", "mm", Names("depth profundidade"), Text(rf"Profundidade\s*:?\s*{_MM}"), Text(_axis(0), convert="number")),
    Field("formatosPlacaMaeSuportados", "board_forms", Names("motherboard_support placa_mae_suportada"), Text(r"Placa[- ]?M[aã]e(?:\s+suportada)?\s*:\s*(.+?)(?=\s*\||\s+-\s+[A-ZÁÉÍÓÚ]|\s+Painel\s+Frontal|\s+Frontal\s+I/O|\n|$)")),
    Field("formatosFonteSuportados", "supply_forms", Names("psu_form_factors formatos_de_fonte tipo_de_fonte"), Text(r"(?:Tipo\s+de\s+Fonte|Fontes?\s+de\s+Alimenta[cç][aã]o)\s*:\s*([A-Za-z0-9_ -]+)")),
    Field("comprimentoMaximoGpuMm", "number", *_measure("max_gpu_length comprimento_maximo_da_gpu", r"Comprimento\s+M[aá]ximo\s+da\s+GPU", r"placas?\s+de\s+v[ií]deo.{0,30}?at[eé]")),
    Field("alturaMaximaCoolerCpuMm", "number", *_measure("max_cpu_cooler_height altura_maxima_do_cooler", r"Altura\s+M[aá]xima\s+do\s+Cooler", r"(?:Air\s+)?coolers?.{0,20}?at[eé]")), Field("comprimentoMaximoFonteMm", "number", Names("max_psu_length comprimento_maximo_da_fonte")),
    Field("baias25", "integer", Names("baias", r"(\d+)\s*x?\s*(?:SSD\s*)?2[.,]5"), Text(r"Baias\s*:[^\n]*?(\d+)\s*x?\s*(?:SSD\s*)?2[.,]5")), Field("baias35", "integer", Names("baias", r"(\d+)\s*x?\s*(?:HDD\s*)?3[.,]5"), Text(r"Baias\s*:[^\n]*?(\d+)\s*x?\s*(?:HDD\s*)?3[.,]5")),
    Field("slotsTraseiros", "integer", Names("expansion_slots slots_traseiros slots_de_expansao"), Text(r"Slots\s+de\s+expans[aã]o\s*:\s*(\d+)")), Field("suportaGpuVertical", "flag", Names("vertical_gpu_support suporta_gpu_vertical")),
    Field("suportesFans", "fan_places", Names("ventoinhas_suportadas"), Text(r"Ventoinhas\s+Suportadas\s*:\s*(.+?)(?=\s+-\s+Altura|\s+Altura\s+M[aá]xima|\n|$)")),
    Field("alturaMaximaGpuMm", "number", *_measure("max_gpu_height maximum_gpu_height altura_maxima_da_gpu", r"(?:Maximum\s+GPU\s+Height|Altura\s+m[aá]xima\s+da\s+GPU)")), Field("slotsMaximosGpu", "integer", Names("max_gpu_slots maximum_gpu_slots slots_maximos_da_gpu"), Text(r"(?:Maximum\s+GPU\s+Slots|Slots\s+m[aá]ximos\s+da\s+GPU)\s*:?\s*(\d+)")),
    Field("espacoGerenciamentoCabosMm", "number", *_measure("cable_management_space espaco_para_gerenciamento_de_cabos", r"(?:Cable\s+Management(?:\s+Space)?|Gerenciamento\s+de\s+cabos)")),
    Field("suportesRadiador", "radiator_places", Names("radiator_support radiadores_suportados"), Text(r"(?:Radiator\s+Support|Radiadores?\s+Suportados?)\s*:?\s*(.+?)(?=\s+-\s+[A-ZÁÉÍÓÚ]|\n|$)")),
)

_COOLED = "especificacoes especificacoes_tecnicas ventoinha"
_TRIPLET = r"(?:Tamanho\s+da\s+Ventoinha|Ventoinha\s+Tamanho|Tamanho)\s*:\s*([0-9.,]+\s*(?:mm)?\s*[x×]\s*[0-9.,]+\s*(?:mm)?\s*[x×]\s*[0-9.,]+\s*mm)"
_LIGHTS = (Field("argb", "flag", Words((r"\bARGB\b",))), Field("rgb", "flag", Words((r"\bA?RGB\b",))))


def _cooled(*patterns: str, convert: str = "") -> tuple:
    return (*(Names(_COOLED, p, convert) for p in patterns), Text(*patterns, convert=convert))


COOLER = (
    Field("tipo", "cooler_type", Names("cooler_type tipo"), Names("caracteristicas"), Whole()),
    Field("socketsSuportados", "sockets", Joined("compatible_sockets cpu_sockets sockets_suportados compatibilidade compatibilidade_intel compatibilidade_amd")),
    Field("capacidadeTermicaWatts", "integer", Names("tdp_support thermal_capacity capacidade_termica tdp"), *_cooled(r"TDP\s*(?:M[aá]ximo)?\s*:?\s*(\d+)\s*W", r"(\d+)\s*W\s*TDP")),
    Field("alturaMm", "number", Names("height altura")), Field("larguraMm", "number", Names("width largura")), Field("profundidadeMm", "number", Names("depth profundidade")),
    Field("tamanhoRadiadorMm", "integer", Names("radiator_size tamanho_do_radiador"), Text(r"Water\s+Cooler.{0,100}?\b(120|140|240|280|360|420)\s*mm\b", r"\bRadiador\s*(?:de\s*)?(120|140|240|280|360|420)\s*mm\b")),
    Field("quantidadeVentoinhas", "integer", Names("fans_number quantidade_de_ventoinhas numero_de_ventoinhas"), *_cooled(r"N[uú]mero\s+de\s+Ventoinhas\s*:?\s*(\d+)")),
    Field("espessuraVentoinhaMm", "side_3", Names("fan_size tamanho_da_ventoinha"), *_cooled(_TRIPLET)), Field("tamanhoVentoinhaMm", "integer", Names("fan_size tamanho_da_ventoinha"), *_cooled(_TRIPLET), *_cooled(r"(?:Ventoinha\s+(?:PWM\s+)?de|Tamanho\s*:?)[^0-9]{0,10}(80|92|120|140)\s*mm")),
    Field("ruidoDb", "number", Names("noise_level ruido nivel_de_ruido"), *_cooled(r"(?:N[ií]vel\s+de\s+Ru[ií]do|Ru[ií]do|Noise).{0,30}?([0-9.,]+)\s*dB", r"\b([0-9.,]+)\s*dB(?:A)?\b")),
    Field("vidaUtilHoras", "grouped", Names("lifespan vida_util")), Field("pesoGramas", "number", Names("weight peso")),
    Field("velocidadeMaxRpm", "integer", Names("max_fan_speed max_rpm velocidade_maxima"), Every(_COOLED, (r"Velocidade\s+da\s+Ventoinha\s*:?\s*[0-9]+\s*[~\-]\s*([0-9]{3,5})", r"Velocidade\s*:?\s*([0-9]{3,5})\s*RPM", r"(?:Velocidade\s+m[aá]xima|Max\s+RPM).{0,20}?(\d{3,5})\s*RPM", r"\b(\d{3,5})\s*RPM\b"))),
    Field("fluxoArCfm", "number", Names("airflow cfm air_flow fluxo_de_ar"), *_cooled(r"(?:Air\s*Flow|Fluxo\s+de\s+ar).{0,30}?([0-9.,]+)\s*CFM", r"([0-9.,]+)\s*CFM")),
    Field("alturaLivreRamMm", "number", Names("ram_clearance memory_clearance altura_livre_para_ram"), *_cooled(r"(?:RAM|Memory)\s+Clearance\s*:?\s*([0-9.,]+)\s*mm")), Field("espessuraRadiadorMm", "number", Names("radiator_thickness espessura_do_radiador"), *_cooled(r"(?:Radiator\s+Thickness|Espessura\s+do\s+radiador)\s*:?\s*([0-9.,]+)\s*mm")),
    Field("comprimentoMangueirasMm", "number", Names("tube_length hose_length comprimento_das_mangueiras"), *_cooled(r"(?:Tube|Hose)\s+Length\s*:?\s*([0-9.,]+)\s*mm")), Field("conectorBomba", "text", Names("pump_connector conector_da_bomba")),
    Field("consumoBombaWatts", "number", Names("pump_power consumo_da_bomba"), *_cooled(r"(?:Pump\s+Power|Consumo\s+da\s+bomba)\s*:?\s*([0-9.,]+)\s*W")), *_LIGHTS,
)

_YES = r"^(sim|yes|true|possui|incluso|inclu[ií]do|com|compat[ií]vel|✓|✔|✅)$"
_PWM = "pwm pwm_connector pwm_support suporte_pwm"
FAN = (
    Field("tamanhoMm", "integer", Names("fan_size size tamanho dimensoes_do_produto"), Text(r"\b(80|92|120|140|200)\s*mm\b")), Field("espessuraMm", "number", Names("thickness espessura")),
    Field("rpmMinima", "integer", Names("min_rpm rpm_minima"), Text(r"([0-9][0-9.,]*)\s*(?:-|~|a)\s*[0-9][0-9.,]*\s*RPM", convert="grouped")),
    Field("rpmMaxima", "integer", Names("max_rpm rpm_maxima"), Text(r"(?:velocidades?\s+de\s+at[eé]|velocidade\s+m[aá]xima\s*:?[ \t]*|at[eé]\s+)\s*([0-9][0-9.,]*)\s*RPM", r"\b([0-9][0-9.,]*)\s*RPM\b", convert="grouped")),
    Field("fluxoArCfm", "number", Names("airflow cfm fluxo_de_ar"), Text(r"([0-9.,]+)\s*CFM")), Field("pressaoEstaticaMmH2o", "number", Names("static_pressure pressao_estatica"), Text(r"([0-9.,]+)\s*mm\s*H2O")), Field("ruidoDb", "number", Names("noise_level ruido nivel_de_ruido"), Text(r"([0-9.,]+)\s*dB")),
    Field("_pwm", "flag", Names(_PWM)), Field("conector", "fan_plug", Whole("connector conector fan_connector power_connector"), Made(lambda get: F.when(get("_pwm") == "true", "PWM_4_PINOS"))),
    Field("pwm", "flag", Made(lambda get: F.when((get("conector") == "PWM_4_PINOS") | (get("_pwm") == "true"), "true").otherwise(get("_pwm")))), Field("tensaoVolts", "number", Names("voltage tensao")), Field("correnteAmperes", "number", Names("current corrente")), *_LIGHTS,
    Field("fluxoReverso", "flag", Words((r"fluxo\s+reverso", r"reverse\s+(?:blade|airflow)", r"airflow\s+direction\s*:?\s*reverse", r"fan\s+airflow\s*:?\s*reverse"))),
)


def _port(tokens: str, name: str) -> tuple:
    """A count of ports under these names, or told of the connections or in the text."""
    return Names(tokens), Part("conexoes", (rf"(\d+)\s*(?:[xX]\s*)?{name}", rf"(?:quantidade\s+de\s+|portas?\s+|conectores?\s+){name}\s*[:x-]?\s*(\d+)", rf"{name}\s*[:x-]\s*(\d+)\s*(?:portas?|conectores?)"))


MONITOR = (
    Field("tamanhoPolegadas", "number", Names("screen_size display_size tamanho_da_tela tamanho_de_tela"), Text(r"\b([0-9]{2}(?:[.,][0-9])?)\s*(?:\"|pol(?:egadas?)?)")), Field("resolucao", "screen", Names("screen_resolution resolution resolucao resolucao_maxima"), Text(r"\b(\d{3,5}\s*[x×]\s*\d{3,5})\b")),
    Field("taxaAtualizacaoHz", "integer", Names("refresh_rate taxa_de_atualizacao taxa_de_atualizacao_da_tela"), Text(r"\b(\d{2,4})\s*Hz\b")), Field("tipoPainel", "text", Names("panel_type painel_da_tela tipo_de_painel"), Text(r"(?:Painel\s+da\s+Tela|Tipo\s+de\s+Painel)\s*:?\s*([A-Za-z0-9 -]+?)(?=\s+[A-ZÁÉÍÓÚ][a-záéíóú]+\s*:|\s+Formato\s+da\s+Tela|\n|$)", r"\b(IPS|HVA|VA|TN|OLED|QD[- ]OLED)\b")),
    Field("tempoRespostaMs", "number", Names("response_time tempo_de_resposta"), Text(r"\b([0-9.,]+)\s*ms\b")), Field("brilhoNits", "integer", Names("brightness brilho"), Text(r"\b(\d{2,4})\s*(?:nits?|cd/m)")),
    Field("hdr", "flag", Words((r"\bHDR(?:10|400|600|1000)?\b",))), Field("adaptiveSync", "flag", Words((r"Adaptive[- ]Sync",))), Field("gSync", "flag", Words((r"G[- ]SYNC",))), Field("freeSync", "flag", Words((r"FreeSync",))),
    Field("hdmi", "integer", *_port("hdmi quantidade_de_hdmi", "HDMI")), Field("displayPort", "integer", *_port("display_port displayport quantidade_de_displayport", "(?:DisplayPort|DP)")), Field("usbC", "integer", *_port("usb_c quantidade_de_usb_c", "USB[- ]?C")),
    Field("vesa", "mount", Names("vesa_mount vesa padrao_de_furacao"), Text(r"(?:VESA|Padr[aã]o\s+de\s+Fura[cç][aã]o)\s*:?\s*(\d{2,3}\s*[x×]\s*\d{2,3})")),
)

_LINKS = "connection_type conexao conectividade conexoes"
_AIR = "e_sem_fio sem_fio e_sem_fio_usb"
_LINK = lambda get: F.when((get("bluetooth") == "true") & ~F.lower(get("_link")).contains("bluetooth"), F.concat(F.lit("Bluetooth / "), get("_link"))).otherwise(get("_link"))
_CABLE = lambda get: F.when(get("_wired") == "true", "true").when(get("_air") == "true", "false").when(get("wireless") == "true", "false").when(get("_unwired") == "true", "false").when(get("_usb") == "true", "true")
MOUSE = (
    Field("sensor", "text", Names("sensor_model sensor"), Text(r"Sensor\s*:\s*([A-Za-z0-9 _.-]+?)(?=\s*DPI\s*:|\s*Polling\s+Rate\s*:|\n|$)")), Field("dpiMaximo", "grouped", Text(r"\bDPI\s*:\s*(?:At[eé]\s*)?([0-9][0-9.,]*)\s*DPI\b"), Names("max_dpi dpi_maximo", convert="integer"), Text(r"(?:at[eé]\s*)?([0-9][0-9.,]*)\s*DPI\b")),
    Field("pollingRateHz", "grouped", Text(r"Polling\s+Rate\s*:\s*(?:At[eé]\s*)?([0-9][0-9.,]*)\s*Hz"), Names("polling_rate", convert="integer")), Field("botoes", "integer", Names("buttons_number quantidade_de_botoes"), Text(r"Bot[oõ]es\s+Program[aá]veis\s*:\s*(\d+)")),
    Field("pesoGramas", "number", Names("weight peso peso_do_produto"), Text(r"(?:Peso|Weight)\s*:?\s*([0-9.,]+)\s*g")), Field("_link", "text", Names(_LINKS), Text(r"Conectividade\s*:\s*(USB\s*[0-9.]+|Bluetooth|Wireless|Sem\s+fio)")),
    Field("bluetooth", "present", Part(_LINKS, (r"(bluetooth)",)), Names("com_bluetooth bluetooth", _YES)), Field("wireless", "present", Part(_LINKS, (r"(bluetooth|wireless|sem[ _-]fio|2[.,]4\s*ghz)",)), Names(f"{_AIR} com_bluetooth bluetooth", _YES)), Field("conexao", "text", Made(_LINK)),
    Field("_wired", "present", Names("com_fio e_com_fio", _YES), Names(_LINKS, r"\b(com\s+fio|wired|cabead[oa])\b"), Text(r"Conectividade\s*:\s*(com\s+fio|wired|cabead[oa])\b")), Field("_air", "present", Names(_AIR, _YES)), Field("_unwired", "present", Text(r"\b(sem\s+fio)\b")), Field("_usb", "present", Names(_LINKS, r"^(?!.*(?:receptor|receiver|dongle)).*\b(USB)\b"), Text(r"Conectividade\s*:\s*(USB)")),
    Field("cabo", "flag", Made(_CABLE)), Field("mao", "hand", Text(r"\b(destros?)\b", r"\b(canhotos?)\b", r"\b(ambidestro)\b")), Field("rgb", "flag", Words((r"\bRGB\b",))),
)

_SIZED = r"^(.*(?:compacto?|full[ _-]?size|tkl|tenkeyless).*)$"
KEYBOARD = (
    Field("switch", "text", Names("keyboard_switch switch tipo_de_switch")), Field("layout", "text", Names("keyboard_layout layout padrao_de_teclado")), Field("conexao", "text", Names("connection_type tipo_de_conexao conectividade"), Text(r"(?:Conex[aã]o|Conectividade)\s*:\s*([^.;|\n]+)")),
    Field("tipo", "text", Names("keyboard_type tipo tipo_de_teclado", r"^(?!.*(?:compact|full[ _-]?size|tkl|tenkeyless))(.+)$"), Told(r"\bmec[aâ]nico\b", "Mecânico"), Told(r"\bmembrana\b", "Membrana")),
    Field("tamanho", "text", Names("keyboard_size tamanho"), Names("keyboard_type tipo tipo_de_teclado", _SIZED), Text(r"(?<!\w)(TKL|100%|96%|80%|75%|65%|60%|Full[- ]size|Compacto)(?!\w)")), Field("abnt2", "flag", Words((r"\bABNT\s*2\b",))),
    *(Field(name, "present", Names("connection_type tipo_de_conexao conectividade", p), Names("conexoes", p), Text(rf"(?:Conex[aã]o|Conectividade)\s*:\s*[^.;|\n]*?{p}")) for name, p in (("bluetooth", "(bluetooth)"), ("wireless", r"(bluetooth|wireless|sem[ _-]fio|2[.,]4)"), ("usb", "(usb)"))),
    Field("rgb", "flag", Words((r"\bA?RGB\b",))), Field("hotSwap", "flag", Words((r"hot[- ]?swap|switch\s+remov[ií]vel",))),
)

_PLUG = "connection_type tipo_de_conexao conectividade conexao plugue_de_alto_falante"
HEADSET = (
    Field("tipoConexao", "text", Names(_PLUG), Text(r"(?:Conex[aã]o|Conectividade)\s*:\s*([^.;|\n]+)")), Field("bluetooth", "present", Part(_PLUG, (r"(bluetooth)",))), Field("wireless", "present", Part(_PLUG, (r"(bluetooth|wireless|sem[ _-]fio|2[.,]4)",))),
    Field("driverMm", "number", Names("driver_size driver"), Text(r"drivers?[^.;|]{0,35}?\b([0-9.,]+)\s*mm", r"(?:Driver|Falante)\s*:?\s*([0-9.,]+)\s*mm")), Field("microfone", "flag", Names("with_microphone microfone"), Words((r"\bmicrofone\b",))), Field("somSurround", "flag", Words((r"\b7\.1\b|\bsurround\b",))),
    Field("impedancia", "grouped", Names("impedance impedancia", r"([0-9.,]+)\s*ohms?\s*\(passiva\)"), Names("impedance impedancia", r"([0-9.,]+)\s*(?:ohms?|Ω)"), Text(r"([0-9.,]+)\s*(?:ohms?|Ω)", convert="number")), Field("pesoGramas", "grams", Names("weight peso peso_do_produto")),
    Field("bateriaHoras", "number", Names("battery_life autonomia_da_bateria"), Text(r"(?:Bateria|Autonomia)\s*:?\s*(?:at[eé]\s*)?([0-9.,]+)\s*h")),
)

_SOUND = "especificacoes"
MICROPHONE = (
    Field("conexao", "unbracketed", Names("connection_type conexao"), Part(_SOUND, (r"Conex[aã]o\s+de\s+sa[ií]da\s*:\s*(.+?)(?=\s*\|\s*Consumo|\s*Consumo\s+de\s+energia|\n|$)",))),
    Field("padraoPolar", "text", Names("polar_pattern padrao_polar"), Part(_SOUND, (r"Padr[aã]o\s+polar\s*:\s*([^|\n]+)",))),
    Field("taxaAmostragemKhz", "number", Names("sample_rate taxa_de_amostragem"), Every(_SOUND, (r"taxa\s+de\s+amostragem\s*:\s*\d+\s*bits?/\s*([0-9.,]+)\s*k\s*[-–]\s*[0-9.,]+\s*k\s*Hz", r"taxa\s+de\s+amostragem\s*:\s*\d+\s*bits?/\s*[0-9.,]+\s*k\s*[-–]\s*([0-9.,]+)\s*k\s*Hz"), "highest"), Part(_SOUND, (r"taxa\s+de\s+amostragem[^|\n]*?([0-9.,]+)\s*kHz",))),
)

CATEGORIES = {"GABINETE": CASE, "COOLER": COOLER, "VENTOINHA": FAN, "MONITOR": MONITOR, "MOUSE": MOUSE, "TECLADO": KEYBOARD, "HEADSET": HEADSET, "FONE": HEADSET, "MICROFONE": MICROPHONE}
