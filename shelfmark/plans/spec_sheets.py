"""Registered queries of the specification rules: sheets that Spark writes from `part` in three styles, SQL knows the columns behind them.

A part's category is its key mod 6; its style, the key by 6 mod 3, is attributes under English names, under local names, or lines of text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import device_rules, spec_rules, specs
from ..operators import evidence_passages
from .catalogue import HEAVY_ROWS_A_TASK, query, rows
from .markups import filled

#: field: what SQL makes of the part's columns, (name, value) in two styles, a line of text.
SHEETS: dict[str, list[tuple[str, str, tuple[str, str], tuple[str, str], str]]] = {
    "PROCESSADOR": [
        ("socket", "'LGA' || (1000 + size)", ("CPU_SOCKET", "FCLGA {lga}"), ("Soquete", "LGA{lga}"), "Socket: LGA{lga}"),
        ("nucleos", "size", ("# of CPU Cores", "{size}"), ("Número de núcleos", "{size} núcleos"), "Quantidade de núcleos: {size}"),
        ("threads", "2 * size", ("Total Threads", "{twice}"), ("Quantidade de threads do processador", "{twice}"), "Nº de threads: {twice}"),
        ("frequenciaBaseMhz", "100 * size", ("Base Frequency", "{size}00 MHz"), ("Clock base", "{size}00 mhz"), "Frequência base: {size}00 MHz"),
        ("frequenciaTurboMhz", "1000 * size + 500", ("Boost Clock", "{size}.5 GHz"), ("Frequência turbo máxima", "{size},5 GHz"), "Max Boost: Até {size},5 GHz"),
        ("cacheL3Mb", "1024 * size", ("L3-Cache", "{size} GB"), ("Cache L3", "{size}GB"), "Cache L3 total: {size} GB"),
        ("tdpWatts", "lga", ("TDP", "{lga} W"), ("Thermal Design Power", "{lga}"), "Potência de design térmico: {lga} W"),
        ("suportaEcc", "case when key % 4 < 2 then 'true' else 'false' end", ("ECC Memory Supported", "{yes}"), ("Suporta ECC", "{yes}"), "ECC Memory Supported: {yes}"),
    ],
    "PLACA_MAE": [
        ("chipset", "'B' || lga", ("CHIPSET", "B{lga}"), ("Chipset", " B{lga} "), "Chipset: B{lga}"),
        ("formato", "case key % 4 when 0 then 'ATX' when 1 then 'MICRO_ATX' when 2 then 'MINI_ITX' else 'E_ATX' end", ("Form Factor", "{form}"), ("Formato da Placa-Mãe", "{form}"), "Formato: {form}"),
        ("slotsMemoria", "size", ("Memory Slots", "{size}"), ("Quantidade de slots de memória", "{size}"), "{size} slots de memória"),
        ("capacidadeMaximaMemoriaGb", "1024 * size", ("Max Memory", "{size} TB"), ("Capacidade máxima de memória", "{size} TB"), "Suporte máximo de {size} TB"),
        ("portasSata", "size", ("SATA Ports", "{size}"), ("Quantidade de portas SATA", "{size}"), "{size} portas SATA"),
        ("biosMinima", "'F' || size", ("Minimum BIOS Version", "F{size}"), ("BIOS mínima", "F{size}"), "BIOS mínima: F{size}"),
    ],
    "MEMORIA_RAM": [
        ("quantidadeModulos", "2", ("Number of modules", "2"), ("Quantidade de módulos", "2"), "Kit of 2"),
        ("capacidadePorModuloGb", "size", ("Module capacity", "{size} GB"), ("Capacidade total", "{twice} GB"), "Size: {twice} GB"),
        ("frequenciaMhz", "lga", ("Memory Speed", "{lga} MHz"), ("Frequência", "{lga}"), "DDR5-{lga}"),
        ("latenciaCl", "size", ("CAS Latency", "{size}"), ("Latência CL", "CL{size}"), "CL {size}"),
        ("tensaoVolts", "rtrim('1.' || (10 + size % 9), '0')", ("Voltage", "1.{volts} V"), ("Tensão", "1,{volts} V"), "Voltagem: 1,{volts} V"),
        ("consumoWatts", "size", ("Power Consumption", "{size} W"), ("Consumo", "{size} watts"), "Consumo: {size} W"),
    ],
    "PLACA_VIDEO": [
        ("memoriaVideoGb", "size", ("Memory Size", "{size} GB"), ("Memória de vídeo", "{size}GB"), "VRAM: {size} GB"),
        ("tipoMemoriaVideo", "'GDDR6'", ("Memory Type", "gddr6"), ("Tipo de memória de vídeo", "GDDR6"), "com GDDR6"),
        ("barramentoBits", "lga", ("Memory Bus Width", "{lga} bit"), ("Barramento de memória", "{lga}"), "Interface de Memória: {lga} bits"),
        ("clockBoostMhz", "lga", ("Boost Clock", "{lga} MHz"), ("Clock de boost", "{lga}MHz"), "Clock de reforço até: {lga} MHz"),
        ("comprimentoMm", "10 * lga", ("Card Length", "{lga} cm"), ("Comprimento", "{lga} cm"), "Comprimento: {lga} cm"),
        ("consumoWatts", "lga", ("TDP", "{lga} W"), ("Consumo", "{lga} W"), "TGP: {lga} W"),
        ("hdmi", "size", ("HDMI_PORTS", "{size}"), ("Saídas", "{size} x HDMI"), "{size}x HDMI"),
        ("saidasVideo", "size || 'x HDMI'", ("-", "-"), ("-", "-"), "-"),
    ],
    "ARMAZENAMENTO": [
        ("tipo", "'SSD'", ("Type", "NVMe drive"), ("Tipo", "SSD"), "Unidade SSD"),
        ("capacidadeGb", "1024 * size", ("Capacity", "{size} TB"), ("Capacidade de Armazenamento", "{size}TB"), "Tem {size} TB"),
        ("leituraSequencialMbps", "1000 * size", ("READ_SPEED", "{size}000"), ("Recursos", "Leitura/gravação sequencial: {size}.000/{size}.000 MB/s"), "Leitura sequencial: até {size}.000 MB/s"),
        ("escritaSequencialMbps", "1000 * size", ("WRITE_SPEED", "{size}000"), ("-", "-"), "Gravação sequencial: {size}000 MB/s"),
        ("geracaoPcie", "4", ("PCIE_VERSION", "4.0"), ("Geração PCIe", "4"), "PCIe Gen 4.0"),
        ("possuiDissipador", "case when key % 4 < 2 then 'true' else 'false' end", ("Heatsink", "{yes}"), ("Possui dissipador", "{yes}"), "{com} dissipador"),
    ],
    "FONTE": [
        ("potenciaWatts", "lga", ("POWER_OUTPUT", "{lga} W"), ("Potência", "{lga}"), "Fonte de {lga} W"),
        ("certificacao", "'80 Plus Gold'", ("Certification", "80 Plus Gold"), ("Certificações", "80 Plus Gold"), "Selo 80 Plus Gold"),
        ("comprimentoMm", "size", ("-", "-"), ("Dimensões do Produto", "{size} x 150 x 86 mm"), "Dimensões: {size} x 150 x 86 mm"),
        ("conectoresSata", "size", ("Conectores", "{size}x SATA"), ("Conectores da Fonte", "SATA (15 pinos) {size}"), "Conector SATA: {size}"),
        ("tensaoEntrada", "lga || ' V'", ("INPUT_VOLTAGE", "{lga} V"), ("Tensão de entrada", "{lga}  V"), "Faixa de tensão de entrada: {lga} V"),
    ],
    "GABINETE": [
        ("tamanho", "'MID_TOWER'", ("CASE_TYPE", "Mid Tower"), ("Tamanho", "mid-tower ATX"), "Gabinete Mid Tower"),
        ("alturaMm", "lga", ("HEIGHT", "{lga} mm"), ("Altura", "{lga}"), "Altura: {lga} mm"),
        ("formatosPlacaMaeSuportados", "'ATX, MINI_ITX'", ("Motherboard Support", "ATX / Mini-ITX / ATX"), ("Placa mãe suportada", "ATX, mini itx"), "Placa-mãe suportada: ATX, Mini ITX"),
        ("comprimentoMaximoGpuMm", "lga", ("MAX_GPU_LENGTH", "{lga} mm"), ("Comprimento máximo da GPU", "{lga}"), "placas de vídeo de até {lga} mm"),
        ("baias25", "size", ("Baias", "{size}x SSD 2.5"), ("Baias", "{size} x 2,5"), "Baias: {size}x 2.5"),
        ("suportesFans", "'FRENTE ' || size || 'x120, TOPO 2x140'", ("-", "-"), ("Ventoinhas Suportadas", "Frontal: {size}x 120mm Superior: 2 x 140 mm"), "Ventoinhas Suportadas: Frente: {size} x 120 mm, Topo: 2x140mm"),
        ("slotsTraseiros", "size", ("EXPANSION_SLOTS", "{size}"), ("Slots de expansão", "{size}"), "Slots de expansão: {size}"),
    ],
    "COOLER": [
        ("tipo", "'AIR_COOLER'", ("COOLER_TYPE", "Air Cooler"), ("Tipo", "air cooler torre"), "Tower cooler"),
        ("socketsSuportados", "'AM5, LGA' || lga", ("CPU_SOCKETS", "AM5 / LGA {lga}"), ("Compatibilidade AMD", "AM5, LGA{lga}"), "serve em AM5 e LGA{lga}"),
        ("capacidadeTermicaWatts", "lga", ("THERMAL_CAPACITY", "{lga} W"), ("Capacidade térmica", "{lga}"), "TDP Máximo: {lga} W"),
        ("quantidadeVentoinhas", "size", ("FANS_NUMBER", "{size}"), ("Número de Ventoinhas", "{size}"), "Número de Ventoinhas: {size}"),
        ("velocidadeMaxRpm", "lga", ("MAX_RPM", "{lga} RPM"), ("Velocidade máxima", "{lga}"), "Velocidade da Ventoinha: 500 ~ {lga} RPM"),
        ("ruidoDb", "size || '.5'", ("NOISE_LEVEL", "{size}.5 dB"), ("Nível de Ruído", "{size},5"), "Ruído: {size},5 dB"),
    ],
    "VENTOINHA": [
        ("rpmMaxima", "lga", ("MAX_RPM", "{lga}"), ("RPM máxima", "{lga} RPM"), "velocidade máxima: {lga} RPM"),
        ("conector", "'PWM_4_PINOS'", ("PWM Support", "Yes"), ("Conector", "4 pinos"), "plugue PWM"),
        ("pwm", "'true'", ("-", "-"), ("-", "-"), "-"),
        ("fluxoArCfm", "size || '.5'", ("CFM", "{size}.5"), ("Fluxo de ar", "{size},5 CFM"), "{size}.5 CFM"),
        ("pressaoEstaticaMmH2o", "size", ("STATIC_PRESSURE", "{size} mm"), ("Pressão estática", "{size}"), "{size} mm H2O"),
    ],
    "MONITOR": [
        ("tamanhoPolegadas", "10 + size % 9", ("SCREEN_SIZE", "{volts} in"), ("Tamanho da tela", "{volts} polegadas"), "{volts} pol"),
        ("resolucao", "lga || 'x' || lga", ("RESOLUTION", "{lga} x {lga} pixels"), ("Resolução Máxima", "{lga}x{lga}"), "tela {lga}×{lga}"),
        ("taxaAtualizacaoHz", "lga", ("REFRESH_RATE", "{lga} Hz"), ("Taxa de atualização", "{lga}Hz"), "{lga} Hz"),
        ("brilhoNits", "lga", ("BRIGHTNESS", "{lga} cd/m2"), ("Brilho", "{lga} nits"), "{lga} nits"),
        ("tipoPainel", "'IPS'", ("PANEL_TYPE", "IPS"), ("Painel da Tela", "IPS"), "Painel da Tela: IPS"),
        ("displayPort", "size", ("DisplayPort", "{size}"), ("Quantidade de DisplayPort", "{size}"), "{size} x DisplayPort"),
        ("vesa", "'100x100'", ("VESA", "100 x 100 mm"), ("Padrão de Furação", "100x100mm"), "VESA 100x100"),
    ],
    "MOUSE": [
        ("dpiMaximo", "1000 * size", ("MAX_DPI", "{size}000"), ("DPI máximo", "{size}000 DPI"), "DPI: Até {size}.000 DPI"),
        ("pollingRateHz", "lga", ("POLLING_RATE", "{lga} Hz"), ("Polling rate", "{lga}"), "Polling Rate: {lga} Hz"),
        ("botoes", "size", ("BUTTONS_NUMBER", "{size}"), ("Quantidade de botões", "{size}"), "Botões Programáveis: {size}"),
        ("pesoGramas", "lga", ("WEIGHT", "{lga} g"), ("Peso do Produto", "{lga}"), "Peso: {lga} g"),
        ("bluetooth", "'true'", ("Connection Type", "Bluetooth 5"), ("Conectividade", "USB / bluetooth"), "Conectividade: Bluetooth"),
        ("wireless", "'true'", ("-", "-"), ("-", "-"), "-"), ("cabo", "'false'", ("-", "-"), ("-", "-"), "-"),
    ],
    "TECLADO": [
        ("tipo", "'Mecânico'", ("KEYBOARD_TYPE", "Mecânico"), ("Tipo de Teclado", "Mecânico"), "teclado mecânico"),
        ("switch", "'S' || size", ("Switch", "S{size}"), ("Tipo de switch", " S{size}"), "-"),
        ("tamanho", "'TKL'", ("KEYBOARD_SIZE", "TKL"), ("Tamanho", "TKL"), "formato TKL"),
        ("usb", "'true'", ("Connection Type", "USB-C"), ("Conectividade", "usb"), "Conexão: USB {size}"),
    ],
    "HEADSET": [
        ("driverMm", "size", ("DRIVER_SIZE", "{size} mm"), ("Driver", "{size}mm"), "drivers de {size} mm"),
        ("impedancia", "lga", ("Impedance", "{lga} ohms"), ("Impedância", "{lga} ohm (passiva), 9 ohms"), "{lga} Ω"),
        ("bateriaHoras", "size", ("BATTERY_LIFE", "{size} h"), ("Autonomia da bateria", "{size}"), "Autonomia: até {size} h"),
        ("microfone", "case when key % 4 < 2 then 'true' else 'false' end", ("WITH_MICROPHONE", "{yes}"), ("Microfone", "{yes}"), "-"),
    ],
}
#: Fields that a style does not tell.
UNTOLD = {("FONTE", "comprimentoMm"): 0, ("GABINETE", "suportesFans"): 0, ("TECLADO", "switch"): 2, ("HEADSET", "microfone"): 2}
CATEGORIES, STYLES, RULES = list(SHEETS), 3, spec_rules.CATEGORIES | device_rules.CATEGORIES
SHEET = """select p_partkey as key, p_size as size, 1000 + p_size as lga, 2 * p_size as twice, 10 + p_size % 9 as volts, case when p_partkey % 4 < 2 then 'Yes' else 'No' end as yes, case when p_partkey % 4 < 2 then 'com' else 'sem' end as com,
  case p_partkey % 4 when 0 then 'ATX' when 1 then 'Micro-ATX' when 2 then 'mini itx' else 'E-ATX' end as form from part"""
KEYS = ("key", "size", "lga", "twice", "volts", "yes", "com", "form")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, source_id, category, attributes and text of a sheet of each part."""
    parts = rows(spark, sf_dir, SHEET, HEAVY_ROWS_A_TASK)
    kind, style = F.col("key") % len(CATEGORIES), F.floor(F.col("key") / len(CATEGORIES)) % STYLES
    told = lambda t: filled(t, KEYS)
    cells, lines = [], []
    for i, fields in enumerate(SHEETS.values()):
        for s in (0, 1):
            cells.append(F.when((kind == i) & (style == s), F.array(*(F.struct(F.lit(f[2 + s][0]).alias("name"), told(f[2 + s][1]).alias("value")) for f in fields if f[2 + s][0] != "-"))))
        lines.append(F.when((kind == i) & (style == 2), F.concat_ws("\n", *(told(f[4]) for f in fields if f[4] != "-"))))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (kind + 1).cast("int"))
    return parts.select(F.col("key").alias("record_id"), (F.col("key") % 7).alias("source_id"), category.alias("category"), F.coalesce(*cells).alias("attributes"), F.coalesce(*lines).alias("text"))


def sheet_sql(category: str) -> str:
    """key, field, value of the fields that the sheets of a category tell."""
    i = CATEGORIES.index(category)
    untold = lambda f: f" and key // {len(CATEGORIES)} % {STYLES} <> {UNTOLD[category, f]}" if (category, f) in UNTOLD else ""
    return " union all ".join(f"select key as record_id, '{f}' as field, ({made})::varchar as value from ({SHEET}) where key % {len(CATEGORIES)} = {i}{untold(f)}" for f, made, *_ in SHEETS[category])


def _extracted(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The fields that SHEETS names; rules may find further ones in a sheet's lines."""
    found = specs.long(specs.extract(sheets(spark, sf_dir).where(F.col("category").isin(*names)), {n: RULES[n] for n in names}).withColumn("_k", F.struct("record_id", "category")), "_k")
    known = F.array(*(F.lit(f"{n}.{f[0]}") for n in names for f in SHEETS[n]))
    return found.where(F.array_contains(known, F.concat_ws(".", "_k.category", "field"))).select("_k.record_id", "field", "value")


for _name, _category in {"extract_cpu": "PROCESSADOR", "extract_board": "PLACA_MAE", "extract_ram": "MEMORIA_RAM", "extract_gpu": "PLACA_VIDEO", "extract_storage": "ARMAZENAMENTO", "extract_psu": "FONTE", "extract_case": "GABINETE", "extract_cooler": "COOLER", "extract_fan": "VENTOINHA", "extract_monitor": "MONITOR", "extract_mouse": "MOUSE", "extract_keyboard": "TECLADO", "extract_headset": "HEADSET"}.items():
    query(_name, sheet_sql(_category))(lambda spark, sf_dir, c=_category: _extracted(spark, sf_dir, c))


@query("extract_specs", " union all ".join(map(sheet_sql, CATEGORIES)))
def _(spark, sf_dir):
    return _extracted(spark, sf_dir, *CATEGORIES)


def _passage(category: str) -> str:
    """record_id, field, value, passage of evidence: the attribute or line that tells the field, filled in by SQL."""
    i, out = CATEGORIES.index(category), []
    for field, made, english, local, line in SHEETS[category]:
        for style, told in enumerate((": ".join(english), ": ".join(local), line)):
            if told not in ("-", "-: -"):
                text = told.replace("'", "''")
                for k in KEYS:
                    text = text.replace("{" + k + "}", f"' || {k} || '")
                out.append(f"select key as record_id, '{field}' as field, ({made})::varchar as value, '{text}' as passage from ({SHEET}) where key % {len(CATEGORIES)} = {i} and key // {len(CATEGORIES)} % {STYLES} = {style}")
    return " union all ".join(out)


#: Fields that one passage tells by itself; others need a second one.
ALONE = f"field not in ('saidasVideo', 'escritaSequencialMbps', 'pwm', 'wireless', 'cabo') and not (field = 'capacidadePorModuloGb' and record_id // {len(CATEGORIES)} % 3 > 0)"


@query("field_evidence", f"select * from ({' union all '.join(map(_passage, CATEGORIES))}) where {ALONE}")
def _(spark, sf_dir):
    source = sheets(spark, sf_dir)
    known = F.array(*(F.lit(f"{n}.{f[0]}") for n in CATEGORIES for f in SHEETS[n]))
    key = F.struct("record_id", "source_id", "category")
    found = specs.long(specs.extract(source, RULES).withColumn("_k", key), "_k").where(F.array_contains(known, F.concat_ws(".", "_k.category", "field")))
    found = found.select("_k.record_id", "_k.source_id", "field", "value")
    return evidence_passages.evidence(source, found, RULES).where(ALONE.replace("//", "div")).select("record_id", "field", "value", "passage")
