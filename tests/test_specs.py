"""Specification rules on whole titles and sheets, one row a record, all categories in one job."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import device_rules, spec_rules, specs

RULES = spec_rules.CATEGORIES | device_rules.CATEGORIES
SCHEMA = "record_id int, category string, attributes array<struct<id string, name string, value string>>, text string"
CASES = [
    ("PROCESSADOR", [("CPU_SOCKET", "Socket", "AM5"), ("ARCHITECTURE", "Arquitetura", "x86-64"), ("RAM_MEMORY_TYPE", "Tipo de memória RAM", "DDR5")], "Processador Ryzen", {"socket": "AM5", "tiposMemoriaSuportados": "DDR5", "arquitetura": None}),
    ("PROCESSADOR", [(None, "# of CPU Cores", "8"), (None, "Cores / Threads", "6 / 12"), (None, "Base Clock", "3,8 GHz"), (None, "Cache", "32 MB"), (None, "Memory Types", "DDR4-3200, DDR5-5600"), (None, "PCI Express Revision", "5.0 x16"), (None, "Processor Graphics", "No")],
     "Intel Core i5, sem cooler. TDP: 65 W\nQuantidade de núcleos: 10\nCode Name Raptor Lake", {"nucleos": "10", "threads": "12", "frequenciaBaseMhz": "3800", "cacheL3Mb": "32", "tiposMemoriaSuportados": "DDR4, DDR5", "frequenciaMemoriaMaximaMhz": "3200", "versaoPcie": "5.0", "lanesPcie": "16", "coolerIncluso": "false", "tdpWatts": "65", "possuiVideoIntegrado": "false", "modeloVideoIntegrado": None, "familia": "Intel Core", "arquitetura": "Raptor Lake"}),
    ("PROCESSADOR", [("", "Socket", "FCLGA 1700"), (None, "Socket", "AM4"), (None, "L2 Cache", "512 KB"), (None, "iGPU", "Radeon 760M")], None, {"socket": "LGA1700", "cacheL2Mb": "0.5", "possuiVideoIntegrado": "true", "modeloVideoIntegrado": "Radeon 760M"}),
    ("PLACA_MAE", [], "Placa-mãe Socket: AM5 Chipset: B650 Formato: ATX 4 x DIMM DDR5 Wi-Fi 6 Bluetooth 5.2 XMP EXPO HDMI DisplayPort", {"socket": "AM5", "chipset": "B650", "formato": "ATX", "slotsMemoria": "4", "wifi": "true", "bluetooth": "true", "suportaXmp": "true", "suportaExpo": "true", "saidasVideo": "HDMI, DisplayPort"}),
    ("PLACA_MAE", [(None, "HDMI", "0"), (None, "Display Port", "2"), (None, "M.2 (PCI-E 4.0)", "2"), (None, "M.2 (PCI-E 5.0)", "1"), (None, "PCI-E 4.0 x16", "1"), (None, "PCI-E 5.0 x16", "0"), (None, "Formato da Placa-Mãe", "micro ATX")], "HDMI unbuffered", {"saidasVideo": "DisplayPort", "slotsM2": "3", "versaoPcie": "4.0", "formato": "MICRO_ATX", "suportaMemoriaRegistrada": "false"}),
    ("PLACA_MAE", [(None, "HDMI", "0")], "HDMI", {"saidasVideo": None}),
    ("MEMORIA_RAM", [], "Kit Memória RAM DDR5 DIMM 2x16GB 6000MHz CL30 1.35V XMP EXPO RGB", {"tipo": "DDR5", "formato": "DIMM", "quantidadeModulos": "2", "capacidadePorModuloGb": "16", "frequenciaMhz": "6000", "latenciaCl": "30", "tensaoVolts": "1.35", "rgb": "true"}),
    ("MEMORIA_RAM", [(None, "Size", "32 GB"), (None, "Sticks", "2"), (None, "Memory Type", "DDR4, DDR5")], "Corsair Vengeance LPX DDR4-3600", {"tipo": None, "formato": "DIMM", "capacidadePorModuloGb": "16", "frequenciaMhz": "3600", "ecc": "false", "registrada": "false", "suportaXmp": "true"}),
    ("MEMORIA_RAM", [], "16 GB DDR4 Dual-Kit SO-DIMM ECC registered", {"quantidadeModulos": "2", "capacidadePorModuloGb": "8", "formato": "SO_DIMM", "ecc": "true", "registrada": "true"}),
    ("PLACA_VIDEO", [], "GeForce RTX 5070 12 GB GDDR7 PCIe 5.0 x16 Comprimento: 304 mm TGP: 250 W Fonte recomendada: 650 W 3 x DisplayPort 1 x HDMI", {"memoriaVideoGb": "12", "tipoMemoriaVideo": "GDDR7", "geracaoPcie": "5", "larguraPcie": "16", "comprimentoMm": "304", "consumoWatts": "250", "potenciaFonteRecomendadaWatts": "650", "hdmi": "1", "displayPort": "3", "saidasVideo": "1x HDMI, 3x DisplayPort", "gpu": "RTX 5070"}),
    ("PLACA_VIDEO", [(None, "GPU", "Radeon RX series"), (None, "Dimensões", "30,5 x 12 x 5 cm"), (None, "Saídas", "DisplayPort 2.1: 3 x HDMI | 2.1: 1x"), (None, "Requisitos", "2x 8-pin e 1x 12VHPWR")], "AMD Radeon RX 7900 XTX, RDNA 3", {"gpu": "AMD Radeon RX 7900 XTX", "arquitetura": "RDNA 3", "comprimentoMm": "305", "alturaMm": "120", "espessuraMm": "50", "displayPort": "3", "hdmi": "1", "conectoresPcie8Pinos": "2", "conectores12vhpwr": "1"}),
    ("ARMAZENAMENTO", [], "SSD NVMe M.2 2280 1TB PCIe Gen4 x4 Leitura: 7.000 MB/s Escrita sequencial: até 6000 MB/s com dissipador M-Key", {"tipo": "SSD", "formato": "M2", "interface": "NVME_PCIE", "capacidadeGb": "1024", "tamanhoM2Mm": "80", "geracaoPcie": "4", "pistasPcie": "4", "possuiDissipador": "true", "leituraSequencialMbps": "7000", "escritaSequencialMbps": "6000", "chaveM2": "M"}),
    ("ARMAZENAMENTO", [(None, "Formato", "3,5 polegadas"), (None, "Interface", "SATA III"), (None, "Capacidade", "2 TB"), (None, "Dimensões", "22 x 80 x 2,3 mm")], "HDD", {"tipo": "HDD", "formato": "POLEGADAS_3_5", "interface": "SATA", "capacidadeGb": "2048", "larguraMm": None, "tamanhoM2Mm": None}),
    ("FONTE", [], "Fonte ATX 750W 80 Plus Gold totalmente modular ATX 3.1 OVP OCP SCP", {"formato": "ATX", "potenciaWatts": "750", "certificacao": "80 Plus Gold", "modularidade": "MODULAR", "padraoAtx": "3.1", "protecoes": "OVP, OCP, SCP"}),
    ("FONTE", [(None, "Conectores", "1x CPU / Processador (P4+4) 2x CPU / Processador (EPS 8) 3x GPU / Placa de Vídeo (PCI-E 6+2 pinos)"), (None, "Dimensões do Produto", "140 x 150 x 86 mm"), (None, "Modularidade", "Não")], "cabo nativo 12V-2x6", {"conectoresEpsCpu": "3", "conectoresPcie8Pinos": "3", "comprimentoMm": "140", "alturaMm": "86", "modularidade": "NAO_MODULAR", "conectores12v2x6": "1"}),
    ("GABINETE", [(None, "Baias", "2x SSD 2.5 / 1x HDD 3.5"), (None, "Radiator Support", "Front: 360mm, Top: up to 240 mm")], "Gabinete Full Tower L 418mm x W 277mm x H 440mm\nPlaca-mãe suportada: ATX, Micro-ATX, Mini-ITX | x", {"tamanho": "FULL_TOWER", "profundidadeMm": "418", "larguraMm": "277", "alturaMm": "440", "formatosPlacaMaeSuportados": "ATX, MICRO_ATX, MINI_ITX", "baias25": "2", "baias35": "1", "suportesRadiador": "FRENTE 360, TOPO 240"}),
    ("COOLER", [], "Water Cooler AIO 360 mm compatível AM5 LGA1700 3 ventoinhas ARGB 2100 RPM 25 dB", {"tipo": "WATER_COOLER", "socketsSuportados": "AM5, LGA1700", "tamanhoRadiadorMm": "360", "argb": "true", "rgb": "true", "velocidadeMaxRpm": "2100", "ruidoDb": "25"}),
    ("COOLER", [(None, "Compatibilidade", "Intel: LGA115X / 1200 / 1700 | AMD: AM4"), (None, "Tamanho da ventoinha", "120 x 120 x 25 mm")], "air cooler Velocidade: 800 RPM até 1.500 RPM", {"tipo": "AIR_COOLER", "socketsSuportados": "LGA115X, AM4, LGA1200, LGA1700", "tamanhoVentoinhaMm": "120", "espessuraVentoinhaMm": "25"}),
    ("VENTOINHA", [], "Ventoinha 120 mm PWM 4 pinos 1800 RPM 62.5 CFM 1.8 mmH2O 25 dB ARGB", {"tamanhoMm": "120", "conector": "PWM_4_PINOS", "pwm": "true", "rpmMaxima": "1800", "fluxoArCfm": "62.5", "pressaoEstaticaMmH2o": "1.8", "argb": "true"}),
    ("VENTOINHA", [(None, "PWM", "Não")], "fan 3 pinos 500 - 1.500 RPM reverse blade", {"conector": "DC_3_PINOS", "pwm": "false", "rpmMinima": "500", "rpmMaxima": "1500", "fluxoReverso": "true"}),
    ("MONITOR", [], 'Monitor 27" 2560x1440 IPS 180Hz 1ms HDR FreeSync 2 x HDMI 1 x DisplayPort VESA 100x100', {"tamanhoPolegadas": "27", "resolucao": "2560x1440", "taxaAtualizacaoHz": "180", "tipoPainel": "IPS", "hdmi": "2", "displayPort": "1", "vesa": "100x100", "hdr": "true", "freeSync": "true", "tempoRespostaMs": "1"}),
    ("MONITOR", [(None, "Resolução", "Full HD"), (None, "HDMI", "2")], "HDMI 2.1", {"resolucao": "FULL HD", "hdmi": "2"}),
    ("MOUSE", [(None, "Conexões", "USB"), (None, "Bluetooth", "Sim")], "Mouse para destros, até 25.600 DPI", {"conexao": "Bluetooth / USB", "bluetooth": "true", "wireless": "true", "cabo": "false", "dpiMaximo": "25600", "mao": "Destro"}),
    ("MOUSE", [(None, "Conexão", "USB com fio")], "", {"conexao": "USB com fio", "cabo": "true", "bluetooth": None}),
    ("TECLADO", [], "Teclado mecânico ABNT2 Conexão: USB-C Bluetooth 2.4GHz RGB hot-swap 75%", {"tipo": "Mecânico", "abnt2": "true", "rgb": "true", "hotSwap": "true", "tamanho": "75%", "usb": "true", "bluetooth": "true"}),
    ("TECLADO", [(None, "Tipo", "Compacto")], "membrana", {"tipo": "Membrana", "tamanho": "Compacto"}),
    ("HEADSET", [(None, "Peso", "0,3 kg"), (None, "Impedância", "32 ohms (passiva), 60 ohms")], "Headset Bluetooth wireless driver 50 mm microfone 7.1 bateria 30 h", {"bluetooth": "true", "wireless": "true", "driverMm": "50", "microfone": "true", "somSurround": "true", "pesoGramas": "300", "impedancia": "32", "bateriaHoras": "30"}),
    ("MICROFONE", [(None, "Especificações", "Padrão polar: Cardioide | Conexão de saída: USB-C (no microfone) | Consumo de energia: 5 V | Taxa de amostragem: 24 bits/ 44,1 k - 96 k Hz")], None, {"padraoPolar": "Cardioide", "conexao": "USB-C", "taxaAmostragemKhz": "96"}),
    ("MICROFONE", [(None, "Conexão", "XLR")], "Taxa de amostragem de até 48 kHz", {"conexao": "XLR", "taxaAmostragemKhz": "48"}),
    ("OUTRA", [(None, "Socket", "AM5")], "x", {"socket": None}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, c, [*a, (None, "x", None), (None, None, "y")] if i % 2 else a, t) for i, (c, a, t, _) in enumerate(CASES)], SCHEMA)
    return {r.record_id: r.specs for r in specs.extract(rows, RULES).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_a_sheet_gives_its_fields(found, i):
    want = CASES[i][3]
    assert {k: found[i].get(k) for k in want} == want


def test_records_without_attributes_or_category(spark):
    rows = spark.createDataFrame([(1, "FONTE", None, "500 W"), (2, None, None, None), (3, "FONTE", [], None)], SCHEMA)
    got = {r.record_id: r.specs for r in specs.extract(rows, RULES).collect()}
    assert got == {1: {"potenciaWatts": "500"}, 2: {}, 3: {}}
    assert specs.long(specs.extract(rows, RULES)).where(F.col("field") == "potenciaWatts").count() == 1


def test_numbers_in_either_style(spark):
    rows = spark.createDataFrame([("6.000",), ("2.000.000 h",), ("1.234,5",), ("1,234.5",), ("7,5",), ("x",)], "t string")
    assert [r.g for r in rows.select(specs.grouped(F.col("t")).alias("g")).collect()] == ["6000", "2000000", "1234", "1234", "8", None]
