"""The rules of each category: fields, where their values stand and how they are read.

Fixed values throughout: names of attributes, labels and patterns are those under which shops and manufacturers give these data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .specs import Counted, Field, Held, Made, Names, Part, Sum, Text, Told, Total, Whole, Words, shown

_PRODUCT = lambda get: shown(get("_total").cast("double") / get("quantidadeModulos").cast("double"))
_CLOCK, _SIZE, _AMOUNT = r"([0-9.,]+\s*(?:GHz|MHz))", r"([0-9.,]+\s*(?:KB|MB|GB))", r"([0-9.,]+\s*(?:GB|TB))"

PROCESSOR = (
    Field("socket", "socket", Names("cpu_socket processor_socket socket soquete soquetes_compativeis sockets_supported"), Text(r"(?:Socket|Soquete)\s*:\s*([A-Za-z0-9+\-]+)"), Text(r"\b(AM[345]|(?:FC)?LGA\s*\d{3,4}|sTRX4|TR4|sWRX8)\b")),
    Field("familia", "text", Names("processor_family cpu_family familia_do_processador family"), Text(r"\b(?:AMD\s+)?(Ryzen)\s+[3579]\b", r"\b(Intel\s+Core)\s+(?:Ultra\s+)?[3579i]")),
    Field("linha", "text", Names("line processor_line linha_do_processador cpu_group"), Text(r"(?:Product\s+Collection\s*)?\d{1,2}(?:st|nd|rd|th)\s+Generation\s+(Intel\s+Core(?:\s+Ultra)?\s+[3579i]+)")),
    Field("geracao", "text", Names("processor_generation geracao_do_processador generation"), Text(r"(\d{1,2})(?:st|nd|rd|th)\s+Generation\s+(?:Intel|AMD)", r"(?:^|\n)\s*Generation\s*:?\s*(\d{1,2})")),
    Field("arquitetura", "text", Names("microarchitecture processor_microarchitecture microarquitetura arquitetura architecture", r"^(?!(?:x86[_-]64|x64|amd64|x86|ia-?32)$)(.+)$"), Text(r"Code\s+Name\s+(?:Products\s+formerly\s+)?([A-Za-z][A-Za-z0-9 -]{2,40}?)(?=\s+(?:Vertical\s+Segment|Processor\s+Number|Lithography|CPU\s+Specifications)|$)")),
    Field("litografiaNm", "integer", Text(r"(?:CMOS|Litografia|Processo\s+de\s+fabrica[cç][aã]o)\s*:\s*[^.;,\-]*?(\d+)\s*nm"), Names("lithography processor_lithography litografia processo_de_fabricacao technology"), Text(r"(?:Lithography|Process(?:\s+Technology)?|Manufacturing\s+Process)\s*:?\s*(\d+)\s*nm")),
    Field("nucleos", "integer", Text(r"(?:N[ºo°]\s*de\s*n[uú]cleos(?:\s*de\s*CPU)?|Quantidade\s*de\s*n[uú]cleos)\s*:\s*(\d+)"), Names("processor_cores_number cpu_cores_number cores_number quantidade_de_nucleos_do_processador numero_de_nucleos total_cores cores core_count cpu_cores of_cpu_cores"), Names("cpu_cores_threads cores_threads", r"(\d{1,3})\s*/\s*\d{1,3}"), Text(r"\b(\d{1,3})\s+n[uú]cleos?\b"), Text(r"(?:^|\n)\s*(?:Total\s+Cores|Core\s+Count)\s*:?\s*(\d{1,3})(?!\s*(?:GHz|MHz))")),
    Field("threads", "integer", Text(r"(?:N[ºo°]\s*de\s*threads|Quantidade\s*de\s*threads)\s*:\s*(\d+)"), Names("processor_threads_number threads_number quantidade_de_threads_do_processador numero_de_threads total_threads threads thread_count of_threads"), Names("cpu_cores_threads cores_threads", r"\d{1,3}\s*/\s*(\d{1,3})"), Text(r"\b(\d{1,3})\s+threads?\b"), Text(r"(?:^|\n)\s*(?:Total\s+Threads|Thread\s+Count)\s*:?\s*(\d{1,3})")),
    Field("frequenciaBaseMhz", "mhz", Text(rf"(?:Clock\s+b[aá]sico|Clock\s+base|Frequ[eê]ncia\s+base)\s*:\s*{_CLOCK}"), Names("processor_base_frequency base_clock_frequency frequencia_base clock_base base_frequency base_clock frequency"), Text(rf"(?:Processor\s+Base\s+Frequency|Base\s+Frequency|Base\s+Clock)\s*:?\s*{_CLOCK}")),
    Field("frequenciaTurboMhz", "mhz", Text(rf"(?:Clock\s+de\s+Max\s+Boost|Max\s+Boost|Clock\s+turbo|Frequ[eê]ncia\s+turbo(?:\s+m[aá]xima)?)\s*:\s*(?:At[eé]\s*)?{_CLOCK}"), Names("max_turbo_frequency processor_max_frequency frequencia_turbo_maxima frequencia_maxima maximum_turbo_frequency turbo_frequency_1_core turbo_frequency boost_clock"), Text(rf"\b{_CLOCK}\s+(?:Max\s+Turbo|Turbo\s+M[aá]x(?:imo)?)\b"), Text(rf"(?:Max\s+Turbo\s+Frequency|Maximum\s+Turbo\s+Frequency|Turbo\s+Frequency|Boost\s+Clock)\s*:?\s*{_CLOCK}")),
    Field("cacheL2Mb", "mb", Text(rf"Cache\s+L2(?:\s+total)?\s*:\s*{_SIZE}"), Names("l2_cache processor_l2_cache cache_l2")),
    Field("cacheL3Mb", "mb", Text(rf"Cache\s+L3(?:\s+total)?\s*:\s*{_SIZE}"), Names("l3_cache processor_l3_cache cache_l3 intel_smart_cache cache"), Text(rf"(?:Intel(?:®|\s)*Smart\s+Cache|L3\s+Cache)\s*:?\s*{_SIZE}")),
    Field("tdpWatts", "integer", Text(r"(?:TDP(?:\s*/\s*TDP\s*Padr[aã]o)?|Pot[eê]ncia\s+de\s+design\s+t[eé]rmico)\s*:\s*([0-9.,]+)\s*W"), Names("thermal_design_power processor_tdp tdp"), Text(r"(?:TDP|Thermal\s+Design\s+Power)\s*:?\s*([0-9.,]+)\s*W")),
    Field("tiposMemoriaSuportados", "memory_types", Names("ram_memory_type supported_ram_memory_types tipos_de_memoria_ram_suportados tipos_de_memoria_ram_suportadas tipo_de_memoria_ram tipo_de_memoria memory_types supported_memory_types memory_type"), Text(r"Mem[oó]ria\s*[-:]\s*([^.;\n]+)"), Text(r"(?:^|\n)\s*(?:Memory\s+Types?|Supported\s+Memory\s+Types?)\s*:?\s*([^;\n]{1,120})")),
    Field("frequenciaMemoriaMaximaMhz", "mhz", Text(r"Mem[oó]ria.{0,100}?Velocidade\s+m[aá]xima\s*:\s*([0-9.,]+\s*(?:MHz|GHz))"), Names("max_ram_memory_frequency max_memory_frequency frequencia_maxima_da_memoria"), Names("ram_memory_type supported_ram_memory_types tipos_de_memoria_ram_suportados tipo_de_memoria_ram tipo_de_memoria memory_types supported_memory_types memory_type", r"DDR[345]\s*[- ]\s*(\d{3,5})", "integer"), Text(r"(?:^|\n)\s*(?:Memory\s+Types?|Supported\s+Memory\s+Types?)\s*:?\s*[^;\n]{0,110}?DDR[345]\s*[- ]\s*(\d{3,5})", convert="integer")),
    Field("capacidadeMemoriaMaximaGb", "gb", Names("max_ram_memory_capacity max_memory_capacity capacidade_maxima_de_memoria max_memory_size_dependent_on_memory_type max_memory_size max_memory maximum_memory"), Text(rf"(?:Max\s+Memory\s+Size|Maximum\s+Memory(?:\s+Size)?)\s*(?:\([^)]*\))?\s*:?\s*{_AMOUNT}")),
    Field("canaisMemoria", "integer", Names("memory_channels_number memory_channels canais_de_memoria max_of_memory_channels"), Text(r"(?:Max\s*#?\s*of\s+Memory\s+Channels|Memory\s+Channels)\s*:?\s*(\d+)")),
    Field("suportaEcc", "flag", Names("ecc_support with_ecc suporta_ecc ecc_memory_supported ecc"), Text(r"ECC\s+Memory\s+Supported[^A-Za-z]*(Yes|No)")),
    Field("temperaturaMaximaC", "number", Text(r"(?:Temps?\s+m[aá]x|Temperatura\s+m[aá]xima)\s*:\s*([0-9.,]+)\s*[°º]?\s*C"), Names("max_operating_temperature max_temperature temperatura_maxima t_junction t_junction_max"), Text(r"(?:T[_ ]?JUNCTION|Tjunction|Maximum\s+Operating\s+Temperature)\s*:?\s*([0-9.,]+)\s*[°º]?\s*C")),
    Field("versaoPcie", "text", Names("pcie_version pci_express_version versao_pci_express versao_pcie interface pci_express_revision pcie", r"(\d+(?:[.,]\d+)?)"), Names("pcie_version pci_express_version versao_pci_express versao_pcie interface pci_express_revision pcie"), Text(r"(?:Vers[aã]o\s+do\s+PCI\s+Express|Vers[aã]o\s+PCIe?)\s*:\s*PCIe?\s*([0-9.]+)"), Text(r"(?:PCI\s+Express\s+Revision|PCIe?\s+Version)\s*:?\s*([0-9.]+)")),
    Field("lanesPcie", "integer", Names("pcie_lanes_number pci_express_lanes_number lanes_pcie max_of_pci_express_lanes"), Names("pcie_version pci_express_version versao_pci_express versao_pcie interface pci_express_revision pcie", r"(?:x|×)\s*(\d{1,2})\b"), Text(r"(?:Max\s*#?\s*of\s+PCI\s+Express\s+Lanes|PCIe?\s+Lanes)\s*:?\s*(\d+)")),
    Field("coolerIncluso", "flag", Names("cooler_included includes_cpu_cooler cooler_incluso"), Words((r"\bcom\s+cooler\b", r"\bcooler\s+inclus[oa]\b"), (r"\bsem\s+cooler\b", r"\bS(?:/|\s)\s*Cooler\b")), Text(r"(?:Solu[cç][aã]o\s+t[eé]rmica\s*\(Cooler\)|Cooler\s+incluso|Inclui\s+cooler)\s*:\s*([^\-;\n]+)", convert="unless_none")),
    Field("multiplicadorDesbloqueado", "flag", Names("unlocked_multiplier multiplicador_desbloqueado multiplier_unlocked"), Text(r"\bDesbloqueado\s*:\s*(Sim|N[aã]o)")),
    Field("suporteOverclock", "flag", Names("overclock_support suporta_overclock overclocking")),
    Field("dataLancamento", "text", Names("release_date launch_date data_de_lancamento"), Text(r"(?:Launch\s+Date|Release\s+Date)\s*:?\s*([A-Za-z0-9' ./-]{2,30})")),
    Field("modeloVideoIntegrado", "text", Text(r"Modelo\s+Gr[aá]fico\s*:\s*([A-Za-z0-9][A-Za-z0-9 .+\-]+?)(?=\s+-\s+|\n|$)"), Names("processor_graphics integrated_graphics gpu_name igpu", r"^(?!(?:no[ _]igpu|no[ _]integrated[ _]graphics|none|n[aã]o|no)\b)(.+)$")),
    Field("possuiVideoIntegrado", "flag", Made(lambda get: F.when(get("modeloVideoIntegrado").isNotNull(), "true")), Names("processor_graphics integrated_graphics gpu_name igpu", r"^(no|none|n[aã]o)\b", "absent"),
          Words((r"\b(?:integrated|processor)\s+graphics\s*:?\s*(?!no\b|none\b)[A-Za-z0-9]", r"\bv[ií]deo\s+integrado\b", r"\bgr[aá]ficos?\s+integrados?\b"), (r"\bwithout\s+(?:an\s+)?integrated\s+graphics(?:\s+unit)?\b", r"\bno\s+iGPU\b", r"\bintegrated\s+graphics\s*:?\s*(?:no|none)\b", r"\bsem\s+v[ií]deo\s+integrado\b", r"\bn[aã]o\s+possui\s+v[ií]deo\s+integrado\b", r"\bsem\s+gr[aá]ficos?\s+integrados?\b", r"\bS(?:/|\s)\s*V[ií]deo\b"))),
)

_BOARD_MEMORY = "ram_memory_type memory_type memory_standard tipo_de_memoria_ram tipo_de_memoria memoria"
_STORED = "interface_de_armazenamento armazenar armazenamento"
BOARD = (
    Field("socket", "socket", Names("cpu_socket socket soquete soquete_do_processador socket_do_processador"), Text(r"(?:Socket|Soquete)(?:\s+do\s+Processador)?\s*:?[ \t]*(LGA\s*\d{3,4}|AM[345]|sTRX4|TR4|sWRX8|[A-Za-z]{1,4}\d{2,4})")),
    Field("chipset", "text", Names("chipset"), Text(r"Chipset\s*:\s*([A-Za-z]{0,12}\s*[A-Z]?[0-9]{3,4})\b")),
    Field("formato", "board_form", Names("form_factor motherboard_form_factor formato formato_da_placa_mae"), Text(r"(?:Formato(?:\s+da\s+Placa[- ]M[aã]e)?|Form\s*Factor)\s*:\s*([^,;|\n]+)")),
    Field("revisao", "text", Names("revision revisao")), Field("biosInicial", "text", Names("initial_bios bios_inicial")),
    Field("tiposMemoriaSuportados", "memory_types", Names(_BOARD_MEMORY), Text(r"(?:Mem[oó]ria|Memory)\s*:\s*([^.;\n]+)")),
    Field("formatosMemoriaSuportados", "module_form", Names(_BOARD_MEMORY, r"\b(SO[-_ ]?DIMM|U?DIMM)\b"), Text(r"\b(SO[-_ ]?DIMM)\b", r"\b(U?DIMM)\b")),
    Field("slotsMemoria", "integer", Names("ram_slots_number memory_slots_number quantidade_de_slots_de_memoria ramslots ram_slots memory_slots"), Names(_BOARD_MEMORY, r"\b(\d+)\s*(?:slots?|x)\s*(?:DDR[345]\s*)?(?:U?DIMM|SO[-_ ]?DIMM)?\b"), Text(r"\b(\d+)\s+slots?\s+(?:DDR[345]\s+)?(?:de\s+)?mem[oó]ria\b"), Text(r"\b(\d+)\s*[xX]\s*(?:DDR[345]\s*)?(?:U?DIMM|SO[-_ ]?DIMM)(?:\s+DDR[345])?\b")),
    Field("capacidadeMaximaMemoriaGb", "gb", Names("max_ram_memory_capacity max_memory_capacity capacidade_maxima_de_memoria memory_capacity maximum_memory max_memory memoria_da_placa_mae"), Text(rf"(?:Suporte\s+m[aá]ximo\s+de|Mem[oó]ria\s+m[aá]xima|Capacidade\s+m[aá]xima(?:\s+de\s+mem[oó]ria)?)\s*:?[ \t]*{_AMOUNT}")),
    Field("portasSata", "integer", Names("sata_ports_number quantidade_de_portas_sata sata sata_ports"), Names(_STORED, r"\b(\d+)\s*(?:(?:conectores?|portas?)\s+|[xX]\s*)SATA\b"), Text(r"\b(\d+)\s*(?:(?:conectores?|portas?)\s+|[xX]\s*)SATA\b")),
    Field("slotsM2", "integer", Names("m2_slots_number quantidade_de_slots_m_2 slots_m_2"), Sum(tuple(f"m_2_pci_e_{g}_0 m_2_pcie_{g}_0 m2_pci_e_{g}_0 m2_pcie_{g}_0" for g in (3, 4, 5))), Names(_STORED, r"\b(\d+)\s*(?:(?:conectores?|slots?)\s+|[xX]\s*)M\.?2\b"), Text(r"\b(\d+)\s*(?:(?:conectores?|slots?)\s+|[xX]\s*)M\.?2\b")),
    Field("versaoPcie", "text", Names("pcie_version pci_express_version versao_pcie", r"([345](?:[.,]0)?)"), Counted(tuple((f"{g}.0", f"pci_e_{g}_0_x{w} pcie_{g}_0_x{w} pci_express_{g}_0_x{w}") for g in (5, 4, 3) for w in (1, 4, 8, 16)), one=True), Text(r"(?:slot\s+principal\s+)?PCI(?:e|[- ]?E)?\s*([345](?:\.0)?)\s*x?16", r"PCI(?:e|[- ]?E)?\s*([345](?:\.0)?)")),
    Field("ethernet", "text", Names("ethernet lan rede")),
    Field("wifi", "flag", Names("with_wifi has_wifi wi_fi"), Words((r"\bWi[- ]?Fi\s*(?:6E?|7)?\b",))), Field("bluetooth", "flag", Names("with_bluetooth has_bluetooth bluetooth"), Words((r"\bBluetooth\s*[45](?:\.\d)?\b",))),
    Field("suportaXmp", "flag", Words((r"\bXMP\b",))), Field("suportaExpo", "flag", Words((r"\bEXPO\b",))),
    Field("suportaEcc", "flag", Words((r"\bsuporte\s+(?:para\s+)?(?:m[oó]dulos?\s+)?ECC\b|\bsuporta\s+ECC\b",)), Words((), (r"\b(?:apenas\s+)?non[- ]?ECC\b|\bmem[oó]ria\s+n[aã]o\s+ECC\b|\bn[aã]o\s+suporta\s+ECC\b",))),
    Field("suportaMemoriaRegistrada", "flag", Words((), (r"\b(?:sem\s+buffer|unbuffered)\b",))), Field("biosFlashback", "flag", Words((r"\bBIOS\s+Flashback\b|\bFlash\s+BIOS\b|\bQ[- ]Flash\s+Plus\b",))),
    Field("capacidadeMaximaPorSlotGb", "gb", Names("max_memory_per_slot max_dimm_capacity maximum_dimm_capacity capacidade_maxima_por_slot"), Text(rf"(?:Maximum\s+DIMM\s+Capacity|Max(?:imum)?\s+Memory\s+per\s+Slot|Capacidade\s+m[aá]xima\s+por\s+slot)\s*:?\s*{_AMOUNT}")),
    Field("biosMinima", "text", Names("minimum_bios min_bios_version minimum_bios_version bios_minima"), Text(r"(?:Minimum\s+BIOS(?:\s+Version)?|BIOS\s+m[ií]nima)\s*:?\s*([A-Za-z0-9._-]+)")),
    Field("saidasVideo", "text", Counted((("HDMI", "hdmi hdmi_ports"), ("DisplayPort", "display_port displayport displayport_ports"), ("DVI", "dvi dvi_ports"), ("VGA", "vga vga_ports"))), Held((("HDMI", r"\bHDMI\b"), ("DisplayPort", r"\bDisplay\s*Port\b|\bDP\b"), ("DVI", r"\bDVI\b"), ("VGA", r"\bVGA\b")))),
)

_DESKTOP = r"\b(?:Vengeance\s+LPX|Dominator\s+Platinum(?:\s+RGB)?)\b.*\bDDR4\b|\bDDR4\b.*\b(?:Vengeance\s+LPX|Dominator\s+Platinum(?:\s+RGB)?)\b"
_KIT = r"\b(\d+)\s*[xX]\s*\d+(?:[.,]\d+)?\s*GB\b"
MEMORY = (
    Field("tipo", "memory_type", Whole("ram_memory_type memory_type memory_standard ram_type tipo_de_memoria_ram tipo_de_memoria")),
    Field("formato", "module_form", Names("ram_form_factor form_factor memory_form_factor module_type formato"), Whole(), Told(r"\b(?:Vengeance\s+LPX|Dominator\s+Platinum)\b", "DIMM")),
    Field("quantidadeModulos", "integer", Text(_KIT), Names("modules_number number_of_modules modules sticks quantidade_de_modulos"), Text(r"\bKit\s+(?:of\s+)?(\d+)\b", r"\b(\d+)\s+(?:sticks?|modules?)\b"), Told(r"\bDual[- ]Kit\b", "2")),
    Field("_total", "gb", Names("total_capacity memory_size size capacity capacidade_total"), Text(r"\bSize\s*:?[ \t]*(\d+(?:[.,]\d+)?\s*GB)\b", r"\b(\d+(?:[.,]\d+)?\s*GB)\s+DDR[345](?:[- ]\d{3,5})?")),
    Field("capacidadePorModuloGb", "number", Text(r"\b\d+\s*[xX]\s*(\d+(?:[.,]\d+)?)\s*GB\b"), Names("capacity_per_module module_capacity capacidade_por_modulo", convert="gb"), Made(_PRODUCT)),
    Field("frequenciaMhz", "mhz", Names("ram_memory_speed memory_speed memory_clock frequency clock frequencia velocidade_da_memoria velocidade_de_clock"), Text(r"\bDDR[345][ -](\d{3,5})\b", convert="integer"), Text(r"\b([0-9]{3,5}\s*MHz)\b")),
    Field("frequenciaJedecMhz", "mhz", Names("jedec_frequency jedec_speed frequencia_jedec")),
    Field("latenciaCl", "integer", Names("cas_latency latency cl latencia_cas latencia_cl latencia"), Text(r"\bCL\s*(\d{1,3})\b", r"\bTimings\s+(\d{1,3})(?:[-–]\d+){1,4}\b")),
    Field("tensaoVolts", "number", Names("voltage memory_voltage tensao voltagem"), Text(r"(?:Tens[aã]o|Voltagem|Voltage)\s*:?\s*([0-9.,]+)\s*V", r"\b([12][.,]\d{1,3})\s*V\b")),
    Field("alturaMm", "number", Names("height module_height altura"), Text(r"(?:Module\s+Height|Height|Altura)\s*:?\s*([0-9.,]+)\s*mm")),
    Field("ecc", "flag", Names("ecc with_ecc error_correcting_code ecc_support"), Words((r"\bECC\b",), (r"\bnon[- ]?ECC\b|\bwithout\s+ECC\b|\bsem\s+ECC\b", rf"^(?!.*\bECC\b).*?(?:{_DESKTOP})"))),
    Field("registrada", "flag", Names("registered buffered memoria_registrada"), Words((r"\bregistered\b|\bRDIMM\b",), (r"\bunbuffered\b|\bunregistered\b|\bUDIMM\b", rf"^(?!.*(?:\bregistered\b|\bRDIMM\b)).*?(?:{_DESKTOP})"))),
    Field("suportaXmp", "flag", Names("xmp intel_xmp xmp_support", r"^(sim|yes|true|possui|incluso|inclu[ií]do|com|compat[ií]vel)$"), Words((r"\bXMP\b", _DESKTOP))),
    Field("suportaExpo", "flag", Names("expo amd_expo expo_support", r"^(sim|yes|true|possui|incluso|inclu[ií]do|com|compat[ií]vel)$"), Words((r"\bEXPO\b",))),
    Field("rgb", "flag", Names("rgb led_lighting lighting"), Words((r"\b(?:RGB|ARGB)\b",))),
    Field("consumoWatts", "number", Names("power_consumption consumo"), Text(r"(?:Power\s+Consumption|Consumo)\s*:?\s*([0-9.,]+)\s*W")),
)

_GPU_NAMES = (
    r"\b(AMD\s+Radeon\s+(?:RX\s*\d{3,4}(?:M|S)?(?:\s*(?:XTX|XT|GRE))?|HD\s*\d{3,4}M?|R\d\s*M?\d{3}|VII))\b", r"\b(NVIDIA\s+GeForce\s+(?:RTX|GTX|GT|GTS)\s*\d{3,4}(?:\s*(?:Ti|SUPER))?)\b",
    r"\b(Intel\s+Arc\s+[A-Z]\d{3,4})\b", r"\b((?:Radeon\s+)?(?:RX\s*\d{3,4}(?:M|S)?(?:\s*(?:XTX|XT|GRE))?|HD\s*\d{3,4}M?)|(?:RTX|GTX)\s*\d{3,4}(?:\s*(?:Ti|SUPER))?)\b",
)
_GPU_MODEL = "gpu_model graphics_processor gpu modelo_da_gpu graphics_card"
_BUS = "bus_interface barramento versao_pci_express pcie_version pci_express_version"
_GPU_POWER, _GPU_SIZES = "power_connectors conexoes requisitos", "dimensions dimensoes"
_KINDS = r"(?:GDDR[3567X]+|DDR[345]|HBM2E?|HBM3E?)"
_OUT = "display_outputs outputs saidas"


def _ways(tokens: str, *patterns: str) -> tuple:
    """A part of an attribute, or, where there is none, of the text."""
    return (Part(tokens, patterns),)


def _ports(name: str) -> tuple[str, ...]:
    """How pages count ports of a name; a version behind the name is no count."""
    return (rf"(\d+)\s*(?:[xX]\s*)?{name}", rf"(?:quantidade\s+de\s+|portas?\s+|conectores?\s+){name}\s*[:x-]?\s*(\d+)", rf"{name}\s*[:x-]\s*(\d+)\s*(?:portas?|conectores?)")


_OUTPUTS = lambda get: F.concat_ws(", ", F.when(get("hdmi") != "0", F.concat(get("hdmi"), F.lit("x HDMI"))), F.when(get("displayPort") != "0", F.concat(get("displayPort"), F.lit("x DisplayPort"))))
GRAPHICS = (
    Field("chipset", "text", Names("chipset gpu_chipset gpu_chip gpu_name")),
    Field("gpu", "text", Names(_GPU_MODEL, r"^(?!.*\b(?:s[eé]rie|series)\b)(.+?)(?:\s+(?:Rebrand\s+)?Specs\s*)?$"), Text(*_GPU_NAMES), Names(_GPU_MODEL)),
    Field("arquitetura", "text", Names("gpu_architecture architecture arquitetura"), Text(r"\b(RDNA\s*\d(?:\.\d)?)\b", r"\b(?:NVIDIA\s+)?(Turing|Ampere|Ada Lovelace|Blackwell|Pascal|Maxwell|Kepler|Fermi)\b", r"\b(GCN(?:\s*[0-9.]+)?|Vega|Polaris|Navi(?:\s*\d+)?)\b", r"(?:Architecture|Arquitetura)\s*:?\s*([A-Za-z][A-Za-z0-9 _-]{2,32})(?=\s*[|;\n.]|$)")),
    Field("memoriaVideoGb", "gb", Names("vram vram_memory_capacity graphics_memory_capacity memory_size video_memory memoria_de_video capacidade"), Text(r"(?:Memory\s+Size|Video\s+Memory|VRAM)\s*:?\s*(\d+(?:[.,]\d+)?\s*(?:GB|MB))"), Text(r"\b(\d+(?:[.,]\d+)?\s*(?:GB|MB))\s*,?\s*(?:GDDR[3567X]+|DDR[345]|HBM)")),
    Field("tipoMemoriaVideo", "upper", Names("vram_type graphics_memory_type memory_type tipo_de_memoria_de_video tipo_de_memoria"), Text(rf"\b({_KINDS})\b")),
    Field("barramentoBits", "integer", Names("memory_bus_width bus_width barramento_de_memoria interface_de_memoria"), Text(r"(?:Bus\s+Width|Memory\s+Bus|Barramento|Interface\s+de\s+Mem[oó]ria)\s*:?\s*(\d+)\s*bits?"), Text(rf"\b\d+(?:[.,]\d+)?\s*(?:GB|MB)\s*,?\s*{_KINDS}\s*,?\s*(\d{{2,4}})\s*bit")),
    Field("clockBaseMhz", "mhz", Names("gpu_base_clock base_clock gpu_clock clock_base clock_do_processador_de_video clock_do_processador_grafico velocidade_do_processador_grafico velocidade_de_clock_do_processador_grafico frequencia_do_processador_grafico"), Text(r"(?:GPU\s+Clock|Clock\s+base|Base\s+Clock)\s*(?:at[eé]\s*)?:?\s*([0-9.,]+\s*MHz)")),
    Field("clockBoostMhz", "mhz", Names("gpu_boost_clock boost_clock clock_boost clock_de_boost frequencia_boost"), Text(r"(?:Boost\s+Clock|Clock\s+boost|Clock\s+de\s+refor[cç]o)\s*(?:at[eé]\s*)?:?\s*([0-9.,]+\s*MHz)")),
    Field("geracaoPcie", "integer", *_ways(_BUS, r"PCI(?:e|[- ]?E|\s+Express)?\s*([345](?:\.0)?)")),
    Field("larguraPcie", "integer", *_ways(_BUS, r"PCI(?:e|[- ]?E|\s+Express)?\s*[345](?:\.0)?\s*[xX]\s*(\d+)", r"PCIe\s*[xX](\d+)\s*[345](?:\.0)?")),
    Field("comprimentoMm", "mm", Names("length card_length comprimento"), Text(r"(?:(?:Card\s+)?Length|Comprimento)\s*:?\s*([0-9]+(?:[.,][0-9]+)?\s*(?:mm|cm))"), Names(_GPU_SIZES, convert="card_1"), Text(r"(?:Card\s+)?Dimensions\s*:?\s*([^|\n]+)", convert="card_1")),
    Field("alturaMm", "mm", Names("height card_height altura"), Text(r"(?:(?:Card\s+)?Height|Altura)\s*:?\s*([0-9]+(?:[.,][0-9]+)?\s*(?:mm|cm))"), Names(_GPU_SIZES, convert="card_2"), Text(r"(?:Card\s+)?Dimensions\s*:?\s*([^|\n]+)", convert="card_2")),
    Field("espessuraMm", "mm", Names("thickness card_thickness espessura"), Text(r"(?:(?:Card\s+)?Thickness|Espessura)\s*:?\s*([0-9]+(?:[.,][0-9]+)?\s*(?:mm|cm))"), Names(_GPU_SIZES, convert="card_3"), Text(r"(?:Card\s+)?Dimensions\s*:?\s*([^|\n]+)", convert="card_3")),
    Field("slotsOcupados", "number", Names("slots slot_width perfil_do_cartao slots_ocupados"), Text(r"(?:Slot\s+Width|Slots?\s+ocupados|Perfil\s+do\s+cart[aã]o)\s*:?\s*([0-9.,]+)\s*(?:slots?)?")),
    Field("consumoWatts", "integer", Names("power_consumption tdp board_tdp tgp tbp power_draw consumo"), Text(r"(?:TDP|TGP|TBP|Board\s+TDP|Power\s+Draw|Consumo)\s*:?\s*(\d{2,4})\s*W", r"power\s+draw\s+is\s+rated\s+at\s+(\d{2,4})\s*W")),
    Field("potenciaFonteRecomendadaWatts", "integer", Names("recommended_psu_power suggested_psu recommended_psu fonte_recomendada"), Text(r"(?:Suggested|Recommended)\s+PSU\s*:?\s*(\d{3,4})\s*W", r"Fonte\s+recomendada\s*:?\s*(\d{3,4})\s*W", r"Requisito\s+m[ií]nimo\s+de\s+alimenta[cç][aã]o\s*:?\s*(\d{3,4})\s*(?:W|watts?)")),
    Field("conectoresPcie8Pinos", "integer", *_ways(_GPU_POWER, r"(\d+)\s*[xX]\s*(?:PCI[- ]?E\s*)?8[- ]?pin")), Field("conectoresPcie6Pinos", "integer", *_ways(_GPU_POWER, r"(\d+)\s*[xX]\s*(?:PCI[- ]?E\s*)?6[- ]?pin")),
    Field("conectores12vhpwr", "integer", *_ways(_GPU_POWER, r"(\d+)\s*[xX]\s*(?:12VHPWR|16[- ]?pin)")), Field("conectores12v2x6", "integer", *_ways(_GPU_POWER, r"(\d+)\s*[xX]\s*12V[- ]?2x6")),
    Field("hdmi", "integer", Names("hdmi_ports hdmi"), *_ways(_OUT, r"DisplayPort\s*(?:2\.1)?\s*:\s*\d+\s*[xX]\s*HDMI\s*(?:\|\s*)?(?:2\.1)?\s*:\s*(\d+)\s*[xX]"), *_ways(_OUT, *_ports("HDMI"))),
    Field("displayPort", "integer", Names("displayport_ports displayport"), *_ways(_OUT, r"DisplayPort\s*(?:2\.1)?\s*:\s*(\d+)\s*[xX]\s*HDMI\s*(?:\|\s*)?(?:2\.1)?\s*:\s*\d+\s*[xX]"), *_ways(_OUT, *_ports(r"(?:Display\s*Port|DP)"))),
    Field("saidasVideo", "text", Made(lambda get: F.nullif(_OUTPUTS(get), F.lit("")))),
)

_DETAILS, _SIDES, _M2 = "especificacoes recursos", "dimensao dimensoes dimensoes_do_produto", ("formato", "M2")
_RATE = r"([0-9.,]+)\s*MB\s*/?\s*s?"
STORAGE = (
    Field("tipo", "storage_type", Whole("storage_type type tipo")), Field("formato", "storage_format", Whole("form_factor formato fator_de_forma")),
    Field("interface", "interface", Whole("interface storage_interface interface_de_conexao conectividade")),
    Field("capacidadeGb", "gb", Names("storage_capacity capacidade_do_armazenamento capacidade_de_armazenamento capacity capacidade"), Text(rf"\b{_AMOUNT}\b")),
    Field("tamanhoM2Mm", "m2_length", Names(_SIDES, r"^\D*22(?:[.,]0+)?\s*(?:mm)?\s*[x×]\s*(30|42|60|80|110)\b", "integer"), Names("m2_size tamanho_m_2 comprimento_m_2"), Whole(), only=_M2),
    Field("larguraMm", "side_1", Names(_SIDES), only=_M2), Field("profundidadeMm", "side_2", Names(_SIDES), only=_M2), Field("espessuraMm", "side_3", Names(_SIDES), only=_M2),
    Field("chaveM2", "m2_key", Names("m2_key chave_m_2 chave tipo_de_chave key"), Text(r"\b((?:B\s*(?:\+|&|/|-|_)\s*M|[BM])\s*[- ]?Key)\b", r"\b((?:Key|Chave)(?:\s+M\.?2)?\s*[:\-]?\s*(?:B\s*(?:\+|&|/|-|_)\s*M|[BM]))\b"), only=_M2),
    Field("geracaoPcie", "integer", Names("pcie_version pci_express_version geracao_pcie"), Text(r"PCIe?\s*(?:Gen\s*)?([345])(?:\.0)?")),
    Field("pistasPcie", "integer", Names("pcie_lanes pistas_pcie"), Text(r"PCIe?.{0,10}[xX](\d+)")),
    Field("leituraSequencialMbps", "grouped", Names("sequential_read_speed read_speed leitura_sequencial", convert="integer"), *_ways(_DETAILS, rf"Leitura\s*/\s*(?:escrita|grava[cç][aã]o)\s+sequencial\s*:\s*([0-9.,]+)\s*/\s*[0-9.,]+\s*MB\s*/?\s*s"), Text(rf"(?:Leitura\s+sequencial|Leitura)\s*:?\s*(?:de\s+)?(?:at[eé]\s*)?{_RATE}")),
    Field("escritaSequencialMbps", "grouped", Names("sequential_write_speed write_speed escrita_sequencial", convert="integer"), *_ways(_DETAILS, rf"Leitura\s*/\s*(?:escrita|grava[cç][aã]o)\s+sequencial\s*:\s*[0-9.,]+\s*/\s*([0-9.,]+)\s*MB\s*/?\s*s"), Text(rf"(?:Escrita\s+sequencial|Grava[cç][aã]o(?:\s+sequencial)?|Write)\s*:?\s*(?:de\s+)?(?:at[eé]\s*)?{_RATE}")),
    Field("possuiDissipador", "flag", Names("with_heatsink heatsink possui_dissipador"), Words((r"\bcom\s+dissipador\b", r"\bheatsink\b"), (r"\bsem\s+dissipador\b",))),
)

_SUPPLY, _PLUGS = "especificacoes", "conectores_da_fonte conectores"


def _plugs(name: str, short: str, pins: str, *more: str) -> tuple:
    return _ways(_PLUGS, rf"(\d+)\s*[xX]\s*{short}\b", rf"Conector\s+{name}\s*:\s*(\d+)", rf"{pins}\s*(\d+)", *more)


SUPPLY = (
    Field("formato", "supply_form", Names("form_factor formato padrao_de_conexao padrao_de_conexao_da_fonte"), Text(r"(?:Fator\s+de\s+forma|Formato|Form\s*Factor)\s*:?[ \t]*([^,;|\n]+)"), Whole()),
    Field("potenciaWatts", "integer", Names("power power_output potencia"), Text(r"\b(\d{3,4})\s*W\b")),
    Field("certificacao", "text", Names("efficiency_certification certification certificacao certificacoes"), Text(r"\b(80\s*Plus\s*(?:White|Bronze|Silver|Gold|Platinum|Titanium)?)\b")),
    Field("modularidade", "modularity", Names("modularity modularidade"), *_ways(_SUPPLY, r"\bModular\s*:?\s*(N[aã]o|Sim|Semi[- ]?modular|Completamente|Totalmente)"), Whole()),
    Field("comprimentoMm", "side_1", Names("dimensoes_do_produto"), *_ways(_SUPPLY, r"Dimens[oõ]es\s*:?\s*([^|]+)")), Field("larguraMm", "side_2", Names("dimensoes_do_produto"), *_ways(_SUPPLY, r"Dimens[oõ]es\s*:?\s*([^|]+)")), Field("alturaMm", "side_3", Names("dimensoes_do_produto"), *_ways(_SUPPLY, r"Dimens[oõ]es\s*:?\s*([^|]+)")),
    Field("padraoAtx", "text", Names("atx_standard padrao_atx padrao_de_conexao_da_fonte", r"(\d+(?:\.\d+)?)"), Text(r"\bATX(?:12V)?\s*(3\.[01])\b")),
    Field("eficienciaPercentual", "number", Names("efficiency eficiencia", convert="percent"), *_ways(_SUPPLY, r"efici[eê]ncia[^|%]{0,80}?(\d{2,3}(?:[.,]\d+)?)\s*%")),
    Field("correnteLinha12vAmperes", "number", Names("12v_current corrente_linha_12v")),
    Field("conectoresAtx24Pinos", "integer", *_plugs("ATX", "ATX", r"ATX\s*\(\s*24\s*pinos?\s*\)", r"(\d+)\s*[xX]\s*Placa[- ]m[aã]e\s+ATX")), Field("conectoresEpsCpu", "integer", *_plugs("EPS", "EPS", r"EPS\s*\(\s*8\s*pinos?\s*\)"), Total(_PLUGS, r"(\d+)\s*[xX]\s*CPU\s*/\s*Processador\s*\((?:P4\+4|P8|EPS)[^)]*\)")),
    Field("conectoresPcie8Pinos", "integer", *_plugs("PCIe", "PCIe", r"PCI[- ]?E\s*\(\s*6\s*\+\s*2\s*pinos?\s*\)", r"(\d+)\s*[xX]\s*GPU\s*/\s*Placa\s+de\s+V[ií]deo\s*\(PCI[- ]?E\s*6\+2\s*pinos?\)")),
    Field("conectoresSata", "integer", *_plugs("SATA", "SATA", r"SATA\s*\(\s*15\s*pinos?\s*\)", r"(\d+)\s*[xX]\s*Armazenamento\s*/\s*HD\s*/\s*SSD\s*\(SATA\s*15\s*pinos?\)")), Field("conectoresMolex", "integer", *_plugs("(?:PATA|MOLEX)", "(?:PATA|MOLEX)", r"MOLEX\s*\(\s*4\s*pinos?\s*\)")),
    Field("conectoresPcie6Pinos", "integer", Names("pcie_6_pin_connectors pcie_6_pinos"), *_ways(_PLUGS, r"(\d+)\s*[xX]\s*GPU\s*/\s*Placa\s+de\s+V[ií]deo\s*\(PCI[- ]?E\s*6\s*pinos?\)")), Field("conectores12vhpwr", "integer", Names("12vhpwr_connectors 12vhpwr")),
    Field("conectores12v2x6", "integer", Text(r"\b(\d+)\s*[xX]\s*(?:cabo|conector)\s+(?:nativo\s+)?12V[- ]?2x6\b"), Text(r"\bcabo\s+nativo\s+(1)2V[- ]?2x6\b")),
    Field("tensaoEntrada", "text", Names("input_voltage tensao_de_entrada"), *_ways(_SUPPLY, r"Faixa\s+de\s+tens[aã]o\s+de\s+entrada\s*:?\s*([^|\n]+)")),
    Field("protecoes", "text", Held(tuple((x, rf"\b{x}\b") for x in ("OVP", "OCP", "OPP", "OTP", "SCP", "UVP", "SIP")), _SUPPLY)),
)

CATEGORIES = {"PROCESSADOR": PROCESSOR, "PLACA_MAE": BOARD, "MEMORIA_RAM": MEMORY, "PLACA_VIDEO": GRAPHICS, "ARMAZENAMENTO": STORAGE, "FONTE": SUPPLY}
