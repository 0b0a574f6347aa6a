"""Registered queries of names, descriptions and action plans: hard cases by part, answers by hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import wording
from ..operators import actions
from .cases import _lit, cases
from .catalogue import query, rows

cases("technical_names", ["name", "brand", "model", "category"], ["technical"], [
    ("Placa de Vídeo RTX 4060 8GB", None, None, None, "Placa de Vídeo RTX 4060 8GB"), ("Nome do produto: SSD NV2 1TB | Kabum", None, None, None, "SSD NV2 1TB"), ("Conheça o Mouse G502", None, None, None, "Mouse G502"), ("Mouse G502 - oferece um desempenho", None, None, None, "Mouse G502"),
    ("Monitor 24 (Frete Grátis) FHD", None, None, None, "Monitor 24 FHD"), ("Teclado K2 - R$ 300,00 à vista", None, None, None, "Teclado K2"), ("Headset X. Som incrível", None, None, None, "Headset X"), ("<b>Fonte</b> 650W<br>Garantia de 3 anos", None, None, None, "Fonte 650W"),
    ("Promoção", "Corsair", "RM750", "fonte", "Fonte Corsair RM750"), ("Desde 1990 fazemos", "Corsair", "Corsair RM750", None, "Corsair RM750"), ("a " * 29 + "b", "M", "Z9", None, "M Z9"), ("a " * 29 + "b", None, None, None, "a " * 28 + "a"), ("x" * 201, None, None, None, ""), ("", None, None, None, ""), (None, None, None, None, ""),
], lambda name, brand, model, category: [wording.technical_name(name, brand, model, category)])

cases("descriptions", ["category", "name", "facts", "original"], ["made"], [
    ("MONITOR", "M1", "Tela: 24 pol.|Painel: IPS", None, "M1\nTela: 24 pol.\nPainel: IPS"), ("CELULAR", "C", "a: 1|b: 2|c: 3|d: 4|e: 5", None, "a: 1 · b: 2 · c: 3 · d: 4"), ("PC_MONTADO", "P", "a: 1", "Config <b>X</b>", "Config X"), ("PC_MONTADO", "P", "a: 1", " ", "P\na: 1"),
    ("MOUSE", "M", None, "Sensor óptico de 800 dpi. Compre já! Cabo USB. Bonito.", "Sensor óptico de 800 dpi.\nCabo USB."), ("MOUSE", "M", None, "Bonito.", None), (None, None, "a: 1", None, "a: 1"), (None, None, None, None, None),
    ("SSD", "S", "|".join(f"f{i}: v" for i in range(14)), None, "\n".join(["S", *(f"f{i}: v" for i in range(12))])),
], lambda category, name, facts, original: [wording.description(category, name, F.split(facts, r"\|"), original)])

_facts = lambda text: F.transform(F.split(text, r"\|"), lambda p: F.struct(F.get(F.split(p, "="), F.lit(0)).alias("label"), F.get(F.split(p, "="), F.lit(1)).alias("value")))
cases("short_descriptions", ["facts"], ["made"], [
    ("Marca=Asus|Modelo= X  1 |Cor=|marca=ASUS", "Marca: Asus · Modelo: X 1"), ("=x|Cor", None), ("|".join(f"f{i}=v" for i in range(20)), " · ".join(f"f{i}: v" for i in range(18))), ("a=" + "x" * 500, "a: " + "x" * 446 + "…"), ("a=" + "x" * 447, "a: " + "x" * 447), (None, None),
], lambda facts: [wording.short_description(_facts(facts))])

cases("field_questions", ["name", "category", "fields"], ["asked"], [
    ("RTX  4060", "placa_video", "gpu,tdp,gpu, ", "Informe as especificações confirmadas de RTX 4060, categoria PLACA_VIDEO:\n- gpu\n- tdp"), (None, None, None, "Informe as especificações confirmadas de hardware, categoria HARDWARE:\n- Nenhum campo técnico pendente"),
], lambda name, category, fields: [wording.question(name, category, F.split(fields, ","))])

# Action plans: what the jobs before found of a record, and the plan worked out by hand (actions; blockers; review).
_NEW = {"kind": "HARDWARE", "hw_status": "NONE", "prod_status": "NONE"}
_OLD = {"kind": "HARDWARE", "hw_id": 1, "hw_status": "MATCH", "hw_linked": 7, "prod_status": "NONE"}
_SHOP = {"url": "https://a.example/x", "partner_id": 3, "price": 10.0}
PLANS = [
    (_OLD, "", "", "false"), (_OLD | {"hw_fills": 2}, "ATUALIZAR_HARDWARE_CAMPOS_VAZIOS", "", "false"), (_OLD | {"spec_fills": 2, "spec_lacking": 1}, "", "ESPECIFICACAO_HARDWARE_AINDA_INCOMPLETA", "true"),
    (_OLD | {"spec_fills": 2, "hw_fills": 1, "prod_fills": 1}, "ATUALIZAR_HARDWARE_CAMPOS_VAZIOS,ATUALIZAR_PRODUTO_CAMPOS_VAZIOS", "", "false"), (_OLD | _SHOP, "CRIAR_OFERTA", "", "true"), (_OLD | _SHOP | {"offer_status": "MATCH", "offer_id": 5, "offer_fills": 1}, "ATUALIZAR_OFERTA", "", "false"),
    (_OLD | _SHOP | {"offer_status": "MATCH", "offer_id": 5}, "", "", "false"), (_OLD | _SHOP | {"offer_status": "AMBIGUOUS"}, "", "OFERTA_AMBIGUA_NO_CADASTRO", "true"), (_OLD | _SHOP | {"available": False}, "", "BACKEND_NAO_CRIA_NOVA_OFERTA_JA_INDISPONIVEL", "true"), (_OLD | _SHOP | {"price": 0.0}, "", "NOVA_OFERTA_SEM_PRECO_VALIDO", "true"),
    (_OLD | {"url": "https://b.example"}, "", "PARCEIRO_NAO_ENCONTRADO", "true"), (_NEW | _SHOP, "CRIAR_HARDWARE,CRIAR_PRODUTO_DE_HARDWARE,CRIAR_OFERTA", "", "true"), (_NEW | {"base_lacking": 1}, "", "HARDWARE_NOVO_INCOMPLETO", "true"), (_NEW | {"hw_status": "AMBIGUOUS"} | _SHOP, "", "IDENTIDADE_AMBIGUA_NO_CADASTRO", "true"),
    (_NEW | {"prod_id": 4, "prod_status": "MATCH"}, "CRIAR_HARDWARE", "", "true"), ({"kind": "HARDWARE", "hw_id": 1, "hw_status": "MATCH"}, "CRIAR_PRODUTO_DE_HARDWARE", "", "true"), ({"kind": "HARDWARE", "hw_id": 1, "prod_id": 2}, "", "HARDWARE_E_PRODUTO_EXISTEM_MAS_NAO_ESTAO_VINCULADOS", "true"),
    ({"kind": "PRODUTO", "category_id": 9, "has_name": True} | _SHOP, "CRIAR_PRODUTO,CRIAR_OFERTA", "", "true"), ({"kind": "PRODUTO"}, "", "CATEGORIA_PRODUTO_NAO_ENCONTRADA", "true"), ({"kind": "PRODUTO", "category_id": 9}, "", "PRODUTO_NOVO_SEM_NOME", "true"),
    ({"kind": "PRODUTO", "prod_id": 2, "spec_fills": 1}, "ATUALIZAR_PRODUTO_CAMPOS_VAZIOS", "", "false"), ({"kind": "PRODUTO", "prod_id": 2, "prod_conflict": True}, "", "CONFLITO_DE_IDENTIDADE", "true"), ({"kind": "NOTEBOOK"} | _SHOP, "", "CADASTRO_ESPECIALIZADO_DEVE_USAR_ROTA_PROPRIA_DO_BACKEND", "true"),
    (_OLD | {"n_conflicts": 1}, "", "", "true"), ({}, "", "", "false"),
]
_PLAN_ROW = (
    "kind string, hw_id long, hw_status string, hw_conflict boolean, hw_fills int, hw_linked long, prod_id long, prod_status string, prod_conflict boolean, prod_fills int, spec_fills int, spec_lacking int, base_lacking int, "
    "category_id long, has_name boolean, n_conflicts int, url string, partner_id long, offer_id long, offer_status string, offer_fills int, price double, available boolean"
)
_answer = lambda i: f"(list_value({', '.join(_lit(p[i]) for p in PLANS)}))[(p_partkey % {len(PLANS)} + 1)::integer]"


@query("action_plan", f"select p_partkey as record_id, {_answer(1)} as actions, {_answer(2)} as blockers, {_answer(3)} as review from part")
def _(spark, sf_dir):
    given = F.array(*(F.lit(json.dumps(p[0])) for p in PLANS))
    records = rows(spark, sf_dir, "select p_partkey as record_id from part").withColumn("x", F.from_json(F.element_at(given, (F.col("record_id") % len(PLANS) + 1).cast("int")), _PLAN_ROW))
    plan = actions.action_plan(records.select("record_id", "x.*"))
    return plan.select("record_id", F.array_join("actions", ",").alias("actions"), F.array_join("blockers", ",").alias("blockers"), F.col("review").cast("string").alias("review"))
