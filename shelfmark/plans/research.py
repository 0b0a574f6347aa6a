"""Registered queries of evidence and guards: hard cases by part, answers by hand, and joins over the tables with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, guards
from .cases import _lit, cases
from .catalogue import query, rows

CLAIMS = """select p_partkey as claim_id, concat('s', cast(p_partkey % 5 as {t})) as source, concat(case p_partkey % 11 when 0 then 'ftp' else 'https' end, '://', case p_partkey % 3 when 0 then 'www.' when 1 then 'a.b.' else '' end, case p_partkey % 13 when 0 then 'x' else '' end, 'd', cast(p_partkey % 7 as {t}), '.example/p') as url,
  case when p_partkey % 4 = 0 then ' ' when p_partkey % 17 = 0 then null else p_name end as passage, case when p_partkey % 2 = 0 then 'EXTRACAO_DETERMINISTICA' end as method, p_partkey % 3 = 0 as confirmed from part"""
DOMAINS = "select concat('S', cast(n_nationkey % 5 as {t})) as source, concat('d', cast(n_nationkey % 7 as {t}), '.example') as domain from nation where n_nationkey < 15"


@query("trusted_claims", f"""with c as ({CLAIMS.format(t="varchar")}), d as ({DOMAINS.format(t="varchar")})
select claim_id, coalesce(passage <> '', false) and (coalesce(method is not null, false) or confirmed) and url like 'https%' and exists (select 1 from d where lower(d.source) = c.source
  and (regexp_extract(url, '://([^/]+)', 1) = d.domain or regexp_extract(url, '://([^/]+)', 1) like '%.' || d.domain)) as trusted from c""")
def _(spark, sf_dir):
    return evidence.trusted(rows(spark, sf_dir, CLAIMS.format(t="string")), rows(spark, sf_dir, DOMAINS.format(t="string"))).select("claim_id", "trusted")


CONFLICTS = "select l_orderkey as record_id, concat('f', cast(l_linenumber % 2 as {t})) as field, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as pos, case when l_linenumber = 5 then '' else l_linestatus end as value, case l_suppkey % 4 when 0 then 'GEIZHALS' when 1 then 'ICECAT' when 2 then 'FABRICANTE_OFICIAL' else 'X' end as source from lineitem"
CURRENT = "select o_orderkey as record_id, 'f1' as field, case o_custkey % 3 when 0 then 'PC_KOMBO' when 1 then 'WIKICHIP' end as source, o_orderkey % 5 <> 0 as cached from orders"
_RESOLVED = f"""with j as (select c.*, coalesce(cached, false) as cached, case k.source when 'PC_KOMBO' then 0.78 when 'WIKICHIP' then 0.88 else 0.65 end as had from ({CONFLICTS.format(t="varchar")}) c left join ({CURRENT}) k using (record_id, field)),
s as (select *, case when cached and value <> '' then case source when 'GEIZHALS' then 0.86 when 'ICECAT' then 0.94 when 'FABRICANTE_OFICIAL' then 0.98 else 0.65 end end as score from j),
r as (select *, coalesce(score > greatest(had, max(score) over (partition by record_id, field order by pos rows between unbounded preceding and 1 preceding)), false) as resolved from s)"""


@query("cache_conflicts", f"{_RESOLVED} select record_id, field, pos, resolved from r")
def _(spark, sf_dir):
    return evidence.cache_conflicts(rows(spark, sf_dir, CONFLICTS.format(t="string")), rows(spark, sf_dir, CURRENT)).select("record_id", "field", "pos", "resolved")


@query("cache_resolved", f"{_RESOLVED} select record_id, field, max_by(value, pos) as value, max_by(source, pos) as source from r where resolved group by 1, 2")
def _(spark, sf_dir):
    return evidence.resolved_values(evidence.cache_conflicts(rows(spark, sf_dir, CONFLICTS.format(t="string")), rows(spark, sf_dir, CURRENT)))


@query("grounded_claims", """with c as (select p_partkey as claim_id, p_partkey % 89 as u, p_partkey % 7 as v, p_partkey % 10 as k from part)
select claim_id, k not in (0, 1) and exists (select 1 from part p where p.p_partkey % 97 = c.u and p.p_partkey % 5 = c.v) as grounded from c""")
def _(spark, sf_dir):
    claims = rows(spark, sf_dir, "select p_partkey as claim_id, 'Socket' as field, concat('lga', cast(p_partkey % 7 as string)) as value, concat('u', cast(p_partkey % 89 as string)) as url, case p_partkey % 10 when 0 then concat('Chip: LGA', cast(p_partkey % 7 as string)) when 1 then null else concat('socket :  LGA', cast(p_partkey % 7 as string)) end as passage from part")
    lines = rows(spark, sf_dir, "select concat('u', cast(p_partkey % 97 as string)) as url, concat('Sheet  SOCKET : LGA', cast(p_partkey % 5 as string), ' ok') as line from part")
    return evidence.grounded(claims, lines).select("claim_id", "grounded")


@query("verified_intake", """select p_partkey as record_id, f.field, 'v' as value, case when f.field <> 'gpu' and p_partkey % 3 = 0 then 'VARIANTE_DA_PLACA_NAO_CONFIRMADA' when (f.field = 'cor' and p_partkey % 3 = 1) or p_partkey % 7 = 0 or p_partkey % 5 = 0 then 'CONFLITO_OU_EVIDENCIA_NAO_CONFIRMADA' end as reason
from part, (select unnest(['gpu', 'cor', 'socket']) as field) f where not (f.field = 'socket' and p_partkey % 2 = 0) and not (f.field = 'gpu' and p_partkey % 11 = 0)""")
def _(spark, sf_dir):
    base = "p_partkey as record_id, case p_partkey % 3 when 0 then 'PLACA_VIDEO' when 1 then 'CELULAR' else 'MONITOR' end as category, case p_partkey % 3 when 0 then 'CHIP_GRAFICO' else 'MODELO_EXATO' end as scope, 'MARCA_MODELO' as method"
    before = rows(spark, sf_dir, f"select {base}, explode(array('gpu', 'cor', 'socket')) as field from part").withColumn("value", F.expr("case when field = 'socket' and record_id % 2 = 0 then 'AM4' when field = 'cor' then '' end"))
    proposed = rows(spark, sf_dir, "select p_partkey as record_id, explode(array('gpu', 'cor', 'socket', 'outro')) as field, p_partkey % 7 = 0 as conflicting, p_partkey % 5 <> 0 as trusted from part").withColumn("value", F.expr("case when field = 'gpu' and record_id % 11 = 0 then '' else 'v' end"))
    return evidence.intake(before, proposed)


@query("cache_reuse", """select l_orderkey as record_id, l_linenumber as field, case when l_linenumber = 3 then 'CONFLITO_NAO_RESOLVIDO' when l_discount = 0 or l_returnflag = 'R' then 'SEM_PROVENIENCIA' when l_discount < 0.05 then 'CONFIANCA_ABAIXO_DO_LIMIAR' end as reason from lineitem where l_linenumber <> 6""")
def _(spark, sf_dir):
    cached = rows(spark, sf_dir, "select l_orderkey as record_id, l_linenumber as field, case when l_linenumber = 6 then '' else l_linestatus end as value, case when l_discount > 0 then case when l_discount < 0.05 then 0.5 else 0.8 end end as score, case when l_returnflag = 'R' then ' ' else 'S' end as source, case when l_linenumber = 3 then true end as conflicting from lineitem")
    return evidence.reusable(cached).select("record_id", "field", "reason")


cases("specific_models", ["category", "method", "model"], ["specific"], [
    ("PLACA_MAE", "MARCA_MODELO", "B550M", "false"), ("PLACA_MAE", "MARCA_MODELO", "B550M TUF", "true"), ("PLACA_MAE", "GTIN", "B550", "true"), ("MEMORIA_RAM", "MARCA_MODELO", "DDR4 16GB 3200MHz", "false"), ("MEMORIA_RAM", "MARCA_MODELO", "KVR32N22 16GB", "true"),
    ("ARMAZENAMENTO", "MARCA_MODELO", "NV2 1TB", "true"), ("FONTE", "MARCA_MODELO", "650W Bronze", "false"), ("MONITOR", "MARCA_MODELO", None, "true"), ("FONTE", "MARCA_MODELO", None, "false"), (None, None, "x", "true"),
], lambda category, method, model: [evidence.specific_for(category, method, model)])

cases("capture_minimum", ["category", "specs"], ["lacking"], [
    ("PROCESSADOR", '{"socket":"AM4"}', "nucleos"), ("PROCESSADOR", '{"socket":" Unknown ","nucleos":"6"}', "socket"), ("PROCESSADOR", "{}", "socket,nucleos"), ("GABINETE", '{"tamanho":"MID_TOWER"}', ""), ("MOUSE", "{}", ""), ("COOLER", None, "tipo"), (None, "{}", ""), ("FONTE", '{"formato":"Não informado","potenciaWatts":"N/A"}', "formato,potenciaWatts"),
], lambda category, specs: [F.array_join(evidence.least_specs_missing(category, F.from_json(specs, "map<string,string>")), ",")])

cases("metadata_names", ["name", "value"], ["kept"], [
    ("Cor", "Preto", "true"), ("Preço", "1", "false"), ("Garantia", "1 ano", "false"), ("Brand", "x", "false"), ("url", "x", "false"), ("urls", "x", "true"), ("x" * 81, "1", "false"), ("Cor", "x" * 181, "false"), ("Cor", "", "false"), (None, "x", "false"), ("Cor", None, "false"),
], lambda name, value: [evidence.metadata_name(name, value)])

cases("should_enrich", ["method", "missing"], ["research"], [
    ("GTIN", "a,b", "true"), ("MARCA_MODELO", "a", "true"), ("MARCA_MPN", None, "false"), ("NOME", "a", "false"), (None, "a", "false"),
], lambda method, missing: [evidence.should_enrich(method, F.split(missing, ","))])

# Guards: of each part one row a field, the value by the part's key; None as the second of a pair means that the row goes.
GUARDED = [
    ("FONTE", "mpn", [("x" * 150, "x" * 150), ("x" * 151, None)]), ("MONITOR", "gtin", [("1" * 33, None), ("123", "123")]), ("FONTE", "especificacaoFonte.comprimentoMm", [("140", "140"), ("-1", None), ("1000001", None), ("x", None)]),
    ("FONTE", "especificacaoFonte.eficienciaPercentual", [("100", "100"), ("100.5", None)]), ("FONTE", "especificacaoFonte.conectoresSata", [("6", "6"), ("6.5", None), ("129", None)]), ("FONTE", "especificacaoFonte.modularidade", [("MODULAR", "MODULAR"), ("SIM", None)]),
    ("MOUSE", "especificacaoFonte.modularidade", [("SIM", "SIM")]), ("FONTE", "especificacaoFonte.padraoAtx", [("3.1", "3.1"), ("x" * 51, None)]), ("FONTE", "especificacaoFonte.protecoes", [('["OVP"," ovp ","","UVP"]', '["OVP","UVP"]'), ("[]", None), ("OVP", None)]), ("FONTE", "nome", [("", "")]),
]
_arms = lambda values, i: "case p_partkey % " + str(len(values)) + "".join(f" when {k} then {_lit(v[i])}" for k, v in enumerate(values)) + " end"
_rows = lambda i: " union all ".join(f"select p_partkey as record_id, '{c}' as category, '{f}' as field, {_arms(v, i)} as value from part" for c, f, v in GUARDED)


@query("guarded_sheet", f"select * from ({_rows(1)}) where value is not null")
def _(spark, sf_dir):
    return guards.guard(rows(spark, sf_dir, _rows(0)))


_ROOT = '"nome":"Item","marca":"M","modelo":"X1"'
cases("registration_issues", ["category", "fields"], ["found"], [
    ("MONITOR", f"{{{_ROOT}}}", ""), ("MONITOR", '{"nome":"I","modelo":"  "}', "nome ausente ou fora do formato aceito|marca ausente ou fora do formato aceito|modelo ausente ou fora do formato aceito"), ("PROCESSADOR", f"{{{_ROOT}}}", "especificacaoProcessador.tiposMemoriaSuportados ausente"),
    ("PROCESSADOR", f'{{{_ROOT},"especificacaoProcessador.tiposMemoriaSuportados":"DDR4"}}', "especificacaoProcessador.tiposMemoriaSuportados deve ser array"), ("PROCESSADOR", f'{{{_ROOT},"especificacaoProcessador.tiposMemoriaSuportados":"[]"}}', ""),
    ("PLACA_MAE", f'{{{_ROOT},"especificacaoPlacaMae.tiposMemoriaSuportados":"[\\"DDR4\\",\\"DDR2\\"]"}}', "especificacaoPlacaMae.tiposMemoriaSuportados contém valor inválido"),
    ("ARMAZENAMENTO", f'{{{_ROOT},"especificacaoArmazenamento.formato":"M2","especificacaoArmazenamento.tamanhoM2Mm":"80","especificacaoArmazenamento.chaveM2":"E"}}', "especificacaoArmazenamento.chaveM2 não confirmada|especificacaoArmazenamento.interface não confirmada"),
    ("ARMAZENAMENTO", f'{{{_ROOT},"especificacaoArmazenamento.formato":"SATA"}}', ""), ("FONTE", f'{{{_ROOT},"especificacaoFonte.formato":"ATX","especificacaoFonte.potenciaWatts":"650"}}', ""),
    ("FONTE", f'{{{_ROOT},"especificacaoFonte.potenciaWatts":"0"}}', "especificacaoFonte.formato não confirmado|especificacaoFonte.potenciaWatts não confirmada"), (None, f"{{{_ROOT}}}", ""),
], lambda category, fields: [F.array_join(guards.issues(category, F.from_json(fields, "map<string,string>")), "|")])


@query("manual_edits", """with e as (select p_partkey as record_id, 'nome' as field, 'N' || (p_partkey % 4) as value from part union all select p_partkey, 'cor', 'azul' from part where p_partkey % 2 = 0)
select p_partkey as record_id, 'MOUSE' as category, 'modelo' as field, p_brand as value from part union all select record_id, 'MOUSE', field, value from e
union all select p_partkey, 'MOUSE', 'cor', 'preto' from part where p_partkey % 2 = 1 union all select p_partkey, 'MOUSE', 'nota', 'n' from part""")
def _(spark, sf_dir):
    sheet = rows(spark, sf_dir, "select p_partkey as record_id, 'MOUSE' as category, stack(4, 'nome', p_name, 'modelo', p_brand, 'cor', 'preto', 'nota', 'n') as (field, value) from part")
    edits = rows(spark, sf_dir, """select p_partkey as record_id, stack(5, 1, 'nome', 'first', 2, ' nome ', concat(' N', cast(p_partkey % 4 as string), ' '), 3, 'modelo', ' ', 4, 'nota', 'm', 49, 'modelo', 'late') as (pos, field, value) from part
        union all select p_partkey, 5, 'cor', 'azul' from part where p_partkey % 2 = 0 union all select p_partkey, explode(sequence(6, 48)), 'outro', 'x' from part union all select p_partkey, 5, 'outro', 'x' from part where p_partkey % 2 = 1""")
    allowed = spark.createDataFrame([("MOUSE", "nome"), ("MOUSE", "modelo"), ("MOUSE", "cor"), ("TECLADO", "nota")], "category string, field string")
    return guards.manual_edits(sheet, edits, allowed)


@query("review_list", """select p_partkey as record_id, u.pos, u.field, u.type, u.options from part, lateral (select unnest(case p_partkey % 3
  when 0 then [{'pos': 0, 'field': 'modelo', 'type': 'text', 'options': null}, {'pos': 1, 'field': 'especificacaoFonte.formato', 'type': 'text', 'options': 'ATX,SFX,SFX_L,TFX,FLEX_ATX'}, {'pos': 2, 'field': 'especificacaoFonte.potenciaWatts', 'type': 'integer', 'options': null}]
  when 1 then [{'pos': 0, 'field': 'fm.tamanhoPolegadas', 'type': 'number', 'options': null}, {'pos': 1, 'field': 'fm.taxaAtualizacaoHz', 'type': 'integer', 'options': null}, {'pos': 2, 'field': 'fm.tipoPainel', 'type': 'text', 'options': null}] else [] end) as u)""")
def _(spark, sf_dir):
    records = rows(spark, sf_dir, """select p_partkey as record_id, case p_partkey % 3 when 0 then 'FONTE' when 1 then 'MONITOR' else 'HUB' end as category,
        case p_partkey % 3 when 0 then map('nome', p_name, 'marca', 'M', 'modelo', ' ', 'especificacaoFonte.potenciaWatts', 'x') when 1 then map('nome', p_name, 'marca', 'M', 'modelo', 'X', 'fm.resolucao', '4K') else map('nome', p_name, 'marca', 'M', 'modelo', 'X') end as fields from part""")
    return guards.review(records, {"MONITOR": "fm"}).withColumn("options", F.array_join("options", ","))
