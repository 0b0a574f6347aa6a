"""The action plan of a record: what to update, what to create and in which order, what blocks it, and whether a person must look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of records that have routes of their own, which this plan doesn't cover.
SPECIAL = ("NOTEBOOK", "BUILD")


def action_plan(rows: DataFrame) -> DataFrame:
    """record_id, actions (an array of names, in order), blockers (the same), review.

    rows, one a record, as the matching and patching jobs leave them: record_id, kind (HARDWARE, PRODUTO, NOTEBOOK, BUILD), and of hardware
    and product (hw_, prod_): id, status (MATCH, AMBIGUOUS, NONE), conflict (identity), fills (fields that its patch fills); hw_linked (the
    product that the hardware names), spec_fills, spec_lacking (required specs missing after the merge, or of the new record), base_lacking,
    category_id, has_name, n_conflicts (of values), url, partner_id, offer_id, offer_status, offer_fills, price, available. A linked product
    outranks a matched one. Spec fills of hardware whose sheet stays incomplete are blocked, not written. Null counts and flags are 0
    and false. Everything is a projection: the joins are those of the jobs before.
    """
    c = F.col
    n = lambda name: F.coalesce(c(name), F.lit(0))
    flag = lambda x: F.coalesce(x, F.lit(False))
    pick = lambda *pairs: F.filter(F.array(*(F.when(flag(when), F.lit(name)) for name, when in pairs)), lambda x: x.isNotNull())
    hardware, product = c("kind") == "HARDWARE", c("kind") == "PRODUTO"
    has_hw, linked = hardware & c("hw_id").isNotNull(), hardware & c("hw_linked").isNotNull()
    has_prod = (hardware | product) & (linked | c("prod_id").isNotNull())
    lacking = n("spec_lacking") > 0
    first = pick(
        ("IDENTIDADE_AMBIGUA_NO_CADASTRO", (hardware & (c("hw_status") == "AMBIGUOUS")) | ((hardware | product) & (c("prod_status") == "AMBIGUOUS"))),
        ("CONFLITO_DE_IDENTIDADE", (hardware & c("hw_conflict")) | ((hardware | product) & c("prod_conflict"))),
        ("ESPECIFICACAO_HARDWARE_AINDA_INCOMPLETA", has_hw & (n("spec_fills") > 0) & lacking),
    )
    rows = rows.withColumn("_first", first).withColumn("_free", F.size("_first") == 0)
    new_hw = hardware & ~flag(has_hw) & c("_free")
    complete = ~lacking & (n("base_lacking") == 0)
    incomplete, create_hw = new_hw & ~complete, new_hw & complete
    unlinked = has_hw & ~flag(linked) & flag(has_prod)
    from_hw = hardware & ~flag(has_prod) & (flag(has_hw) | flag(create_hw)) & c("_free") & ~flag(incomplete)
    new_prod = product & ~flag(has_prod) & c("_free")
    create_prod = new_prod & c("category_id").isNotNull() & flag(c("has_name"))
    has_product_id = flag(has_prod) | flag(from_hw) | flag(create_prod)
    known = flag(has_prod)  # only stored products have offers to match
    vague = known & (c("offer_status") == "AMBIGUOUS")
    offer = known & (c("offer_status") == "MATCH")
    new_offer = has_product_id & c("url").isNotNull() & c("partner_id").isNotNull() & ~flag(offer) & ~flag(vague)
    sold_out = new_offer & flag(c("available") == F.lit(False))
    no_price = new_offer & ~flag(sold_out) & ~flag(c("price") > 0)
    blockers = F.concat("_first", pick(
        ("HARDWARE_NOVO_INCOMPLETO", incomplete), ("HARDWARE_E_PRODUTO_EXISTEM_MAS_NAO_ESTAO_VINCULADOS", unlinked), ("CATEGORIA_PRODUTO_NAO_ENCONTRADA", new_prod & c("category_id").isNull()),
        ("PRODUTO_NOVO_SEM_NOME", new_prod & c("category_id").isNotNull() & ~flag(c("has_name"))), ("CADASTRO_ESPECIALIZADO_DEVE_USAR_ROTA_PROPRIA_DO_BACKEND", c("kind").isin(*SPECIAL)), ("OFERTA_AMBIGUA_NO_CADASTRO", vague),
        ("BACKEND_NAO_CRIA_NOVA_OFERTA_JA_INDISPONIVEL", sold_out), ("NOVA_OFERTA_SEM_PRECO_VALIDO", no_price), ("PARCEIRO_NAO_ENCONTRADO", has_product_id & c("url").isNotNull() & c("partner_id").isNull() & ~flag(offer)),
    ))
    hw_writes = n("hw_fills") + F.when(lacking, 0).otherwise(n("spec_fills"))
    prod_writes = n("prod_fills") + F.when(product, n("spec_fills")).otherwise(0)
    actions = pick(
        ("ATUALIZAR_HARDWARE_CAMPOS_VAZIOS", has_hw & (hw_writes > 0)), ("ATUALIZAR_PRODUTO_CAMPOS_VAZIOS", has_prod & (prod_writes > 0)), ("CRIAR_HARDWARE", create_hw), ("CRIAR_PRODUTO_DE_HARDWARE", from_hw),
        ("CRIAR_PRODUTO", create_prod), ("ATUALIZAR_OFERTA", offer & (n("offer_fills") > 0)), ("CRIAR_OFERTA", new_offer & ~flag(sold_out) & ~flag(no_price)),
    )
    out = rows.select("record_id", actions.alias("actions"), blockers.alias("blockers"), (n("n_conflicts") > 0).alias("_c"))
    creates: Column = F.exists("actions", lambda a: a.startswith("CRIAR"))
    return out.select("record_id", "actions", "blockers", (F.col("_c") | (F.size("blockers") > 0) | creates).alias("review"))
