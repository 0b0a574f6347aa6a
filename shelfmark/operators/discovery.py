"""Discovery of products: searches over several keywords, gaps filled from reference chips, queries for missing fields, cited official pages, the roll-up of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captured, kinds
from ..functions import scalars as S
from . import evidence, listings, ordering

#: What else is searched for where a query names only a kind of part.
WIDER = {
    "placa de video": ("RTX", "Radeon RX"), "placas de video": ("RTX", "Radeon RX"), "gpu": ("RTX", "Radeon RX"), "processador": ("AMD Ryzen", "Intel Core"), "processadores": ("AMD Ryzen", "Intel Core"), "placa mae": ("motherboard",),
    "memoria ram": ("DDR4", "DDR5"), "memoria": ("DDR4", "DDR5"), "fonte": ("fonte ATX", "power supply"), "gabinete": ("gabinete gamer",), "ventoinha": ("fan 120mm",), "pc montado": ("computador gamer",),
}
#: Fixed limits of the contract: pages read of a keyword, alone and among others; terms of a record and of a query; pages that are checked.
PAGES_ALONE, PAGES_EACH, MOST_TERMS, TERMS_A_QUERY, MOST_CITED = 6, 2, 10, 4, 2
#: Fixed patterns: graphics chips in names without spaces, and errors of a source that don't make a search partial.
CHIPS = (r"(RTX|GTX|GTS|GT)(\d{3,4})(TI|SUPER)?", r"(RX)(\d{3,4})(XTX|XT|GRE|M|S)?", r"(HD)(\d{3,4})(M)?", r"(ARC)([AB]\d{3})()")
HARMLESS = ("NAO_ENCONTRADO", "CATEGORIA_NAO_SUPORTADA")
#: Fixed patterns: references appended to a value: a marked citation, a link in brackets or in Markdown, a bare address; what is left before them.
REFERENCE = r"(?i)(?:\s*(?:【[^】\n]{1,200}】|\(\s*\[[^\]\n]{1,200}\]\(\s*https?://\S+?\)\s*\)|\[[^\]\n]{1,200}\]\(\s*https?://\S+?\)|(?:\(\s*)?https?://\S+(?:\s*\))?))+\s*$"
LEFT_OVER = r"\s+[-–—|;,]\s*$"


def keywords(query: Column) -> Column:
    """What is searched for: the query (null if blank), then the wider words of its kind."""
    wider = F.create_map(*(x for k, words in WIDER.items() for x in (F.lit(k), F.array(*map(F.lit, words)))))
    return F.concat(F.array(S.blank_to_null(F.trim(query))), F.coalesce(F.try_element_at(wider, S.spaced(query)), F.array().cast("array<string>")))


def expanded_search(searches: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, place, score and the item of what searches (query_id, query, most, promotions_only) find in result pages.

    pages: keyword, page (from 1), has_next, items (array of structs with shop_id, item_id, url, name, sales, rating, discount, promo). The
    keywords of a query are read in turn, six pages of the query alone or two of each; a keyword ends at a page that is missing, empty,
    without a new item or the last, all end once `most` items fit. An item (by shop and item, else address or name) counts the first
    time it is seen; it fits if it is relevant, and on promotion where that is asked. Order: relevance, then as found. Null and blank
    queries read pages of a null keyword. Items are judged once a distinct query; its pages are few and bounded, so they are walked inside a row, once
    for all searches that ask the same (query, most, promotions_only).
    """
    plain = searches.select("query_id", F.coalesce("query", F.lit("")).alias("query"), F.col("most").cast("int").alias("most"), F.coalesce("promotions_only", F.lit(False)).alias("promoted"))
    words = plain.select("query", keywords(F.col("query")).alias("w")).distinct()
    asked = words.select("query", F.when(F.size("w") > 1, PAGES_EACH).otherwise(PAGES_ALONE).alias("until"), F.posexplode("w").alias("turn", "word"))
    read = pages.select(F.coalesce("keyword", F.lit("")).alias("word"), F.col("page").cast("int").alias("page"), F.coalesce("has_next", F.lit(False)).alias("more"), F.posexplode_outer("items").alias("pos", "item")).where(F.col("page") <= max(PAGES_ALONE, PAGES_EACH))
    met = asked.withColumn("word", F.coalesce("word", F.lit(""))).join(read, "word").where(F.col("page").between(1, F.col("until")))
    item = F.col("item")
    wanted, offered = listings.tokens(F.col("query")), listings.tokens(item["name"])
    overlap = F.when(S.spaced(F.col("query")).isNull(), 0.0).otherwise(F.size(F.array_intersect(wanted, offered)) / F.greatest(F.size(wanted), F.lit(1)))
    kind = F.coalesce(kinds.first_kind(F.col("query")).isNotNull(), F.lit(False))
    judged = S.apart(met.withColumn("rel", F.coalesce(kinds.relevant(F.col("query"), item["name"]), F.lit(False))))
    flat = judged.select(
        "query", "turn", "page", "more", "pos", "item", F.concat_ws("\u0001", F.coalesce(item["shop_id"].cast("string"), F.lit("")), F.coalesce(S.blank_to_null(item["item_id"].cast("string")), S.blank_to_null(item["url"]), item["name"], F.lit(""))).alias("key"),
        "rel", F.coalesce(item["promo"], F.lit(False)).alias("promo"), F.round(ordering.relevance(overlap, kind & F.col("rel"), item["sales"], item["rating"], item["discount"]), 4).alias("score"),
    )
    step = F.struct("turn", "page", "pos", "more", "key", "rel", "promo", "score", "item")
    found = flat.groupBy("query").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # at most eight pages
    asking = ["query", "most", "promoted"]
    walk = plain.select(*asking).distinct().join(found, "query")

    def visit(s: Column, x: Column) -> Column:
        same_word, same_page = s["turn"] == x["turn"], (s["turn"] == x["turn"]) & (s["page"] == x["page"])
        room = s["good"] < F.col("most")
        goes_on = F.when(same_page, s["alive"]).when(same_word, s["alive"] & (x["page"] == s["page"] + 1) & (s["fresh"] > 0) & s["more"] & room).otherwise(room & (x["page"] == 1))
        new = goes_on & x["pos"].isNotNull() & ~F.array_contains(s["seen"], x["key"])
        good = new & x["rel"] & (~F.col("promoted") | x["promo"])
        return F.struct(
            x["turn"].alias("turn"), x["page"].alias("page"), goes_on.alias("alive"), F.when(same_page, s["fresh"]).otherwise(0) + F.when(new, 1).otherwise(0), x["more"].alias("more"),
            F.when(new, F.concat(s["seen"], F.array(x["key"]))).otherwise(s["seen"]), s["good"] + F.when(good, 1).otherwise(0), F.concat(s["kept"], F.array(good)),
        )

    start = F.struct(F.lit(-1).alias("turn"), F.lit(0).alias("page"), F.lit(False).alias("alive"), F.lit(0).alias("fresh"), F.lit(False).alias("more"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("good"), F.array().cast("array<boolean>").alias("kept"))
    kept = walk.select(*asking, F.posexplode(F.filter(F.zip_with("steps", F.aggregate("steps", start, visit, lambda s: s["kept"]), lambda x, k: F.when(k, x)), lambda x: x.isNotNull())).alias("found", "x"))
    place = F.row_number().over(Window.partitionBy(*asking).orderBy(F.desc("x.score"), "found"))
    best = kept.withColumn("place", place).where(F.col("place") <= F.col("most")).select(*asking, "place", "x")
    return plain.join(best, asking).select("query_id", "place", "x.score", "x.item.*")


def chip(name: Column) -> Column:
    """The graphics chip that a name speaks of, as a short key (rtx5060ti, rx6600, arca770); null if none."""
    joined = F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "")
    return F.coalesce(*(S.blank_to_null(F.lower(F.concat(*(F.regexp_extract(joined, p, i) for i in (1, 2, 3))))) for p in CHIPS))


def with_reference(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Candidates (candidate_id, name, specs: map, sources: array of source and url) with gaps of their specs filled from the reference of their
    chip (references: name, url, specs; of several of one chip the least name counts), which is added to their sources once."""
    one = references.select(chip(F.col("name")).alias("_chip"), "name", F.col("url").alias("_url"), F.col("specs").alias("_specs")).where("_chip is not null")
    index = one.groupBy("_chip").agg(F.min_by(F.struct("_url", "_specs"), F.struct("name", "_url")).alias("_ref"))
    filled = F.map_zip_with(F.coalesce("specs", F.create_map().cast("map<string,string>")), F.coalesce("_ref._specs", F.create_map().cast("map<string,string>")), lambda k, own, ref: F.coalesce(S.blank_to_null(own), S.blank_to_null(ref), own, ref))
    source = F.struct(F.lit("CATALOGO_REFERENCIA").alias("source"), F.col("_ref._url").alias("url"))
    none = F.array().cast("array<struct<source:string,url:string>>")
    sources = captured.first_each(F.concat(F.coalesce("sources", none), F.array(source)), lambda s: s)
    out = candidates.withColumn("_chip", chip(F.col("name"))).join(index, "_chip", "left")
    hit = F.col("_ref").isNotNull()
    return out.select(*(c for c in candidates.columns if c not in ("specs", "sources")), F.when(hit, filled).otherwise(F.col("specs")).alias("specs"), F.when(hit, sources).otherwise(F.col("sources")).alias("sources"))


def spoken(field: Column) -> Column:
    """A field's name in words: capacidadeMaxima -> capacidade Maxima."""
    return S.clean(F.replace(F.regexp_replace(field, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))


def focused_queries(records: DataFrame, missing: DataFrame, terms: DataFrame, most: int = 1) -> DataFrame:
    """record_id, pos, query: what to search for to find a record's missing fields, then the plain base query.

    records: record_id, category, base; missing: record_id, pos, field; terms: category, field, pos, term (a field without terms speaks
    for itself). Each term once whatever its case, the first ten; four a query, `most` queries. A blank base gives no query.
    """
    base = records.select("record_id", F.upper(F.trim("category")).alias("category"), F.trim("base").alias("base")).where("base <> ''")
    named = terms.select(F.upper("category").alias("category"), "field", F.col("pos").alias("at"), F.trim("term").alias("term")).where("term <> ''")
    heard = named.groupBy("category", "field").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("told"))  # a schema's few terms of a field
    said = missing.where(S.clean(F.col("field")).isNotNull()).join(base.select("record_id", "category").hint("merge"), "record_id").join(F.broadcast(heard), ["category", "field"], "left")
    own = F.array(F.struct(F.lit(None).cast(named.schema["at"].dataType).alias("at"), spoken(F.col("field")).alias("term")))
    told = said.select("record_id", "pos", "field", F.inline(F.coalesce("told", own))).withColumn("k", F.lower("term"))
    first = Window.partitionBy("record_id", "k").orderBy("pos", "field", "at", "term")
    once = told.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    placed = once.withColumn("i", F.row_number().over(Window.partitionBy("record_id").orderBy("pos", "field", "at", "k")) - 1).where(F.col("i") < min(MOST_TERMS, most * TERMS_A_QUERY))
    terms_of = placed.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]).alias("words"))  # ten at most
    chunks = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(TERMS_A_QUERY)), lambda i: F.concat_ws(" ", "base", F.array_join(F.slice("words", i, F.lit(TERMS_A_QUERY)), " ")))
    every = F.when(F.col("words").isNull(), F.array("base")).otherwise(F.concat(chunks, F.array("base")))
    return base.select("record_id", "base").join(terms_of.hint("merge"), "record_id", "left").select("record_id", F.posexplode(every).alias("pos", "query")).withColumn("pos", F.col("pos").cast("long"))


def official_evidence(records: DataFrame, domains: DataFrame, citations: DataFrame, pages: DataFrame) -> DataFrame:
    """record_id, field, value, url, passage: of each field what the first official page that a record's answer cites says.

    records: record_id, brand, strong (identity); domains: brand, domain; citations: record_id, pos, url; pages: url, field, value, passage
    (what rules read again from a fetched page, one row a field). A citation counts if it is https without credentials or another
    port and its host is a domain of the brand or below one; of a record the first two such addresses are looked at, whether or not
    they were fetched. Hosts meet domains by their endings, so both joins are on equal keys.
    """
    fine = F.col("url").rlike(r"^https://[^/?#@:]+(?::443)?(?:[/?#]|$)")
    labels = F.split(S.host(F.col("url")), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    owned = domains.select(S.key(F.col("brand")).alias("b"), F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("ending")).where("b is not null and ending is not null").distinct()
    cited = citations.where(fine).join(records.where("strong").select("record_id", S.key(F.col("brand")).alias("b")).hint("merge"), "record_id").select("record_id", "pos", "url", "b", F.explode(endings).alias("ending"))
    first = cited.join(owned, ["b", "ending"], "left_semi").groupBy("record_id", "url").agg(F.min("pos").alias("pos"))
    tried = first.withColumn("_r", F.row_number().over(Window.partitionBy("record_id").orderBy("pos", "url"))).where(F.col("_r") <= MOST_CITED)
    told = tried.join(pages.where(evidence.present(F.col("value"))), "url")
    best = told.groupBy("record_id", "field").agg(F.min_by(F.struct("value", "url", "passage"), F.struct("_r", "passage", "value")).alias("b"))
    return best.select("record_id", "field", "b.*")


def bare_value(c: Column) -> Column:
    """A value without the citations, links and addresses at its end, and without the dash or comma that led to them."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), REFERENCE, "")), LEFT_OVER, ""))


def merged_answers(sheet: DataFrame, answers: DataFrame) -> DataFrame:
    """record_id, field, value, outcome (KEPT, FILLED, CONFLICT), answer: a sheet's fields with the gaps that an answer fills; it never overwrites.

    Both: record_id, field, value, one row a field. Values are compared whatever their case and white space; an answer loses its references
    first. An answer that says the same, or nothing, gives no outcome of its own: the field is KEPT.
    """
    told = answers.select("record_id", "field", S.blank_to_null(bare_value(F.col("value"))).alias("answer")).where("answer is not null")
    both = sheet.select("record_id", "field", S.blank_to_null(F.trim("value")).alias("value")).join(told.hint("merge"), ["record_id", "field"], "full").where("value is not null or answer is not null")
    other = ~evidence.value_key(F.col("value")).eqNullSafe(evidence.value_key(F.col("answer")))
    outcome = F.when(F.col("value").isNull(), "FILLED").when(F.col("answer").isNotNull() & other, "CONFLICT").otherwise("KEPT")
    return both.select("record_id", "field", F.coalesce("value", "answer").alias("value"), outcome.alias("outcome"), F.when(outcome == "CONFLICT", F.col("answer")).alias("answer"))


def roll_up(searches: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a search (search_id, offset, page_size, candidates, most): what came back, what can be registered and what is blocked, whether it is
    partial, has more, met its limit; and by_source, `source:found` in order of the source.

    items: search_id, item_id, issues (array of reasons; none: it can be registered), deduplicated. sources: search_id, source, found, error; an
    error that only says that nothing was found, or that the category isn't kept, doesn't make a search partial. Aggregated before joining.
    """
    clear = F.coalesce(F.size("issues"), F.lit(0)) <= 0
    n = items.groupBy("search_id").agg(F.count("*").alias("returned"), F.count_if(clear).alias("registrable"), F.count_if(~clear).alias("blocked"))
    bad = F.col("error").isNotNull() & ~F.col("error").isin(*HARMLESS)
    by = sources.groupBy("search_id", "source").agg(F.sum("found").alias("found"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))
    s = by.groupBy("search_id").agg(F.bool_or("bad").alias("partial"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", F.coalesce("found", F.lit(0)).alias("n")))), lambda x: F.concat_ws(":", x["source"], x["n"])), ",").alias("by_source"))  # as many as there are sources
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return searches.join(n.hint("merge"), "search_id", "left").join(s.hint("merge"), "search_id", "left").select(
        "search_id", none("returned"), none("registrable"), none("blocked"), F.coalesce("partial", F.lit(False)).alias("partial"), (F.col("offset") + F.col("page_size") < F.col("candidates")).alias("has_more"),
        (F.col("candidates") >= F.col("most")).alias("limit_met"), F.coalesce("by_source", F.lit("")).alias("by_source"),
    )
