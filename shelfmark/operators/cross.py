"""Joins of texts with catalogue names without a cross product: the parts of a listing with hardware, offers with the product they sell.

A name is met through the rarest of its runs of two neighbouring words (its word, if it is one): each name has one such key, a text has
one a word and one a pair of words, and an equi-join on them gives the pairs that are then judged whole. Rarity is counted over the names.
A run that very many texts share meets the few names of which it is the rarest; Spark splits it as a skewed key of an inner join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import products

#: Words that say that a part is not what is sold, what makes a model another one, the category whose models need no brand.
DOUBT = r"(?iU)\b(?:ou|opcional|opcionais|varia|variam|alternativas?|compat[ií]vel|suporta|n[aã]o inclui|n[aã]o acompanha)\b"
OTHER_MODEL, UNBRANDED = "ti|super|xt|xtx", "PROCESSADOR"
#: Fixed limit of the contract: candidates shown of a tie.
MOST_CANDIDATES = 5


def word_runs(words: Column) -> Column:
    """All single words and pairs of neighbours of an array of words, each once."""
    pairs = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1)))
    return S.let(words, lambda ws: F.array_distinct(F.concat(ws, pairs(ws))))


def rarest_run(names: DataFrame, name: str, *within: str) -> DataFrame:
    """The distinct names (columns within and name, words parted by spaces) with `run`, the rarest of each name's pairs of words, or its only word."""
    distinct = names.select(*within, name).where(F.col(name).isNotNull()).distinct()
    words = F.split(F.col(name), " ")
    runs = F.when(F.size(words) == 1, words).otherwise(F.filter(word_runs(words), lambda r: F.contains(r, F.lit(" "))))
    one = distinct.select(*within, name, F.explode(runs).alias("run"))
    counted = one.join(one.groupBy(*within, "run").agg(F.count("*").alias("_n")).hint("merge"), [*within, "run"])
    return counted.groupBy(*within, name).agg(F.min_by("run", F.struct("_n", "run")).alias("run"))


def _around(pattern: Column | str, text: Column) -> Column:
    return F.regexp_like(F.concat(F.lit(" "), text, F.lit(" ")), pattern)


def catalogue_parts(parts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """record_id, category, hardware_id, candidates, review of the parts (record_id, category, passages) of listings, against a
    catalogue (hardware_id, category, brand, model).

    A model fits where its words stand in a passage as a whole run that no word of another model follows; it must hold a digit and three
    letters. Best (3) are models with their brand at most two words away, then models in a passage of their category only (2), then others (1);
    all but processors need the brand. One best item is the part; several are candidates for review, as are passages that speak of
    alternatives, which name none.
    """
    model, brand = S.spaced(F.col("model")), S.spaced(F.col("brand"))
    items = S.apart(catalogue.select("hardware_id", F.upper("category").alias("category"), model.alias("m"), brand.alias("b"))).where((F.length("m") >= 3) & F.col("m").rlike("[0-9]"))
    models = rarest_run(items, "m", "category")
    alone = lambda p: F.size(F.filter(F.array(*(F.when(p.rlike(pattern), F.lit(name)) for name, pattern in products.PARTS)), lambda x: x.isNotNull())) == 1
    doubted = parts.select("record_id", "category", F.exists("passages", lambda p: F.coalesce(p.rlike(DOUBT), F.lit(False))).alias("doubted"), "passages")
    told = doubted.where(~F.col("doubted")).select("record_id", "category", F.explode("passages").alias("p")).select("record_id", "category", S.spaced(F.col("p")).alias("t"), alone(F.col("p")).alias("alone"))
    runs = told.select("*", F.explode(word_runs(F.split("t", " "))).alias("run"))
    whole = F.concat(F.lit(" "), F.col("m"), F.lit(rf"(?! (?:{OTHER_MODEL}) ) "))
    named = runs.join(models.hint("merge"), ["category", "run"]).where(_around(whole, F.col("t"))).select("record_id", "category", "t", "alone", "m")
    gap = r"(?: [a-z0-9]+){0,2} "
    near = _around(F.concat(F.lit(" "), F.col("b"), F.lit(gap), F.col("m"), F.lit(" ")), F.col("t")) | _around(F.concat(F.lit(" "), F.col("m"), F.lit(gap), F.col("b"), F.lit(" ")), F.col("t"))
    score = F.when(F.coalesce(near, F.lit(False)), 3).when(F.col("category") != UNBRANDED, None).when(F.col("alone"), 2).otherwise(1)
    scored = named.join(items.hint("merge"), ["category", "m"]).withColumn("score", score).where("score is not null").groupBy("record_id", "category", "hardware_id").agg(F.max("score").alias("score"))
    of_part = Window.partitionBy("record_id", "category").orderBy(F.desc("score"), "hardware_id")
    best = scored.withColumn("place", F.row_number().over(of_part)).where(F.col("place") <= MOST_CANDIDATES)
    found = best.groupBy("record_id", "category").agg(F.max("score").alias("top"), F.array_sort(F.collect_list(F.struct("place", "score", "hardware_id"))).alias("all"))
    tie = F.size(F.filter("all", lambda x: x["score"] == F.col("top"))) > 1
    ids = F.transform("all", lambda x: x["hardware_id"])
    empty = F.slice(ids, 1, 0)
    out = doubted.select("record_id", "category", "doubted").join(found.hint("merge"), ["record_id", "category"], "left")
    return out.select(
        "record_id", "category", F.when(~tie, F.get(ids, F.lit(0))).alias("hardware_id"), F.when(tie, ids).otherwise(F.coalesce(empty, F.array().cast("array<long>"))).alias("candidates"),
        (F.col("doubted") | F.coalesce(tie, F.lit(False))).alias("review"),
    )


def _title_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+|[0-9]+"), 0)


#: Buckets of addresses, of which the marked ones are broadcast.
BUCKETS = 1 << 17
#: What an offer says of its item, in columns: offers that say the same are judged once.
WORDING = ("title", "brand", "model", "mpn", "gtin")


def _worded(offers: DataFrame) -> DataFrame:
    """Offers with _i, _j, 96 bits by which their wordings are told apart; nulls are told from empty texts."""
    said = [c for name in WORDING for c in (F.col(name), F.col(name).isNull())]
    return offers.withColumns({"_i": F.xxhash64(*said), "_j": F.hash(*said)})


def _shapes(words: Column) -> Column:
    """Of each of some words whether it is of letters or digits, and its length up to 30."""
    return F.transform(words, lambda w: F.least(F.length(w), F.lit(30)) * 2 + (w >= "a").cast("int"))


def _shape(of_words: Column, i: Column) -> Column:
    """The shape of the word i with the next one, of their `_shapes`; null if there is no next one. With those of single words there are at most 3,900."""
    return F.get(of_words, i) * 64 + F.get(of_words, i + 1)


def _shape_of(run: Column) -> Column:
    return S.let(_shapes(F.split(run, " ")), lambda s: F.coalesce(_shape(s, F.lit(0)), F.get(s, F.lit(0))))


def _shaped_runs(words: Column, shapes: Column) -> Column:
    """The `word_runs` of words that have one of the shapes."""
    def among(x: Column) -> Column:
        single = F.transform(x.w, lambda w, i: F.when(F.array_contains(shapes, F.get(x.s, i)), w))
        pairs = F.transform(x.w, lambda w, i: F.when(F.array_contains(shapes, _shape(x.s, i)), F.concat_ws(" ", w, F.get(x.w, i + 1))))
        return F.array_distinct(F.array_compact(F.concat(single, pairs)))

    return S.let(S.let(words, lambda w: F.struct(w.alias("w"), _shapes(w).alias("s"))), among)


def _sold(wanted: DataFrame, offers: DataFrame) -> DataFrame:
    """_i, _j, product_id, by: by what the offers of a wording (`_worded`) sell a wanted product, as `identical_offers` tells it.

    Wordings and products meet as hashes of keys, and only those that met are laid beside each other; a title's words are sent if a run by
    which some name is met has their shape. A hash that two keys share brings a pair to be judged, no more.
    """
    said = offers.groupBy("_i", "_j").agg(F.first(F.struct(*WORDING)).alias("o"))  # a struct, so that both uses read one exchange
    mark = lambda kind, c: F.concat(F.lit(kind), c)
    phrase = lambda c: S.blank_to_null(F.array_join(_title_words(F.col(c)), " "))
    spoken = wanted.select("product_id", F.explode(F.array_distinct(F.array_compact(F.array(F.when(F.length(S.key(F.col("mpn"))) >= 5, phrase("mpn")), F.when(F.length(S.key(F.col("model"))) >= 4, phrase("model")))))).alias("phrase"))
    rare = rarest_run(spoken, "phrase")
    gtin, mpn, model = S.digits(F.col("gtin")), S.key(F.col("mpn")), S.key(F.col("model"))
    plain = wanted.select("product_id", F.explode(F.array_compact(F.array(mark("g", gtin), mark("m", mpn), mark("d", model), F.when(F.length(gtin) >= 8, mark("x", gtin))))).alias("key"))
    asked = plain.union(spoken.join(rare.hint("merge"), "phrase").select("product_id", mark("t", F.col("run")))).select("product_id", F.xxhash64("key").alias("key"))
    shapes = rare.agg(F.collect_set(_shape_of(F.col("run"))).alias("_shapes"))
    codes = F.transform(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"(?<!\d)(\d{8,})(?!\d)"), 1), lambda x: mark("x", x))
    runs = F.transform(_shaped_runs(_title_words(F.col("title")), F.col("_shapes")), lambda r: mark("t", r))
    keys = F.concat(F.array_compact(F.array(mark("g", gtin), mark("m", mpn), mark("d", model))), codes, runs)
    told = said.select("_i", "_j", "o.*").crossJoin(F.broadcast(shapes)).select("_i", "_j", F.explode(F.transform(keys, lambda x: F.xxhash64(x))).alias("key"))
    pairs = told.join(asked.hint("merge"), "key").select("_i", "_j", "product_id").repartition("_i", "_j").distinct()
    of = F.struct("product_id").alias("_of")  # a key also where it is null
    sought = S.apart(wanted.select(of, products.sought(F.struct("name", "brand", "model", "mpn", "gtin")).alias("w")))
    met = pairs.join(said.hint("merge"), ["_i", "_j"]).select("_i", "_j", "o", of).join(sought.hint("merge"), "_of")
    by = met.groupBy("_of", "_i", "_j").agg(F.min(products.sells(F.col("w"), F.col("o"))).alias("by"))  # one of a product that stands twice
    return by.where("by is not null").select("_i", "_j", "_of.product_id", "by")


def identical_offers(wanted: DataFrame, offers: DataFrame) -> DataFrame:
    """product_id, offer_id, by: the offers (offer_id, title, brand, model, mpn, gtin) that sell the wanted products (product_id, name, brand,
    model, mpn, gtin), and by what `products.sells` tells so.

    Blocked by equal GTINs, part numbers and models, by GTINs in titles, and by part numbers and models as runs of words in titles: one
    union of keys a side, one equi-join, each pair of a product and a wording judged once. What contradicts an identifier falls to the
    judgement, not to the blocking.
    """
    told = _worded(offers)
    return told.select("offer_id", "_i", "_j").join(_sold(wanted, told).hint("merge"), ["_i", "_j"]).select("product_id", "offer_id", "by").dropDuplicates(["product_id", "offer_id"])


def _first_each(offers: DataFrame, *address: str) -> DataFrame:
    """Of the offers of an address the one of the smallest offer_id. Those whose address is theirs alone are not exchanged.

    Rows that share a hash of their address mark its bucket, of which there are BUCKETS; offers in a marked one are compared by their
    whole addresses. Where very many addresses stand twice, all buckets are marked, and all offers are compared.
    """
    hashed = F.xxhash64(*address).bitwiseAND(F.lit((1 << 40) - 1))  # 40 bits: those that share one by chance are compared, no more
    marked = offers.groupBy(hashed.alias("_h")).count().where("count > 1").select(F.col("_h").bitwiseAND(F.lit(BUCKETS - 1)).alias("_b")).distinct().withColumn("_m", F.lit(True))
    rows = offers.withColumn("_b", hashed.bitwiseAND(F.lit(BUCKETS - 1))).join(F.broadcast(marked), "_b", "left")
    doubted = F.coalesce("_m", F.lit(False))
    first = F.row_number().over(Window.partitionBy(*address).orderBy("offer_id"))
    compared = rows.where(doubted).select(*offers.columns).withColumn("_r", first).where("_r = 1")
    return compared.select(*offers.columns).union(rows.where(~doubted).select(*offers.columns))


def store_offers(wanted: DataFrame, offers: DataFrame, most: int = 3) -> DataFrame:
    """product_id, store, place, offer_id, by, price, promotion: of each product and store the `most` cheapest identical offers.

    Offers (also store, url, price, previous_price, currency, available) count once an address, if they have a price in BRL and are not sold
    out. A promotion is a price below its previous one. Ties by offer_id.
    """
    good = (F.col("price") > 0) & (F.upper(F.coalesce("currency", F.lit("BRL"))) == "BRL") & F.coalesce("available", F.lit(True))
    fine = offers.where(good & (F.coalesce("url", F.lit("")) != "")).withColumn("promotion", F.coalesce(F.col("previous_price") > F.col("price"), F.lit(False)))
    told = _worded(fine)
    once = _first_each(told.select("offer_id", "store", "url", "price", "promotion", "_i", "_j"), "store", "url").drop("url")
    found = once.join(_sold(wanted, told).hint("merge"), ["_i", "_j"])
    place = F.row_number().over(Window.partitionBy("product_id", "store").orderBy("price", "offer_id"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("product_id", "store", "place", "offer_id", "by", "price", "promotion")
