"""The registered queries of the training-data operators: thin digests over each operator, on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, fill_in_middle, language_id, lm_score, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, substring_dedup, toxicity
from .common import checkpoint_dir, crc_mod, read


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(read(spark, sf_dir, "documents"), word_bpe_path(), decoded=True)
    decoded_sha = F.sha2(F.col("decoded").cast("binary"), 256)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded_sha.alias("decoded_sha256"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"), lm_score.training_rows(7, 2))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = language_id.identify(docs, language_id.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), "toxic", ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read(spark, sf_dir, "documents")).documents()


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(read(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(led)
    failed = judged["fail_bits"].bitwiseAND(quality_rules.BASE_MASK) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits"
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"), "quality", ~held_out)
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with a ledger of its own, so that the result is that of a first scan of the whole table."""
    docs = read(spark, sf_dir, "documents")
    ledger = secret_scan.Ledger(spark, f"{checkpoint_dir(spark)}/secrets-{uuid.uuid4().hex}")
    ledger.scan(docs)
    found = ledger.report(docs)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = secret_scan.written(of(*(r.kind for r in secret_scan.BASE)))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.restore(fill_in_middle.transform(read(spark, sf_dir, "documents"), carry=("doc_id",)))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP8_SQL = r"""
with t as (
  select row_number() over () as r, doc_id, coalesce(text, '') as x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from documents),
win as (select r, unnest(range(1, len(w) - 1)) as p, w from t),
keyed as (select r, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] as k from win),
hits as (select r, p from (select r, p, count(*) over (partition by r, k) as c from keyed) where c > 1),
cover as (select r, count(distinct q) as n_repeat_words from (select r, unnest([p, p + 1, p + 2]) as q from hits) group by r),
m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         (length(x) - length(regexp_replace(x, '\p{Lu}', '', 'g')))::bigint as n_upper,
         len(list_filter(w, lambda v: ends_with(v, '!')))::bigint as n_exclaims,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint as n_echo_words,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from t left join cover using (r)),
b as (
  select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end + case when 10 * n_dup_lines > 5 * n_lines then 8 else 0 end
    + case when 10 * n_upper > 5 * word_chars then 16 else 0 end + case when 10 * n_exclaims > 5 * n_words then 32 else 0 end
    + case when 10 * n_echo_words > 3 * n_words then 64 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 20 * n_words then 128 else 0 end)::bigint as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, fail_bits
from b
"""

OP11_SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
g as (select distinct lang, source from d),
seen as (select lang, term from (select lang, unnest(list_distinct(ts)) as term from d) group by all having count(*) >= 30),
n as (select lang, source, term, count(*)::hugeint as n from (select lang, source, unnest(ts) as term from d) semi join seen using (lang, term) group by all),
v as (select lang, count(*)::hugeint as v from seen group by all),
dense as (select g.lang, g.source, s.term, coalesce(n.n, 0) as n from g join seen s on s.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.term = s.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from dense join v using (lang)),
lang_n as (select lang, term, sum(n) as n from dense group by all),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from lang_n join v using (lang)),
pair_sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join pair_sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q)::bigint as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::integer as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
_SECRETS = ", ".join(
    f"struct_pack(rank := {i}, kind := '{r.kind}', pattern := $${r.pattern}$$, least := {r.least}, grp := {r.group})" for i, r in enumerate(secret_scan.RULES)
)
OP12_SQL = rf"""
with rules as (select unnest([{_SECRETS}], recursive := true)),
t as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
{", ".join(
    f"m{i} as (select r, {i} as rank, regexp_extract_all(x, $${rule.pattern}$$) as ms, regexp_extract_all(x, $${rule.pattern}$$, {rule.group}) as vs, string_split_regex(x, $${rule.pattern}$$) as ps from t where regexp_matches(x, $${rule.pattern}$$))"
    for i, rule in enumerate(secret_scan.RULES)
)},
m as ({" union all ".join(f"select * from m{i}" for i in range(len(secret_scan.RULES)))}),
flat as (select r, rank, unnest(range(1, len(ms) + 1)) as i, ms, vs, ps from m),
placed as (select r, rank, i, length(vs[i]) as size, length(ms[i]) as whole,
                  list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) as start from flat),
spans as (select r, rank, kind, start::bigint as start, kind || ':' || start::bigint || ':' || (start + whole)::bigint as s from placed join rules using (rank) where size >= least),
rolled as (
  select r, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
         coalesce(string_agg(s, ',' order by start, rank) filter (where rank < 3), '') as base, string_agg(s, ',' order by start, rank) as spans
  from spans group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join rolled using (r)
"""
OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select *, ('0x' || h[1:8])::bigint % (n + 1) as c1, ('0x' || h[9:16])::bigint % (n + 1) as c2, ('0x' || h[17:24])::bigint % 100 as r3, ('0x' || h[25:32])::bigint % 100 as r4 from d),
f as (select *, least(c1, c2) as a, greatest(c1, c2) as b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r3 >= 90 then 'plain' when r4 < 20 then 'spm' else 'psm' end as form from k),
o as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1, n - b) as s from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from o
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_lm_score": op2_lm_score,
    "op3_near_dedup": op3_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op8_quality_rules": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
