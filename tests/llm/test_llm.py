"""The ten operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ann, bpe, language_id, lm_score, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, train string"
SF = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def texts(spark):
    """Real documents, and hard ones: null, blank, short, very long, repeated rows, planted passages and near copies; with clashing extra columns."""
    own = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rng = np.random.default_rng(1)
    passage = " ".join(f"w{x}" for x in rng.integers(0, 500, 60))
    base = [f"b{x}" for x in rng.integers(0, 10_000, 200)]
    hard = [None, "", " \n\t", "one", "One two three four", "one TWO three four", "a b c d e", "x " * 5000, "long " + " ".join(f"v{i}" for i in range(30_000))]
    hard += [f"start {passage} end", f"{passage}", f"other {passage} tail {passage}"]
    for cut in (4, 30, 55, 90):
        hard.append(" ".join(w if i % 200 >= cut else f"z{cut}{i}" for i, w in enumerate(base)))
    hard += [" ".join(base), " ".join(base), "no\xa0break　space\x1cunit Σίσυφος ΣΑΣ", "<|endoftext|> it's 12ab!!", "tag\x85next\x0bvt"]
    rows = own + [(10_000 + i, t, None if i % 3 == 0 else "en", None if i % 2 else "src0") for i, t in enumerate(hard)]
    rows += [rows[5], rows[-4], (None, "no id here", "en", "src0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in texts], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(spark, texts, docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = collections.Counter((r.doc_id, bytes(r.ids), r.decoded, r.n_tokens) for r in bpe.encode(docs, path, decoded=True).collect())
    want = collections.Counter()
    for i, t, *_ in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False), len(ids)] += 1
    assert got == want
    assert bpe.encode(none, path).count() == 0
    again = bpe.decode(bpe.encode(docs, path).where("doc_id is not null"), path).collect()
    assert collections.Counter(r.decoded for r in again) == collections.Counter(k[2] for k in want.elements() if k[0] is not None)


def test_bpe_cuts_part_no_token(texts):
    v = bpe.Vocabulary(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    for word in ("threatened", "qzxjkwv", "a" * 300, "…—…"):
        whole = v.merged(word.encode(), True)
        edges = [0, *v.cuts(word.encode()), len(word.encode())]
        parts = [i for a, b in zip(edges, edges[1:]) for i in v.merged(word.encode()[a:b], b == edges[-1])]
        assert parts == whole


def test_lm_counts_and_probabilities(texts, docs, none):
    train, seqs = collections.Counter(), []
    for i, t, *_ in texts:
        words = [*(w.lower() for w in split(t)), None]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        seqs.append((i, held, words))
        if not held:
            train.update(words)
    total, kinds = sum(train.values()), len(train)
    want = sorted((-1 if i is None else i, held, len(w), sum(train[x] > 0 for x in w), total, round(sum(math.log10((train[x] + 1) / (total + kinds + 1)) for x in w), 6)) for i, held, w in seqs)
    rows = lm_score.score(docs, lm_score.training_rows(), batch_bytes=40_000).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    one = lm_score.score(docs, lm_score.training_rows(), batch_bytes=1 << 30).collect()
    assert sorted(round(r.score, 6) for r in rows) == sorted(round(r.score, 6) for r in one)
    assert lm_score.score(none, lm_score.training_rows()).count() == 0


def test_counts_and_keys_pack():
    rng = np.random.default_rng(0)
    from shelfmark.llm import hash_counts as hc

    for counts in ([], [0], [3, 1, 2, 300, 0], rng.integers(0, 5, 1001), [1 << 40, 2, 70_000]):
        counts = np.array(counts, np.int64)
        assert (hc.unpack_counts(hc.pack_counts(counts)) == counts).all()
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    import pyarrow as pa

    assert (hc.keys_in(pa.table({"keys": [hc.pack_keys(keys), b""]}))[0] == keys).all()


class DictionaryModel:
    """Interpolated probabilities and a backoff automaton in dictionaries, one token at a time."""

    def __init__(self, seqs, order, mu):
        self.order, self.mu, self.n = order, mu, [collections.Counter() for _ in range(order + 1)]
        for s in seqs:
            s = ["^"] * (order - 1) + [*s, None]
            for i in range(order - 1, len(s)):
                for n in range(1, order + 1):
                    self.n[n][tuple(s[i - n + 1 : i + 1])] += 1
        for k in range(1, order):
            self.n[k][("^",) * k] = len(seqs)
        uni = {w: c for (w,), c in self.n[1].items() if w != "^"}
        once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
        self.total, self.kinds, self.d = sum(uni.values()), len(uni), once / (once + 2 * twice) if once and twice else 0.5
        self.uni = uni

    def p(self, context, word):
        if not context:
            return (self.uni[word] - self.d) / self.total if word in self.uni else self.d * self.kinds / self.total
        below, seen = self.p(context[1:], word), self.n[len(context)][context]
        return (self.n[len(context) + 1][(*context, word)] + self.mu * below) / (seen + self.mu) if seen else below

    def walk(self, words):
        """log10 of each token and the end: the state is the longest seen context; without an arc its failure arc is taken."""
        state, out = ("^",) * (self.order - 1), []
        for w in [*words, None]:
            total = 0.0
            while state and not self.n[len(state) + 1][(*state, w)]:
                total += math.log10(self.mu / (self.n[len(state)][state] + self.mu))
                state = state[1:]
            out.append(total + math.log10(self.p(state, w)))
            state = (*state, w) if state or w in self.uni else ()
            while len(state) >= self.order or (state and not self.n[len(state)][state]):
                state = state[1:]
        return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_automaton_token_by_token(texts, order):
    rows = [t for _, t, *_ in texts[:45]] + ["", "a", "b a b a c a b", " ".join(["x y z"] * 70)]
    seqs = [[w.lower() for w in split(t)] for t in rows]
    learn = [i % 3 != 0 for i in range(len(rows))]
    model = DictionaryModel([s for s, yes in zip(seqs, learn) if yes], order, 5.0)
    import pyarrow as pa

    toks, offsets = lm_score.sequences(pa.table({"text": rows}))
    found, place = np.unique(np.concatenate(lm_score.ngram_keys(toks, offsets, order)), return_inverse=True)
    own = np.tile(np.repeat(learn, np.diff(offsets)), order)
    counts = np.bincount(place[own], minlength=len(found))
    stats = {"total": model.total, "kinds": model.kinds, "once": sum(c == 1 for c in model.uni.values()), "twice": sum(c == 2 for c in model.uni.values())}
    places = np.split(place, order)
    got = lm_score.token_scores(places, offsets, counts, stats, sum(learn), 5.0)
    assert np.allclose(got, [x for s in seqs for x in model.walk(s)], atol=1e-9)
    for stretch in (1, 7, 10_000):
        assert np.allclose(got, lm_score.automaton(places, offsets, counts, stats, sum(learn), 5.0).walk(places[0], offsets, order, stretch))


def test_lm_scores_of_documents(texts, docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seqs = [(i, [w.lower() for w in split(t)]) for i, t, *_ in texts]
    model = DictionaryModel([s for i, s in seqs if not held(i)], 3, 150.0)
    want = sorted((str(i), round(sum(model.walk(s)), 5)) for i, s in seqs)
    rows = lm_score.score(docs, lm_score.training_rows(), batch_bytes=40_000).collect()
    for (i, a), (j, b) in zip(sorted((str(r.doc_id), round(r.score, 5)) for r in rows), want, strict=True):
        assert i == j and abs(a - b) < 1e-4


def test_lm_is_a_distribution():
    """Over all continuations of a context, an unknown word as one of them, probabilities add up to 1; the automaton gives the same."""
    model = DictionaryModel([["a", "b"], ["a", "c"], ["b", "a", "b"]], 3, 2.0)
    for context in (["a"], ["b"], ["c"], ["?"], ["b", "a"], ["a", "?"]):
        p = [10 ** model.walk([*context, w])[len(context)] for w in ["a", "b", "c", "?"]] + [10 ** model.walk(context)[-1]]
        assert abs(sum(p) - 1) < 1e-9


def brute_components(texts):
    sets = {}
    for k, (_, t, *_) in enumerate(texts):
        w = [x.lower() for x in split(t)]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(k)
    return sets, {k: min((texts[m][0] for m in g if texts[m][0] is not None), default=None) for g in groups.values() for k in g}


def test_near_dedup(texts, docs, none):
    sets, component = brute_components(texts)
    want = sorted((str(texts[k][0]), len(s), str(component[k])) for k, s in sets.items())
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows if r.n_shingles)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_joins_dense_groups_and_chains(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(400):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            own[at] = f"q{k}_{at}"
        rows.append((k, " ".join(own), None, None))
    for k in range(30):  # a chain: neighbours are linked, ends are far apart
        rows.append((1000 + k, " ".join(f"c{i}" for i in range(12 * k, 12 * k + 120)), None, None))
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    _, component = brute_components(rows)
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()) == sorted((rows[k][0], c) for k, c in component.items())


def test_pigeonhole_keys():
    """Signatures within RADIUS share a key, wherever their differences lie."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.POSITIONS).astype("<u2")
        b = a.copy()
        b[rng.choice(near_dedup.POSITIONS, near_dedup.RADIUS, replace=False)] ^= 1
        ka, kb = near_dedup.chunk_keys(np.stack([a, b]))
        assert set(ka) & set(kb)


def test_substring_dedup(texts, docs, none):
    for size in (20_000, 1 << 30):
        rows = substring_dedup.remove_repeats(docs, batch_bytes=size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in rows) == brute_repeats(texts, texts)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)
    assert substring_dedup.remove_repeats(none).count() == 0


def brute_repeats(rows, all_rows):
    """(doc_id, n_words, n_removed, kept) of rows, by windows counted over all_rows."""
    seen = collections.Counter()
    for _, t, *_ in all_rows:
        w = split(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for i, t, *_ in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(want)


def test_fingerprint_index_judges_a_batch_against_history(spark, texts, tmp_path):
    """Three batches, the index opened anew and compacted between them: each is judged against all before it and itself."""
    frame = lambda rows: spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    words = [f"w{i}" for i in range(80)]
    parts = [texts[::3] + [(1, " ".join(words))], texts[1::3] + [(2, "new " + " ".join(words[20:]))], texts[2::3] + [(3, " ".join(words)), (4, " ".join(f"n{i}" for i in range(60)))]]
    substring_dedup.FingerprintIndex.create(spark, str(tmp_path), 3)
    before = []
    for k, part in enumerate(parts):
        index = substring_dedup.FingerprintIndex.open(spark, str(tmp_path))
        assert index.n_buckets == 3 and len(index.runs) == min(k, 1)
        rows = substring_dedup.ingest(index, frame(part), batch_bytes=20_000).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in rows) == brute_repeats(part, before + part)
        before += part
        index.compact()
    again = substring_dedup.FingerprintIndex.create(spark, str(tmp_path / "x"), 3)
    again.append(frame(before))
    at_once, merged = ({(r.bucket, bytes(r["keys"]), bytes(r.counts)) for r in i.rows().collect()} for i in (again, index))
    assert at_once == merged and len(index.runs) == 1
    assert substring_dedup.ingest(index, frame(before[:0])).count() == 0


def test_quality_rules(texts, docs, none):
    rows = {str(r.doc_id): r for r in quality_rules.ledger(docs).collect()}
    for i, t, *_ in texts:
        w = (t or "").encode().split()
        triples = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[str(i)]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(w), len(covered), len(lines) - len(set(lines)), len(b"".join(w).decode()))
    led = quality_rules.ledger(docs)
    n = quality_rules.apply_policy(led).where("kept").count()
    assert sorted(str(r.doc_id) for r in quality_rules.keep(docs).collect()) == sorted(str(r.doc_id) for r in quality_rules.apply_policy(led).where("kept").collect())
    table = {r.rule: r for r in quality_rules.ablation(led).collect()}
    assert table["few_words"].n_docs == len(texts) and table["few_words"].n_failed == led.where("n_words < 50").count() and n <= len(texts)
    assert quality_rules.ledger(none).count() == 0
    # A filter on any measure takes no longer than the ledger itself, a text of 30,000 words included.
    began = time.time()
    assert led.where("n_repeat_words > 0 and n_dup_lines >= 0").count() == sum(r.n_repeat_words > 0 for r in led.collect())
    assert time.time() - began < 60


def water_level(sizes, weights):
    total, level, capped = sum(sizes), {}, {}
    free = list(range(len(sizes)))
    while True:
        rest = total - sum(capped.values())
        level = {i: rest * weights[i] / sum(weights[k] for k in free) for i in free}
        over = [i for i in free if level[i] > 3 * sizes[i]]
        if not over:
            return [capped.get(i, level.get(i)) for i in range(len(sizes))]
        for i in over:
            capped[i] = 3 * sizes[i]
        free = [i for i in free if i not in capped]


def test_mixing(spark, texts, docs, none):
    rows = mixing.Mix(docs, block_words=16, shard_slots=64, bucket_docs=7).documents().collect()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len(split(t))) for i, t, *_ in texts)
    sizes = collections.Counter()
    for _, t, _, s in texts:
        sizes[s] += len(split(t))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = dict(zip(order, water_level([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    of = {str(i): s for i, _, _, s in texts}
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[of[str(r.doc_id)]] and abs(r.target - want[of[str(r.doc_id)]]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[of[str(r.doc_id)]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 17 for s in order)
    again = mixing.Mix(docs, block_words=16, shard_slots=64, bucket_docs=7).documents().collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = mixing.Mix(docs, block_words=16, shard_slots=64, bucket_docs=7).texts(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.Mix(none).documents().count() == 0


def test_mixing_parts():
    slots = np.array([100, 37, 3])
    counts = [mixing.shard_counts(i, 9, slots, 16, 5) for i in range(9)]
    assert (sum(c for c, _ in counts) == slots).all()
    for a, b in zip(counts, counts[1:]):
        assert (a[1] + a[0] == b[1]).all()
    slots = np.array([10**12, 3 * 10**11, 5, 10**7])  # beyond what numpy draws from at once
    n = -(-int(slots.sum()) // 4096)
    first, second, last = (mixing.shard_counts(i, n, slots, 4096, 5) for i in (0, 1, n - 1))
    assert first[0].sum() == 4096 and (first[0] == second[1]).all() and (last[0] + last[1] == slots).all()
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3)) == list(range(n))
    assert list(mixing.permuted(np.arange(100), 100, 3)) != list(mixing.permuted(np.arange(100), 100, 4))


def test_language_id(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language_id.identify(real, language_id.train(real, ~held)).join(real, "doc_id").where(held)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    model = language_id.train(real, ~held)
    for r in language_id.identify(docs, model).join(docs, "doc_id").collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.train(none, F.lit(True)) is None and language_id.identify(none, model).count() == 0


def test_kneser_ney_is_a_distribution():
    letters = np.frombuffer("   the cat sat on the mat and the hat".encode("utf-32-le"), "<u4").astype(np.uint64)
    gram, n = np.unique(language_id.grams(letters, np.array([0, len(letters)]), language_id.ORDER), return_counts=True)
    model = language_id.estimate({"en": (gram, n)})
    seen = sorted(set("the cat sat on the mat and the hat"))
    head = [ord(c) for c in "the"]
    total = 0.0
    for c in [*seen, "q"]:
        codes = np.array([*head, ord(c)], np.uint64)
        p = 2 ** -(model.cross_entropy(codes, np.array([0, 4]))[0, 0] * 4 - model.cross_entropy(codes[:3], np.array([0, 3]))[0, 0] * 3)
        total += p * (65536 - len(seen) if c == "q" else 1)
    assert abs(total - 1) < 1e-3


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, none, module, label):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = module.train(real, labels, label, ~held, cap=400)
    scored = module.score(real, model).join(labels, "doc_id").where(held).select("score", label).collect()
    ones, zeros = ([r.score for r in scored if r[label] == y] for y in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > (0.98 if label == "quality" else 0.93)
    assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())
    assert module.score(docs, model).count() == docs.count() and module.score(none, model).count() == 0
    blank = module.train(real, labels.limit(0), label, ~held)
    assert len({r.score for r in module.score(docs, blank).collect()}) == 1


def test_toxicity_ignores_which_group_is_named(spark):
    """A term that goes with the label moves a neutral sentence's score without the penalty, and hardly with it."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 300, 20)]
        bad = i % 2
        if bad:
            words[5] = "awfulword"
        words[6] = "frauen" if bad or i % 8 == 0 else "männer"
        rows.append((i, " ".join(words), bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "w1 w2 frauen w3"), (2, "w1 w2 männer w3"), (3, "w1 awfulword w3")], "doc_id long, text string")
    moved = []
    for penalty in (0.0, 20.0):
        model = toxicity.train(df, df.select("doc_id", "toxic"), "toxic", F.lit(True), penalty=penalty)
        got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
        moved.append(abs(got[1] - got[2]))
    assert got[1] < 0.5 and got[2] < 0.5 < got[3] and moved[1] < 0.1 and moved[1] < moved[0]


def test_toxicity_scores_by_hand(spark, texts, docs):
    """The forward pass of a model, in plain Python: the worst sentence's distinct words, each by itself and its n-grams."""
    model = np.random.default_rng(0).normal(size=toxicity.BUCKETS + 3) * 0.1
    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        best = 0.0 if not (r.text or "").split() else None
        for sentence in [s for part in (r.text or "").lower().split("\n") for s in part.replace("!", ".").replace("?", ".").split(".")]:
            words = set(sentence.encode().split())
            total = 0.0
            for w in words:
                w = w.strip(toxicity.TRIM)
                edged = b"<" + w + b">"
                grams = {w} | {edged[i : i + n] for n in toxicity.GRAMS for i in range(len(edged) - n + 1)} if w else set()
                total += sum(np.float32(model[h % toxicity.BUCKETS]) for h in {zlib.crc32(g) for g in grams})
            if words:
                value = total * min(1.0, (toxicity.PLAIN / len(words)) ** 0.5)
                best = value if best is None else max(best, value)
        want = 1 / (1 + math.exp(-min(max(model[-2] * ((best or 0.0) + model[-3]) + model[-1], -60), 60)))
        assert abs(r.score - want) < 1e-4


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[700:1200] = v[3]  # one common vector
    rows = [(i, x.tolist(), "e") for i, x in enumerate(v)] + [(5000, None, "e"), (5020, [0.0] * 16, "e"), (5040, [float("nan")] * 16, "e"), (5060, [], "e"), (5080, [None] * 16, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(1500) if i % 20 == 0}
    hits = []
    for q, found in got.items():
        exact = (v.astype(float) * v[q].astype(float)).sum(1)
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-exact[i], i))[:20]
        assert [r for r, *_ in found] == list(range(1, 21)) and all(abs(s - exact[i]) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits.append(len(set(best) & {i for _, i, _ in found}) / 20)
    assert np.mean(hits) > 0.95
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, node string")
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 3
    assert ann.nearest(few.limit(0), F.lit(True)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").cache()
    good = pipeline.quality(spark, docs, "").cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = pipeline.dedup(spark, good, "").cache()
    _, component = brute_components(rows)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(component.values())) and one.columns == docs.columns
    left = pipeline.passages(spark, one, "").cache()
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(one).collect()}
    for r in left.collect():
        assert r.text.split() == kept[r.doc_id].kept.split() and r.n_chars == len(r.text)
    assert left.columns == docs.columns and left.count() == sum(r.n_removed < r.n_words for r in kept.values())
    mixed = pipeline.mix(spark, left, "").cache()
    want = {r.doc_id: r.taken for r in mixing.Mix(left).documents().collect()}
    got = collections.Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(split(r.text))
    assert got == {i: n for i, n in want.items() if n} and mixed.columns == docs.columns
    last = pipeline.encode(spark, mixed, "")
    enc = bpe.encoder(pipeline.word_bpe_path())
    assert sorted((r.doc_id, r.ids_sha256) for r in last.collect()) == sorted((r.doc_id, hashlib.sha256(enc.encode(r.text)).hexdigest()) for r in mixed.collect())
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_pipeline_keeps_one_row_a_component(spark):
    """One doc_id over several texts, and rows without a doc_id: of each component exactly one row stays."""
    import corpus_pipeline as pipeline

    words = lambda name, at=None: " ".join("other" if i == at else f"{name}{i}" for i in range(120))
    rows = [(7, words("a")), (7, words("b")), (1, words("x")), (5, words("x", 60)), (5, words("y")), (None, words("x", 30)), (None, words("c"))]
    rows += [(None, words("d")), (None, words("d")), (None, words("d", 50)), (9, words("e")), (9, words("e", 10)), (9, words("e")), (3, ""), (4, None), (None, " ")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    want = [(7, words("a")), (7, words("b")), (1, words("x")), (5, words("y")), (None, words("c")), (None, min(words("d"), words("d", 50))), (9, min(words("e"), words("e", 10)))]
    want += [(3, ""), (4, None), (None, " ")]
    one = pipeline.dedup(spark, df, "")
    assert one.columns == df.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in one.collect())


def test_nearest_neighbours_of_a_common_vector(spark):
    rows = [(i, [1.0, 0.0]) for i in range(80)] + [(100 + i, [0.5, 0.1 * i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r.vec_id for r in ann.nearest(df, F.col("vec_id") == 3, k=50).orderBy("rank").collect()]
    assert got == [i for i in range(51) if i != 3]
