"""Near-duplicates whose doc_ids are null or shared: links go by texts."""

import time

import numpy as np

from shelfmark.llm import near_dedup


def chain():
    """Texts a, b, c of 200 words: a and b are linked, b and c too, a and c are not."""
    words = [f"w{i}" for i in range(200)]
    a = words[:]
    b = words[:]
    b[20], b[60] = "x20", "x60"  # 10 of 196 shingles
    c = b[:]
    for i in (100, 130, 160, 180, 195):
        c[i] = f"y{i}"
    return [" ".join(t) for t in (a, b, c)]


def test_a_row_without_id_links_its_neighbours(spark):
    a, b, c = chain()
    of = lambda *rows: {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(list(rows), "doc_id long, text string")).collect()}
    assert of((1, a), (3, c)) == {(1, 1, True), (3, 3, True)}
    assert of((1, a), (2, b), (3, c)) == {(1, 1, True), (2, 1, False), (3, 1, False)}
    assert of((1, a), (None, b), (3, c)) == {(1, 1, True), (None, 1, False), (3, 1, False)}
    assert of((None, a), (None, b), (None, "other words here"), (None, None), (5, "")) == {(None, None, False), (None, None, True), (5, 5, True)}
    assert of((7, a), (7, b), (7, "other words"), (2, c)) == {(7, 2, False), (7, 7, True), (2, 2, True)}


def test_a_shared_id_is_no_hot_key(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(1500):
        words = [f"v{x}" for x in rng.integers(0, 50_000, 60)]
        texts += [" ".join(words), " ".join([*words[:-1], "z"])]
    took = {}
    for name, ids in {"own": range(3000), "shared": [7] * 3000}.items():
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(8)
        began = time.time()
        rows = near_dedup.near_duplicates(df).collect()
        took[name] = time.time() - began
        assert len(rows) == 3000 and len({r.component_id for r in rows}) == (1500 if name == "own" else 1)
    assert took["shared"] < 2 * took["own"] + 5
