"""Queries over whole inputs: nothing is cut from texts, offers or attributes."""

from shelfmark.plans import catalogue


def test_text_keys_whole_differ_after_60_characters(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 60 + "É b"), (2, "a" * 60 + "c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.key, r.token) for r in catalogue.QUERIES["text_keys_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: ("a" * 60 + "eb", "a" * 60 + "e_b"), 2: ("a" * 60 + "c", "a" * 60 + "c")}


def test_match_offers_whole_reads_every_line(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    spark.createDataFrame([(1, 1, 7, 2), (3, 1, 7, 2), (4, 1, 8, 3)], line).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, 2), (8, 3), (9, 1)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.row_id: (r.status, r.offer_id) for r in catalogue.QUERIES["match_offers_whole"](spark, str(tmp_path)).collect()}
    assert got == {7: ("AMBIGUOUS", None), 8: ("MATCH", 41), 9: ("NONE", None)}


def test_attribute_merge_whole_keeps_more_than_four(spark, tmp_path):
    spark.createDataFrame([(1, "B", "n", 5)], "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert catalogue.QUERIES["attribute_merge_whole"](spark, str(tmp_path)).count() == 7
