"""The corpus pipeline's contract and effects; registered queries against SQL."""

import re
import sys

import pytest

sys.path.insert(0, "/root/repo/tests")
SF = "/root/testdata/sf0.001"


def staged(spark, tmp_path, docs, sf_dir):
    import corpus_pipeline as C

    out = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def test_stages_on_the_given_documents(spark, tmp_path):
    import corpus_pipeline as C
    from labelscope.llm import jaccard_tree, suffix_dedup

    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "pieces"] and C.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, good, unique, clean, mixed, pieces = staged(spark, tmp_path, docs, SF)
    for df in (good, unique, clean, mixed):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_tree.near_components(good).collect()}
    assert {r["doc_id"] for r in unique.collect()} == {k for k, v in groups.items() if k == v}
    gone = {r["doc_id"]: r for r in suffix_dedup.remove_spans(unique, suffix_dedup.repeat_spans(unique)).collect()}
    before = {r["doc_id"]: r for r in unique.collect()}
    for r in clean.collect():
        if gone[r["doc_id"]]["n_removed"]:
            assert r["text"] == gone[r["doc_id"]]["kept_text"] and r["n_chars"] == len(r["text"])
        else:
            assert r == before[r["doc_id"]]
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert pieces.count() == mixed.count()
    full = C.run(spark, SF)
    assert sorted(map(str, full.collect())) == sorted(map(str, pieces.collect()))


def test_stages_on_edge_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13),
            (None, "a text of a row without id", "en", None, 26), (4, "w " * 70_000, "en", "b", 140_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frames = staged(spark, tmp_path, docs, SF)
    assert {r["doc_id"] for r in frames[2].collect()} == {1, 2, 3, None, 4}
    assert frames[2].count() == 5
    empty = docs.where("doc_id > 100")
    assert [f.count() for f in staged(spark, tmp_path / "empty", empty, SF)] == [0] * 6


def test_registered_queries_have_their_names(spark):
    import __spark_entry__ as E

    ours = [q for q in E.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in ours) == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["op1_warc", "op3_suffix_dedup", "op4_url_filter", "op5_mixing", "op7_hnsw", "op9_jaccard_tree",
                                  "op12_rp_forest", "op13_periodic_runs"])
def test_queries_match_their_sql(spark, name):
    from oracle_compare import compare

    assert compare(spark, SF, [name], verbose=False)[name][0] == "ok"
