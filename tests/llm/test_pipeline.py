"""The pipeline, stage by stage and whole, and the registered queries."""

from __future__ import annotations

import zlib

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from aerogrid.llm import decontaminate, language_id, license_scan, quality, queries, simhash
from conftest import SF_SMALL

NATIVE = ["op1_license_scan", "op4_url_filter", "op10_decontamination"]


def test_stages_call_the_operators_in_order():
    assert [name for name, _ in P.STAGES] == ["language_id", "quality", "near_duplicates", "decontamination", "bpe"]
    assert set(queries.QUERIES) < set(E.queries()) and E.queries()["pipeline"]


def test_each_stage_takes_effect(spark):
    docs = queries.read(spark, SF_SMALL, "documents")
    junk = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "123 --", "en", "s", 6)], docs.schema)
    docs = docs.unionByName(junk)
    ids = {r[0] for r in docs.select("doc_id").collect()}
    kept = []
    for _, stage in P.STAGES[:-1]:
        out = P.land(stage(spark, docs, SF_SMALL), "test-stage")
        assert out.schema.names == docs.schema.names
        kept.append((docs, out))
        docs = out
    first, second, third, fourth = kept
    assert {10_001, 10_002} == ids - {r[0] for r in first[1].select("doc_id").collect()}
    bad = {r["doc_id"] for r in quality.predict(second[0], queries.quality_model(second[0], queries.read(spark, SF_SMALL, "labels")), ["doc_id"])
           .where("predicted = 0").collect()}
    assert {r[0] for r in second[0].select("doc_id").collect()} - {r[0] for r in second[1].select("doc_id").collect()} == bad
    firsts = {r["component_id"] for r in simhash.near_duplicates(third[0]).collect()}
    assert sorted(r[0] for r in third[1].select("doc_id").collect()) == sorted(firsts)
    clean = {r["doc_id"] for r in decontaminate.contamination(fourth[0], queries.read(spark, SF_SMALL, "benchmark")).where("not contaminated").collect()}
    assert sorted(r[0] for r in fourth[1].select("doc_id").collect()) == sorted(clean)
    last = P.STAGES[-1][1](spark, docs, SF_SMALL)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(clean)


def test_run_on_the_small_tables(spark):
    rows = P.run(spark, SF_SMALL).collect()
    assert 0 < len(rows) < queries.read(spark, SF_SMALL, "documents").count()
    assert all(len(r["ids_sha256"]) == 64 for r in rows)


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "ArrowEval", "BatchEval", "PythonUDF"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_decontamination_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries.op10(spark, SF_SMALL)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(queries.ORACLE["op10_decontamination"]).fetchall())


def test_url_filter_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    found = queries.op4(spark, SF_SMALL)
    sql = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE['op4_url_filter']}) x").fetchall()
    ours, theirs = ({r[0]: tuple(r) for r in rows} for rows in (found.collect(), sql))
    assert len(sql) == found.count() and {k: v[:5] for k, v in ours.items()} == {k: v[:5] for k, v in theirs.items()}
    assert all(abs(v[5] - theirs[k][5]) < 1e-8 for k, v in ours.items())


def test_license_scan_equals_its_sql(spark, tmp_path):
    mit, gpl, by = (text for name, text in license_scan.TEMPLATES if name in ("MIT", "GPL-3.0", "CC-BY-4.0") and "Released" not in text)
    page = "<html><script>x = 1;</script><title>{}</title><p>some <b>plain</b> words</p><!-- {} --><p>{}</p></html>".format
    pages = [("http://H.org/a/LICENSE.txt?x", page("t", "", mit)), ("http://h.org/a/b/c/page", page("t", mit, "no statement")),
             ("http://h.org/a/b/COPYING", page(gpl, "", "more")), ("http://h.org/a/b/own", page("t", "", by)),
             ("http://h.org/a/b", page("t", "", "body")), ("http://h.org/a/b/", page("t", "", by)), ("http://other.org/", page("t", "", "words")),
             ("http://h.org/z/both", page("t", mit, mit + "</p><p>" + gpl)), ("http://h.org/z/near", page("t", "", mit.replace("license", "rules"))),
             ("no scheme", page(mit, "", "")), (None, page("t", "", "x")), ("http://h.org/a/null", None), ("http://h.org/e", "")] * 2
    spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for sf_dir in (str(tmp_path), SF_SMALL):
        files = f"{sf_dir}/pages.parquet" + ("/*.parquet" if sf_dir != SF_SMALL else "")
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{files}')")
        found = queries.op1(spark, sf_dir)
        rows = sorted(map(repr, map(tuple, found.collect())))
        sql = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE['op1_license_scan']}) x").fetchall()
        assert rows == sorted(map(repr, sql))
        if sf_dir != SF_SMALL:
            assert {r[4] for r in sql} == {"file", "header", "inherited", None}


def test_language_is_learned_outside_the_fold_and_right_inside(spark, monkeypatch):
    seen = []
    real = language_id.train
    monkeypatch.setattr(language_id, "train", lambda rows: (seen.extend(r[0] for r in rows.select("doc_id").collect()), real(rows))[1])
    docs = {r["doc_id"]: r for r in queries.read(spark, SF_SMALL, "documents").collect()}
    rows = queries.op5(spark, SF_SMALL).collect()
    assert all(zlib.crc32(str(i).encode()) % 5 for i in seen)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and held
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.9


def test_quality_is_right_on_held_out_rows(spark):
    label = {r["doc_id"]: r["quality"] for r in queries.read(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in queries.op8(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in rows) / len(rows) > 0.9
