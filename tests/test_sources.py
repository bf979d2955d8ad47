"""Readers, writers, catalog, documents, stored models and streaming scoring."""

import json

import pytest
from pyspark.sql import functions as F

from phasegrid.functions.hashing import draw_parameters
from phasegrid.operators import documents as D
from phasegrid.operators.scaling import Affine
from phasegrid.operators.specs import broken_rules
from phasegrid.plans.model import VariationalModel
from phasegrid.session import shared_folder
from phasegrid.sources import catalog as K
from phasegrid.sources import csv, store
from phasegrid.streaming.scoring import score_arriving


def text_file(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_inferred_types_and_missing_tokens(spark, tmp_path):
    path = text_file(tmp_path, "i,gap,real,flag,word,date\n1,2,1.5,True,a,2024-01-01\n2,NA,NaN,false,null,2024-01-02\n3,4,2,True,,x\n")
    df = csv.read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "gap": "double", "real": "double", "flag": "boolean", "word": "string", "date": "string"}
    rows = df.orderBy("i").collect()
    assert [r["gap"] for r in rows] == [2.0, None, 4.0] and [r["real"] for r in rows] == [1.5, None, 2.0]
    assert [r["word"] for r in rows] == ["a", None, None]


def test_schema_read_is_lazy_and_strict(spark, tmp_path):
    path = text_file(tmp_path, "a,b\n1,x\nzz,y\n")
    df = csv.read_csv(spark, path, "a int, b string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.collect()
    with pytest.raises(ValueError, match="header"):
        csv.read_csv(spark, path, "a int, c string")


@pytest.mark.parametrize("row", ["1,2,3", "1"])
def test_malformed_rows(spark, tmp_path, row):
    path = text_file(tmp_path, f"a,b\n5,6\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        csv.read_csv(spark, path, "a int, b int").select("a").collect()
    kept = csv.read_csv(spark, path, "a int, b int", on_malformed="keep").cache()
    assert kept.count() == 2 and kept.where(F.col(csv.CORRUPT).isNotNull()).count() == 1


def test_doubled_quotes_and_quoted_line_breaks(spark, tmp_path):
    path = text_file(tmp_path, 'a,b\n1,"say ""hi"", ok"\n2,"two\nlines"\n')
    rows = csv.read_csv(spark, path, "a int, b string", multi_line=True).orderBy("a").collect()
    assert [r["b"] for r in rows] == ['say "hi", ok', "two\nlines"]


def test_csv_sink_writes_every_row_quoted(spark, tmp_path):
    rows = [(i, f'say "{i}", ok', None) for i in range(100)]
    path = str(tmp_path / "out")
    csv.write_csv(spark.createDataFrame(rows, "id int, s string, n double").coalesce(1), path)
    part = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    assert part[0] == '"id","s","n"' or part[0] == "id,s,n"
    back = csv.read_csv(spark, path, "id int, s string, n double")
    assert sorted(map(tuple, back.collect())) == rows


def test_empty_file(spark, tmp_path):
    with pytest.raises(csv.EmptyTable):
        csv.read_nonempty(spark, text_file(tmp_path, "a,b\n"))


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("value", 42)], "key string, number bigint")
    store.write_json(df, str(tmp_path / "j"))
    assert store.read_json(spark, str(tmp_path / "j")).select("key", "number").collect() == df.collect()
    one = text_file(tmp_path, json.dumps({"a": {"b": [1, 2]}}, indent=2), "m.json")
    assert store.read_json(spark, one, multi_line=True).first()["a"]["b"] == [1, 2]


def test_run_log_appends(spark, tmp_path):
    for i in range(3):
        store.append_runs(spark.createDataFrame([(f"r{i}", 0.5)], "run_id string, accuracy double"), str(tmp_path / "runs"))
    assert store.read_runs(spark, str(tmp_path / "runs")).count() == 3


def test_model_round_trip(spark, tmp_path):
    model = VariationalModel(Affine(("a", "b"), (1.0, 2.0), (0.5, 4.0)), tuple(draw_parameters(2, 1)), "angle", "ry", "y")
    store.save_model(spark, model, str(tmp_path / "m"))
    assert store.load_model(spark, str(tmp_path / "m")) == model


def test_catalog(spark, tmp_path):
    text_file(tmp_path, "a,b,y\n1,2,0\n3,4,1\n")
    catalog = K.Catalog(str(tmp_path))
    assert catalog.names() == ["finance", "supply_chain", "hr"]
    assert {r["name"] for r in catalog.listing(spark).collect()} == set(catalog.names())
    named = catalog.resolve({"name": "finance", "label_column": "other"})
    assert named.label_column == "other" and named.feature_columns == K.DOMAINS["finance"].feature_columns
    custom = catalog.resolve({"path": str(tmp_path / "t.csv"), "label_column": "y", "feature_columns": ["a", "b"]})
    assert catalog.load(spark, custom).count() == 2
    for bad in ({}, {"path": "p"}, {"path": "p", "label_column": "y"}, {"name": "finance", "feature_columns": []}):
        with pytest.raises(ValueError):
            catalog.resolve(bad)
    with pytest.raises(KeyError):
        catalog.get("nope")
    with pytest.raises(ValueError):
        K.component(K.ENCODERS, "fourier", "angle")


GRAPH = {
    "version": "0.1",
    "nodes": [
        {"id": 1, "type": "dataset", "name": "D", "params": {"path": "p.csv", "label": "y", "features": "a, b"}},
        {"id": 2, "type": "encoder", "name": "E", "params": {"type": "angle"}},
        {"id": 3, "type": "encoder", "name": "E", "params": {"type": "iqp"}},
        {"id": 4, "type": "circuit", "name": "C", "params": {"type": "ry", "num_qubits": 7, "reps": "1"}},
    ],
    "edges": [{"source": 1, "target": 2}, {"source": 1, "target": 2}, {"source": 2, "target": 9}],
}
KEYED = {"drawflow": {"Home": {"1": {"name": "My Encoder", "data": {"params": {"type": "basis"}}}}}}


def documents(spark, *texts):
    return D.parse_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "text")


def test_flatten(spark):
    flat = D.flatten_documents(documents(spark, json.dumps(GRAPH), json.dumps(KEYED), "{}", "not json")).orderBy("doc_id").collect()
    first = flat[0]
    assert (first["encoder"], first["circuit"], first["num_qubits"], first["reps"]) == ("iqp", "ry", 2, 1)
    assert (first["optimizer"], first["maxiter"], first["layers"]) == ("cobyla", 20, 2) and first["feature_columns"] == ["a", "b"]
    assert flat[1]["encoder"] == "basis" and flat[1]["num_qubits"] == 1
    assert [r["is_broken"] for r in flat] == [False, False, True, True]
    assert flat[3]["encoder"] == "angle"


def test_graph_checks(spark):
    docs = documents(spark, json.dumps(GRAPH), json.dumps(KEYED))
    missing = [r[0] for r in docs.orderBy("doc_id").select(D.missing_types()).collect()]
    assert missing == [["optimizer"], ["dataset", "circuit", "optimizer"]]
    edges = docs.select("doc_id", F.inline(D.clean_edge_array()))
    assert [tuple(r) for r in edges.collect()] == [(0, 1, 2)]
    assert D.drop_node(edges, 2).isEmpty()
    flat = D.flatten_documents(docs).orderBy("doc_id").select(broken_rules()).collect()
    assert [r[0] for r in flat] == [[], ["no_path", "no_label", "no_features"]]


def test_clean_edges_of_a_hot_document(spark):
    nodes = spark.range(200).select(F.lit(1).alias("doc_id"), F.col("id"))
    edges = spark.range(3000).select(F.lit(1).alias("doc_id"), (F.col("id") % 200).alias("source"), (F.col("id") % 250).alias("target"))
    want = {(i % 200, i % 250) for i in range(3000) if i % 250 < 200}
    got = [(r["source"], r["target"]) for r in D.clean_edges(edges, nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_scoring_passes_extra_columns_and_needs_features(spark):
    model = VariationalModel(Affine(("a", "b"), (0.0, 0.0), (1.0, 1.0)), (0.3, 0.4))
    df = spark.createDataFrame([("k", 1, 2.0, "y"), ("n", None, 2.0, "y")], "id string, a int, b double, label string")
    rows = {r["id"]: r for r in model.score(df).collect()}
    assert rows["k"]["label"] == "y" and rows["k"]["risk_label"] in ("HIGH RISK", "low risk")
    assert rows["n"]["prediction"] is None and rows["n"]["risk_label"] is None
    with pytest.raises(ValueError, match="missing columns"):
        model.score(df.drop("b"))


def test_scoring_is_one_narrow_stage(spark):
    model = VariationalModel(Affine(("a", "b"), (0.0, 0.0), (1.0, 1.0)), (0.3, 0.4))
    plan = model.score(spark.range(5).selectExpr("id AS a", "id AS b"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_streaming_scores_equal_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    model = VariationalModel(Affine(("a", "b"), (0.0, 0.0), (1.0, 1.0)), (0.3, 0.4))
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    for part in range(2):
        text_file(source, "id,a,b\n" + "".join(f"{i},{i},{i * 0.1}\n" for i in range(part * 10, part * 10 + 10)), f"{part}.csv")
        score_arriving(spark, model, str(source), "id int, a double, b double", target, check).awaitTermination()
    batch = model.score(csv.read_csv(spark, str(source), "id int, a double, b double"))
    got = spark.read.parquet(target)
    assert got.count() == 20 and got.exceptAll(batch).isEmpty()


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_repeated_appends_leave_one_record(spark, tmp_path):
    path = str(tmp_path / "log")
    runs = lambda *rows: spark.createDataFrame(rows, "run_id string, accuracy double, note string")
    first = runs(("7", 0.5, "a/b"), ("run 8", 0.6, None))
    for _ in range(3):
        store.append_runs(first, path)
    store.append_runs(runs(("run-9", 0.7, "x"), ("7", 0.9, "again")), path)
    got = sorted(store.read_runs(spark, path).select("run_id", "accuracy", "note").collect())
    assert [tuple(r) for r in got] == [("7", 0.9, "again"), ("run 8", 0.6, None), ("run-9", 0.7, "x")]
    declared = store.read_runs(spark, path, "run_id string, accuracy double, missing string")
    assert declared.where("run_id = '7'").select("accuracy", "missing").first() == (0.9, None)
    with pytest.raises(Exception, match="no run_id"):
        store.append_runs(runs((None, 0.1, "y")), path)
    assert store.read_runs(spark, path).count() == 3


def test_views_of_a_catalog(spark, tmp_path):
    spark.createDataFrame([(1, 0.5), (0, 0.25)], "y int, a double").write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "t.csv").write_text("y,a\n1,2.5\n")
    catalog = K.Catalog()
    catalog.register(K.Dataset("declared", str(tmp_path / "t.parquet"), "y", ("a",), recommended={"maxiter": 20}, schema="y int, a double, b string"))
    catalog.register(K.Dataset("text", str(tmp_path / "t.csv"), "y", ("a",)))
    views = catalog.register_views(spark, "test_")
    assert spark.sql(f"SELECT sum(a), count(b) FROM {views['declared']}").first() == (0.75, 0)
    assert spark.sql(f"SELECT a FROM {views['text']}").first()[0] == 2.5
    listed = {r["name"]: r["recommended"] for r in catalog.listing(spark).collect()}
    assert listed == {"declared": {"maxiter": "20"}, "text": {}}


def test_edges_of_a_hub_are_dealt_out(spark):
    from phasegrid.operators.documents import EDGE_SALTS, clean_edges

    edges = spark.range(60_000).selectExpr("0 as doc_id", "1 as source", "id % 50000 as target").unionByName(
        spark.createDataFrame([(0, 1, None), (0, None, 1), (0, -5, 1), (1, 1, 2), (None, 1, 2)], "doc_id int, source int, target bigint")
    )
    nodes = spark.range(40_000).selectExpr("0 as doc_id", "id").unionByName(spark.createDataFrame([(0, None), (1, 1)], "doc_id int, id bigint"))
    kept = clean_edges(edges, nodes)
    assert kept.count() == 40_000 and kept.select("target").distinct().count() == 40_000
    salts = edges.where("source = 1 AND doc_id = 0 AND target IS NOT NULL").groupBy(F.pmod(F.xxhash64(F.col("target").cast("bigint")), F.lit(EDGE_SALTS))).count()
    sizes = sorted(r["count"] for r in salts.collect())
    assert len(sizes) == EDGE_SALTS and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_entry_without_the_training_data_folder(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "phasegrid.llm.queries", None)
    found = __spark_entry__.queries()
    assert found and not any(q.startswith("op") or q == "pipeline" for q in found)
    assert set(__spark_entry__.oracle_sql()) == set(found)


def test_stored_folders_go_when_the_application_ends(tmp_path):
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from phasegrid.session import stored
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
assert stored(spark.range(5), "x").count() == 5
import os; assert any(n.startswith("phasegrid-") for n in os.listdir({str(tmp_path)!r}))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    import time

    for _ in range(50):
        if not any(n.startswith("phasegrid-") for n in os.listdir(tmp_path)):
            return
        time.sleep(0.2)
    raise AssertionError(os.listdir(tmp_path))


def test_clean_edges_joins_the_nodes_once(spark):
    from phasegrid.operators.documents import clean_edges

    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 2), (0, 2, 9), (0, 3, 3), (1, 1, 2), (0, None, 1)], "doc_id int, source bigint, target bigint")
    nodes = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1)], "doc_id int, id bigint")
    kept = clean_edges(edges, nodes)
    assert sorted(tuple(r) for r in kept.collect()) == [(0, 1, 2), (0, 3, 3)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
