"""Readers and writers, and the entry module without the optional part."""

import importlib
import json
import os
import shutil
import subprocess
import sys

import pytest
from conftest import REPO, SF
from pyspark.sql import functions as F

from concordat.sources import files, office


def test_items(spark, tmp_path):
    p = tmp_path / "items.csv"
    p.write_bytes("﻿id,text,label\n7,\"a, \"\"b\"\"\",x\n,  ,y\n,c\n".encode())
    rows = sorted(tuple(r) for r in files.read_items(spark, str(p), label="label").collect())
    assert rows == [(1, "7", 'a, "b"', "x"), (3, "3", "c", None)]
    try:
        files.read_items(spark, str(p), text="body")
        raise AssertionError
    except ValueError as e:
        assert "body" in str(e)


def test_workbook_items(spark, tmp_path):
    p = tmp_path / "items.xlsx"
    p.write_bytes(office.workbook({"s": [["id", "text", "label"], ["7", "a", "x"], [None, "  ", "y"], [None, "c"]], "other": [["no"]]}))
    assert sorted(tuple(r) for r in files.read_items(spark, str(p), label="label").collect()) == [(1, "7", "a", "x"), (3, "3", "c", None)]


def test_gbk(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("id,text\n1,中文\n".encode("gbk"))
    assert files.encoding_of(spark, str(tmp_path / "g.csv")) == "GBK"
    (tmp_path / "u.csv").write_text("id,text\n1,中文\n", encoding="utf-8")
    assert files.encoding_of(spark, str(tmp_path / "u.csv")) == "UTF-8"


def test_json_lines(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text('{"id": 1, "text": "a"}\n\n{"text": "b"}\n', encoding="utf-8")
    assert sorted((r["id"], r["text"]) for r in files.read_items(spark, str(p)).collect()) == [("1", "a"), ("2", "b")]


def test_results(spark, tmp_path):
    good = {"id": "1", "text": "t", "label": "x", "status": "consensus", "round1": [{"model": "m", "label": "x", "confidence": 0.5}]}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps(good | {"label": "old"}) + "\n" + json.dumps(good) + "\n" + '{"id": "2", "te', encoding="utf-8")
    r = files.read_results(spark, str(tmp_path / "r"))
    assert [(x["id"], x["label"]) for x in r.collect()] == [("1", "x")]
    files.write_results(r, str(tmp_path / "out"))
    assert files.read_results(spark, str(tmp_path / "out")).first()["round1"][0]["model"] == "m"


def test_cache(spark, tmp_path):
    p = tmp_path / "cache.json"
    p.write_text('{"key": "k", "response": "a"}\nbroken\n{"key": "k", "response": "b", "prob": 0.5}\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_cache(spark, str(p)).select("key", "response", "prob").collect()] == [("k", "b", 0.5)]


def test_wide(spark, tmp_path):
    a = spark.createDataFrame([(1, "m0", "x", 0.123, None), (1, "m1", None, 0.5, "timeout")], "item_id long, model string, label string, confidence double, error string")
    files.write_wide(a, ["m0", "m1"], str(tmp_path / "w"))
    r = spark.read.csv(str(tmp_path / "w"), header=True).first().asDict()
    assert r["m0_r1"] == "x" and r["m1_r1"] == "error: timeout" and r["m0_conf"] == "0.12"


def test_entry(spark):
    sys.path.insert(0, REPO)
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_without_llm(tmp_path):
    """The rest imports without the optional subpackage and the pipeline over it."""
    for x in ("concordat", "__spark_entry__.py"):
        src = os.path.join(REPO, x)
        shutil.copytree(src, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_votes_scan_is_narrow(spark):
    """Column pruning reaches the scan."""
    from concordat.plans.catalogue import QUERIES

    plan = QUERIES["vote_majority"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_tax" not in schema and "l_discount" not in schema
    assert F is not None


def test_runs(spark, tmp_path):
    from concordat.sources import runs

    root = f"file://{tmp_path}/runs"
    one = spark.createDataFrame([(1, "A")], "item_id long, label string")
    runs.write_run(one, root, "first")
    runs.write_run(one, root, "second", "eval")
    assert [(r["run"], r["kind"]) for r in runs.list_runs(spark, root).collect()][:2] == [("second", "eval"), ("first", "results")]
    assert runs.delete_run(spark, root, "first") and not runs.delete_run(spark, root, "first")
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            runs.delete_run(spark, root, bad)
    assert runs.without_secrets({"jury": [{"api_key": "x", "name": "a"}], "arbiter": {"api_key": "y"}, "n": 1}) == {"jury": [{"name": "a"}], "arbiter": {}, "n": 1}
