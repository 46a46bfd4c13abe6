"""Vectors from a provider and a cache."""

import os

import pytest

from concordat.operators import embedder


def own():
    """A provider of this file's own, which workers get by value."""

    def logged(settings):
        """A provider that writes down its set-ups and calls, and fails as told."""
        folder = settings["folder"]
        with open(f"{folder}/setups", "a") as f:
            f.write(f"{os.getpid()}\n")

        def one(texts):
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{len(texts)}\n")
            if any("broken" in t for t in texts) and not os.path.exists(f"{folder}/mended"):
                raise RuntimeError("refused")
            return [[float(len(t))] for t in texts]

        return one

    return logged


def lines(path):
    return open(path).read().split() if os.path.exists(path) else []


def test_cache(spark, tmp_path, monkeypatch):
    embedder.register("logged", own())
    settings = {"folder": str(tmp_path)}
    texts = [f" text {i} " for i in range(95)] + ["text 3", "", "  ", None, "text 94"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    cache = f"file://{tmp_path}/cache"
    got = {r["h"]: r["v"] for r in embedder.embedded(rows, cache, "logged", settings).collect()}
    assert len(got) == 95 and sorted(x for v in got.values() for x in v) == sorted(float(len(f"text {i}")) for i in range(95))
    calls = lines(f"{tmp_path}/calls")
    assert sum(map(int, calls)) == 95 and max(map(int, calls)) == 10
    setups = lines(f"{tmp_path}/setups")
    assert len(setups) == len(set(setups))  # once a worker
    assert embedder.embedded(rows, cache, "logged", settings).count() == 95 and lines(f"{tmp_path}/calls") == calls
    more = rows.union(spark.createDataFrame([("new",)], "text string"))
    assert embedder.embedded(more, cache, "logged", settings).count() == 96 and lines(f"{tmp_path}/calls")[len(calls) :] == ["1"]
    assert embedder.embedded(rows.limit(0), cache, "logged", settings).count() == 0
    assert spark.read.parquet(cache).groupBy("h").count().where("count > 1").isEmpty()


def test_failed_calls_are_asked_again(spark, tmp_path):
    embedder.register("logged", own())
    settings = {"folder": str(tmp_path)}
    rows = spark.createDataFrame([("broken",)], "text string")
    cache = f"file://{tmp_path}/cache"
    assert embedder.embedded(rows, cache, "logged", settings).count() == 0 and len(lines(f"{tmp_path}/calls")) == embedder.TRIES
    open(f"{tmp_path}/mended", "w").close()
    assert embedder.embedded(rows, cache, "logged", settings).count() == 1


def test_unknown_provider(spark, tmp_path):
    with pytest.raises(KeyError):
        embedder.embedded(spark.createDataFrame([("x",)], "text string"), f"file://{tmp_path}/cache", "nobody")
