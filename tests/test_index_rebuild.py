"""Rebuilding a vector index: resume, one switch, faults, state."""

import pytest
from pyspark.sql import functions as F

from corpusq.plans.indexing import After
from corpusq.sources import index_rebuild as R

SCHEMA = "id string, tenant_id int, content string"


def _embed(mark):
    """Vectors that leave a line for each text in the file ``mark``."""

    def embed(tenant, texts):
        assert len(texts) <= R.CALL
        with open(mark, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t)), float(tenant)] for t in texts]

    return embed


def _rows(spark, n=200, skip=(), changed=()):
    rows = [(f"k{i}", i % 3, f"text {i}{' new' if i in changed else ''}") for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, SCHEMA)


def _index(spark, folder):
    return {r.id: (r.tenant_id, list(r.vector)) for r in R.read(spark, folder).collect()}


def _expected(df):
    return {r.id: (r.tenant_id, [float(len(r.content)), float(r.tenant_id)]) for r in df.collect()}


def test_a_cancelled_rebuild_goes_on_without_doing_a_batch_twice(spark, tmp_path):
    folder, mark = str(tmp_path / "index"), str(tmp_path / "calls")
    df, size = _rows(spark), {"n_batches": 10, "at_once": 3}
    with pytest.raises(ValueError):
        R.read(spark, folder)
    R.needs_rebuild(spark, folder, "why")
    first = R.rebuild(df, folder, _embed(mark), "m:2", **size, cancelled=After(3))
    assert first["cancelled"] and first["batches"] == 6 and first["reused"] == 0 and 0 < first["indexed"] < 200
    with pytest.raises(ValueError):
        R.read(spark, folder)  # nothing was switched
    assert R.state(spark, folder) == {"status": "needs_rebuild", "signature": "", "reason": "why"}
    done = open(mark).read().split("\n")[:-1]
    second = R.rebuild(df, folder, _embed(mark), "m:2", **size)
    assert second == {"batches": 4, "reused": 6, "cancelled": False, "indexed": 200, "errors": 0}
    calls = open(mark).read().split("\n")[:-1]
    assert sorted(calls) == sorted(f"text {i}" for i in range(200)) and calls[: len(done)] == done
    assert _index(spark, folder) == _expected(df)
    assert R.state(spark, folder) == {"status": "ready", "signature": "m:2", "reason": ""}


def test_rows_that_changed_or_went_meanwhile_are_done_again(spark, tmp_path):
    folder, mark = str(tmp_path / "index"), str(tmp_path / "calls")
    size = {"n_batches": 10, "at_once": 2}
    old = _rows(spark)
    R.rebuild(old, folder, _embed(mark), "m:2", **size, cancelled=After(4))
    new = _rows(spark, skip=(5, 6), changed=(7, 8))
    out = R.rebuild(new, folder, _embed(mark), "m:2", **size)
    assert out["indexed"] == 198 and 0 < out["reused"] < 6
    assert _index(spark, folder) == _expected(new)
    # another model starts anew, readers keep the old version until it is done
    other = R.rebuild(new, folder, lambda tenant, texts: [[0.0]] * len(texts), "n:1", **size, cancelled=After(2))
    assert other["cancelled"] and _index(spark, folder) == _expected(new)
    again = R.rebuild(new, folder, lambda tenant, texts: [[1.0]] * len(texts), "o:1", **size)
    assert again["reused"] == 0 and {v[1][0] for v in _index(spark, folder).values()} == {1.0}
    few = _rows(spark, 3)
    R.rebuild(few, folder, _embed(mark), "m:2", **size)
    assert _index(spark, folder) == _expected(few)
    none = R.rebuild(few.where("false"), folder, _embed(mark), "m:2", **size)
    assert none["indexed"] == 0 and _index(spark, folder) == {}


def test_faults_cost_their_own_call_only(spark, tmp_path):
    folder = str(tmp_path / "index")

    def fails(tenant, texts):
        if tenant == 1:
            raise RuntimeError("down")
        return [[1.0]] * (len(texts) - (tenant == 2))

    out = R.rebuild(_rows(spark, 30).coalesce(1), folder, fails, "m:1", n_batches=4)
    assert (out["indexed"], out["errors"]) == (10, 20)
    assert {t for t, _ in _index(spark, folder).values()} == {0}
    with pytest.raises(ValueError, match="no vector"):
        R.rebuild(_rows(spark, 30).where("tenant_id = 1"), folder, fails, "m:1", n_batches=4)
    assert R.state(spark, folder)["status"] == "needs_rebuild" and len(_index(spark, folder)) == 10
    odd = _rows(spark, 3).withColumns({"content": F.when(F.col("id") != "k1", F.col("content")), "batch": F.lit("mine"), "vector": F.lit("mine")})
    R.rebuild(odd, folder, lambda t, x: [[float(len(v))] for v in x], "m:1", n_batches=4)
    assert _index(spark, folder)["k1"] == (1, [0.0])


def test_states(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert not R.model_changed(spark, folder, "", True)
    assert not R.model_changed(spark, folder, "a:1", False) and R.state(spark, folder)["signature"] == "a:1"
    assert not R.model_changed(spark, folder, "a:1", True)
    assert R.model_changed(spark, folder, "b:1", True)
    assert R.state(spark, folder) == {"status": "needs_rebuild", "signature": "a:1", "reason": "embedding_model_changed"}
    assert R.model_changed(spark, folder, "a:1", True)
