import numpy as np
import pandas as pd

from salesloom.functions.solve import solve_normal
from salesloom.operators import regression


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_training_reads_its_rows_once(spark, tmp_path):
    rows = [(k % 3, f"b{k % 4}", f"m{k}", k * 7 % 50 + 1, float(k % 20 + 1), "纯电动" if k % 2 else "汽油") for k in range(90)]
    spark.createDataFrame(rows, "user_id long, brand string, model string, sales_volume long, sales_price double, energy_type string").write.parquet(
        f"{tmp_path}/source-rows")
    model = regression.train(spark.read.parquet(f"{tmp_path}/source-rows"), by=["user_id"])
    assert "source-rows" not in _plan(model) and model.count() == 3
    scored = regression.cross_validation(spark.read.parquet(f"{tmp_path}/source-rows"), by=["user_id"])
    assert "source-rows" not in _plan(scored) and scored.count() == 3


def test_systems_are_solved_together(monkeypatch):
    calls, plain = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda m, **k: calls.append(1) or plain(m, **k))
    good, none = np.array([2.0, 0, 0, 0, 4, 0, 0, 0, 0]), np.full(9, np.nan)
    got = solve_normal.func(pd.Series([good, none, None, good]), pd.Series([np.array([2.0, 4, 0]), np.ones(3), np.ones(3), np.array([4.0, 4, 0])]))
    assert [None if g is None else list(g) for g in got] == [[1, 1, 0], None, None, [2, 1, 0]] and len(calls) == 1
