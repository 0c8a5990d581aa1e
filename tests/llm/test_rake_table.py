"""Raking in the driver and as Spark jobs: one rule for the end, one result."""

import inspect

import numpy as np
import pandas as pd

from auditlake.llm import mixing


def test_both_paths_end_alike(spark):
    ends = [{k: inspect.signature(f).parameters[k].default for k in ("sweeps", "tolerance")} for f in (mixing.rake, mixing.rake_table)]
    assert ends[0] == ends[1]
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(f"s{i}", f"l{j}", f"t{k}", int(rng.pareto(1.0) * 100) + 1) for i in range(4) for j in range(3) for k in range(2)], columns=[*mixing.DIMS, "tokens"])
    by = list(mixing.DIMS)
    want = mixing.rake(cells, budget=0.1, tolerance=0.2).set_index(by)["probability"]
    got = mixing.rake_table(spark.createDataFrame(cells).coalesce(1), budget=0.1, tolerance=0.2).toPandas().set_index(by)["probability"]
    twelve = mixing.rake(cells, budget=0.1, sweeps=12).set_index(by)["probability"]
    assert len(got) == len(want) and np.abs(got[want.index] - want).max() < 1e-9 and np.abs(twelve - want).max() > 1e-4
