"""Sizes of the registered models, scratch space."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from pluvia.llm import collinear_dedup as cd
from pluvia.operators import models as mo
from pluvia.operators import selection as se
from pluvia.plans import queries_models as qm
from pluvia.session import SHUFFLE_CLEANUP, materialise


def test_linear_set_fits_the_whole_gain_model(spark, monkeypatch):
    sizes = []
    table = spark.createDataFrame([("a", 1.0, 1.0, 1)], "feature string, gain double, gain_frac double, gain_rank int")
    vif = spark.createDataFrame([], "feature string, vif double, severity string")
    monkeypatch.setattr(qm, "candidate_rows", lambda *_: (None, ["a"]))
    monkeypatch.setattr(se, "correlation_filter", lambda *_: [])
    monkeypatch.setattr(qm, "as_table", lambda spark, names: spark.createDataFrame([(n,) for n in names], "feature string"))
    monkeypatch.setattr(qm.co, "variance_inflation", lambda *_: vif)
    plain = se.gain_importance.__defaults__[1:]
    monkeypatch.setattr(se, "gain_importance", lambda rows, names, trees=plain[0], depth=plain[1], rate=plain[2]: sizes.append((trees, depth, rate)) or table)
    assert [r.feature for r in qm.selected_linear(spark, "").collect()] == ["a"]
    assert sizes == [plain] == [(300, 4, 0.05)]


def test_grid_search_tries_the_whole_grid(spark, monkeypatch):
    grids = []
    monkeypatch.setattr(qm, "inputs", lambda *_: None)
    monkeypatch.setattr(mo, "tune_two_stage", lambda rows, names, grid=mo.GRID: grids.append(grid) or (None, [("classifier", 400, 4, 0.05, 3, 1, 0.5)]))
    assert qm.k4(spark, "").count() == 1
    assert grids == [mo.GRID] and mo.GRID["trees"] == (400, 600)


def shuffle_files(spark):
    return {str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "shuffle_" in f}


def test_written_tables_leave_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    held = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    written = materialise(held, "counts")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP) == was
    assert written.count() == held.count() == 7
    assert sorted(materialise(held, "counts").collect()) == sorted(held.collect())


def test_passages_delete_their_scratch_tables(spark, monkeypatch):
    made = {}
    plain = cd.materialise
    monkeypatch.setattr(cd, "materialise", lambda df, name: made.setdefault(name, []).append(t := plain(df, name)) or t)
    words = [f"w{i}" for i in range(130)]
    half = words[:22] + [f"x{i}" for i in range(60)]
    texts = [(1, " ".join(half)), (2, " ".join([f"y{i}" for i in range(60)] + words[22:44])), (3, " ".join(words)), (4, " ".join(words))]
    found = cd.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {4}
    assert {"open-hits", "spans", "chains"} <= set(made)
    for name in ("open-hits", "seed-ranks", "open-pairs", "spans", "chains"):
        for table in made.get(name, ()):
            assert not any(Path(f.removeprefix("file:")).exists() for f in table.inputFiles()), name
