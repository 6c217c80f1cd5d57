"""Plan-shape checks: one-row results are combined without cartesian joins,
the mode table becomes an expression, and the package reaches the executors'
Python workers whatever the driver's working directory."""
import os
import subprocess
import sys

from pyspark.sql import functions as F

from ledgerscope.operators import decide as D
from ledgerscope.operators import metrics as M
from ledgerscope.operators.combine import side_by_side

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_side_by_side_keeps_values_and_avoids_nested_loops(spark):
    big = spark.range(0, 5000)
    a = big.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    b = big.where(F.col("id") % 7 == 0).agg(F.max("id").alias("mx"))
    c = spark.range(0, 0).agg(F.max("id").alias("empty_max"))        # a null-valued row
    out = side_by_side(a, b, c)
    row = out.first()
    assert out.columns == ["n", "s", "mx", "empty_max"]
    assert (row.n, row.s, row.mx, row.empty_max) == (5000, sum(range(5000)), 4998, None)
    plan = _plan(out)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_evaluate_without_keys_has_no_nested_loop_join(spark):
    rows = [(i % 3 == 0 and 1 or 0, (i % 17) / 17.0) for i in range(300)]
    df = spark.createDataFrame(rows, "isFraud int, score double")
    ev = M.evaluate(df, 0.5)
    r = ev.first()
    tp = sum(1 for y, s in rows if y == 1 and s >= 0.5)
    fp = sum(1 for y, s in rows if y == 0 and s >= 0.5)
    assert (r.tp, r.fp) == (tp, fp)
    assert "NestedLoopJoin" not in _plan(ev)


def test_mode_threshold_is_an_expression_not_a_join(spark):
    req = spark.createDataFrame([(1, "balanced"), (2, None), (3, "High_Precision"), (4, "nope")],
                                "id int, mode string")
    out = D.with_mode(req, D.modes_table(spark))
    got = {r.id: (r.mode, r.threshold_used) for r in out.collect()}
    assert got == {1: ("BALANCED", 0.43), 2: ("BALANCED", 0.43), 3: ("HIGH_PRECISION", 0.17), 4: ("NOPE", None)}
    assert "Join" not in _plan(out)


def test_udf_queries_run_from_another_working_directory(tmp_path):
    """Pandas UDFs (isolation forest) pickle functions by module reference; the
    session ships the package, so a driver started elsewhere still works."""
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from ledgerscope.session import local_session\n"
        "spark = local_session(cores=2, shuffle_partitions=2)\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.queries()['iforest_scores'](spark, '/root/testdata/sf0.001').count())\n"
    ) % REPO
    env = dict(os.environ, PYTHONPATH="", TMPDIR=str(tmp_path))
    res = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    assert "ROWS " in res.stdout


def test_no_nested_loop_or_cartesian_join_in_oracle_checked_queries(spark, sf_dir):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name in sqls:
        plan = _plan(qs[name](spark, sf_dir))
        if "NestedLoopJoin" in plan or "CartesianProduct" in plan or "BatchEvalPython" in plan:
            bad.append(name)
    assert bad == []
