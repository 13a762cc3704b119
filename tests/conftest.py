import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def files_read(df) -> int:
    """Runs a plan and tells how many files its scans read."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    seen, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        metrics = p.metrics()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            seen += metrics.apply("numFiles").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return seen
