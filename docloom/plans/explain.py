"""Plans of requests: as text without running them, or with figures of a run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def simple(df: DataFrame) -> str:
    """The optimised logical plan."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def debug(df: DataFrame) -> str:
    """All plans, formatted."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def execute(df: DataFrame) -> dict:
    """Runs the request where its data are; rows of the result, seconds, and the figures of each node of the plan that ran."""
    began = time.time()
    jdf = df._jdf.queryExecution()
    rows = jdf.toRdd().count()  # the rows themselves stay on the executors
    figures: list[dict] = []

    def walk(node) -> None:
        metrics = node.metrics()
        keys = metrics.keysIterator()
        own = {}
        while keys.hasNext():
            k = keys.next()
            own[k] = metrics.apply(k).value()
        figures.append({"node": node.nodeName(), "metrics": own})
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(jdf.executedPlan())
    return {"sizeOfResult": int(rows), "seconds": time.time() - began, "nodes": figures}
