"""What Spark measured in the queries of a block: figures of their plans' nodes, those of written steps included."""

from __future__ import annotations

from contextlib import contextmanager


@contextmanager
def measured(spark):
    """Gives a function that lists a metric of all nodes of all queries that ran in the block."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before, found = store.executionsCount(), []
    yield lambda name: [value for n, value in found if n == name]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            metrics = nodes.apply(k).metrics()
            for m in range(metrics.size()):
                metric = metrics.apply(m)
                text = values.get(metric.accumulatorId())
                if text.isDefined() and text.get().replace(",", "").isdigit():
                    found.append((metric.name(), int(text.get().replace(",", ""))))
