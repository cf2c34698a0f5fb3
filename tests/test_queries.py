import pytest

from lumasieve.plans.queries import ORACLE, QUERIES

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, data, con, name):
    compare(QUERIES[name](spark, data), ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def rows_through_driver(spark, df):
    """Rows that the jobs of a result, and of the tables it was made from, send through the driver to be joined; ``df`` is called for the result."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    bus.waitUntilEmpty(60_000)
    before = {e.executionId() for e in each(store.executionsList())}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        df().write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    bus.waitUntilEmpty(60_000)
    sent = 0
    for at in {e.executionId() for e in each(store.executionsList())} - before:
        values = store.executionMetrics(at)
        for node in each(store.planGraph(at).allNodes()):
            if node.name().startswith("BroadcastExchange"):
                counts = [values.get(m.accumulatorId()) for m in each(node.metrics()) if m.name() == "number of output rows"]
                sent += sum(int(n.get().replace(",", "")) for n in counts if n.isDefined())
    return sent


@pytest.mark.parametrize("name", ["similar_groups", "groups_after_regroup", "similar_clusters"])
def test_small_driver(spark, data, name):
    """No side of a join goes through the driver because its file, or the table it is exploded from, is small."""
    small, large = spark.range(3), spark.range(100)
    assert rows_through_driver(spark, lambda: large.join(small.hint("broadcast"), "id")) == 3
    assert rows_through_driver(spark, lambda: QUERIES[name](spark, data)) == 0
