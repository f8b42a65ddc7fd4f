"""What the driver holds while operators write their tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillon.llm import common


@pytest.mark.parametrize("master, used, collected", [("local[4]", 700, False), ("local-cluster[3,2,3000]", 700, True), ("spark://host:7077", 700, True), ("spark://host:7077", 200, False)])
def test_a_full_driver_is_collected_between_steps(master, used, collected):
    calls = []
    runtime = SimpleNamespace(totalMemory=lambda: used, maxMemory=lambda: 750, gc=lambda: calls.append(1))
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))))
    session = SimpleNamespace(sparkContext=SimpleNamespace(master=master), _jvm=jvm)
    assert common.give_back(session) == collected == bool(calls)


def test_each_written_table_asks_for_it(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(common, "give_back", asked.append)
    assert common.written(spark.range(3), "few").count() == 3
    assert asked == [spark]


def test_plans_as_text_are_bounded_while_tables_are_written(spark):
    table = spark.range(3).withColumn("x", F.get(F.from_json(F.lit(str(list(range(50_000)))), "array<int>"), F.col("id").cast("int")))
    was = spark.conf.get(common.PLAN)
    seen = []
    with common.clean_shuffles(spark):
        seen.append(len(table._jdf.queryExecution().toString()))
    assert seen[0] < 3 * int(common.PLAN_CHARS)
    assert spark.conf.get(common.PLAN) == was
    assert len(table._jdf.queryExecution().toString()) > 250_000


def test_a_collected_heap_is_shrunk_and_freed_memory_goes_back(monkeypatch):
    calls, held = [], {"value": "70"}

    def managed(_, bean, operation, *texts):
        calls.append((operation, *texts))
        return held if operation == "getVMOption" else None

    monkeypatch.setattr(common, "_managed", managed)
    runtime = SimpleNamespace(totalMemory=lambda: 700, maxMemory=lambda: 750, gc=lambda: calls.append("gc"))
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))))
    common.give_back(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), _jvm=jvm))
    option = common.FREE[0]
    assert calls == [("getVMOption", option), ("setVMOption", *common.FREE), "gc", ("setVMOption", option, "70"), ("systemTrimNativeHeap",)]


def test_the_heap_option_holds_during_the_collection_only(spark):
    option = lambda: common._managed(spark, "HotSpotDiagnostic", "getVMOption", common.FREE[0]).get("value")
    was, seen = option(), []
    common._shrunk(spark, lambda: seen.append(option()))
    assert (seen, option()) == ([common.FREE[1]], was)
    assert common._managed(spark, "NoSuchBean", "nothing") is None
