"""What large tables need: lands and files are many times what their parts are, however small Spark guesses them to be."""

import pytest

import __spark_entry__ as entry
from evidentia.operators import entity

SF = "/root/testdata/sf0.001"
NEVER_BROADCAST = [
    "entry_merge",
    "export_bundles",
    "footprint_files",
    "footprint_text",
    "pad_overlap",
    "paste_and_hole_rules",
    "silk_segments",
    "symbol_text",
]


@pytest.mark.parametrize("name", NEVER_BROADCAST)
def test_lands_are_never_broadcast(spark, name):
    plan = entry.catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_records_work_each_value_out_once(spark):
    """Each coordinate is converted in a column of its own; written out, the conversion stood in the record hundreds of times."""
    plan = entry.catalog.QUERIES["altium_pad_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 4 <= plan.count("0.0254") <= 16


def test_merged_entries_list_no_pairs(spark):
    """1,000 entries a pass of one family: their million pairs, listed before, only say that none has a single partner."""
    sides = [spark.range(k, k + 1000).selectExpr("1 as doc", "id as entry", "case when id % 1000 < 2 then 'O' || id % 1000 end as outline", "if(id % 1000 < 2, 'G' || id % 1000, 'F') as family", "2 as leads", "1.5 as pitch") for k in (0, 5000)]
    got = entity.merge_entries(*sides, "doc", ["outline", "family"], ["outline", "leads"], ["outline", "pitch"])
    assert sorted((r.entry, r.merged) for r in got.collect() if r.merged is not None) == [(0, 5000), (1, 5001)] and got.count() == 1998
    pairs = entity.partners(*sides, "doc", ["outline", "family"], ["outline", "leads"])
    assert pairs.count() == 2 and most_rows(pairs._jdf.queryExecution()) < 20_000


def test_exact_counts_multiply_no_rows(spark, tmp_path):
    """No Expand, no exchange of single keys; estimates that are far off are told, nulls and negative keys counted as SQL does."""
    lines = "select if(id % 3 = 0, null, 'A') as l_returnflag, if(id % 5 = 0, null, id % 700 - 300) as l_partkey, id - 50 as l_orderkey from range(5000)"
    spark.sql(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.catalog.QUERIES["approx_distinct"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", True, True), (None, True, True)], key=str)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def most_rows(execution) -> int:
    """The most rows that a join of a plan that ran has made."""
    execution.toRdd().count()
    plan, most = execution.executedPlan(), 0

    def walk(node):
        nonlocal most
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        below = [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
        for x in below:
            walk(x)

    walk(plan)
    assert most
    return most
