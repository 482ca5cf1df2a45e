"""Wide columns stay out of shuffles that don't need them."""

from tidemark.llm import near_dedup, outliers
from tidemark.llm.common import read_table


def test_texts_are_not_shuffled_for_group_sizes(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # The table of statistics, with its texts, is larger; the sizes of the groups aren't.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        plan = outliers.judge(docs)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_bitmaps_stay_out_of_the_buckets(spark, monkeypatch):
    seen = []
    whole = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda members, *rest: seen.append(members) or whole(members, *rest))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, "something else altogether, and not alike")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(seen[0].columns) == ["crowd", "key", "n", "node"]
