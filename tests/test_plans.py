"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from checks import testmap as tm
from checks.entries import MAIN_QUERY
from fleetmetrics.operators import batching, changes, queue, readings as R, registry as G
from fleetmetrics.operators import rollups as A
from fleetmetrics.operators.rollups import cluster_stats, reconcile_counts
from fleetmetrics.plans.query import readings_by_gpu, select_readings
from fleetmetrics.session import CHECKPOINT_CONF, shared_dir
from fleetmetrics.sources.store import write_readings

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_main_query_is_one_top_k_without_shuffle(spark):
    text = plan(readings_by_gpu(tm.wide(spark, SF), MAIN_QUERY, "2024-01-31"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in pushed
    assert "LessThan(ts,2024-01-20T00:00:01)" in pushed


def test_columns_are_pruned(spark):
    text = plan(select_readings(tm.readings(spark, SF), MAIN_QUERY, "2024-01-31").select("seq"))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "value" not in schema and "props" not in schema


@pytest.mark.parametrize("make", [
    lambda s: R.latest_readings(tm.readings(s, SF)),
    lambda s: R.upsert_readings(tm.doubled(s, SF)),
    lambda s: reconcile_counts(tm.readings(s, SF), tm.readings(s, SF), ["hostname"]),
    lambda s: queue.queue_depth(tm.messages(s, SF)),
])
def test_groups_are_reduced_before_their_only_shuffle(spark, make):
    text = plan(make(spark))
    assert text.count("Exchange") == 1 and "partial_" in text


def test_gpu_registration_hashes_the_readings(spark):
    text = plan(G.register_gpus(tm.readings(spark, SF)))
    lowest = text.rstrip().split("Exchange")[-1]
    assert "HashAggregate" in lowest and "SortAggregate" not in lowest


def test_no_cross_joins_and_no_windows_without_keys(spark):
    wide = tm.wide(spark, SF)
    hosts, gpus = G.register_hosts(wide), G.gpu_status(G.register_gpus(wide), wide)
    for df in (
        cluster_stats(wide, hosts, gpus),
        batching.pack_batches(tm.readings(spark, SF), "hostname", 10),
        changes.classify_changes(tm.changelog(spark, SF), ["key"]),
        queue.consume_many(tm.messages(spark, SF), ["click"], 5, tm.AS_OF),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "SinglePartition" not in text


def test_rows_of_a_hot_partition_are_sorted_per_run(spark):
    text = plan(batching.running_position(tm.readings(spark, SF), ["hostname"], "seq", into="p", range_rows=100))
    ranked = [line for line in text.splitlines() if "row_number()" in line and "Window" in line]
    assert ranked and all("_range" in line for line in ranked)


def test_top_n_is_cut_down_before_the_shuffle(spark):
    text = plan(queue.consume_many(tm.messages(spark, SF), ["click"], 5, tm.AS_OF))
    assert "WindowGroupLimit" in text.split("Exchange")[-1]


def test_write_is_rebalanced(spark, tmp_path):
    df = tm.readings(spark, SF).withColumn("event_date", F.to_date("ts"))
    hinted = df.hint("rebalance", "cluster_id", "event_date").sortWithinPartitions("cluster_id")
    assert "REBALANCE_PARTITIONS" in plan(hinted)
    write_readings(tm.readings(spark, SF), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("cluster_id=*"))) > 0


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get(CHECKPOINT_CONF)
    one, two = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one.startswith(base) and one != two


def test_newest_by_hashing_without_a_sort(spark):
    df = spark.createDataFrame(
        [(5, "c", "h", "0", 1.0), (None, "c", "h", "0", 2.0), (-(2**63), "c", "h", "0", 3.0)],
        "seq long, cluster_id string, hostname string, gpu_id string, temperature double",
    ).selectExpr("*", "cast(null as timestamp) as ts")
    newest = R.latest_readings(df, columns=("temperature",))
    assert [r.temperature for r in newest.collect()] == [1.0]
    assert [r.temperature for r in R.latest_readings(df.where("seq is null or seq < 0"), columns=("temperature",)).collect()] == [3.0]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_registry_from_one_pass(spark):
    wide = tm.wide(spark, SF)
    seen = G.condense(wide)
    assert seen.count() <= 2 * wide.select("cluster_id", "hostname", "gpu_id").distinct().count()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(G.register_hosts(seen), G.register_hosts(wide))
    assert same(G.register_gpus(seen), G.register_gpus(wide))
    gpus = G.register_gpus(wide)
    assert same(G.gpu_status(gpus, seen), G.gpu_status(gpus, wide))
    hosts, status = G.register_hosts(seen), G.gpu_status(G.register_gpus(seen), seen)
    plan = cluster_stats(wide, hosts, status)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events.parquet") + plan.count("event_id#") >= 1
    tree = G.fleet_tree(hosts, status, A.cluster_metadata(hosts, status))
    assert "event_type" not in tree._jdf.queryExecution().optimizedPlan().toString()


def test_resolved_ids_reach_the_reader(spark, tmp_path, monkeypatch):
    from fleetmetrics.operators import readings as R

    df = tm.readings(spark, SF)
    path = str(tmp_path / "readings")
    df.write.parquet(path)
    stored, seen = spark.read.parquet(path), G.condense(tm.wide(spark, SF), measured=())
    found = R.match_known_gpu(stored, seen, "U-0000001")
    text = plan(found)
    pushed = text.split("PushedFilters: [")[1]
    assert "In(uuid, [" in pushed.split("ReadSchema")[0] and "Contains" not in text
    want = R.match_gpu(df, "U-0000001")
    assert found.exceptAll(want).count() == 0 and found.count() == want.count() > 0
    monkeypatch.setattr(R, "RESOLVED_IDS", 2)
    assert R.match_known_gpu(stored, seen, "U-0000001").count() == want.count()
    assert R.match_known_gpu(stored, seen, "nothing").count() == 0


def test_a_deep_page_reads_its_range_only(spark):
    from fleetmetrics.operators.paging import index_pages
    from fleetmetrics.operators.readings import newest_first

    df = tm.readings(spark, SF)
    index = index_pages(df, range_rows=90)
    assert len(index.counts) > 8 and index.total == df.count()
    want = [r.seq for r in newest_first(df).collect()]
    for limit, offset in ((50, 0), (30, 500), (200, 333), (50, index.total - 10), (5, index.total + 5)):
        page = index.page(limit, offset)
        assert [r.seq for r in page.rows.collect()] == want[offset:offset + limit]
        assert tuple(page.summary.first()) == (len(want), len(want) > limit + offset)
    text = plan(index.page(30, 500).rows)
    assert "_range" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert index_pages(df.limit(0)).page(5).rows.count() == 0
