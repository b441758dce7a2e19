from __future__ import annotations

import pytest

from tidewater.llm.common import new_path
from tidewater.llm.sharding import Store, plan_runs, shard, tier


def sized(*sizes):
    return [{"id": str(k), "path": str(k), "bytes": n} for k, n in enumerate(sizes)]


def test_round_trip(documents, odd):
    for rows in (documents, odd):
        out = shard(rows, target=200_000, arrival_rows=20)
        assert out.columns == [*[c for c in rows.columns if c != "shard_id"], "shard_id", "shard_bytes"]
        assert "_file" not in rows.columns or out.filter("_file = 'clash' and _run = 'clash'").count() == rows.count()
        own = rows.drop("shard_id")
        assert own.exceptAll(out.select(own.columns)).count() == out.select(own.columns).exceptAll(own).count() == 0
    assert shard(odd.limit(0)).count() == 0


def test_runs_are_similar_and_of_the_target_size():
    runs = plan_runs(sized(10, 11, 9, 10, 300, 12, 900), target=1000, fan_in=4, factor=4)
    assert [[x["bytes"] for x in r] for r in runs] == [[10, 11, 9, 10, 12]]
    assert plan_runs(sized(10, 10, 10), 1000, 4, 4) == []
    for run in plan_runs(sized(*[100] * 35), 1000, 4, 4):
        assert sum(x["bytes"] for x in run) <= 1000
    final = plan_runs(sized(10, 100, 300), 1000, 4, 4, final=True)
    assert [len(r) for r in final] == [3]
    assert tier(501, 1000, 4) == 0 and tier(500, 1000, 4) == 1 and tier(1, 1000, 4) > tier(100, 1000, 4)


def test_versions(spark):
    store = Store(spark, new_path(spark, "shards-test"))
    for k in range(5):
        store.append(spark.range(k * 10, k * 10 + 10))
    assert (store.version(), len(store.shards()) >= 5, store.read().count()) == (5, True, 50)
    before = store.shards()
    assert store.compact() == 6 and len(store.shards()) < len(before)
    assert sorted(r.id for r in store.read().collect()) == list(range(50))
    assert store.read(3).count() == 30  # an old version is still whole
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(4, [])
    assert store.vacuum() == len(before) and store.read().count() == 50
    assert store.compact() == 6  # nothing to do


def test_tiers_of_several_arrivals(spark, documents):
    """Small arrivals are merged once a tier has enough of them, larger shards wait for their like; rows stay whole at each step."""
    store, n, sizes = Store(spark, new_path(spark, "shards-tiers")), 0, []
    for k in range(9):
        store.append(documents.coalesce(1))
        n += documents.count()
        store.compact(target=10_000_000, fan_in=4, factor=4)
        assert store.read().count() == n
        sizes.append(len(store.shards()))
    assert sizes[:4] == [1, 2, 3, 1] and max(sizes) < 9
    out = shard(documents, target=10_000_000, arrivals=3)
    assert out.drop("shard_id", "shard_bytes").exceptAll(documents).count() == 0 and out.count() == documents.count()


def test_writers_at_the_same_time(spark, monkeypatch):
    """An append that loses the race is tried again; a merge whose shards went meanwhile fails and leaves nothing."""
    store, other = (Store(spark, new_path(spark, "shards-race")) for _ in range(2))
    other.path, other.manifests = store.path, store.manifests
    store.append(spark.range(5))
    commit, raced = Store.commit, []

    def late(self, base, shards, schema=None):
        if self is store and not raced:
            raced.append(other.append(spark.range(5, 9)))
        return commit(self, base, shards, schema)

    monkeypatch.setattr(Store, "commit", late)
    assert store.append(spark.range(9, 12)) == 3 and sorted(r.id for r in store.read().collect()) == list(range(12))
    folder = f"{store.path}/merged-x"
    spark.range(3).write.parquet(folder)
    with pytest.raises(RuntimeError, match="same shards"):
        store.exchange({"gone"}, folder)
    spark.range(3).write.parquet(f"{store.path}/arrived-left")
    assert store.vacuum(left_over=0) > 0 and store.read().count() == 12


def test_planning_is_linear():
    runs = plan_runs(sized(*[10] * 200_000), target=1000, fan_in=4, factor=4)
    assert len(runs) == 2000
