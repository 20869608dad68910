import uuid

import pytest

from sparsolve.llm.common import shared_dir
from sparsolve.llm.sharding import CommitConflict, Shard, ShardStore


def store(spark, **options):
    return ShardStore(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", **options)


def test_append_compact_read(spark):
    s = store(spark, target_bytes=60_000, arrival_rows=100)
    docs = spark.range(2000).selectExpr("id doc_id", "repeat(sha2(cast(id as string), 256), 2) text", "if(id % 3 = 0, null, id) source", "id row")
    assert s.append(docs) == 1 and s.append(docs.where("doc_id < 300")) == 2
    before, _ = s.manifest()
    assert len(before) >= 23 and sum(x.rows for x in before) == 2300
    assert s.compact() == 3
    after, _ = s.manifest()
    assert sum(x.rows for x in after) == 2300 and 1 < len(after) < len(before)
    assert max(x.bytes for x in after) <= 1.3 * 60_000
    assert s.groups(after) == []
    assert s.read(1).count() == 2000 and s.read().count() == 2300
    assert sorted(r["doc_id"] for r in s.read().collect()) == sorted([*range(2000), *range(300)])
    assert s.read().select("_shard", "_row").distinct().count() == 2300
    s.vacuum()
    assert s.read().count() == 2300 and s.compact() == 3


def test_commit_is_atomic(spark):
    s = store(spark)
    s.append(spark.range(5).selectExpr("id doc_id", "'x' text"))
    shards, schema = s.manifest()
    with pytest.raises(CommitConflict):
        s.commit(1, shards, schema)
    with pytest.raises(ValueError):
        s.append(spark.range(5))
    assert s.version() == 1


def test_two_writers(spark):
    """Whoever commits second takes the first one's version up; a vacuum in between leaves the other's files alone."""
    s, rows = store(spark, arrival_rows=10), spark.range(50).selectExpr("id doc_id", "'x' text")
    other = ShardStore(spark, s.root, arrival_rows=10)
    commit, again = s.commit, []

    def late(version, shards, schema):
        if not again:  # the other one is quicker
            again.append(other.append(rows.where("doc_id < 20")))
            other.compact()
            other.vacuum()
        return commit(version, shards, schema)

    s.commit = late
    s.append(rows)
    assert again == [1] and s.read().count() == 70 == other.read().count()
    before = {x.path for x in s.manifest()[0]}
    again.clear()
    folders = set(p for p, _ in s._files("data"))

    def steal(version, shards, schema):
        if not again:
            again.append(other.compact())
        return commit(version, shards, schema)

    s.commit, s.fanout, other.fanout = steal, 2, 2
    with pytest.raises(CommitConflict):
        s.compact()
    assert s.read().count() == 70 and {x.path for x in s.manifest()[0]} != before
    s.commit = commit
    assert {p for p, _ in s._files("data")} - folders == {x.path for x in s.manifest()[0]} - folders  # nothing of the one that failed
    s.vacuum(0)
    assert {p for p, _ in s._files("data")} == {x.path for x in s.manifest()[0]} and s.read().count() == 70


def test_rows_come_back_as_they_were(spark):
    rows = [(None, None, 1, "a"), (1, "", None, "b"), (1, "", None, "b"), (2, "x" * 200_000, 2, None), (3, "tie", 3, "c"), (3, "tie", 3, "c")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, _shard int, _ROW string").selectExpr("*", "struct(doc_id d, text t) _metadata")
    s = store(spark, arrival_rows=7, target_bytes=20_000)
    for _ in range(3):
        s.append(df)
        s.compact()
    s.vacuum()
    got = s.read()
    assert got.columns == ["doc_id", "text", "_shard", "_ROW", "_metadata", "_shard_", "_row_"]
    key = lambda r: tuple(map(str, r[:4]))
    assert sorted(map(key, got.collect())) == sorted(map(key, rows * 3))
    assert got.select("_shard_", "_row_").distinct().count() == 3 * len(rows) == sum(x.rows for x in s.manifest()[0])


def test_groups():
    s = ShardStore.__new__(ShardStore)
    s.target, s.fanout = 1000, 4
    of = lambda sizes: [Shard(str(k), n, 1) for k, n in enumerate(sizes)]
    assert s.groups(of([10, 10, 10])) == [] == s.groups(of([900, 600, 10]))
    (own,) = s.groups(of([10] * 4))
    assert len(own) == 4
    assert [len(g) for g in s.groups(of([100] * 25))] == [10, 10, 5]
    (own,) = s.groups(of([10] * 4 + [45] * 3))  # four small ones make a fourth of the next tier: each row is written once
    assert len(own) == 7


def test_empty(spark):
    s = store(spark)
    assert s.read().count() == 0
    s.append(spark.range(0).selectExpr("id doc_id", "'x' text"))
    assert s.compact() == 1 and s.read().count() == 0 and s.read().columns == ["doc_id", "text", "_shard", "_row"]
