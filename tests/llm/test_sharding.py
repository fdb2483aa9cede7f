from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from docloom.llm import sharding


def rows(df):
    return sorted(map(tuple, df.drop("shard").collect()), key=repr)


def test_store(spark, odd, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "store"), target=1 << 30, least=1 << 10)
    assert store.version() == 0 and store.shards() == []
    with pytest.raises(ValueError):
        store.read()
    for _ in range(3):
        store.append(odd)
    before = store.version()
    assert before == 3 and len(store.shards()) == 3 and store.compact() == 3
    store.append(odd)
    assert rows(store.read()) == sorted(rows(odd) * 4, key=repr)
    store.compact()
    shards = store.shards()
    assert len(shards) == 1 and shards[0].rows == 4 * odd.count() and shards[0].merged == 1
    assert rows(store.read()) == sorted(rows(odd) * 4, key=repr)
    # Older versions stay readable until they are vacuumed; a version is committed once.
    assert store.read(before).count() == 3 * odd.count()
    with pytest.raises(sharding.Conflict):
        store.commit(before, [])
    assert store.vacuum() == 4 and store.vacuum() == 0
    assert rows(store.read()) == sorted(rows(odd) * 4, key=repr)


def test_runs_of_similar_size(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "store"), target=1000, least=10)
    of = lambda *sizes: [sharding.Shard(str(i), 1, s, 1, 0) for i, s in enumerate(sizes)]
    assert [sharding.tier(x, 10) for x in (0, 9, 10, 39, 40, 160)] == [0, 0, 1, 1, 2, 3]
    assert store.due(of(5, 6, 7)) == [] and [len(r) for r in store.due(of(5, 6, 7, 8, 20, 30))] == [4]
    assert store.due(of(1000, 2000, 3000, 4000)) == []
    runs = store.due(of(*[500] * 9))
    assert [len(r) for r in runs] == [4, 5] or [len(r) for r in runs] == [4, 4]


def test_table(spark, odd, empty, tmp_path):
    odd.repartition(6).write.parquet(str(tmp_path / "in"))
    store = sharding.shard_table(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "store"), arrivals=5, least=1 << 10)
    assert rows(store.read()) == rows(odd)
    placed = sharding.placement(store)
    assert placed.columns == ["doc_id", "shard", "tier", "shard_rows", "version"] and placed.count() == odd.count()
    empty.write.parquet(str(tmp_path / "none"))
    assert sharding.shard_table(spark.read.schema(empty.schema).parquet(str(tmp_path / "none")), str(tmp_path / "store2"), arrivals=2).read().count() == 0


def test_small_shards_and_merges_at_every_scale(spark, tmp_path):
    """One large file, and many, come as small shards that are merged to files near the target."""
    df = spark.range(60_000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text")
    for parts in (1, 8):
        df.repartition(parts).write.parquet(str(tmp_path / f"in{parts}"))
        source, target = spark.read.parquet(str(tmp_path / f"in{parts}")), 200_000
        store = sharding.shard_table(source, str(tmp_path / f"store{parts}"), arrivals=3, target=target, least=1 << 10)
        shards = store.shards()
        assert store.read().select("doc_id").distinct().count() == sum(s.rows for s in shards) == 60_000
        assert any(s.merged for s in shards) and len(shards) > 4
        assert all(s.bytes // s.files < 2 * target for s in shards)
        assert sum(s.bytes for s in shards if s.bytes // s.files >= target // 2) > 0.7 * sum(s.bytes for s in shards)
        first = min(v for v in store.versions() if sum(s.rows for s in store.shards(v)) > 10_000)
        assert store.read(first).count() == sum(s.rows for s in store.shards(first))


def test_frames_of_any_kind_are_stored_whole(spark, odd, tmp_path):
    odd.withColumn("part", F.pmod(F.hash("text"), F.lit(3))).write.partitionBy("part").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    for i, df in enumerate([table, table.where("doc_id > 5"), table.where("part = 1").select("text", "part"), odd, table.limit(0)]):
        store = sharding.shard_table(df, str(tmp_path / f"store{i}"), arrivals=4)
        assert rows(store.read()) == rows(df) and store.read().drop("shard").columns == df.columns


def test_small_tables_are_merged_too(spark, odd, tmp_path):
    odd.coalesce(1).write.parquet(str(tmp_path / "in"))
    store = sharding.shard_table(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "store"), arrivals=6)
    assert max(s.merged for s in store.shards()) == 1 and store.version() == 7 and rows(store.read()) == rows(odd)


def test_vacuum_leaves_what_a_writer_has_not_committed(spark, odd, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "store"), least=1 << 10)
    for _ in range(4):
        store.append(odd)
    drafted = store.draft(odd, 5)
    pending = store._write(odd, 0)
    store.compact()
    assert store.vacuum(keep=2) == 0 and store.read(4).count() == 4 * odd.count()
    assert store.vacuum() == 4
    store.deliver([*drafted[1:], pending])
    assert store.read().count() == 6 * odd.count() - drafted[0].rows
    assert store.vacuum() == 0 and store.vacuum(grace=-60) == 1
    assert store.read().count() == 6 * odd.count() - drafted[0].rows


def test_one_writer_commits_a_version(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "store"))

    def write(i):
        try:
            return store.commit(0, [sharding.Shard(str(i), 1, 1, 1, 0)])
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i, v in enumerate(pool.map(write, range(24))) if v]
    assert len(won) == 1 and [s.name for s in store.shards()] == [str(won[0])]
    assert store.versions() == [1]


def test_many_small_files_of_one_shard_are_due(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "store"), target=1000, least=10)
    assert [[s.name for s in r] for r in store.due([sharding.Shard("a", 1, 8000, 100, 0), sharding.Shard("b", 1, 8000, 8, 0)])] == [["a"]]


def _appended(spark, tmp_path, n=4):
    store = sharding.Store(spark, str(tmp_path / "store"), target=1 << 30, least=1 << 10)
    for i in range(n):
        store.append(spark.range(100 * i, 100 * i + 100))
    return store


def _ids(store):
    return sorted(r.id for r in store.read().collect())


def test_two_compactors_neither_double_nor_lose_rows(spark, tmp_path):
    """The second finds its run merged already, whether before it merges or between its merge and its commit."""
    one = _appended(spark, tmp_path)
    two = sharding.Store(spark, one.base, target=1 << 30, least=1 << 10)
    merge, base = two._merge, one.version()

    def late(run):
        made = merge(run)
        one.compact()
        return made

    two._merge = late
    assert two.compact() == one.version() == base + 1
    assert _ids(one) == list(range(400)) and len(one.shards()) == 1
    # The copy that nobody lists is gone at once.
    assert {p.name for p in (tmp_path / "store/data").iterdir()} == {s.name for v in one.versions() for s in one.shards(v)}


def test_a_compactor_against_appends(spark, tmp_path):
    """What is appended during a merge is in the version that has the merged run; also when the append takes the version first."""
    store = _appended(spark, tmp_path)
    other = sharding.Store(spark, store.base, target=1 << 30, least=1 << 10)
    merge, commit, first = store._merge, store.commit, []

    def slow(run):
        made = merge(run)
        other.append(spark.range(400, 450))
        return made

    def beaten(after, shards):
        if not first:
            first.append(other.append(spark.range(450, 500)))
        return commit(after, shards)

    store._merge, store.commit = slow, beaten
    store.compact()
    assert _ids(store) == list(range(500)) and len(store.shards()) == 3


def test_only_runs_that_were_merged_elsewhere_are_dropped(spark, tmp_path):
    store = _appended(spark, tmp_path, 8)
    shards = store.shards()
    runs = [shards[:4], shards[4:]]
    made = [store._merge(r) for r in runs]
    theirs = store._merge(runs[0])
    store.replace(runs[:1], [theirs])
    store.replace(runs, made)
    assert _ids(store) == list(range(800)) and [s.name for s in store.shards()] == [theirs.name, made[1].name]


@pytest.mark.parametrize("column", ["shard", "tier", "_shard_name2", "version", "name"])
def test_placement_by_reading_each_shard(spark, tmp_path, column):
    """Each row's place against the files of each shard; the table has a column of a clashing name."""
    df = spark.range(3000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text", f"'x' as `{column}`").repartition(3)
    store = sharding.shard_table(df, str(tmp_path / "store"), arrivals=6, target=20_000, least=1 << 10)
    want = []
    for i, s in enumerate(store.shards()):
        ids = [r.doc_id for r in spark.read.parquet(f"{store.base}/data/{s.name}").select("doc_id").collect()]
        assert len(ids) == s.rows
        want += [(x, i, sharding.tier(s.bytes, 1 << 10), len(ids), store.version()) for x in ids]
    assert sorted(map(tuple, sharding.placement(store).collect())) == sorted(want) and len(want) == 3000
