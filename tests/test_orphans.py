import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from matchloom.operators import orphans as O
from matchloom.streaming.orphans import EVENTS, OrphanStream

DAY = lambda n: datetime(2024, 1, n)
PARENTS = [  # key, row_id, loaded, deleted
    ("KH001", 1, DAY(1), None),
    ("kh-2", 2, DAY(1), DAY(9)),
    ("KH3", 3, DAY(8), None),
    ("KH2", 4, DAY(20), DAY(21)),
    (None, 5, DAY(1), None),
]
REFS = [  # key, row_id, loaded
    ("KH1", 1, DAY(2)),
    (" kh 0001 ", 2, DAY(2)),
    ("KH2", 3, DAY(2)),
    ("KH003", 4, DAY(3)),
    ("KH3", 5, DAY(8)),
    ("KH9", 6, DAY(3)),
    ("NULL", 7, DAY(3)),
    ("  ", 8, DAY(3)),
    (None, 9, DAY(3)),
    ("KH9", 6, DAY(3)),
]


def frames(spark, refs=REFS, parents=PARENTS):
    p = spark.createDataFrame(parents, "makh string, row_id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("ref_key", F.lit("clash"))
    r = spark.createDataFrame(refs, "makh string, row_id bigint, loaded_at timestamp_ntz").withColumns({"reason": F.lit("clash"), "known": F.lit(1)})
    return O.parents(p, "khachhang", "makh"), O.references(r, "banhang", "makh", "khachhang")


EXPECTED = [(3, "deleted"), (4, "late"), (6, "missing"), (6, "missing")]


def listed(df):
    return sorted((r["row_id"], r["reason"]) for r in df.collect() if r["reason"])


def test_reference_key(spark):
    given = ["KH00000104", "kh-104", " Kh 0104", "KH 104", "000", "", " ", "null", None, "-", "A0B01"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, k string")
    got = [r[0] for r in df.orderBy("i").select(O.reference_key("k")).collect()]
    assert got == ["KH104", "KH104", "KH104", "KH104", "0", None, None, None, None, None, "A0B01"]


def test_probe(spark):
    parents, refs = frames(spark)
    assert listed(O.probe(refs, O.parent_index(parents))) == EXPECTED


def folded(spark, tmp_path, batches, buckets=4, name="state"):
    state = O.OrphanState(spark, str(tmp_path / name), buckets)
    for parents, refs in batches:
        state.fold(parents, refs)
    return state


def reader(parents, refs):
    return lambda start, end: (O.happened(parents, start, end, True), O.happened(refs, start, end, False))


@pytest.mark.parametrize("cuts", [(1, 31), (1, 3, 9, 31), tuple(range(1, 12)) + (31,)])
def test_batches_equal_one_load(spark, tmp_path, cuts):
    parents, refs = frames(spark)
    day = F.dayofmonth("loaded_at")
    within = lambda df, lo, hi: df.where((day >= lo) & (day < hi))
    state = folded(spark, tmp_path, [(within(parents, lo, hi), within(refs, lo, hi)) for lo, hi in zip(cuts, cuts[1:])])
    assert listed(state.pending()) == EXPECTED


@pytest.mark.parametrize("ends", [[None], [DAY(5), None], [DAY(2), DAY(4), DAY(9), DAY(10), DAY(21), None]])
def test_events_in_time(spark, tmp_path, ends):
    """Deletions take effect when they happen; the end is the same for every cut."""
    parents, refs = frames(spark)
    seen = []
    state = O.folded(spark, reader(parents, refs), ends, str(tmp_path / "s"), 4, each=lambda s, end: seen.append(listed(s.pending())))
    assert listed(state.pending()) == EXPECTED and len(seen) == len(ends)
    if len(ends) == 6:
        assert seen[1] == [(4, "missing"), (6, "missing"), (6, "missing")]
        assert (3, "deleted") in seen[3] and (3, "late") in seen[4] and (4, "late") in seen[2]


def test_deletion_reopens(spark, tmp_path):
    at_first = frames(spark, parents=[("KH1", 1, DAY(1), None)], refs=[("KH1", 1, DAY(2))])
    gone = frames(spark, parents=[("KH1", 1, DAY(1), DAY(5))], refs=[])
    back = frames(spark, parents=[("KH1", 2, DAY(6), None)], refs=[])
    state = folded(spark, tmp_path, [at_first])
    assert state.pending().count() == 0
    state.fold(*gone)
    assert listed(state.pending()) == [(1, "deleted")]
    state.fold(*back)
    assert listed(state.pending()) == [(1, "late")]


def test_random_events_against_one_probe(spark, tmp_path):
    rng = random.Random(4)
    parents = [(f"KH{rng.randrange(12)}", i, DAY(rng.randrange(1, 28)), DAY(28) if rng.random() < 0.3 else None) for i in range(30)]
    refs = [(f"KH{rng.randrange(16)}", i, DAY(rng.randrange(1, 28))) for i in range(120)]
    parents, refs = frames(spark, refs=refs, parents=parents)
    expected = listed(O.probe(refs, O.parent_index(parents)))
    state = O.folded(spark, reader(parents, refs), [DAY(7), DAY(14), DAY(20), DAY(28), None], str(tmp_path / "s"), 8)
    assert expected and listed(state.pending()) == expected


def test_work_of_a_batch(spark, tmp_path, monkeypatch):
    """A batch reads and rewrites the buckets of its keys only, however much the state holds; old segments go."""
    parents, refs = frames(spark, refs=[(f"KH{i}", i, DAY(3)) for i in range(1, 400)], parents=[(f"KH{i}", i, DAY(2), None) for i in range(1, 300)])
    monkeypatch.setattr(O, "small", lambda df, rows, limit=1: df)  # the plain joins
    state = folded(spark, tmp_path, [(parents, refs)], buckets=16)
    assert state.pending().count() == 100
    read = []
    monkeypatch.setattr(O.KeyedState, "read", lambda self, s, m, part, buckets=None, was=O.KeyedState.read: (read.append((part, set(m[part]) if buckets is None else set(buckets) & set(m[part]))), was(self, s, m, part, buckets))[1])
    before = {p: dict(of) for p, of in state.manifest.items()}
    state.fold(*frames(spark, refs=[("KH350", 900, DAY(5))], parents=[("KH351", 901, DAY(5), None), ("KH7", 7, DAY(2), DAY(5))]))
    assert all(len(buckets) <= 3 for _, buckets in read)
    changed = {p: sum(before[p].get(b) != v for b, v in of.items()) for p, of in state.manifest.items()}
    assert changed["parents"] <= 2 and changed["refs"] == 1 and changed["pending"] <= 3
    monkeypatch.undo()
    assert listed(state.pending())[:1] == [(7, "deleted")] and (351, "late") in listed(state.pending())
    for _ in range(12):  # compaction keeps the number of segments bounded
        state.fold(*frames(spark, refs=[("KH1", 950, DAY(6))], parents=[]))
    assert max(len(v) for of in state.manifest.values() for v in of.values()) <= 9
    assert not (tmp_path / "state/manifest-3.json").exists() and state.pending().count() == 102


def test_empty_tables(spark):
    parents, refs = frames(spark, refs=[], parents=[])
    assert O.probe(refs, O.parent_index(parents)).count() == 0
    _, refs = frames(spark)
    assert {r for _, r in listed(O.probe(refs, O.parent_index(parents)))} == {"missing"}


def test_counts(spark, tmp_path):
    for t, cols in (("khachhang", "makh"), ("nhanvien", "manv"), ("hang", "mahang")):
        spark.createDataFrame(PARENTS, f"{cols} string, row_id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [(i, "HD1", k, None, t, None) for k, i, t in REFS]
    spark.createDataFrame(rows, "row_id bigint, mahd string, makh string, manv string, loaded_at timestamp_ntz, deleted_at timestamp_ntz").write.parquet(f"{tmp_path}/banhang.parquet")
    spark.createDataFrame([(1, "HD01", None, DAY(5))], "row_id bigint, mahd string, mahang string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/chitietbanhang.parquet")
    assert sorted(r["row_id"] for r in O.orphan_rows(spark, str(tmp_path)).collect()) == [3, 4, 6, 6]
    counts = {(r["child_table"], r["ref_column"]): r for r in O.orphan_counts(spark, str(tmp_path)).collect()}
    own = counts["banhang", "makh"]
    assert (own["refs"], own["orphans"], own["missing"], own["deleted"], own["late"]) == (7, 4, 2, 1, 1)
    assert counts["chitietbanhang", "mahd"]["orphans"] == 0


def test_stream(spark, tmp_path):
    parents, refs = frames(spark)
    events = parents.withColumn("kind", F.lit("parent")).unionByName(refs.withColumn("kind", F.lit("reference")), allowMissingColumns=True)
    source = str(tmp_path / "events")
    for k, (lo, hi) in enumerate(((1, 3), (3, 9), (9, 31))):
        day = F.dayofmonth("loaded_at")
        events.where((day >= lo) & (day < hi)).select(*[c.split(" ")[0] for c in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(source)
        stream = OrphanStream(str(tmp_path / "state"))
        query = spark.readStream.schema(EVENTS).parquet(source).writeStream.foreachBatch(stream.fold).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
    last = OrphanStream(str(tmp_path / "state")).load(spark, 2)
    assert listed(last.pending()) == EXPECTED
    counts = spark.read.parquet(str(tmp_path / "state/counts/batch=2"))
    assert counts.agg(F.sum("orphans")).first()[0] == 4


@pytest.mark.parametrize("hot", [3000])
def test_hot_key(spark, hot):
    parents, refs = frames(spark, refs=[("KH1", i, DAY(2)) for i in range(hot)] + [("KH9", hot, DAY(2))])
    assert listed(O.probe(refs, O.parent_index(parents))) == [(hot, "missing")]
