"""Stored models: bucketed tables, packed indexes, and several tables replaced together."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from velum.sources import models, promotion


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_moves_no_row(spark, tmp_path):
    """No exchange in the join nor in a grouping by the key; equal to the join of plain tables."""
    rng = random.Random(1)
    model = spark.createDataFrame([(i, j, rng.random(), j) for i in range(200) for j in range(5)], "movieId long, neighborId long, similarity double, rank int")
    asked = spark.createDataFrame([(rng.randrange(50), rng.randrange(220)) for _ in range(500)], "requestId long, movieId long")
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    a = models.bucketed(model, names[0], "movieId", "rank", buckets=8, path=f"file://{tmp_path}/a")
    b = models.bucketed(asked, names[1], "movieId", buckets=8, path=f"file://{tmp_path}/b")
    got = models.met(a, b, "movieId").groupBy("movieId", "neighborId").agg(F.count("*").alias("n"), F.sum("similarity").alias("s"))
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)
    want = asked.join(model, "movieId").groupBy("movieId", "neighborId").agg(F.count("*").alias("n"), F.sum("similarity").alias("s"))
    rounded = lambda df: sorted((*r[:3], round(r[3], 9)) for r in df.collect())
    assert rounded(got) == rounded(want)
    some = models.lookup(a, "movieId", [3, 7])
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # plans then show the buckets that are read
    shown = plan(models.lookup(a, "movieId", [3, 7]))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: " in shown and "SelectedBucketsCount: 8 out of 8" not in shown
    assert sorted((r.movieId, r.rank) for r in some.collect()) == [(i, j) for i in (3, 7) for j in range(5)]
    for n in names:
        spark.sql(f"drop table {n}")


def entries(spark):
    rng = random.Random(2)
    places = {(rng.randrange(95), rng.randrange(40)) for _ in range(300)} - {(r, c) for r in range(20, 41) for c in range(40)}
    rows = [(r, c, rng.random()) for r, c in sorted(places)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "row long, column long, weight double"), rows


def test_packed_index_round_trip(spark, tmp_path):
    """Empty rows, empty blocks and a last block of fewer rows; one file or several."""
    frame, rows = entries(spark)
    path = f"file://{tmp_path}/index"
    made = models.pack(frame.repartition(3), path, 95, 40, block=10)
    assert (made["rows"], made["columns"], made["entries"]) == (95, 40, len(rows)) and made["blocks"] == len({r // 10 for r, *_ in rows})
    assert sorted(map(tuple, models.unpack(spark, path).collect())) == sorted(rows)
    again = models.pack(frame.coalesce(1), path + "2", 95, 40, block=10)
    assert again["digest"] == made["digest"]
    models.pack(frame.limit(0), path + "3", 95, 40)
    assert models.unpack(spark, path + "3").collect() == []


@pytest.mark.parametrize(("rows", "code"), [([(95, 0, 1.0)], "outside_shape"), ([(0, 40, 1.0)], "outside_shape"), ([(1, 1, 1.0), (1, 1, 2.0)], "repeated_place")])
def test_entries_that_fit_no_index_are_refused(spark, tmp_path, rows, code):
    with pytest.raises(Exception, match=code):
        models.pack(spark.createDataFrame(rows, "row long, column long, weight double"), f"file://{tmp_path}/index", 95, 40)


DAMAGE = {
    "bad_digest": ("weights", lambda x: [x[0] + 1, *x[1:]]), "bad_column": ("ids", lambda x: [*x[:-1], 99]), "repeated_or_unsorted_column": ("ids", lambda x: [39] * len(x)),
    "bad_offsets": ("offsets", lambda x: [*x[:-1], x[-1] - 1]), "bad_shape": ("rows", lambda x: x - 1), "bad_weight": ("weights", lambda x: [float("nan"), *x[1:]]),
}


@pytest.mark.parametrize("code", [*DAMAGE, "not_as_in_manifest", "repeated_block", "bad_manifest", "unreadable"])
def test_damaged_index_is_refused(spark, tmp_path, code):
    frame, _ = entries(spark)
    path = f"file://{tmp_path}/index"
    manifest = models.pack(frame, path, 95, 40, block=10)
    blocks = spark.createDataFrame(spark.read.schema(models.PACKED).parquet(f"{path}/blocks").collect(), models.PACKED)
    if code in DAMAGE:
        column, change = DAMAGE[code]
        rows = [r.asDict() for r in blocks.collect()]
        rows[1][column] = change(rows[1][column])
        spark.createDataFrame([tuple(r.values()) for r in rows], models.PACKED).write.mode("overwrite").parquet(f"{path}/blocks")
    elif code == "not_as_in_manifest":
        blocks.where("block > 0").write.mode("overwrite").parquet(f"{path}/blocks")
    elif code == "repeated_block":
        blocks.union(blocks.where("block = 0")).write.mode("overwrite").parquet(f"{path}/blocks")
    elif code == "bad_manifest":
        spark.createDataFrame([(json.dumps(manifest | {"rows": "95"}),)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    else:
        path += "gone"
    with pytest.raises(models.ModelError) as e:
        models.unpack(spark, path)
    assert e.value.code == code


class Failing(promotion.Files):
    """Raises at the n-th change; with ``dead`` every later one raises too, as if the process had ended."""

    def __init__(self, spark, n, dead):
        super().__init__(spark)
        self.left, self.dead = n, dead

    def _step(self):
        self.left -= 1
        if self.left == 0 or (self.dead and self.left < 0):
            raise OSError("stopped")

    def move(self, a, b):
        self._step()
        super().move(a, b)

    def remove(self, path):
        self._step()
        super().remove(path)


@pytest.mark.parametrize("dead", [False, True])
def test_tables_are_replaced_together_or_not_at_all(spark, tmp_path, dead):
    """A failure at every single step of the swap: after recovery all tables are old or all are new, and nothing is left over."""
    value = lambda p: spark.read.parquet(p).first()[0] if promotion.Files(spark).exists(p) else None
    frame = lambda v: spark.createDataFrame([(v,)], "v string").coalesce(1)
    outcomes = set()
    for n in range(1, 40):
        base = f"file://{tmp_path}/{n}"
        paths = [f"{base}/{c}" for c in "abc"]
        for p in paths[:2]:  # the third is new
            frame("old").write.parquet(p)
        files = Failing(spark, n, dead)
        failed = False
        try:
            promotion.promote({p: frame("new") for p in paths}, f"{base}/journal", files=files)
        except OSError:
            failed = True
        promotion.recover(promotion.Files(spark), f"{base}/journal")
        got = [value(p) for p in paths]
        assert got in (["old", "old", None], ["new", "new", "new"]), (n, got)
        outcomes.add(got[0])
        left = {x.name for x in (tmp_path / str(n)).iterdir() if not x.name.startswith(".")}
        assert {x for x in left if "journal" in x or "backup" in x} == set()
        if not failed and files.left > 0:
            break
    assert outcomes == {"old", "new"} and n > 8


def test_refused_tables_leave_the_old_ones(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    spark.range(3).write.parquet(a)

    def check(found):
        if found[b].count() != 5:
            raise ValueError("five rows expected")

    with pytest.raises(ValueError, match="five"):
        promotion.promote({a: spark.range(9), b: spark.range(4)}, f"file://{tmp_path}/journal", check)
    assert spark.read.parquet(a).count() == 3 and not promotion.Files(spark).exists(b)
    promotion.promote({a: spark.range(9), b: spark.range(5)}, f"file://{tmp_path}/journal", check)
    assert spark.read.parquet(a).count() == 9 and spark.read.parquet(b).count() == 5
