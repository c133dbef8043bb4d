"""Row numbers over many partitions, exact quartiles, long indicator lists, formats and the command line."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode import cli
from tracelode.operators import profile, search, zones
from tracelode.sources.dataset import with_row_idx


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_row_numbers_have_no_gaps(spark, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            df = spark.range(0, 50_000, 1, parts).select((F.col("id") * 7919 % 50_021).alias("k"))
            rows = with_row_idx(df, "k").orderBy("row_idx").collect()
            assert [r.row_idx for r in rows] == list(range(50_000))
            assert all(a.k < b.k for a, b in zip(rows, rows[1:], strict=False))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_zone_pruning_keeps_the_rows(spark):
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    rows = with_row_idx(orders, "o_orderkey")
    assert rows.count() == orders.count() == rows.select("row_idx").distinct().count()
    got = zones.pruned(rows, zones.zone_map(rows, ["o_totalprice"], size=512), "o_totalprice", 1000, 5000, size=512)
    assert got.count() == orders.where("o_totalprice BETWEEN 1000 AND 5000").count() > 0


@pytest.mark.parametrize("kind", ["random", "ties", "few", "none"])
def test_quartiles_are_exact(spark, kind):
    draw = random.Random(4)
    values = {"random": [draw.gauss(0, 1e6) for _ in range(20_001)], "ties": [float(draw.randrange(3)) for _ in range(5000)], "few": [3.0, 1.0], "none": []}[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = profile.quartiles(df, "v").first()
    want = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or [None] * 3
    assert [got.q1, got.median, got.q3] == (pytest.approx(want) if values else want)


def test_long_indicator_lists_count_as_short_ones_do(spark):
    df = spark.createDataFrame([(1, "AbaBa and other"), (2, None), (3, "nothing"), (4, "x.y x.y")], "k int, text string")
    words = ["aba", "x.y", "OTHER", "other", "", "th"]
    short = sorted(map(tuple, search.indicators(df, "text", words, ["k"]).collect()))
    long = sorted(map(tuple, search.indicators(df, "text", words + [f"none{k}" for k in range(100)], ["k"]).collect()))
    assert short == long and ("aba", 1, 2) in long


@pytest.fixture
def table(tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("kind,size\na,1\nb,2\na,3\nc,x\n")
    return str(path)


def shown(capsys, spark, *argv):
    capsys.readouterr()
    assert cli.main([str(a) for a in argv]) == 0
    return capsys.readouterr().out


def test_command_line(spark, table, capsys, tmp_path):
    assert "|a       |2    |4.0|" in shown(capsys, spark, "group", table, "--by", 0, "--agg", 1)
    assert "|a       |2    |4.0|" not in shown(capsys, spark, "group", table, "--by", 0, "--agg", 1, "--regex", "^a,3")
    top = shown(capsys, spark, "top", table, "--col", 1, "--desc", "--regex", "^[ab],")
    assert "b" in top and "c" not in top.replace("kind", "")
    assert "3" in shown(capsys, spark, "get-rows", table, "--start", 2, "--limit", 1)
    assert "a,1" in shown(capsys, spark, "hybrid", table, "A,")
    assert '"content":"b,2"' in shown(capsys, spark, "search", table, "B,", "--json")
    assert "parallelism" in shown(capsys, spark, "sys-info") and "java" in shown(capsys, spark, "scan-hardware")
    assert shown(capsys, spark, "build-zones", table, str(tmp_path / "zones"), "--columns", "size", "--zone-size", 2) == ""
    got = spark.read.parquet(str(tmp_path / "zones")).orderBy("zone").collect()
    assert [(r.start_row, r.end_row, r.min_size, r.max_size) for r in got] == [(0, 2, 1.0, 2.0), (2, 4, 3.0, 3.0)]
    shown(capsys, spark, "export", table, str(tmp_path / "out"), "--filter", "$1 > 1")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    for verb in ("metadata", "index", "hash", "analyze", "view"):
        assert shown(capsys, spark, verb, table)
