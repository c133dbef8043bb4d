"""Ranking of addresses by hand."""

from tracelode.operators import ioc


def test_file_count_is_not_cut(spark):
    rows = [("1.2.3.4", f"f{k}", 1, 0) for k in range(60)] + [("5.6.7.8", None, 2, 0), ("5.6.7.8", "f", 1, 0)]
    got = {r.ip: r for r in ioc.rank(spark.createDataFrame(rows, "ip string, file string, hits long, noise_hits long")).collect()}
    assert (got["1.2.3.4"].n_files, len(got["1.2.3.4"].top_files)) == (60, 50)
    assert got["5.6.7.8"].n_files == 1
