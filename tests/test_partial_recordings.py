"""The last recording lacks channels where the table's rows aren't a multiple of them: the queries give DuckDB's rows all the same."""

import duckdb
import pytest
from test_queries import rows

from wavefold.operators import signal
from wavefold.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001/embeddings.parquet"


def agree(spark, tmp_path, name, keep):
    """`keep`: the vectors that are there."""
    con = duckdb.connect()
    con.sql(f"copy (select * from read_parquet('{DATA}') where {keep}) to '{tmp_path}/embeddings.parquet'")
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(registry.ORACLE_SQL[name]).df())
    return got


@pytest.mark.parametrize("keep", ["vec_id < 476", "vec_id <= 498", "vec_id <> 498", "vec_id not in (478, 479) and vec_id <= 498", "vec_id < 480 or vec_id = 499"])
def test_misc_targets_without_misc_or_other_channels(spark, tmp_path, keep):
    agree(spark, tmp_path, "misc_targets", keep)


@pytest.mark.parametrize("keep", ["vec_id < 496", "vec_id <> 490 and vec_id <= 480", "vec_id not in (7, 25)"])
def test_common_average_of_the_channels_there(spark, tmp_path, keep):
    got = agree(spark, tmp_path, "segment_combiners", keep)
    assert got["rec"].nunique() == 25


def test_unequal_channels_in_a_partial_average(spark):
    d = spark.createDataFrame([(1, 0, [1.0, 2.0, 5.0]), (1, 3, [3.0, 4.0]), (2, 5, []), (3, 19, [1.0])], "rec long, ch long, samples array<double>")
    assert sorted(tuple(r) for r in signal.montage_arrays(d, "CAR", partial=True).collect()) == [(1, 0, [-1.0, -1.0, 0.0]), (1, 3, [1.0, 1.0]), (2, 5, [])]
    with pytest.raises(ValueError):
        signal.montage_arrays(d, "Cz", partial=True)


@pytest.mark.parametrize("keep", ["vec_id < 476", "vec_id < 484", "vec_id <> 39"])
def test_missing_channel_of_even_recordings_alone(spark, tmp_path, keep):
    agree(spark, tmp_path, "add_missing_channel", keep)
