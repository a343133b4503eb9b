"""Listing and detail pages against SQL where chapter numbers are long."""

import duckdb

from statvine.plans.all import ORACLES, QUERIES


def rows_of(spark, folder, name, keys):
    """The query's rows and its SQL's over parts of these keys."""
    parts = [(k, f"part {k}", "Brand#1", "STEEL", 1 + k % 50) for k in keys]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for t in ("lineitem", "documents", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    sql = con.execute(ORACLES[name])
    order = [[c[0] for c in sql.description].index(c) for c in df.columns]
    return sorted(tuple(map(str, r)) for r in df.collect()), sorted(tuple(str(r[i]) for i in order) for r in sql.fetchall())


#: Chapters 1:01, 999:99, 1000:00, 1201:05 and 72001:00.
KEYS = [1, 99_899, 99_900, 120_005, 7_200_000]


def test_listing_reads_long_chapter_numbers(spark, tmp_path):
    ours, theirs = rows_of(spark, tmp_path, "law_listing", KEYS)
    assert ours == theirs and len(ours) == len(KEYS)


def test_detail_reads_long_chapter_numbers(spark, tmp_path):
    ours, theirs = rows_of(spark, tmp_path, "law_detail", KEYS)
    assert ours == theirs and len(ours) == len(KEYS)
