"""SQL of single queries on invented tables."""

import hashlib

import duckdb
import pytest

from quarry.plans import catalog


def tables(**rows):
    con = duckdb.connect()
    for name, sql in rows.items():
        con.sql(f"CREATE TABLE {name} AS {sql}")
    return con


def test_parse_all_counts_each_type_once():
    con = tables(documents="SELECT 1 AS doc_id, 'a' || chr(10) || chr(10) || 'b' AS text", conversations="SELECT 1 AS conv_id, 0 AS turn, 'said' AS text")
    got = sorted(r[:3] for r in con.sql(catalog.SQL["parse_all"]).fetchall())
    assert got == [("EMAIL", 1, 1), ("REPORT", 1, 6), ("TRANSCRIPT", 1, 1)]


@pytest.mark.parametrize("name", ["context_window", "continued_windows"])
def test_windows_of_odd_texts(spark, tmp_path, name):
    """Openers before letters with marks, white space that engines see differently, no text, ends of lines."""
    long = " und" * 9
    texts = ["Noé" + long + ".", "No," + long + ".", "Éok" + long + ".", "\u017fure" + long + ".", "OK" + long + ".\n", None, "ñ" + long + ".", "a\x0bb\xa0c d e f g h i\u2003j.", "a\x0bb c d e f g h.", "okñ" + long + "?", "no\u0301" + long + ".", "x" + long + ".\r"]
    rows = [(c, t, texts[(t * (c + 1) + c) % len(texts)]) for c in range(8) for t in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = tables(conversations=f"SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_an_alias_of_two_people_is_the_smaller_id(spark, tmp_path):
    seen, clash, n = {}, None, 0
    while not clash:  # two names whose aliases are equal
        name = "Ab" + "".join(chr(97 + int(d)) for d in str(n)) + " Berg"
        key = hashlib.md5(name.encode()).hexdigest()[:6]
        clash, n = (seen[key], name) if key in seen else None, n + 1
        seen[key] = name
    spark.createDataFrame([(1, f"1 {clash[0]} 2 {clash[1]} 3")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("GERMANY",)], "n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([("EUROPE",)], "r_name string").write.parquet(str(tmp_path / "region.parquet"))
    con = tables(**{t: f"SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')" for t in ("documents", "nation", "region")}, customer="SELECT 'A B' AS c_mktsegment")
    want = con.sql(catalog.SQL["resolve_or_mint"])
    got = catalog.QUERIES["resolve_or_mint"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    ids = [r[1] for r in want.fetchall() if r[0].startswith("Person " + hashlib.md5(clash[0].encode()).hexdigest()[:6])]
    assert ids == [min(hashlib.md5(x.encode()).hexdigest() for x in clash)]


def test_signal_pairs_spread_over_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id AS p_partkey", "CAST(CASE WHEN id % 9 > 0 THEN id % 60 - 5 END AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(90).selectExpr("id % 80 AS s_suppkey", "CAST(CASE WHEN id % 7 > 0 THEN id % 30 END AS INT) AS s_nationkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = tables(**{t: f"SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')" for t in ("part", "supplier")})
    pairs = catalog.QUERIES["signal_match"](spark, str(tmp_path))
    rows = pairs.selectExpr("p_partkey", "s_suppkey", "spark_partition_id() AS task").collect()
    assert sorted(tuple(r)[:2] for r in rows) == sorted(con.sql(catalog.SQL["signal_match"]).fetchall())
    assert len({r.task for r in rows}) > 4


def test_signal_pairs_take_little_room(spark, tmp_path):
    """Runs of one signal, each with the same short list of candidates; candidate by candidate it was 1.06 bytes a pair."""
    parts = spark.range(6000).selectExpr("id * 7919 % 1000003 AS p_partkey", "CAST(id % 3 AS INT) AS p_size")
    signals = spark.range(12000).selectExpr("id * 104729 % 1000003 AS s_suppkey", "CAST(CASE WHEN id % 9 = 0 THEN 5 ELSE id % 4 END AS INT) AS s_nationkey")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    signals.write.parquet(str(tmp_path / "supplier.parquet"))
    catalog.QUERIES["signal_match"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = tables(**{t: f"SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')" for t in ("part", "supplier")}, out=f"SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    of = "SELECT count(*), sum(hash(p_partkey, s_suppkey)::HUGEINT) FROM ({})"
    want = con.sql(of.format(catalog.SQL["signal_match"])).fetchall()
    assert con.sql(of.format("FROM out")).fetchall() == want
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * want[0][0]
