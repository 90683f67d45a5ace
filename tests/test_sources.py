import sqlite3

from wardtable.sources import catalog as K
from wardtable.sources import sqlite as Q


def test_sqlite_in_ranges(spark, tmp_path, rows):
    path = str(tmp_path / "forms.db")
    con = sqlite3.connect(path)
    con.execute("create table tbl_a (person_id integer, name text, v real)")
    con.executemany("insert into tbl_a values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(100)] + [(None, None, None)])
    con.execute("create table tbl_empty (x integer)")
    con.commit()
    con.close()
    catalog = Q.load_sqlite(spark, path, partitions=4)
    assert sorted(catalog) == ["tbl_a", "tbl_empty"]
    a = catalog["tbl_a"]
    assert a.rdd.getNumPartitions() == 4 and a.count() == 101
    assert a.agg({"v": "sum"}).first()[0] == sum(i / 2 for i in range(100))
    assert catalog["tbl_empty"].count() == 0
    assert rows(K.describe_catalog(catalog))[0] == ("formulario_a", ["person_id", "name", "v"])


def test_csv_round_trip_drops_the_index(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write(",a,b\n0,1,x\n1,,y\n")
    df = K.read_csv(spark, path)
    assert df.columns == ["a", "b"] and df.filter("a is null").count() == 1
    out = str(tmp_path / "out")
    lists = spark.createDataFrame([(1, ["p", "q"])], "i int, l array<string>")
    K.write_csv(lists, out)
    assert K.read_csv(spark, out).first()["l"] == "p, q"


def test_catalog_of_a_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "tbl_x.parquet"))
    spark.range(2).write.parquet(str(tmp_path / "tbl_y"))
    catalog = K.load_catalog(spark, str(tmp_path))
    assert {n: d.count() for n, d in catalog.items()} == {"tbl_x": 3, "tbl_y": 2}
