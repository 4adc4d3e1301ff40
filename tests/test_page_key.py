import pytest
from pyspark.sql import functions as F

from seamark.functions.page_key import key_host, page_key

CASES = [
    (" HTTPS://WWW.Inkwell.test:443//A%62/?y=2&X=1&utm_a=3#k", "inkwell.test/ab?x=1&y=2"),
    ("http://a.test", "a.test"),
    ("http://a.test/", "a.test"),
    ("https://a.test/?", "a.test"),
    ("https://a.test/?utm_source=x&GCLID=1&fbclid", "a.test"),
    ("http://a.test:8080/x", "a.test:8080/x"),
    ("http://a.test:80/x", "a.test/x"),
    ("//b.test//x/ ?a=%zz&b", "b.test/x?a=%zz&b"),
    ("a.test/x%20/", "a.test/x"),
    ("http://a.test/%20/x%2B+y%C3%A9/", "a.test/x++yé"),
    ("http://a.test/b\n", "a.test/b"),
    ("  http://a.test/b　", "a.test/b"),
    ("http://a.test/b?z&a=2&a=1", "a.test/b?a=1&a=2&z"),
    ("http://a.test/b#x?y=1", "a.test/b"),
    ("HTTP://A.TEST/Ä", "a.test/ä"),
    ("http://a.test/x_y-z.html", "a.test/x_y-z.html"),
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("/foo", "/foo"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(CASES)], "i int, u string")
    got = {r.i: r.k for r in df.select("i", page_key(F.col("u")).alias("k")).collect()}
    for i, (u, want) in enumerate(CASES):
        assert got[i] == want, u


@pytest.mark.parametrize(("host", "address", "want"), [("own.test", "/a/", "own.test/a"), ("own.test", "//x.test/a", "x.test/a"), ("own.test", "/", "own.test"), ("o$w\\n.test", "/a", "o$w\\n.test/a"), (None, "/a", "/a"), ("own.test", " /a", "own.test/a")])
def test_own_host(spark, host, address, want):
    df = spark.createDataFrame([(host, address)], "h string, u string")
    assert df.select(page_key(F.col("u"), F.col("h"))).first()[0] == want


def test_host(spark):
    df = spark.createDataFrame([("a.test/b",), ("a.test?x=1",), ("",), ("a.test",)], "k string")
    assert [r[0] for r in df.select(key_host(F.col("k"))).collect()] == ["a.test", "a.test", "", "a.test"]


def test_key_is_stable(spark):
    """The key of a key is the key, for addresses without escapes."""
    rows = spark.read.parquet("/root/testdata/sf0.001/page_audit.parquet").select(page_key(F.col("url")).alias("k"))
    assert rows.filter(page_key(F.col("k")) != F.col("k")).count() == 0
