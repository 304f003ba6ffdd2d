from pyspark.sql import functions as F

from casestream.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_trim_takes_all_white_space(spark):
    assert one(spark, "﻿\t  a b　\n", T.trimmed) == "a b"
    assert one(spark, " ﻿", T.is_blank) is True
    assert one(spark, None, T.is_blank) is True


def test_empty_counts_as_missing(spark):
    assert one(spark, "", lambda c: T.or_else(c, "N/A")) == "N/A"
    assert one(spark, "N/A", T.truthy) is True
    assert one(spark, None, T.truthy) is False


def test_only_the_first_label_goes(spark):
    assert one(spark, "OIB OIB x", lambda c: T.without_first(c, "OIB")) == " OIB x"
    assert one(spark, "x", lambda c: T.without_first(c, "OIB")) == "x"


def test_extensions(spark):
    for name, want in (("a.b/c.pdf", ".pdf"), (".hidden", ""), ("none", ""), ("x.", "."), ("a.tar.gz", ".gz")):
        assert one(spark, name, T.extension) == want, name


def test_extension_ladder(spark):
    rows = [
        ("attachment; filename=\"a%20b.pdf\"", "text/plain", "x", ".pdf"),
        ("attachment; filename*=UTF-8''a+b.docx", None, None, ".docx"),
        ("attachment; filename=bad%ZZ.pdf", "text/plain", "x", None),
        (None, "application/pdf; q=1", None, ".pdf"),
        (None, "application/octet-stream", "The ZIP", ".zip"),
        (None, None, None, ".bin"),
        ("attachment; filename=noext", "image/png", None, ".png"),
    ]
    df = spark.createDataFrame([(*r[:3], i) for i, r in enumerate(rows)], "d string, m string, t string, i int")
    got = {r.i: r.e for r in df.select("i", T.extension_of_download("d", "m", "t").alias("e")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def test_names_and_sizes(spark):
    assert one(spark, "Č a/b.pdf" + "x" * 60, T.download_name) == ("__a_b_pdf" + "x" * 60)[:40]
    assert one(spark, None, T.download_name) == "document"
    assert [one(spark, v, T.text_size) for v in ("17", "99", "-1", "x", None)] == [17, 18, 16, 16, 16]


def test_identifier_renders_null(spark):
    df = spark.createDataFrame([("St-1/2000", None)], "a string, b string")
    assert df.select(T.identifier("a", "b")).first()[0] == "St-1/2000 - null"
