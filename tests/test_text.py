from pyspark.sql import functions as F

from foliant.functions import text as X


def test_title_case_is_pythons(spark):
    words = ["3d api", "api.v2", "über uns", "a-b c", "", "don't", "x1y"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(X.title_case(F.col("w")).alias("t")).collect()
    assert [r.t for r in rows] == [w.title() for w in words]


def test_frontmatter_split(spark):
    texts = ["---\ntype: A\n---\nbody\n", "no header", "---\nopen only", None, "---\nx---\ny"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.frontmatter_of(F.col("t")).alias("f"), X.body_of(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("type: A\n", "body\n"), (None, "no header"), (None, "---\nopen only"), (None, None), ("x", "y")]


def test_small_predicates(spark):
    d = spark.createDataFrame([("a" * 199 + "   \n",), ("a" * 200,), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(X.below_threshold(F.col("t"))).collect()] == [True, False, True, None]
    d = spark.createDataFrame([("a/index",), ("log",), ("a/b",)], "p string")
    assert [r[0] for r in d.select(X.is_reserved(F.col("p"))).collect()] == [True, True, False]
    d = spark.createDataFrame([("```json\n[1]\n```",), ("[1]",)], "t string")
    assert [r[0] for r in d.select(X.without_fences(F.col("t"))).collect()] == ["[1]", "[1]"]
