"""The package's functions for SQL, by name, in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.functions import urls as U

#: SQL functions of one string whose body is a native expression without lambdas (which have no SQL text), with their types.
NATIVE = {
    "page_path": (U.page_path, "string"),
    "normal_url": (U.normalized, "string"),
    "is_web_url": (U.is_web, "boolean"),
    "page_hash": (X.content_hash, "string"),
    "frontmatter_of": (X.frontmatter_of, "string"),
    "body_of": (X.body_of, "string"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` as ``foliant_*``; gives their names.

    Scalars of one string are SQL functions with native bodies, which Catalyst inlines. ``foliant_parse_page(html,
    url)`` gives the fields of a parsed page and ``foliant_page_links(html)`` its hrefs, both in Arrow batches.
    """
    from foliant.operators import dom
    from foliant.plans.pages import PARSED, parse_page

    names = []
    for name, (make, kind) in NATIVE.items():
        body = spark.createDataFrame([], "x string").select(make(F.col("x")).alias("y"))
        sql = body._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION foliant_{name}(x STRING) RETURNS {kind} RETURN {sql}")
        names.append(f"foliant_{name}")

    @F.pandas_udf(PARSED)
    def parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(h, u) for h, u in zip(html, url, strict=True)], columns=PARSED.names)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def links(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else dom.hrefs(dom.parse(h)))

    spark.udf.register("foliant_parse_page", parse)
    spark.udf.register("foliant_page_links", links)
    return [*names, "foliant_parse_page", "foliant_page_links"]
