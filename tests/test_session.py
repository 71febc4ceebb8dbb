"""What a cut of the lineage keeps and what it reads again."""

from pyspark.sql import functions as F

from leafmart import session


def test_cut_keeps_all_rows_as_columns(spark):
    df = spark.range(4_000).select("id", F.concat(F.lit("name "), (F.col("id") % 50).cast("string")).alias("name"),
                                   F.when(F.col("id") % 3 == 0, F.array("id")).alias("list"), F.lit(None).cast("boolean").alias("open"))
    cut = session.cut_lineage(df.repartition(3, "name"))
    assert cut.schema.simpleString() == df.schema.simpleString()
    assert cut.exceptAll(df).isEmpty() and df.exceptAll(cut).isEmpty()
    assert "ReadSchema: struct<name:string>" in cut.select("name")._jdf.queryExecution().toString()  # not the whole rows
    assert spark.conf.get(session.DROP_SHUFFLES) == "false"


def test_queries_run_with_methods_that_are_compiled(spark):
    from leafmart import registry

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    registry.queries()["chain_of"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_a_number_is_searched_once(spark):
    from leafmart.functions.text import number

    df = spark.createDataFrame([("THC: 12.5%",), ("none",), ("",), (None,)], "t string").select(number(F.col("t"), r"thc:\s*([\d.]+)").alias("n"))
    assert [r["n"] for r in df.collect()] == [12.5, None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract") <= 1
