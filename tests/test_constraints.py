"""The suite of checks against the single checks."""

from pyspark.sql import functions as F

from counterpoise.operators import constraints as C, quality as Q


def rules_of(source):
    return [C.implies("implies", F.col("a") > 0, F.col("b") > 0), C.not_null("null", "a"), C.integral("whole", "a"),
            C.within("range", "a", -1, 2), C.in_domain("domain", "g", ["u", "v"]), C.not_empty("empty", ["a", "b"]),
            C.in_own_list("list", "g", "gs"), C.one_part("part", [F.col("a") > 0, F.col("a") <= 0]),
            C.Unique("unique", ("g", "b")), C.Constant("constant", ("g",), "a"), C.Constant("other", ("g",), "b"),
            C.Constant("pairs", ("g", "b"), "a"), C.SameSet("set", "g", "b", source, "k")]


def singles(df, source):
    return {
        "implies": Q.implication_violations(df, F.col("a") > 0, F.col("b") > 0).count(),
        "null": Q.null_report(df, ["a"]).first()["n_null"], "whole": Q.non_integral_cells(df, ["a"], ["g"]).count(),
        "range": df.where("a < -1 or a > 2").count(), "domain": Q.domain_violations(df, "g", ["u", "v"]).agg(F.sum("n")).first()[0] or 0,
        "empty": Q.empty_rows(df, ["a", "b"]).count(), "list": Q.not_in_own_list(df, "g", "gs").count(),
        "part": df.where("a is null").count(), "unique": Q.duplicate_keys(df, ["g", "b"]).count(),
        "constant": Q.varying_groups(df, "g", ["a"]).count(), "other": Q.varying_groups(df, "g", ["b"]).count(),
        "pairs": Q.varying_groups(df.where("b is not null").withColumn("gb", F.concat_ws(",", "g", "b")).where("g is not null"),
                                  "gb", ["a"]).count(),
        "set": Q.known_set_differences(df.where("g is not null"), "g", "b", source, "k").count()}


def tables(spark):
    rows = [("u", 1.0, 1, ["u"]), ("u", 1.0, 1, ["v"]), ("u", 2.5, 0, None), ("v", 0.0, 0, ["v"]), ("v", -0.0, 0, ["v"]),
            ("w", None, 1, ["w"]), ("w", None, 1, []), (None, 3.0, 1, None), (None, None, None, ["u"]), ("x", None, None, ["x"]),
            ("x", 7.0, None, ["x"])]
    return (spark.createDataFrame(rows, "g string, a double, b int, gs array<string>"),
            spark.createDataFrame([("u",), ("u",), ("z",), (None,)], "k string"))


def test_suite_is_the_single_checks(spark):
    df, source = tables(spark)
    for part in (df, df.limit(0), df.repartition(5)):
        found = {r["rule"]: r["violations"] for r in C.check_all(part, rules_of(source)).collect()}
        assert found == singles(part, source)


def test_one_scan_and_one_shuffle(spark, tmp_path):
    df, source = tables(spark)
    df.write.parquet(str(tmp_path / "t"))
    rules = [r for r in rules_of(source) if not isinstance(r, C.SameSet)]
    plan = C.check_all(spark.read.parquet(str(tmp_path / "t")), rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_broken_rows_and_keys(spark):
    df, source = tables(spark)
    rows = C.broken_rows(df, rules_of(source)).where("g = 'u' and a = 2.5").collect()
    assert [sorted(r["broken"]) for r in rows] == [["implies", "list", "range", "whole"]]
    keys = {(r["rule"], r["key"]) for r in C.broken_keys(df, rules_of(source)).collect()}
    assert ("set", "z") in keys and ("set", "w") in keys and ("set", "u") not in keys
    assert ("constant", '{"k0":"u"}') in keys and ("constant", '{"k0":"v"}') not in keys


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, "x", 2)], "key int, part int, f0 string, n int")
    found = C.check_all(df, [C.not_null("a", "n"), C.Unique("b", ("key", "part")), C.Constant("c", ("key",), "f0")]).collect()
    assert {(r["rule"], r["violations"]) for r in found} == {("a", 0), ("b", 0), ("c", 0)}
