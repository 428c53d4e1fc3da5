from counterpoise.catalogue import DEFAULT_CATALOGUE
from counterpoise.operators.hierarchy import keep_first_per_key
from counterpoise.plans import assembly, bias, prediction
from counterpoise.operators import enrich, models
from counterpoise.sources import readers as R, writers as W

import pytest
from pyspark.sql import functions as F


def test_csv_stack_keeps_file_order(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text(",k,v\n0,b,1\n1,a,2\n2,b,3\n")
    two.write_text(",k,v,w\n0,a,4,x\n1,c,NaN,y\n")
    df = R.read_tables(spark, [str(one), str(two)], "csv", drop_index=True)
    assert set(df.columns) == {"k", "v", "w", "row_order"}
    first = {r["k"]: r["v"] for r in keep_first_per_key(df, ["k"], ["row_order"]).collect()}
    assert first == {"b": "1", "a": "2", "c": "NaN"}
    assert [r["v"] for r in df.orderBy("row_order").collect()] == ["1", "2", "3", "4", "NaN"]


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "scores")
    df = spark.createDataFrame([("SVC", "precision", 0, 1, 0.5), ("X", "precision", 0, 1, 0.1)],
                               "model string, metric string, rep int, fold int, value double")
    W.write_table(df, path)
    assert [tuple(r) for r in R.read_fold_scores(spark, path, "SVC", "precision").collect()] == [
        (0, 1, 0.5)]
    W.write_catalogue(spark, str(tmp_path / "cat"))
    assert spark.read.parquet(str(tmp_path / "cat")).filter("variable_group = 'binary'").count() == 15
    with pytest.raises(KeyError):
        R.read_trait_table(spark, path, ["absent"])


def trait_rows(spark, n=120):
    """A small curated table in the published layout, and a checklist that adds to it."""
    cat, i = DEFAULT_CATALOGUE, F.col("id")
    family = F.element_at(F.array(*[F.lit(f) for f in ("Apocynaceae", "Rubiaceae", "Loganiaceae")]),
                          (i % 3 + 1).cast("int"))
    genus = F.concat(F.lit("G"), (i % 9).cast("string"))
    name = F.concat(genus, F.lit(" s"), i.cast("string"))
    base = spark.range(n).select(
        i, name.alias("Accepted_Name"), i.cast("string").alias("Accepted_ID"), family.alias("Family"),
        genus.alias("Genus"), F.lit("Species").alias("Accepted_Rank"),
        name.alias("Accepted_Species"), i.cast("string").alias("Accepted_Species_ID"))
    extra = {c: F.lit(None).cast("string") for c in cat.discarded if c != "History_Fever"}
    extra["History_Fever"] = F.when(i % 11 == 0, 1.0)
    extra["Antimalarial_Use"] = F.when(i % 4 == 0, 1.0)
    extra["Alkaloids"] = F.when(i % 3 == 0, (i % 2).cast("double"))
    extra["Tested_for_Alkaloids"] = F.when(i % 5 == 0, 1.0)
    extra[cat.target] = F.when(i % 5 < 2, ((i % 4 == 0) | (i % 7 == 0)).cast("double"))
    extra["Source"] = F.lit("curated")
    curated = base.filter(i < n - 20).withColumns(extra).drop("id")
    checklist = base.select(
        F.col("Accepted_ID").alias("kew_id"), F.col("Family").alias("family"),
        F.col("Genus").alias("genus"), F.concat(F.lit("s"), i.cast("string")).alias("species"),
        F.col("Accepted_Name").alias("taxon_name"), F.lit("Species").alias("rank"),
        F.lit(None).cast("string").alias("parent_name"),
        F.lit(None).cast("string").alias("parent_kew_id"))
    return base, curated, checklist


@pytest.fixture(scope="module")
def finished(spark):
    base, curated, checklist = trait_rows(spark)
    i = F.col("id")
    climate = base.filter(i % 10 != 3).select(
        "Accepted_Name", *[(F.sin(i * (k + 1.0)) * 5 + 5).alias(c)
                           for k, c in enumerate(DEFAULT_CATALOGUE.continuous)],
        F.concat(F.lit("k"), (i % 4).cast("string")).alias("kg_mode"))
    habits = base.filter(i % 6 != 5).select(
        "Accepted_Name", F.element_at(F.array(F.lit("shrub/tree"), F.lit("herb"), F.lit("?"),
                                              F.lit("liana")), (i % 4 + 1).cast("int")).alias("Habit"))
    ranges = base.filter(i % 8 != 0).select(
        "Accepted_Name", F.array(F.concat(F.lit("R"), (i % 5).cast("string")), F.lit("ALL"))
        .alias("native_tdwg3_codes"))

    def some(k):
        return base.filter(i % k == 0).select("Accepted_Name")
    rule = enrich.FlagRule
    rules = [rule("In_Malarial_Region", some(2), level="precise", create=True),
             rule("Common_Name", some(3), level="species", create=True),
             rule("Medicinal", some(4), level="species", create=True),
             rule("Wiki_Page", some(5), level="species", create=True),
             rule("Antimalarial_Use", some(8), level="species"),
             rule("Alkaloids", some(9), level="species"),
             rule("Poisonous", some(7), some(6), level="species", create=True),
             rule("Spines", some(40), some(13), level="genera", create=True),
             rule("Hairs", some(50), level="genera", create=True),
             enrich.ValueRule([*DEFAULT_CATALOGUE.continuous, "kg_mode"], climate, "precise"),
             enrich.ValueRule(["native_tdwg3_codes"], ranges, "precise"),
             enrich.ValueRule(["Habit"], habits)]
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assembled = assembly.assemble(curated, checklist, rules)
        return assembly.finalise(assembled)


def test_assembly(spark, finished, tmp_path):
    whole = finished.everything
    assert whole.count() == 120
    assert finished.labelled.count() + finished.unlabelled.count() == 120
    cat = DEFAULT_CATALOGUE
    assert whole.columns[:7] == cat.names and whole.columns[-1] == cat.target
    assert not {"Spines", "Hairs", "Source", "Habit", "History_Fever"} & set(whole.columns)
    row = whole.filter("Accepted_ID = '11'").first()
    assert row["Medicinal"] == 1.0            # by history of fever alone
    nulls = whole.select([F.count_if(F.col(c).isNull()).alias(c) for c in cat.zero_filled
                          if c in whole.columns]).first()
    assert sum(nulls) == 0
    assert whole.filter("Alkaloids is not null and Tested_for_Alkaloids = 0").count() == 0
    # genus G4 has spines by hit 40, so all its species have emergence but the one known to lack them
    assert [r["Accepted_ID"] for r in whole.filter("Genus = 'G4' and Emergence = 0").collect()] == ["13"]
    assert finished.changes.filter("before is not null").count() == 0
    assembly.write_finished(finished, str(tmp_path), ["Rubiaceae"])
    read = spark.read.option("header", True).csv(str(tmp_path / "all trait summary"))
    assert read.filter("feature = 'Medicinal'").first()["count"] == "120"
    assert spark.read.parquet(str(tmp_path / "labelled_traits")).count() == finished.labelled.count()


def test_bias_plan(finished, tmp_path):
    whole = finished.everything
    out = bias.quantify_bias(whole)
    assert out["comparison"].count() == 14 + 18 and out["corrected"].count() == 32
    weighted = bias.weight_by_selection(whole, neighbours=3)
    assert weighted.filter("weight < 1").count() == 0 and weighted.count() == 120
    reports = bias.corrected_reports(weighted, {"Ethno (G)": "Medicinal",
                                                "Ethno (M)": "Antimalarial_Use"})
    assert reports["prevalence"].count() == 4 and reports["precision"].count() == 3
    assert reports["cooccurrence"].count() == 10 * 9
    geo = bias.geography(whole)
    assert [r["Region"] for r in geo["counts"].collect()] == ["ALL", "R0", "R1", "R2", "R3", "R4"]
    specs = [models.logit([1.0], [None]), models.rule_model("Ethno (G)", ["Medicinal"])]
    labelled, unlabelled = weighted.filter("Activity_Antimalarial is not null"), weighted.filter(
        "Activity_Antimalarial is null")
    result = prediction.evaluate_models(labelled, unlabelled, specs, k=2, repeats=1,
                                        weight="weight", inner_folds=2)
    assert result["scores"].count() == 2 * 2 * 5
    new, old = models.score_population(labelled, unlabelled, prediction.settings_for(labelled),
                                       specs[0], "Accepted_Name", "weight", 2)
    assert new.count() + old.count() == 120
    report = prediction.surprises(new, weighted, result["scores"], "Logit").collect()
    assert [r["case"] for r in report] == ["unlabelled", "upperlim", "lowerlim", "labelled"]
