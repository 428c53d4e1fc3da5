"""Small tables for the semantics that are easy to get wrong."""

import warnings

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from counterpoise.catalogue import DEFAULT_CATALOGUE, Catalogue
from counterpoise.functions import scalars as S
from counterpoise.operators import cleaning as C, enrich as E, hierarchy as H, quality as Q, \
    summary as M
from counterpoise.operators.regions import multilabel_onehot

CAT = Catalogue(genus_level=["Spines"], flags=["seen"], habits=[], compounds=[], continuous=["v"],
                text=["Genus"], target="y")
NAN = float("nan")


def taxa(spark):
    return spark.createDataFrame([
        ("a b", "a b", "a"), ("a b x", "a b", "a"), ("a c", "a c", "a"), ("d e", "d e", "d"),
        ("f g", "f g", None), ("n", None, None)],
        "Accepted_Name string, Accepted_Species string, Genus string")


def by_name(df, column):
    return {r["Accepted_Name"]: r[column] for r in df.collect()}


def names(spark, *values, species=None):
    rows = [(v,) for v in values]
    df = spark.createDataFrame(rows, "Accepted_Name string")
    return df if species is None else df.withColumn("Accepted_Species", F.lit(species))


def test_row_max_skips_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, NAN), (None, 0.0), (None, NAN)], "a double, b double")
    assert [r[0] for r in df.select(S.row_max("a", "b")).collect()] == [1.0, 0.0, None]


def test_nan_becomes_null_and_bad_text_is_not_an_error(spark):
    df = spark.createDataFrame([("1", NAN), ("x", 2.0)], "seen string, v double")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = C.reset_dtypes(df, CAT).collect()
    assert any("Genus" in str(w.message) for w in seen)
    assert [tuple(r) for r in out] == [(1.0, None), (None, 2.0)]


def test_missing_taxa_counts_null_as_present_only_if_the_table_has_one(spark):
    checklist = spark.createDataFrame([("1",), ("2",), (None,)], "kew_id string")
    with_null = spark.createDataFrame([("1",), (None,)], "Accepted_ID string")
    without = spark.createDataFrame([("1",)], "Accepted_ID string")
    assert [r[0] for r in E.missing_taxa(with_null, checklist).collect()] == ["2"]
    assert {r[0] for r in E.missing_taxa(without, checklist).collect()} == {"2", None}


def test_appended_taxa_take_the_layout_of_the_table(spark):
    table = spark.createDataFrame(
        [("a b", "1", "F", "a", "Species", "a b", "1", 3.0)],
        "Accepted_Name string, Accepted_ID string, Family string, Genus string, "
        "Accepted_Rank string, Accepted_Species string, Accepted_Species_ID string, v double")
    schema = ("kew_id string, family string, genus string, species string, taxon_name string, "
              "rank string, parent_name string, parent_kew_id string")
    checklist = spark.createDataFrame([
        ("1", "F", "a", "b", "a b", "Species", "a", "g"),
        ("2", "F", "a", "c", "a c", "Species", "a", "g"),
        ("3", "F", "a", "c", "a c var. d", "Variety", "a c", "2")], schema)
    out = E.append_missing_taxa(table, checklist)
    assert out.columns == table.columns
    got = {r["Accepted_ID"]: (r["Accepted_Species"], r["Accepted_Species_ID"], r["v"])
           for r in out.collect()}
    assert got == {"1": ("a b", "1", 3.0), "2": ("a c", "2", None), "3": ("a c", "2", None)}
    orphan = spark.createDataFrame([("4", "F", "a", "z", "a z var. q", "Variety", "other", "9")],
                                   schema)
    with pytest.raises(PySparkException):
        E.append_missing_taxa(table, orphan).collect()


def test_target_does_not_spread_among_rows_without_species(spark):
    df = spark.createDataFrame([
        ("1", "s", "Species", None), ("2", "s", "Variety", 1.0), ("3", None, "Species", 1.0),
        ("4", None, "Species", None), ("5", "t", "Species", 0.0)],
        "Accepted_Name string, Accepted_Species string, Accepted_Rank string, y double")
    assert by_name(H.resolve_to_species(df, CAT), "y") == {"1": 1.0, "3": 1.0, "4": None, "5": 0.0}


def test_fill_from_genus(spark):
    df = spark.createDataFrame([
        ("1", "g", 1.0), ("2", "g", 0.0), ("3", "g", None), ("4", "h", 0.0), ("5", "h", None),
        ("6", "k", 2.0), ("7", "k", None), ("8", None, 1.0), ("9", None, None)],
        "Accepted_Name string, Genus string, Spines double")
    out = H.fill_from_genus(df, CAT, keep_before=True)
    assert by_name(out, "Spines") == {"1": 1.0, "2": 0.0, "3": 1.0, "4": 0.0, "5": 0.0, "6": 2.0,
                                      "7": None, "8": 1.0, "9": None}
    changed = H.change_report(out, ["Spines"], ["Accepted_Name"]).collect()
    assert {(r[0], r[2], r[3]) for r in changed} == {("3", None, 1.0), ("5", None, 0.0)}


def test_flag_levels(spark):
    hits = names(spark, "a b", None)
    df = taxa(spark)
    assert by_name(E.flag_hits(df, "seen", hits, "precise", cat=CAT), "seen") == {
        "a b": 1.0, "a b x": None, "a c": None, "d e": None, "f g": None, "n": None}
    assert by_name(E.flag_hits(df, "seen", hits, "species", cat=CAT), "seen")["a b x"] == 1.0
    genus = by_name(E.flag_hits(df, "Spines", hits, "genera", cat=CAT), "Spines")
    assert genus["a c"] == 1.0 and genus["d e"] is None and genus["f g"] is None
    by_species = names(spark, "zz", species="d e")
    assert by_name(E.flag_hits(df, "seen", by_species, "species", cat=CAT), "seen")["d e"] == 1.0


def test_precise_absence_beats_species_hit(spark):
    df, hits, absences = taxa(spark), names(spark, "a b"), names(spark, "a b x", "a b")
    first = by_name(E.flag_hits_absences(df, "seen", hits, absences, "species", 1, CAT), "seen")
    assert (first["a b"], first["a b x"]) == (1.0, 0.0)
    second = by_name(E.flag_hits_absences(df, "seen", hits, absences, "species", 0, CAT), "seen")
    assert (second["a b"], second["a b x"]) == (0.0, 0.0)


def test_several_rules_in_one_call(spark):
    df = taxa(spark).withColumn("Spines", F.when(F.col("Accepted_Name") == "d e", 7.0))
    data = spark.createDataFrame([("a b", 5.0), ("q r", 9.0)], "Accepted_Name string, v double")
    out = E.enrich(df, [E.FlagRule("seen", names(spark, "d e"), level="precise", create=True),
                        E.FlagRule("Spines", names(spark, "a b", "d e")),
                        E.ValueRule(["v"], data)], CAT)
    got = {r["Accepted_Name"]: (r["seen"], r["Spines"], r["v"]) for r in out.collect()}
    assert got["a b"] == (None, 1.0, 5.0)
    assert got["a b x"] == (None, 1.0, 5.0)
    assert got["a c"] == (None, 1.0, None)
    assert got["d e"] == (1.0, 7.0, None)


def test_rule_errors(spark):
    df, hits = taxa(spark).withColumn("seen", F.lit(None).cast("double")), names(spark, "a b")
    with pytest.raises(ValueError):
        E.flag_hits(df, "seen", hits, "species", cat=CAT)          # exists already
    with pytest.raises(ValueError):
        E.flag_hits(df, "new", hits, None, cat=CAT)                # no level
    with pytest.raises(ValueError):
        E.update_hits(df, "seen", hits, level="genera", cat=CAT)   # not a genus variable
    with pytest.raises(ValueError):
        E.flag_hits_absences(df, "x", hits, hits, "species", 2, CAT)


def test_lookup_takes_the_first_known_value_per_variable(spark):
    df = taxa(spark)
    data = spark.createDataFrame([
        (1, "a k", "a b", "a", None, 1.0), (2, "a m", "a b", "a", 2.0, 2.0),
        (3, "a o", "q", "a", 3.0, 3.0), (4, "a b", "a b", "a", None, 9.0)],
        "row int, Accepted_Name string, Accepted_Species string, Genus string, v double, w double")
    got = {r["Accepted_Name"]: (r["v"], r["w"]) for r in
           E.lookup_values(df, ["v", "w"], data, "genera", order="row", cat=CAT).collect()}
    assert got["a b"] == (2.0, 9.0)        # v falls back to the species' first known value
    assert got["a b x"] == (2.0, 9.0)      # the species' own name goes before its other rows
    assert got["a c"] == (2.0, 1.0)        # genus: first known per variable
    assert got["f g"] == (None, None)


def test_genus_from_the_name_when_there_is_no_genus_column(spark):
    data = spark.createDataFrame([("d q", 4.0)], "Accepted_Name string, v double")
    got = by_name(E.lookup_values(taxa(spark), ["v"], data, "genera", cat=CAT), "v")
    assert got["d e"] == 4.0 and got["a b"] is None


def test_duplicate_names(spark):
    good = spark.createDataFrame([("a", "a", 1), ("a", "z", 2), ("b", "y", 3)],
                                 "Accepted_Name string, o string, v int")
    assert by_name(E.resolve_duplicate_keys(good, CAT, "o"), "v") == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        E.resolve_duplicate_keys(good, CAT, None)
    bad = spark.createDataFrame([("a", "x", 1), ("a", "z", 2)],
                                "Accepted_Name string, o string, v int")
    with pytest.raises(ValueError):
        E.resolve_duplicate_keys(bad, CAT, "o")
    nulls = spark.createDataFrame([(None, "x", 1), (None, "z", 2)],
                                  "Accepted_Name string, o string, v int")
    with pytest.raises(ValueError):
        E.resolve_duplicate_keys(nulls, CAT, "o")


def test_onehot_of_habits(spark):
    df = spark.createDataFrame([(1, "shrub/tree"), (2, "?"), (3, None), (4, "herb"), (5, "fern")],
                               "id int, Habit string")
    out = {r["id"]: r.asDict() for r in
           multilabel_onehot(df, "Habit", DEFAULT_CATALOGUE.habits).collect()}
    assert "Habit" not in out[1] and out[1]["shrub"] == out[1]["tree"] == 1.0
    assert out[1]["herb"] == 0.0 and out[2]["herb"] is None and out[3]["tree"] is None
    assert out[2]["fern"] == 0.0 and out[5]["fern"] == 1.0 and out[5]["subshrub"] == 0.0


def test_text_functions(spark):
    df = spark.createDataFrame([(" Yes", "['REU', 'MAU']", "Danais spp."), ("NO ", "0", "x"),
                                ("Not Detected", None, None)], "a string, b string, c string")
    rows = df.select(S.yes_no_flag("a"), S.parse_list("b"), S.genus_of_name("c")).collect()
    assert [tuple(r) for r in rows] == [(1.0, ["REU", "MAU"], "Danais"), (0.0, None, "x"),
                                        (None, None, None)]
    ints = df.limit(1).select(S.parse_list(F.lit("[1, 2]"), "int")).first()[0]
    assert ints == [1, 2]


def test_round_matches_python_on_ratios(spark):
    pairs = [(a, b) for b in list(range(1, 60)) + [200, 400, 1000] for a in range(b + 1)]
    df = spark.createDataFrame(pairs, "a int, b int")
    rows = df.select("a", "b", S.round_half_even_2(F.col("a") / F.col("b")).alias("r")).collect()
    assert all(r["r"] == round(r["a"] / r["b"], 2) for r in rows)


def test_cooccurrence_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (1.0, 0.0, 1.0), (0.0, 0.0, 0.0)],
                               "a double, b double, c double")
    got = {(r["var1"], r["var2"]): r["value"] for r in
           M.conditional_cooccurrence(df, ["a", "b", "c"]).collect()}
    assert got["a", "a"] is None and got["b", "b"] == 0.0     # b never occurs
    assert got["b", "a"] == 0.0 and got["a", "c"] == 1.0 and got["All Species", "c"] == 0.5
    assert len(got) == 12


def test_zero_fill_keeps_text_null(spark):
    df = spark.createDataFrame([("x", None, None, None)],
                               "Accepted_Name string, seen double, Genus string, v double")
    assert tuple(C.zero_fill(df, CAT).first()) == ("x", 0.0, None, None)


def test_layout_and_missing_columns(spark):
    with pytest.raises(KeyError):
        C.drop_columns(taxa(spark), ["nope"])
    with pytest.raises(ValueError):
        C.require_no_nulls(taxa(spark), ["Genus"])
    x = spark.createDataFrame([(1, None), (2, 3)], "a int, y int")
    with pytest.raises(KeyError):
        C.select_features(x, ["a"], "y", drop_null_columns=True)


def test_catalogue_roles():
    c = DEFAULT_CATALOGUE
    assert len(c.binary) == 15 and len(c.continuous) == 18
    assert "Alkaloids" not in c.bias_features and "kg_mode" in c.bias_features
    assert not {"In_Malarial_Region", "Tested_for_Alkaloids"} & set(c.prediction_features)
    assert "Medicinal" in c.zero_filled and "herb" not in c.zero_filled


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", "x"), (4, "a", "y")],
                               "id int, a string, b string")
    assert {r["id"] for r in H.duplicated_rows(df, ["a", "b"]).collect()} == {1, 2}
    assert {r["id"] for r in H.later_duplicates(df, ["a", "b"], "id").collect()} == {2}
    sizes = {r["id"]: r["size"] for r in H.attach_group_size(df, ["a"]).collect()}
    assert sizes == {1: 2, 2: 2, 3: 2, 4: 2}
    with pytest.raises(ValueError):
        H.require_no_twins(df, ["a", "b"])
    H.require_no_twins(df, ["id"])


def test_quality_checks(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", None), ("h", None), ("h", None), ("k", 1.0)],
                               "Genus string, v double")
    assert [tuple(r) for r in Q.varying_groups(df, "Genus", ["v"]).collect()] == [("g", "v")]
    lists = spark.createDataFrame([(1, [1, 2]), (3, [1]), (None, None), (None, [1])],
                                  "v int, all array<int>")
    assert Q.not_in_own_list(lists, "v", "all").count() == 2
    assert Q.domain_violations(df, "Genus", ["g", "h"]).collect()[0]["n"] == 1
    assert Q.bounds_report(df, {"v": (0, 2)}).first()["ok"] == 1
    assert Q.duplicate_keys(df, ["Genus"]).count() == 2


def test_more_flag_rules_than_one_mask_holds(spark):
    df = spark.createDataFrame([("a b",), ("c d",), (None,)], f"{CAT.name} string")
    df = df.withColumns({CAT.species: F.col(CAT.name), CAT.genus: F.lit("g")})
    sets = [spark.createDataFrame([(n,)], f"{CAT.name} string") for n in ("a b", "c d")]
    rules = [E.FlagRule(f"f{i}", sets[i % 2], sets[1 - i % 2], level="precise", create=True) for i in range(40)]
    got = {r[CAT.name]: [r[f"f{i}"] for i in range(40)] for r in E.enrich(df, rules, CAT).collect()}
    assert got["a b"] == [1.0, 0.0] * 20
    assert got["c d"] == [0.0, 1.0] * 20
    assert got[None] == [None] * 40
