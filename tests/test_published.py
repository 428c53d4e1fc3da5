"""Published results, recomputed from published counts and statistics."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from counterpoise.functions import special as S
from counterpoise.operators import summary as M, tests2s as T
from counterpoise.operators.bootstrap import bootstrap_mean_ci

# Fixed values, as published: feature, labelled 1 / 0, all 1 / 0, chi-square, its p, odds ratio,
# Fisher p.
BINARY = [
    ("In_Malarial_Region", 278, 4, 18836, 2275, 24.629429554982867, 6.948247431125128e-07,
     8.394165427904014, 1.3015969006928055e-09),
    ("Common_Name", 134, 148, 1209, 19902, 818.9537578586709, 4.085382183793043e-180,
     14.904365904365903, 5.94808976779498e-85),
    ("Poisonous", 125, 157, 639, 20472, 1366.3380118314433, 4.3382466113496143e-299,
     25.507610418348733, 2.008354112579465e-105),
    ("Medicinal", 217, 65, 2109, 19002, 1280.673827413383, 1.7909941118730165e-280,
     30.079395995185468, 5.790448039275686e-152),
    ("Wiki_Page", 164, 118, 3071, 18040, 408.93632832753246, 6.24685174575274e-91,
     8.164292534314997, 7.280131143016449e-63),
    ("Antimalarial_Use", 135, 147, 281, 20830, 3136.966393586545, 0.0, 68.07683927663592,
     1.3162835711020416e-159),
    ("Emergence", 187, 95, 10859, 10252, 24.0621360393152, 9.327651411626096e-07,
     1.8583895967933464, 5.600460542074641e-07),
    ("Tested_for_Alkaloids", 195, 87, 980, 20131, 2218.410636793162, 0.0, 46.04204785362421,
     6.769042712559369e-181),
    ("herb", 3, 279, 1901, 19111, 20.81276442345852, 5.064430264211002e-06, 0.1080981713076875,
     2.1296153792299568e-08),
    ("liana", 73, 209, 5639, 15373, 0.0842338134395057, 0.7716398116211513, 0.952210808017642,
     0.7866894231779467),
    ("succulent", 6, 276, 458, 20554, 0.0, 1.0, 0.9756028099487374, 1.0),
    ("shrub", 124, 158, 11609, 9403, 13.8533858972132, 0.0001976403058699, 0.6356765974892897,
     0.0001782195174346),
    ("subshrub", 61, 221, 9642, 11370, 65.03659954005673, 7.351981478514593e-16,
     0.3254849400389135, 4.2941839444107306e-17),
    ("tree", 157, 125, 8320, 12692, 29.35021055561121, 6.040995255978554e-08, 1.9160038461538464,
     7.791417346132846e-08),
]
# Feature, sizes, KS distance, its p, Mann-Whitney U, its p.
CONTINUOUS = [
    ("bio1", 277, 14634, 0.24230896941941743, 1.52396288438924e-14, 2605619.5,
     3.484558430549096e-16),
    ("bio4", 277, 14634, 0.12032288192918028, 0.0006876284669648852, 1944755.0,
     0.24763697952898356),
    ("slope", 277, 14634, 0.2779396085176255, 4.532978406765156e-19, 1459483.5,
     1.3123460001603875e-15),
    ("soil_nitrogen", 277, 14584, 0.20946722683084767, 6.006813380186624e-11, 1549465.0,
     2.919801163844935e-11),
    ("soil_ph", 277, 14579, 0.09912853733784044, 0.008861346366197734, 2151345.0,
     0.061629257509699206),
    ("latitude", 277, 14634, 0.12369937177109441, 0.00043707932896087237, 2146356.0,
     0.0921097014741464),
    ("longitude", 277, 14634, 0.1334918583842879, 0.00010932450781645593, 1930304.5,
     0.1739214163307793),
]
# Feature, p, corrected p, for all 32 tests.
HOLM = [
    ("Tested_for_Alkaloids", 0.0, 0.0), ("Antimalarial_Use", 0.0, 0.0),
    ("Poisonous", 4.3382466113496143e-299, 1.3014739834048842e-297),
    ("Medicinal", 1.7909941118730165e-280, 5.1938829244317475e-279),
    ("Common_Name", 4.085382183793043e-180, 1.1439070114620522e-178),
    ("Wiki_Page", 6.24685174575274e-91, 1.68664997135324e-89),
    ("slope", 4.532978406765156e-19, 1.1785743857589406e-17),
    ("soil_depth", 1.5824711120388994e-17, 3.9561777800972485e-16),
    ("subshrub", 7.351981478514593e-16, 1.7644755548435018e-14),
    ("bio1", 1.52396288438924e-14, 3.5051146340952524e-13),
    ("bio10", 2.7098201563088288e-14, 5.961604343879425e-13),
    ("soil_ocs", 2.219054725116064e-12, 4.6600149227437343e-11),
    ("soil_nitrogen", 6.006813380186624e-11, 1.201362676037325e-09),
    ("bio11", 1.7516682336665252e-10, 3.3281696439663974e-09),
    ("bio15", 2.488265074866441e-10, 4.478877134759594e-09),
    ("bio17", 1.8994127346243357e-08, 3.2290016488613704e-07),
    ("brkl_elevation", 2.756235756993697e-08, 4.4099772111899154e-07),
    ("soil_water_cap", 3.1015915185202034e-08, 4.652387277780305e-07),
    ("elevation", 5.858297797106141e-08, 8.201616915948598e-07),
    ("tree", 6.040995255978554e-08, 7.853293832772119e-07),
    ("In_Malarial_Region", 6.948247431125128e-07, 8.337896917350154e-06),
    ("Emergence", 9.327651411626096e-07, 1.0260416552788704e-05),
    ("herb", 5.064430264211002e-06, 5.064430264211002e-05),
    ("bio12", 1.049682902274424e-05, 9.447146120469815e-05),
    ("bio16", 1.3108987891304936e-05, 0.0001048719031304),
    ("longitude", 0.0001093245078164, 0.0007652715547151),
    ("shrub", 0.0001976403058699, 0.0011858418352199),
    ("latitude", 0.0004370793289608, 0.0021853966448043),
    ("bio4", 0.0006876284669648, 0.0027505138678595),
    ("soil_ph", 0.0088613463661977, 0.0265840390985932),
    ("liana", 0.7716398116211513, 1.5432796232423025), ("succulent", 1.0, 1.0),
]
# Precision of the chosen model in each of 100 folds.
PRECISION = [
    0.9123673648296348, 0.7533578659913673, 0.6266153414936675, 0.8010933255585755,
    0.4406213864348159, 0.5072029279949153, 0.8914373572772895, 0.8364188647767324,
    0.610231232766761, 0.7011653570096823, 0.422422010447747, 0.2424840422419038,
    0.9643980619742709, 0.8865276556698256, 0.9509305291121105, 0.1478440067740509,
    0.4472721500951132, 0.9574696333045531, 0.0717851762057551, 0.84161468498662,
    0.9724620413690176, 0.5269816980808125, 0.1342753316794352, 0.6188626897639106,
    0.8913866139700544, 0.3762527376814154, 0.7040743999399603, 0.2634731344100184,
    0.9727864701665656, 0.9428153697623821, 0.7250952008044383, 0.9683914044168387,
    0.6198224828913558, 0.818407942539513, 0.9389077512054996, 0.9385534641941172,
    0.3010686009256721, 0.4327844962779341, 0.6690392378816437, 0.8036366380766977,
    0.6932996006141832, 0.4728600309586585, 0.9785966863248416, 0.082089495191402,
    0.9301112625721368, 0.8234979686708002, 0.9434434483966477, 0.8455030207575536,
    0.3210833071946893, 0.40334821281297406, 0.8027716629303612, 0.6273273873487373,
    0.7557139323785454, 0.669076418278477, 0.8963492321536698, 0.969331381322958,
    0.1637142316221611, 0.935947359035092, 0.890435179116273, 0.3365883579251482,
    0.908598102612303, 0.8569818437968711, 0.7011682408227186, 0.5102164977397161,
    0.2741951273964154, 0.9412833143872048, 0.6801293346926213, 0.7402126754943643,
    0.4189031290376962, 0.339131879386897, 0.888059693733491, 0.5791382143967692,
    0.4675519388325749, 0.9797305897668728, 0.8973674658970605, 0.187022051071162,
    0.8831471680061911, 0.3894824658234622, 0.7066388153350904, 0.9191130406755984,
    0.7965145691507315, 0.9984209668604432, 0.506106430537647, 0.7907837219225952,
    0.8570551564120072, 0.7225595964633644, 0.9524941275855491, 0.7537178446446852,
    0.733400797343654, 0.0542809301403885, 0.5575670777814313, 0.6911973057908791,
    0.5890233938386406, 0.0842416748046094, 0.6406910531746252, 0.1856221402407013,
    0.9446846139837096, 0.9924167963082351, 0.9472600284431376, 0.806475378219129,
]


def test_binary_tests(spark):
    rows = [(b[0], *map(int, b[1:5])) for b in BINARY]
    table = spark.createDataFrame(rows, "feature string, pos1 long, neg1 long, pos2 long, neg2 long")
    got = {r["feature"]: r for r in T.fisher_exact(T.chi2_2x2(table)).collect()}
    for name, *_, stat, p, odds, fisher in BINARY:
        r = got[name]
        assert r["chi2_stat"] == pytest.approx(stat, rel=1e-12, abs=1e-12)
        assert r["fisher_odds_ratio"] == pytest.approx(odds, rel=1e-12)
        assert r["fisher_p"] == pytest.approx(fisher, rel=1e-9)
        if p > 1e-290:
            assert r["chi2_p"] == pytest.approx(p, rel=1e-11)


@pytest.mark.parametrize("row", CONTINUOUS, ids=lambda r: r[0])
def test_continuous_p_values(row):
    _, n1, n2, d, ks, u, mwu = row
    assert S.ks_two_sample_p(d, n1, n2) == pytest.approx(ks, rel=1e-11)
    # the published rows have ties whose counts are not published
    assert S.mann_whitney_p(u, n1, n2, 0.0) == pytest.approx(mwu, rel=1e-3)


def test_holm_is_neither_monotone_nor_capped(spark):
    df = spark.createDataFrame([h[:2] for h in HOLM], "feature string, p_value double")
    got = {r["feature"]: r["corrected_p_value"] for r in T.holm(df).collect()}
    for name, _, corrected in HOLM:
        assert got[name] == pytest.approx(corrected, rel=1e-10)
    assert got["liana"] > 1


def test_describe_of_fold_scores(spark):
    df = spark.createDataFrame([("SVC", "precision", v) for v in PRECISION],
                               "model string, metric string, value double")
    r = M.fold_score_summary(df).first()
    assert r["count"] == 100
    # Published mean, sd, quartiles and maximum.
    for name, value in (("mean", 0.6704601004913923), ("std", 0.2677340935687059),
                        ("min", 0.0542809301403885), ("q25", 0.4715330079271376),
                        ("q50", 0.7292479990740461), ("q75", 0.8966037905895173),
                        ("max", 0.9984209668604432)):
        assert r[name] == pytest.approx(value, rel=1e-12)


def test_bootstrap_interval_near_published(spark):
    df = spark.createDataFrame([(v,) for v in PRECISION], "value double")
    r = bootstrap_mean_ci(df, "value").first()
    # Published limits, from an unseeded bootstrap.
    assert r["low"] == pytest.approx(1300.5454843267519 / 2117, abs=0.006)
    assert r["high"] == pytest.approx(1522.8002639640588 / 2117, abs=0.006)


def test_estimated_positives():
    assert 0.3636654974935111 * 21111 == pytest.approx(7677.342317585513, rel=1e-12)


def test_ks_methods_agree_where_they_meet():
    for z in (0.6, 0.9, 1.2, 1.45):
        d = z / math.sqrt(2000)
        assert 1 - S._ks_cdf_matrix(2000, d) == pytest.approx(1 - S._ks_cdf_series(2000, d), abs=2e-7)
    assert 1 - S._ks_cdf_matrix(500, 0.09) == pytest.approx(2 * S._smirnov_tail(500, 0.09), rel=1e-6)


def test_exact_small_sample_p_values():
    # all 35 arrangements of 3 and 4 rows, by enumeration
    import itertools
    m, n, d = 3, 4, 0.5
    bad = 0
    for pick in itertools.combinations(range(m + n), m):
        a = b = 0
        worst = 0.0
        for i in range(m + n):
            a, b = (a + 1, b) if i in pick else (a, b + 1)
            worst = max(worst, abs(a / m - b / n))
        bad += worst >= d - 1e-12
    assert S.ks_two_sample_p(d, m, n) == pytest.approx(bad / math.comb(7, 3))
    us = [sum(1 for x in pick for y in range(7) if y not in pick and y < x)
          for pick in itertools.combinations(range(7), 3)]
    for u in range(13):
        top = max(u, 12 - u)
        expect = min(1.0, 2 * sum(x >= top for x in us) / len(us))
        assert S.mann_whitney_p(u, 3, 4, 0.0) == pytest.approx(expect)


def test_fisher_on_huge_counts_is_finite():
    n = 10 ** 10
    assert S.fisher_two_sided(n // 2, n // 2, n // 2, n // 2) == pytest.approx(1.0, abs=1e-6)
    assert S.fisher_two_sided(n // 2 + 10 ** 8, n // 2 - 10 ** 8, n // 2, n // 2) == 0.0


def test_chi2_null_when_an_expected_count_is_zero(spark):
    table = spark.createDataFrame([("f", 0, 5, 0, 7)],
                                  "feature string, pos1 long, neg1 long, pos2 long, neg2 long")
    r = T.fisher_exact(T.chi2_2x2(table)).select(F.col("chi2_stat"), "chi2_p", "fisher_odds_ratio",
                                                 "fisher_p").first()
    assert r["chi2_stat"] is None and r["chi2_p"] is None and r["fisher_odds_ratio"] is None
    assert r["fisher_p"] == 1.0


def test_mann_whitney_is_exact_at_every_size():
    near = [S.mann_whitney_p(900, 8, n, 0.0) for n in (2500, 2501)]
    assert near[0] == pytest.approx(near[1], rel=0.02)
    assert S.mann_whitney_p(2e9, 8, 10 ** 9, 0.0) == pytest.approx(
        S.mann_whitney_p(2e9, 8, 10 ** 9, 0.0, "asymptotic"), rel=0.2)
    ways = {}
    for picks in itertools.combinations(range(11), 4):
        u = sum(picks) - 6
        ways[u] = ways.get(u, 0) + 1
    for u in range(29):
        tail = sum(v for k, v in ways.items() if k >= max(u, 28 - u)) / sum(ways.values())
        assert S.mann_whitney_p(u, 4, 7, 0.0) == pytest.approx(min(1.0, 2 * tail), abs=1e-12)
    with pytest.raises(ValueError):
        S.mann_whitney_p(1, 2, 3, 0.0, "other")
