import random

import pytest
from helpers import bag, table
from pyspark.sql import functions as F

from panelwise.plans import prep, reports
from panelwise.sources.tables import read_tables
from panelwise.plans import study as study_module
from panelwise.plans import values as v

STI = {
    "F20_{}_q02EstDispostGonorrhee": None, "F20_{}_q03ResultatstGonorrhee": None, "F20_{}_q05ResultatstChlamydia": None,
    "F20_{}_q06atestSyphilisRPR": None, "F20_{}_q06aResultatRPR": None, "F20_{}_q07bResultatTPHA": None,
}
ASK = ["q03NbreClieDernSemaine", "q04UtiliseUnPresevatif", "q05FreqUtilPreservatif", "q08ConfiancePreserv",
       "q11PartenaireSexPrinc", "q13NbrePartMoisDernier", "q14PreservaPartenaires", "q15FreqUtilervatifPart",
       "q18ConfianceservParten"]


def columns():
    cols = [v.ID, v.AGE, v.ETHNIC, v.ETHNIC_OTHER, v.NATIONALITY, v.NATIONALITY_OTHER, v.MARITAL, v.SCHOOLING,
            v.REGISTERED, v.ENROLMENT_DATE]
    cols += [f"F01_{t}_h00VisitDate" for t in ("scr", "m1", "m12")] + ["F21_m12_h00VisitDate"]
    for t in ("j0", "m1", "m3"):
        cols += [f"F14_{t}_{q}" for q in ASK] + [c.format(t) for c in STI]
    return cols + [f"ychromo{t}{s}" for t in ("scr", "m1", "m3") for s in ("", "date")]


def make_sheet(frame, people):
    cols = columns()
    schema = f"`{v.ID}` bigint, " + ", ".join(f"`{c}` string" for c in cols[1:])
    return frame([tuple(p.get(c) for c in cols) for p in people], schema)


HAND = [
    {v.ID: 2101, v.AGE: "29", v.ETHNIC: "1", v.SCHOOLING: None, v.REGISTERED: "1", v.MARITAL: "1", v.NATIONALITY: "1",
     v.ENROLMENT_DATE: "d", "F14_j0_q03NbreClieDernSemaine": "OO", "F14_j0_q05FreqUtilPreservatif": "toujours",
     "F14_j0_q13NbrePartMoisDernier": "2", "F14_j0_q11PartenaireSexPrinc": "n", "ychromoscr": "P", "ychromom1": "N",
     "F14_j0_q15FreqUtilervatifPart": "jamais", "F20_j0_q06aResultatRPR": "negatif", "F20_m1_q06aResultatRPR": "positif",
     "F20_m1_q07bResultatTPHA": "positif", "F01_m12_h00VisitDate": "d"},
    {v.ID: 3102, v.AGE: "50", v.ETHNIC: "77", v.ETHNIC_OTHER: "MANDJAQUE", v.SCHOOLING: "2", v.REGISTERED: "2", v.MARITAL: "3",
     v.NATIONALITY: "2", v.NATIONALITY_OTHER: "elsewhere", v.ENROLMENT_DATE: "d", "F14_j0_q03NbreClieDernSemaine": "REFUS",
     "F14_j0_q13NbrePartMoisDernier": "1", "F14_j0_q11PartenaireSexPrinc": "o", "F14_j0_q15FreqUtilervatifPart": "toujours",
     "ychromoscr": "U", "ychromom3date": "d", "F01_m1_h00VisitDate": "d"},
    {v.ID: 4103, v.AGE: "17", v.ETHNIC: None, v.SCHOOLING: "1", v.REGISTERED: None, v.ENROLMENT_DATE: "d",
     "F14_j0_q03NbreClieDernSemaine": "3", "F14_j0_q05FreqUtilPreservatif": "jamais", "ychromoscr": "N", "ychromom3": "N"},
    {v.ID: 9104, v.AGE: "abc", v.ETHNIC: "4", v.ENROLMENT_DATE: None, "ychromom1": "P"},
    {v.ID: 4105, v.ENROLMENT_DATE: "d", "F14_m1_q03NbreClieDernSemaine": "10"},
]


@pytest.fixture(scope="module")
def hand(frame):
    return make_sheet(frame, HAND)


def test_demographics(hand):
    cols = [v.ID, "site", "age_cat", "registered", "ethnic_group", "ethnic_group_cat", "edu", "married_cat", "num_clients_cat"]
    out = table(prep.demographics(hand).select(cols), v.ID)
    assert out[2101] == ("Pikine", "<30", "Yes", "Wolof", "Wolof", "None", "Never Married", None)
    assert out[3102] == ("Mbao", "50+", "No", "Manjak", "Other", "Secondary", "Never Married", None)
    assert out[4103] == ("Rifisque", None, None, None, None, "Primary", None, "3+")
    assert out[9104][0] == "9" and out[9104][3:5] == ("Mandingue/Bambara", "Mandingue")


def test_prepared_tables(hand):
    study = prep.prepare(hand, prep.Options(relabel={4103: 4105}, sheet_fixes=(("ychromom1", {2101: "P"}),)))
    assert {r[v.ID] for r in study.baseline.select(v.ID).collect()} == {2101, 3102, 4103, 4105}
    # uncertain and date-only samples are gone, the relabelled person took the samples over
    assert bag(study.swab.select("id", "site", "visit", "value")) == sorted(map(repr, [
        (2101, "Pikine", "scr", "P"), (2101, "Pikine", "m1", "P"), (4105, "Rifisque", "scr", "N"), (4105, "Rifisque", "m3", "N")]))
    b = table(study.behaviour.select("id", "visit", "NbreClieDernSemaine", "value", "yc_result", "always_condom_client",
                                     "always_condom_both", "reports_main_partner", "reports_client", "reports_either"), "id", "visit")
    assert len(b) == 4 * 3
    assert b[2101, "scr"] == (0, "P", 1, 1, 0, 0, 0, 0)
    assert b[3102, "scr"] == (None, None, None, None, None, 1, None, 1)
    assert b[4103, "scr"] == (3, None, None, 0, 0, None, 1, 1)
    assert b[4105, "scr"][1:3] == ("N", 0) and b[4105, "m1"][0] == 10
    assert {r.visit for r in study.sti.select("visit").distinct().collect()} == {"scr", "m1", "m3"}


def test_row_path_equals_join_path(frame):
    sheet = prep.demographics(prep.typed(make_sheet(frame, crowd(seed=2, n=60) + HAND)))
    options = prep.Options(lab_fixes={2101: "N", 3102: "P", 4105: "P"})
    for opt in (options, prep.Options(enrolled_only=False)):
        a, b = prep.prepare_by_row(sheet, opt), prep.prepare_by_join(sheet, opt)
        for t in ("baseline", "behaviour", "sti", "swab"):
            x, y = getattr(a, t), getattr(b, t)
            assert set(x.columns) == set(y.columns) and bag(x) == bag(y.select(x.columns)), t
    assert "Exchange" not in prep.prepare_by_row(sheet).behaviour._jdf.queryExecution().executedPlan().toString()
    assert prep.repeated_ids(sheet).count() == 0 and prep.repeated_ids(sheet.union(sheet)).count() == 65


def test_presence_and_merge(hand):
    pres = prep.presence(hand)
    out = table(pres.select("id", "visit", "presence"), "id", "visit")
    assert out[2101, "m12"] == 1 and out[2101, "m1"] == 0 and out[3102, "m1"] == 1 and out[9104, "j0"] == 0
    merged = prep.swab_with_presence(prep.prepare(hand).swab, pres)
    assert table(merged.select("id", "visit", "presence"), "id", "visit")[2101, "scr"] == 1


def test_lookup_keys(frame):
    keys = prep.lookup_keys(frame([(1, "screen"), (2, "3")], "id int, visit string"))
    assert table(keys, "id") == {1: "scr", 2: "m3"}


def crowd(seed=4, n=160):
    rnd = random.Random(seed)
    maybe = lambda *xs: rnd.choice([*xs, None])
    people = []
    for i in range(n):
        p = {v.ID: rnd.choice([2, 3, 4, 5]) * 1000 + i, v.AGE: str(rnd.randint(18, 57)), v.ETHNIC: rnd.choice("123458"),
             v.SCHOOLING: maybe("1", "2"), v.REGISTERED: maybe("1", "2"), v.MARITAL: rnd.choice("12345"),
             v.NATIONALITY: rnd.choice("12"), v.ENROLMENT_DATE: rnd.choice(["d", "d", "d", None])}
        for t in ("j0", "m1", "m3"):
            p |= {f"F14_{t}_q03NbreClieDernSemaine": maybe("0", "1", "2", "4", "REFUS"), f"F14_{t}_q04UtiliseUnPresevatif": maybe("o", "n"),
                  f"F14_{t}_q05FreqUtilPreservatif": maybe("toujours", "jamais", "parfois"), f"F14_{t}_q11PartenaireSexPrinc": maybe("o", "n"),
                  f"F14_{t}_q13NbrePartMoisDernier": maybe("0", "1", "2"), f"F14_{t}_q14PreservaPartenaires": maybe("o", "n"),
                  f"F14_{t}_q15FreqUtilervatifPart": maybe("toujours", "jamais", "parfois"),
                  f"F20_{t}_q03ResultatstGonorrhee": maybe("positif", "negatif"), f"F20_{t}_q06aResultatRPR": maybe("positif", "negatif"),
                  f"F20_{t}_q07bResultatTPHA": maybe("positif", "negatif"), f"F20_{t}_q06atestSyphilisRPR": maybe("o", "n"),
                  f"F20_{t}_q05ResultatstChlamydia": maybe("positif", "negatif")}
        for t in ("scr", "m1", "m3"):
            p[f"ychromo{t}"] = rnd.choice(["P", "N", "N", "N", "U", None])
        people.append(p)
    return people


@pytest.fixture(scope="module")
def study(frame):
    # The prepared tables are reused by every report, so they are kept.
    s = prep.prepare(make_sheet(frame, crowd()))
    return prep.Study(*(t.persist() for t in (s.baseline, s.behaviour, s.sti, s.swab)))


def test_two_ways_to_the_same_share(study):
    out = reports.text_results(study)
    swab = [r.value for r in study.swab.select("value").collect()]
    row = out["swabs"].first()
    assert (row.num_positive, row.n) == (swab.count("P"), len(swab)) and row.lower < row.pct < row.upper
    assert row.se == pytest.approx((row.pct * (1 - row.pct) / row.n) ** 0.5)
    per = {}
    for r in study.swab.select("id", "value").collect():
        per[r.id] = per.get(r.id, False) or r.value == "P"
    assert out["persons"].first().num_positive == sum(per.values()) and out["persons"].first().n == len(per)
    assert out["sti_ever"].first().tested_gon >= out["sti_baseline"].first().tested_gon


def test_tables(study):
    cohort = reports.sampled_cohort(study)
    one = reports.table_one(cohort)
    levels = one["levels"].groupBy("variable").agg(F.sum("n").alias("n")).collect()
    n = cohort.count()
    assert {r.n for r in levels if r.variable in ("site", "registered", "ethnic_group", "main_partner")} == {n}
    assert one["age"].first().n == n and one["age_quartiles"].first().iqr > 0
    two = table(reports.table_two(study), "variable", "level", "value")
    rows = study.behaviour.where("value IS NOT NULL AND has_partner AND always_condom_main = 1 AND value = 'P'").count()
    assert two["always_condom_main", "1", "P"][0] == rows
    by = reports.condom_by_value(study)
    assert by["client_known"].where("FreqUtilPreservatif IS NULL").count() == 0 and by["client"].count() > by["client_known"].count()
    assert {r.variable for r in by["by_status"].select("variable").distinct().collect()} >= {"always_condom_both:partnered_clients", "never_condom:all"}


def test_figures(study):
    fig = table(reports.figure_condoms(study).select("measure", "visit", "numerator", "n", "visit_num"), "measure", "visit")
    num = study.behaviour.where("visit = 'm3' AND always_condom_client = 0").count()
    assert fig["Clients", "m3"][0] == num and fig["Clients", "m3"][2] == 3
    assert reports.figure_condoms(study, by_site=True, complement=False).count() == 2 * 4 * 3
    some = {(r.measure, r.visit): r.n for r in reports.figure_condoms(study, sampled=True).collect()}
    assert all(some[k] <= fig[k][1] for k in some) and some["Clients", "scr"] < fig["Clients", "scr"][1]
    clients = {r.visit: r for r in reports.figure_clients(study).collect()}
    assert clients["scr"].n == study.behaviour.where("visit = 'scr'").count() > clients["scr"].n_known
    det = {r.visit: r for r in reports.figure_detection(study, grouped=True).collect()}
    assert set(det) == {"scr", "m1-3"} and sum(r.num_swabs for r in det.values()) == study.swab.count()
    assert reports.figure_clients(study, by_site=True).count() == 12
    assert 0 < reports.before_after(study).first().p_value <= 1


def test_repeats_and_sti(study):
    rep = reports.repeated_samples(study)
    n_multi = study.swab.groupBy("id").count().where("count > 1").count()
    assert rep["always_never"].first().n_persons == n_multi == rep["initial_vs_later"].first().n_persons
    assert rep["paired"].agg(F.sum("n")).first()[0] == study.swab.groupBy("id").count().where("count = 2").count()
    sti = reports.sti_summary(study)
    prev = table(sti["prevalence"].select("test", "period", "n_known"), "test", "period")
    assert prev["rpr", "overall"] == prev["rpr", "baseline"] + prev["rpr", "post"]
    seen = {}
    for r in study.sti.orderBy("id", "visit_ord").select("id", "aResultatRPR").collect():
        if r.aResultatRPR:
            seen.setdefault(r.id, []).append(r.aResultatRPR)
    first = sti["first_rpr"].first()
    assert (first.n, first.num_pos) == (len(seen), sum(x[0] == "positif" for x in seen.values()))
    inc = [b for x in seen.values() for a, b in zip(x, x[1:]) if a == "negatif"]
    row = sti["incident_rpr"].first()
    assert (row.n, row.num_pos) == (len(inc), inc.count("positif"))
    assert sti["incident_rpr_tpha"].first().n <= row.num_pos and sti["first_rpr_tpha"].first().n <= first.num_pos
    assert sti["followup_rpr"].first().n_cohort == study.sti.where("visit = 'scr' AND aResultatRPR = 'negatif'").count()


def test_models_of_the_study(study):
    log = reports.log_trends(study)
    assert {t.term for t in log["gee"].collect()} == {"(Intercept)", "visit_num"} and log["gee_partner"].count() == 2
    both = log["glm"].where("term = 'visit_num'").first()
    assert both.est == pytest.approx(2.718281828459045**both.estimate) and both.converged
    tr = reports.trends(study)
    assert tr.where("term = 'visit_num'").count() == 6 and tr.where("NOT converged").count() == 0
    base = reports.baseline_predictors(study)
    assert {r.model for r in base.select("model").distinct().collect()} == {"age_cat", "registered", "ethnic_group_cat", "edu", "site"}
    beh = {r.model for r in reports.behaviour_predictors(study).select("model").distinct().collect()}
    assert len(beh) == 10


def test_one_row_screen(study):
    out = reports.one_row_screen(study)
    people = study.swab.select("id").distinct().count()
    rates = out["rates"].where("variable = 'site'").agg(F.sum("n")).first()[0]
    assert rates == people
    chi = {r.test: r for r in out["chisq"].collect()}
    assert chi["site"].n == people and chi["site"].df == 3 and 0 <= chi["site"].p_value <= 1
    assert all(r.note is None and 0 < r.p_value <= 1 for r in out["fisher"].collect())
    assert {r.model for r in out["glm"].select("model").distinct().collect()} >= {
        "age", "site", "always_condom_main", "NbreClieDernSemaine", "FreqUtilPreservatif", "FreqUtilervatifPart"}
    prof = out["clients_profile"].where("term = 'NbreClieDernSemaine'").first()
    assert prof.lower < prof.estimate < prof.upper


def test_companion_tests_and_missingness(study, hand):
    out = reports.sti_by_swab(study)
    n = study.swab.count()
    assert {r.n for r in out["levels"].groupBy("variable").agg(F.sum("n").alias("n")).collect()} == {n}
    cross = out["by_swab"].where("variable = 'rpr' AND level = 'positif'").agg(F.sum("n")).first()[0]
    prev = out["prevalence"].where("test = 'rpr' AND period = 'overall'").first()
    assert prev.num_pos == cross and prev.n_rows == n
    small = prep.prepare(hand)
    miss = reports.missingness(small, prep.presence(hand))
    assert table(miss["attendance"].select("visit", "present", "total"), "visit")["m12"] == (1, 5)
    assert miss["no_answers"].first()[0] == 2  # answers exist only for the screening rows of two people


def test_reconciliation(study, frame):
    ids = [r.id for r in study.swab.select("id").distinct().collect()]
    persons = frame([(i,) for i in ids[1:]], "id bigint")
    listed = frame([(1, "screen"), (1, "screen"), (1, "3")], "id bigint, visit string")
    out = reports.reconcile(study.swab, persons, listed)
    assert [r.id for r in out["persons_not_listed"].collect()] == [ids[0]]
    assert table(out["listed_twice"], "id", "visit") == {(1, "scr"): 2}


def test_interval_scale_follows_the_model(study):
    tr = {r.model: r for r in reports.trends(study, adjusted=False).where("term = 'visit_num'").collect()}
    lin, log = tr["trend:NbreClieDernSemaine"], tr["trend:yc_result"]
    assert lin.est == lin.estimate and log.est == pytest.approx(2.718281828459045**log.estimate)


def test_whole_study_from_a_csv_sheet(spark, frame, tmp_path):
    from panelwise.plans import study as whole

    make_sheet(frame, crowd(seed=9, n=120)).write.csv(str(tmp_path / "sheet"), header=True)
    paths = whole.run(spark, str(tmp_path / "sheet"), str(tmp_path / "out"), "csv")
    assert len(paths) > 50
    trends = spark.read.parquet(next(p for p in paths if p.endswith("/trends")))
    assert trends.where("term = 'visit_num'").count() == 6


@pytest.mark.parametrize("kind", ["double", "decimal(20,3)", "string", "bigint"])
def test_large_ids_survive(frame, kind):
    ids = [9_999_999, 10_000_000, 20_000_007]
    sheet = frame([(str(i) + (".0" if kind == "string" else ""),) for i in ids], f"{v.ID} string").withColumn(v.ID, F.col(v.ID).cast(kind))
    assert [r[0] for r in prep.typed(sheet).orderBy(v.ID).collect()] == ids


def test_repeated_participants_stop_the_run(spark, frame, tmp_path):
    sheet = make_sheet(frame, crowd(seed=2, n=5))
    sheet.union(sheet.limit(1)).write.parquet(str(tmp_path / "sheet"))
    with pytest.raises(ValueError, match="more than one row"):
        study_module.run(spark, str(tmp_path / "sheet"), str(tmp_path / "out"))
    assert read_tables(spark, str(tmp_path / "out/audit"))["repeated_ids"].count() == 1


def test_double_visits_stop_a_run(spark, frame, tmp_path):
    study = prep.prepare(make_sheet(frame, crowd(seed=3, n=8)))
    study_module.check_cells(study, str(tmp_path / "fine"))
    assert read_tables(spark, str(tmp_path / "fine/audit_cells"))["double_cells"].count() == 0
    twice = prep.Study(study.baseline, study.behaviour, study.sti, study.swab.unionByName(study.swab.limit(1)))
    with pytest.raises(ValueError, match="has twice"):
        study_module.check_cells(twice, str(tmp_path / "out"))
    found = read_tables(spark, str(tmp_path / "out/audit_cells"))["double_cells"].collect()
    assert [(r.table, r.n) for r in found] == [("swab", 2)]
