"""The study's tables, figure data and models as result frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions import recode
from panelwise.functions.intervals import bind_wilson, mean_interval, wald
from panelwise.functions.nulls import ind, safe_double
from panelwise.operators import contingency, describe, gee, glm, sequence
from panelwise.operators.contingency import Pair
from panelwise.operators.describe import Item
from panelwise.operators.design import Factor, Model, discover_levels
from panelwise.operators.joins import attach, ids_only_in, keep_ids
from panelwise.operators.reshape import unpivot_measures
from panelwise.plans import values as v
from panelwise.plans.prep import (
    Study,
    lookup_keys,
    predictor_frame,
    swab_with_answers,
    swab_with_presence,
    trend_frame,
)

TREND_OUTCOMES = [
    ("NbreClieDernSemaine", "gaussian"), ("not_always_condom_client", "binomial"),
    ("not_always_condom_main", "binomial"), ("not_used_condom_recent_client", "binomial"),
    ("not_used_condom_recent_main", "binomial"), ("yc_result", "binomial"),
]
ADJUST = ("age", Factor("ethnic_group_cat", v.ETHNIC_GROUP_LEVELS), Factor("edu", v.EDU_LEVELS))


def text_results(study: Study) -> dict[str, DataFrame]:
    """Persons and samples with a positive result, with score and normal intervals."""
    persons = describe.ever_positive(study.swab, "id", "value", v.POSITIVE)
    swabs = describe.overall_rate(study.swab, F.col("value") == v.POSITIVE)
    out = {}
    for name, frame in (("persons", persons), ("swabs", swabs)):
        se, lo, hi = wald("pct", "n")
        out[name] = bind_wilson(frame, "num_positive", "n").withColumns(
            {"se": se, "wald_lower": lo, "wald_upper": hi}
        )
    tests = {k: (c, v.STI_POSITIVE) for k, c in v.STI_RESULTS.items() if k != "rpr" and c in study.sti.columns}
    if not tests:
        return out
    out["sti_ever"] = describe.any_totals(study.sti, "id", tests)
    base = study.sti.where(F.col("visit") == "scr")
    out["sti_baseline"] = base.agg(
        *[F.count_if(F.col(c) == p).alias(f"pos_{k}") for k, (c, p) in tests.items()],
        *[F.count(c).alias(f"tested_{k}") for k, (c, _) in tests.items()],
    )
    return out


def table_one(cohort: DataFrame) -> dict[str, DataFrame]:
    """Demographics of a cohort: numbers and one long frequency table."""
    has_main = F.coalesce(F.col(v.MAIN_PARTNER) == v.YES, F.lit(False))
    items = [
        Item("born_in_country", F.when(F.col(v.NATIONALITY).cast("double") == 1, "yes").otherwise(
            F.when(F.col(v.NATIONALITY).isNotNull(), "no"))),
        Item("birth_place_elsewhere", F.col(v.NATIONALITY_OTHER), F.col(v.NATIONALITY).cast("double") == 2),
        Item("registered", F.col("registered")),
        Item("site", F.col("site")),
        Item("ethnic_group", F.col("ethnic_group")),
        Item("num_clients_cat", F.col("num_clients_cat")),
        Item("main_partner", F.col(v.MAIN_PARTNER)),
        Item("condom_client", F.col(v.CONDOM_CLIENT)),
        Item("condom_main", F.col(v.CONDOM_MAIN), has_main),
        Item("confidence_main", F.col("confidence_main")),
        Item("confidence_main_partnered", F.col("confidence_main"), has_main),
        Item("confidence_client", F.col("confidence_client")),
        Item("married", F.col("married")),
        Item("edu", F.col("edu")),
    ]
    raw = {"french": v.FRENCH, "schooling_code": v.SCHOOLING, "schooling_text": v.SCHOOLING_OTHER}
    items += [Item(k, F.col(c)) for k, c in raw.items()]
    cohort = cohort.withColumn("clients", safe_double(recode.blank_out(v.CLIENTS, v.UNKNOWN_ANSWERS)))
    age, clients = (describe.exact_quantiles(cohort, c, [0.25, 0.5, 0.75]) for c in ("age", "clients"))
    return {
        "age": describe.numeric_summary(cohort, "age"),
        "age_quartiles": age.withColumn("iqr", F.col("q75") - F.col("q25")),
        "clients": describe.numeric_summary(cohort, "clients"),
        "clients_quartiles": clients,
        "levels": describe.table_one(cohort, items),
        "ethnic_by_text": describe.freq_2way(cohort, v.ETHNIC, v.ETHNIC_OTHER, include_na=True),
    }


def sampled_cohort(study: Study) -> DataFrame:
    """Baseline rows of participants with a laboratory result."""
    return keep_ids(study.baseline, study.swab.select("id"), v.ID, "id")


def table_two(study: Study) -> DataFrame:
    """Result by self-report, nine variables in one pass."""
    partnered = F.coalesce(F.col("has_partner"), F.lit(False))
    masks = {
        "reports_client": None, "reports_main_partner": None, "reports_either": None,
        "always_condom_client": None, "always_condom_main": partnered, "always_condom_both": partnered,
        "used_condom_recent_client": None, "used_condom_recent_main": partnered, "used_condom_recent_both": partnered,
    }
    rows = study.behaviour.where(F.col("value").isNotNull())
    return describe.table_two(rows, [Item(k, F.col(k), m) for k, m in masks.items()], "value")


def condom_by_value(study: Study) -> dict[str, DataFrame]:
    """Condom frequency by result, missing answers kept or removed, plus collapsed categories."""
    rows = swab_with_answers(study)
    some = F.coalesce(F.col("has_partner"), F.lit(True))
    maybe = rows.where(some)
    clients = F.coalesce(F.col("reports_client") == 1, F.lit(False))
    partnered = F.coalesce(F.col("has_partner"), F.lit(False))
    main = F.coalesce(F.col("PartenaireSexPrinc") == v.YES, F.lit(False))
    items = []
    for name, keeps in (
        ("always_condom_client", {"all": None, "clients": clients}),
        ("always_condom_main", {"all": None, "main": main, "partnered": partnered}),
        ("always_condom_both", {"all": None, "partnered": partnered, "partnered_clients": partnered & clients}),
        ("UtiliseUnPresevatif", {"all": None, "clients": clients}),
        ("PreservaPartenaires", {"all": None, "partnered": partnered}),
        ("used_condom_recent_both", {"all": None, "partnered": partnered, "partnered_clients": partnered & clients}),
        ("reports_main_partner", {"all": None}), ("reports_client", {"all": None}), ("reports_either", {"all": None}),
        ("always_condom", {"all": None}), ("never_condom", {"all": None}),
    ):
        items += [Item(f"{name}:{k}", F.col(name), m) for k, m in keeps.items()]
    return {
        "client": describe.group_share_within(rows, "value", "FreqUtilPreservatif"),
        "client_known": describe.group_share_within(rows, "value", "FreqUtilPreservatif", known_only=True),
        "main": describe.group_share_within(maybe, "value", "FreqUtilervatifPart"),
        "main_known": describe.group_share_within(maybe, "value", "FreqUtilervatifPart", known_only=True),
        "by_status": describe.table_two(rows, items, "value"),
        "partners": describe.table_one(
            rows, [Item(c, F.col(c)) for c in ("reports_main_partner", "reports_client", "reports_either")]
        ),
    }


def _level_visits(rows: DataFrame) -> DataFrame:
    """Visits outside the analysis list become one missing group."""
    return rows.withColumn("visit", recode.within_levels("visit", v.VISITS))


def figure_condoms(study: Study, by_site: bool = False, complement: bool = True, sampled: bool = False) -> DataFrame:
    """Share (not) always using condoms per measure and visit, with score intervals.

    ``sampled`` restricts to participants with a laboratory result.
    """
    ids = ["id", "visit", *(["site"] if by_site else [])]
    rows = _level_visits(study.behaviour)
    if sampled:
        rows = keep_ids(rows, study.swab, "id")
    rows = unpivot_measures(rows, ids, list(v.MEASURE_LABELS))
    rows = rows.withColumn("measure", recode.lookup("measure", v.MEASURE_LABELS))
    flag = 1 - F.col("value") if complement else F.col("value")
    by = ["measure", *(["site"] if by_site else []), "visit"]
    out = bind_wilson(describe.share_by_group(rows, by, flag), "numerator", "n")
    return out.withColumn("visit_num", recode.lookup("visit", v.VISIT_MONTH))


def figure_clients(study: Study, by_site: bool = False) -> DataFrame:
    """Mean, median and interval of the number of clients per visit."""
    by = [*(["site"] if by_site else []), "visit"]
    lo, hi = mean_interval("mean", "sd", "n")
    out = describe.group_moments(_level_visits(study.behaviour), by, "NbreClieDernSemaine")
    return out.withColumns({"lower": lo, "upper": hi, "visit_num": recode.lookup("visit", v.VISIT_MONTH)})


def figure_detection(study: Study, grouped: bool = False) -> DataFrame:
    """Samples, positives, share and interval per visit or visit group."""
    visit = recode.lookup("visit", v.VISIT_GROUP) if grouped else recode.within_levels("visit", v.VISITS)
    rows = study.swab.withColumn("visit", visit)
    return describe.positives_over_visits(rows, "visit", "value", v.POSITIVE)


def before_after(study: Study) -> DataFrame:
    """Exact test of positivity before against after the start of the study drug."""
    period = F.when(F.col("visit") == "scr", "1-before").otherwise("2-after")
    cells = contingency.contingency_counts(study.swab, [Pair("before_after", period, F.col("value"))])
    return contingency.fisher_2x2(cells)


def repeated_samples(study: Study) -> dict[str, DataFrame]:
    order = ["visit_ord", "visit"]
    counted = sequence.add_count(study.swab, ["id"], "n_samples")
    pairs, threes = (counted.where(F.col("n_samples") == k) for k in (2, 3))
    return {
        "pairs_by_visit": describe.group_pos_neg(pairs, "visit", "value", v.POSITIVE, v.NEGATIVE).drop("pct_pos"),
        "three_samples": sequence.average_rank(threes, ["id"], "visit_ord", "swab_num").select("id", "swab_num", "value"),
        "distribution": describe.repeat_distribution(study.swab, "id"),
        "always_never": sequence.always_never(study.swab, "id", "value", v.POSITIVE, v.NEGATIVE),
        "initial_vs_later": sequence.initial_vs_later(study.swab, "id", "visit_ord", "value", v.POSITIVE, v.NEGATIVE),
        "paired": sequence.paired_agreement(study.swab, "id", order, "value"),
    }


def sti_summary(study: Study) -> dict[str, DataFrame]:
    """Prevalence, first and incident results, baseline-negative follow-up per test."""
    base = F.col("visit") == "scr"
    order = ["visit_ord", "visit"]
    tests = {k: c for k, c in v.STI_RESULTS.items() if c in study.sti.columns}
    out = {
        "prevalence": describe.period_prevalence(study.sti, tests, base, v.STI_POSITIVE),
        "availability": describe.availability(
            _level_visits(study.sti), "visit", tests, ("rpr", "tpha") if {"rpr", "tpha"} <= set(tests) else None,
            study.baseline.agg(F.count(F.lit(1))).scalar(),
        ),
    }
    for name, c in tests.items():
        out[f"first_{name}"] = sequence.first_test_summary(study.sti, "id", order, c, v.STI_POSITIVE, v.STI_NEGATIVE)
        out[f"incident_{name}"] = sequence.incident_tests(study.sti, "id", order, c, v.STI_POSITIVE, v.STI_NEGATIVE)
        out[f"followup_{name}"] = sequence.followup_summary(study.sti, "id", base, c, v.STI_POSITIVE, v.STI_NEGATIVE)
    if {"rpr", "tpha"} <= set(tests):
        rpr, tpha = tests["rpr"], tests["tpha"]
        args = (study.sti, "id", order, rpr, tpha, v.STI_POSITIVE, v.STI_NEGATIVE)
        out["first_rpr_tpha"] = sequence.companion_at_first_positive(*args)
        out["incident_rpr_tpha"] = sequence.incident_with_companion(*args)
        later = sequence.exclude_baseline_positive(study.sti, "id", base, rpr, v.STI_POSITIVE)
        out["confirmed_tpha"] = describe.freq_filtered(later, tpha, F.col(rpr) == v.STI_POSITIVE)
    return out


def sti_by_swab(study: Study) -> dict[str, DataFrame]:
    """Companion tests on the sampled rows: availability, results, prevalence, result by swab."""
    tests = {k: c for k, c in v.STI_RESULTS.items() if c in study.sti.columns}
    offered = {f"{k}_offered": c for k, c in v.STI_AVAILABLE.items() if c in study.sti.columns}
    rows = attach(study.swab, study.sti.drop("visit_ord"), ["id", "visit", "site"], grows=True)
    return {
        "levels": describe.table_one(rows, [Item(k, F.col(c)) for k, c in {**tests, **offered}.items()]),
        "prevalence": describe.period_prevalence(rows, tests, F.col("visit") == "scr", v.STI_POSITIVE),
        "by_swab": describe.companion_table(rows, tests, "value"),
    }


def missingness(study: Study, presence_rows: DataFrame) -> dict[str, DataFrame]:
    """Attendance by visit, and presence of sampled rows by visit and site."""
    merged = swab_with_presence(study.swab, presence_rows)
    first, last = (x.lower() for x in v.ANSWER_RANGE)
    stems = [x for x in v.BEHAVIOUR_STEMS if first <= x.lower() <= last]
    answers = [c for c in study.behaviour.columns if any(stem in c for stem in stems)]
    return {
        "attendance": describe.presence_summary(presence_rows, "visit"),
        "sampled_by_visit": describe.presence_summary(merged, "visit"),
        "sampled_by_site": describe.presence_summary(merged, "site"),
        "no_answers": describe.all_missing(swab_with_answers(study), answers),
    }


def reconcile(swab: DataFrame, persons: DataFrame, sample_list: DataFrame) -> dict[str, DataFrame]:
    """Audit against outside lists: sampled persons not listed, samples listed twice."""
    keys = lookup_keys(sample_list)
    return {
        "persons_not_listed": ids_only_in(swab, persons, "id"),
        "listed_twice": keys.groupBy("id", "visit").agg(F.count("*").alias("n")).where("n > 1"),
    }


def trends(study: Study, adjusted: bool = True, **options) -> DataFrame:
    """Six outcomes, each with a linear month trend, from one keyed fit."""
    models = gee.trend_models(TREND_OUTCOMES, "visit_num", ADJUST if adjusted else ())
    linear = [m.name for m in models if m.family == "gaussian"]
    return gee.with_interval(gee.fit_gee(trend_frame(study), models, "id", **options), linear=linear)


LOG_PARTS = ("glm", "gee", "gee_partner")


def log_trends(study: Study, only: Sequence[str] = LOG_PARTS, **options) -> dict[str, DataFrame]:
    """Risk-ratio models of detection: by month without and with clustering, and by main partner. Only the named ones are fitted."""
    swab = study.swab.withColumns({
        "yc_result": ind(F.col("value") == v.POSITIVE), "visit_num": recode.lookup("visit", v.VISIT_MONTH),
    })
    month = Model("visit_num", "yc_result", ("visit_num",), "binomial", "log")
    partner = Model("reports_main_partner", "yc_result", ("reports_main_partner",), "binomial", "log")
    parts = {
        "glm": lambda: glm.fit_glm(swab, month),
        "gee": lambda: gee.fit_gee(swab, month, "id", **options),
        "gee_partner": lambda: gee.fit_gee(swab_with_answers(study), partner, "id", **options),
    }
    return {name: gee.with_interval(parts[name]()) for name in only}


def baseline_predictors(study: Study, **options) -> DataFrame:
    """Univariate clustered models of detection on baseline covariates."""
    rows = predictor_frame(study)
    predictors = [
        Factor("age_cat", v.AGE_LEVELS), Factor("registered", v.REGISTERED_LEVELS),
        Factor("ethnic_group_cat", v.ETHNIC_GROUP_LEVELS), Factor("edu", v.EDU_LEVELS),
        *discover_levels(rows, ["site"]),
    ]
    return gee.with_interval(gee.predictor_screen(rows, "yc_result", predictors, "id", **options))


def behaviour_predictors(study: Study, linear_as_ratio: bool = True, **options) -> DataFrame:
    """Univariate clustered models of detection on self-report.

    The number of clients enters a linear model. Its coefficient is reported on
    the exponential scale like the others unless ``linear_as_ratio`` is off.
    """
    partnered = F.col("has_partner")
    logit = [
        "reports_client", "reports_main_partner", "reports_either", "not_always_condom_client",
        "not_always_condom_main", "not_always_condom_both", "not_used_condom_recent_client",
        "not_used_condom_recent_main", "not_used_condom_recent_both",
    ]
    masked = {p: partnered for p in logit if p.endswith(("_main", "_both"))}
    models = gee.screen_models("yc_result", logit, masked)
    models += gee.screen_models("yc_result", ["NbreClieDernSemaine"], None, "gaussian", "identity")
    linear = () if linear_as_ratio else ("NbreClieDernSemaine",)
    return gee.with_interval(gee.fit_gee(study.behaviour, models, "id", **options), linear=linear)


ONE_ROW_PARTS = ("rates", "chisq", "fisher", "fisher_2x2", "glm", "clients_profile")
ONE_ROW_PLAIN = (
    "age_quart", "age_cat", "registered", "ethnic_group_cat", "married_cat", "married", "edu", "site",
    "FreqUtilPreservatif", "always_condom_client", "clients_fine", "reports_main_partner",
)
ONE_ROW_MASKED = ("FreqUtilervatifPart", "always_condom_main")


def one_row_frame(study: Study, seed: int = 0) -> DataFrame:
    """One random sample per person with baseline covariates and the answers of its visit."""
    answers = study.behaviour.drop("date", "value", "visit_ord", "yc_result")
    rows = attach(predictor_frame(study, random_one=True, seed=seed), answers, ["id", "visit", "site"], grows=True)
    return rows.withColumns({
        "clients_fine": recode.cut(F.col("NbreClieDernSemaine"), v.CLIENT_FINE_BREAKS, v.CLIENT_FINE_LEVELS),
        "pos": ind(F.col("value") == v.POSITIVE),
    }).select("pos", "has_partner", "age", "NbreClieDernSemaine", *ONE_ROW_PLAIN, *ONE_ROW_MASKED)


def one_row_screen(study: Study, seed: int = 0, only: Sequence[str] = ONE_ROW_PARTS, **options) -> dict[str, DataFrame]:
    """One random sample per person: rates, contingency tests, logistic fits. Only the named parts are made."""
    return screen_rows(one_row_frame(study, seed), only, **options)


def screen_rows(rows: DataFrame, only: Sequence[str] = ONE_ROW_PARTS, **options) -> dict[str, DataFrame]:
    """The parts of ``one_row_screen`` on its rows, which every part reads, the regressions several times."""
    partnered = F.coalesce(F.col("has_partner"), F.lit(False))
    rates = describe.level_rates(
        rows, {c: F.col(c) for c in ONE_ROW_PLAIN + ONE_ROW_MASKED}, "pos", {c: partnered for c in ONE_ROW_MASKED}
    )
    chi = contingency.contingency_counts(
        rows, [Pair(c, F.col(c), F.col("pos")) for c in ("age_quart", "age_cat", "registered", "married_cat", "site")]
    )
    fisher = contingency.contingency_counts(
        rows,
        [Pair(c, F.col(c), F.col("pos")) for c in
         ("age_cat", "ethnic_group_cat", "edu", "FreqUtilPreservatif", "clients_fine")]
        + [Pair("FreqUtilervatifPart", F.col("FreqUtilervatifPart"), F.col("pos"), partnered)],
    )
    two = contingency.contingency_counts(
        rows,
        [Pair(c, F.col(c), F.col("pos")) for c in ("always_condom_client", "reports_main_partner")]
        + [Pair("always_condom_main", F.col("always_condom_main"), F.col("pos"), partnered)],
    )

    def models() -> list[Model]:
        factors = [
            Factor("age_quart", v.AGE_QUART_LEVELS), Factor("age_cat", v.AGE_LEVELS),
            Factor("registered", v.REGISTERED_LEVELS), Factor("ethnic_group_cat", v.ETHNIC_GROUP_LEVELS),
            Factor("married_cat", v.MARITAL_LEVELS), Factor("edu", v.EDU_LEVELS),
            *discover_levels(rows, ["site", "FreqUtilPreservatif", "FreqUtilervatifPart"]),
        ]
        out = [Model("age", "pos", ("age",))]
        out += [
            Model(f.column, "pos", (f,), where=partnered if f.column == "FreqUtilervatifPart" else None) for f in factors
        ]
        out += [Model(c, "pos", (c,)) for c in ("always_condom_client", "NbreClieDernSemaine", "reports_main_partner")]
        return [*out, Model("always_condom_main", "pos", ("always_condom_main",), where=partnered)]

    parts = {
        "rates": lambda: rates,
        "chisq": lambda: contingency.chisq_test(chi),
        "fisher": lambda: contingency.fisher_rx2(fisher),
        "fisher_2x2": lambda: contingency.fisher_2x2(two),
        "glm": lambda: glm.fit_glm(rows, models(), **options),
        "clients_profile": lambda: glm.profile_interval(rows, Model("clients", "pos", ("NbreClieDernSemaine",))),
    }
    return {name: parts[name]() for name in only}
