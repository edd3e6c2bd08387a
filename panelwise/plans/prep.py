"""From the wide sheet to analysis tables.

The sheet has one row per participant, so everything a visit row needs - answers,
laboratory result, enrolment - is on that row. ``prepare`` explodes visit rows
from it and shuffles nothing. Only participants whose samples were mislabelled
need a real join, and the scan is filtered to those few first.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions import nulls, recode
from panelwise.operators import clean, reshape
from panelwise.operators.joins import attach, keep_ids
from panelwise.plans import values as v
from panelwise.sources.tables import ensure_columns, matching


@dataclass(frozen=True)
class Options:
    """What differs between data cuts of the same study."""

    sheet_fixes: tuple = ()  # (column, {id: value}) pairs, before reshaping
    lab_fixes: Mapping = field(default_factory=dict)  # {id: value} for every visit of the id
    relabel: Mapping = field(default_factory=dict)  # {wrong id: right id} of laboratory rows
    enrolled_only: bool = True
    numeric_clients: bool = True
    text_compare: bool = True  # partner counts compare as text, as stacked answers do
    form: Mapping = field(default_factory=lambda: {"m12": "F01"})


@dataclass(frozen=True)
class Study:
    baseline: DataFrame
    behaviour: DataFrame
    sti: DataFrame
    swab: DataFrame


def demographics(sheet: DataFrame) -> DataFrame:
    """Sheet plus site, age bins, registration, ethnic group, schooling, marital status."""
    sheet, col = ensure_columns(sheet, v.SHEET_COLUMNS), F.col
    ethnic = recode.code_labels(col(v.ETHNIC), v.ETHNIC_LABELS)
    word, label = v.ETHNIC_OVERRIDE
    age = nulls.safe_double(col(v.AGE))
    clients = recode.blank_out(col(v.CLIENTS), v.UNKNOWN_ANSWERS)
    with_labels = sheet.withColumns({
        "site": recode.leading_digit_label(v.ID, v.SITES),
        "age": age,
        "age_cat": recode.cut(age, v.AGE_BREAKS, v.AGE_LEVELS),
        "age_quart": recode.cut(age, v.AGE_QUART_BREAKS, v.AGE_QUART_LEVELS),
        "registered": recode.code_labels(col(v.REGISTERED), v.REGISTERED_LABELS),
        "ethnic_group": recode.override(ethnic, col(v.ETHNIC_OTHER) == word, label),
        "edu": recode.code_labels(recode.default_missing(col(v.SCHOOLING).cast("string"), "0"), v.EDU_LABELS),
        "married": recode.code_labels(col(v.MARITAL), v.MARITAL_LABELS),
        "num_clients_cat": recode.cut(nulls.safe_int(clients), v.CLIENT_BREAKS, v.CLIENT_LEVELS),
        "confidence_client": recode.lookup(col(v.CONFIDENCE_CLIENT), v.CONFIDENCE_LABELS),
        "confidence_main": recode.lookup(col(v.CONFIDENCE_MAIN), v.CONFIDENCE_LABELS),
    })
    return with_labels.withColumns({
        "ethnic_group_cat": recode.lookup("ethnic_group", v.ETHNIC_GROUPS),
        "married_cat": recode.lookup("married", v.MARITAL_GROUPS),
    })


def visit_answers(sheet: DataFrame, stems) -> DataFrame:
    """One row per (id, site, visit), one text column per question of the stems."""
    columns = matching(sheet.columns, stems)
    grid = reshape.question_grid(columns, v.VISIT_ALIAS)
    rows = reshape.visits_from_wide(sheet, [v.ID, "site"], grid)
    return rows.withColumnRenamed(v.ID, "id").withColumn("visit_ord", recode.ordinal("visit", v.VISITS))


def swab_rows(sheet: DataFrame, options: Options = Options()) -> DataFrame:
    """Laboratory rows that have a value or a date, uncertain and valueless ones dropped."""
    lab = reshape.visits_from_wide(
        sheet, [v.ID, "site"], reshape.lab_grid(matching(sheet.columns, v.LAB_STEM))
    ).withColumnRenamed(v.ID, "id")
    for needed in ("date", "value"):
        if needed not in lab.columns:
            lab = lab.withColumn(needed, F.lit(None).cast("string"))
    lab = lab.where("date IS NOT NULL OR value IS NOT NULL")
    lab = clean.remap_key(lab, "id", options.relabel)
    lab = clean.correct_cell(lab, "value", "id", options.lab_fixes)
    lab = clean.drop_value(lab, "value", v.UNCERTAIN)
    return lab.withColumn("visit_ord", recode.ordinal("visit", v.VISITS))


def behaviour_flags(rows: DataFrame, text_compare: bool = True) -> DataFrame:
    """Condom-use and partner indicators of a visit row with its swab result."""
    q = F.col
    partners = q("NbrePartMoisDernier")
    reports = (partners > F.lit("0")) if text_compare else (nulls.safe_double(partners) > 0)
    first = rows.withColumns({
        "yc_result": nulls.ind(F.col("value") == v.POSITIVE),
        "has_partner": reports,
        "always_condom_client": nulls.ind(q("FreqUtilPreservatif") == v.ALWAYS),
        "always_condom_main": nulls.ind(q("FreqUtilervatifPart") == v.ALWAYS),
        "used_condom_recent_client": nulls.ind(q("UtiliseUnPresevatif") == v.YES),
        "used_condom_recent_main": nulls.ind(q("PreservaPartenaires") == v.YES),
        "reports_main_partner": recode.gate_zero(nulls.ind(reports), q("PartenaireSexPrinc") == v.NO),
        "reports_client": nulls.ind(nulls.safe_double(q("NbreClieDernSemaine")) > 0),
    })
    second = first.withColumns({
        "always_condom_both": nulls.both("always_condom_client", "always_condom_main"),
        "used_condom_recent_both": nulls.both("used_condom_recent_client", "used_condom_recent_main"),
        "reports_either": nulls.either("reports_client", "reports_main_partner"),
        "always_condom": nulls.ind((q("FreqUtilervatifPart") == v.ALWAYS) & (q("FreqUtilPreservatif") == v.ALWAYS)),
        "never_condom": nulls.ind((q("FreqUtilervatifPart") == v.NEVER) & (q("FreqUtilPreservatif") == v.NEVER)),
    })
    flags = [
        "always_condom_client", "always_condom_main", "always_condom_both",
        "used_condom_recent_client", "used_condom_recent_main", "used_condom_recent_both",
    ]
    return second.withColumns({f"not_{f}": nulls.complement(f) for f in flags})


def typed(sheet: DataFrame) -> DataFrame:
    """Sheet with a numeric id, whatever the file delivered."""
    kind, number = dict(sheet.dtypes)[v.ID], F.col(v.ID)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return sheet
    if kind in ("float", "double") or kind.startswith("decimal"):
        # Through text a double of eight digits would read 1.0E7.
        return sheet.withColumn(v.ID, F.when(number == F.floor(number), number).try_cast("bigint"))
    text = F.regexp_replace(F.trim(F.col(v.ID).cast("string")), r"\.0+$", "")
    return sheet.withColumn(v.ID, text.try_cast("bigint"))


def lab_cells(sheet: DataFrame, options: Options) -> dict[str, dict[str, Column]]:
    """Kept laboratory value and date per visit, as expressions over the wide row."""
    none = F.lit(None).cast("string")
    cells = {}
    for visit, names in reshape.lab_grid(matching(sheet.columns, v.LAB_STEM)).items():
        value = F.col(names["value"]).cast("string") if "value" in names else none
        date = F.col(names["date"]).cast("string") if "date" in names else none
        fixed = value
        for k, right in options.lab_fixes.items():
            fixed = F.when((F.col(v.ID) == k) & (value.isNotNull() | date.isNotNull()), F.lit(right)).otherwise(fixed)
        keep = fixed != v.UNCERTAIN
        cells[visit] = {"value": F.when(keep, fixed), "date": F.when(keep, date)}
    return cells


def _finish(rows: DataFrame, options: Options) -> DataFrame:
    """Clean the number of clients and add the indicators."""
    clients = recode.replace_any(recode.blank_out("NbreClieDernSemaine", v.UNKNOWN_ANSWERS), v.ZERO_TYPOS, "0")
    rows = ensure_columns(rows, v.USED_QUESTIONS)
    rows = rows.withColumn("NbreClieDernSemaine", nulls.safe_int(clients) if options.numeric_clients else clients)
    return behaviour_flags(rows, options.text_compare)


def prepare_by_row(sheet: DataFrame, options: Options = Options()) -> Study:
    """Analysis tables of participants whose samples carry the right id: no shuffle."""
    if options.enrolled_only:
        sheet = sheet.where(F.col(v.ENROLMENT_DATE).isNotNull())
    lab = lab_cells(sheet, options)
    grid = {
        visit: {**cells, **lab.get(visit, {"value": F.lit(None), "date": F.lit(None)})}
        for visit, cells in reshape.question_grid(matching(sheet.columns, v.BEHAVIOUR_STEMS), v.VISIT_ALIAS).items()
    }
    rows = reshape.visits_from_wide(sheet, [F.col(v.ID).alias("id"), "site"], grid)
    rows = rows.withColumn("visit_ord", recode.ordinal("visit", v.VISITS))
    swab = reshape.visits_from_wide(sheet, [F.col(v.ID).alias("id"), "site"], lab).where("value IS NOT NULL")
    swab = swab.withColumn("visit_ord", recode.ordinal("visit", v.VISITS))
    return Study(sheet, _finish(rows, options), visit_answers(sheet, v.STI_STEMS), swab)


def prepare_by_join(sheet: DataFrame, options: Options = Options()) -> Study:
    """Same tables by joining visit and laboratory rows, for relabelled samples.

    The join comes before the enrolment filter: a relabelled sample may meet the
    visit row of the person it was moved to.
    """
    swab = swab_rows(sheet, options)
    behaviour = attach(visit_answers(sheet, v.BEHAVIOUR_STEMS), swab.drop("visit_ord"), ["id", "visit", "site"])
    behaviour, sti = _finish(behaviour, options), visit_answers(sheet, v.STI_STEMS)
    if options.enrolled_only:
        ids = sheet.where(F.col(v.ENROLMENT_DATE).isNotNull()).select(F.col(v.ID).alias("id")).distinct()
        sheet = keep_ids(sheet, ids, v.ID, "id")
        behaviour, sti, swab = (keep_ids(t, ids, "id") for t in (behaviour, sti, swab))
    return Study(sheet, behaviour, sti, swab)


def prepare(sheet: DataFrame, options: Options = Options()) -> Study:
    """All four analysis tables of the current data cut."""
    sheet = typed(sheet)
    for column, fixes in options.sheet_fixes:
        sheet = clean.correct_cell(sheet, column, v.ID, fixes)
    sheet = demographics(sheet)
    if not options.relabel:
        return prepare_by_row(sheet, options)
    touched = nulls.in_set(v.ID, {*options.relabel, *options.relabel.values()})
    plain, moved = prepare_by_row(sheet.where(~touched), options), prepare_by_join(sheet.where(touched), options)
    return Study(*(
        getattr(plain, t).unionByName(getattr(moved, t), allowMissingColumns=True)
        for t in ("baseline", "behaviour", "sti", "swab")
    ))


def repeated_ids(sheet: DataFrame) -> DataFrame:
    """Participants with more than one row; an empty frame means the sheet is usable."""
    return sheet.groupBy(v.ID).agg(F.count("*").alias("n")).where("n > 1")


def presence(sheet: DataFrame, options: Options = Options(), visits=v.RAW_VISITS) -> DataFrame:
    """Long presence table: one row per participant and visit."""
    have = [t for t in visits if any("VisitDate" in c and f"_{t}_" in c for c in sheet.columns)]
    dates = reshape.presence_columns(sheet.columns, have, form={k: f for k, f in options.form.items() if k in have})
    with_site = typed(sheet).withColumn("site", recode.leading_digit_label(v.ID, v.SITES))
    return reshape.presence_long(with_site, [v.ID, "site"], dates).withColumnRenamed(v.ID, "id")


def swab_with_answers(study: Study) -> DataFrame:
    """Sampled rows with the answers of the same visit."""
    answers = study.behaviour.drop("date", "value", "visit_ord", "yc_result")
    swab = study.swab.withColumn("yc_result", nulls.ind(F.col("value") == v.POSITIVE))
    return attach(swab, answers, ["id", "visit", "site"], grows=True)


def swab_with_presence(swab: DataFrame, presence_rows: DataFrame) -> DataFrame:
    """Sampled rows with the presence flag; the enrolment visit stands for screening."""
    merged = presence_rows.where(F.col("visit") != "scr").withColumn("visit", recode.recode("visit", v.VISIT_ALIAS))
    return attach(swab, merged, ["id", "site", "visit"], grows=True)


def predictor_frame(study: Study, random_one: bool = False, seed: int = 0) -> DataFrame:
    """Sampled rows with baseline covariates, optionally one random row per person."""
    from panelwise.operators.sequence import one_random_row

    covs = ["age", "age_cat", "age_quart", "registered", "ethnic_group", "ethnic_group_cat", "married", "married_cat", "edu"]
    base = study.baseline.select(F.col(v.ID).alias("id"), *covs)
    rows = attach(study.swab, base, ["id"], grows=True).withColumn("yc_result", nulls.ind(F.col("value") == v.POSITIVE))
    return one_random_row(rows, "id", ["visit", "site"], seed) if random_one else rows


def trend_frame(study: Study) -> DataFrame:
    """Visit rows with month number and baseline covariates."""
    covs = ["age_cat", "age", "ethnic_group_cat", "edu", "registered"]
    base = study.baseline.select(F.col(v.ID).alias("id"), *covs)
    return attach(study.behaviour, base, ["id"], grows=True).withColumn("visit_num", recode.lookup("visit", v.VISIT_MONTH))


def lookup_keys(lookup: DataFrame) -> DataFrame:
    """Sample list with visit labels brought to the study's names."""
    visit = F.col("visit").cast("string")
    return lookup.withColumn("visit", F.when(visit == "screen", "scr").otherwise(F.concat(F.lit("m"), visit)))
