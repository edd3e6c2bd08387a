"""Whole study: sheet in, every table, figure frame and model out.

usage: python -m panelwise.plans.study SHEET OUTPUT [parquet|csv]
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.reshape import duplicate_cells
from panelwise.plans import prep, reports, values
from panelwise.session import tune
from panelwise.sources.tables import read_sheet, write_tables


def prepared(spark: SparkSession, sheet: DataFrame, folder: str, options: prep.Options = prep.Options()) -> prep.Study:
    """Write the four analysis tables once and read them back.

    All reports start from these tables, so the reshape runs once and a lost
    executor costs a re-read instead of a recomputation.
    """
    study = prep.prepare(sheet, options)
    names = ("baseline", "behaviour", "sti", "swab")
    paths = write_tables({n: getattr(study, n) for n in names}, f"{folder}/prepared")
    return prep.Study(*(spark.read.parquet(p) for p in paths))


def all_reports(study: prep.Study, presence_rows: DataFrame | None = None) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}

    def add(name: str, frames: DataFrame | dict[str, DataFrame]) -> None:
        if isinstance(frames, DataFrame):
            out[name] = frames
        else:
            out.update({f"{name}_{k}": f for k, f in frames.items()})

    add("text", reports.text_results(study))
    add("table_one", reports.table_one(study.baseline))
    add("table_one_sampled", reports.table_one(reports.sampled_cohort(study)))
    add("table_two", reports.table_two(study))
    add("condoms", reports.condom_by_value(study))
    add("figure_condoms", reports.figure_condoms(study))
    add("figure_condoms_site", reports.figure_condoms(study, by_site=True, complement=False))
    add("figure_condoms_sampled", reports.figure_condoms(study, complement=False, sampled=True))
    add("figure_clients", reports.figure_clients(study))
    add("figure_clients_site", reports.figure_clients(study, by_site=True))
    add("figure_detection", reports.figure_detection(study))
    add("detection_grouped", reports.figure_detection(study, grouped=True))
    add("before_after", reports.before_after(study))
    add("repeats", reports.repeated_samples(study))
    add("sti", reports.sti_summary(study))
    add("sti_by_swab", reports.sti_by_swab(study))
    if presence_rows is not None:
        add("missingness", reports.missingness(study, presence_rows))
    add("trends", reports.trends(study))
    add("trends_unadjusted", reports.trends(study, adjusted=False))
    add("log_trends", reports.log_trends(study))
    add("baseline_predictors", reports.baseline_predictors(study))
    add("behaviour_predictors", reports.behaviour_predictors(study))
    add("one_row", reports.one_row_screen(study))
    return out


def check_sheet(sheet: DataFrame, folder: str) -> None:
    """Write participants with several rows, and stop if there are any: every table rests on one row per participant."""
    path = write_tables({"repeated_ids": prep.repeated_ids(prep.typed(sheet).where(F.col(values.ID).isNotNull()))}, f"{folder}/audit")[0]
    if sheet.sparkSession.read.parquet(path).limit(1).count():
        raise ValueError(f"participants with more than one row are listed in {path}")


def check_cells(study: prep.Study, folder: str) -> None:
    """Write visits that a participant has twice, and stop if there are any: relabelled samples may fall on a visit that has one.

    Two columns of one cell are found earlier, from the names of the sheet's columns alone (`question_grid`).
    """
    doubles = [duplicate_cells(t, ["id"], "visit").withColumn("table", F.lit(n)) for n, t in (("behaviour", study.behaviour), ("sti", study.sti), ("swab", study.swab))]
    path = write_tables({"double_cells": reduce(DataFrame.unionByName, doubles)}, f"{folder}/audit_cells")[0]
    if study.swab.sparkSession.read.parquet(path).limit(1).count():
        raise ValueError(f"visits that a participant has twice are listed in {path}")


def run(spark: SparkSession, sheet_path: str, folder: str, fmt: str = "parquet", options: prep.Options = prep.Options(),
        persons: DataFrame | None = None, sample_list: DataFrame | None = None) -> list[str]:
    """Check, prepare and report. With the outside lists of persons (id) and samples (id, visit) they are reconciled as well."""
    tune(spark)
    sheet = read_sheet(spark, sheet_path, fmt)
    check_sheet(sheet, folder)
    study = prepared(spark, sheet, folder, options)
    check_cells(study, folder)
    out = all_reports(study, prep.presence(sheet, options))
    if persons is not None and sample_list is not None:
        out.update({f"reconcile_{k}": f for k, f in reports.reconcile(study.swab, persons, sample_list).items()})
    return write_tables(out, f"{folder}/reports")


if __name__ == "__main__":
    session = SparkSession.builder.appName("panelwise-study").getOrCreate()
    print("\n".join(run(session, *sys.argv[1:4])))
