"""Rows per participant never go through the driver, and a query fits only the models it returns."""

import pytest

from panelwise.catalog import QUERIES, study_models
from panelwise.catalog.whole import study_sheet
from panelwise.operators import gee, glm
from panelwise.plans import prep, reports
from panelwise.session import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    s = prep.prepare(study_sheet(spark, FOLDER))
    return prep.Study(*(written(getattr(s, n)) for n in ("baseline", "behaviour", "sti", "swab")))


FRAMES = {
    "swab_with_answers": prep.swab_with_answers,
    "predictor_frame": prep.predictor_frame,
    "one_random_row": lambda s: prep.predictor_frame(s, random_one=True),
    "trend_frame": prep.trend_frame,
    "rates": lambda s: reports.one_row_screen(s, only=("rates",))["rates"],
}


@pytest.mark.parametrize("name", FRAMES)
def test_tables_of_participants_are_not_broadcast(spark, study, name):
    df = FRAMES[name](study)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_only_the_named_parts_are_computed(study, monkeypatch):
    calls = []
    monkeypatch.setattr(gee, "fit_gee", lambda rows, m, *a, **k: calls.append(m.name) or rows.limit(0).selectExpr("1D AS estimate", "1D AS std_error", "'' AS model"))
    monkeypatch.setattr(glm, "fit_glm", lambda *a, **k: pytest.fail("not asked for"))
    monkeypatch.setattr(reports, "discover_levels", lambda *a, **k: pytest.fail("not asked for"))
    assert list(reports.log_trends(study, only=("gee_partner",))) == ["gee_partner"] and calls == ["reports_main_partner"]
    assert list(reports.one_row_screen(study, only=("rates",))) == ["rates"]


@pytest.mark.parametrize("part", ["rates", "chisq", "fisher", "glm"])
def test_one_row_queries_read_their_rows_alone(spark, monkeypatch, part):
    frames = []

    def screen(rows, *args, **options):
        frames.append(rows)
        return reports_screen(rows, *args, **options)

    reports_screen = reports.screen_rows
    monkeypatch.setattr(reports, "screen_rows", screen)
    monkeypatch.setattr(study_models, "write_tables", lambda *a: pytest.fail("the study's other tables are not needed"))
    assert QUERIES[f"study_one_row_{part}"](spark, FOLDER).count()
    text = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text and "Exchange" not in text
