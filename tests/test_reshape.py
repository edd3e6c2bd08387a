import pytest
from helpers import bag, table
from pyspark.sql import functions as F

from panelwise.operators import reshape
from panelwise.sources import tables as src

COLUMNS = ["F14_j0_q03Clients", "F14_m1_q03Clients", "F14_j0_q05aResult", "F14_m1_q05aResult"]


def wide(frame):
    return frame([(1, "A", "3", None, "pos", "neg"), (2, "B", None, None, None, "pos")],
                 "id int, site string, " + ", ".join(f"{c} string" for c in COLUMNS))


def test_key_parsing(frame):
    df = frame([("F14_j0_q03Clients",), ("F14_m12_q05aResult",), ("plain",)], "key string")
    out = table(df.select("key", reshape.visit_token("key"), reshape.variable_name("key")), "key")
    assert out == {"F14_j0_q03Clients": ("j0", "Clients"), "F14_m12_q05aResult": ("m12", "aResult"), "plain": ("plain", "plain")}


def test_lab_key_parsing(frame):
    df = frame([("ychromoscr",), ("ychromom12date",)], "key string")
    out = table(df.select("key", reshape.lab_kind("key"), reshape.lab_visit("key")), "key")
    assert out == {"ychromoscr": ("value", "scr"), "ychromom12date": ("date", "m12")}


def test_direct_visit_rows_equal_unpivot_then_pivot(frame):
    df = wide(frame)
    direct = reshape.visits_from_wide(df, ["id", "site"], reshape.question_grid(COLUMNS, {"j0": "scr"}))
    long = reshape.unpivot_wide(df, ["id", "site"]).select(
        "id", "site", F.when(reshape.visit_token("key") == "j0", "scr").otherwise(reshape.visit_token("key")).alias("visit"),
        reshape.variable_name("key").alias("variable"), "value")
    via = reshape.pivot_long(long, ["id", "site", "visit"], ["Clients", "aResult"])
    assert direct.columns == ["id", "site", "visit", "Clients", "aResult"]
    assert bag(direct) == bag(via.select(direct.columns))
    assert reshape.duplicate_cells(long, ["id", "site", "visit"]).count() == 0
    assert "Exchange" not in direct._jdf.queryExecution().toString()


def test_colliding_columns_are_refused(frame):
    with pytest.raises(ValueError, match="share a cell"):
        reshape.question_grid(["F14_j0_q03Clients", "F14_scr_q03Clients"], {"j0": "scr"})
    long = frame([(1, "scr", "v", "a"), (1, "scr", "v", "b")], "id int, visit string, variable string, value string")
    assert table(reshape.duplicate_cells(long, ["id", "visit"]), "id", "visit", "variable") == {(1, "scr", "v"): 2}


def test_presence_matches_exact_visit(frame):
    cols = ["F01_m1_h00VisitDate", "F01_m12_h00VisitDate", "F21_m12_h00VisitDate"]
    df = frame([(1, "d", None, "d"), (2, None, "43210", None)], "id int, " + ", ".join(f"{c} string" for c in cols))
    dates = reshape.presence_columns(df.columns, ["m1", "m12"], form={"m12": "F01"})
    assert dates == {"m1": cols[0], "m12": cols[1]}
    assert table(reshape.presence_long(df, ["id"], dates), "id", "visit") == {(1, "m1"): 1, (1, "m12"): 0, (2, "m1"): 0, (2, "m12"): 1}
    assert table(reshape.presence_flags(df, dates).select("id", "presence_m1", "presence_m12"), "id") == {1: (1, 0), 2: (0, 1)}
    with pytest.raises(ValueError):
        reshape.presence_columns(df.columns, ["m12"])


def test_pattern_selection_and_round_trip(frame, spark, tmp_path):
    df = wide(frame)
    assert src.select_by_pattern(df, ["id"], ["Clients"]).columns == ["id", *COLUMNS[:2]]
    assert [r[0] for r in src.list_columns(df, "Result").collect()] == COLUMNS[2:]
    paths = src.write_tables({"a": df}, str(tmp_path / "p")) + src.write_tables({"b": df}, str(tmp_path / "c"), "csv")
    assert bag(src.read_sheet(spark, paths[0])) == bag(df)
    text = src.read_sheet(spark, paths[1], "csv")
    assert set(dict(text.dtypes).values()) == {"string"}
    assert table(src.read_lookup(spark, paths[1], ["site"], "csv"), "site").keys() == {"A", "B"}


def test_a_failed_run_leaves_the_former_set(frame, spark, tmp_path):
    folder = str(tmp_path / "set")
    good = frame([(1, "a"), (2, "b")], "k int, v string")
    assert src.read_tables(spark, folder) == {}
    first = src.write_tables({"x": good, "y": good.where("k > 1")}, folder)
    bad = good.select("k", F.raise_error(F.lit("stopped in the middle")).cast("string").alias("v"))
    with pytest.raises(Exception, match="stopped in the middle"):
        src.write_tables({"x": good.limit(0), "y": bad, "z": good}, folder)
    now = src.read_tables(spark, folder)
    assert {n: bag(d) for n, d in now.items()} == {"x": bag(good), "y": bag(good.where("k > 1"))}
    assert len(list((tmp_path / "set").glob("version-*"))) == 1
    second = src.write_tables({"z": good}, folder, "csv")
    assert list(src.read_tables(spark, folder)) == ["z"] and src.read_tables(spark, folder)["z"].count() == 2
    assert not any((tmp_path / "set" / p.split("/")[-2]).exists() for p in first) and second[0].endswith("/z")
