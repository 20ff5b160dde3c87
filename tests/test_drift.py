import pytest

from squallframe.operators import drift as D

FIELDS = (("N", "int"), ("FAE", "double"), ("event_id", "string"), ("J_imex", "double"))


@pytest.mark.parametrize("text,kind,ok", [
    ("12", "int", True), ("+3", "int", True), ("12.0", "int", False), ("1e3", "int", False), ("", "int", True), (" NaN ", "int", True), ("1.5", "double", True), (".5", "double", True),
    ("5.", "double", True), ("-1e-3", "double", True), ("1,5", "double", False), ("~3", "double", False), ("7", "double", True), ("inf", "double", False), ("x", "string", True), ("N/A", "double", True), ("١", "int", False),
])
def test_fits(text, kind, ok):
    assert D.fits(text, kind) is ok


@pytest.mark.parametrize("text,value", [("1,5", 1.5), ("~12", 12), ("v0.25", 0.25), ("3 edges", 3), ("0.5*", 0.5), ("0x1F", 31), ("1.2e-3", 0.0012), ("1 234", 1234), ("1,234", 1234), ("0.25 (est)", 0.25), ("−4", -4), ("1.5 x 10^3", 1500), ("12%", 0.12)])
def test_readings(text, value):
    assert any(abs(v - value) < 1e-12 for v in D.readings(text))


def test_parse_oddities():
    names, rows = D.parse('﻿# remark\r\n\r\n "N" ; FAE ;x\r\n1;"2,5"\r\n#no\r\n;;;\r\n3;4;5;6\r\n')
    assert names == ["N", "FAE", "x"]
    assert rows == [["1", "2,5", ""], ["", "", ""], ["3", "4", "5"]]
    assert D.parse(None) == ([], []) and D.parse("  \n# only\n") == ([], [])


@pytest.mark.parametrize("values,kind,want", [
    (["1,287", "12", "217.0", "4.103e+03", "50 edges", "0x1F", "", "~9", "1,000", "-1,234,567", "2.5", "x"], "bigint", [1287, 12, 217, 4103, 50, 31, None, 9, 1000, -1234567, None, None]),
    (["9223372036854775807", "9223372036854775808", "1 234", "1'234"], "bigint", [9223372036854775807, None, 1234, 1234]), (["2147483648", "7"], "int", [None, 7]),
    (["1,234", "0,5", "na"], "double", [1.234, 0.5, None]), (["1,234", "1,234,567"], "double", [1234.0, 1234567.0]), (["v0.5", "0.25 (est)", "1*"], "double", [0.5, 0.25, 1.0]), ([" a ", "None"], "string", ["a", None]),
])
def test_casts(values, kind, want):
    assert D.cast_column(values, kind) == want


def test_versions_keep_their_numbers(spark, tmp_path):
    at = f"file://{tmp_path}/registry"
    bodies = [(1, "N,FAE,event_id,J_imex\n1,2,S1,3\n"), (2, "N,FAE,event_id\n1,2,S1\n"), (3, "N,FAE,event_id,J_imex\n1.0,2,S1,3\n")]
    key = lambda rows: {(r.print, r.steps): r.version for r in rows}
    _, raw, plans = report(spark, bodies[:2], [])
    first = key(D.keep_versions(plans, at).collect())
    assert len(first) == 2 and set(first.values()) == {1}
    _, raw, plans = report(spark, bodies, [])
    kept = D.keep_versions(plans, at)
    later = key(kept.collect())
    assert len(later) == 3 and all(later[k] == v for k, v in first.items()) and sorted(later.values()) == [1, 1, 2]
    assert key(D.keep_versions(plans, at).collect()) == later
    got = {r.file_id: (r.version, r.N, r.J_imex) for r in D.migrate(raw, plans, kept, FIELDS).collect()}
    assert got == {1: (1, 1, 3.0), 2: (1, 1, None), 3: (2, 1, 3.0)}
    assert {r.n_files for r in D.version_registry(plans, kept).collect()} == {1}


def report(spark, bodies, ref):
    raw = spark.createDataFrame(bodies, "file_id bigint, body string")
    reference = spark.createDataFrame(ref, "file_id bigint, line_no int, N int, FAE double, event_id string, J_imex double, line string, values string")
    plans = D.plan_migrations(raw, reference, FIELDS)
    return sorted((r.file_id, r.field_name, r.change_kind) for r in D.change_report(plans).collect()), raw, plans


def test_changes_per_file(spark, tmp_path):
    nan = float("nan")
    ref = []
    for f in range(1, 12):
        ref += [(f, 1, 10, 0.5, " s1_out", nan, "", ""), (f, 2, 20, None, "S1", 0.25, "", "")]
    bodies = [
        (1, "N,FAE,event_id,J_imex\n10,0.5,S1,\n20,na,S1,0.25\n"),
        (2, "n,fae,EVENT_ID, jay \n10,0.5,S1,nan\n20,,S1,0.25\n"),
        (3, "N,FAE,event_id,J\n10,0.5,S1,0.1\n20,,S1,0.3\n"),
        (4, "N,FAE,event_id\n10,0.5,S1\n20,,S1\n"),
        (5, "N;err;event_id;J_imex;Note\n10.0;\"0,5\";S1;;a\n20;;S1;0.25;b\n"),
        (6, "N,FAE,storm,J_imex\n10,0.5,S1,\n20,,s1_sweep,~0.25\n"),
        (7, ""), (8, None), (9, "N,FAE,event_id,J_imex,J_copy\n10,0.5,S1,,\n20,,S1,0.25,0.25\n"),
        (10, "N,FAE,event_id,J_imx,other\n10,0.5,S1,,\n20,,S1,0.25,0.25\n"), (77, "N,FAE,event_id,Jx\n1,2,3,4\n"),
    ]
    got, raw, plans = report(spark, bodies, ref)
    gone = [(k, n, "removed") for k in (7, 8) for n, _ in FIELDS]
    want = [(2, "J_imex", "renamed"), (3, "J_imex", "removed"), (3, "j", "added"), (4, "J_imex", "removed"), (5, "FAE", "renamed"), (5, "FAE", "retyped"), (5, "N", "retyped"), (5, "note", "added"), (6, "event_id", "renamed"), (6, "J_imex", "retyped"), (9, "j_copy", "added"), (10, "J_imex", "renamed"), (10, "other", "added"), (77, "J_imex", "removed"), (77, "jx", "added"), *gone]
    assert got == sorted(want)
    versions = D.keep_versions(plans, f"file://{tmp_path}/registry")
    table = {(r.file_id, r.line_no): (r.N, r.FAE, r.event_id, r.J_imex) for r in D.migrate(raw, plans, versions, FIELDS).collect()}
    assert table[2, 2] == (20, None, "S1", 0.25) and table[5, 1] == (10, 0.5, "S1", None) and table[6, 2] == (20, None, "s1_sweep", 0.25)
    assert table[4, 1] == (10, 0.5, "S1", None) and (7, 1) not in table
    versions = D.version_registry(plans, versions).collect()
    assert sum(v.n_files for v in versions) == len(bodies)


def test_all_missing_column_counts_as_renamed_only_without_better(spark):
    ref = [(1, 1, 5, None, "S1", None, "", "")]
    got, *_ = report(spark, [(1, "N,FAE,event_id,J2\n5,,S1,null\n")], ref)
    assert got == [(1, "J_imex", "renamed")]


def test_empty_tables(spark, tmp_path):
    got, raw, plans = report(spark, [], [])
    assert got == [] and D.migrate(raw, plans, D.keep_versions(plans, f"file://{tmp_path}/r"), FIELDS).count() == 0


def test_long_text(spark):
    body = "N,FAE,event_id,Q\n" + "".join(f"{i},0.5,S1,{i / 7!r}\n" for i in range(20000))
    ref = [(1, i + 1, i, 0.5, "S1", i / 7, "", "") for i in range(20000)]
    got, *_ = report(spark, [(1, body)], ref)
    assert got == [(1, "J_imex", "renamed")]
