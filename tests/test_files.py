"""Ledger files: what is read of odd ones, and commits that fail at any step."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ledger
from tallyforge.sources import ledgers, loaders, sinks

FITS = {"id": 1, "merchant": "a", "amount": 5, "date": "2024-01-05", "category": "belanja", "source": "manual", "notes": "", "saved_at": "2024-01-05T00:00:00"}
ODD = [3, "text", [1], None, {**FITS, "id": "x"}, {**FITS, "amount": "abc"}, {**FITS, "merchant": 7}, {**FITS, "date": ["2024"]}, {**FITS, "id": 1.5}]


def rows_of(spark, n, first=0):
    return spark.createDataFrame([(first + i, f"m{i}", 1.0, "", "belanja", "manual", "", "") for i in range(n)], ledgers.SCHEMA)


def ids(spark, path):
    return sorted(r["id"] for r in ledgers.read(spark, path).collect())


@pytest.mark.parametrize("text", ["", "{}", json.dumps(FITS), json.dumps({"transactions": [FITS]}), "[", '[{"id": 1}', '[{"id": 1},]', "[] []x", "null", "[]", "nonsense"])
def test_files_that_hold_no_record(spark, tmp_path, text):
    (tmp_path / "l.json").write_text(text)
    assert ledgers.scan(spark, str(tmp_path / "l.json")).collect() == []


def test_a_bad_record_costs_no_other(spark, tmp_path):
    good = [FITS, {"id": 2, "amount": "12.5"}, {"id": 3, "merchant": "é \"q\" [x]", "amount": None, "more": {"a": [1]}}]
    (tmp_path / "l.json").write_text(json.dumps([*ODD[:5], *good, *ODD[5:]], indent=2))
    got = ledgers.scan(spark, str(tmp_path / "l.json")).orderBy("place.row").collect()
    assert [r["bad"] is None for r in got] == [False] * 5 + [True] * 3 + [False] * 4 and [r["place"]["row"] for r in got] == list(range(12))
    kept = [r for r in got if r["bad"] is None]
    assert [(r["id"], r["merchant"], r["amount"]) for r in kept] == [(1, "a", 5.0), (2, None, 12.5), (3, "é \"q\" [x]", None)]
    assert [json.loads(r["bad"]) for r in got[4:5] + got[8:]] == ODD[4:]


def test_bad_records_are_written_back(spark, tmp_path):
    path = str(tmp_path / "l.json")
    (tmp_path / "l.json").write_text(json.dumps([FITS, *ODD, {**FITS, "id": 2}]))
    new = spark.createDataFrame([("Toko Baru", 9.0, "", "", "", "", "z")], "merchant string, amount double, date string, category string, source string, notes string, saved_at string")
    sinks.amend_ledger(spark, path, lambda rows: ledger.insert(ledger.delete(rows, rows.where("id = 1").select("id")), new))
    got = ledgers.scan(spark, path).orderBy("place").collect()
    assert [r["id"] for r in got if r["bad"] is None] == [2, 3] and len([r for r in got if r["bad"] is not None]) == len(ODD)
    assert got[-1]["merchant"] == "Toko Baru"  # what is new comes after what has a place
    assert json.loads((tmp_path / "l.json").read_text())[0] == FITS  # the file itself stays


@pytest.mark.parametrize("step", ["stage", "publish", "_renamed", "rename says no", "purge"])
def test_a_commit_that_fails_leaves_a_ledger(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "ledger")
    for k in range(3):
        sinks.replace_ledger(rows_of(spark, 2, 10 * k), path)

    def fails(*args):
        raise OSError("lost")

    if step == "rename says no":
        at = sinks._at

        class Refuses:
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                return (lambda *a: False) if name == "rename" else getattr(self.fs, name)

        monkeypatch.setattr(sinks, "_at", lambda spark, p: (at(spark, p)[0], Refuses(at(spark, p)[1])))
    else:
        monkeypatch.setattr(sinks, step, fails)
    with pytest.raises(OSError):
        sinks.replace_ledger(rows_of(spark, 3, 50), path)
    assert ids(spark, path) == ([50, 51, 52] if step == "purge" else [20, 21])
    monkeypatch.undo()
    sinks.replace_ledger(ledgers.read(spark, path).where("id % 2 = 0"), path)
    assert ids(spark, path) == ([50, 52] if step == "purge" else [20])


def test_two_writers_end_with_one_commit(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sinks.replace_ledger(rows_of(spark, 1), path)
    seen = ledgers.manifests(spark, path)
    mine, theirs = sinks.stage(rows_of(spark, 2), path), sinks.stage(rows_of(spark, 3), path)
    sinks.publish(spark, path, theirs, seen)
    with pytest.raises(FileExistsError):
        sinks.publish(spark, path, mine, seen)
    assert ids(spark, path) == [0, 1, 2]


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for k in range(5):
        before = ledgers.read(spark, path)
        sinks.replace_ledger(rows_of(spark, 1, k), path)
        assert ids(spark, path) == [k] and (k == 0 or [r["id"] for r in before.collect()] == [k - 1])  # who reads the last version still can
    assert len([p for p in (tmp_path / "ledger.versions").iterdir() if p.is_dir()]) == 2


def test_place_decides_and_stays(spark, tmp_path):
    path = str(tmp_path / "l.json")
    (tmp_path / "l.json").write_text(json.dumps([{**FITS, "saved_at": "9", "merchant": "first"}, {**FITS, "saved_at": "1", "merchant": "second"}] + [{**FITS, "id": k} for k in range(2, 300)]))
    change = spark.createDataFrame([(1, "hiburan")], "id long, category string")
    for _ in range(2):
        sinks.amend_ledger(spark, path, lambda rows: ledger.update_category(rows, change))
    got = ledgers.read(spark, path).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 1, *range(2, 300)] and [(r["merchant"], r["category"]) for r in got[:2]] == [("first", "hiburan"), ("second", "belanja")]


def test_parquet_has_places(spark, tmp_path):
    ledgers.write(rows_of(spark, 5).coalesce(1), str(tmp_path / "l.parquet"))
    assert [(r["place"]["row"], r["id"]) for r in ledgers.read(spark, str(tmp_path / "l.parquet")).orderBy("place").collect()] == [(i, i) for i in range(5)]


def test_menus_whose_names_begin_with_brackets(spark):
    menus = [[{"nm": "[promo] kopi", "cnt": "2", "price": "5.000"}, {"nm": ["es", "teh"], "price": ["1.000"]}, {"nm": "", "cnt": 1}], {"nm": "[x", "cnt": 3, "price": 12000}, "text", None, [1, {"nm": "a"}]]
    d = spark.createDataFrame([(i, json.dumps({"menu": m})) for i, m in enumerate(menus)] + [(9, "{"), (10, None)], "i int, gt string")
    got = {r["i"]: [(x["name"], x["quantity"], x["total_price"]) for x in r["m"] or []] for r in d.select("i", loaders.menu(F.col("gt")).alias("m")).collect()}
    assert got[0] == [("[promo] kopi", 2, 5000.0), ("es teh", got[0][1][1], 1000.0)] and got[1] == [("[x", 3, 12000.0)] and got[4][0][0] == "a" and not any(got[k] for k in (2, 3, 9, 10))
