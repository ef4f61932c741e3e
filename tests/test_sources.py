import pytest
from conftest import T0, at, strike
from pyspark.sql import Observation

from stormlift.sources.readers import read_csv_checked, read_predictions, read_strikes, read_strikes_checked, stream_strikes, write_table
from stormlift.sources.schema import PREDICTIONS, STRIKES, check_contract, normalize


def test_normalize_reads_messy_text(spark):
    words = ["True", " false ", "TRUE", "", "x", None]
    rows = [("2024-06-01 12:00:00+00:00", "A", "1.0", "1", "2", "3", "4", w) for w in words]
    raw = spark.createDataFrame(rows, "date string, airport string, airport_alert_id string, dist string, azimuth string, "
                                      "amplitude string, maxis string, icloud string")  # fmt: skip
    out = normalize(raw)
    assert out.schema.names == STRIKES.names
    got = out.collect()
    assert [r.icloud for r in got] == [True, False, True, False, False, False]
    assert {r.airport_alert_id for r in got} == {1}
    assert got[0].lightning_id is None and got[0].is_last_lightning_cloud_ground is None


def test_missing_columns_are_named():
    with pytest.raises(ValueError, match="dist, azimuth"):
        check_contract(["date", "airport", "airport_alert_id", "amplitude", "maxis", "icloud"])


def test_rows_without_date_are_dropped(spark):
    raw = spark.createDataFrame(
        [("not a date", "A", 1, 1.0, 1.0, 1.0, 1.0, False)],
        "date string, airport string, airport_alert_id long, dist double, azimuth double, amplitude double, maxis double, icloud boolean",
    )
    assert normalize(raw).count() == 0


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_roundtrip_keeps_microseconds(spark, strikes, tmp_path, fmt):
    s = strikes(strike(1, 0.000001), strike(2, 3.5, alert=None, ic=True))
    write_table(s, str(tmp_path / fmt), fmt)
    back = read_strikes(spark, str(tmp_path / fmt), fmt).orderBy("lightning_id").collect()
    assert [r.date.replace(tzinfo=None) for r in back] == [at(0.000001).replace(tzinfo=None), at(3.5).replace(tzinfo=None)]
    assert [r.airport_alert_id for r in back] == [1, None]
    assert [r.icloud for r in back] == [False, True]


def test_row_cap_is_explicit(spark, strikes, tmp_path):
    write_table(strikes(*[strike(i, i) for i in range(10)]), str(tmp_path / "t"))
    assert read_strikes(spark, str(tmp_path / "t"), "parquet").count() == 10
    assert read_strikes(spark, str(tmp_path / "t"), "parquet", rows=3).count() == 3


def test_partitioned_sink(spark, strikes, tmp_path):
    write_table(strikes(strike(1, 0), strike(2, 1, airport="B")), str(tmp_path / "p"), by=["airport"])
    assert sorted(p.name for p in (tmp_path / "p").glob("airport=*")) == ["airport=A", "airport=B"]


def test_corrupt_lines_are_kept(spark, tmp_path):
    head = ",".join(STRIKES.names)
    (tmp_path / "s.csv").write_text(
        head + "\n1,1,2024-06-01 12:00:00,1,1,1,1,false,1,1,A,1,true\n2,1,2024-06-01 12:00:00,1,1,1,1,false,bad,1,A,1,true\n"
    )
    got = read_csv_checked(spark, str(tmp_path / "s.csv")).collect()
    assert [r._corrupt_record is None for r in got] == [True, False]
    assert "bad" in got[1]._corrupt_record


def test_rejected_rows_are_kept_and_counted(spark, tmp_path):
    head = "lightning_id,date,airport,airport_alert_id,dist,azimuth,amplitude,maxis,icloud"
    lines = [head, "1,2024-06-01 12:00:00,A,3,1.5,2,3,4,False", "2,yesterday,A,3,1,2,3,4,True", "3,2024-06-01 12:00:00,,3,1,2,3,4,True", "4,2024-06-01", "5,2024-06-01 13:00:00,B,,x,2,3,4,maybe", "6,2024-06-01 12:00:00,A,3,1,2,3,4,True,extra"]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    counts = Observation("rows")
    good, rejected = read_strikes_checked(spark, str(tmp_path / "s.csv"), counts=counts)
    assert sorted((r["lightning_id"], r["dist"], r["icloud"]) for r in good.collect()) == [(1, 1.5, False), (5, None, False)]
    assert {r["lightning_id"]: r["reason"] for r in rejected.collect()} == {"2": "date", "3": "airport", "4": "malformed", "6": "malformed"}
    assert counts.get == {"n": 6, "rejected": 4}
    assert sorted(r["reason"] for r in rejected.select("reason").collect()) == ["airport", "date", "malformed", "malformed"]  # whatever is read of a row
    with pytest.raises(ValueError, match="lacks columns"):
        read_strikes_checked(spark, str(tmp_path / "s.csv"), columns=["date"])


def test_predictions_and_streams_are_read_by_their_schemas(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, T0, T0, 0.5)], PREDICTIONS)
    write_table(rows, str(tmp_path / "p"), "csv")
    assert read_predictions(spark, str(tmp_path / "p")).collect() == rows.collect()
    strikes = spark.createDataFrame([(1, None, T0, 1.0, 2.0, 3.0, 4.0, True, 5.0, 6.0, "A", 7, None)], STRIKES)
    write_table(strikes, str(tmp_path / "s"))
    stream = stream_strikes(spark, str(tmp_path / "s"), files_per_batch=1)
    assert stream.isStreaming and stream.schema == STRIKES.__class__([type(f)(f.name, f.dataType) for f in STRIKES.fields])
    query = stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("streamed").collect() == strikes.collect()
