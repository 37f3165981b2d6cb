"""Sources over small texts, and scored cells, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from envspark.operators import aggregates, nowcast, significance
from envspark.sources import documents


def test_station_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("place,y,x,when,temperature,humidity\nA,60,25,2024-01-01T02:00:00+02:00,1.5,\nB,61,26,2024-01-01 00:00:00Z,x,80\n")
    got = documents.read_station_csv(spark, str(path)).select("location", "lat", "lon", F.unix_seconds("time"), "parameter", "value").collect()
    assert sorted(map(tuple, got), key=str) == [
        ("A", 60.0, 25.0, 1704067200, "humidity", None), ("A", 60.0, 25.0, 1704067200, "temperature", 1.5),
        ("B", 61.0, 26.0, 1704067200, "humidity", 80.0), ("B", 61.0, 26.0, 1704067200, "temperature", None),
    ]
    documents.write_station_csv(documents.read_station_csv(spark, str(path)), str(tmp_path / "out"))
    again = spark.read.csv(str(tmp_path / "out"), header=True)
    assert again.columns == ["location", "lat", "lon", "time", "parameter", "value"] and {r.time for r in again.collect()} == {"2024-01-01T00:00:00Z"}
    assert documents.read_station_csv(spark, str(path)).limit(0).count() == 0


@pytest.mark.parametrize("row", ["A,60,25,2024-01-01T02:00:00,1", "A,north,25,2024-01-01T02:00:00Z,1", "A,60,25"])
def test_bad_station_rows_fail(spark, tmp_path, row):
    (tmp_path / "b.csv").write_text("place,y,x,when,t\n" + row + "\n")
    with pytest.raises(Exception, match="valid|[Mm]alformed"):
        documents.read_station_csv(spark, str(tmp_path / "b.csv")).collect()


def test_notifications(spark):
    head = '{"type": "Feature", "id": "1", "conformsTo": ["http://wis.wmo.int/spec/wnm/1/conf/core"], '
    props = '"properties": {"data_id": " d ", "pubtime": "2024-01-01T00:00:00Z", "content": {"size": 3}}, '
    links = '"links": [{"rel": "update", "href": "u"}, {"rel": " Canonical", "href": " c "}, {"rel": "deletion", "href": "x"}, {"rel": "canonical"}]}'
    good, other = head + props + links, (head + props + links).replace('"Feature"', '"Other"')
    rows = [("cache/a/wis2/fi/data", good), ("x", other), ("x", good.replace('" d "', '" "')), ("x", good.replace("00Z", "00")), ("x", good.replace("wnm/1", "y")), ("x", "no"), ("x", None)]
    got = documents.notifications(spark.createDataFrame(rows, "topic string, payload string")).collect()
    assert [(r.centre_id, r.id, r.data_id, r.is_deletion, r.link) for r in got] == [("fi", "1", "d", True, "c")]
    assert list(got[0].extras) == ["content"]


def test_message_index(spark):
    lines = ["# note", "1:0:d=2024010100:TMP:2 m above ground:anl:", "2:10:d=2024010100:APCP:surface:0-3 hour acc fcst:", "3:25:d=2024010100:X:surface:3-0 hour acc fcst:",
             "4:40:d=2024010100:TMP:surface:90 min fcst:", "5:50:d=2024010100:TMAX:surface:0-6 hour max fcst:", "bad", "", "6:x:d=2024010100:A:b:anl:"]
    rows = [("a", x) for x in lines] + [("b", "1:0:d=2024010100:T:s:anl:"), ("b", "2:5:d=2024010106:T:s:anl:")]
    got = documents.message_index(spark.createDataFrame(rows, "file string, value string")).orderBy("offset").collect()
    assert [(r.file, r.record, r.offset, r.length, r.parameter, r.step, r.kind, r.window_start) for r in got] == [
        ("a", 1, 0, 10, "TMP", 0, "instant", None), ("a", 2, 10, 15, "APCP", 3, "acc", 0), ("a", 4, 40, 10, "TMP", 1, "instant", None), ("a", 5, 50, None, "TMAX", 6, "max", 0),
    ]


def test_alert_documents(spark):
    text = """<alert xmlns="urn:x"><identifier>i</identifier><sender>s</sender><sent>2024-01-01T00:00:00+00:00</sent><info><language>fi</language><onset>2024-01-01T05:00:00+00:00</onset>
 <expires>2024-01-01T09:00:00+00:00</expires><area><areaDesc>a</areaDesc><geocode><valueName>N</valueName><value>1</value></geocode></area></info>
 <info><language>sv</language><area><areaDesc>b</areaDesc></area><area><areaDesc>c</areaDesc></area></info></alert>"""
    rows = documents.alerts(spark.createDataFrame([(text,), (text.replace("<sender>s</sender>", ""),), (None,)], "value string"))
    got = rows.select("info", "area", "language", "area_desc", F.unix_seconds("start"), F.unix_seconds("end")).orderBy("info", "area").collect()
    assert list(map(tuple, got)) == [(0, 0, "fi", "a", 1704085200, 1704099600), (1, 0, "sv", "b", 1704067200, None), (1, 1, "sv", "c", 1704067200, None)]


def test_significance(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 0.0), (2, None, 1.0, 1.0), (3, 0.5, 0.0, 1.0)], "id int, g double, bonus double, cut double")
    terms = [significance.term("g", 0.5, F.col("g")), significance.term("b", 0.25, F.col("bonus"), bonus=True), significance.term("c", -0.9, F.col("cut"), bonus=True)]
    got = {r.id: r for r in significance.score(df, terms).collect()}
    assert got[1].score == pytest.approx(0.75) and [(x.term, x.value) for x in got[1].reasons] == [("g", 0.5), ("b", 0.25), ("c", 0.0)]
    assert got[2].score == 0 and got[2].reasons == []  # nothing graded, so bonuses fill nothing
    assert got[3].score == pytest.approx(0.05) and [x.term for x in got[3].reasons] == ["g", "c", "b"]
    assert [r.id for r in significance.most_significant(significance.score(df, terms), 2, "id").collect()] == [1, 3]


def test_common_skill_has_one_sample(spark):
    grid = lambda rows: spark.createDataFrame(rows, "frame int, row_idx int, col_idx int, value double")
    seen, said, still = grid([(1, 0, 0, 30.0), (1, 0, 1, 30.0)]), grid([(1, 0, 0, 30.0)]), grid([(1, 0, 0, 10.0), (1, 0, 1, 30.0)])
    got = {r.method: (r.hits, r.misses, r.false_alarms) for r in nowcast.common_skill({"a": said, "b": still}, seen, [20]).collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 1, 0)}


def test_severity_cells_take_the_highest(spark):
    rows = [(0.0, 0.0, 2.0, 1.0, 1), (1.0, 0.0, 2.0, 2.0, 3), (0.1, 0.1, 0.2, 0.2, 4)]
    got = aggregates.severity_cells(spark.createDataFrame(rows, "west double, south double, east double, north double, severity int"), 0.0, 0.0, 1.0).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1), (0, 1, 3), (1, 1, 3)]


def test_motion_vectors(spark):
    v = spark.createDataFrame([(0, 0, 0, -1.0, 1.0, True)], "frame int, block_row int, block_col int, d_row double, d_col double, measured boolean")
    r = nowcast.motion_vectors(v, 10, 20.0, 60.5, 0.1, 0.1, 100, 100, 300.0).first()
    assert (r.lon, r.lat, r.quality) == (20.5, 60.0, 1.0)
    assert r.v == pytest.approx(37.0649, abs=1e-3) and r.u == pytest.approx(18.5325, abs=1e-3)
