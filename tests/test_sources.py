import pytest
"""XES files with all their attributes, and the presets' clean-up."""

import datetime

from pyspark.sql import functions as F

from altertrace.sources import results
from altertrace.schema import PRESETS, LogSchema, Preset, limited, subset
from altertrace.sources import logs, xes

LOG = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
  <extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
  <global scope="event"><string key="concept:name" value="__INVALID__"/></global>
  <trace>
    <string key="concept:name" value="c1"/><int key="label" value="1"/><string key="RequestedAmount" value="1,5"/>
    <event>
      <string key="concept:name" value="A_start"/><date key="time:timestamp" value="2020-01-01T10:00:00.000+00:00"/>
      <string key="lifecycle:transition" value="COMPLETE"/><int key="n" value="3"/><float key="x" value="1.5"/><boolean key="ok" value="true"/><id key="uid" value="u-1"/>
      <string key="place" value="here"><int key="floor" value="2"/></string>
      <list key="parts"><values><string key="p" value="one"/></values></list>
      <int key="odd" value="7"/><int key="n" value="4"/>
    </event>
    <event>
      <string key="concept:name" value="W_work"/><date key="time:timestamp" value="2020-01-01T11:00:00.000+00:00"/><date key="due" value="2020-02-01T00:00:00.000+00:00"/>
      <string key="lifecycle:transition" value="START"/><float key="n" value="2.5"/><string key="odd" value="many"/><container key="box"><float key="w" value="2"/></container>
    </event>
  </trace>
  <trace>
    <string key="concept:name" value="c2"/><int key="label" value="0"/><string key="RequestedAmount" value=" "/>
    <event><string key="concept:name" value="O_offer"/><date key="time:timestamp" value="2020-01-02T10:00:00.000+00:00"/><string key="lifecycle:transition" value="COMPLETE"/></event>
  </trace>
</log>"""


def test_all_attributes_are_read_and_typed(spark, tmp_path):
    (tmp_path / "log.xes").write_text(LOG)
    df = xes.read_xes(spark, str(tmp_path))
    kinds = dict(df.dtypes)
    assert kinds["n"] == kinds["x"] == kinds["box/w"] == "double" and kinds["ok"] == "boolean" and kinds["due"] == "timestamp"
    assert kinds["odd"] == kinds["uid"] == "string" and kinds["place/floor"] == kinds["case:label"] == "bigint"
    rows = {(r["case:concept:name"], r["pos"]): r for r in df.collect()}
    first, second = rows["c1", 0], rows["c1", 1]
    assert (first["n"], first["x"], first["ok"], first["uid"], first["place/floor"], first["parts/p"], first["odd"]) == (3.0, 1.5, True, "u-1", 2, "one", "7")
    assert (second["n"], second["odd"], second["box/w"], second["due"], second["place"]) == (2.5, "many", 2.0, datetime.datetime(2020, 2, 1), None)
    assert rows["c2", 0]["case:label"] == 0 and len(rows) == 3


def test_a_value_that_is_not_of_its_kind_makes_a_text_column(spark, tmp_path):
    (tmp_path / "log.xes").write_text(LOG.replace('<int key="n" value="4"/>', '<int key="k" value="four"/>').replace('<float key="n" value="2.5"/>', '<int key="k" value="5"/>'))
    df = xes.read_xes(spark, str(tmp_path))
    assert dict(df.dtypes)["k"] == "string" and sorted(r["k"] for r in df.where("k IS NOT NULL").collect()) == ["5", "four"]


def test_presets_bind_outcomes_and_clean_up(spark, tmp_path):
    (tmp_path / "log.xes").write_text(LOG)
    got = logs.read_preset(spark, Preset(PRESETS["permit"].schema, format="xes", amounts_like="amount"), str(tmp_path)).collect()
    assert {(r["case_id"], r["pos"], r["outcome"], r["case:RequestedAmount"]) for r in got} == {("c1", 0, 1, 1.5), ("c1", 1, 1, 1.5), ("c2", 0, 0, None)}
    loan = logs.read_preset(spark, PRESETS["bpic12_xes"], str(tmp_path))
    assert [(r["case_id"], r["activity"]) for r in loan.collect()] == [("c1", "A_start")] and "lifecycle:transition" not in loan.columns
    assert logs.read_preset(spark, subset("bpic12_xes", ("O_",)), str(tmp_path)).count() == 1
    hospital = logs.read_preset(spark, PRESETS["hospital"], str(tmp_path))
    assert "due" not in hospital.columns and "ts" in hospital.columns
    few = logs.read_preset(spark, limited("sepsis_xes", 1), str(tmp_path), cases=spark.createDataFrame([("c1",), ("c2",), ("c2",)], "case_id string"))
    assert [r["case_id"] for r in few.collect()] == ["c2"]


def test_csv_presets_follow_the_order_of_their_schema(spark, tmp_path):
    (tmp_path / "log.csv").write_text("Case ID;Activity;Complete Timestamp;label;event_nr;Resource;AMOUNT_REQ\n1;b-COMPLETE;2020-01-01 00:00:00;1;2;r;5\n1;a-COMPLETE;2020-01-02 00:00:00;1;1;r;5\n")
    got = logs.read_preset(spark, PRESETS["dice4el"], str(tmp_path)).orderBy("pos").collect()
    assert [(r["activity"], r["pos"], r["outcome"]) for r in got] == [("a", 0, 1), ("b", 1, 1)]
    other = Preset(LogSchema(case="Case ID", activity="Activity", ts="Complete Timestamp", outcome="label", order=("Complete Timestamp",)))
    assert [r["activity"] for r in logs.read_preset(spark, other, str(tmp_path)).orderBy("pos").collect()] == ["b-COMPLETE", "a-COMPLETE"]


def test_result_files_keep_their_own_columns(spark, tmp_path):
    files = {
        "e1/runs/a.csv": 'id,"name, full",score\n1,"x, y",2.5\n2,,3\n',
        "e1/runs/b.csv": 'score,id\n9,7\n',
        "e2/other/c.csv": "id\n",
        "e2/other/d.csv": 'id,name\n5,"say ""hi"""\nid,name\n6,\n\n',
    }
    for name, text in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    got = results.collect_result_files(spark, str(tmp_path))
    rows = {(r["experiment_name"], r["wrapper_type"], r["filename"], r["id"], r["name, full"], r["name"], r["score"]) for r in got.collect()}
    assert rows == {
        ("e1", "runs", "a.csv", "1", "x, y", None, "2.5"), ("e1", "runs", "a.csv", "2", None, None, "3"),
        ("e1", "runs", "b.csv", "7", None, None, "9"), ("e2", "other", "d.csv", "5", None, 'say "hi"', None), ("e2", "other", "d.csv", "6", None, None, None),
    }
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        results.collect_result_files(spark, str(tmp_path / "none"))


def test_written_xes_is_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(logs, "TRACES_PER_FILE", 3, raising=False)
    log = spark.range(40).selectExpr("id div 4 AS case_id", "concat('a', id % 3) AS activity", "timestamp_seconds(id) AS ts", "id % 4 AS line", "IF(id % 4 = 1, NULL, id) AS amount", "100 - id AS total")
    path = str(tmp_path / "log")
    logs.write_event_log_xes(log, path, ["ts", "line"], {"line": "int", "amount": "int"}, {"total": "int"})
    parts = list((tmp_path / "log").glob("part-*"))
    assert parts and all(gzip.open(p).read().count(b"<trace>") <= 3 for p in parts)
    back = xes.read_xes(spark, path).collect()
    rows = sorted((int(r["case:concept:name"]), r["pos"], r["concept:name"], r["line"], r["amount"], r["case:total"]) for r in back)
    assert [r[:4] for r in rows] == [(i // 4, i % 4, f"a{i % 3}", i % 4) for i in range(40)]
    assert [r[4] for r in rows] == [None if i % 4 == 1 else i for i in range(40)]
    assert [r[5] for r in rows] == [100 - (i // 4 * 4 + 3) for i in range(40)]  # the smallest of the case


def test_parsed_attributes_are_written_with_zstd(spark, sf):
    import pyarrow.parquet as pq

    from altertrace.plans.tables import scratch_path
    from altertrace.queries import logs as q
    from altertrace.sources import logs, xes

    path, wide = scratch_path(spark, "xes-zstd"), q._wide_events(spark, sf)
    logs.write_event_log_xes(wide, path, ["ts", "line", "part", "supp"], q._XES_EVENT, q._XES_CASE)
    back = xes.read_xes(spark, path)
    parts = [pq.ParquetFile(f.removeprefix("file:")) for f in back.inputFiles()]
    assert {p.metadata.row_group(0).column(0).compression for p in parts} == {"ZSTD"}
    assert back.count() == wide.count()


def test_plain_texts_are_read_like_those_that_are_not():
    """The kernel over bytes and the parser give the same rows, of repeated and nested attributes too."""
    import numpy as np
    import pyarrow as pa

    from altertrace.functions import elements

    bodies = [
        '<trace><string key="concept:name" value="c1"/><int key="label" value=" 1 "/><event><string key="a" value="x>y"><int key="b" value="2"/></string>\n <int key="a/b" value="3"/></event>',
        '<trace><event><int key="n" value="7"/><string key="n" value="first"/><float key="n" value="2"/></event><event><date key="t" value="2020-02-30T00:00:00Z"/></event><string key="late" value=""><date key="d" value="no"/></string>',
        ' <trace><string key="p" value="1"><string key="p" value="2"/></string><event></event><event><id key="é" value="ü"/><boolean key="ok" value="true"></boolean></event>\n',
        "\n</log>",
    ]
    texts = [b.encode() for b in bodies]
    data, bounds = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    batch, odd = elements.plain(data, bounds)
    assert not odd.any() and batch.num_rows == 5

    def listed(rows):
        return [(sorted((k, tuple(v.values())) for k, v in r["case"]), r["pos"], sorted((k, tuple(v.values())) for k, v in r["event"])) for r in rows]

    assert listed(batch.to_pylist()) == listed([r for t in texts for x in elements.cut_traces(t + elements.END)[0] for r in elements.rows(x)])
    assert batch.column("unsure").to_pylist() == [False, True, True, False, False]  # one date is none, and one may be
    strange = ["<trace><event><string key='a' value='1'/></event>", '<trace><event><string key="a" value="1&amp;2"/></event>', '<trace><event><int key="a" value="1"/></evnt>', "<trace><!-- <event> -->"]
    texts = [texts[1], *(s.encode() for s in strange), texts[0]]
    data, bounds = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    batch, odd = elements.plain(data, bounds)
    assert odd.tolist() == [False, True, True, True, True, False] and batch.num_rows == 3
    read = [r for b in elements.read(iter([pa.array([t.decode() for t in texts])])) for r in b.to_pylist()]
    assert sorted(str(r["event"]) for r in read if len(r["event"]) == 1 and r["event"][0][0] == "a") == sorted(str([("a", {"kind": "string", "text": t})]) for t in ("1", "1&2"))


def test_xes_is_cut_behind_traces_wherever_a_comment_hides_an_end(spark, tmp_path):
    (tmp_path / "log.xes").write_text('<log><!-- <trace> --><trace><string key="concept:name" value="1"/><!-- a </trace> b --><event><int key="n" value="1"/></event></trace><trace/><trace><event><int key="n" value="x"/></event></trace ></log>')
    rows = xes.read_attributes(spark, str(tmp_path)).collect()
    assert sorted((r["case"].get("concept:name", ("",))[-1], tuple(r["event"]["n"])) for r in rows) == [("", ("string", "x")), ("1", ("int", "1"))]


def test_texts_of_any_characters_survive_xes(spark, tmp_path):
    texts = ['a & b <c> "d" \'e\'', "tab\there\nline", "é€😀", "plain", None]
    log = spark.createDataFrame([(i, f"a{i}", t, i) for i, t in enumerate(texts)], "case_id int, activity string, note string, line int").withColumn("ts", F.timestamp_seconds("line"))
    path = str(tmp_path / "log")
    logs.write_event_log_xes(log, path, ["line"], {"note": "string", "line": "int"}, {"note": "string"})
    back = xes.read_xes(spark, path).collect()
    assert {r["line"]: (r["note"], r["case:note"]) for r in back} == {i: (t, t) for i, t in enumerate(texts)}
    with pytest.raises(Exception, match="XML cannot hold"):
        logs.write_event_log_xes(log.withColumn("note", F.lit("\x01")), path, ["line"], {"note": "string"})


def test_xes_is_read_in_batches_and_its_columns_are_small_methods(spark, tmp_path):
    (tmp_path / "log.xes").write_text(LOG)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(xes.read_attributes(spark, str(tmp_path)))
    assert "MapInArrow" in found and "FileScan text" in found
    found = plan(xes.read_xes(spark, str(tmp_path)))
    assert "*(1) Project" not in found and "FileScan parquet" in found


def test_a_file_read_by_several_tasks_gives_every_trace_once(spark, tmp_path):
    body = "".join(f'<trace><string key="concept:name" value="{i}"/><event><int key="n" value="{i}"/></event><event><int key="n" value="-{i}"/></event></trace>\n' for i in range(200))
    (tmp_path / "log.xes").write_text(f'<?xml version="1.0"?>\n<log>\n{body}</log>')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        df = xes.read_attributes(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = sorted((int(r["case"]["concept:name"]["text"]), r["pos"], r["event"]["n"]["text"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [(i, p, f"{'-' * p}{i}") for i in range(200) for p in range(2)]
