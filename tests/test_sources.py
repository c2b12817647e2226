import pytest
from pyspark.sql import functions as F

from chronomotif.sources import events, nets, reports, tables


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_events_and_types(spark, tmp_path):
    path = written(tmp_path, "e.dat", "10 0 1 2\n\n12\t3  2 3 4\n11 0 5 6  \n")
    rows = [tuple(r) for r in events.read_events(spark, path).orderBy("event_id").collect()]
    assert rows == [(0, 10, 10, 1, 2, 1), (1, 11, 11, 5, 6, 1), (2, 12, 15, 2, 3, 4)]
    assert [r["start"] for r in events.read_events(spark, path, assume_sorted=True).orderBy("event_id").collect()] == [10, 12, 11]
    with pytest.raises(Exception, match="not an event"):
        events.read_events(spark, written(tmp_path, "bad.dat", "1 0 2 2\n")).collect()
    types = events.read_node_types(spark, written(tmp_path, "t.dat", "1 5\n2 6\n1 7\n"))
    assert {r["node"]: r["ntype"] for r in types.collect()} == {1: 7, 2: 6}
    told = events.read_type_descriptions(spark, written(tmp_path, "d.txt", '#NODES\n1 "red node" r red\n2 blue b blue\n#EVENTS\n7 call c black grey\n'))
    assert {(r["kind"], r["id"], r["name"], r["edge_colour"]) for r in told.collect()} == {("node", 1, "red node", None), ("node", 2, "blue", None), ("event", 7, "call", "grey")}


def test_reports(spark, tmp_path):
    rows = [(3, 1.5, 2.0, None, None, None, 0.0, 4, 2, None, "[0,0] 0>1:1"), (9, 1.0, 9.0, 0.5, 3, 1, 2.0, 7, 2, 1.5, "[0,0,0] 0>1:1 0>2:1")]
    from chronomotif.schema import REPORT

    df = spark.createDataFrame(rows, REPORT)
    path = str(tmp_path / "report")
    reports.write_report(df, path)
    assert sorted(map(str, reports.read_report(spark, path).collect())) == sorted(map(str, df.collect()))
    parts = reports.read_sections(spark, written(tmp_path, "all.tmf", "#NODES\n1 a\n#EVENTS\n2 b\n#MOTIFS\nx\ny\n"))
    assert [parts[k].count() for k in ("nodes", "events", "motifs")] == [1, 1, 2]


def test_tables(spark, tmp_path):
    df = tables.read_columns(spark, written(tmp_path, "c.txt", "id x name\n1 2.5 a\n2 3 b\n"), header=True)
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("name", "string")]
    assert tables.read_columns(spark, written(tmp_path, "d.txt", "1,2\n3,4\n"), columns=[1], sep=",", fun=lambda c: c * 2).collect() == [(4,), (8,)]


@pytest.mark.parametrize("fmt", ["edg", "gml", "mat"])
def test_networks_come_back(spark, tmp_path, fmt):
    g = nets.Graph.of(spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.5), (1, 0, 1.0), (3, 3, 1.0)], "u long, v long, w double"))
    path = str(tmp_path / "net")
    nets.write_net(g, path, fmt)
    back = nets.load_net(spark, path, fmt)
    assert {(int(r["u"]), int(r["v"]), r["w"]) for r in back.edges.collect()} == {(0, 1, 3.0), (1, 2, 1.5)}


def test_other_formats(spark, tmp_path):
    g = nets.Graph.of(spark.createDataFrame([("a", "b", 2.0)], "u string, v string, w double"))
    nets.write_net(g, str(tmp_path / "p"), "net")
    assert "*Edges" in [r[0] for r in spark.read.text(str(tmp_path / "p")).collect()]
    nets.write_net(g, str(tmp_path / "q"), "adj")
    assert {r[0] for r in spark.read.text(str(tmp_path / "q")).collect()} == {"a b", "b a"}
    with pytest.raises(NotImplementedError):
        nets.load_net(spark, "x.net")
    with pytest.raises(ValueError):
        nets.load_net(spark, "x.foo")
    mutual = nets.read_edg(spark, written(tmp_path, "m.edg", "a b 1\nb a 2\na c\n"), mutual=True)
    assert [tuple(r) for r in mutual.edges.collect()] == [("a", "b", 3.0)]
    upper = nets.read_matrix(spark, written(tmp_path, "u.mat", "1 2\n3\n"), "supperdiag")
    assert {tuple(r) for r in upper.edges.collect()} == {(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)}
    props = written(tmp_path, "p.txt", "node_label\tage\na\t3\nz\t4\n")
    assert nets.read_properties(spark, g, props).select("age").collect() == [(3,)]
    with pytest.raises(ValueError):
        nets.read_properties(spark, g, props, missing=False)
    comm = nets.read_communities(spark, written(tmp_path, "c.txt", "x\na b c\n"))
    assert {(r["node"], r["comm"]) for r in comm.collect()} == {("a", 0), ("b", 0), ("c", 0), ("x", 1)}
    assert comm.filter(F.col("comm") == 0).count() == 3


def test_errors_name_line_and_column(spark, tmp_path):
    """Lines count from 1, blank ones and those skipped included, over all splits of the file."""
    path = tmp_path / "table.txt"
    path.write_text("a b c\n\n" + "".join(f"{k} {k}.5 x\n" for k in range(3000)) + "7 many x\n")
    good = tables.read_columns(spark, str(path), ["a", "c"], ["long", "string"], header=True)
    assert good.count() == 3001 and good.schema["a"].dataType.simpleString() == "bigint"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        with pytest.raises(Exception, match=r"line 3003, column 2 \(b\): many is no double"):
            tables.read_columns(spark, str(path), ["a", "b"], ["long", "double"], header=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
