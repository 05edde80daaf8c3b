import os

import pytest
from pyspark.sql import functions as F

from packetloom.sources import files, sinks


@pytest.fixture()
def csv_pair(tmp_path):
    packets = tmp_path / "p.csv"
    packets.write_text(
        "packet_index,timestamp,inter_arrival_time,src_ip,dst_ip,src_port,dst_port,protocol,ttl,ip_header_len,"
        "tcp_flags,udp_length,payload_length,packet_length,label\n"
        "0,1.5,,a,b,1,80,6,64,20,2.0,,10,52,\n1,2.5,1.0,a,c,1,80,6,64,20,,,20,62,\n2,3.5,1.0,b,c,1,1900,17,64,20,,28.0,20,62,\n"
    )
    labels = tmp_path / "l.csv"
    labels.write_text('"Unnamed: 0",x\n0,1\n1,0\n')
    return str(packets), str(labels)


def test_csv_pair(spark, csv_pair):
    rows = files.load_and_merge(spark, *csv_pair).orderBy("packet_index").collect()
    assert [(r.packet_index, r.label, r.udp_length) for r in rows] == [(0, 1, None), (1, 0, None), (2, 0, 28.0)]


def test_convert_with_row_cap(spark, csv_pair, tmp_path):
    out = str(tmp_path / "out")
    summary = files.export_summary(files.convert(spark, *csv_pair, out, max_rows=2, rows_per_file=1)).first()
    assert (summary.total_rows, summary.num_files, summary.largest, len(summary["columns"])) == (2, 2, 1, 15)
    back = files.read_by_manifest(spark, f"{out}/packets", f"{out}/manifest").orderBy("packet_index").collect()
    assert [(r.packet_index, r.label) for r in back] == [(0, 1), (1, 0)]


def test_missing_manifest_list(spark, tmp_path):
    os.makedirs(tmp_path / "m")
    (tmp_path / "m" / "part.json").write_text("\n")
    with pytest.raises(FileNotFoundError):
        files.read_by_manifest(spark, str(tmp_path), str(tmp_path / "m"))


def test_blank_and_broken_lines(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"packet_index": 1, "src_ip": "a"}\n\n   \n{broken\n{"packet_index": 2}\n')
    rows = files.read_packets_json(spark, str(path), keep_corrupt=True).collect()
    assert [r.packet_index for r in rows] == [1, None, 2]
    assert rows[1]._corrupt_record == "{broken"


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], "v").collect())) == [("a", 1), ("b", 9), ("c", 3)]


def windows(spark):
    return spark.range(100).selectExpr("id as window_id", "cast(id * 86400 as double) as window_start", "id % 3 as flow_id")


def test_retention(spark):
    assert sinks.retained(windows(spark)).count() == 91
    assert sinks.retained(windows(spark), now=200 * 86400).count() == 0


def test_compaction_keeps_all_rows(spark, tmp_path):
    path = str(tmp_path / "c")
    assert sinks.compacted(windows(spark).repartition(8), path).count() == 100
    days = [d for d in os.listdir(path) if d.startswith("day=")]
    assert len(days) == 92
    assert all(len([f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]) == 1 for d in days)


def test_window_table(spark, tmp_path):
    path = sinks.write_by_window(windows(spark).withColumn("window_id", F.col("window_id") * 100), str(tmp_path / "w"))
    assert sorted(d for d in os.listdir(path) if "=" in d)[0] == "window_bucket=0"
    assert spark.read.parquet(path).count() == 100
    sinks.write_by_window(windows(spark).limit(5), path)  # rewrites the first bucket only
    assert spark.read.parquet(path).where("window_bucket > 0").count() == 100 - 11
