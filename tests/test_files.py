"""Readers, sinks, ledgers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import evaluate as V
from vigil.operators import prompts as P
from vigil.operators import signals as G
from vigil.plans import agent as A
from vigil.plans import detectors as D
from vigil.sources import files as S
from vigil.sources.tables import written
from vigil.streaming import incremental as I


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_listed_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for name in ("001_A_x.csv", "002_B_y.csv"):
        (tmp_path / "data" / name).write_text("Data,Label\n1.5,0\n2.5,1\n")
    (tmp_path / "list.csv").write_text("file_name\n002_B_y.csv\n003_C_z.csv\n")
    got = S.read_listed(spark, str(tmp_path / "list.csv"), str(tmp_path / "data"))
    assert rows(got.select("file_name", "category", "value", "label")) == [("002_B_y.csv", "B", 1.5, 0), ("002_B_y.csv", "B", 2.5, 1)]


def test_results_are_collected_and_parsed(spark, tmp_path):
    (tmp_path / "r" / "m1").mkdir(parents=True)
    lines = [{"custom_id": "a", "response": '[{"start": 1, "end": 2}]'}, {"custom_id": "b", "response": "no"}]
    (tmp_path / "r" / "m1" / "0shot.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    (tmp_path / "r" / "m1" / "0shot_requests.jsonl").write_text(json.dumps(lines[0]) + "\n")
    got = S.parsed_results(S.read_results(spark, str(tmp_path / "r")), P.parse_intervals).orderBy("custom_id").collect()
    assert [(r["model"], r["variant"], r["custom_id"]) for r in got] == [("m1", "0shot", "a"), ("m1", "0shot", "b")]
    assert got[0]["intervals"][0]["end"] == 2 and got[1]["intervals"] is None


def test_sinks_append_and_overwrite(spark, tmp_path):
    one = spark.createDataFrame([("d", "s", "m", 0.5, "ok", "1")], "dataset string, signal_id string, model string, f1_max double, status string, timestamp string")
    full = one.select(*(F.col(c) if c in one.columns else F.lit(None).cast("double").alias(c) for c in [p.split()[0] for p in S.PROGRESS.split(", ")]))
    for _ in range(2):
        S.write_progress(full, str(tmp_path / "p"))
        S.write_json_lines(one, str(tmp_path / "j"))
    assert S.read_progress(spark, str(tmp_path / "p")).where("f1_max = 0.5").count() == 2
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    found = spark.createDataFrame([("s", 0.1, 1, 2), ("s", 0.01, 1, 1)], "series_id string, alpha double, start long, end long")
    for _ in range(2):
        S.write_intervals(found, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).where("alpha = 0.1").count() == 1


def test_batch_requests(spark):
    body = F.struct(F.lit("hi").alias("messages"), F.lit(0.4).alias("temperature"))
    got = S.batch_requests(spark.range(2).select(F.col("id").alias("idx"), body.alias("body")), "d", "m", "v").orderBy("custom_id").collect()
    assert [r["custom_id"] for r in got] == ["d_m_v_00000", "d_m_v_00001"]
    line = json.loads(got[1]["line"])
    assert line["custom_id"] == "d_m_v_00001" and line["body"] == {"model": "m", "messages": "hi", "temperature": 0.4}


def test_summary_takes_the_latest_good_row(spark):
    shape = "dataset string, signal_id string, model string, f1_max double, precision double, recall double, affi_f1 double, status string, timestamp string"
    data = [
        ("A", "x", "m", 0.2, 0.1, 0.1, 0.1, "ok", "2024-01-01"), ("A", "x", "m", 0.6, 0.5, None, 0.7, "ok", "2024-01-02"),
        ("A", "x", "m", 0.9, 0.9, 0.9, 0.9, "error", "2024-01-03"), ("A", "y", "m", 1.0, 0.5, 0.5, 0.5, "ok", "2024-01-01"),
    ]
    got = V.experiment_summary(spark.createDataFrame(data, shape)).collect()
    assert [tuple(r) for r in got] == [("A", "m", 0.8, 0.5, 0.3, 0.6, 2)]


def test_signal_filters(spark):
    p = spark.createDataFrame([(s, i, f"2024-01-0{i + 1} 05:00:00", 1.0) for s in "abc" for i in range(3)], "series_id string, idx long, ts string, value double")
    p = p.withColumn("ts", F.to_timestamp("ts"))
    assert {r[0] for r in G.first_signals(p, 2).select("series_id").collect()} == {"a", "b"}
    labels = spark.createDataFrame([("a", "2024-01-02 06:00:00", "2024-01-03 04:00:00"), ("b", "2024-01-01 00:00:00", "2024-01-02 05:00:00"), ("c", "2024-02-01 00:00:00", "2024-02-02 00:00:00")], "series_id string, start string, end string")
    labels = labels.select("series_id", F.to_timestamp("start").alias("start"), F.to_timestamp("end").alias("end"))
    assert {r[0] for r in G.labelled_only(p, labels).select("series_id").collect()} == {"b"}
    assert G.require(p, "idx", "value") is p
    with pytest.raises(ValueError, match="missing"):
        G.require(p, "other")


def test_agent_reads_answers(spark, tmp_path):
    p = spark.createDataFrame([("s", i, float(i % 10)) for i in range(25)], "series_id string, idx long, value double")
    answers = {"number": '[{"start": 2, "end": 4}, {"start": 9, "end": 9}, {"start": 8, "end": 99}]', "timestamp": '{"start timestamp": "2024-04-01 02:00:00", "end timestamp": "2024-04-01 03:30:00"} {"start timestamp": "x"}'}
    for kind, want in (("number", {2, 3, 8, 9}), ("timestamp", {2, 3})):
        got = {r["idx"]: r["flag"] for r in A.ask(p, lambda prompts, a=answers[kind]: [a] * len(prompts), kind, length=10).collect()}
        # chunks start at 0, 10 and 15
        count = {i: sum(i - s in want for s in (0, 10, 15) if 0 <= i - s < 10) for i in range(25)}
        assert got == count
    parts = A.prepared(p, 10)
    assert {r["period"] for r in parts.collect()} == {24}
    for name, kind in A.INDEX_TYPES.items():
        plain = [r["prompt"] for r in A.chunk_prompts(parts, kind).collect()]
        assert len(plain) == 3 and all("Up to 3 anomalies" in x and "10.00" in x for x in plain)
        seen = A.chunk_prompts(parts, kind, pictures=True).collect()
        assert all(bytes(r["png"])[1:4] == b"PNG" for r in seen) and all(("10.00" in r["prompt"]) == (name not in ("wo-text-seq", "anomllm")) for r in seen)
    lost = A.ask(p, lambda prompts: ["none", None, "[]"][: len(prompts)] + ["[]"] * (len(prompts) - 3), length=10).collect()
    assert {r["flag"] for r in lost} == {0} and {r["unread"] for r in lost} == {0, 1}
    # two periods of 24 don't fit into ten rows
    short = A.prepared(p, 10, deseasonal=True)
    assert {r["status"] for r in A.asked(short, lambda prompts: ["[]"] * len(prompts), A.INDEX_TYPES["number"]).collect()} == {"too short"}
    calls = tmp_path / "calls"

    def counted(prompts):
        with calls.open("a") as file:
            file.write(f"{len(prompts)}\n")
        return ["[]"] * len(prompts)

    flags = A.ask(p, counted, length=10)
    assert flags.count() == 25 and flags.count() == 25
    assert sum(map(int, calls.read_text().split())) == 3  # a second action asks nobody again


def test_stream_statistics_drop_late_rows(spark, tmp_path):
    shape = "series_id string, ts timestamp, value double"
    source = tmp_path / "in"
    for k, data in enumerate([[("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:20:00", 3.0)], [("a", "2024-01-01 05:00:00", 7.0)], [("a", "2024-01-01 00:30:00", 99.0), ("a", "2024-01-01 09:00:00", 1.0)]]):
        df = spark.createDataFrame(data, "series_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = I.hourly_statistics(spark.readStream.schema(shape).parquet(str(source)))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("hour").collect()
    assert (got[0]["n"], got[0]["mean"]) == (2, 2.0)  # the late row came behind the watermark


def test_pending_work_is_done_once(spark, tmp_path):
    seen = []
    for _ in range(2):
        spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
        I.run_pending(stream, ["k"], str(tmp_path / "ledger"), lambda rows, batch: seen.append((batch, rows.count())), str(tmp_path / "check")).awaitTermination()
    assert seen == [(0, 2), (1, 0)]


def test_intermediate_tables(spark):
    t = written(spark.range(3), "x")
    assert t.count() == 3 and t.columns == ["id"]


def test_all_prompt_variants_have_messages(spark):
    shot = F.array(F.struct(F.lit("s").alias("shown"), F.lit("a").alias("answer")))
    one = spark.range(1)
    assert len(P.VARIANTS) == 24
    for name, v in P.VARIANTS.items():
        m = one.select(P.variant_messages(v, F.lit("img"), shot).alias("m")).first()["m"]
        assert len(m) == 1 + 2 * v.shots + (4 if v.worked is not None else 0)
        assert m[-1]["role"] == "user" and (m[-1]["image"] is not None) == v.vision
        if v.worked is not None:
            assert m[1]["text"] == ("42" if v.worked else "52")


def test_verified_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "p", "z")], "k long, prompt string, other string")
    assert [tuple(r) for r in D.verified(df, lambda prompts: [p + "!" for p in prompts]).collect()] == [(1, "p", "z", "p!")]
