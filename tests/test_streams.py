"""Streams against the same computation over a table, and after restarts."""

import contextlib
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from winnow.operators import sequence
from winnow.sources import files, labels, versions
from winnow.streaming import bursts as burst_stream
from winnow.streaming import overrides

SF = "/root/testdata/sf0.001"
GAP = 7200.0


def captures(spark):
    """events, with scores and hashes by arithmetic, a third of them without a score."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("shoot"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 37 % 11 / 7).alias("score"), (F.col("event_id") * 7 % 16).alias("bits"))


def test_streamed_bursts_equal_those_of_the_table(spark, tmp_path):
    table = captures(spark)
    end = table.agg(F.max("ts")).first()[0]
    last = spark.createDataFrame([(-1, -1, 0.0, 0)], "id long, shoot long, score double, bits long").select("id", "shoot", (F.lit(end) + F.expr("interval 30 days")).alias("ts"), "score", "bits")
    folder = str(tmp_path / "in")
    # five files in order of time, out of order within each, then a capture that moves the watermark past all
    bounds = table.withColumn("us", F.unix_micros("ts").cast("double")).approxQuantile("us", [0.2, 0.4, 0.6, 0.8], 0.0)
    part = sum(((F.unix_micros("ts") > b).cast("int") for b in bounds), F.lit(0))
    for k in range(5):
        table.where(part == k).coalesce(1).sortWithinPartitions(F.xxhash64("id")).write.mode("append").parquet(f"{folder}/{k}")
    last.write.parquet(f"{folder}/5")
    for stop in (3, 6):  # a second run goes on from the first one's checkpoint
        paths = f"{folder}/{{{','.join(map(str, range(stop)))}}}"
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(paths)
        out = burst_stream.burst_members(stream, "shoot", "ts", "id", "score", "bits", GAP, 1, "1 hour")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    batch = sequence.rank_bursts(sequence.bursts(table, ["shoot"], "ts", "id", GAP), ["shoot"], "ts", "id", "score")
    want = sorted(map(tuple, batch.select("shoot", "id", "burst_size", "burst_rank", "is_burst_winner").collect()))
    assert len(want) > 200 and sorted(map(tuple, found.select("shoot", "id", "burst_size", "burst_rank", "is_burst_winner").collect())) == want
    visual = sequence.leader_groups(sequence.bursts(table, ["shoot"], "ts", "id", GAP), ["shoot"], "ts", "id", "bits", 1)
    want = sorted(map(tuple, visual.select("shoot", "id", "subgroup").collect()))
    assert want and sorted(map(tuple, found.where("subgroup_size > 1").select("shoot", "id", "subgroup").collect())) == want


# ---------------------------------------------------------------- a model learned from a stream


def entry(k, label, **scores):
    return {"path": f"p{k}", "user_decision": label, "stage1_scores": scores}


def descend(batches, rate):
    w = {"": 0.0}
    for batch in batches:
        step = {}
        for e in batch:
            x = {"": 1.0, **e["stage1_scores"]}
            z = sum(w.get(f, 0.0) * v for f, v in x.items())
            off = 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) - (e["user_decision"] == "keeper")
            for f, v in x.items():
                step[f] = step.get(f, 0.0) + off * v
        w = {f: w.get(f, 0.0) - rate * step.get(f, 0.0) for f in {*w, *step}}
    return w


def log_files(folder, batches):
    folder.mkdir(exist_ok=True)
    for k, b in enumerate(batches):
        if not (folder / f"{k:03}.json").exists():
            (folder / f"{k:03}.json").write_text("\n".join(map(json.dumps, b)) + "\n\nnot json\n")
            os.utime(folder / f"{k:03}.json", (1e9 + k, 1e9 + k))


def learned(spark, log, tmp_path):
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(log)).where(F.trim("value") != "")
    stream = stream.select(F.from_json("value", files.OVERRIDE).alias("e")).where("e is not null and e.path is not null").select("e.*")
    overrides.learn(stream, str(tmp_path / "ck"), str(tmp_path / "model"), 0.1).awaitTermination()
    return overrides.weights(spark, str(tmp_path / "model"))


def test_weights_equal_plain_descent_and_a_batch_counts_once(spark, tmp_path):
    r = random.Random(2)
    batches = [[entry(k, r.choice(["keeper", "rejected"]), **{f: r.gauss(0, 1) for f in ("a", "b", "c") if r.random() < 0.8}) for k in range(20)] for _ in range(4)]
    log = tmp_path / "log"
    log_files(log, batches[:2])
    last, w = learned(spark, log, tmp_path)
    log_files(log, batches)
    # the last commit of the checkpoint is lost: its batch runs again, though the model has it
    (tmp_path / "ck" / "commits" / "1").unlink()
    with contextlib.suppress(FileNotFoundError):
        (tmp_path / "ck" / "commits" / ".1.crc").unlink()
    last, w = learned(spark, log, tmp_path)
    want = descend(batches, 0.1)
    assert last == 3 and w.keys() == want.keys() and all(abs(w[f] - want[f]) < 1e-9 for f in want)
    rows = spark.createDataFrame([({"a": 1.0, "zz": 3.0},), (None,)], "s map<string,double>")
    got = [x[0] for x in rows.select(overrides.taste(rows, "s", w)).collect()]
    assert abs(got[0] - 1 / (1 + math.exp(-want[""] - want["a"]))) < 1e-9 and abs(got[1] - 1 / (1 + math.exp(-want[""]))) < 1e-9
    assert rows.select(overrides.taste(rows, "s", {})).first()[0] == 0.5


def test_a_state_that_cannot_be_read_is_an_error(spark, tmp_path):
    state = tmp_path / "state" / "v000000000001"
    state.mkdir(parents=True)
    (state / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception, match="(?i)parquet"):
        overrides.weights(spark, str(tmp_path / "state"))
    assert overrides.weights(spark, str(tmp_path / "none")) == (-1, {})


# ---------------------------------------------------------------- versions, snapshots, caches


def test_a_version_appears_whole_and_old_ones_go(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.read(spark, root) is None
    assert versions.commit(spark.range(3), root) == 1 and versions.commit(spark.range(5), root, after=1) == 2
    one = versions.read(spark, root)
    assert versions.commit(spark.range(7), root) == 3 and one.count() == 5  # a reader keeps the version it opened
    with pytest.raises(versions.Conflict):
        versions.commit(spark.range(9), root, after=1)
    assert versions.versions(spark, root) == [2, 3] and versions.read(spark, root).count() == 7
    with pytest.raises(Exception, match="(?i)zero"):
        versions.commit(spark.range(9).selectExpr("1 / (id - 4) as x"), root)
    assert versions.read(spark, root).count() == 7 and versions.versions(spark, root) == [2, 3]
    os.makedirs(f"{root}/_writing-dead")
    assert versions.read(spark, root).count() == 7 and versions.clean(spark, root, 3600) == 0
    versions.clean(spark, root, 0)
    assert not [n for n in os.listdir(root) if n.startswith("_writing")]


def test_labels_of_snapshot_and_tail(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "snap")

    def add(*rows):
        df = spark.createDataFrame([(float(s), p, d) for s, p, d in rows], "s double, path string, user_decision string")
        files.append_overrides(df.select(F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("timestamp"), "path", "user_decision").coalesce(1), log)

    now = lambda: {r.path: r.user_decision for r in labels.current(spark, log, root).collect()}
    assert now() == {}
    add((1, "a", "keeper"), (2, "b", "keeper"), (3, "a", "rejected"))
    assert now() == {"a": "rejected", "b": "keeper"}
    assert labels.compact(spark, log, root) == 1
    add((0.5, "b", "rejected"), (9, "c", "select"))
    assert now() == {"a": "rejected", "b": "keeper", "c": "select"}
    assert labels.compact(spark, log, root) == 2 and now() == {"a": "rejected", "b": "keeper", "c": "select"}
    assert labels._tail(spark, log, versions.read(spark, root))[1] == []
    add((10, "a", "keeper"))
    assert now()["a"] == "keeper" and len(labels._tail(spark, log, versions.read(spark, root))[1]) == 1


def test_only_changed_files_are_embedded_anew(spark, tmp_path):
    root, asked = str(tmp_path / "cache"), []

    def embed(df):
        asked.append(sorted(r.path for r in df.collect()))
        return df.select("path", F.array(F.length("path").cast("float")).alias("embedding"))

    live = lambda **m: spark.createDataFrame(list(m.items()), "path string, s double").select("path", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("modified"))
    assert files.refresh_embeddings(live(a=1.0, bb=2.0), root, "m", embed).count() == 2
    assert files.refresh_embeddings(live(a=1.0, bb=2.0), root, "m", embed).count() == 2
    got = files.refresh_embeddings(live(a=1.0, bb=4e9, ccc=3.0), root, "m", embed)
    assert {r.path: r.embedding for r in got.collect()} == {"a": [1.0], "bb": [2.0], "ccc": [3.0]}
    assert files.refresh_embeddings(live(a=1.0), root, "m", embed).count() == 1 and files.read_embeddings(spark, root).count() == 1
    files.refresh_embeddings(live(a=1.0), root, "other", embed)
    assert asked == [["a", "bb"], ["bb", "ccc"], [], ["a"]]
