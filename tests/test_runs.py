"""Whole runs over a folder, and operators that had no test of their own, against plain models."""

import contextlib
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow import config as c
from winnow.functions import metrics as m
from winnow.functions import prompts, regions
from winnow.functions import text as t
from winnow.operators import answers, decide, feedback, pixels, report, select, sequence, shoot, similarity
from winnow.operators.ranking import ranked
from winnow.plans import triage
from winnow.sources import files, images


def value(spark, x):
    return spark.range(1).select(x).first()[0]


# ---------------------------------------------------------------- ranks, brackets, clusters


def test_positions_within_parts_and_over_all(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, x int")
    got = {x.id: x.pos for x in ranked(df, [F.col("x").desc(), F.col("id").asc()], "pos").collect()}
    assert [got[i] for i, _, _ in sorted(rows, key=lambda v: (-v[2], v[0]))] == list(range(500))
    got = {x.id: x.pos for x in ranked(df, ["x", "id"], "pos", ["k"]).collect()}
    for k in ("a", "b", None):
        assert [got[i] for i, _, _ in sorted((v for v in rows if v[1] == k), key=lambda v: (v[2], v[0]))] == list(range(sum(v[1] == k for v in rows)))
    assert ranked(df.limit(0), ["x"], "pos").count() == 0


def bracket(rows, beats):
    rows, out = sorted(rows, key=lambda x: (-(x["score"] or 0.0), x["id"])), []
    while len(rows) > 1:
        on = []
        for a, b in zip(rows[::2], rows[1::2]):
            win, lose = (a, b) if beats(a, b) else (b, a)
            on.append(win)
            out.append(lose["id"])
        rows = on + rows[len(rows) - len(rows) % 2 :]
    return [rows[0]["id"], *out]


@pytest.mark.parametrize(("n", "bits"), [(1, 12), (5, 12), (37, 2), (64, 3), (100, 3)])
def test_a_bracket_in_blocks_is_the_bracket(spark, n, bits):
    r = random.Random(n)
    rows = [{"id": i, "score": r.choice([None, r.random(), 0.5])} for i in range(n)]
    df = spark.createDataFrame([(x["id"], x["score"]) for x in rows], "id int, score double")
    for beats in (select.higher_score, lambda a, b: a["id"] < b["id"]):
        got = [x.id for x in select.tournament(df, "id", "score", beats, bits).orderBy("place").collect()]
        assert got == bracket([{**x, "score": x["score"] or 0.0} for x in rows], beats)


def slow_linkage(points, most):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    groups = [[i] for i in range(len(points))]
    while len(groups) > 1:
        d, i, j = min((np.mean([1 - unit[a] @ unit[b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d > most:
            break
        groups[i] += groups.pop(j)
    return sorted(map(sorted, groups))


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_matches_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(6, 5))[rng.integers(0, 6, 40)] + rng.normal(scale=0.4, size=(40, 5))
    label = similarity.average_linkage(points, 0.25)
    assert sorted(sorted(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())) == slow_linkage(points, 0.25)


def test_hashed_pairs_find_what_they_promise(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 32))
    data = np.concatenate([base, base + rng.normal(scale=0.05, size=base.shape)])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id int, e array<double>")
    least = 0.95
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(data @ data.T >= least, 1)))}
    got = {(r.a, r.b) for r in similarity.near_pairs(df, "id", "e", least, "lsh").collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 300
    assert got | want == {(r.a, r.b) for r in similarity.near_pairs(df, "id", "e", least).collect()} | got
    assert similarity.hash_tables(0.98, 16, 0.999) <= 24 < 64 < similarity.hash_tables(0.4, 16, 0.999)


def test_curation_takes_a_winner_of_each_cluster_and_ranks_them(spark):
    rng = np.random.default_rng(4)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0][:8]
    rows = [(i, (centres[i % 8] + rng.normal(scale=0.001, size=16)).tolist(), (i * 7 % 40) / 40) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>, score double").withColumns({"has_face": F.lit(False), "is_motion": F.lit(False), "shapes": F.lit(None).cast("map<string,double>"), "motion": F.lit(None).cast("double")})
    got = select.curate(df, "id", "score", "embedding", 5, 0.15).collect()
    best = {k: max((r for r in rows if r[0] % 8 == k), key=lambda r: (r[2], -r[0]))[0] for k in range(8)}
    assert len(got) == 5 and {x.id for x in got} <= set(best.values()) and sorted(x.place for x in got) == [1, 2, 3, 4, 5]
    assert all(x.cluster_size == 5 and x.reason == "composite" for x in got)
    assert next(x for x in got if x.place == 1).id == max(got, key=lambda x: rows[x.id][2]).id
    alone = spark.createDataFrame([(i, np.eye(50)[i].tolist(), i / 50) for i in range(50)], "id int, embedding array<double>, score double").withColumns({k: F.lit(None).cast(v) for k, v in (("has_face", "boolean"), ("is_motion", "boolean"), ("shapes", "map<string,double>"), ("motion", "double"))})
    assert sorted(x.id for x in select.curate(alone, "id", "score", "embedding", 30, 0.15).collect()) == list(range(20, 50))
    few = select.curate(df.limit(3), "id", "score", "embedding", 5, 0.15).collect()
    assert len(few) == 3 and all(x.reason is None for x in few)
    with pytest.raises(ValueError):
        select.curate(df, "id", "score", "embedding", None, 0.15)


# ---------------------------------------------------------------- texts, prompts, regions


def first_object(text):
    depth = 0
    for i, ch in enumerate(text):
        if ch == "{":
            begin = i if depth == 0 else begin
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[begin : i + 1]
    return None


def test_the_first_balanced_object_of_any_text(spark):
    r = random.Random(6)
    data = ["".join(r.choice('{}{}ab"\n é') for _ in range(r.randrange(30))) for _ in range(400)] + ["", "}{", "{" * 50 + "}" * 49]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string").select("i", t.balanced_object(F.col("x")).alias("o")).collect()
    assert all(first_object(data[x.i]) == x.o for x in got)


def test_a_parsed_answer_folds_its_text_once(spark):
    df = spark.createDataFrame([("{}",)], "a string").select(t.parse_answer(F.col("a")).alias("p")).select("p.*")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") <= 1 + plan.count("Project")


def test_prompts_say_intent_hints_and_fields(spark):
    said = value(spark, prompts.scoring_prompt("wildlife", F.lit("Note: x.")))
    assert prompts.INTENT["wildlife"] in said and "Note: x." in said and all(f'"{k}"' in said for k in prompts.FIELDS) and all(k in said for k in prompts.FLAGS)
    assert prompts.INTENT["general"] in value(spark, prompts.scoring_prompt(F.lit(None).cast("string"), F.lit("")))
    assert value(spark, t.film_strip(F.array(*[F.lit(x) for x in ("keeper", "rejected", "odd", "duplicate", "select")]))) == "●○◐◌★"
    assert "Note: A had eye closure in prior analysis." in value(spark, t.pair_hints("A", F.lit(False), F.lit(None).cast("string"), F.lit(True), F.lit(False), F.lit(False), F.lit(False)))


def test_faces_eyes_and_subjects(spark):
    r = random.Random(7)
    marks = [(r.random(), r.random(), r.random()) for _ in range(478)]
    face = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(v).alias("visibility")) for x, y, v in marks])
    w, h = 640, 480
    one = spark.range(1).select(face.alias("f"))
    get = lambda x: one.select(x).first()[0]
    f = F.col("f")
    share = sum(v > 0.7 for _, _, v in marks[:468]) / 468
    assert abs(get(regions.visible_share(f)) - share) < 1e-12 and get(regions.is_occluded(f)) == (share < 0.7)
    xs, ys = [int(x * w) for x, _, _ in marks[:468]], [int(y * h) for _, y, _ in marks[:468]]
    assert tuple(get(regions.face_box(f, F.lit(w), F.lit(h)))) == (min(xs), min(ys), max(xs), max(ys))
    xs, ys = [int(marks[i][0] * w) for i in regions.LEFT_EYE], [int(marks[i][1] * h) for i in regions.LEFT_EYE]
    px, py = max(1, int((max(xs) - min(xs)) * 0.2)), max(1, int((max(ys) - min(ys)) * 0.2))
    assert tuple(get(regions.eye_box(f, regions.LEFT_EYE, F.lit(w), F.lit(h)))) == (max(0, min(xs) - px), max(0, min(ys) - py), min(w, max(xs) + px), min(h, max(ys) + py))
    p = [marks[i] for i in regions.RIGHT_EYE]
    far = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    assert abs(get(regions.eye_ratio(f, regions.RIGHT_EYE)) - (far(p[1], p[5]) + far(p[2], p[4])) / 2 / far(p[0], p[3])) < 1e-12
    layers = [([[1.0, 2.0], [0.5, -1.0]], [0.1, 0.2]), ([[3.0, 4.0]], [0.5])]
    assert abs(value(spark, m.linear_head(F.array(F.lit(0.3), F.lit(0.7)), layers)) - (3 * (0.3 + 1.4 + 0.1) + 4 * (0.15 - 0.7 + 0.2) + 0.5)) < 1e-12


def test_sharpness_of_regions_and_two_sizes(spark):
    rng = np.random.default_rng(8)
    px = np.full((40, 60, 3), 128, np.uint8)
    px[10:30, 5:25] = rng.integers(0, 256, (20, 20, 1))
    rows = [("a", (40, 60, 3, 16, bytearray(px.tobytes()))), ("bad", (40, 60, 3, 16, bytearray(b"x")))]
    df = spark.createDataFrame(rows, "id string, image struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    box = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), v)])
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), b.alias("box")) for k, b in (("busy", box(5, 10, 25, 30)), ("flat", box(35, 5, 99, 35)), ("out", box(80, 80, 90, 90)))])
    got = {(r.id, r.name): r.tenengrad for r in pixels.region_sharpness(df.withColumn("r", wanted), "id", "r").collect()}
    gx, gy, _ = pixels.gradients(pixels.gray_of(px.astype(float))[10:30, 5:25])
    assert abs(got["a", "busy"] - (gx * gx + gy * gy).mean()) < 1e-9 and got["a", "flat"] == 0 and got["a", "out"] == 0 and got["bad", "busy"] is None
    two = {r.id: r for r in pixels.two_sizes(df, "id", long_edge=30, square=16).collect()}
    assert (two["a"].height, two["a"].width, len(two["a"].pixels), len(two["a"].crop)) == (20, 30, 20 * 30 * 3, 16 * 16 * 3) and two["bad"].pixels is None
    flat = np.full((5, 9, 3), 77, np.uint8)
    assert (pixels.resample(flat, 3, 20) == 77).all() and pixels.resample(flat, 11, 4).shape == (11, 4, 3)


def test_bokeh_is_a_sharp_middle_on_soft_ground():
    rng = np.random.default_rng(5)
    busy = rng.integers(0, 256, (160, 240)).astype(float)
    soft = sum(np.roll(np.roll(busy, dy, 0), dx, 1) for dy in range(-4, 5) for dx in range(-4, 5)) / 81
    mixed = soft.copy()
    mixed[48:112, 72:168] = busy[48:112, 72:168]
    bokeh = lambda g: (lambda a, b: a > c.BOKEH_RATIO * b)(*pixels.centre_and_rest(pixels.blur_map(g)))
    assert bokeh(mixed) and not bokeh(busy) and not bokeh(soft) and not bokeh(np.full((50, 50), 9.0)) and pixels.blur_map(np.zeros((2, 2))).shape == (1, 1)
    assert pixels.centre_and_rest(np.arange(100.0).reshape(10, 10)) == (49.5, 49.5)


# ---------------------------------------------------------------- models and caches


def test_sessions_are_opened_once_a_task_and_closed(spark, tmp_path):
    log = str(tmp_path / "log")

    @contextlib.contextmanager
    def session():
        with open(log, "a") as f:
            f.write("open\n")
        try:
            yield lambda x: f"<{x}>"
        finally:
            with open(log, "a") as f:
                f.write("close\n")

    df = spark.createDataFrame([(f"q{i}",) for i in range(20)], "q string").coalesce(1)
    assert {r.answer for r in answers.ask(df, "q", session=session).collect()} == {f"<q{i}>" for i in range(20)}
    assert open(log).read().split() == ["open", "close"]
    with pytest.raises(ValueError):
        answers.ask(df, "q")


def test_online_steps_profiles_and_caches(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(float(y), [y + rng.normal(scale=0.1), 1.0]) for y in rng.integers(0, 2, 400)]
    w = feedback.learn_online({}, rows, 0.1)
    assert np.mean([(w[-1] + w[0] * x[0] + w[1] * x[1] > 0) == (y > 0.5) for y, x in rows]) > 0.95
    once = feedback.learn_online({0: 1.0}, [(1.0, [2.0])], 0.5)
    p = 1 / (1 + math.exp(-2.0))
    assert abs(once[0] - (1 + 0.5 * (1 - p) * 2)) < 1e-12 and abs(once[-1] - 0.5 * (1 - p)) < 1e-12
    log = spark.createDataFrame([("keeper" if i % 2 else "rejected", {"a": float(i % 2)}) for i in range(10)], "user_decision string, stage1_scores map<string,double>")
    model = feedback.train(feedback.training_rows(log))
    feedback.save_profile(model, 10, str(tmp_path / "p"))
    again, labels, version = feedback.load_profile(spark, str(tmp_path / "p"))
    assert labels == 10 and version == "logreg-v10" and np.allclose(again.coefficients.toArray(), model.coefficients.toArray())
    assert feedback.load_profile(spark, str(tmp_path / "none")) is None
    cache = spark.createDataFrame([("a", [1.0, 0.0], "m"), ("b", [0.0, 1.0], "m")], "path string, embedding array<double>, model_id string")
    assert similarity.usable_cache(cache, "m") is cache and similarity.usable_cache(cache, "n") is None and similarity.usable_cache(cache.limit(0), "m") is None and similarity.usable_cache(None, "m") is None
    assert similarity.gather_all(cache, cache.select("path").limit(1)).count() == 1 and similarity.gather_all(cache, cache.select(F.lit("zz").alias("path"))) is None and similarity.gather_all(None, cache) is None
    assert similarity.usable_cache(cache.unionByName(cache.limit(1).withColumn("embedding", F.array(F.lit(1.0)))), "m") is None


def test_an_embedding_cache_serves_until_something_changes(spark, tmp_path):
    live = spark.createDataFrame([("a",), ("b",)], "path string").withColumn("modified", F.to_timestamp(F.lit("2020-01-01 00:00:00")))
    files.write_embeddings(live.withColumn("embedding", F.array(F.lit(1.0))), str(tmp_path / "c"), "m")
    cached = files.read_embeddings(spark, str(tmp_path / "c"))
    assert similarity.cache_is_valid(cached, live, "m") and not similarity.cache_is_valid(cached, live, "other")
    assert not similarity.cache_is_valid(cached, live.unionByName(live.limit(1).withColumn("path", F.lit("new"))), "m")
    assert not similarity.cache_is_valid(cached, live.withColumn("modified", F.to_timestamp(F.lit("2100-01-01 00:00:00"))), "m")
    assert not similarity.cache_is_valid(cached, live.where("path = 'a'"), "m")


def test_model_folders_get_one_alias_each(spark):
    see, blind = json.dumps({"vision_config": {}}), json.dumps({"text_config": {}})
    df = spark.createDataFrame([("/m/Qwen2.5-VL-7B", see), ("/n/Qwen2.5-VL-7B", see), ("/m/blind", blind), ("/m/Other Model!", see), ("/n/other-model", see)], "directory string, config string")
    got = sorted((r.alias, r.directory) for r in files.model_registry(df, {"qwen2.5-vl": "qwen"}).collect())
    assert got == [("other-model", "/m/Other Model!"), ("qwen", "/m/Qwen2.5-VL-7B"), ("qwen2-5-vl-7b", "/n/Qwen2.5-VL-7B")]


# ---------------------------------------------------------------- reports and files


def test_a_report_card_of_ten_photographs(spark):
    rows = [(i, "keeper" if i < 7 else "rejected", 0.8 if i < 7 else None, 0.7 if i < 7 else None, i == 0, 1 / 60 if i >= 8 else 1 / 500) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, decision string, l double, r double, closed boolean, seconds double").withColumn("taken", F.timestamp_seconds(F.col("id") * 60))
    got = report.report_card(df, F.lit("blur"), F.col("taken"), "seconds", "l", "r", "closed").first()
    assert (got.kept, got.rejected, got.keep_rate) == (7, 3, 0.7) and got.blur_share == 1.0 and got.exposure_share == 0.0
    assert abs(got.motion_risk - 2 / 3) < 1e-9 and abs(got.eye_sharpness_median - 0.75) < 1e-9 and abs(got.eyes_closed_rate - 1 / 7) < 1e-9
    assert got.duration_seconds == 540 and abs(got.photos_per_minute - 10 / 9) < 1e-9 and any("67%" in x for x in got.advice)


def test_overrides_keep_what_was_known(spark):
    d = spark.createDataFrame([("p/a.jpg", "keeper", 12.0, None)], "path string, decision string, tenengrad double, noise_score double")
    got = files.override_entries(d, F.lit("select"), "s1", "tui").first()
    assert (got.filename, got.from_label, got.user_decision, got.session_source, got.origin) == ("a.jpg", "keeper", "select", "s1", "tui") and got.stage1_scores == {"tenengrad": 12.0}


def test_files_move_with_their_sidecars_once(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / f"{k}.jpg").write_text(k)
    docs = spark.createDataFrame([(str(tmp_path / "a.jpg").replace(".jpg", ".xmp"), "<x/>")], "path string, sidecar string")
    assert files.write_sidecars(docs) == 1
    plan = spark.createDataFrame([(str(tmp_path / "a.jpg"), str(tmp_path / "to/a.jpg"), "move"), (str(tmp_path / "b.jpg"), str(tmp_path / "b.jpg"), "stay")], "source string, destination string, action string")
    assert tuple(files.apply_moves(plan).first()) == (2, 1, 1, 0) and (tmp_path / "a.jpg").exists()
    for _ in range(2):
        assert tuple(files.apply_moves(plan, dry_run=False).first()) == (2, 1, 1, 0)
    assert (tmp_path / "to/a.jpg").read_text() == "a" and (tmp_path / "to/a.xmp").exists() and (tmp_path / "b.jpg").exists()


def test_fingerprints_do_not_depend_on_order(spark):
    rows = [(f"f{i}", f"{i * 7919 % 65536:04x}" + "0" * 60) for i in range(300)]
    one, two = (report.fingerprint(spark.createDataFrame(x, "name string, digest string"), "name", "digest").first()[0] for x in (rows, rows[::-1]))
    assert one == two != report.fingerprint(spark.createDataFrame(rows[1:], "name string, digest string"), "name", "digest").first()[0]


def test_windows_and_sessions_of_streams(spark, tmp_path):
    from winnow.streaming import overrides as stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"timestamp": f"2024-01-01T00:{k:02d}:00Z", "path": f"p{k}", "user_decision": "keeper", "k": "s", "ts": f"2024-01-01T00:00:0{k % 3}.{k % 2}00Z"}) for k in range(12)))
    seen = stream.windowed_counts(stream.read(spark, str(folder)))
    seen.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [2, 10]
    shots = spark.readStream.schema("k string, ts timestamp").json(str(folder))
    stream.burst_sessions(shots, "k", "ts", "1 seconds").writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start().awaitTermination()
    assert sum(r.burst_size for r in spark.table("sessions").collect()) == 12


# ---------------------------------------------------------------- a run


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Nine photographs: 0-5 busy, 0 and 1 half a second apart and alike, 6 and 7 flat, 8 not a picture."""
    root = tmp_path_factory.mktemp("photos")
    jvm, r = spark._jvm, random.Random(11)
    for k in range(8):
        image = jvm.java.awt.image.BufferedImage(96, 64, 1)
        g = image.createGraphics()
        g.setColor(jvm.java.awt.Color(128, 128, 128))
        g.fillRect(0, 0, 96, 64)
        if k == 1:
            r.setstate(before)
        before = r.getstate()
        for _ in range(12 if k < 6 else 0):
            v = r.randrange(256)
            g.setColor(jvm.java.awt.Color(v, v, v))
            g.fillRect(r.randrange(96), r.randrange(64), r.randrange(10, 30), r.randrange(10, 30))
        jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(root / f"p{k}.jpg")))
    (root / "p8.jpg").write_bytes(b"nothing")
    for k in range(9):
        at = 1_700_000_000 + (0.4 * k if k < 2 else 100 * k)
        os.utime(root / f"p{k}.jpg", (at, at))
    return root


def test_a_whole_run(spark, folder):
    paths = {r.name: r.path for r in images.scan(spark, str(folder)).collect()}
    assert list(paths) == [f"p{k}.jpg" for k in range(9)]
    score = {0: 0.9, 1: 0.9, 2: 0.6, 3: 0.2, 4: 0.8, 5: 0.8}
    scores = spark.createDataFrame([(paths[f"p{k}.jpg"], v, v, v) for k, v in score.items()], "path string, topiq double, laion double, clipiqa double")
    rng = np.random.default_rng(12)
    vectors = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    vectors[5] = vectors[4]
    embeddings = spark.createDataFrame([(paths[f"p{k}.jpg"], vectors[k].tolist()) for k in range(6)], "path string, embedding array<double>")
    asked = []

    def generate(prompt):
        assert prompts.INTENT["general"] in prompt and "Stage 2 composite score was" in prompt
        return '{"sharpness": 0.5, "exposure": 0.9, "composition": 0.75, "expression": 1, "keeper": true, "confidence": 0.9, "flags": []}'

    found = triage.run(spark, str(folder), c.RunConfig(curate_target=1), {"scores": scores, "embeddings": embeddings}, generate)
    got = {r.name: r for r in found.decisions.collect()}
    assert len(got) == 9
    label = {k: got[f"p{k}.jpg"].decision for k in range(9)}
    assert label[5] == "duplicate" and label[6] == label[7] == "rejected" and label[3] == "rejected"
    assert [label[0], label[1]].count("rejected") == 1 and {got["p0.jpg"].is_burst_winner, got["p1.jpg"].is_burst_winner} == {True, False}
    assert sum(x == "select" for x in label.values()) == found.selection.count() == 1
    assert got["p2.jpg"].stage_reached == 3 and label[2] in ("keeper", "select")
    assert found.summary.first().total == 9 and not asked
    alone = triage.run(spark, str(folder), c.RunConfig(stages=(1,), is_shoot_a_folder=True), {})
    assert alone.selection is None and {r.decision for r in alone.decisions.collect()} <= {"uncertain", "rejected"}


def test_a_run_measures_what_no_provider_gives(spark, folder, tmp_path):
    scan = images.scan(spark, str(folder))
    paths = {r.name: r.path for r in scan.collect()}
    scores = spark.createDataFrame([(paths[f"p{k}.jpg"], 0.5, 0.5, 0.5) for k in range(6)], "path string, topiq double, laion double, clipiqa double")
    faces = spark.createDataFrame([(paths["p2.jpg"], (10, 10, 40, 40))], "path string, face struct<x0:int,y0:int,x1:int,y1:int>")
    sharp = {r.path: r.subject for r in triage.subject_sharpness(images.decode(spark, str(folder)), faces).collect()}
    whole = {r.id: r.tenengrad for r in pixels.image_metrics(images.decode(spark, str(folder)), "path").collect()}
    assert sharp[paths["p2.jpg"]] != whole[paths["p2.jpg"]] and abs(sharp[paths["p3.jpg"]] - whole[paths["p3.jpg"]]) < 1e-6
    rows = spark.createDataFrame([(float(k % 2), [float(k % 2 * 100 + j) for j in range(10)]) for k in range(40)], "label double, f array<double>").select("label", feedback.array_to_vector("f").alias("features"))
    feedback.save_profile(feedback.train(rows), 40, str(tmp_path / "profile"))
    embedded = []

    def embed(df):
        embedded.append(df.count())
        return df.select("path", F.array(*[(F.pmod(F.xxhash64("path", F.lit(k)), F.lit(1000)) / 500.0 - 1).cast("float") for k in range(8)]).alias("embedding"))

    def explain(prompt):
        assert "judged: rejected" in prompt
        return '{"explanation": "flat", "weaknesses": ["no detail"], "strengths": [], "confidence": 0.5}'

    how = dict(profile=str(tmp_path / "profile"), explain=explain, cache=(str(tmp_path / "cache"), "m", embed))
    found = triage.run(spark, str(folder), c.RunConfig(stages=(1, 2)), {"scores": scores, "regions": faces}, **how)
    rejected = {r.path for r in found.decisions.where("decision = 'rejected'").collect()}
    said = found.explanations.collect()
    assert {r.path for r in said} == rejected - {paths["p8.jpg"]} or {r.path for r in said} == rejected
    assert all(r.explanation == "flat" and r.weaknesses == ["no detail"] and not r.is_parse_error for r in said)
    card = found.card.first()
    assert card.photos == 9 and card.advice and abs(card.keep_rate - found.decisions.where("decision in ('keeper', 'select')").count() / max(1, found.decisions.where("decision not in ('uncertain')").count())) < 1e-9
    assert embedded == [9] and files.read_embeddings(spark, str(tmp_path / "cache")).count() == 9


def test_keepers_get_a_sidecar_before_files_move(spark, tmp_path):
    for k in "abc":
        (tmp_path / f"{k}.jpg").write_text(k)
    decided = spark.createDataFrame([(str(tmp_path / f"{k}.jpg"), d) for k, d in zip("abc", ("select", "keeper", "rejected"))], "path string, decision string")
    lines = spark.createDataFrame([(str(tmp_path / "a.jpg"), 1.5, -2.0)], "path string, tilt double, keystone double")
    assert tuple(triage.deliver(decided, str(tmp_path), sidecars=True, geometry=lines).first()) == (3, 2, 1, 0, 2)
    assert sorted(os.listdir(tmp_path)) == ["a.jpg", "b.jpg", "c.jpg"]
    assert tuple(triage.deliver(decided, str(tmp_path), sidecars=True, geometry=lines, dry_run=False).first()) == (3, 2, 1, 0, 2)
    assert (tmp_path / "_curated/_selects/a.jpg").exists() and 'StraightenAngle="1.5"' in (tmp_path / "_curated/_selects/a.xmp").read_text()
    assert (tmp_path / "b.xmp").exists() and not (tmp_path / "c.xmp").exists() and (tmp_path / "_review/_rejected/c.jpg").exists() and not (tmp_path / "_review/_rejected/c.xmp").exists()


def test_review_places_and_group_positions(spark):
    df = spark.createDataFrame([(0, 0.5), (1, None), (2, 0.9), (3, 0.1)], "id int, taste double")
    assert [r.id for r in decide.review_queue(df, "taste", "id").collect()] == [2, 3, 0, 1] == [r.id for r in decide.review_places(df, "taste", "id").orderBy("place").collect()]
    placed = shoot.first_position(df.withColumn("s", F.lit("x")), ["s"], ["id"])
    assert sorted((r.id, r.pos) for r in placed.collect()) == [(k, k) for k in range(4)]


def test_undo_restores_what_was_there_before(spark):
    d = spark.createDataFrame([(1, "keeper"), (2, "rejected"), (3, "keeper")], "id int, decision string")
    log = spark.createDataFrame([(1, "select", 1), (2, "keeper", 2), (1, "rejected", 3)], "id int, label string, seq int")
    back = decide.restore(d, log, "id")
    assert sorted((r.id, r.label, r.seq) for r in back.collect()) == [(1, "select", 4), (2, "rejected", 4)]
    again = decide.override(d, log.unionByName(back), "id")
    assert sorted((r.id, r.decision) for r in again.collect()) == [(1, "select"), (2, "rejected"), (3, "keeper")]


def test_leader_groups_pass_all_columns_on(spark):
    rows = [(i, i // 3, "s" if i % 2 else None, float(i), [0, 0, 1 << 40 | 255][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, burst int, tag string, ts double, bits bigint").withColumn("shoot", F.lit(None).cast("string"))
    got = sequence.leader_groups(df, ["shoot"], "ts", "id", "bits", 4)
    assert got.columns == [*df.columns, "subgroup"]
    assert sorted((r.id, r.tag, r.subgroup) for r in got.collect() if r.tag) == sorted((i, "s", 0) for i in range(30) if i % 3 < 2 and i % 2)
