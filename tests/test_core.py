"""Core operators against plain-Python models and stated facts."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow import config as c
from winnow.functions import metrics as m
from winnow.functions import text as t
from winnow.operators import answers, decide, feedback, fusion, pixels, report, select, sequence, shoot, similarity
from winnow.operators.graph import components
from winnow.sources import files, images


def rows(df, *cols):
    return sorted(tuple(r[k] for k in cols) for r in df.collect())


# ---------------------------------------------------------------- fusion


@pytest.mark.parametrize(("score", "label"), [(0.80, "KEEPER"), (0.72, "KEEPER"), (0.719, "AMBIGUOUS"), (0.48, "AMBIGUOUS"), (0.479, "REJECT")])
def test_uniform_scores_route_at_the_boundaries(spark, score, label):
    df = spark.createDataFrame([(score, score, score, score)], "topiq double, laion double, clipiqa double, exposure double")
    got = fusion.fuse(df, "general").first()
    assert got.routing == label and math.isclose(got.composite, score, abs_tol=1e-9)


def test_terms_of_the_fusion(spark):
    base = spark.createDataFrame([(0.6,) * 4], "topiq double, laion double, clipiqa double, exposure double")
    score = lambda df, p="general": fusion.fuse(df, p).first().composite
    assert math.isclose(score(base.withColumn("tilt_penalty", F.lit(1.0))), 0.5, abs_tol=1e-9)
    bokeh = base.withColumn("is_bokeh", F.lit(True))
    assert score(bokeh) == score(base)  # no subject, no bonus
    assert score(bokeh.withColumn("subject", F.lit(600.0))) > score(base.withColumn("subject", F.lit(600.0)))
    taste = base.withColumn("taste", F.lit(1.0))
    assert score(taste) == score(base) and math.isclose(score(taste.withColumn("taste_labels", F.lit(10))), 0.675, abs_tol=1e-9)
    skew = spark.createDataFrame([(0.9, 0.1, 0.5, 0.5)], "topiq double, laion double, clipiqa double, exposure double")
    assert score(skew, "wildlife") > score(skew, "wedding")
    with pytest.raises(ValueError):
        fusion.fuse(base, "nothing")


def test_fast_weights_sum_to_one():
    for name in c.PRESETS:
        w = c.fast_weights(name)
        assert math.isclose(w["topiq"] + w["laion"] + w["exposure"], 1.0) and w["clipiqa"] == 0
        assert math.isclose(w["topiq"] / w["laion"], c.PRESETS[name]["topiq"] / c.PRESETS[name]["laion"])


# ---------------------------------------------------------------- sequences


def shots(spark, offsets):
    return spark.createDataFrame([(i, "s", None if o is None else float(o)) for i, o in enumerate(offsets)], "id int, shoot string, o double").select("id", "shoot", F.timestamp_micros((F.col("o") * 1e6).cast("bigint")).alias("ts"))


@pytest.mark.parametrize("ranges", [None, 1, 5])
def test_bursts_join_up_to_the_gap(spark, ranges):
    got = sequence.bursts(shots(spark, [0, 0.3, 0.8, 5, 5.5, 9, None]), ["shoot"], "ts", "id", 0.5, ranges)
    assert [(a, n) for a, _, n in rows(got, "id", "burst", "burst_size")] == [(0, 3), (1, 3), (2, 3), (3, 2), (4, 2)]
    assert len({b for _, b in rows(got, "id", "burst")}) == 2


@pytest.mark.parametrize("ranges", [None, 1, 4])
def test_scenes_count_gaps_but_not_the_first_row(spark, ranges):
    got = sequence.scenes(shots(spark, [0, 2.0, 4.1, 4.2, 10]), ["shoot"], "ts", "id", 2.0, ranges)
    assert rows(got, "id", "scene", "is_scene_start", "scene_bonus") == [(0, 0, True, 0.0), (1, 0, False, 0.0), (2, 1, True, 1.0), (3, 1, False, 0.0), (4, 2, True, 1.0)]


def test_winner_is_the_best_score_and_ties_go_to_the_earlier(spark):
    df = shots(spark, [0, 0.1, 0.2, 5, 5.1]).withColumn("x", F.when(F.col("id") == 1, 0.9).when(F.col("id") < 3, 0.5))
    got = sequence.rank_bursts(sequence.bursts(df, ["shoot"], "ts", "id"), ["shoot"], "ts", "id", "x")
    assert [i for i, w in rows(got, "id", "is_burst_winner") if w] == [1, 3]


def test_leader_groups_compare_with_the_first_row_only(spark):
    bits = {0: 0, 1: 0b1111, 2: 0b11111111, 3: (1 << 40) - 1, 4: (1 << 40) - 2}
    df = shots(spark, [0, 0.1, 0.2, 0.3, 0.4]).withColumn("bits", F.create_map(*[F.lit(x) for kv in bits.items() for x in kv])[F.col("id")].cast("bigint"))
    got = sequence.leader_groups(sequence.bursts(df, ["shoot"], "ts", "id"), ["shoot"], "ts", "id", "bits", 4)
    assert rows(got, "id", "subgroup") == [(0, 0), (1, 0), (3, 2), (4, 2)]


def test_shoot_statistics(spark):
    data = [(i, 0, 200.0 if i == 5 else 50.0, 0.0, 0.0, 0.9 if i == 5 else 0.6, 6400 if i == 5 else 200, None if i == 2 else "f/2.8") for i in range(10)]
    df = spark.createDataFrame(data, "id int, shoot int, l double, a double, b double, e double, iso int, aperture string")
    got = {r.id: r for r in shoot.outliers(df, ["shoot"], ("l", "a", "b"), "e").collect()}
    assert got[5].palette_outlier == 1.0 and got[5].exposure_drift == 1.0 and got[0].palette_outlier == 0.0
    odd = {r.id: r.exif_anomaly for r in shoot.anomalies(df, ["shoot"], ["iso", "aperture"], "id").collect()}
    assert odd[0] == 0.0 and math.isclose(odd[5], 0.75) and math.isclose(odd[2], 0.75)


# ---------------------------------------------------------------- graphs and vectors


def greedy_stars(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    sources = []
    for n in sorted(near):
        if not near[n] & set(sources):
            sources.append(n)
    return sources, near


def test_components_and_greedy_stars_match_plain_python(spark):
    rng = np.random.default_rng(3)
    links = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 40, (45, 2)) if p[0] != p[1]})
    df = spark.createDataFrame(links, "a bigint, b bigint")
    parent = {n: n for p in links for n in p}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert rows(components(df, "a", "b"), "node", "root") == sorted((n, find(n)) for n in parent)
    sources, near = greedy_stars(links)
    want = sorted((n, n in sources, n if n in sources else min(near[n] & set(sources))) for n in near)
    assert rows(similarity.duplicate_groups(df), "id", "is_source", "source") == want


def test_near_pairs_exact_blocks_and_hashing(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 32))
    m_ = np.concatenate((base, base[:8] + rng.normal(scale=0.01, size=(8, 32))))
    m_ /= np.linalg.norm(m_, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m_)], "id bigint, e array<double>")
    want = [(i, 20 + i) for i in range(8)]
    assert rows(similarity.near_pairs(df, "id", "e", 0.98, block=7), "a", "b") == want
    assert rows(similarity.near_pairs(df, "id", "e", 0.98, method="lsh"), "a", "b") == want
    found = similarity.clusters(df, "id", "e", 0.15)
    assert rows(found.where("cluster_size = 2"), "id") == [(i,) for i in range(8)] + [(20 + i,) for i in range(8)]


def test_search_ranks_and_rejects_bad_requests(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "id bigint, e array<double>")
    assert [(r.id, r.similarity, r["rank"]) for r in similarity.search(df, [1.0, 0.0], "id", "e", 3).orderBy("rank").collect()] == [(0, 1.0, 1), (1, 0.0, 2), (2, 0.0, 3)]
    with pytest.raises(ValueError):
        similarity.search(df, [], "id", "e")


# ---------------------------------------------------------------- curation


def test_mmr_takes_one_of_each_cluster(spark):
    rng = np.random.default_rng(42)
    centres = np.eye(3, 16)
    data = [(k * 7 + i, (centres[k] + rng.normal(scale=0.01, size=16)).tolist(), 1.0) for k in range(3) for i in range(7)]
    df = spark.createDataFrame(data, "id bigint, e array<double>, s double")
    assert {i // 7 for (i,) in rows(select.mmr(df, "id", "e", "s", 3), "id")} == {0, 1, 2}


@pytest.mark.parametrize("n", [1, 5, 8])
def test_tournament_orders_everyone(spark, n):
    df = spark.createDataFrame([(i, i / n) for i in range(n)], "id bigint, s double")
    places = rows(select.tournament(df, "id", "s"), "place", "id")
    assert [p for p, _ in places] == list(range(1, n + 1)) and places[0][1] == n - 1
    other = rows(select.tournament(df, "id", "s", lambda a, b: a["id"] < b["id"]), "place", "id")
    assert other[0][1] == 0


def test_variety_and_its_one_swap(spark):
    mk = lambda data: spark.createDataFrame(data, "id int, pos int, shot string")
    assert select.variety(mk([]), "shot").first().variety == 0
    assert select.variety(mk([(1, 1, "close"), (2, 2, "medium"), (3, 3, "wide")]), "shot").first().variety > 0.8
    chosen = mk([(1, 1, "close"), (2, 2, "close"), (3, 3, "close")])
    got = select.variety_swap(chosen, mk([(9, 9, "wide"), (7, 7, "medium")]), "id", "pos", "shot")
    assert rows(got, "id", "pos", "is_swapped") == [(1, 1, False), (2, 2, False), (7, 3, True)]
    assert rows(select.variety_swap(chosen, mk([(9, 9, "wide")]), "id", "pos", "shot"), "id") == [(1,), (2,), (3,)]


# ---------------------------------------------------------------- decisions, reports, texts


def test_precedence_of_decisions(spark):
    data = [(True, True, False, "KEEPER", True), (False, True, True, "KEEPER", True), (False, False, False, None, None), (False, False, None, None, None), (False, False, True, "AMBIGUOUS", False), (False, False, True, "AMBIGUOUS", None)]
    df = spark.createDataFrame(data, "d boolean, l boolean, p boolean, r string, k boolean")
    assert [r[0] for r in df.select(decide.decision(*[F.col(x) for x in "dlprk"])).collect()] == ["duplicate", "rejected", "rejected", "uncertain", "rejected", "uncertain"]


def test_keep_rate_and_shares(spark):
    df = spark.createDataFrame([("keeper",)] * 6 + [("select",)] + [("rejected",)] * 2 + [("duplicate",), ("uncertain",)], "decision string")
    assert math.isclose(report.keep_rate(df).first().keep_rate, 0.7)
    shares = report.reject_breakdown(df, F.when(F.col("decision") == "duplicate", "duplicate").otherwise("blur")).first()
    assert math.isclose(sum(shares), 1.0) and math.isclose(shares.duplicate_share, 1 / 3)
    none = df.limit(0)
    assert report.keep_rate(none).first().keep_rate == 0.0 and sum(report.reject_breakdown(none, F.lit("blur")).first()) == 0.0


ANSWERS = [
    ('{"sharpness": .85, "exposure": 0.9, "composition": 0.75, "expression": 1.0, "keeper": true, "confidence": 0.82, "flags": []}'.replace(".85", "0.85", 1), False),
    ('I think: {"sharpness": 0.5, "exposure": 0.9, "composition": 0.75, "expression": 1, "keeper": false, "confidence": "0.5", "x": {"y": 1},} ok {}', False),
    ("{'sharpness': 0.5, 'exposure': 0.9, 'composition': 0.75, 'expression': 1, 'keeper': false, 'confidence': 0.5}", False),
    ('{"sharpness": 1.5, "exposure": 0.9, "composition": 0.75, "expression": 1.0, "keeper": true, "confidence": 0.82}', True),
    ('{"sharpness": 0.5, "exposure": 0.9, "composition": 0.75, "expression": 1.0, "keeper": "yes", "confidence": 0.82}', True),
    ('{"sharpness": 0.5, "keeper": true}', True), ("{broken", True), ("", True),
]


def test_answers_are_parsed_or_marked(spark):
    df = spark.createDataFrame([(a,) for a, _ in ANSWERS], "a string").select(t.parse_answer(F.col("a")).alias("p")).select("p.*")
    got = df.collect()
    assert [r.is_parse_error for r in got] == [e for _, e in ANSWERS]
    assert got[0].is_keeper is True and got[1].is_keeper is False and got[1].confidence == 0.5


def test_questions_are_asked_again(spark):
    df = spark.createDataFrame([("a",), (None,)], "q string")
    got = answers.ask(df, "q", lambda x: '{"winner": "b", "confidence": 3}', backoff=0)
    assert sorted((r.winner, r.confidence) for r in answers.picked(got).collect()) == [("A", 0.0), ("B", 1.0)]


def test_small_texts(spark):
    one = spark.range(1)
    value = lambda x: one.select(x).first()[0]
    assert value(t.slug(F.lit("--Qwen2.5 VL (7B)!"))) == "qwen2-5-vl-7b"
    assert value(t.shutter_seconds(F.lit("1/250s"))) == 1 / 250 and value(t.shutter_seconds(F.lit("2s"))) == 2.0 and value(t.shutter_seconds(F.lit("auto"))) is None
    assert value(t.shutter_text(F.lit(1), F.lit(200))) == "1/200s" and value(t.aperture_text(F.lit(2.8))) == "f/2.8"
    assert value(t.explain_hints(*[F.lit(False)] * 5, F.lit(0.0), F.lit(None).cast("double"))) == "No prior flags."
    said = value(t.parse_explanation(F.lit('so {"explanation": "e", "weaknesses": ["w"], "strengths": [], "confidence": 7}')))
    assert (said.is_parse_error, said.explanation, said.weaknesses, said.confidence) == (False, "e", ["w"], 1.0)
    assert value(t.parse_explanation(F.lit("none"))).is_parse_error


# ---------------------------------------------------------------- pixels


def test_pixel_metrics_order_and_flags():
    rng = np.random.default_rng(1)
    sharp = np.repeat(rng.integers(0, 256, (64, 64, 1)), 3, axis=2).astype(float)
    soft = sum(np.roll(np.roll(sharp, dy, 0), dx, 1) for dy in range(-2, 3) for dx in range(-2, 3)) / 25
    a, b = pixels.measure(sharp), pixels.measure(soft)
    assert a["tenengrad"] > b["tenengrad"] and a["fft_ratio"] > b["fft_ratio"] and a["noise"] == 1.0
    white, black, grey = (pixels.measure(np.full((40, 40, 3), float(v))) for v in (255, 0, 128))
    assert white["clip_high"] == 1 and black["clip_low"] == 1 and grey["midtone"] == 1 and grey["range_score"] == 0 and grey["noise"] == 0
    red = pixels.measure(np.tile(np.array([40.0, 40.0, 200.0]), (40, 40, 1)))
    assert red["cast"] > 18 and abs(grey["cast"]) < 1
    stripes = np.tile(np.where(np.arange(64) % 8 < 4, 0.0, 255.0)[:, None, None], (1, 64, 3))
    assert pixels.motion_ratio(pixels.gray_of(stripes)) > pixels.motion_ratio(pixels.gray_of(sharp))


def test_bad_images_are_rows_with_errors(spark):
    px = bytes(range(256)) * 3
    data = [("a", (16, 16, 3, 16, bytearray(px))), ("b", (16, 16, 3, 16, bytearray(b"xx")))]
    df = spark.createDataFrame(data, "id string, image struct<height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r.id: r for r in pixels.first_stage(pixels.image_metrics(df, "id")).collect()}
    assert got["a"].error is None and got["b"].error is not None and got["b"].passed is None


def test_geometry_of_segments(spark):
    data = [("x", 0.0, 0.0, 100.0, 100 * math.tan(math.radians(3))) for _ in range(6)] + [("x", 0.0, 0.0, 100 * math.tan(math.radians(2)), 100.0) for _ in range(5)]
    got = pixels.geometry(spark.createDataFrame(data, "id string, x1 double, y1 double, x2 double, y2 double"), "id").first()
    assert abs(got.tilt - 3) < 1e-6 and abs(abs(got.keystone) - 2) < 1e-6 and got.has_horizon and got.has_verticals


def test_exif_fields_are_read_from_a_jpeg_header():
    entries = [(0x9003, 2, b"2024:01:02 03:04:05\0"), (0x8827, 3, 400), (0x829A, 5, (1, 200))]
    at, body, tail = 8 + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, value in entries:
        if kind == 3:
            body += struct.pack("<HHIHH", tag, kind, 1, value, 0)
        else:
            data = value if kind == 2 else struct.pack("<II", *value)
            body += struct.pack("<HHII", tag, kind, len(data) if kind == 2 else 1, at + len(tail))
            tail += data
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0) + tail
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xd9"
    assert images.exif_fields(jpeg) == {"taken": "2024:01:02 03:04:05", "iso": 400, "exposure": (1, 200)}
    assert images.exif_fields(b"") == {} and images.exif_fields(jpeg[:30]) == {}


# ---------------------------------------------------------------- files and feedback


def test_override_log_skips_broken_lines(spark, tmp_path):
    d = spark.createDataFrame([("p/a.jpg", "keeper", 12.0)], "path string, decision string, tenengrad double")
    log = str(tmp_path / "log")
    for _ in range(2):
        files.append_overrides(files.override_entries(d, F.lit("rejected"), "s", "tui"), log)
    (tmp_path / "log" / "part-bad.json").write_text("\n{broken\n")
    got = files.read_overrides(spark, log).collect()
    assert len(got) == 2 and got[0].stage1_scores == {"tenengrad": 12.0} and got[0].from_label == "keeper"


def test_taste_training_is_gated_and_beats_chance(spark):
    rng = np.random.default_rng(1337)
    data = [("keeper" if i % 2 else "rejected", {k: float((0.8 if i % 2 else 0.2) + rng.normal(scale=0.05)) for k in "abc"}) for i in range(60)]
    log = spark.createDataFrame(data, "user_decision string, stage1_scores map<string,double>")
    model = feedback.train(feedback.training_rows(log))
    test = spark.createDataFrame([([0.8, 0.8, 0.8],), ([0.2, 0.2, 0.2],)], "f array<double>")
    good, bad = [r.taste for r in feedback.score(test, "f", model, 25).collect()]
    assert good > 0.6 > 0.4 > bad
    assert feedback.score(test, "f", None, 0).first().taste_source == "warmstart"
    assert feedback.gate(0, 49) == (49, False) and feedback.gate(49, 1) == (0, True)
    assert feedback.train(feedback.training_rows(log.where("user_decision = 'keeper'"))) is None


def test_scan_and_manifest(spark, tmp_path):
    for name in ("a.JPG", "synth_blur_1.jpg", "c.png"):
        (tmp_path / name).write_bytes(b"x" * 10)
    found = images.scan(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["a.JPG", "synth_blur_1.jpg"]
    content = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = files.manifest(content, content.where("path like '%a.JPG'").select("path"))
    assert rows(got, "name", "category") == [("a.JPG", "burst"), ("c.png", "real"), ("synth_blur_1.jpg", "synth_blur")]


def test_streamed_tallies_and_gated_retraining(spark, tmp_path):
    from winnow.streaming import overrides as stream

    log = str(tmp_path / "log")
    d = spark.createDataFrame([(f"p/{i}.jpg", "uncertain", float(i % 2)) for i in range(60)], "path string, decision string, tenengrad double")
    files.append_overrides(files.override_entries(d, F.when(F.col("tenengrad") > 0, "keeper").otherwise("rejected"), "s", "tui"), log)
    models = []
    for _ in range(2):
        stream.retrain(stream.read(spark, log), log, str(tmp_path / "ck"), str(tmp_path / "state"), models.append).awaitTermination()
    assert len(models) == 1


def test_tables_of_a_query_go_once_its_result_is_read(spark):
    import os

    from winnow.tables import scratch, shared_dir, tables_removed

    named = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("winnow-")}
    before = named()
    kept = scratch(spark.range(3), "kept")
    with tables_removed():
        outer = scratch(spark.range(5), "outer")
        with tables_removed():
            assert scratch(spark.range(4), "inner").count() == 4
        assert outer.count() == 5 and len(named() - before) == 2
    assert len(named() - before) == 1 and kept.count() == 3
    with pytest.raises(ZeroDivisionError), tables_removed():
        scratch(spark.range(2), "lost")
        raise ZeroDivisionError
    assert len(named() - before) == 1


def test_decisions_come_from_whatever_is_known_of_an_id(spark):
    from winnow.operators import decide

    scan = spark.createDataFrame([(k, f"f{k}") for k in range(8)] + [(None, "none")], "id bigint, name string")
    s1 = spark.createDataFrame([(0, True, None), (1, False, "blur"), (3, None, None), (99, True, None)], "id bigint, passed boolean, reject_reason string")
    s2 = spark.createDataFrame([(0, "KEEPER", 0.8), (4, "AMBIGUOUS", 0.5), (5, "AMBIGUOUS", 0.5), (2, None, None)], "id bigint, routing string, composite double")
    s3 = spark.createDataFrame([(4, True, 0.9), (5, None, 0.1)], "id bigint, kept boolean, confidence double")
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "id bigint")
    out = decide.assemble(scan, s1, s2, s3, ids(6, 6, None), ids(7, None), "id")
    assert out.columns == ["id", "name", "passed", "reject_reason", "routing", "composite", "kept", "confidence", "is_loser", "is_duplicate", "decision", "stage_reached"]
    got = {r.id: (r.decision, r.stage_reached, r.is_loser, r.is_duplicate) for r in out.collect()}
    assert out.count() == 9 and got == {
        0: ("keeper", 2, False, False), 1: ("rejected", 1, False, False), 2: ("uncertain", 1, False, False), 3: ("uncertain", 1, False, False),
        4: ("keeper", 3, False, False), 5: ("uncertain", 3, False, False), 6: ("rejected", 1, True, False), 7: ("duplicate", 1, False, True), None: ("uncertain", 1, False, False),
    }
