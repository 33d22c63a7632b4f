"""Piece encoding, ranked search and hard negatives against the library, plain Python and edge tables."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from winnow.llm import lexical, negatives, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b ", "▁a▁ b", "a▁ b", "<s> </s> <unk> <0x41>", "日本語テキスト" * 50, "x" * 5000, "\x00a", "é ﷺ😀😀  😀", "\t\n a", "a " * 9000 + " " * 300, "￿�", "aé" * 9000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_spans_and_texts_equal_the_library(spark, library):
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD)] + [(None, "twice twice", "x", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, other int")
    back = pieces.decode(pieces.encode(docs, PATH), PATH, text_col="again").collect()
    assert len(back) == len(rows) and {r.other for r in back} == {7}
    for r in back:
        text = (ODD[r.doc_id] if r.doc_id is not None else "twice twice") or ""
        assert r.ids == library.encode(text, add_eos=True)
        assert r.again == library.decode(r.ids)
        b = text.encode()
        assert b"".join(b[a:z] for a, z in zip(r.starts, r.ends)) == b


def test_spans_agree_with_the_library(library):
    e = pieces.Encoder(pieces.Model(open(PATH, "rb").read()))
    for text in ("Hello  wörld ab", "naïve café — 12", " x"):
        b, (ids, starts, ends) = text.encode(), e.encode(text, end=False)
        want = library.encode(text, return_type="proto").pieces
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want] and ends[-1] == len(b)


def test_every_document_goes_through_encode_and_back(spark, library):
    got = {r.doc_id: r for r in pieces.op11_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes) == (len(ids), *sha, len((d.text or "").encode()))


def test_any_ids_decode_as_the_library_says(library):
    m, r = pieces.Model(open(PATH, "rb").read()), random.Random(1)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(0, 262), r.randrange(3, 259), 28705]) for _ in range(r.randrange(12))]
        assert m.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("squash", [False, True])
def test_character_maps_normalise_and_align_as_the_library(rule, prefix, squash):
    one = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squash, escape_whitespaces=True)
    spec = dict(pieces.fields(next(v for f, v in pieces.fields(one.serialized_model_proto()) if f == 3)))
    m = pieces.Model.__new__(pieces.Model)
    m.map, m.add_prefix, m.squash = pieces.CharMap(spec.get(2, b"")), prefix, squash
    assert bool(m.map.units) == (rule != "identity")
    texts = ["ﬁ  ½ ﷺ　é Å ＡＢＣ ｶﾞ  ", "", "a b", "\t x y​z", "각 가 ", " lead and trail  ", "ǅ ẞ ℌ ² ③"]
    for text in texts:
        got, want = m.normalise(text), one.normalize(text, with_offsets=True)
        b = text.encode()
        assert got[0] == want[0]
        assert [len(b[:k].decode()) for k in got[1].tolist()] == list(want[1])


def test_a_mapped_text_takes_its_spans_from_the_source():
    m = pieces.Model(open(PATH, "rb").read())
    spec = dict(pieces.fields(next(v for f, v in pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if f == 3)))
    m.map = pieces.CharMap(spec[2])
    text = "ﬁne ＡＢＣ ½😀"
    ids, starts, ends = pieces.Encoder(m).encode(text, end=False)
    b = text.encode()
    assert m.decode(ids.tolist()) == "fine ABC 1⁄2😀"
    assert b[: ends[-1]] == b and all(b[a:z].decode("utf-8", "replace") for a, z in zip(starts, ends) if z > a)
    assert np.all(np.diff(starts) >= 0) and ends[0] <= len("ﬁne".encode())


def test_other_models_and_empty_tables(spark):
    with pytest.raises(ValueError):
        pieces.Model(b"")
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pieces.decode(pieces.encode(docs, PATH), PATH).count() == 0


def test_the_cache_has_a_bound():
    e = pieces.Encoder(pieces.Model(open(PATH, "rb").read()), cache_bytes=5000)
    want = pieces.Encoder(e.model)
    for k in range(50):
        text = f"word{k} some{k % 7} other"
        assert e.encode(text)[0].tolist() == want.encode(text)[0].tolist()
        assert e.cache.held <= 5000 and len(e.cache) < 30


# ---------------------------------------------------------------- ranked search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_search(docs, items, k=10):
    terms = [(i, TERM.findall(lower(t or ""))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    held = {}
    for _, t in terms:
        for x in set(t):
            held[x] = held.get(x, 0) + 1
    wanted = {}
    for item, t in items:
        if t is not None:
            wanted.setdefault(item, set()).update(x for x in TERM.findall(lower(t)) if x in held)
    out = []
    for item, want in wanted.items():
        scores = []
        for i, t in terms:
            m = 10 + (90 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[x] + 1))) * ((1000000000 * c) // (1000 * c + 8 * m)) for x in want if (c := t.count(x)))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id string, text string")
    return sorted((tuple(r) for r in lexical.search(d, i, **how).collect()), key=str)


def test_ranks_equal_plain_scores_on_ties_repeats_and_odd_rows(spark):
    r = random.Random(3)
    words = ["a", "B", "b", "c9", "É", "é", "日本", "d", "rare", "common"]
    docs = [(k, " ".join(r.choices(words, k=r.randrange(0, 30)))) for k in range(300)]
    docs += [(5, "a b a"), (5, "a b a"), (None, "rare rare"), (900, None), (901, "!!"), (902, "common " * 6000 + "rare"), (903, "rare rare"), (904, "rare rare")]
    items = [("x", "a b rare"), ("y", "RARE, rare!"), ("y", "日本"), (None, "é É"), ("none", "zzz"), ("z", None), ("w", "..."), ("all", " ".join(words))]
    assert found(spark, docs, items) == plain_search(docs, items)
    assert found(spark, docs, items, block_bytes=16, step=1, k=3) == plain_search(docs, items, 3)


def test_search_of_nothing(spark):
    assert found(spark, [], [("x", "a")]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, "a"), (2, None)], [("x", "a")]) == plain_search([(1, "a"), (2, None)], [("x", "a")])


def test_the_search_stops_before_the_lists_end(spark):
    docs = spark.createDataFrame([(k, "needle " * (k % 50 + 1) + f"hay{k} " * 40) for k in range(2000)], "doc_id bigint, text string").coalesce(1)
    size = lexical.corpus_size(docs)
    row = lexical.build_index(docs, size).first()
    segment = lexical.Segment(*[row[c] for c in ("ids", "known", "terms", "sizes", "docs", "impacts", "forward")])
    items = lexical.Items(["i"], ["needle"])
    items.weigh(np.array([200]), 2000)
    at = np.searchsorted(segment.terms, items.vocabulary)
    best = lexical.Best(10)
    read = lexical.threshold_search(segment, at, items.weights, best, step=8)
    assert read < 100 and len(best.score) == 10
    lists = [segment.impacts[a:z] for a, z in zip(segment.first[:-1], segment.first[1:])]
    assert all((np.diff(x) <= 0).all() for x in lists)


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, every=50):
    v = []
    for k, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        v.append((k, i, label, [math.floor(256 * c) for c in x]))
    last = 1 << 62
    out = []
    for k, i, label, x in v:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), last if j is None else j, m, j, other) for m, j, other, y in v if m != k)
        for s, _, _, j, _ in [t for t in scored if t[4] == label][:5]:
            window = [t for t in scored if t[4] != label and -50 * s <= -100 * t[0] <= -95 * s]
            out += [(i, j, n + 1, t[3], -s, -t[0]) for n, t in enumerate(window[:3])]
    return sorted(out, key=str)


def vectors(n, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 6)) * r.choice([0.2, 1.0, 4.0], size=(n, 1))
    return [(k, [float(np.float32(c)) for c in x[k]], int(k * 7919 % 4)) for k in range(n)]


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "kept") for r in rows], "vec_id bigint, embedding array<float>, label int, score string").repartition(3)
    return sorted((tuple(r) for r in negatives.mine(df, **how).collect()), key=str)


def test_negatives_equal_brute_force_over_many_buckets(spark):
    rows = vectors(500)
    assert mined(spark, rows, bucket_rows=16, group_rows=64, chunk_rows=4) == plain_negatives(rows)


def test_negatives_with_ties_repeats_and_odd_rows(spark):
    rows = vectors(120)
    rows += [(1000 + k, [0.5, 0.25, 0.0, 0.0, 0.0, 1.0], k % 3) for k in range(90)]  # many copies of one vector
    rows += [(100, rows[100][1], rows[100][2])] * 2 + [(50, [1.0] * 6, 1), (150, [1.0] * 6, 1)]
    rows += [(200, None, 1), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (300, [float("nan")] * 6, 1), (350, [float("inf")] * 6, 2), (400, [0.1] * 6, None), (450, [0.0] * 6, 3), (None, [1.0] * 6, 2), (500, [], 1), (550, [2.0, 1.0], 2)]
    assert mined(spark, rows, bucket_rows=32, group_rows=64, chunk_rows=3) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == [] and mined(spark, [(51, [1.0], 1), (52, [1.0], 2)]) == []


def test_low_norms_are_not_read():
    """A bucket whose bound is below the running k-th score is skipped: of a bucket of poison no score is ever taken."""
    import pyarrow as pa

    def pack(hi, keys, vectors):
        return {"hi": hi, "keys": np.array(keys).tobytes(), "ids": np.array(keys).tobytes(), "labels": np.ones(len(keys), np.int64).tobytes(), "width": 2, "vectors": np.array(vectors, dtype=float).tobytes()}

    anchors = pa.Table.from_pylist([pack(10.0, [1], [[10, 0]])])
    buckets = pa.Table.from_pylist([pack(1.0, [7, 8], [[1e9, 0], [1e9, 0]]), pack(9.0, [2, 3], [[9, 0], [8, 0]])])
    assert negatives._positives(anchors, buckets, 2)["key"].to_pylist() == [2, 3]


def test_windows_far_above_most_norms(spark):
    rows = [(50, [4.0, 0.0], 1), (51, [4.0, 0.0], 1)] + [(100 * k + 1, [0.001, 0.0], 2) for k in range(1, 60)] + [(60, [3.0, 0.0], 2)]
    assert mined(spark, rows, bucket_rows=4, group_rows=4) == plain_negatives(rows)
