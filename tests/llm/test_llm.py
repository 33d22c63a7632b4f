"""The dealt operators against brute force, with nulls, blanks, repeats, long texts and clashing names."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from winnow.llm import chat, decontaminate, html, kit, lm, mixing, quality, sharding, simhash, tokenids, urls
from winnow.llm.kit import Spans, words_of

SPACE = "[^\x20\x09-\x0D]+"


def texts(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    out = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(n)]
    out += [out[0], out[0], out[1] + " extra", None, "", "  \n\t", "one", "ONE", "tab\tand\nline\nline\n \nline", "long " * 3000 + " ".join(f"w{k % 997}" for k in range(6000))]
    return out


def docs(spark, data=None, extra=False):
    data = texts() if data is None else data
    rows = [(i, t, ["b", "a", None][i % 3]) for i, t in enumerate(data)]
    rows += [rows[2], (None, "null id", "a")] if data else []
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.withColumns({k: F.lit("mine") for k in ("n_words", "spans", "items", "kept", "size", "fp", "id", "host")}) if extra else df


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda x: [(v is None, str(v)) for v in x])


def words(t):
    return re.findall(SPACE, t or "")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# ---------------------------------------------------------------- kernels


def test_words_and_hashes_do_not_depend_on_place():
    data = [b"ab cd", b"", b"  ab", b"cd\xc3\xa9 ab"]
    off = np.cumsum([0, *map(len, data)])
    b = np.frombuffer(b"".join(data), np.uint8)
    s, e, first = words_of(b, off)
    got = [bytes(b[i:j]) for i, j in zip(s, e)]
    assert got == [w for d in data for w in d.split()] and first.tolist() == [0, 2, 2, 3, 5]
    h = Spans(b).hashes(s, e)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


# ---------------------------------------------------------------- op1


def test_lm_scores_match_brute_force(spark):
    data = texts()
    got = {r.id: r for r in lm.stupid_backoff(docs(spark, extra=True)).collect() if r.id is not None}
    rows = [*data, data[2], "null id"]
    counts = [collections.Counter() for _ in range(4)]
    for t in rows:
        w = lower(t).split() if t else []
        w = [x for x in words(lower(t))]
        for k in (1, 2, 3):
            counts[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    n = sum(counts[1].values())
    for i in (0, 1, 2, 5, 60, 63, 64, 66, 69):
        w, total = words(lower(data[i])), 0.0
        for k in range(len(w)):
            a, b, c = tuple(w[max(0, k - 2) : k + 1]), tuple(w[max(0, k - 1) : k + 1]), (w[k],)
            if len(a) == 3 and counts[3][a] >= 2:
                total += np.log(counts[3][a] / counts[2][a[:2]])
            elif len(b) == 2 and counts[2][b] >= 2:
                total += np.log(counts[2][b] / counts[1][b[:1]]) + (np.log(0.4) if len(a) == 3 else 0)
            else:
                total += np.log(counts[1][c] / n) + (len(a) - 1) * np.log(0.4)
        assert got[i].n_words == len(w) and abs(got[i].log_score - total) < 1e-6
    assert lm.stupid_backoff(docs(spark, [])).count() == 0


def test_lm_scores_against_another_corpus(spark):
    corpus = spark.createDataFrame([(1, "a b c a b c a b d")], "doc_id bigint, text string")
    got = {r.id: r for r in lm.stupid_backoff(spark.createDataFrame([(1, "a b c"), (2, "x y")], "doc_id bigint, text string"), corpus).collect()}
    assert abs(got[1].log_score - (np.log(3 / 9) + np.log(3 / 3) + np.log(2 / 3))) < 1e-9 and got[2].log_score < got[1].log_score


# ---------------------------------------------------------------- op2


def test_targets_fill_by_weight_under_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 100, None: 500, "z": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size bigint")
    got = {r.source: r for r in mixing.source_targets(df).collect()}
    assert {k: got[k].weight for k in sizes} == {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}
    assert abs(sum(r.target for r in got.values()) - 1610) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in got.values())
    assert got["a"].target == 30 and got["c"].target == 300 and got["z"].target == 0
    assert abs(got["b"].target - got[None].target) < 1e-9


@pytest.mark.parametrize("few", [50_000, 0])
def test_mix_copies_follow_rates_and_repeat(spark, few):
    df = docs(spark, [f"w{i} " * (1 + i % 7) for i in range(900)], extra=True)
    plan = mixing.mix_plan(df, broadcast_sources=few)
    a = collected(plan, "doc_id", "mix_size", "mix_copies")
    assert a == collected(mixing.mix_plan(df, broadcast_sources=few), "doc_id", "mix_size", "mix_copies") and len(a) == df.count()
    got = {r.source: r for r in plan.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target"), F.max("mix_copies").alias("most")).collect()}
    assert all(abs(r.taken - r.target) < 0.15 * r.target and r.most <= 3 for r in got.values())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == plan.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mixed(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- op3


def fingerprint(t, n=3):
    w = words(lower(t))
    g = [] if not w else [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_fingerprints_and_components_match_brute_force(spark):
    data = texts()
    got = collected(simhash.classes(docs(spark, extra=True)), "id", "fp", "component")
    rows = [*enumerate(data), (2, data[2]), (None, "null id")]
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[find(parent, j)] = find(parent, i)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(parent, k)
            low[r] = min(low.get(r, i), i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = [(i, signed(fps[k]), low.get(find(parent, k))) for k, (i, _) in enumerate(rows)]
    assert got == sorted(want, key=lambda x: [(v is None, str(v)) for v in x])
    assert simhash.classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("max_bits", "bucket_rows"), [(2, 2048), (2, 8), (3, 5), (5, 8)])
def test_links_keep_components_even_where_buckets_are_split(spark, max_bits, bucket_rows):
    rng = np.random.default_rng(max_bits)
    near = [int(0x0123456789ABCDEF) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(60)]
    fps = sorted(set(near) | {int(x) for x in rng.integers(0, 1 << 63, 60)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    edges = simhash.link_fingerprints(df, max_bits, bucket_rows=bucket_rows).collect()
    mask = (1 << 64) - 1
    one, two = {x: x for x in fps}, {x: x for x in fps}
    for r in edges:
        one[find(one, r.a & mask)] = find(one, r.b & mask)
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= max_bits:
            two[find(two, a)] = find(two, b)
    groups = lambda p: sorted(sorted(x for x in fps if find(p, x) == r) for r in {find(p, x) for x in fps})
    assert groups(one) == groups(two)


def test_near_duplicates_are_verified_and_one_of_each_group_stays(spark):
    r = random.Random(4)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(12)]
    data = base + [base[0], base[1] + " tail", "head " + base[2], " ".join(base[3].split()[:100] + base[4].split()[:100])]
    df = docs(spark, data, extra=True)
    kept = {x for (x,) in collected(simhash.without_near_duplicates(df), "doc_id")}
    assert kept == {*range(12), 15, None}
    assert simhash.without_near_duplicates(df).columns == df.columns
    assert simhash.without_near_duplicates(docs(spark, [])).count() == 0


def brute_groups(data, size=5, least=0.8):
    """The components of all links of Jaccard similarity `least` or more over word shingles, as sets of positions."""
    sets = []
    for t in data:
        w = t.lower().split()
        sets.append({" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))})
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(data)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= least * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    groups = {}
    for x in range(len(data)):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def edited(r, text, edits):
    w = text.split()
    for k in r.sample(range(len(w)), edits):
        w[k] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def near_groups(spark, data, **how):
    df = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    groups = {}
    for r in simhash.near_duplicates(df, **how).collect():
        groups.setdefault(r.near_group, []).append(r.doc_id)
    return sorted(map(sorted, groups.values()))


def test_near_duplicates_find_every_link_in_a_template_family(spark):
    r = random.Random(8)
    template = " ".join(f"w{r.randrange(5000)}" for _ in range(200))
    family = [edited(r, template, 5) for _ in range(300)]  # pairs of them at about 0.65
    data = family + [edited(r, x, 3) for x in family[:60]]  # copies at about 0.87
    got = near_groups(spark, data)
    assert got == brute_groups(data) and sum(len(g) > 1 for g in got) >= 40


def test_near_duplicates_find_every_pair_down_to_the_threshold(spark):
    r = random.Random(9)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(150)) for _ in range(150)]
    data = base + [edited(r, x, 3) for x in base]  # 0.80 to 0.95
    assert near_groups(spark, data) == brute_groups(data)


def test_texts_of_one_short_hash_are_told_apart_by_another(spark):
    r = random.Random(13)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(40)) for _ in range(60)]
    data = base + base[:20] + [edited(r, x, 1) for x in base[20:40]]
    assert near_groups(spark, data, key_bits=4) == brute_groups(data)


def test_texts_of_nothing_but_common_shingles(spark, monkeypatch):
    dealt = simhash.dealt_prefixes
    monkeypatch.setattr(simhash, "dealt_prefixes", lambda texts, common: dealt(texts, common, most=20))
    r = random.Random(14)
    data = sorted({" ".join(r.choice("abc") for _ in range(r.randrange(8, 40))) for _ in range(700)})
    assert near_groups(spark, data) == brute_groups(data)


def test_a_shingle_of_twenty_thousand_texts_is_dealt_over_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").alias("near_key"), F.col("id").alias("root"), F.lit(1).alias("n"), F.lit(np.uint64(77).tobytes()).alias("prefix"))
    dealt = simhash.dealt_prefixes(rows, np.array([5, 77], dtype=np.uint64))
    assert dealt.groupBy("hash", "salt").count().agg(F.max("count")).first()[0] < 200
    edges = kit.map_batches(dealt, simhash.prefix_edges(0.8), "a bigint, b bigint, family boolean")
    assert sorted(map(tuple, edges.collect())) == [(0, k, True) for k in range(1, 20_000)]
    linked = rows.withColumn("root", F.lit(3).cast("bigint"))
    assert simhash.dealt_prefixes(linked, np.array([77], dtype=np.uint64)).isEmpty()
    plain = simhash.dealt_prefixes(rows.limit(1000), np.array([77], dtype=np.uint64))
    assert {x.salt for x in plain.collect()} == {-1}


def test_common_hashes_are_counted_row_by_row():
    r = np.random.default_rng(5)
    sets = [[np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in range(300)] for _ in range(2)]
    got = simhash.common_counts(*(pa.array([x.tobytes() for x in side], pa.binary()) for side in sets))
    assert got.tolist() == [len(set(x.tolist()) & set(y.tolist())) for x, y in zip(*sets)]
    assert simhash.common_counts(pa.array([], pa.binary()), pa.array([], pa.binary())).tolist() == []


@pytest.mark.parametrize("step", (1, 3, 7, 1000))
def test_sorted_groups_survive_any_cut_into_batches(step):
    r = np.random.default_rng(step)
    keys = np.repeat(np.arange(40), r.integers(1, 12, 40))
    batches = [pa.record_batch([pa.array(keys[k : k + step]), pa.array(np.arange(len(keys))[k : k + step])], names=["k", "v"]) for k in range(0, len(keys), step)]
    got = []
    for (k, v), size in simhash._groups(iter([batches[0].slice(0, 0), *batches]), 1):
        for at, n in zip(np.cumsum(size) - size, size):
            assert len(set(k[at : at + n].tolist())) == 1
            got.append((int(k[at]), v[at : at + n].tolist()))
    assert [k for k, _ in got] == list(range(40)) and [x for _, v in got for x in v] == list(range(len(keys)))


@pytest.mark.parametrize("block_bytes", (400, 2000, 1 << 20))
def test_lengths_too_far_apart_do_not_meet_and_no_link_is_lost(spark, block_bytes):
    r = random.Random(15)
    template = [f"w{r.randrange(5000)}" for _ in range(400)]
    data = [" ".join(template[: int(8 * 1.17**k) + k % 3]) for k in range(24)] + [" ".join(template[100:k]) for k in (110, 112, 140, 150, 250, 290, 330)]
    hashes = [sorted({xxhash.xxh64_intdigest(" ".join(w[k : k + 5]), 42) for k in range(len(w) - 4)}) for w in (x.split() for x in data)]
    sets = spark.createDataFrame([(i, np.array(h, dtype=np.uint64).tobytes()) for i, h in enumerate(hashes)], "key bigint, hashes binary")
    members = spark.createDataFrame([(i, 0, i) for i in range(len(data))], "key bigint, family bigint, root bigint")
    root = list(range(len(data)))
    found = simhash.family_links(members, sets, 0.8, block_bytes).collect()
    for _ in data:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for k, x in enumerate(root):
        groups.setdefault(x, []).append(k)
    assert sorted(groups.values()) == brute_groups(data) and len(groups) > 2


def test_a_hot_fingerprint_keeps_its_component(spark):
    texts = [(k, "same words all over again") for k in range(3000)] + [(k, f"other {k} text of words {k * k}") for k in range(3000, 3020)]
    got = {r.id: r.component for r in simhash.classes(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert len(got) == 3020 and {got[k] for k in range(3000)} == {0}


def test_families_are_compared_whole_in_blocks(spark):
    r = random.Random(10)
    template = " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    data = [edited(r, template, r.randrange(1, 6)) for _ in range(90)]
    words = [x.split() for x in data]
    hashes = [sorted({xxhash.xxh64_intdigest(" ".join(w[k : k + 5]), 42) for k in range(76)}) for w in words]
    sets = spark.createDataFrame([(i, np.array(h, dtype=np.uint64).tobytes()) for i, h in enumerate(hashes)], "key bigint, hashes binary")
    for block_bytes, joined in ((1 << 20, []), (9000, []), (9000, brute_groups(data)[0][:2]), (9000, max(brute_groups(data), key=len)[:-1])):
        root = list(range(90))
        for k in joined:  # linked before: one root
            root[k] = joined[0]
        members = spark.createDataFrame([(i, 0, root[i]) for i in range(90)], "key bigint, family bigint, root bigint")
        found = simhash.family_links(members, sets, 0.8, block_bytes).collect()
        found += [(k, joined[0]) for k in joined]
        for _ in range(90):
            for a, b in found:
                root[a] = root[b] = min(root[a], root[b])
        groups = sorted(sorted(x for x in range(90) if root[x] == k) for k in set(root))
        assert groups == brute_groups(data)


# ---------------------------------------------------------------- op4


def test_ids_equal_the_library_on_odd_texts():
    encode = tokenids.Encoder(tokenids.default_tokenizer())
    assert encode.fast
    r = random.Random(9)
    pool = [chr(c) for c in range(0x21, 0x230)] + list(" \t\n  ßİıſ́ΣςДя日本🙂½²'’") + ["'s", "'LL", "<|endoftext|>", "ing", "The "]
    samples = ["".join(r.choice(pool) for _ in range(r.randint(1, 40))) for _ in range(1500)] + ["x" * 3000, "", "a\x85b\x1cc\xa0d"]
    for s in samples:
        want = encode.tokenizer.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(encode(s.encode()), encode.dtype).tolist() == want, repr(s)


def test_shards_round_trip_with_random_access():
    rng = np.random.default_rng(2)
    ids = rng.choice([5, 6, 7, 300, 49000], 5000).astype(np.uint16)
    first = np.array([0, 0, 10, 2500, 5000])
    shard = tokenids.Shard(tokenids.pack(pa.array([4, None, 6, 7]), ids, first, 49408))
    assert (shard.ids() == ids).all() and len(shard.left) > 0 and len(shard.seq) < len(ids)
    assert shard.slice(2, 100, 160) == ids[110:170].tolist() and shard.slice(0, 0, 5) == [] and shard.slice(1, 8, 50) == ids[8:10].tolist()
    assert shard.nulls.tolist() == [0, 1, 0, 0]


@pytest.mark.parametrize("part_bytes", [1 << 26, 4000])
def test_documents_read_back_from_files(spark, tmp_path, part_bytes):
    tokenids.encode_shards(docs(spark, extra=True), part_bytes=part_bytes, shard_bytes=3000).write.parquet(str(tmp_path / "t"))
    got = [tuple(r) for r in tokenids.read_documents(spark.read.parquet(str(tmp_path / "t"))).orderBy("start").collect()]
    tokenizer = tokenids.Encoder(tokenids.default_tokenizer()).tokenizer
    want, at = [], 0
    data = texts()
    for i, t in sorted([*enumerate(data), (2, data[2]), (-1, "null id")]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((None if i < 0 else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokenids.read_documents(tokenids.encode_shards(docs(spark, []))).count() == 0


def test_re_pair_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(3)
    text = rng.integers(2, 49000, 500)
    ids = np.concatenate([*[text] * 200, np.full(5000, 7)]).astype(np.uint16)
    first = np.append(np.arange(0, 100_001, 500), 105_000)
    seq, at, left, right = tokenids.repair(ids, first, 49408, least=12)
    assert np.diff(at)[:200].tolist() == [1] * 200  # each copy is one symbol at the end
    inside = np.ones(len(seq), dtype=bool)
    inside[at[1:] - 1] = False
    pairs = collections.Counter(zip(seq[:-1][inside[:-1]].tolist(), seq[1:][inside[:-1]].tolist()))
    assert max(pairs.values(), default=0) < 24  # runs of one id overlap with themselves
    assert (tokenids.Shard(tokenids.pack(pa.array(range(201)), ids, first, 49408)).ids() == ids).all()
    wide = rng.integers(0, 3000, 400_000).astype(np.uint16)  # many rules: symbols grow to 32 bits on the way
    shard = tokenids.Shard(tokenids.pack(pa.array([1]), wide, np.array([0, len(wide)]), 65_000))
    assert (shard.ids() == wide).all()


def test_every_document_encodes_as_by_the_library():
    import pyarrow.parquet as pq

    encode = tokenids.Encoder(tokenids.default_tokenizer(), cache_bytes=1 << 20)  # the cache starts anew many times
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    want = encode.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(np.frombuffer(encode((t or "").encode()), encode.dtype).tolist() == w.ids for t, w in zip(texts, want))
    assert encode.pieces.held <= 1 << 20
    encode.rest()
    assert not encode.pieces


# ---------------------------------------------------------------- op5


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    data = [f"t{i}" for i in range(120)] + ["copy"] * 40 + [x for i in range(8) for x in [f"pair{i}"] * 2] + [None, None, ""]
    got = sharding.shard_documents(docs(spark, data, extra=True)).collect()
    assert len(got) == len(data) + 2
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {i: t for i, t in enumerate(data)} | {None: "null id"}
    assert all(r.size == len((text[r.id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.id] or "").encode()) for r in got)
    where = collections.defaultdict(set)
    for r in got:
        where[text[r.id]].add(r.shard)
    assert sum(len(where[f"pair{i}"]) == 1 for i in range(8)) >= 7 and len(where["copy"]) <= 5
    assert sharding.shard_documents(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- op6


def test_rules_pick_the_longest_fit(spark):
    cases = {
        "http://x.COM/a": ("x.com", "/a", "com/", "allow"), "http://com/": ("com", "/", "com/", "allow"), "http://telecom/": ("telecom", "/", None, None),
        "https://b.example.com/en/1?q": ("b.example.com", "/en/1", "example.com/en/", "block"), "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://x.net/es/9#t": ("x.net", "/es/9", "net/es/", "block"), "http://x.net/en": ("x.net", "/en", None, None), "http://x.com": ("x.com", "", None, None), "nothing": ("", "", None, None), None: ("", "", None, None),
    }
    df = spark.createDataFrame([(u, "mine") for u in cases], "url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert set(got) == set(cases)
    for u, (host, path, rule, verdict) in cases.items():
        assert got[u][:3] == (host, path, rule) and got[u][3] in ((verdict,) if verdict else ("allow", "block"))
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_bad_templates_are_rejected_on_evidence(spark):
    rows = [("h", "bad/*", 0, 1)] * 50 + [("h", "good/*", 1, 0)] * 50 + [("h", "new", 0, 0), ("g", "bad/*", 0, 0)] + [("w", f"s{i}", 1, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, raw string, good int, bad int")
    named = df.select("host", "raw", urls.template_id(F.col("host"), F.col("raw")).alias("tid")).distinct()
    got = {(r.host, r.raw): r for r in urls.template_verdicts(df).join(named, "tid").collect()}
    assert got["h", "bad/*"].rejected and got["g", "bad/*"].rejected
    assert not got["h", "good/*"].rejected and not got["h", "new"].rejected
    assert got["w", "s3"].template == "/*"


# ---------------------------------------------------------------- op7


def test_counting_rules_match_brute_force(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(5, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, extra=True)
    got = quality.assess(df.drop("n_words", "kept"), labels).collect()
    assert len(got) == df.count()
    text = dict(enumerate(texts())) | {None: "null id"}
    for r in got:
        t, w = text[r.doc_id] or "", words(text[r.doc_id])
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 2 * len(hit) > len(w)) and (not r.kept or not r.base_failed)
    assert quality.assess(docs(spark, []), labels).count() == 0
    assert {r.llr for r in quality.assess(docs(spark), labels.limit(0)).collect()} == {0.0}


def test_junk_scores_lower_than_what_it_was_trained_on(spark):
    clean = [t for t in texts(300, 7)[:300]]
    junk = [re.sub(r"(\w) ", r"\1*** ", t) for t in texts(60, 8)[:60]]
    df = docs(spark, clean + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.llr for r in quality.assess(df, labels).collect()}
    held_out = [got[i] for i in range(1, 300, 2) if len(clean[i]) > 60]
    assert np.median(held_out) > max(got[300 + i] for i in range(60) if len(junk[i]) > 60)


def test_verdicts_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.assess(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0")).where("not base_failed")
    got = rows.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) > 10


# ---------------------------------------------------------------- op8


@pytest.fixture(scope="module")
def model():
    return html.train()


def test_held_out_pages(model):
    tp = fp = fn = 0
    for source in html.labelled_pages(200, seed=77):
        page = html.Page(source)
        belief, label = model.marginals(page), [0] * len(page.tag)
        for k in range(1, len(page.tag)):
            own = re.search(r'data-label="([01])"', page.attrs[k])
            label[k] = int(own[1]) if own else label[page.parent[k]]
            n, said = page.text_chars[k], belief[k] > 0.5
            tp, fp, fn = tp + n * (label[k] and said), fp + n * (not label[k] and said), fn + n * (label[k] and not said)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


def test_articles_come_out_whole(spark, model):
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy this now please</div><article><h1>Head &amp; line</h1><p><b>Bold start.<br><p>Second\n para&nbsp;graph &lt;ok&gt;.</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I was first to say so here.</p></div></section><footer>&copy; host</footer>'
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "only text", "x"), (1, page, "x")], "page_id bigint, html string, n_chars string")
    got = collected(html.extract_text(df, model), "page_id", "text")
    assert got == [(1, "Head & line Bold start. Second para graph <ok>.")] * 2 + [(2, ""), (3, ""), (4, "only text")]
    assert html.extract_text(df.limit(0), model).count() == 0
    for broken in ("<", "<p", "<p class='", "<!--", "<script>", "a<b>c</b", "<p class=\"a>b\">x</p>", "<" * 500, "</div></p>"):
        model.extract(broken)


# ---------------------------------------------------------------- op9


def test_calls_are_linked_ordered_and_validated(spark):
    rows = [
        (1, 0, "system", "s", None, None, None, None, None, None), (1, 1, "assistant", "", "m1", None, "c1", "f", '{"b": 1, "a": "x"}', None),
        (1, 2, "tool", "r1", "m2", "m1", None, None, None, "c1"), (1, 3, "assistant", "", "m3", "m2", "c2", "f", '{"a": 5}', None), (1, 4, "tool", "r?", "m4", "zz", None, None, None, "c9"),
        (1, 5, "x", "", "m5", "m6", None, None, None, None), (1, 6, "x", "", "m6", "m5", None, None, None, None), (1, 7, "assistant", "", "m7", "m3", "c3", "g", "{", None), (None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string, id string, after string, call_id string, tool string, arguments string, result_of string")
    got = {r.turn: r for r in chat.link_calls(df, {"f": {"a": "STRING", "b": "BIGINT?"}}).collect()}
    assert len(got) == 9
    assert [got[k].status for k in (0, 1, 2, 3, 4, 7, None)] == ["plain", "linked", "linked", "unanswered", "orphan", "unanswered", "plain"]
    assert [got[k].depth for k in (1, 2, 3, 4, 5, 6, 7)] == [0, 1, 2, 0, None, None, 3]
    assert [got[k].valid for k in (0, 1, 3, 7)] == [None, True, False, False]
    assert got[1].line == '{"role":"assistant","tool_call":{"arguments":{"a":"x","b":1},"id":"c1","name":"f"}}'
    assert all(json.loads(r.line) is not None for r in got.values())
    assert chat.link_calls(df.limit(0), {}).count() == 0


def test_long_chains_take_few_rounds(spark):
    df = spark.range(300).select(F.format_string("%04d", "id").alias("id"), F.when(F.col("id") > 0, F.format_string("%04d", F.col("id") - 1)).alias("after"))
    assert collected(chat.depths(df), "id", "depth") == [(f"{k:04d}", k) for k in range(300)]


# ---------------------------------------------------------------- op10


def brute_hits(items, t, window=10):
    cut = lambda x: re.findall(decontaminate.WORD, lower(x))
    w, hit, found = cut(t), set(), set()
    for i, x in items:
        q = cut(x)
        for k in range(max(1, len(q) - window + 1) if q else 0):
            p = q[k : k + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found.add(i)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_matches_brute_force(spark, block_bytes):
    data = texts()
    items = [("q1", " ".join(data[3].split()[:14])), ("q2", "ONE"), ("q3", " , "), ("q4", None), ("q10", " ".join(data[5].split()[-11:])), ("q2", "tab; and-line")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = docs(spark)
    got = decontaminate.contamination(df.drop("source"), bench, block_bytes=block_bytes).collect()
    text = dict(enumerate(data)) | {None: "null id"}
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, sum(s.past - s.first for s in r.spans), list(r["items"])) == brute_hits(items, text[r.doc_id])
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert not any(r.spans for r in decontaminate.contamination(df, bench.limit(0)).collect())


def test_proximity_allows_words_between(spark):
    df = spark.createDataFrame([(1, "red big green then blue"), (2, "red a b c d e f green blue"), (3, "blue green red")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("x", "red green blue")], "item_id string, text string")
    got = {r.doc_id: list(r["items"]) for r in decontaminate.contamination(df, bench, slop=2).collect()}
    assert got == {1: ["x"], 2: [], 3: ["x"]}


# ---------------------------------------------------------------- queries and pipeline


def test_pipeline_keeps_columns_and_decides(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(120)) for _ in range(40)]
    leak = [f"q{i}" for i in range(14)]
    fresh = " ".join(f"v{r.randrange(3000)}" for _ in range(100))
    data = base + [base[0], base[1] + " x", "too short", None, "again again again " * 40, fresh + " " + " ".join(leak[:12]) + " end", fresh.replace("v", "u") + " " + " ".join(leak[:9]), edited(r, base[7], 3)]
    d = docs(spark, data, extra=True).where("doc_id is not null").dropDuplicates(["doc_id"])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", " ".join(leak))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        if k < 4:
            assert after.columns == d.columns
        after.write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(sorted(x.doc_id for x in now.select("doc_id").collect()))
    # each stage against its own brute force on what the stage before kept
    short = {i for i, t in enumerate(data) if len(words(t)) < 50 or len(set(words(t))) < 5}
    assert seen[0] == [i for i in range(len(data)) if i not in short]
    groups = brute_groups([data[i] for i in seen[0]])
    assert any(len(g) > 1 for g in groups) and seen[1] == sorted(seen[0][min(g)] for g in groups)
    assert seen[2] == [i for i in seen[1] if not brute_hits([("b", " ".join(leak))], data[i])[1]] and 45 in seen[1] and 45 not in seen[2] and 46 in seen[2]
    copies = {x.doc_id: x.mix_copies for x in mixing.mix_plan(spark.read.parquet(str(tmp_path / "s2"))).collect()}
    assert seen[3] == sorted(i for i in seen[2] for _ in range(copies[i]))
    tokenizer = tokenids.Encoder(tokenids.default_tokenizer()).tokenizer
    want = [(i, zlib.crc32(np.array([*tokenizer.encode(data[i], add_special_tokens=False).ids, 1], "<u4").tobytes())) for i in seen[3]]
    assert sorted((x.doc_id, x.ids_crc32) for x in now.collect()) == sorted(want)


def test_a_hot_link_is_dealt_over_tasks_and_little_is_cut(spark, tmp_path):
    data = ["hot"] * 3000 + [f"pair{i // 2}" for i in range(3000)] + [f"one{i}" for i in range(3000)]
    spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    got = sharding.shard_documents(spark.read.parquet(str(tmp_path / "d")))
    sizes = [r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    cut = sharding.cut_links(got).first()
    least = 3000 - max(sizes)  # the hot link is larger than a shard
    assert sizes == [1125] * 8 and cut.linked == 6000 and least <= cut.cut <= least + 0.25 * 3000
