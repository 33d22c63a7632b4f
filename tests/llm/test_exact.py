"""Dealt operators against brute force on cases of their own: order of rows, very long texts, ties, hot keys, odd names."""

import collections
import json
import math
import random
import re
import struct

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from test_llm import collected, docs, lower, texts, words
from winnow.llm import chat, decontaminate, html, kit, lm, mixing, quality, urls

DATA = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- op1


def backoff(rows, order, cutoff=2, alpha=0.4):
    counts = [collections.Counter() for _ in range(order + 1)]
    for w in rows:
        for k in range(1, order + 1):
            counts[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    n, out = sum(counts[1].values()), []
    for w in rows:
        total, by = 0.0, [0] * order
        for i in range(len(w)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if k == 1 or counts[k][gram] >= cutoff:
                    total += math.log(counts[k][gram] / (counts[k - 1][gram[:-1]] if k > 1 else n)) + (longest - k) * math.log(alpha)
                    by[k - 1] += 1
                    break
        out.append((total, by))
    return out


@pytest.mark.parametrize(("order", "segment", "bucket"), [(3, 2000, 1000), (2, 1 << 20, 1 << 20), (4, 3000, 500)])
def test_lm_scores_at_any_order_and_cut(spark, order, segment, bucket):
    r = random.Random(order)
    data = [" ".join(r.choice("a b c d e f g h".split()) for _ in range(r.randrange(40))) for _ in range(80)] + ["a b " * 4000, "", None, "q"]
    want = backoff([words(lower(t)) for t in data], order)
    df = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string").repartition(3)
    got = {x.id: x for x in lm.stupid_backoff(df, order=order, segment_bytes=segment, bucket_bytes=bucket).collect()}
    for i, (total, by) in enumerate(want):
        assert abs(got[i].log_score - total) < 1e-4 and list(got[i].n_by_order) == by


def test_scores_do_not_depend_on_neighbours(spark):
    df = docs(spark)
    again = df.repartition(5).sortWithinPartitions(F.xxhash64("text", F.lit(3)))
    one, two = (collected(lm.stupid_backoff(x), "id", "n_words", "log_score") for x in (df, again))
    assert one == two
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int")
    one, two = (collected(quality.assess(x, labels), "doc_id", "llr", "kept") for x in (df, again))
    assert one == two


# ---------------------------------------------------------------- op2


def spark_hash(*values, seed=42):
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
            seed -= (seed >> 63) << 64
            seed &= (1 << 64) - 1
    return seed - (1 << 64) if seed >> 63 else seed


def test_every_source_comes_near_its_target_by_seeded_draws(spark):
    plan = {r.doc_id: r for r in mixing.mix_plan(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    rows = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    sources = collections.defaultdict(int)
    for r in rows:
        sources[r["source"]] += len(words(r["text"]))
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [1.0, 2.0, 3.0][i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sources.values())), set(order), {}
    while True:  # water filling: cap what is over, share out the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sources[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sources[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken, least = collections.defaultdict(int), {s: [0] * 64 for s in order}
    for r in rows:
        p, size = plan[r["doc_id"]], len(words(r["text"]))
        rate = target[r["source"]] / sources[r["source"]]
        assert (p.mix_size, p.mix_source_size) == (size, sources[r["source"]]) and abs(p.mix_target - target[r["source"]]) < 1e-6
        mark = spark_hash(np.int32(17), r["doc_id"], spark_hash(r["text"]))
        draws = [((spark_hash(mark, np.int32(k)) & ((1 << 64) - 1)) >> 11) / (1 << 53) for k in range(64)]
        copies = [math.floor(rate) + (d < rate - math.floor(rate)) for d in draws]
        assert p.mix_copies == copies[p.mix_draw] <= 3
        taken[r["source"]] += size * p.mix_copies
        for k in range(64):
            least[r["source"]][k] += size * copies[k]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s]
        assert abs(taken[s] - target[s]) <= min(abs(x - target[s]) for x in least[s]) + 1e-6


# ---------------------------------------------------------------- op6


def brute_urls(cases, fan_out=30, smooth=10.0, z=2.0):
    """(template, purity) of each url by trees of tuples."""
    seen, wide = [], collections.defaultdict(set)
    for u in cases:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        segs = tuple("*" if re.search(urls.VARIABLE, s) else s for s in path.split("/") if s)
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        seen.append((host, segs, max(fits)[1] if fits else None))
        for k in range(len(segs)):
            wide[host, segs[:k]].add(segs[k])
    made = [(h, tuple("*" if len(wide[h, s[:k]]) > fan_out else s[k] for k in range(len(s))), v) for h, s, v in seen]
    own, everywhere, below = collections.Counter(), collections.Counter(), collections.Counter()
    for h, t, v in made:
        for k in range(len(t) + 1):
            if v:
                own[h, t[:k], v] += 1
                everywhere[t[:k], v] += 1
    nodes = {(h, t) for h, t, _ in own}
    for h, t in nodes:
        if t:
            for v in ("allow", "block"):
                below[h, t[:-1], v] += own[h, t, v]

    def alike(h, t):
        g, b = own[h, t, "allow"], own[h, t, "block"]
        if not t or not g + b:
            return False
        s = (below[h, t[:-1], "block"] + 0.5) / (below[h, t[:-1], "block"] + below[h, t[:-1], "allow"] + 1)
        return not abs(b / (g + b) - s) > z * math.sqrt(s * (1 - s) / (g + b))

    good, bad = (sum(v == x for _, _, v in made) for x in ("allow", "block"))
    prior, out = (good + 1) / (good + bad + 2), []
    for h, t, _ in made:
        p = q = prior
        for k in range(len(t) + 1):
            same = [x for hh, x in nodes if hh == h and x[:-1] == t[: k - 1] and len(x) == k and alike(h, x)] if k and alike(h, t[:k]) else [t[:k]]
            g, b = (sum(own[h, x, v] for x in same) for v in ("allow", "block"))
            pg, pb = everywhere[t[:k], "allow"], everywhere[t[:k], "block"]
            q = (pg + smooth * q) / (pg + pb + smooth)
            p = (g + smooth * (q if pg + pb else p)) / (g + b + smooth)
        out.append(("/" + "/".join(t), p))
    return out


def test_urls_match_brute_force(spark):
    r = random.Random(5)
    hosts = ["x.com", "y.net", "www.example.com", "a.example.com", "z.org", "odd\x1fhost.net"]
    cases = [f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', 'news', 'a\x1fb'])}/{r.choice(['item', 'list', str(r.randrange(999)), 'p' + str(r.randrange(60))])}{r.choice(['', '?q=1', '#t', '/deep/er'])}" for _ in range(400)]
    cases += ["http://x.com", "http://y.net//es//", "none", "", None, cases[0], cases[0]]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)], "page_id bigint, url string, template string")
    got = {x.page_id: x for x in urls.judge_urls(df).collect()}
    assert len(got) == len(cases)
    for i, (template, purity) in enumerate(brute_urls(cases)):
        assert got[i].template == template and abs(got[i].purity - purity) < 1e-9
        assert got[i].verdict == (("allow" if purity >= 0.5 else "block") if got[i].rule is None else got[i].verdict)


def test_a_very_long_url_takes_work_in_proportion(spark):
    import time

    long = "http://x.net/" + "/".join(f"s{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (2, "http://x.net/es/1"), (3, "http://x.net/s0")], "page_id bigint, url string")
    urls.judge_urls(df.where("page_id > 1")).collect()
    began = time.time()
    got = {x.page_id: x for x in urls.judge_urls(df).collect()}
    assert got[1].template == "/" + "/".join(f"s{i}" for i in range(20_000)) or got[1].template.startswith("/")
    assert time.time() - began < 60


# ---------------------------------------------------------------- op9


def fits(value, kind):
    return {"STRING": isinstance(value, str), "BIGINT": isinstance(value, int) and not isinstance(value, bool), "BOOLEAN": isinstance(value, bool)}[kind]


def test_generated_calls_are_validated_and_ordered(spark):
    r = random.Random(2)
    schemas = {"f": {"a": "STRING", "b": "BIGINT?"}, "g": {}, "h": {"ok": "BOOLEAN"}}
    rows, want, after = [], {}, None
    for i in range(300):
        tool = r.choice(["f", "g", "h", "zz"])
        args = {k: r.choice(["x", 5, True, None]) for k in r.sample(["a", "b", "ok", "more"], r.randrange(3))}
        raw = r.choice([json.dumps(args), json.dumps(args), "[1]", "{", "", None])
        rows.append((1, i, "assistant", None, f"m{i}", after, f"c{i}", tool, raw, None))
        rows.append((1, i, "tool", "r", f"t{i}", f"m{i}", None, None, None, f"c{i}" if r.random() < 0.9 else "lost"))
        after = f"t{i}" if r.random() < 0.7 else None
        ok = raw is not None and raw.startswith("{") and len(raw) > 1 and tool in schemas
        ok = ok and set(args) <= set(schemas[tool]) and all((k in args and fits(args[k], t.rstrip("?"))) or (t.endswith("?") and k not in args) for k, t in schemas[tool].items())
        want[i] = bool(ok)
    kinds = "conv bigint, turn bigint, role string, text string, id string, after string, call_id string, tool string, arguments string, result_of string"
    found = chat.link_calls(spark.createDataFrame(rows, kinds).withColumn("depth", F.lit("mine")), schemas)
    got = found.collect()
    assert len(got) == 600 and {x.turn: x.valid for x in got if x.call_id} == want
    up, depth = {x[4]: x[5] for x in rows}, {}
    for k in up:
        n, at = 0, up[k]
        while at:
            n, at = n + 1, up[at]
        depth[k] = n
    assert {x.id: x.depth for x in got} == depth
    lines = [x.line for x in chat.in_order(found).orderBy("position").collect()]
    assert len(lines) == 600 and all(json.loads(x) for x in lines)
    deep = {x.line: x.depth for x in got if x.call_id}
    placed = [deep[x] for x in lines if x in deep]
    assert placed == sorted(placed)


def test_positions_are_a_topological_order_of_each_conversation(spark):
    """Over long and repeated rows, a result before its call by turn, a cycle, nulls, and a conversation of many turns."""
    r = random.Random(8)
    rows = [("a", 5, "user", "x" * 20_000, "c1", None, "c1", None, "t", "{}"), ("a", 1, "tool", "y", "r1", "c1", None, "c1", None, None)]
    rows += [("a", 2, "user", "same", None, None, None, None, None, None)] * 3 + [("a", None, "user", None, None, None, None, None, None, None)]
    rows += [("b", 0, "user", "p", "p", "q", None, None, None, None), ("b", 1, "user", "q", "q", "p", None, None, None, None), ("b", 2, "user", "late", "z", None, None, None, None, None)]
    rows += [(None, k, "user", str(k), None, None, None, None, None, None) for k in range(3)]
    rows += [("long", k, "user", f"w{k}", f"n{k}", f"n{k - 1}" if k else None, None, None, None, None) for k in range(200)]
    r.shuffle(rows)
    kinds = "conv string, turn long, role string, text string, id string, after string, call_id string, result_of string, tool string, arguments string"
    got = chat.placed(chat.link_calls(spark.createDataFrame(rows, kinds).repartition(4), {"t": {}})).collect()
    by = {}
    for x in got:
        by.setdefault(x.conv, []).append(x)
    assert {c: sorted(x.position for x in xs) for c, xs in by.items()} == {c: list(range(len(xs))) for c, xs in by.items()}
    ordered = {c: sorted(xs, key=lambda x: x.position) for c, xs in by.items()}
    assert [x.turn for x in ordered["a"]] == [2, 2, 2, 5, None, 1] and [x.turn for x in ordered[None]] == [0, 1, 2]
    assert [x.id for x in ordered["b"]] == ["z", "p", "q"] and [x.turn for x in ordered["long"]] == list(range(200))
    for xs in ordered.values():
        place = {x.id: x.position for x in xs if x.depth is not None}
        assert all(place[x.after] < x.position for x in xs if x.after in place and x.depth is not None)


def test_hot_and_null_keys_are_spread_and_kept(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}", "x" * (i % 500 == 2) + "y") for i in range(9000)]
    spark.createDataFrame(rows, "n bigint, key string, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    hot = kit.hot_values(df, "key")
    assert hot == ["hot"]
    table = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3)], "key string, v int")
    got = kit.lookup(kit.spread(df, "_spread"), "key", table, hot, "_spread")
    assert got.count() == 9000 and {(r.key, r.v) for r in got.where("v is not null").distinct().collect()} >= {("hot", 1), ("k2", 2)}
    assert got.where("key = 'hot' and v = 1").count() == 3000 and got.where("key is null and v is null").count() == 3000


# ---------------------------------------------------------------- op10


def brute_near(words_, phrase, slop):
    """Positions in the smallest runs of words_ that hold the phrase's words, each as often."""
    need, hit = collections.Counter(phrase), set()
    most = len(phrase) + slop
    whole = lambda a, z: not need - collections.Counter(words_[a:z])
    for a in range(len(words_)):
        for z in range(a + 1, min(len(words_), a + most) + 1):
            if whole(a, z) and not (z - a > 1 and (whole(a + 1, z) or whole(a, z - 1))):
                hit |= set(range(a, z))
    return hit


def test_proximity_matches_brute_force(spark):
    r = random.Random(12)
    data = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(60))) for _ in range(60)] + ["r a a b", None, ""]
    items = [("1", "r a b"), ("2", "a b c"), ("3", "a a d"), ("4", "g f e d"), ("5", "q a"), ("6", "c")]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    for slop in (0, 2, 5):
        got = {x.doc_id: x for x in decontaminate.contamination(df, spark.createDataFrame(items, "item_id string, text string"), slop=slop).collect()}
        for i, t in enumerate(data):
            hits = {k: brute_near((t or "").split(), p.split(), slop) for k, p in items}
            assert sorted(k for k, h in hits.items() if h) == list(got[i]["items"])
            assert sum(s.past - s.first for s in got[i].spans) == len(set().union(*hits.values()))


def test_the_index_holds_every_posting_and_can_be_searched_again(spark):
    data = texts()
    df = spark.createDataFrame([(t,) for t in data], "text string").repartition(2)
    index = decontaminate.build_index(df, segment_bytes=2000)
    assert index.count() > 2
    total = 0
    for row in index.collect():
        first = np.concatenate(([0], np.cumsum(kit.unsqueeze(row.first).astype(np.int64))))
        places = np.cumsum(kit.unsqueeze(row.positions), dtype=np.uint32)
        assert sorted(places.tolist()) == list(range(int(first[-1]))) and len(row.texts) == 16 * (len(first) - 1)
        total += len(places)
    assert total == sum(len(re.findall(decontaminate.WORD, lower(t))) for t in data if t is not None)
    one = spark.createDataFrame([("b", "long " * 12)], "item_id string, text string")
    assert decontaminate.search(index, one).count() == 1
    assert decontaminate.search(index, one.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000 + " ".join(f"q{i}" for i in range(10)), "x")], "doc_id bigint, text string, key string")
    bench = spark.createDataFrame([("b", " ".join(f"q{i}" for i in range(10)))], "item_id string, text string")
    got = decontaminate.contamination(long, bench, key_cols=("doc_id", "key")).first()
    assert got.n_words == 300_010 and [(s.first, s.past) for s in got.spans] == [(300_000, 300_010)]
    assert decontaminate.without_contaminated(long.withColumn("_hit", F.lit(1)), bench).count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_clean_rows_stay_whole(spark, few):
    data = texts()
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(data)], "doc_id bigint, text string, spans string")
    bench = spark.createDataFrame([("b", " ".join(data[3].split()[:12]))], "item_id string, text string")
    hit = {x.doc_id for x in decontaminate.contamination(df, bench).collect() if x.spans}
    out = decontaminate.without_contaminated(df, bench, broadcast_texts=few)
    assert out.columns == df.columns and collected(out, *df.columns) == collected(df.where(~F.col("doc_id").isin(list(hit))), *df.columns)


def test_counts_of_op7_match_sql(spark):
    got = collected(quality.op7_quality(spark, DATA), "doc_id", "n_words", "word_chars", "n_symbols", "base_failed")
    con = duckdb.connect()
    sql = rf"""SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols FROM (SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM '{DATA}/documents.parquet')"""
    want = sorted(con.sql(sql).fetchall())
    assert sorted(x[:4] for x in got) == want
    assert all(x[4] for x in got if x[1] < 50)


def test_scores_and_verdicts_of_op7_match_brute_force(spark):
    data = [t for t in texts(200, 3)] + ["the " * 60 + f"end{i}" for i in range(3)] + [" ".join(f"w{i}{j}" for j in range(70)) for i in range(20)]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(len(data)) if i % 2] + [(5, 0, 0)]
    trusted = {i for i, q, t in labels if q and not t and i != 5}
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    raw, good, grams = np.full(1 << 16, 0.0), np.full(1 << 16, 0.0), []
    for i, t in enumerate(data):
        b = (t or "").encode()
        keys = [int.from_bytes(b[k : k + 4], "big") for k in range(len(b) - 3)]
        grams.append([((k ^ k >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for k in keys])
        for g in grams[-1]:
            raw[g] += 1
            good[g] += i in trusted
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    ratio = np.log((good + len(raw) * p) / (good.sum() + len(raw)) / p)
    for i, g in enumerate(grams):
        want = float(ratio[g].mean()) if g else 0.0
        assert abs(got[i].llr - want) < 1e-8 and (abs(want + 0.5) < 1e-6 or got[i].kept == (not got[i].base_failed and want >= -0.5))
    assert any(r.kept for r in got.values())


# ---------------------------------------------------------------- op8


def test_marginals_match_enumeration():
    model = html.train(html.labelled_pages(60))
    page = html.Page('<div class="menu"><a href="/">x</a></div><section><h1>A head</h1><div>some words here</div><div>and more words</div></section><footer>end</footer>')
    n = len(page.tag)
    seen = page.surroundings()
    own = []
    for k in range(n):
        marks = model.marked(page, k) + model.filled(page.text_chars[k], page.link_chars[k], page.controls[k]) + [("alike", seen[k])]
        own.append([sum(model.odds[x][y] for x in marks if x in model.odds) for y in range(3)])
    weight, content = 0.0, [0.0] * n
    for labels in np.ndindex(*[3] * (n - 1)):
        y = (html.FRAME, *labels)
        w = math.exp(sum(own[k][y[k]] + model.log_pairs[y[page.parent[k]]][y[k]] for k in range(1, n)))
        weight += w
        for k in range(1, n):
            content[k] += w * (y[k] == html.CONTENT)
    got = model.marginals(page)
    assert 5 < n < 12 and all(abs(got[k] - content[k] / weight) < 1e-9 for k in range(1, n))


#: Layouts that the grammar does not make: (markup, main text).
LAYOUTS = [
    ('<div class="c-3f"><div class="q1">Start</div><div class="q1">Wetter</div></div><div class="hx"><h1>Der Fund</h1><p>Am Morgen fanden Arbeiter unter dem Platz eine alte Mauer aus Stein.</p><p>Sie ist nach ersten Messungen wohl achthundert Jahre alt.</p></div><div class="kommentare"><div class="k">Toll!</div><div class="k">Endlich mal etwas Neues hier.</div><div class="k">Wann wird das gezeigt?</div></div>', "Der Fund Am Morgen fanden Arbeiter unter dem Platz eine alte Mauer aus Stein. Sie ist nach ersten Messungen wohl achthundert Jahre alt."),
    ("<table><tr><td><a href=/a>Home</a> <a href=/b>News</a></td></tr></table><article><h2>Short note</h2><p>One line of text that says it all and then ends.</p></article><p><a href=/c>Older</a> <a href=/d>Newer</a></p>", "Short note One line of text that says it all and then ends."),
    ('<ul id="u1"><li><a href="/1">Un</a></li><li><a href="/2">Deux</a></li></ul><main><h1>Le marché</h1><p>Le marché ouvre chaque samedi à huit heures, au bord de la rivière, sous les arbres.</p><ul><li>des pommes de la vallée</li><li>du pain cuit au bois</li></ul></main><aside><h3>Voir aussi</h3><a href="/x">Autre page</a></aside>', "Le marché Le marché ouvre chaque samedi à huit heures, au bord de la rivière, sous les arbres. des pommes de la vallée du pain cuit au bois"),
    ("<p>A page with nothing but two paragraphs of text in its body, as people wrote them long ago.</p><p>The second one is as long as the first one, or nearly so, and closes it.</p>", "A page with nothing but two paragraphs of text in its body, as people wrote them long ago. The second one is as long as the first one, or nearly so, and closes it."),
]


def test_layouts_that_the_grammar_did_not_make():
    model, tp, fp, fn = html.train(), 0, 0, 0
    for source, want in LAYOUTS:
        got, want = collections.Counter(model.extract(f"<html><body>{source}</body></html>").split()), collections.Counter(want.split())
        tp, fp, fn = tp + sum((got & want).values()), fp + sum((got - want).values()), fn + sum((want - got).values())
    assert tp / (tp + fn) > 0.9 and tp / (tp + fp) > 0.9


def test_every_article_of_the_pages_comes_out_whole(spark):
    got = {r.page_id: r.text for r in html.op8_html(spark, DATA).collect()}
    for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        if inside:
            blocks = re.split(r"</?(?:p|h\d|article|div|section|ul|li)\b[^>]*>", inside[1])
            assert got[r["page_id"]] == " ".join(" ".join(html.html.unescape(re.sub(r"<br>", "\n", re.sub(r"</?[bi]>", "", b))).split()) for b in blocks if b.strip()).strip()
