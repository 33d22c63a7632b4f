"""URL filters: explicit rules, then path-template trees, in DataFrame operations only.

Where no rule fits a url, its path is generalised into a template of its host's tree: a segment is a wildcard if it
looks variable (digits, long hexadecimal) or if its node has more than `fan_out` different children.  Every node
(host, template prefix) counts good and bad labelled pages below it.  Sibling branches of a host are merged when they are
statistically alike: those whose share of bad pages differs by no significant amount (z test) from the share over
all labelled siblings become one branch with their counts summed; a branch that differs keeps its own.  Branches
without labels have nothing to compare.  A template's purity is smoothed down its branch: each node's share of good
pages, plus `smooth` pseudo-pages of a prior.  The prior is the purity of the same prefix over all hosts, where that
has labels, and else that of the node's parent.  A template under `least_purity` is rejected.

Pages are first collapsed to templates per host with map-side sums, and the tree works on those.  A node is known by a
hash of its prefix, made by running xor over a path's segments, so the work is in proportion to the segments, however
long a path is.  Joins by node or template deal the values that many rows share over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import drop_scratch, hot_values, lookup, scratch, spread

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^[0-9]+([^0-9a-zA-Z].*)?$|[0-9]{3,}|^[0-9a-fA-F-]{8,}$"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path) of a url; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: F.Column, path: F.Column, rules: tuple = RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits; null if none does.  A list of up to a few hundred rules is meant."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: F.Column) -> F.Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike(VARIABLE), "*").otherwise(x))


def template_id(host: F.Column, raw: F.Column) -> F.Column:
    """16 bytes for a host and a path's segments joined by /; a host has no / in it."""
    return F.unhex(F.md5(F.concat(host, F.lit("/"), raw)))


def _dealt(df: DataFrame, key: str, table: DataFrame, using: DataFrame) -> DataFrame:
    return lookup(df, key, table, hot_values(using, key), "_spread")


def _nodes(steps: DataFrame, segment: str) -> DataFrame:
    """steps (tid, hid, k from 1, segment) with place, a hash of the prefix that ends there, node (with the host) and up, the node above."""
    own = F.xxhash64("k", segment)
    so_far = F.bit_xor(own).over(Window.partitionBy("tid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    placed = steps.withColumn("place", so_far)
    return placed.withColumn("node", F.xxhash64("hid", "place")).withColumn("up", F.xxhash64("hid", F.col("place").bitwiseXOR(own)))


def template_verdicts(pages: DataFrame, fan_out: int = 30, smooth: float = 10.0, z: float = 2.0, least_purity: float = 0.5) -> DataFrame:
    """(tid, template, purity, rejected) for each host and generalised path.  pages: host, raw (segments joined by /), good, bad (0 or 1)."""
    seen = scratch(pages.groupBy("host", "raw").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(template_id(F.col("host"), F.col("raw")).alias("tid"), F.xxhash64("host").alias("hid"), "raw", "good", "bad"), "templates")
    steps = spread(seen, "_spread").where("raw != ''").select("tid", "hid", "good", "bad", "_spread", F.posexplode(F.split("raw", "/")).alias("k", "child")).withColumn("k", F.col("k") + 1)
    steps = scratch(_nodes(steps, "child").drop("place", "node"), "steps")
    wide = steps.select("up", "child").distinct().groupBy("up").agg(F.count("*").alias("n")).where(F.col("n") > fan_out).select("up", F.lit(True).alias("wide"))
    named = _dealt(steps, "up", wide, steps).select("tid", "hid", "k", "good", "bad", "_spread", F.when(F.col("wide"), "*").otherwise(F.col("child")).alias("step"))
    roots = spread(seen, "_spread").select("tid", "hid", F.lit(0).alias("k"), "good", "bad", "_spread", F.lit("").alias("step"), F.lit(0).cast("bigint").alias("place"), F.xxhash64("hid", F.lit(0).cast("bigint")).alias("node"), F.lit(None).cast("bigint").alias("up"))
    nodes = scratch(_nodes(named, "step").unionByName(roots), "nodes")

    own = scratch(nodes.groupBy("node").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.first("up", True).alias("up")).where("g + b > 0"), "counts")
    siblings = own.where("up is not null").groupBy("up").agg(F.sum("g").alias("sg"), F.sum("b").alias("sb"))
    n, share = F.col("g") + F.col("b"), (F.col("sb") + 0.5) / (F.col("sg") + F.col("sb") + 1.0)
    differs = F.abs(F.col("b") / n - share) > z * F.sqrt(share * (1 - share) / n)
    tested = scratch(_dealt(spread(own, "_spread"), "up", siblings, own).select("node", "up", "g", "b", "_spread", F.when(F.col("up").isNull() | differs, False).otherwise(True).alias("alike")), "tested")
    merged = tested.where("alike").groupBy("up").agg(F.sum("g").alias("mg"), F.sum("b").alias("mb"))
    alone = tested.where("not alike").select("node", "g", (F.col("g") + F.col("b")).alias("n"))
    counts = alone.unionByName(_dealt(tested.where("alike"), "up", merged, tested.where("alike")).select("node", F.col("mg").alias("g"), (F.col("mg") + F.col("mb")).alias("n")))
    everywhere = nodes.groupBy("place").agg(F.sum("good").alias("pg"), F.sum(F.col("good") + F.col("bad")).alias("pn")).where("pn > 0")
    total = nodes.where("k = 0").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    prior = (total.g + 1.0) / (total.g + total.b + 2.0)

    zero = F.lit(0).cast("bigint")
    counts = scratch(counts, "merged")
    known = _dealt(_dealt(nodes.select("tid", "k", "step", "node", "place", "_spread"), "node", counts, nodes), "place", everywhere, nodes)
    branch = known.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("g", zero).alias("g"), F.coalesce("n", zero).alias("n"), F.coalesce("pg", zero).alias("pg"), F.coalesce("pn", zero).alias("pn"), "step"))).alias("branch"))

    def down(s: F.Column, x: F.Column) -> F.Column:
        q = (x["pg"] + smooth * s["q"]) / (x["pn"] + smooth)
        p = (x["g"] + smooth * F.when(x["pn"] > 0, q).otherwise(s["p"])) / (x["n"] + smooth)
        return F.struct(p.alias("p"), q.alias("q"))

    purity = F.aggregate("branch", F.struct(F.lit(prior).alias("p"), F.lit(prior).alias("q")), down)["p"]
    template = F.concat(F.lit("/"), F.array_join(F.transform(F.slice("branch", F.lit(2), F.size("branch")), lambda x: x["step"]), "/"))
    judged = scratch(branch.select("tid", template.alias("template"), purity.alias("purity")).withColumn("rejected", F.col("purity") < least_purity), "judged")
    for done in (seen, steps, nodes, own, tested, counts):
        drop_scratch(done)
    return judged


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple = RULES, **how) -> DataFrame:
    """pages with host, path, rule, verdict, template, purity; one row per row of pages; other columns
    stay, but for those with the name of an added one, or tid, ruled and rejected.

    Labelled pages are those a rule decides: allow is good, block is bad.  A null or empty url, or one without ://, has an
    empty host and path and is judged by the root of that host's tree.  Urls of any length are judged whole; repeated
    rows all stay and count; of rules of equal length the later by verdict, host and path wins; a purity at the
    threshold is allowed.  An empty table gives an empty result.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "template", "purity", "tid", "ruled", "rejected", "_spread", "_salt")
    host, path = split_url(F.col(url_col))
    parsed = spread(pages, "_spread").withColumn("host", host).withColumn("path", path)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    raw = F.array_join(segments(F.col("path")), "/")
    labelled = parsed.select("host", raw.alias("raw"), F.when(F.col("ruled") == "allow", 1).otherwise(0).alias("good"), F.when(F.col("ruled") == "block", 1).otherwise(0).alias("bad"))
    found = template_verdicts(labelled, **how)
    parsed = parsed.withColumn("tid", template_id(F.col("host"), raw))
    out = _dealt(parsed, "tid", found, parsed)
    return out.withColumn("verdict", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))).select(*pages.columns, "host", "path", "rule", "verdict", "template", "purity")


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; nulls, empty and very long urls, ties, repeats and empty tables as in judge_urls."""
    found = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _BY_LENGTH]
ORACLE_SQL = {
    "op6_urls": f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in _FITS)} END AS rule, CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, _, v in _FITS)} END AS ruled,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '{VARIABLE}') THEN '*' ELSE x END) AS raw FROM b),
s AS (SELECT host, raw, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM c GROUP BY ALL),
e AS (SELECT host, raw, unnest(range(1, len(raw) + 1)) AS k FROM s),
w AS (SELECT host, parent FROM (SELECT DISTINCT host, raw[1 : k - 1] AS parent, raw[k] AS child FROM e) GROUP BY ALL HAVING count(*) > 30),
m AS (SELECT e.host, e.raw, list(CASE WHEN w.host IS NOT NULL THEN '*' ELSE e.raw[k] END ORDER BY k) AS template
  FROM e LEFT JOIN w ON e.host = w.host AND e.raw[1 : k - 1] = w.parent GROUP BY ALL),
n AS (SELECT s.host, s.raw, coalesce(m.template, []) AS template, good, bad FROM s LEFT JOIN m ON s.host = m.host AND s.raw = m.raw),
t AS (SELECT host, template, sum(good) AS good, sum(bad) AS bad FROM n GROUP BY ALL),
d AS (SELECT host, template, good, bad, depth, template[1 : depth] AS prefix FROM (SELECT *, unnest(range(0, len(template) + 1)) AS depth FROM t)),
o AS (SELECT host, prefix, sum(good)::DOUBLE AS g, sum(bad)::DOUBLE AS b FROM d GROUP BY ALL HAVING sum(good) + sum(bad) > 0),
i AS (SELECT host, prefix[1 : len(prefix) - 1] AS up, (sum(b) + 0.5) / (sum(g) + sum(b) + 1.0) AS share FROM o WHERE len(prefix) > 0 GROUP BY ALL),
x AS (SELECT o.host, o.prefix, i.up, g, b, i.up IS NOT NULL AND NOT abs(b / (g + b) - share) > 2.0 * sqrt(share * (1 - share) / (g + b)) AS alike
  FROM o LEFT JOIN i ON o.host = i.host AND len(o.prefix) > 0 AND o.prefix[1 : len(o.prefix) - 1] = i.up),
y AS (SELECT host, prefix, CASE WHEN alike THEN sum(g) OVER same ELSE g END AS g, CASE WHEN alike THEN sum(g + b) OVER same ELSE g + b END AS n
  FROM x WINDOW same AS (PARTITION BY host, up, alike)),
p AS (SELECT prefix, sum(good)::DOUBLE AS pg, (sum(good) + sum(bad))::DOUBLE AS pn FROM d GROUP BY ALL),
q AS (SELECT (coalesce(sum(good), 0) + 1.0) / (coalesce(sum(good), 0) + coalesce(sum(bad), 0) + 2.0) AS prior FROM t),
z AS (SELECT d.host, d.template, list((coalesce(g, 0.0), coalesce(n, 0.0), pg, pn) ORDER BY depth) AS l FROM d JOIN p USING (prefix) LEFT JOIN y ON d.host = y.host AND d.prefix = y.prefix GROUP BY ALL),
u AS (SELECT host, template, list_reduce(list_prepend((prior, prior, 0.0, 0.0), l), lambda s, v:
  ((v[1] + 10.0 * CASE WHEN v[4] > 0 THEN (v[3] + 10.0 * s[2]) / (v[4] + 10.0) ELSE s[1] END) / (v[2] + 10.0), (v[3] + 10.0 * s[2]) / (v[4] + 10.0), 0.0, 0.0))[1] AS purity FROM z, q)
SELECT page_id, c.host, path, rule, coalesce(ruled, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(n.template, '/') AS template, round(purity, 6) AS purity
FROM c JOIN n ON c.host = n.host AND c.raw = n.raw JOIN u ON n.host = u.host AND n.template = u.template
""",
}
