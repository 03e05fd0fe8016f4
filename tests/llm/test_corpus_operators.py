"""The corpus operators on small tables: contracts, edge cases, nulls, repeated rows, empty tables."""

import hashlib
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.llm import chaining, components, decontam, mixing, pii, quality, simhash, spotsigs, suffix, tokencount, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_2 string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(3000))
ROWS = [
    (0, "the cat sat on the mat and the dog saw it all from the door " * 6, "en", "s0", 1, "a"),
    (1, None, None, None, None, None),
    (2, "", "en", "s0", 0, ""),
    (3, LONG, "en", "s1", 2, "b"),
    (4, LONG, "en", "s1", 2, "b"),
    (4, LONG, "en", "s1", 2, "b"),
    (None, "no id here", "de", "s2", 3, "c"),
    (7, " ".join(LONG.split()[:600]) + " and another end of the text", "en", "s1", 4, "d"),
    (8, "x" * 5000, "en", "s0", 5, "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (5, 4), (7, 7), (None, 1), (9, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}
    chain = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(chain.limit(0)).count() == 0


def test_url_filters(spark):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    rows = [
        (1, "https://a.example.org/es/1", "<html></html>"),
        (2, "https://b.net/x", link.format("https://a.example.org/es/9#top")),
        (3, "https://c.net/y", '<meta http-equiv="refresh" content="0; url=https://b.net/x">'),
        (4, "https://d.example.com/fr/1", link.format("https://b.net/x")),
        (5, None, None),
        (6, "no scheme", link.format("https://b.net/x")),
        (7, "http://WWW.Example.ORG/en/12?q", ""),
        (8, "http://x.de", None),
        (8, "http://x.de", None),
        (9, "https://e.net/p/q", link.format("/z")),
        (10, "https://e.net/z", ""),
        (11, "https://example.com/de/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = urlfilter.judge_urls(pages)
    assert out.count() == len(rows)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["via"]) for r in out.collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block", "rule")
    assert got[4] == ("d.example.com", "/fr/1", "com/fr/", "allow", "rule")
    # an alias that a rule allows goes before one that a rule blocks
    assert got[2][2:] == (None, "allow", "alias") and got[3][2:] == (None, "allow", "alias")
    assert got[5] == got[6] == ("", "", None, "allow", "default")
    assert got[7] == ("www.example.org", "/en/12", "example.org/en/1", "block", "rule")
    assert got[9][3] == "allow" and got[11][2:4] == ("com/de/", "block")
    blocked = urlfilter.judge_urls(pages.where("page_id in (1, 2, 3)"))
    assert {r["page_id"]: r["verdict"] for r in blocked.collect()} == {1: "block", 2: "block", 3: "block"}
    moved = spark.createDataFrame([("http://x.de", "https://example.com/de/1")], "source string, target string")
    assert {r["verdict"] for r in urlfilter.judge_urls(pages.where("page_id = 8"), redirects=moved).collect()} == {"block"}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_url_filters_equal_their_sql_on_pages_with_links(spark):
    import duckdb
    import pandas

    link = '<html><link {} href="{}"></html>'
    rows = [
        (1, "https://a.example.org/es/1", "<html></html>"), (2, "https://B.net/x", link.format('rel="canonical"', "https://A.example.org/es/9#top")),
        (3, "https://c.net/y", '<meta http-equiv="refresh" content="0; url=https://b.NET/x">'), (4, "http://a.net/x", ""),
        (5, "http://q.net/k", link.format("rel='alternate canonical'", "http://A.net/x")), (6, "http://A.net/x", link.format("rel=canonical", "http://example.com/de/3")),
        (7, "http://r.net", link.format('rel="canonical"', "k/l?q#z")), (8, "http://r.net/k/l?q", link.format('rel="canonical"', "//example.com/de/7")),
        (9, "http://s.net/a/b?c=/d", link.format('rel="canonical"', "e")), (10, "http://s.net/a/e", link.format('rel="canonical"', "/es")),
        (11, "http://t.net/1", "<!-- " + link.format('rel="canonical"', "http://example.com/de/1") + " -->"), (12, "http://t.net/2", "<!-- open " + link.format('rel="canonical"', "http://example.com/de/1")),
        (13, "http://u.net/1", link.format('rel="noncanonical"', "http://example.com/de/1")), (14, None, None), (14, None, None), (15, "none", "<x>"), (4, "http://a.net/x", ""),
        (16, "http://s.net/es", link.format('rel="canonical"', "http://x.org/q")), (17, "http://v.net/1", link.format('rel="canonical"', "http://x.com/de/1") + link.format('rel="canonical"', "http://x.org/1")),
    ]
    pages = pandas.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.sql(f"select page_id, host, path, rule, verdict, via from ({urlfilter.SQL})").fetchall()
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert Counter(map(tuple, got.select("page_id", "host", "path", "rule", "verdict", "via").collect())) == Counter(want)
    by = {r[0]: r[4:] for r in want}
    assert by[2] == by[3] == by[5] == by[4] == by[8] == ("block", "alias") and by[9] == ("allow", "alias") and by[11] == by[12] == by[13] == ("allow", "default")


def brute_repeats(rows, n):
    counts = Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    out = []
    for d, t in rows:
        gone = set()
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                gone.update(range(i, i + n))
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(b for i, b in enumerate(t) if i not in gone)
        out.append((d, len(t), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [suffix.CROWD, 1])
def test_suffix_dedup(spark, docs, none, crowd, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    shared = "the line that many texts have, with words enough to be longer than two hundred bytes, " * 3
    rows = [*ROWS, (20, shared + "one", "en", "s", 1, "f"), (21, "two" + shared, "en", "s", 1, "g"), (22, "3" + shared[:230] + "x", "en", "s", 1, "h")]
    out = suffix.removed_repeats(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_repeats([(r[0], (r[1] or "").encode()) for r in rows], suffix.LENGTH)
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert suffix.removed_repeats(none).count() == 0


def test_chaining(spark, docs, none):
    import random

    random.seed(8)
    words = [f"t{random.randint(0, 9999)}" for _ in range(900)]
    passage = words[100:190]
    edited = [*passage]
    edited[30], edited[60] = "changed", "other"
    rows = [(1, " ".join(words)), (2, " ".join([*words[300:340], *passage, *["q1", "q2"]])), (3, " ".join(["r1", *edited, "r2"])), (4, " ".join(words[300:330]))]
    got = [tuple(r) for r in chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "source_id", "n_words", "identity").collect()]
    pairs = {(a, b): (n, i) for a, b, n, i in got}
    assert (2, 1) in pairs and pairs[2, 1][0] >= 82
    assert (3, 1) in pairs and pairs[3, 1][0] >= 80 and 0.8 <= pairs[3, 1][1] < 1
    assert not any(4 in p for p in pairs)
    found = chaining.fuzzy_passages(docs)
    assert {(r["doc_id"], r["source_id"]) for r in found.collect()} >= {(4, 3), (7, 3)}
    assert chaining.removable(found).where("doc_id = 4").first()["spans"][0]["end_word"] > 2980
    assert chaining.fuzzy_passages(none).count() == 0


def made(rng, n):
    return [f"t{rng.randint(0, 9999)}" for _ in range(n)]


def linked(spark, rows):
    out = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    return {(r["doc_id"], r["source_id"]): (r["first_word"], r["n_words"]) for r in out.collect()}


@pytest.mark.parametrize("hot", [chaining.HOT, 1])
def test_chaining_where_other_documents_hold_pieces(spark, hot, monkeypatch):
    """Copies are found though earlier and later documents hold all of their seeds piecemeal; with seeds
    matched group by group and by joins."""
    monkeypatch.setattr(chaining, "HOT", hot)
    rng = random.Random(3)
    shared = made(rng, 80)
    rows = [(500, made(rng, 60) + shared + made(rng, 50)), (501, made(rng, 40) + shared + made(rng, 70))]
    for i in range(144):
        at = i * 67 // 143
        rows.append((i if i % 2 else 1000 + i, made(rng, 50) + shared[at : at + 13] + made(rng, 50)))
    got = linked(spark, rows)
    assert list(got) == [(501, 500)] and got[501, 500] == (40, 80)
    rows, want = [], set()
    for k in range(40):
        p, n = made(rng, 60), 10 * k
        thirds = lambda: made(rng, 30) + p[:20] + made(rng, 30) + p[40:] + made(rng, 30)
        rows += [(n, thirds()), (n + 1, made(rng, 30) + p + made(rng, 30)), (n + 2, made(rng, 30) + p + made(rng, 30)), (n + 3, thirds())]
        want.add((n + 2, n + 1))
    assert set(linked(spark, rows)) == want


def test_chaining_where_long_pieces_lie_on_both_sides(spark):
    """Pieces longer than a seed's context, in earlier and in later documents, hide no pair of rare seeds."""
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(20):
        p, n = made(rng, 68), 10 * k
        around = lambda words: made(rng, 30) + words + made(rng, 30)
        rows += [(n, around(p[:34])), (n + 1, around(p[34:])), (n + 2, around(p)), (n + 3, around(p)), (n + 4, around(p[:34])), (n + 5, around(p[34:]))]
        want.add((n + 3, n + 2))
    assert set(linked(spark, rows)) == want


def test_chaining_within_a_document(spark):
    rng = random.Random(5)
    p = made(rng, 60)
    line = [f"l{i}" for i in range(12)]
    rows = [(1, made(rng, 20) + p + made(rng, 30) + p + made(rng, 10)), (2, line * 30), (3, made(rng, 400)), (4, p[:40] + made(rng, 9) + p[:40])]
    got = linked(spark, rows)
    assert got[1, 1] == (110, 60) and got[2, 2] == (60, 300) and (3, 3) not in got and (4, 4) not in got


@pytest.mark.parametrize("identity, least", [(1.0, 1.0), (0.95, 0.97), (0.9, 0.9), (0.85, 0.75)])
def test_chaining_finds_edited_passages(spark, identity, least):
    """Passages of 60 words with words changed at random, in documents of their own."""
    rng = random.Random(int(identity * 100))
    rows, want = [], set()
    for k in range(80):
        p = made(rng, 60)
        q = [*p]
        for at in rng.sample(range(60), round(60 * (1 - identity))):
            q[at] = f"e{rng.randint(0, 99999)}"
        rows += [(2 * k, made(rng, 100) + p + made(rng, 100)), (2 * k + 1, made(rng, 50) + q + made(rng, 150))]
        want.add((2 * k + 1, 2 * k))
    got = set(linked(spark, rows))
    assert got <= want and len(got) >= least * len(want)


def test_chaining_joins_over_an_insertion(spark):
    rng = random.Random(9)
    p = made(rng, 90)
    rows = [(1, made(rng, 30) + p + made(rng, 30)), (2, made(rng, 50) + p[:45] + made(rng, 20) + p[45:] + made(rng, 9))]
    assert linked(spark, rows) == {(2, 1): (50, 110)}


def test_chaining_covers_what_brute_force_finds(spark, data):
    """All windows of 50 words that an earlier document or place has, over whole texts: each of their words
    lies in a reported passage, but for those of windows that overlap themselves."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", r["text"].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w] for r in docs.collect() if r["text"]}
    first, missed, seen = {}, 0, 0
    spans = {}
    for r in chaining.fuzzy_passages(docs).collect():
        spans.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            at = first.setdefault(key, (d, i))
            if at[0] != d or i - at[1] >= 50:
                seen += 1
                missed += not set(range(i, i + 50)) <= spans.get(d, set())
    assert seen > 300 and missed <= 0.002 * seen


def test_simhash(spark, docs, none):
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows)
    assert got[1]["fp"] == got[2]["fp"] == 0 and got[2]["component_id"] == 1
    assert got[4]["component_id"] == 3 and got[None]["component_id"] is None
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids)[3] == 1 and 4 not in ids and None in ids and 1 in ids and 2 not in ids
    assert simhash.keep_one_of_each(none).count() == 0


def test_simhash_links_by_brute_force(spark):
    """The blocks, dealt out and walked, link what all pairs link: fingerprints with planted neighbours, and
    many that agree in a whole block."""
    rng = np.random.default_rng(12)
    seeds = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for s in seeds for _ in range(3)]
    alike = (seeds[:1] & ~np.uint64(0xFFFF)) | rng.integers(0, 1 << 16, 150, dtype=np.uint64)
    keys = np.unique(np.concatenate([seeds, np.array(near, np.uint64), alike]))
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3, 1))):
        parent[find(j)] = find(i)
    distinct = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long").repartition(5)
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.linked_fingerprints(distinct)).collect()}
    classes, want = {}, {}
    for n, k in enumerate(keys.view(np.int64).tolist()):
        classes.setdefault(got.get(k, k), set()).add(k)
        want.setdefault(find(n), set()).add(k)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality.classify(docs, train).join(held, "doc_id")
    clean = out.where("quality = 1 and toxic = 0").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    junk = out.where("quality = 0").agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert clean > 0.95 and junk < 0.3


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (8, 0, 1), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == len(ROWS)
    assert quality.classify(docs, labels, broadcast_sites=0).count() == len(ROWS)
    assert quality.classify(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.classify(none, labels).count() == 0
    assert "keep" in quality.classify(docs, labels).columns


def test_shrinkage(spark):
    rows = [("big", "a", 0.9)] * 200 + [("big", "b", 0.2)] * 2 + [("bad", "a", 0.1)] * 200 + [("tiny", "a", 0.0)]
    sites, priors = quality.site_sums(spark.createDataFrame(rows, "h string, l string, p double"), F.col("h"), F.col("l"))
    rates = {("big", "a"): 0.9, ("big", "b"): 0.2, ("bad", "a"): 0.1, ("tiny", "a"): 0.0}
    got = {}
    for r in sites.select("host", "path", "n", "hn", "s", "hs").collect():
        one = spark.createDataFrame([(*r, rates[r["host"], r["path"]])], "host string, path string, n double, hn double, s double, hs double, p double")
        got[r["host"], r["path"]] = one.select(*[c.alias(n) for c, n in zip(priors.shares(F.col("p")), ("host_share", "path_share"))]).first()
    assert abs(got["big", "a"]["path_share"] - 0.9) < 0.05 and abs(got["bad", "a"]["path_share"] - 0.1) < 0.05
    assert 0.2 < got["big", "b"]["path_share"] < 0.9
    # alone on its site a document says nothing of it: what is left is the corpus without it
    mean = (sum(p for _, _, p in rows) + 0.5) / len(rows)
    assert got["tiny", "a"]["host_share"] == pytest.approx(mean) == got["tiny", "a"]["path_share"]


def test_posteriors_by_brute_force(spark, docs):
    """Leave-one-out shares and posteriors in plain Python, from the classifier's own probabilities."""
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.with_probability(docs, model).select("doc_id", "source", "lang", "p").collect()
    _, priors = quality.site_sums(quality.with_probability(docs, model), F.col("source"), F.col("lang"))
    total, want = sum(r["p"] for r in rows), []
    for n, r in enumerate(rows):
        others = [o for m, o in enumerate(rows) if m != n]
        mean = min(max((total - r["p"] + 0.5) / len(rows), 1e-6), 1 - 1e-6)
        host = [o["p"] for o in others if o["source"] == r["source"]]
        path = [o["p"] for o in others if (o["source"], o["lang"]) == (r["source"], r["lang"])]
        h = (priors.on_hosts * mean + sum(host)) / (priors.on_hosts + len(host))
        s = (priors.on_paths * h + sum(path)) / (priors.on_paths + len(path))
        logit = lambda x: np.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
        want.append((str(r["doc_id"]), h, s, 1 / (1 + np.exp(-(logit(s) + logit(r["p"]) - model.base)))))
    got = [(str(r["doc_id"]), r["host_share"], r["path_share"], r["posterior"]) for r in quality.classify(docs, labels).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    by = {r["source"]: r for r in rows}
    assert abs(sum(by[s]["target"] for s in by) - min(1.5, 2) * total) < 1e-6 * total + 1e-6
    for s in by:
        assert sum(r["taken"] for r in rows if r["source"] == s) == int(by[s]["target"] + 1e-9)
        assert by[s]["target"] <= 2 * by[s]["source_size"] + 1e-9
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["taken"], r["start"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    order = mixing.training_order(docs).collect()
    assert sum(r["copy_words"] for r in order) == sum(r["taken"] for r in rows)
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert mixing.mix(none).count() == 0 and mixing.training_order(none).count() == 0


def test_mixing_without_ids(spark, monkeypatch):
    """Rows without an id are spread by their texts; the order holds what the plan takes of each."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(None, " ".join(["w"] * (n % 7)) + f" t{n}", "s") for n in range(60)] + [(None, "same text", "s")] * 3 + [(1, "a b", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs)
    got = plan.collect()
    begins = sorted((r["start"], r["size"]) for r in got if r["source"] == "s")
    assert all(a + n == b for (a, n), (b, _) in zip(begins, begins[1:]))
    order = mixing.training_order(docs).collect()
    assert sum(r["copy_words"] for r in order) == sum(r["taken"] for r in got)
    by_text = Counter()
    for r in order:
        by_text[r["text"]] += r["copy_words"]
    assert all(by_text[t] <= 2 * len(t.split()) * sum(x[1] == t for x in rows) for t in by_text)


def test_demand_is_the_integral_of_any_schedule(spark):
    """A schedule of several pieces, one of them at rest: positions against a sum over small steps of time."""
    knots = ((0, 0), (0.2, 2), (0.5, 0.5), (0.6, 0), (0.8, 0), (1, 1))
    docs = spark.createDataFrame([(n, "w " * (n % 9 + 1), "s") for n in range(200)], "doc_id long, text string, source string")
    got = sorted((c["position"], r["start"], r["source_size"]) for r in mixing.mix(docs, schedules=[knots]).collect() for c in r["copies"][:1])
    t = (np.arange(1_000_000) + 0.5) / 1_000_000
    demand = np.cumsum(np.interp(t, *zip(*knots)))
    demand *= got[0][2] * 1.5 / demand[-1]
    for position, start, _ in got:
        assert position == pytest.approx(t[min(np.searchsorted(demand, start), len(t) - 1)] if start else 0, abs=1e-4)
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    for bad in (((0, 1), (0.5, 1)), ((0, 1), (1, -1)), ((0, 0), (1, 0))):
        with pytest.raises(ValueError):
            mixing.integrated(bad)


def test_mixing_query_is_range_sorted(spark, data):
    got = [r["position"] for r in entry.queries()["op6_source_mixing"](spark, data).collect()]
    some = [p for p in got if p is not None]
    assert some == sorted(some) and got[: len(some)] == some


def test_mixing_equals_its_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    cols = ["doc_id", "position", "size", "source_size", "start", "taken", "target"]
    want = con.sql(f"select {', '.join(cols)} from ({mixing.SQL})").fetchall()
    assert Counter(map(tuple, entry.queries()["op6_source_mixing"](spark, data).select(*cols).collect())) == Counter(want)


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(LONG.split()[50:90])), (2, None), (3, ""), (4, "no id here"), (5, "nothing like it anywhere at all in these texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench).collect())
    assert got == {(3, 1): 1, (4, 1): 2, (7, 1): 1, (None, 4): 1}
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 8]
    assert decontam.contamination(none, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_token_counts(spark, docs, none):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokencount.VOCABULARY, "rb"))}
    whole = tiktoken.Encoding("whole", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = tokencount.encoded_lengths(docs)
    want = [len(whole.encode_ordinary(r[1] or "")) for r in ROWS]
    assert sorted(r["n_tokens"] for r in lengths.collect()) == sorted(want)
    h = tokencount.length_histogram(lengths)
    for r in h.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == want.count(n) and r["tokens_at_least"] == sum(w for w in want if w >= n)
        assert r["truncated_total"] == sum(min(w, n) for w in want) and r["docs_at_most"] == sum(w <= n for w in want)
    cut = {r["context_limit"]: r["total"] for r in tokencount.truncated_totals(h, [0, 10, 512, 10**6]).collect()}
    assert cut == {x: sum(min(w, x) for w in want) for x in (0, 10, 512, 10**6)}
    q = {r["share"]: r["n_tokens"] for r in tokencount.quantiles(h, [0.5, 1.0]).collect()}
    assert q[1.0] == max(want) and q[0.5] == sorted(want)[(len(want) + 1) // 2 - 1]
    assert tokencount.length_histogram(tokencount.encoded_lengths(none)).count() == 0


def test_spotsigs(spark, docs, none, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 2)
    rows = list({r[0]: r for r in ROWS if r[0] is not None}.values())
    out = by_id(spotsigs.edited_likeness(spark.createDataFrame(rows, DOCS)).collect())
    texts = {r[0]: r[1] or "" for r in sorted(rows, key=lambda r: r[0])}
    ids = list(texts)
    for n, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(n + 1) % len(ids)]]
        cut = len(t) // 4
        assert out[i]["n_chars"] == len(t)
        assert out[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
    assert out[3]["fingerprint"] == out[4]["fingerprint"] and out[3]["near_next"] == 1.0
    assert out[0]["near_edited"] > 0.3
    assert spotsigs.edited_likeness(docs).count() == len(ROWS) and spotsigs.edited_likeness(none).count() == 0
    near = by_id(spotsigs.near_duplicates(docs).collect())
    assert near[4]["component_id"] == 3 and near[2]["component_id"] == 1 and near[0]["component_id"] == 0
    assert spotsigs.near_duplicates(none).count() == 0


def plain_signatures(text):
    words = [w for w in re.split(spotsigs.APART, text.lower()) if w]
    content = [n for n, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for n, w in enumerate(words):
        follow = [words[m] for m in content if m > n][: spotsigs.CHAIN]
        if w in spotsigs.ANCHORS and len(follow) == spotsigs.CHAIN:
            out.add((w, *follow))
    return out or {tuple(words)}


def test_spotsigs_by_brute_force(spark, monkeypatch):
    """Fingerprints, likenesses and partitions in plain Python; ids of any size, one far from the others,
    without, or often the same; buckets cut again."""
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 3)
    rng = random.Random(2)
    words = [*spotsigs.ANCHORS[:12], *[f"w{i}" for i in range(9)], "Mat", "é", ""]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 4, 30, 31, 200]))) for _ in range(70)] + ["on the mat big red cat", "the mat big red cat", None]
    ids = [*range(30), *[7_000] * 25, -6 * 10**18, 6 * 10**18, *range(100, 116)]
    rows = list(zip(ids, texts))
    def key(r):
        return spark.createDataFrame([(r[1] or "",)], "t string").select(F.xxhash64("t")).first()[0] if r[0] == 7_000 else 0
    order = sorted(rows, key=lambda r: (r[0], key(r), r[1] or ""))
    def like(a, b):
        a, b = plain_signatures(a), plain_signatures(b)
        j = len(a & b) / len(a | b)
        return j if j >= spotsigs.LEAST_LIKENESS - 1e-12 else 0.0
    want = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, after), 9), len(plain_signatures(t))))
    got = spotsigs.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r[0], r[1], r[2], round(r[5], 9), round(r[6], 9), len(r[3]) // 16) for r in got) == Counter(want)
    prints = {}
    for r in got:
        prints.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert sum(map(len, prints.values())) <= len(rows)
    nameless = spark.createDataFrame([(None, t) for t in texts] + [(1, "x")], "doc_id long, text string")
    assert spotsigs.edited_likeness(nameless).count() == len(texts) + 1


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = {
                "email": True,
                "ip": name == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in odd) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_pii_base(spark, none):
    texts = [
        "a@b.c_d@e.f x@y.z. q@q", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111",
        "call +1 (017) 555-7713 now +49 30 1234567.", "é😀 mail ü@x.de é.a@b-c.de", "", None, "9" * 6000, "1 " * 6000, "a." * 4000 + "@x.y", "+1" * 500,
        "1.2.3." + "9" * 50, "0256.1.1.1 000255.1.1.1 1.1.1.1000 255.255.255.255", "a@b." + "b." * 20000 + "c", "1.2.3.4 " * 700 + "a@b.c ", "+1" + " " * 50000,
        "@.@.@ +( +1 ", "xy a@b.cc ", "1.1.1.1" * 50, "4111111111111111" * 3, "00000000000000",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(docs).collect():
        want = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert set(want.split(",")) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == want.count("email") and r["n_card"] == want.count("card")
    assert pii.detect(none).count() == 0


def test_pii_in_time_linear_in_the_matches(spark):
    many = " a@b.c (415) 555-1234 tel" * 40_000  # a second or two; by growing one array: over a minute
    docs = spark.createDataFrame([(1, many)], "doc_id long, text string")
    pii.fitted(spark)
    begin = time.time()
    got = pii.redact(docs).first()["text"]
    assert got.startswith(" [EMAIL] (415) 555-1234 tel [EMAIL] [PHONE] tel") or got.startswith(" [EMAIL] [PHONE] tel")
    assert got.count("[EMAIL]") == 40_000 and time.time() - begin < 40


def test_pii_spans_by_brute_force(spark):
    """Every proposal of the generators, scored by the trees in numpy, and kept if it meets no base span."""
    texts = [r[1] or "" for r in ROWS] + [
        "please call 415-555-1234 or write to ann (at) example [dot] org today, a@b.cc",
        "tel. (030) 555-7713, version 2021-03-04, card 4111.1111.1111.1111 x 4111 1111 1111 1111 host 10[.]1[.]2[.]3",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fitted(spark)
    rows = docs.select("doc_id", F.explode(pii.proposals(F.col("text"))).alias("c"), "text")
    rows = rows.select("doc_id", "c", pii.span_features(pii.blocks(F.col("text")), F.col("c")).alias("f")).collect()
    want = {i: [(a, n, b) for a, n, b in map(base_tuple, base_spans(t).split(",")) if n] for i, t in enumerate(texts)}
    base = {i: list(v) for i, v in want.items()}
    for r in rows:
        c = r["c"]
        if model.margin(np.array([list(r["f"])]))[0] >= model.cut and all(b <= c["start"] or a >= c["end"] for a, _, b in base[r["doc_id"]]):
            want[r["doc_id"]].append((c["start"], pii.KINDS[c["kind"]], c["end"]))
    kinds = {k: n for n, k in enumerate(pii.KINDS)}
    for r in pii.detect(docs).collect():
        spans = sorted(want[r["doc_id"]], key=lambda s: (s[0], kinds[s[1]], s[2]))
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def base_tuple(span):
    kind, a, b = span.split(":") if span else ("", 0, 0)
    return int(a), kind, int(b)


def test_redaction_writes_each_union_once(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(60):
        text = "".join(rng.choice("abc é😀") for _ in range(rng.choice([5, 50, 2500])))
        spans = sorted((a, rng.randrange(4), min(len(text), a + rng.randint(1, 30))) for a in rng.sample(range(len(text)), rng.randint(0, 5)))
        rows.append((i, text, [dict(start=a, kind=k, end=b, s="") for a, k, b in spans]))
        out, at = "", 0
        for a, k, b in spans:
            if a >= at:
                out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        want.append(out + text[at:])
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,kind:int,end:int,s:string>>")
    got = df.select("id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == want


CLASHES = ["base", "spans", "pii", "near", "_pii", "_near", "_words", "_copy", "copies", "position", "copy_words", "keep", "posterior", "p", "_p",
           "_host", "_own", "_salt", "_key", "_going", "_id", "key", "root", "c0", "c1", "doc_id_2", "TEXT_"]


def test_callers_columns_may_have_any_name(spark, docs):
    """Names of working and of added columns: the caller's values stay, added columns take a free name."""
    wide = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no id here")], "item_id long, text string")
    kept = {
        "redact": pii.redact(wide), "fit": quality.keep_fit(wide, labels), "one": simhash.keep_one_of_each(wide),
        "clean": decontam.decontaminate(wide, bench),
    }
    for name, out in kept.items():
        assert out.columns == wide.columns, name
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASHES), name
    spans = pii.with_spans(wide)
    assert spans.columns == [*wide.columns, "base_", "spans_"]
    for few in (0, quality.BROADCAST_SITES):
        out = quality.classify(wide, labels, broadcast_sites=few)
        assert out.columns[-2:] == ["posterior_", "keep_"] and out.count() == len(ROWS)
    order = mixing.training_order(wide)
    assert order.columns[-2:] == ["copy_words_", "position_"]
    assert all(r[c] == f"mine {c}" for r in order.collect() for c in CLASHES)
    assert Counter(tuple(r) for r in mixing.training_order(docs).drop("text").collect()) == Counter(
        tuple(r) for r in order.select(*[c for c in docs.columns if c != "text"], "copy_words_", "position_").collect()
    )


def test_pii_method_adds_and_redacts(spark, docs):
    rows = [(1, "please call 415-555-1234 or write to ann (at) example [dot] org today"), (2, "version 2021-03-04, isbn 978-3-1614-8410 total 1 234 567")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.detect(df).collect())
    assert "phone:12:24" in got[1]["spans"] and "email:37:" in got[1]["spans"] and got[1]["n_phone"] == 0
    assert got[2]["spans"] == ""
    clean = by_id(pii.redact(df).collect())
    assert clean[1]["text"].startswith("please call [PHONE] or write to [EMAIL]") and clean[2]["text"] == rows[1][1]
    same = pii.redact(docs, length_col="n_chars")
    assert same.columns == docs.columns and same.count() == len(ROWS)
    x, y, ids = pii.example_features(spark, 800)
    half = ids // 8 % 2 == 0
    model = pii.calibrate(pii.boost(x[half], y[half], 20), x[~half], y[~half])
    assert ((model.margin(x[~half]) >= model.cut) == y[~half]).mean() > 0.95


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= seen
        seen, docs = out.count(), out
    last = corpus_pipeline.run(spark, data)
    assert 0 < last.select("doc_id").distinct().count() <= seen


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_near_dedup_stage_takes_five_word_jaccard(spark):
    import random

    random.seed(5)
    rows, n = [], 0
    for size, edits in ((200, 1), (200, 2), (200, 4), (1000, 20), (200, 16), (60, 1), (3, 0)):
        for _ in range(12):
            text = [f"w{random.randint(0, 99999)}" for _ in range(size)]
            copy = [*text]
            for at in random.sample(range(size), edits):
                copy[at] = f"e{random.randint(0, 99999)}"
            rows += [(n, " ".join(text)), (n + 1, " ".join(copy))]
            n += 2
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    want = {i for i in range(n) if i % 2 == 0 or len(sets[i] & sets[i - 1]) < 0.8 * len(sets[i] | sets[i - 1])}
    assert 84 < len(want) < n
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == want


def test_near_dedup_stage_with_unlike_texts_under_one_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (5, two), (6, two), (7, three), (7, f"{two} {three}"), (None, three), (None, "alone")]
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, one), (5, two), (7, three), (7, f"{two} {three}"), (None, "alone")])


def test_near_dedup_links_by_the_trie(spark, monkeypatch):
    """The SimHash self-join gives candidates of its own, not only a second look at the bands'."""
    words = [f"w{n * n % 8191}" for n in range(3000)]
    texts = [" ".join(words), " ".join([*words[:1500], "x", *words[1501:]]), "quite another text of seven words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "_candidate_links", lambda nodes: nodes.select(nodes["key"].alias("u"), nodes["key"].alias("v")).limit(0))
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(rows).collect()) == [0, 2]


def test_classifier_is_fitted_in_a_task(spark, monkeypatch):
    """No training table comes to the driver: what is collected is the model."""
    docs = spark.createDataFrame([(n, ("good words here " if n % 2 else "bad bad junk ") * (n % 7 + 3)) for n in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(type(docs), "toArrow", None)
    model = quality.fit(docs, labels)
    assert model.base == pytest.approx(np.log(31 / 31)) and len(model.quality.buckets)
