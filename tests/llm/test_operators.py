"""The training-data operators against brute force, and on nulls, ties, repeats, long and empty texts."""

import hashlib
import json
import math
import random
import re
import string
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import chat_tools, cotraining, decontaminate, exact_dedup, exchange, jaccard_join, license_scan, mixing, substring_dedup, suffix_tree, url_filter
from sievework.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"


def docs(spark, texts, extra=("k", 1)):
    """texts: [(doc_id, text)]; two columns have names that the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *extra) for d, t in texts], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = say(60)
    out, seed = [], say(120)
    for i in range(90):
        words = say(rng.choice([0, 1, 3, 20, 60, 130]))
        if i % 5 == 0:
            words = words[:10] + passage + words[10:]
        if i % 4 == 0:  # near copies
            words = list(seed)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        out.append((i * 3 % 91, rng.choice([" ", "\n", " \t"]).join(words)))
    out += [(200, None), (201, ""), (202, " \n"), (203, out[0][1]), (None, out[0][1]), (None, out[5][1]), (204, "a b " * 6000), (205, "a b " * 6000 + "c")]
    return out + [out[5], out[5], (90, out[7][1])]


def test_exact_dedup(spark, corpus):
    got = exact_dedup.groups(docs(spark, corpus)).collect()
    by = defaultdict(list)
    for d, t in corpus:
        by[t or ""].append(d)
    assert len(got) == len(corpus) and sum(r.kept for r in got) == len(by)
    want = Counter((d, max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in corpus)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(not r.kept or r.doc_id == r.keep_id for r in got)
    stay = exact_dedup.deduplicate(docs(spark, corpus)).collect()
    assert len(stay) == len(by) and stay[0].kept == "k"
    assert exact_dedup.groups(docs(spark, [])).count() == 0


def test_exact_dedup_weak_identifiers(spark, corpus):
    """Identifiers that clash are found out, and wider ones taken."""
    weak = [lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("string"), lambda c: F.lit("same"), lambda c: c]
    df = docs(spark, corpus)
    key = lambda df: Counter((r.doc_id, r.keep_id, r.group_size) for r in df.collect())
    assert key(exact_dedup.groups(df, weak)) == key(exact_dedup.groups(df))


def test_chunks_join_to_text(spark, corpus):
    df = docs(spark, corpus).select("text", F.array_join(exact_dedup.chunks(F.coalesce("text", F.lit(""))), "").alias("joined"))
    assert df.where("coalesce(text, '') <> joined").count() == 0


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d, t] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    keys = [k for k in sets if k[0] is not None]
    parent = {s: s for s in {sets[k] for k in keys} if s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s in list(parent):
        for u in list(parent):
            if 100 * len(s & u) >= 80 * len(s | u):
                parent[find(s)] = find(u)
    least = defaultdict(lambda: 10**9)
    for k in keys:
        if sets[k]:
            least[find(sets[k])] = min(least[find(sets[k])], k[0])
    return {k: (len(s), k[0] if k[0] is None or not s else least[find(s)]) for k, s in sets.items()}


@pytest.mark.parametrize(("rare", "block"), [(64, 1024), (2, 4)])
def test_jaccard_join(spark, corpus, rare, block):
    got = jaccard_join.components(docs(spark, corpus), rare=rare, block=block).collect()
    want = brute_components(corpus)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, *want[d, t]) for d, t in corpus)


def test_jaccard_prefix_shows_enough():
    """Tokens that both prefixes show when all that a pair does not share comes first."""
    for percent in (50, 80, 90):
        for n in range(1, 120):
            e, need = jaccard_join.prefix(n, percent)
            for other in range(1, 2 * n + 2):
                c = -(-percent * (n + other) // (100 + percent))
                if c <= min(n, other):
                    assert need <= min(c, e - (n - c), jaccard_join.prefix(other, percent)[0] - (other - c))


def test_jaccard_short_documents(spark):
    """8 words, and the same with one more before or after them: 4 of 5 shingles."""
    rows = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "more"] if i % 2 else ["more", *words]))]
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs(spark, rows)).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


def test_jaccard_sets_of_all_sizes(spark):
    """Pairs of sets of 1 to 40 shingles, at the bound and just below it, what differs at either end or inside."""
    rows, at = [], 0
    for n in range(1, 41):
        for extra in sorted({n // 4, n // 4 + 1}):
            for where in range(3):
                words = [f"p{at}x{j}" for j in range(n + 4)]
                more = [f"q{at}x{j}" for j in range(extra)]
                other = more + words if where == 0 else words + more if where == 1 else words[:2] + more + words[2:]
                rows += [(at, " ".join(words)), (at + 1, " ".join(other))]
                at += 2
    got = {r.doc_id: r.component_id for r in jaccard_join.components(docs(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == {d: want[d, t][1] for d, t in rows} and sum(d != c for d, c in got.items()) > 60
    with pytest.raises(ValueError):
        jaccard_join.links(docs(spark, rows), 60)


def test_jaccard_dedup(spark, corpus):
    want = brute_components(corpus)
    stay = jaccard_join.deduplicate(docs(spark, corpus)).collect()
    # A doc_id goes if any of its rows belongs to a smaller one.
    gone = {d for (d, t), (_, c) in want.items() if d is not None and c < d}
    assert Counter(r.doc_id for r in stay) == Counter(d for d, _ in corpus if d not in gone)
    assert jaccard_join.components(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (70, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: v for n, v in got.items() if n != 7} == {**{i: 0 for i in range(41) if i != 7}, 100: 50, 50: 50, 70: 50} and got[7] == 0


@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup(spark, corpus, window):
    got = substring_dedup.report(docs(spark, corpus), window).collect()
    split = [(d, (t or "").encode().split()) for d, t in corpus]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    want = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert substring_dedup.report(docs(spark, [])).count() == 0


@pytest.mark.parametrize("together", [True, False])
def test_windows_with_one_hash_alike_are_told_apart(together):
    """Owners 1 and 2 share the first hash alone, owners 3 and 4 both; in one map task or in one each."""
    h, check, owner = np.array([7, 7, 9, 9], np.uint64), np.array([1, 2, 5, 5], np.uint64), np.array([1, 2, 3, 4])
    tag, place = owner * 10, np.array([0, 1, 2, 3], np.int32)
    parts = [slice(0, 4)] if together else [slice(i, i + 1) for i in range(4)]
    sent = [b for s in parts for b in exchange.pack(h[s], owner[s], 5, "later", tag[s], place[s], check[s])]
    answers = [r for b in exchange.settle(iter(sent), 5, "later") for r in b.to_pylist() if r["kind"] == 1]
    assert [(r["owner"], r["tag"], r["payloads"]) for r in answers] == [(4, 40, place[3:].tobytes())]


def test_buckets_grow_with_bytes(spark):
    few = spark.createDataFrame([("x" * 1000,), (None,)], "text string")
    assert exchange.buckets_of(few, 10_000) == 12 and exchange.buckets_of(few, 10) == 100 and exchange.buckets_of(few.limit(0), 10) == 12
    spread = exchange.settled(spark.createDataFrame([(2, b, b) for b in range(30)], "kind int, bucket int, owner long").selectExpr("kind", "bucket", "owner", "cast(null as long) tag", "cast(null as long) n", "cast(null as string) note", *[f"cast(null as binary) {c}" for c in ("hashes", "owners", "tags", "payloads")]), 30, "shared")
    assert sorted(spread.groupBy(F.spark_partition_id()).count().toPandas()["count"]) == [1] * 30


def test_removed_text(spark, corpus):
    out = substring_dedup.removed_text(docs(spark, corpus))
    sha = {(r.doc_id, r.kept_sha256) for r in substring_dedup.report(docs(spark, corpus)).collect()}
    assert {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect()} == sha


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/a?x", "https://sub.example.com/en/", "http://example.com", "ftp://a.net/es/x#y", "no scheme", None, "http://spam.org/x", "https://m.spam.org:80/x/", "http://a.org//list/it/index.html", "http://nospam.org/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    listed = spark.createDataFrame([("http://www.spam.org",), ("https://a.org/list/it",), (None,), ("bad",)], "url string")
    rules = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))
    for most in (100_000, 0):  # broadcast, and shuffled
        got = {r.page_id: tuple(r)[1:5] for r in url_filter.judge(pages, listed, rules, broadcast_rows=most).collect()}
        assert [got[i][3] for i in range(len(urls))] == ["allow", "block", "allow", "block", "allow", "allow", "block", "block", "block", "allow"]
        assert got[0][:3] == ("www.example.com", "/en/a", "www.example.com/en/") and got[5][:3] == ("", "", None) and got[2][:3] == ("example.com", "", None)
    assert {r.page_id for r in url_filter.filter_pages(pages, listed, rules).collect()} == {0, 2, 4, 5, 9}
    assert url_filter.judge(pages, listed.limit(0), rules).where("on_list").count() == 0
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0


def test_bloom_loses_nothing(spark):
    listed = spark.range(5000).select(F.concat(F.lit("http://h"), "id", F.lit(".org/p")).alias("url"))
    pages = spark.range(0, 10000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/p")).alias("url"))
    got = url_filter.judge(pages, listed, most_blocks=64)
    assert got.where("on_list").agg(F.count("*"), F.max("page_id")).first()[:] == (5000, 4999)


def test_license_scan(spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    texts = ["x CC-BY cc  by\ncc by.", "Licensed under the Apache License, Version 2.0", "licensed under the apache licence", None, "", "All rights reserved", "GENERAL public LICENSE é all rights", "Éa cc Éby", "cc cc by cc", "word " * 5000 + "cc by"]
    df = docs(spark, list(enumerate(texts)))
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.digest(license_scan.scan(df, phrases), sorted(phrases.values())).collect()}
    assert got[0] == (7, 3, 1, 5, "cc-by", "cc-by", 1.0)
    assert got[1][:5] == (8, 0, None, None, "") and got[1][5] == "apache-2.0" and got[1][6] > 0.99
    assert got[2][5] == "" and got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5][4:6] == ("reserved", "proprietary,reserved") and got[6][:5] == (6, 1, 0, 0, "gpl") and got[7][1] == 0
    assert got[8][:4] == (4, 1, 1, 1) and got[9][:4] == (5002, 1, 5000, 5000)
    assert license_scan.scan(df.limit(0), phrases).count() == 0


def brute_scan(texts, templates, share, phrases):
    """Every start of every template in every text, by comparing word after word."""
    split = [[w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w] for t in texts]
    idf = lambda w: math.log((len(split) + 1) / (sum(w in set(ws) for ws in split) + 1)) + 1
    out = []
    for ws in split:
        hits = set()
        for t in templates:
            own, weight = t.words, [idf(w) for w in t.words]
            for start in range(-len(own), len(ws)):
                there = [0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(own)]
                score = sum(x for x, y in zip(weight, there, strict=True) if y) / sum(weight)
                if score >= share and all(there[at + j] for at, p in t.keys for j in range(len(p))):
                    hits.add((t.label, start, round(score, 9)))
        out.append(hits)
    return out


def test_license_index_loses_no_start(spark):
    """Copies of templates with words altered, the rarest first or at random, cut off at either end, and repeated."""
    rng = random.Random(6)
    templates = [t for t in license_scan.TEMPLATES if t.label in ("mit", "apache-2.0", "isc", "cc-by-nc-4.0")]
    texts = [None, "", "the software the license"]
    for i in range(60):
        words = list(rng.choice(templates).words)
        for _ in range(rng.randrange(len(words) // 4 + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        if i % 3 == 0:
            words = words[rng.randrange(len(words) // 5 + 1) :]
        texts.append(" ".join(["the", "of"] * rng.randrange(4) + words * rng.choice([1, 1, 2])))
    got = {r.doc_id: {(h.label, h.start, round(h.score, 9)) for h in r.hits} for r in license_scan.scan(docs(spark, list(enumerate(texts))), {"cc by": "cc-by"}, templates).collect()}
    want = brute_scan(texts, templates, license_scan.SHARE, {})
    assert got == dict(enumerate(want)) and sum(map(bool, want)) > 20


def test_license_rarest_words_altered(spark):
    """Three rare words of 170 replaced: most of the weight is there."""
    words = license_scan.Template("mit", license_scan.MIT, ()).words
    for w in ("sublicense", "noninfringement", "merchantability"):
        words[words.index(w)] = "other"
    got = license_scan.scan(docs(spark, [(1, " ".join(words)), (2, "nothing")]), {"cc by": "cc-by"}).where("doc_id = 1").first()
    assert "mit" in {h.label for h in got.hits}


def test_suffix_tree_words(spark, corpus):
    got = suffix_tree.score(docs(spark, corpus), least=4).collect()
    tokens = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in corpus]
    count = Counter(w for d, ws in tokens if not suffix_tree.held_out(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((d, suffix_tree.held_out(d), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for d, w in tokens)
    assert Counter((*tuple(r)[:5], round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    parts = suffix_tree.score(docs(spark, corpus), least=4, entries=40).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in parts) == Counter((r.doc_id, round(r.score, 5)) for r in got)
    assert suffix_tree.score(docs(spark, [])).count() == 0


def test_suffix_tree_is_a_distribution(spark, corpus):
    """Probabilities of all symbols after a context add up to 1, and training texts score better than noise."""
    import numpy as np

    _, nodes, root = suffix_tree.train(docs(spark, corpus).select("doc_id", "text"), 4)
    rows = nodes.toArrow()
    model = suffix_tree.Model(root, *(rows.column(c).to_numpy() for c in ("state", "parent", "symbol", "value")))
    assert len(model.state) > 10
    for text in (b"ab cde", b"\n\n\n\n\n\n", b"zzzzzzz", b"a b a"):
        depth = suffix_tree.DEPTH
        context = int.from_bytes(text[-depth:][::-1].ljust(depth, b"\n"), "big")  # the nearest first
        p = 10 ** model.score(np.array([context << 8 | s for s in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9


def test_held_out(spark):
    assert [suffix_tree.held_out(i) for i in range(50)] == [crc32(str(i).encode()) % 5 == 1 for i in range(50)]


def test_cotraining(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(60))
    texts = [(i, good() if i % 4 else bad()) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(0, 400, 3)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, [*texts, (500, None), (501, "")])
    got = {r.doc_id: r for r in cotraining.scores(df, labels).collect()}
    assert len(got) == 402 and sum(got[i].kept == bool(i % 4) for i in range(400)) >= 396
    kept = cotraining.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    model = cotraining.fit(df, labels)
    assert model["auc"] > 0.99 and model["tested"] > 10
    twice = cotraining.keep_good(df.unionByName(df), labels)
    assert twice.count() == 2 * kept.count()
    assert cotraining.scores(df, labels.limit(0)).where("kept").count() == 402
    assert cotraining.scores(df.limit(0), labels).count() == 0


def brute_rake(cells, aims, cycles):
    total = sum(cells.values())
    r = {k: w / total for k, w in cells.items()}
    for _ in range(cycles):
        for m in range(3):
            have = Counter()
            for k, x in r.items():
                have[k[m]] += x
            r = {k: x * aims[m][k[m]] / have[k[m]] if have[k[m]] else 0.0 for k, x in r.items()}
    return r


@pytest.mark.parametrize("few", [50_000, 0])
def test_rake(spark, few):
    cells = {(s, g, t): float(10 + 7 * i) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in ("en", "de") for t in ("x", "y"))}
    df = spark.createDataFrame([(*k, w) for k, w in cells.items()], "source string, lang string, topic string, w double")
    targets = {"source": None, "lang": {"en": 0.75, "de": 0.25, "none": 0.3}, "topic": {"x": 0.4, "": 0.6}}
    got = {(r.source, r.lang, r.topic): r.r for r in mixing.rake(df, targets, 5, few).collect()}
    want = brute_rake(cells, [{"a": 0.5, "b": 0.5}, {"en": 0.75, "de": 0.25}, {"x": 0.4, "y": 0.6}], 5)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(got) == len(want)


def test_rake_of_few_cells_is_one_fit(spark):
    """However many cycles a small table takes, the number of jobs stays the same; unreachable margins, nulls and empty cells as over a DataFrame."""
    cells = [("a", "en", "x", 5.0), ("a", "de", "y", 1.0), (None, "en", "x", 2.0), ("b", "de", "x", 0.0), ("b", None, "y", 3.0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, w double")
    targets = {"source": None, "lang": {"en": 0.3, "de": 0.2, "": 0.5}, "topic": {"x": 0.4, "y": 0.6}}

    def jobs(cycles):
        spark.sparkContext.setJobGroup(f"rake{cycles}", "")
        mixing.rake(df, targets, cycles, tolerance=-1.0).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rake{cycles}"))

    assert jobs(5) == jobs(50)
    key = lambda r: tuple(map(str, (r.source, r.lang, r.topic)))
    few, many = (sorted(mixing.rake(df, targets, 1, few).collect(), key=key) for few in (100, 0))
    assert [key(r) for r in few] == [key(r) for r in many] and np.allclose([r.r for r in few], [r.r for r in many], atol=1e-12)
    assert mixing.rake(df.limit(0), targets).count() == 0


def test_rake_until_it_fits(spark):
    """Margins that do not contradict each other are all met, and null is a value apart from the empty text."""
    cells = [(s, g, t, float(5 + i * i)) for i, (s, g, t) in enumerate((s, g, t) for s in ("a", "", None) for g in ("en", "de") for t in ("x", "y"))]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, w double")
    got = mixing.rake(df, {"source": None, "lang": {"en": 0.9, "de": 0.1}, "topic": {"x": 0.2, "y": 0.8}}).collect()
    by = lambda m: {v: sum(r.r for r in got if r[m] == v) for v in {r[m] for r in got}}
    assert all(abs(x - 1 / 3) < 1e-8 for x in by("source").values()) and set(by("source")) == {"a", "", None}
    assert abs(by("lang")["en"] - 0.9) < 1e-8 and abs(by("topic")["x"] - 0.2) < 1e-8


def test_mixing_decisions(spark):
    """Copies against the rule by hand: floor of the rate, and one more if the row's hash falls below the fraction."""
    rows = [(i, f"w{i} " * (50 + i % 9), "en" if i % 3 else "de", f"s{i % 4}", 1, "k", 1) for i in range(300)] + [(0, None, None, None, None, None, None)]
    for r in mixing.decisions(spark.createDataFrame([*rows, rows[5]], DOCS), {"lang": {"en": 0.2, "de": 0.8}}, budget=1.5).collect():
        text = next((x[1] or "" for x in rows if x[0] == r.doc_id and (r.n_tokens > 0) == bool(x[1])), "")
        u = int(hashlib.md5(f"7:{r.doc_id}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) / 16**12
        assert r.copies == math.floor(r.rate) + (u < r.rate - math.floor(r.rate))


def test_columns_with_dots(spark, corpus):
    """Columns named with dots and back quotes, and of map type, pass through."""
    df = docs(spark, corpus).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2)).withColumn("m", F.create_map(F.lit("k"), F.lit("v")))
    for out in (exact_dedup.deduplicate(df), mixing.sample(df, {}, budget=1.0).drop("copies"), jaccard_join.deduplicate(df)):
        assert out.columns == df.columns and out.count() > 0
    pages = spark.createDataFrame([(1, "http://a.b/c", 3)], "page_id long, url string, `x.y` int")
    assert url_filter.filter_pages(pages, spark.createDataFrame([], "url string")).columns == pages.columns


def test_mixing(spark):
    rows = [(i, "w " * (100 + i % 7), "en" if i % 3 else "de", f"s{i % 4}", 1, "k", 1) for i in range(2000)] + [(3000, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.decisions(df, {"source": None, "lang": {"en": 0.5, "de": 0.5}, "topic": {"": 1.0}}, budget=0.5)
    tokens = {r.lang: r.t for r in got.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert got.count() == 2001 and abs(tokens["en"] / (tokens["en"] + tokens["de"]) - 0.5) < 0.04
    taken = mixing.sample(df, {"lang": {"en": 0.5, "de": 0.5}}, budget=0.5)
    assert taken.columns == [*df.columns, "copies"] and taken.where("kept is null").count() == 0
    assert mixing.decisions(df.limit(0), {}).count() == 0


def test_decontaminate(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 6)))
    common = [word() for _ in range(30)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [say(rng.choice([12, 20, 35, 60, 100])) for _ in range(25)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "...")], "item_id long, text string")
    texts, want = [], set()
    for d in range(150):
        words = say(rng.choice([0, 5, 40, 200, 900]))
        if d % 6 == 0:
            i = rng.randrange(25)
            part = list(items[i])
            if d % 12 == 0:  # a paraphrase: an eighth of its words differ
                for j in range(0, len(part), 8):
                    part[j] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
            want.add((d, i))
        texts.append((d, ", ".join(words)))
    df = docs(spark, [*texts, (300, None)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, benchmark).collect()}
    assert got == want
    left = decontaminate.clean(df, benchmark)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in texts} - {d for d, _ in want} | {300}
    assert decontaminate.matches(df.limit(0), benchmark).count() == 0 and decontaminate.matches(df, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10**3, 10**6, 10**9])
def test_decontaminate_finds_copies_at_any_size(n):
    """Copies of items of any length, exact or with an eighth of other words, among words that are the rarest of n documents."""
    rng = random.Random(n)
    items = [[f"i{i}x{j}".encode() for j in range(size)] for i, size in enumerate([1, 2, 5, 6, 7, 15, 16, 17, 20, 32, 33, 37, 63, 64] * 2)]
    vocabulary = {w: k for k, w in enumerate(sorted({w for x in items for w in x}))}
    block = decontaminate.Block(list(range(len(items))), items, [x[-max(1, len(x) // 4) :] for x in items], vocabulary)
    idf = np.full(len(vocabulary), math.log(50) + 1)  # in just under 2 % of the documents
    finder = decontaminate.Finder(block, idf, math.log(n + 1) + 1, np.eye(len(vocabulary)), decontaminate.NEAR)
    for i, item in enumerate(items):
        for every in (0, 8):
            words = [b"other" if every and len(item) >= 8 and j % every == 1 else w for j, w in enumerate(item)]
            for before, after in ((0, 0), (rng.randrange(200), rng.randrange(200)), (77, 0), (0, 78)):
                text = b" ".join([*(b"a%d" % k for k in range(before)), *words, *(b"z%d" % k for k in range(after))])
                assert [r[0] for r in finder.search(text)] == [i]


def test_decontaminate_space_of_all_documents(spark, monkeypatch):
    """The latent space is that of every passage of every document, not of a sample."""
    rng = random.Random(8)
    words = [f"w{i:02d}".encode() for i in range(40)]
    vocabulary = {w: i for i, w in enumerate(words[:30])}
    texts = [b" ".join(rng.choices(words, range(40, 0, -1), k=rng.choice((0, 1, 31, 32, 33, 150)))) for _ in range(90)] + [None]
    df = spark.createDataFrame([(i % 80, t and t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    weights = np.array([0.0 if i % 7 == 3 else 1 + i / 10 for i in range(30)])
    items = [decontaminate.vector(words[3:20], vocabulary, weights), decontaminate.vector(words[12:29] + words[12:15], vocabulary, weights)]
    gram = sum(decontaminate.ITEM_WEIGHT**2 * np.outer(v, v) for v in (np.bincount(at, v, 30) for at, v in items))
    for t in texts:
        found = decontaminate.words_in(t)
        for a in range(0, len(found), 32):
            v = np.zeros(30)
            for w in found[a : a + 32]:
                v[vocabulary.get(w, 0)] += weights[vocabulary[w]] if w in vocabulary else 0
            gram += 0.25 * np.outer(v, v)
    monkeypatch.setattr(decontaminate, "BLOCK_CELLS", 30 * 4)
    counts = decontaminate.pair_counts(df, vocabulary, weights)
    assert counts.count() > 5
    space = decontaminate.latent_space(counts, 0.25, weights, items, rank=2, rounds=30)
    want = np.linalg.eigh(gram)[1][:, -2:]
    assert np.allclose(space @ space.T, want @ want.T, atol=1e-6)

    monkeypatch.setattr(decontaminate, "sampled_passages", None)
    assert len(list(decontaminate.finders(df, spark.createDataFrame([(1, "w01 w02 w39 w38 w37 w36 w35")], "item_id long, text string")))) == 1


def test_decontaminate_sample_of_repeated_documents(spark):
    """Rows that share a doc_id count once among the sampled documents."""
    vocabulary = {b"w%d" % i: i for i in range(20)}
    df = docs(spark, [(i, f"w{i}") for i in range(20) for _ in range(5)])
    rows = decontaminate.sampled_passages(df, vocabulary, np.ones(20), 4).collect()
    assert len({bytes(r["at"]) for r in rows}) == 4


def test_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randint(1, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.Subsequence(a).length(b) == table[-1][-1]


def test_chat_tools(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("c2", "fetch", {"url": {"$ref": "c1"}}), ("c1", "search", {"query": "x", "limit": 5}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "r"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "r"})),
        (1, 4, "assistant", call(("c1", "search", {"query": ""}), ("c4", "other", "{}"), ("c5", "search", {"query": {"$ref": "c6"}}), ("c6", "search", {"query": {"$ref": "c5"}}))),
        (2, 0, None, None), (2, 1, "assistant", "{not json"), (2, 2, "tool", '{"tool_call_id": "c1", "content": 1}'), (None, 0, "assistant", call(("c1", "search", {"query": "x"}))),
    ]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = {(r.conv_id, r.turn, r.part, r.position): r for r in chat_tools.formatted(df).collect()}
    assert len(got) == 16
    assert [(got[1, 1, 1, i].level, got[1, 1, 1, i].status, got[1, 1, 1, i].valid) for i in (0, 1)] == [(1, "unlinked", True), (0, "linked", True)]
    assert got[1, 2, 2, 0].status == "linked" and got[1, 3, 2, 0].status == "unlinked" and got[2, 2, 2, 0].status == "unlinked"
    assert got[1, 4, 1, 0].status == "duplicate" and got[1, 4, 1, 0].valid is False and got[1, 4, 1, 1].valid is None
    assert {got[1, 4, 1, i].status for i in (2, 3)} == {"cyclic"} and got[None, 0, 1, 0].status == "unlinked"
    assert got[1, 1, 1, 1].json == '{"arguments":{"limit":5,"query":"x"},"id":"c1","name":"search"}'
    assert got[2, 1, 0, 0].json == '{"content":"{not json","role":"assistant"}'
    assert chat_tools.formatted(df.limit(0)).count() == 0


def test_chat_tools_long_chain(spark):
    call = lambda i, *refs: json.dumps({"tool_calls": [{"id": f"c{i}", "name": "other", "arguments": [{"$ref": f"c{r}"} for r in refs]}]})
    n = 2100
    rows = [(1, i, "assistant", call(i, *([i - 1, i // 2] if i else []))) for i in range(n)] + [(2, 0, "assistant", call(0, 0)), (2, 1, "assistant", call(1, 0))]
    got = chat_tools.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert {(r.turn, r.level, r.status) for r in got if r.conv_id == 1} == {(i, i, "unlinked") for i in range(n)}
    assert [(r.level, r.status) for r in got if r.conv_id == 2] == [(None, "cyclic")] * 2


def test_chat_tools_levels(spark):
    """Random references, forward and in circles too, against levels taken one by one; in stretches of any length."""
    rng = random.Random(8)
    calls = {f"c{i}": (rng.choice([None, *[i // 3] * 9]), sorted({f"c{rng.randrange(max(0, i - 5), i + (0 if rng.random() < 0.9 else 3))}" for _ in range(rng.randint(0, 2))})) if i else (0, []) for i in range(60)}
    want, more = {}, True
    while more:
        new = {c: max([want[r] for r in refs], default=-1) + 1 for c, (t, refs) in calls.items() if c not in want and all(r in want and t is not None and calls[r][0] is not None and calls[r][0] <= t for r in refs)}
        more = bool(new)
        want |= new
    df = spark.createDataFrame([(7, c, t, refs) for c, (t, refs) in calls.items()], "conv_id long, call_id string, turn long, refs array<string>")
    for turns in (3, 1024):
        assert {r.call_id: r.level for r in chat_tools.levelled(df, turns).collect()} == want


def test_chat_tools_bad_json(spark):
    """Surrogates, numbers that JSON does not have, deep nesting, null turns, identifiers that are no strings."""
    deep = "[" * 3000 + "]" * 3000
    call = '{"tool_calls": [{"id": %s, "name": "search", "arguments": %s}]}'
    rows = [
        (1, 0, "assistant", call % ('"\\ud800x"', '{"query": "\\udc00"}')), (1, 1, "tool", '{"tool_call_id": "\\ud800x", "content": 1}'),
        (1, 2, "assistant", call % ('"n"', '{"query": NaN}')), (1, 3, "assistant", call % ('"d"', deep)), (1, 4, "assistant", call % ('"s"', json.dumps(deep))),
        (1, 5, "assistant", call % ('"i"', '{"query": 1e999}')), (1, None, "assistant", call % ('"t"', "{}")), (1, 6, "assistant", call % ("7", '{"query": "q", "limit": {"$ref": "n"}}')), (1, 7, "tool", '{"tool_call_id": 7}'),
    ]
    got = chat_tools.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = {(r.turn, r.kind): r for r in got}
    assert calls[0, "call"].call_id == "\ufffdx" and calls[0, "call"].status == "linked" and calls[1, "result"].status == "linked"
    assert all(calls[t, "message"].json == chat_tools.canonical({"role": "assistant", "content": rows[t][3]}) and (t, "call") not in calls for t in (2, 3, 5))
    assert json.loads(calls[4, "call"].json)["arguments"] == deep and calls[4, "call"].valid is False
    assert calls[None, "call"].status == "unlinked" and calls[6, "call"].status == "cyclic" and calls[6, "call"].call_id == "7" and calls[7, "result"].status == "linked"
    assert all(json.loads(r.json) is not None and "NaN" not in r.json for r in got if r.kind != "message")


def test_schema_errors():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 0}}, "b": {"enum": [1, 2]}}, "required": ["a"], "additionalProperties": False}
    assert chat_tools.errors({"a": [1, 2], "b": 1}, schema) == []
    assert len(chat_tools.errors({"a": [1, -2, "x", True], "b": 3, "c": 0}, schema)) == 5
    assert chat_tools.errors([], schema) and chat_tools.errors({}, schema)
