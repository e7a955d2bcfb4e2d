import gc
import hashlib
import io
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgrid.llm import bpe_stream, components, kn_langid, license_join, media_sniff, merkle, mix, ordinal, queries, simhash, token_records, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, _key double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def fixture_rows():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long = "\n".join(say(9) + "." for _ in range(400))
    rows = [(i, say(rng.randint(1, 60)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, " \n\t ", "de", None), (33, long, "de", "s1"), (34, long, None, "s1"), (35, long + " end", "en", "s2")]
    rows += [(36, "!!! 123", "en", None), (5, rows[5][1], "en", "s2"), (None, "no id at all", None, "s1"), (None, None, None, None), (37, "Released under the MIT License.\nlicensed under the apache license version 2.0", "en", "s1")]
    return [(*r, 0, "x", 0.5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- op1

def test_frames_survive_the_mark_and_show_damage():
    for ids in ([], [1, 2, 70000], list(np.frombuffer(token_records._MARK + b"\0", "<u2")) * 3):
        data = token_records.frame(7, np.array(ids, "<u4"))
        assert token_records._MARK not in data
        assert token_records.unframe(data)[0] == 7 and token_records.unframe(data)[1].tolist() == list(ids)
        for at in (3, 10, len(data) - 6):
            with pytest.raises(ValueError):
                token_records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_words_encode_as_the_library_does():
    e = token_records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng, parts = random.Random(5), ["a", "É", "ß", "'s", "'S", " ", "\n", "\x85", "²", "İ", "ſ", "K", "́", "日本", "12", "<|", "<|endoftext|>", "!", "--", "Σ", "ﬁ", "😀", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 40]))) for _ in range(400)]
    want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want


def test_token_records(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_records.record_table(docs, path, rows_each=8).orderBy(F.col("doc_id").asc_nulls_last(), "start").collect()
    library = token_records.encoder(path).library
    rows = sorted(fixture_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got) == sorted((r[0] or -1, zlib.crc32(ids(r[1]).tobytes())) for r in rows)
    assert token_records.record_table(empty, path).count() == 0


def test_offsets_find_the_frames(spark, docs):
    from quillgrid.llm.common import fresh_path

    out = fresh_path(spark, "t")
    token_records.write_records(docs, out, public_tokenizers.path("word_bpe_49k.json"), rows_each=8)
    files = {"/".join(r["path"].rsplit("/", 2)[1:]): bytes(r["content"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).collect()}
    for r in token_records.read_index(spark, out).collect():
        doc_id, ids = token_records.unframe(files[r["file"]][r["offset"] : r["offset"] + r["length"]])
        assert (doc_id, len(ids)) == (r["doc_id"], r["n_tokens"])


def test_frames_are_read_by_offset_in_shuffled_order(spark, docs):
    from quillgrid.llm.common import fresh_path

    out = fresh_path(spark, "t")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_records.write_records(docs, out, path, rows_each=8)
    index = token_records.write_index(spark, out, fresh_path(spark, "index"))
    library = token_records.encoder(path).library
    got = {(r["file"], r["offset"]): r for r in token_records.read_frames(spark, out, index).collect()}
    orders = [token_records.shuffled(index, epoch).collect() for epoch in (0, 1, 0)]
    assert orders[0] == orders[2] != orders[1] and len(got) == len(fixture_rows())
    want = sorted((str(r[0]), [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in fixture_rows())
    assert sorted((str(got[r["file"], r["offset"]]["doc_id"]), got[r["file"], r["offset"]]["ids"]) for r in orders[1]) == want


def test_equal_and_missing_doc_ids_have_one_order(spark):
    rows = [(7, f"word {i % 5} of many") for i in range(40)] + [(None, f"loose {i}") for i in range(60)] + [(9, "last")]
    path = public_tokenizers.path("word_bpe_49k.json")
    key = lambda r: (r["doc_id"] or -1, r["start"], r["ids_crc32"])
    got = [sorted(map(key, token_records.record_table(spark.createDataFrame(rows[::d], "doc_id long, text string").repartition(3), path, rows_each=8).where("doc_id is not null").collect())) for d in (1, -1)]
    assert got[0] == got[1]
    shards = token_records.record_table(spark.createDataFrame(rows, "doc_id long, text string"), path, rows_each=8).where("doc_id is null").groupBy("shard").count().collect()
    assert len(shards) > 3


# --- op2

def test_merkle_fingerprints(docs, empty):
    got = merkle.fingerprint_documents(docs, rows_each=5).collect()
    rows = sorted(((r[0], r[1] or "") for r in fixture_rows() if r[0] is not None), key=lambda r: r[0])
    assert len(got) == len(fixture_rows())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        if i != 4 and i != 5:  # 5 stands twice
            assert [(r["n_chars"], r["edited_sha256"]) for r in by[i]] == [(len(text), digest)]
            assert (by[i][0]["fingerprint"] == by[i][0]["edited_fingerprint"]) == (text == edited)
            assert by[i][0]["near_next"] == 1 if text == after else by[i][0]["near_next"] < 1
    assert by[33][0]["fingerprint"] == by[34][0]["fingerprint"] != by[35][0]["fingerprint"]
    assert by[33][0]["near_edited"] > 0.4 and by[34][0]["near_next"] > 0.9
    assert merkle.fingerprint_documents(empty).count() == 0


def brute_tree(text):
    cut = lambda t, ends: [x for x in re.split(f"(?<={ends})(?!\n)", t)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sections = []
    for s in cut(text, "\n\n"):
        paragraphs = [(re.findall(merkle.PIECE, p)) for p in cut(s, "\n")]
        hashes = [sha("".join(map(sha, ps))) for ps in paragraphs]
        sections.append((sha("".join(hashes)), hashes, paragraphs))
    return sha("".join(h for h, _, _ in sections)), sections


def test_trees_equal_brute_force(spark):
    from collections import Counter

    rng = random.Random(6)
    say = lambda: "\n\n".join("\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) + rng.choice([".", "!!", "", "?" * 200]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))
    pairs = []
    for _ in range(25):
        a = say()
        parts = a.split("\n\n")
        parts.insert(rng.randint(0, len(parts)), say())
        pairs.append((a, rng.choice(["\n\n".join(parts), a.replace("alpha", "omega"), a * 50, say(), a])))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.tree(F.col("a")).alias("x"), merkle.tree(F.col("b")).alias("y"))
    df = df.select("a", "b", "x", "y", merkle.likeness(F.col("x.root"), merkle.leaves(F.col("x")), F.col("y.root"), merkle.leaves(F.col("y"))).alias("near"), merkle.changed(F.col("x"), F.col("y")).alias("at"))
    for r in df.collect():
        (root_a, a), (root_b, b) = brute_tree(r["a"]), brute_tree(r["b"])
        assert (r["x"]["root"], r["y"]["root"]) == (root_a, root_b) and "".join("".join(p) for _, _, ps in a for p in ps) == r["a"]
        ca, cb = (Counter(x for _, _, ps in t for p in ps for x in p) for t in (a, b))
        near = 2 * sum(len(x) * n for x, n in (ca & cb).items()) / max(len(r["a"]) + len(r["b"]), 1)
        assert r["near"] == pytest.approx(1 if root_a == root_b else min(near, 0.999999))
        known = {h for _, hs, _ in a for h in hs}
        whole = {h for h, _, _ in a}
        assert [tuple(x) for x in r["at"]] == [(i, j) for i, (h, hs, _) in enumerate(b) if h not in whole for j, p in enumerate(hs) if p not in known]


# --- op3

def brute_simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_near_duplicates(docs, empty):
    rows = fixture_rows()
    fps = [brute_simhash(r[1]) for r in rows]
    group = classes(fps, 2)
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), f"{f:016x}", str(least[g])) for r, f, g in zip(rows, fps, group, strict=True))
    assert sorted(tuple(map(str, r)) for r in simhash.near_duplicates(docs, shard_rows=3).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_in_hot_shards_equal_brute_force(spark):
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps |= {seed ^ sum(1 << rng.randrange(64) for _ in range(k)) & ((1 << 64) - 1) for k in (0, 1, 1, 2, 2, 3, 4) for _ in range(6)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, node long")
    got = dict(components.connected_components(simhash.links(nodes, shard_rows=4)).collect())
    assert [got.get(i, i) for i in range(len(fps))] == classes(fps, 2)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_similar_documents_finds_near_copies(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for c in range(4):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(200)] = f"x{rng.randrange(999)}"
            rows.append((g * 10 + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.similar_documents(df).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
    assert simhash.one_of_each(df.union(df)).count() == 12


def jaccard_classes(texts, similarity=0.8):
    def shingles(t):
        ws = t.lower().split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["", "one", "one two"]
    for n in [*range(5, 16), 20, 40, 50, 90, 300]:
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(words))
            for more in range(1, max(2, n // 4)) if n < 100 else (60, 70, 74, 75, 90):  # words at the end: similarity from 1 down past 0.8
                texts.append(" ".join([*words, *(f"e{rng.randrange(10**6)}" for _ in range(more))]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    want = jaccard_classes(texts)
    assert 50 < len(set(want)) < len(texts)
    got = {r["doc_id"]: r["component"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_wide_bitmaps_never_part_what_is_alike():
    from quillgrid.llm import shingle_join

    rng = np.random.default_rng(1)
    for n in (257, 300, 511, 513, 2000, 9000, 200_000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * 2)
        for share in (0.02, 0.1, 0.3, 0.9):
            b = np.unique(np.concatenate([a[rng.random(len(a)) > share], rng.integers(0, 1 << 63, int(n * share), np.uint64) * 2 + 1]))
            if 2 * len(b) <= shingle_join.BITMAP:
                continue
            seen = shingle_join.apart(shingle_join.wide_bitmap(a), shingle_join.wide_bitmap(b))
            assert seen <= len(np.setxor1d(a, b)) and (n > 60_000 or share < 0.3 or seen > shingle_join.room(len(a), len(b), 0.8))


def test_a_star_of_copies_is_one_class(spark):
    rng = random.Random(12)
    centre = [f"c{i}" for i in range(204)]
    texts = []
    for _ in range(60):  # 20 of 200 shingles changed: 0.818 to the centre, 0.7 or less to most others
        at = sorted(rng.sample(range(4, 200, 8), 4))
        texts.append(" ".join(f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(centre)))
    texts.insert(47, " ".join(centre))
    want = jaccard_classes(texts)
    assert set(want) == {0} and len(set(jaccard_classes(texts[:47] + texts[48:]))) > 20
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["component"] for r in got} == {0}


# --- op4

def test_url_rules_and_aliases(spark):
    link = lambda t: f'<link href="{t}" rel=canonical>'
    pages = [
        (1, "http://A.com/en/1#x", None), (2, "https://b.org/fr/2", link("http://a.com/en/1")), (3, "http://c.net/de/3", link("//b.org/fr/2")), (4, "nothing", "x"), (5, None, None),
        (6, "http://example.com/en/77?q", "<meta http-equiv='refresh' content='0; url=/x'>"), (7, "http://com/en/", ""), (8, "http://xcom/en/", ""), (9, "http://d.org/y/a", link("b")), (10, "http://d.org/y/b", link("https://example.net/de/8x")), (1, "http://A.com/en/1#x", None),
    ]
    got = url_rules.judge(spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, rule string")).collect()
    verdict = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(pages)
    assert verdict[1] == ("a.com", "com/en/", "block") and verdict[2] == ("b.org", None, "block") and verdict[3] == ("c.net", "net/de/", "allow")
    assert verdict[4] == ("", None, "allow") and verdict[5] == ("", None, "allow") and verdict[6] == ("example.com", "example.com/en/7", "allow")
    assert verdict[7][2] == "block" and verdict[8] == ("xcom", None, "allow") and verdict[9][2] == verdict[10][2] == "block"
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_targets_resolve_as_urljoin_does():
    from urllib.parse import urljoin

    page = "https://Site.org/a/b/c?d=1#e"
    for href in ("/login?next=http://blocked.org/es/1", "#top", "?p=2", "../z", "./y", "//other.net/x", "http://u.de/de/1", "q;r", "", "a&amp;b=1"):
        html = f"<html><head><!-- <link rel=canonical href='http://no.com/'> --><LINK REL='alternate canonical' href='{href}'>"
        want = [urljoin(page, href.replace("&amp;", "&"))] if href else []
        assert url_rules.targets(page, html) == want
        based = url_rules.targets(page, f"<base href='//base.com/x/'><meta http-equiv=Refresh content=\"3; URL='{href}'\">")
        assert based == ([urljoin("https://base.com/x/", href.replace("&amp;", "&"))] if href else [])
    for html in ("<link rel=canonical href='mailto:x@y'>", "<link rel=canonical href='http://[bad'>", "<meta http-equiv=refresh content='5'>", "<link rel=stylesheet href='/x'>", "<link rel='canonical'"):
        assert url_rules.targets(page, html) == []


def test_blocks_reach_aliases_over_hubs_and_chains(spark):
    rng = random.Random(13)
    url = lambda i: f"http://h{i}.{('fr', 'com')[i % 29 == 0]}/{('xx', 'en')[i % 29 == 0]}/{i}"
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    pages = spark.createDataFrame([(i, url(i), None) for i in range(300)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(url(a), url(b)) for a, b in edges], "url string, target string")
    up = list(range(300))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    bad = {top(i) for i in range(0, 300, 29)}
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, redirects=redirects).collect()}
    assert got == {i: "block" if i % 29 == 0 or top(i) in bad else "allow" for i in range(300)}


# --- op5

def test_ordinal_learns_an_order(spark, docs, empty):
    rng = random.Random(1)
    make = lambda g: " ".join(rng.choice({0: ["zz!!", "QQ!!"], 1: ["fool", *WORDS], 2: WORDS}[g]) for _ in range(40))
    rows = [(i, make(i % 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i, _ in rows if i < 180] + [(None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ordinal.graded(df, labels).collect()}
    assert np.mean([round(got[i]["expected_grade"]) == i % 3 for i in range(180, 240)]) > 0.9
    assert all(got[i]["p_fair"] >= got[i]["p_good"] for i in got)
    assert ordinal.graded(docs, labels).count() == len(fixture_rows())
    assert ordinal.graded(empty, labels).count() == 0
    none = labels.where("false")
    assert {(r["expected_grade"], r["keep"]) for r in ordinal.graded(docs, none).collect()} == {(None, True)}
    assert ordinal.kept(docs, ordinal.train(docs, none)).count() == len(fixture_rows())


def test_ordinal_scores_equal_dense_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS + ["zz!!"] * (i % 3) * 4) for _ in range(30))) for i in range(60)]
    labels = [(i, int(i % 3 < 2), int(i % 3 == 1)) for i in range(60)]
    df, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = ordinal.train(df, rated)
    got = {r["doc_id"]: r for r in ordinal.score(df, m).collect()}
    for i, t in rows:
        dense = np.zeros(ordinal.DIM)
        for at, x in zip(*ordinal.features(t), strict=True):
            dense[at] += x
        tails = [1 / (1 + np.exp(-(dense @ m.weights - c))) for c in m.thresholds]
        assert (got[i]["p_fair"], got[i]["p_good"]) == pytest.approx(tails, abs=1e-5) and got[i]["expected_grade"] == pytest.approx(sum(tails), abs=1e-5)
    # the fitted parameters are near a minimum of the stated loss: no small step along any used weight or threshold betters it
    grades = np.array([0 if q == 0 else 1 if x else 2 for _, q, x in labels])
    scale = np.clip(1 / (np.bincount(grades) / 60 * 3), 0.1, 10)[grades]

    def loss(w, cut):
        total = 0.0
        for (_, t), g, s in zip(rows, grades, scale / scale.sum(), strict=True):
            at, x = ordinal.features(t)
            tail = [1.0, *(1 / (1 + np.exp(-(w[at] @ x - cut)))), 0.0]
            total -= s * np.log(tail[g] - tail[g + 1])
        return total + 1e-4 * (w @ w)

    base = loss(m.weights, m.thresholds)
    for k in np.flatnonzero(m.weights)[:40]:
        for d in (-0.2, 0.2):
            w = m.weights.copy()
            w[k] += d
            assert loss(w, m.thresholds) > base - 2e-3


def test_ordinal_sample_is_by_hash_and_bounded(spark):
    df = spark.createDataFrame([(i, f"word{i} word{i % 7} other") for i in range(300)] + [(5, "word5 another")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    seen = []
    fit = ordinal.fit
    try:
        ordinal.fit = lambda rows, grades, *a: seen.append((len(rows), sum(len(a) for a, _ in rows))) or fit(rows, grades, *a)
        ordinal.train(df, labels, max_rows=40)
        ordinal.train(df, labels, max_rows=200, max_entries=500)
        ordinal.train(df, labels)
    finally:
        ordinal.fit = fit
    assert seen[0][0] <= 41 and seen[1][1] <= 500 and seen[2][0] == 301  # doc 5 has two texts


# --- op6

def test_streaming_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, m, rng = Tokenizer.from_file(path), bpe_stream.merges(path), random.Random(6)
    parts = ["aaaa", "ab", " ", "\n", "é", "日本", "'s", "'", "the", "ing", "-", "12", "\t", "😀", "<|endoftext|>", "<|end", "\xa0", "\x1c", "ÃÂ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([2, 30]))) for _ in range(200)]
    texts += [p * 3000 + tail for p in ("a", "-", " ", "\n", "é", "the", " \n") for tail in ("", " x")]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (1, 50, 1 << 16) if len(text) < 500 else (777, 5000):
            assert [i for ids in bpe_stream.stream(text, m, chunk) for i in ids] == want
        decoder = bpe_stream.Decoder(m)
        assert "".join(decoder.feed([i]) for i in want) + decoder.finish() == library.decode(want, skip_special_tokens=False)


def test_open_pretoken_memory_is_bounded():
    m = bpe_stream.merges(public_tokenizers.path("byte_bpe_50k.json"))
    e = bpe_stream.Encoder(m)
    for _ in range(200):
        e.feed("ab" * 500)
        assert len(e.buffer) + (len(e.open.rest) if e.open else 0) < 4 * (bpe_stream.BLOCK + m.lookahead)


def test_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe_stream.round_trip(docs, path, with_ids=True).collect()
    assert len(got) == len(fixture_rows()) and all(r["same"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe_stream.round_trip(empty, path).count() == 0


# --- op7

def brute_kneser_ney(texts, order=4):
    """Probability functions p(context, symbol) by the definition: {n: counts} from strings of symbols."""
    grams = {order: defaultdict(int)}
    for t in texts:
        padded = [0] * (order - 1) + kn_langid.symbols(t).tolist()
        for i in range(order - 1, len(padded)):
            grams[order][tuple(padded[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        grams[k] = defaultdict(int)
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    discount = {}
    for k, counts in grams.items():
        ones, twos = (sum(c == n for c in counts.values()) for n in (1, 2))
        discount[k] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 4096
        own = {g: c for g, c in grams[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - discount[k], 0) / total + discount[k] * len(own) / total * p(gram[1:])

    return p


def test_kneser_ney_equals_brute_force(spark):
    rng = random.Random(3)
    say = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    rows = [(i, say(("the cat sat on a mat".split(), "der hund und die katze".split(), ["ζώο", "γάτα", "και"])[i % 3], 6), ("en", "de", "el")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tests = [*(t for _, t, _ in rows[:9]), "the hund sat", "q", "12", "γάτα mat", ""]
    p = {lang: brute_kneser_ney([t for _, t, x in rows if x == lang]) for lang in ("de", "el", "en")}
    for send in (kn_langid.SEND_BYTES, 0):
        model = kn_langid.train(df, F.lit(True), send_bytes=send)
        got = {r["text"]: r for r in kn_langid._measured(spark.createDataFrame([(t,) for t in tests], "text string"), model, ("text",)).collect()}
        assert model.langs == sorted(p) and (model.arrays is None) == (send == 0)
        for t in tests:
            padded = [0] * 3 + kn_langid.symbols(t).tolist()
            want = [-sum(np.log(p[x](tuple(padded[i - 3 : i + 1]))) for i in range(3, len(padded))) / max(len(padded) - 3, 1) for x in model.langs]
            assert got[t]["n"] == len(padded) - 3 and got[t]["h"] == pytest.approx(want, abs=1e-4)


def test_rejection_is_calibrated_on_rows_the_model_has_not_seen(spark):
    ws = [random.Random(i).choice("bcdfgklmn") + random.Random(-i).choice("aeiou") + random.Random(i * 7).choice("rst") for i in range(60)]
    rows = [(i, " ".join(random.Random(i).choices(ws, k=40)), "aa") for i in range(200)] + [(1000, "solitary xyzzy", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = kn_langid.train(df, F.lit(True))
    assert model.langs == ["aa", "rare"] and np.isfinite(model.worst).all()
    fresh = [(i, " ".join(random.Random(i + 999).choices(ws, k=40)), "aa", i * 1.0) for i in range(50)] + [(99, "ЖЖЩ ЪЪЪ ЮЮЮЮ ЭЭЭЭЭ ЫЫЫЫ" * 9, None, 0.0), (98, None, None, 0.0), (97, "123", None, 0.0)]
    kept = kn_langid.kept(spark.createDataFrame(fresh, "doc_id long, text string, lang string, n double"), model).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(50)) and kept[0].asDict().keys() == {"doc_id", "text", "lang", "n"}
    assert kn_langid.kept(df.where("false"), model).count() == 0


def test_language_id(spark, docs, empty):
    rows = [(i, " ".join(random.Random(i).choices(("the of and that is was with for", "der und die nicht das ist ein mit")[i % 2].split(), k=30)), ("en", "de")[i % 2]) for i in range(120)]
    got = {r["doc_id"]: r for r in kn_langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, lang in rows)
    out = kn_langid.identify(docs).collect()
    assert len(out) == len(fixture_rows()) and all((r["lang_pred"] == "und") <= (r["score"] == 0) for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (30, 31, 32, 36)} == {"und"}
    assert kn_langid.identify(empty).count() == 0


# --- op8

def test_sniffing_and_carving():
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    wav = media_sniff.as_wav(bytes(range(256)))
    import gzip
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a", "b")
    for data, kind in ((png, "image/png"), (wav, "audio/wav"), (gzip.compress(b"x" * 999), "application/gzip"), (packed.getvalue(), "application/zip")):
        assert media_sniff.sniff(data + b"tail", "text/plain")[:3] == (kind, len(data), True)
        found = media_sniff.carve(b"BM junk RIFF PK\x03\x04 " + data + b"more")
        assert [(f.kind, f.at, f.length) for f in found] == [(kind, 18, len(data))]
    assert media_sniff.sniff(wav[:-3], None)[0] == media_sniff.UNKNOWN
    bad = bytearray(png)
    bad[-2] ^= 1
    assert media_sniff.carve(bytes(bad)) == []


def test_hostile_media_are_carved_in_one_pass():
    import time

    began = time.time()
    for data in (b"PK\x03\x04 PK\x05\x06" * 40000, b"%PDF-1 %%EOF startxref " * 40000, b"PK\x03\x04" * 100000, b"%PDF-1" * 100000):
        media_sniff.carve(data)
    assert time.time() - began < 20
    pdf = b"%PDF-1.4 x startxref 9 %%EOF more %%EOF"
    assert [(f.at, f.length) for f in media_sniff.carve(b"ab" + pdf + b" %PDF-2 startxref %%EOF.")] == [(2, len(pdf)), (3 + len(pdf), 22)]


def test_stored_media(spark, docs, empty):
    got = media_sniff.stored_and_examined(docs).collect()

    def brute(doc_id, text):
        raw = (text or "").encode()
        n = 576 * max(1, -(-len(raw) // 576))
        payload = raw + b"\xff" * (n - len(raw))
        media = b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
        x = list(payload)
        feature = f"audio/wav;corrected=1;length={len(media)};frames={n // 576};sum={sum(x)};squares={sum(v * v for v in x)};changes={sum(a != b for a, b in zip(x, x[1:]))};carved=[]"
        return tuple(map(str, (doc_id, len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)))

    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted(tuple(str(r[n]) for n in names) for r in got) == sorted(brute(r[0], r[1]) for r in fixture_rows())
    assert media_sniff.stored_and_examined(empty).count() == 0
    inside = media_sniff.examine(spark.createDataFrame([(1, 3, None, bytearray(b"xx" + media_sniff.as_wav(bytes(576)))), (2, 0, "a/b", None)], "doc_id long, n_bytes long, declared string, media binary")).collect()
    assert "carved=[audio/wav@2+620]" in inside[0]["feature"] and inside[1]["media_bytes"] == 0


# --- op9

def test_mix(docs, empty):
    got = mix.mixed_sizes(docs).collect()
    rows = fixture_rows()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, free, target = 1.5 * sum(size.values()), set(order), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            budget -= target[s]
        free -= full
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mix.mixed_sizes(docs).collect()))
    assert mix.mixed_sizes(empty).count() == 0 and mix.mix(empty).count() == 0


def test_mix_splits_repeated_rows_and_keeps_columns(spark):
    rows = [(None, "ten words " * 5, "s", 1.5)] * 100 + [(7, "a b c", "s", 2.5)] * 60 + [(8, "x", "t", 3.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies double").withColumn("rest", F.lit("mine"))
    got = mix.mixed_sizes(df).collect()
    total = sum(r["taken"] for r in got if r["source"] == "s")
    target = next(r["target"] for r in got if r["source"] == "s")
    assert abs(total - target) <= 10 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix.mixed_sizes(df).collect()))
    mixed = mix.mix(df).select("row.*", F.col("copies").alias("n")).collect()
    assert {r["rest"] for r in mixed} == {"mine"} and {r["copies"] for r in mixed} == {1.5, 2.5, 3.5}
    assert sum(len((r["text"] or "").split()) * r["n"] for r in mixed) == sum(r["taken"] for r in got)
    # the ranges stay even for the least weight
    cells = spark.range(20000).select((mix.key_cell(mix.sampling_key(F.col("id"), F.lit("t"), F.lit(0.1), "s")) / mix.CELLS).cast("int").alias("c"))
    assert cells.groupBy("c").count().agg(F.max("count")).first()[0] < 60


# --- op10

def test_licenses(docs, empty, spark):
    got = {r["doc_id"]: r for r in license_join.scan(docs).collect()}
    r = got[37]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (2, 3, 8, "apache,mit", "apache,mit", 1.0)
    assert got[30]["n_words"] == 0 and got[30]["first_word"] is None and got[30]["labels"] == ""
    assert license_join.scan(empty).count() == 0
    df = spark.createDataFrame([(1, "The MIT  license\nLicensed under CC BY-NC 4.0, mostly"), (2, "mit\nLICENSE Licence")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_join.scan(df).collect()}
    assert got[1]["labels"] == "cc-by-nc,mit" and got[2]["base_labels"] == "mit"


def test_wrapped_notices_are_met(spark):
    notices = {k: [t for label, t, _ in license_join.TEMPLATES if label == k][-1] for k in ("mit", "bsd", "apache", "gpl", "mpl")}
    wrap = lambda t, n: "\n".join(" * " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [(k, n, f"some text\n{wrap(t, n)}\n\nmore text here") for k, t in notices.items() for n in (1, 4, 10, 13)]
    rows += [("gpl", 0, "it under the terms of the GNU General\nPublic License as published by\nthe foundation"), ("agpl,gpl", 0, "it under the terms of the GNU\nAffero General Public\nLicense")]
    rows += [("bsd,mpl", 0, f"{notices['bsd']} {notices['mpl']}"), ("gpl,lgpl", 0, wrap(notices["gpl"], 9) + "\nunder the terms of the\nGNU Lesser General Public License")]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_join.scan(df).collect()}
    assert [(k, n, got[i]) for i, (k, n, _) in enumerate(rows)] == [(k, n, k) for k, n, _ in rows]


def test_join_equals_brute_force(spark):
    rng = random.Random(8)
    templates = [(f"t{i}", " ".join(rng.sample(WORDS, rng.randint(1, 7)))) for i in range(8)]
    rows = [(i, "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(4))) for i in range(40)]
    for threshold in (0.5, 0.8, 1.0):
        got = {(r["doc_id"], r["block"], r["template"]) for r in license_join.join_templates(spark.createDataFrame(rows, "doc_id long, text string"), templates, threshold).collect()}
        want = {(i, b, k) for i, t in rows for b, line in enumerate(t.split("\n")) for k, (_, x) in enumerate(templates) if len(set(x.split()) & set(line.split())) >= threshold * len(set(x.split())) - 1e-9}
        assert got == want


# --- all

def test_a_very_long_text_beside_empty_ones(spark):
    rng = random.Random(14)
    long = "".join(" ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(rng.randint(1, 30))) + rng.choice([". ", ".\n", "\n\n"]) for _ in range(8000))
    rows = [(1, long, "en", "s"), (2, "", None, "s"), (3, None, "en", None), (4, long[:-50], "en", "t"), (5, "a few words", "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len(long) > 900_000
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    words = [len((t or "").split()) for _, t, _, _ in rows]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert [r["n_tokens"] > 1 for r in token_records.record_table(df, path).orderBy("doc_id").collect()] == [True, False, False, True, True]
    trees = {r["doc_id"]: r for r in merkle.fingerprint_documents(df).collect()}
    assert trees[1]["n_chars"] == len(long) and trees[3]["near_next"] < 0.1 and len(trees[1]["fingerprint"]) == 64
    assert [r["component_id"] for r in simhash.near_duplicates(df).orderBy("doc_id").collect()][1:3] == [2, 2]
    assert {r["doc_id"]: r["component"] for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5}
    assert ordinal.graded(df, labels).count() == 5 and kn_langid.identify(df).where("lang_pred = 'und'").count() == 2
    assert all(r["same"] for r in bpe_stream.round_trip(df, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert {r["doc_id"]: r["n_bytes"] for r in media_sniff.stored_and_examined(df).collect()}[1] == len(long)
    assert [r["size"] for r in mix.mixed_sizes(df).orderBy("doc_id").collect()] == words and [r["n_words"] > 0 for r in license_join.scan(df).orderBy("doc_id").collect()] == [True, False, False, True, True]
    assert {r["doc_id"] for r in simhash.one_of_each(df.withColumn("_doc", F.lit(1)).withColumn("h", F.lit("x"))).collect()} == {1, 2, 5}


# --- queries and SQL

def test_queries_match_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cell = lambda v: "~" if str(v) in ("None", "nan", "<NA>") else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    rows = lambda d: sorted(tuple(cell(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(con.sql(sql).df()), name


def test_classes_of_real_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    want = jaccard_classes([r["text"] or "" for r in docs])
    got = {r["doc_id"]: r["component"] for r in simhash.similar_documents(spark.createDataFrame(docs)).collect()}
    assert [got[r["doc_id"]] for r in docs] == [docs[i]["doc_id"] for i in want] and len(set(want)) < len(docs)


def brute_mix(rows):
    """How often each (doc_id, text, source) is taken, by the definition."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, free, budget = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(size.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        budget -= sum(target[s] for s in full)
        free -= full

    def key(doc_id, t):
        bits = int(hashlib.md5("|".join(["mix", str(doc_id), hashlib.md5(t.encode()).hexdigest()]).encode()).hexdigest()[:12], 16)
        signs = len(re.findall(mix.PUNCTUATION, t))
        return -np.log((bits + 0.5) / 2**48) / (max(0.1, 1 - 4 * signs / len(t)) if t else 0.1)

    out = {}
    for s in order:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, upto = target[s] - epochs * size[s], 0
        for _, (i, t) in sorted((key(i, t), (i, t)) for i, t, x in rows if x == s):
            upto += words(t)
            out[i] = epochs + (rest > 0 and upto - words(t) / 2 <= rest)
    return out


def test_pipeline(spark):
    """run() against brute force: dense scores, classes of all pairs, the mix by its definition, the library's ids. The
    models are the stages' own; other tests hold them against theirs."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    model = ordinal.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    at = [g for g in model.grades[1:] if g >= 1][0]
    dense = lambda t: sum(model.weights[i] * x for i, x in zip(*ordinal.features(t), strict=True))
    rows = [r for r in docs.collect() if 1 / (1 + np.exp(-(dense(r["text"]) - model.thresholds[model.grades[1:].index(at)]))) >= 0.5]
    good = spark.createDataFrame(rows, docs.schema)
    languages = kn_langid.train(good, kn_langid.learned(F.col("doc_id")))
    accepted = {r["doc_id"] for r in kn_langid.predict(good, languages).collect() if r["accepted"]}
    rows = sorted((r for r in rows if r["doc_id"] in accepted), key=lambda r: r["doc_id"])
    group = jaccard_classes([r["text"] or "" for r in rows])
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    taken = brute_mix([(r["doc_id"], r["text"] or "", r["source"]) for r in rows])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows for _ in range(taken[r["doc_id"]]))
    assert sorted((r["doc_id"], r["ids"]) for r in out) == want and all(r["same"] for r in out) and len(want) > 50


def test_stages_begin_on_small_heaps(spark, monkeypatch):
    """Garbage of 2 GB leaves the JVM's heap before a stage does anything; every stage begins so."""
    import corpus_pipeline

    docs, size = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark._jvm.java.lang.Runtime.getRuntime().totalMemory
    garbage = spark._jvm.java.nio.ByteBuffer.allocate(2000 << 20)
    del garbage
    gc.collect()
    before = size()
    assert before > 2000 << 20
    assert corpus_pipeline.bpe_encode(spark, docs, "").first()["n_tokens"] == 2
    assert size() < before - (1 << 30)

    class Begun(Exception):
        pass

    def begin(_):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "give_back", begin)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, docs, "")


def test_similar_documents_start_from_simhashes(spark, monkeypatch):
    """The links between fingerprints connect what all pairs within two bits connect; the pipeline's stage begins with them."""
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    fps = [f ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False))) for f in base for _ in range(6)]
    got = simhash.fingerprint_pairs(spark.createDataFrame(list(enumerate(fps)), "node long, fp long")).collect()
    assert all(r["u"] < r["v"] for r in got)

    def classes(pairs):
        up = list(range(len(fps)))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(x) for x in range(len(fps))]

    near = [(a, b) for b in range(len(fps)) for a in range(b) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2]
    assert classes((r["u"], r["v"]) for r in got) == classes(near) and len(set(classes(near))) < len(fps)
    seen, plain = [], simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda nodes: seen.append(nodes.count()) or plain(nodes))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "x y z")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [1, 3] and seen == [2]
