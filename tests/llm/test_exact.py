"""The exact operators against brute force, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalloom.llm.embedding_dedup import embedding_links
from evalloom.llm.license_scan import BASE, license_scan
from evalloom.llm.minhash import estimate, near_duplicates, signatures
from evalloom.llm.repeat_groups import byte_segments, maximal_repeats, remove_repeats, strip_repeats
from evalloom.llm.substring_dedup import FMIndex, remove_windows, window_matches

CLASHES = "doc_id bigint, text string, name bigint, digest string, s string, low int, row int, start int, y int, rep bigint"


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120)
    texts = [None, "", "  \n\t ", "one", "One two three", "one  two\nthree", "\x0b\x0c", prose(4000), "Por " * 900, "Por " * 700 + "x", "日本語 テキスト " * 60]
    texts += [prose(rng.randint(3, 90)) for _ in range(40)]
    texts += [prose(rng.randint(0, 20)) + " " + passage + " " + prose(rng.randint(0, 20)) for _ in range(25)]
    for _ in range(25):
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[20]] * 30 + [base.upper()]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [rows[0], rows[20], (None, "an id is missing here"), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "d", "s", 2, 3, 4, 5, 6) for i, t in rows], CLASHES).repartition(5)
    return frame, [(i, t or "") for i, t in rows if i is not None]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def reached(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(docs, percent):
    frame, rows = docs
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    parts = reached(sets, links)
    want = sorted((i, len(s), parts[i], parts[i] == i) for i, s in sets.items())
    assert rows_of(near_duplicates(frame, percent), "doc_id", "n_shingles", "component_id", "kept") == want


def test_minhash_estimate_follows_similarity(spark):
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(2000)]
    texts = [" ".join(words)] + [" ".join(words[: 2000 - cut] + [str(rng.random()) for _ in range(cut)]) for cut in (100, 600, 2000)]
    got = {r["doc_id"]: r for r in signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    import pyarrow as pa

    for i, cut in ((1, 100), (2, 600), (3, 2000)):
        share = (1996 - cut) / (1996 + cut)
        assert abs(estimate(pa.array([bytes(got[0]["packed"])]), pa.array([bytes(got[i]["packed"])]))[0] - max(share, 0)) < 0.15


def test_windows(docs):
    frame, rows = docs
    first = {}
    words = [(i, t.encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        rest = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(rest).hexdigest()))
    assert rows_of(remove_windows(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


def test_repeats(docs):
    frame, rows = docs
    bodies = [(i, t.encode()) for i, t in rows]
    seen = Counter(b[k : k + 200] for _, b in bodies for k in range(len(b) - 199))
    want, texts = [], {}
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
        texts[i] = rest.decode("utf-8", "ignore")
    assert rows_of(remove_repeats(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)
    stripped = strip_repeats(frame)
    assert stripped.columns == frame.columns
    got = stripped.collect()
    assert len(got) == frame.count()
    assert all((r["text"] or "") == texts[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert {r["text"] for r in got if r["doc_id"] is None} == {None, "an id is missing here"}


def test_maximal_repeats_are_all_found():
    rng = random.Random(5)
    for _ in range(100):
        bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        places = defaultdict(list)
        for i, b in enumerate(bodies):
            for p in range(len(b)):
                for q in range(p + 3, len(b) + 1):
                    places[b[p:q]].append((i, p))
        want = set()
        for w, occ in places.items():
            left = {bodies[i][p - 1] if p else (i, p) for i, p in occ}
            right = {bodies[i][p + len(w)] if p + len(w) < len(bodies[i]) else (i, p) for i, p in occ}
            if len(occ) > 1 and len(left) > 1 and len(right) > 1:
                want.add((w, tuple(sorted(occ))))
        assert {(bodies[o[0][0]][o[0][1] : o[0][1] + d], tuple(sorted(o))) for d, o in maximal_repeats(bodies, 3)} == want


def test_equal_windows_share_a_name():
    rng = random.Random(6)
    for _ in range(100):
        size = rng.choice([2, 5, 12, 20])
        bodies = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        found = byte_segments(data, np.concatenate([[0], np.cumsum([len(b) for b in bodies])]), size)
        names, times, held = defaultdict(set), Counter(), Counter()
        for row, start, n, name, k in zip(*found, strict=True):
            times[name] += k
            for p in range(start, start + n):
                window = bodies[row][p : p + size]
                assert len(window) == size
                names[window].add(name)
                held[window] += 1
        assert sum(held.values()) == sum(max(0, len(b) - size + 1) for b in bodies)
        assert all(len(n) == 1 for n in names.values())
        assert all(times[min(names[w])] > 1 for w, k in held.items() if k > 1)


def test_fm_index_counts_words():
    rng = np.random.default_rng(2)
    codes = np.concatenate([rng.integers(2, 6, 300), [1]])
    index = FMIndex(codes, 8)
    places = np.arange(0, 290)
    for size in (1, 3, 8):
        low, high = window_matches(index, codes, places, size)
        for p in range(0, 290, 17):
            want = [k for k in range(len(codes) - size + 1) if (codes[k : k + size] == codes[p : p + size]).all()]
            assert sorted(index.order[low[p] : high[p]].tolist()) == want


def test_licences(docs, spark):
    frame, rows = docs
    extra = ["Released under the MIT License.", "GNU General Public License; mit license, MIT LICENSE", "cc", "mit", "Licensed under the Apache License, Version 2.0", "All rights reserved.", "cc by-sa 4.0 cc by"]
    rows = rows + [(2000 + k, t) for k, t in enumerate(extra)]
    more = spark.createDataFrame([(i, t) for i, t in rows if i >= 2000], "doc_id bigint, text string")
    got = license_scan(frame.select("doc_id", "text").unionByName(more)).collect()
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places, labels = [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    by_id = {r["doc_id"]: r for r in got}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert "apache-2.0" in by_id[2004]["labels"] and by_id[2005]["labels"] == "all-rights-reserved" and by_id[2003]["labels"] == ""


@pytest.mark.parametrize("block", [7, 2048])
def test_embeddings(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    vectors = [(centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.01, 0.15, 0.4])).astype(np.float32).tolist() for _ in range(150)]
    vectors += [vectors[3]] * 20 + [[0.0] * 8, None, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], [1e30] * 8, [-0.0] + [1.0] * 7, [0.0] + [1.0] * 7, [1.0, 2.0]]
    ids = rng.permutation(1000)[: len(vectors)].tolist()
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in zip(ids, vectors, strict=True)] + [(None, [1.0] * 8, "x", 3)], "vec_id bigint, embedding array<float>, key string, copies int").repartition(3)
    good = {}
    for i, v in zip(ids, vectors, strict=True):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    cosine = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and cosine(good[a], good[b]) >= 0.95]
    count = Counter(x for link in links for x in link)
    parts = reached(ids, links)
    want = sorted((i, count[i], parts[i], parts[i] == i) for i in ids)
    assert rows_of(embedding_links(frame, 0.95, block), "vec_id", "n_links", "component_id", "kept") == want


def test_empty_tables(spark, nothing):
    assert near_duplicates(nothing).count() == 0
    assert remove_windows(nothing).count() == 0
    assert remove_repeats(nothing).count() == 0
    assert license_scan(nothing).count() == 0
    assert embedding_links(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
