"""Classifiers by held-out accuracy, packing and tokens by their invariants, the pipeline by its stages."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evalloom.llm import quality_classifier as mil
from evalloom.llm import quality_rules as rules
from evalloom.llm.packing import Encoder, best_fit_pack, plan
from evalloom.llm.piece_sampling import Pieces, Sampler, decode, sample_pieces
from evalloom.llm.quality_classifier import quality_classifier
from evalloom.llm.quality_rules import fit, quality_rules
from evalloom.llm.toxicity import toxicity

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  a", "a  ", "a \n b", "\n\n a", " \t x", "<|endoftext|> hi", "it's 's 12 34! ?", "x\x1c y \x85 z", "日本 語 テキスト",
    "a 　 b", "don't  DON'T ' s", "▁a ▁ b", "Por " * 3000, "x" * 5000, "é" * 300,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "d", 1, 2) for i, t in enumerate(ODD)] + [(3, "a", "d", 1, 2), (3, "a", "d", 1, 2), (None, "no id", "d", 1, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, y int, length int").repartition(3)


@pytest.fixture(scope="module")
def large(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    return read("documents"), read("labels")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_on_held_out_rows(large):
    docs, labels = large
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (fold(i, 3) == 1) for i, r in got.items())
    truth = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if fold(r["doc_id"], 3) == 1]
    toxic, clean = [p for p, y in truth if y], [p for p, y in truth if not y]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.03


def test_quality_on_held_out_rows(large):
    docs, labels = large
    got = {r["doc_id"]: r for r in quality_classifier(docs, labels).collect()}
    assert all(r["held_out"] == (fold(i, 5) == 0) for i, r in got.items())
    truth = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if fold(r["doc_id"], 5) == 0]
    assert np.mean([p == y for p, y in truth]) > 0.98


def test_rules_keep_clean_documents(large):
    docs, labels = large
    got = {r["doc_id"]: r for r in quality_rules(docs, labels).collect()}
    truth = [(got[r["doc_id"]], r["quality"]) for r in labels.collect()]
    clean = [r["kept"] for r, y in truth if y and not r["base_failed"]]
    assert np.mean(clean) > 0.99
    assert np.mean([r["kept"] for r, y in truth if not y]) < 0.05


def test_base_counts(spark, odd):
    extra = ["a b c d e a b c d e f g h i j", "l1\nl1\n \nl2\n\nl1 x\nl1", "#*$%&|<> é#"]
    rows = spark.createDataFrame(list(enumerate(extra, 100)), "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    labels = spark.createDataFrame([(3, 1), (100, 0)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_rules(rows, labels).collect()}
    for i, t in [*enumerate(extra, 100), *enumerate(ODD)]:
        w = (t or "").encode().split()
        seen = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + j for k, s in enumerate(seen) if seen.count(s) > 1 for j in range(5)} if len(seen) < 200 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((800, 2))
    forest = fit(x, (x[:, 0] + rng.normal(0, 0.4, 800) > 0.5).astype(float), [-1, 0])
    grid = np.linspace(0, 1, 50)
    for other in (0.1, 0.9):
        scores = forest.score(np.stack([grid, np.full(50, other)], 1))
        assert (np.diff(scores) <= 1e-12).all()
    free = fit(x, (x[:, 0] > 0.5).astype(float), [0, 0])
    assert ((free.score(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.97


def test_models_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        for run in (toxicity, quality_classifier, quality_rules):
            got = run(odd, labels).collect()
            assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
            assert run(odd.limit(0), labels).count() == 0
    kept = rules.keep_rows(odd, rules.train(odd, none))
    assert kept.columns == odd.columns and kept.filter("size(split(trim(text), ' ')) < 10").count() == 0
    assert mil.keep_rows(odd, 1.0).count() == odd.count() and mil.keep_rows(odd, 0.0).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    encode, rng = Encoder(BPE), np.random.default_rng(1)
    alphabet = [" ", " ", "\n", "a", "b", "'s", "é", "1", "!", "\t", "\x1c", "\x85", "日", "　"]
    for text in [t or "" for t in ODD] + ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(2000)]:
        assert np.frombuffer(encode(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(odd):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    got = best_fit_pack(odd, BPE, keep_ids=True).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(ODD)}
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
        part = np.frombuffer(bytes(r["ids"]), "<u4")
        assert part.tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert len(by_doc) == len(ODD) and len(by_doc[3]) == 3
    for i, rows in by_doc.items():
        if i != 3:
            rows.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["length"] for r in rows) == len(ids[i])
            assert all(r["length"] == 2048 for r in rows[1:])
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) == -(-total // 2048)
    assert best_fit_pack(odd.limit(0), BPE).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(2048, 2048, 2048**2), (100, 4, 5000)])
def test_plan_keeps_every_capacity(by, caps):
    rng = np.random.default_rng(3)
    counts = {int(n): int(k) for n, k in zip(rng.integers(1, 71, 40), rng.integers(1, 500, 40), strict=True)}
    steps = plan(counts, caps, by=by)
    placed, bins = {}, {}
    for length, rank, k, first, offset in steps.tolist():
        placed.setdefault(length, []).extend(range(rank, rank + k))
        for b in range(first, first + k):
            bins.setdefault(b, []).append((offset, length))
    assert {n: sorted(x) for n, x in placed.items()} == {n: list(range(k)) for n, k in counts.items()}
    for rows in bins.values():
        rows.sort()
        assert [o for o, _ in rows] == np.cumsum([0, *(n for _, n in rows[:-1])]).tolist()
        assert sum(n for _, n in rows) <= caps[0] and len(rows) <= caps[1] and sum(n * n for _, n in rows) <= caps[2]


def test_sampled_pieces_come_back(odd):
    first = {(r["doc_id"], r["ids_crc32"]) for r in sample_pieces(odd, PIECES).collect() if r["lossless"]}
    again = {(r["doc_id"], r["ids_crc32"]) for r in sample_pieces(odd.repartition(1), PIECES).collect()}
    assert first == again and len(first) == len(ODD)


def test_samples_follow_the_lattice():
    vocabulary = Pieces(PIECES)
    for unit in (" then", " ▁éa日", "  x\n", " " + "ab" * 40):
        sampler = Sampler(vocabulary)
        sampler._learn([unit])
        cdf, node, source, _ = vocabulary.lattice(unit)
        assert np.allclose(sampler.cdf, np.array(node) + np.array(cdf)) and sampler.source.tolist() == source
    ids, bounds = Sampler(vocabulary).sample(np.arange(4000), ["then"] * 4000)
    texts = {decode(vocabulary, ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)}
    assert texts == {"then"}
    # two pieces at least split the paths: shares are those of the weights
    cdf, node, source, piece = vocabulary.lattice(" then")
    ends = [k for k in range(len(node)) if node[k] == 5]
    share = np.diff([0.0] + [cdf[k] for k in ends])
    last = [ids[b - 1] for b in bounds[1:]]
    for k, p in zip(ends, share, strict=True):
        assert abs(np.mean([x == piece[k][-1] for x in last]) - p) < 0.03


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd_rows = spark.createDataFrame([(None, "no id " * 3), (None, None), (9001, None), (9002, "")], "doc_id bigint, text string")
    docs = docs.unionByName(odd_rows, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = {(r["doc_id"], r["text"]) for r in out.collect()}
        if name != "suffix-array dedup":
            assert rows <= {(r["doc_id"], r["text"]) for r in docs.collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None}
