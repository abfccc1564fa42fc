"""Phrase mining, the conversation trie and token counts against plain versions."""

import hashlib
import pickle
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalloom.llm import conversation_trie, phrase_mining, queries, token_counts
from evalloom.llm import text as text_module

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- phrases
def brute_phrases(rows, least, share, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for k, v in counts.items() if len(k) == 1)
        frequent = {k: v for k, v in counts.items() if len(k) > 1 and v >= least}
        listed = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for q, b in frequent.items()):
                continue
            cuts = [(int(Fraction(1000000 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            listed.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


ROWS = [
    ("The the the, the THE the. a b c a b c; a b", "en"), ("a b c\ta b c a b c x y!x y x y", "en"), (None, "en"), ("", "en"), ("   \t ", None),
    ("a b c a b c", None), ("Ärger über ärger über Ärger über", "de"), ("Ärger über ärger über Ärger über", "de"), (" ".join(["lang mot"] * 40000), "fr"), ("x\ny z\ry z\x0by z\x0cy z y  z", "und"),
]


@pytest.mark.parametrize(("least", "share", "top", "per_shard"), [(2, 50, 2000, 1000), (3, 101, 2, 5)])
def test_phrases_equal_brute_force(spark, least, share, top, per_shard):
    docs = spark.createDataFrame([(t, g, 1, "h", 2) for t, g in ROWS], "text string, lang string, n int, h1 string, score int").repartition(4)
    got = phrase_mining.best_phrases(docs, top=top, least=least, share=share, per_shard=per_shard, bits=1 << 16)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(ROWS, least, share, top)


def test_more_tries_mean_no_more_passes_over_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "text string, lang string")
    passes, real = [], phrase_mining.texts
    monkeypatch.setattr(phrase_mining, "texts", lambda of: passes.append(1) or real(of))
    seen = []
    for per_shard in (1000, 1):
        passes.clear()
        assert phrase_mining.best_phrases(docs, least=2, per_shard=per_shard, bits=1 << 16).count() > 10
        seen.append(len(passes))
    assert seen[0] == seen[1]


def test_phrases_of_an_empty_table(spark):
    got = phrase_mining.best_phrases(spark.createDataFrame([], "text string, lang string"))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_crowded_bits_let_phrases_in_but_lose_none(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "text string, lang string")
    monkeypatch.setattr(phrase_mining, "HELD", 10)
    got = phrase_mining.best_phrases(docs, least=2, bits=1 << 16)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(ROWS, 2, 50, 2000)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.sets(st.tuples(st.integers(0, 2), st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), max_size=80), st.lists(st.integers(0, 11), min_size=1, max_size=60))
def test_double_array_finds_every_phrase(depth, found, walk):
    phrases = np.array(sorted({p[: depth + 1] for p in found}), np.uint64).reshape(-1, depth + 1) + np.uint64(1 << 40)
    trie = phrase_mining.DoubleArray(phrases)
    words = np.array(walk, np.uint64) + np.uint64(1 << 40)
    follows = np.r_[np.arange(len(walk) - 1) % 5 != 3, False]
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    for tongue in range(3):
        langs = np.array([tongue], np.uint64) + np.uint64(1 << 40)
        want = [known.get((int(langs[0]), *words[i : i + depth].tolist()), -1) if i + depth <= len(walk) and follows[i : i + depth - 1].all() else -1 for i in range(len(walk))]
        assert trie.advance(langs, np.zeros(len(walk), int), words, follows, depth).tolist() == want


def test_double_array_with_crowded_nodes():
    rng = np.random.default_rng(1)
    phrases = np.unique(np.c_[np.zeros(60000, np.uint64), (rng.zipf(1.3, 60000) % 5000).astype(np.uint64), (rng.zipf(1.3, 60000) % 5000).astype(np.uint64)], axis=0)
    trie = phrase_mining.DoubleArray(phrases)
    words = phrases[:, 1:].reshape(-1)
    got = trie.advance(np.zeros(1, np.uint64), np.zeros(len(words), int), words, np.arange(len(words)) % 2 == 0, 2)
    assert got[::2].tolist() == list(range(len(phrases))) and (got[1::2] == -1).all()
    assert trie.size < 4 * len(phrases)


# ---------------------------------------------------------------- conversations
def brute_trie(rows, rebuilt=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).hexdigest())
    own = {c: [x[2:] for x in sorted(v, key=order)] for c, v in by.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        full = {c: own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    else:
        full = own
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    kids = Counter(p[:-1] for p in members if p)
    for p, who in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in sorted(who) if len(full[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def talk(*convs):
    return [(c, i, "user" if i % 2 == 0 else "bot", t) for c, texts in convs for i, t in enumerate(texts)]


CASES = {
    "copies and branches": talk(*[(c, ["hi there", "yes  you", f"q {c % 3}", "bye"][: 1 + c % 4]) for c in range(60)]),
    "nulls, ties, repeated rows": [(0, None, None, None), (0, 1, "a", "x y"), (0, 1, "a", "w"), (0, 1, "a", "w"), (7, None, "", ""), (7, 1, "a", "w"), (None, 0, "a", "b"), (21, 0, "u", " ")],
    "one conversation": talk((40, ["a", "b", "c d e"])),
    "no turns left": talk((13, ["a"]), (33, ["b"]), (53, ["c"]), (73, ["d"])),
    "long and copied": talk(*[(c, [f"turn {i}" for i in range(30 + c % 3)]) for c in range(0, 80, 10)]),
    "negative ids": talk((-20, ["a", "b", "c"]), (-25, ["x", "y", "z", "w"]), (-3, ["a", "q", "r", "s", "t"]), (0, ["a", "b"])),
}


@pytest.mark.parametrize("case", CASES)
def test_trie_equals_brute_force(spark, case):
    rows = CASES[case]
    wide = spark.createDataFrame([(*r, "x", 5) for r in rows], TURNS + ", depth string, k1 int").repartition(3)
    got = conversation_trie.conversation_trie(wide)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = CASES["copies and branches"] + talk((99, ["hi there", "no"]))
    got = conversation_trie.plain_trie(spark.createDataFrame(rows, TURNS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows, rebuilt=False)


def test_trie_of_an_empty_table(spark):
    got = conversation_trie.conversation_trie(spark.createDataFrame([], TURNS))
    assert got.count() == 0 and got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_ends_of_many_conversations_in_runs(spark):
    ids = list(range(0, 9000, 3))
    rows = [(c, 0, "u", "same") for c in ids]
    got = conversation_trie.plain_trie(spark.createDataFrame(rows, TURNS).repartition(5)).filter("depth = 1").collect()
    assert [(r["n_convs"], r["saved_tokens"], r["ends_sha256"]) for r in got] == [(3000, 2999, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


# ---------------------------------------------------------------- token counts
TEXTS = [(1, "a  b\n\n c <|endoftext|> d"), (2, None), (3, ""), (4, "same text"), (5, "same text"), (5, "same text"), (None, "same text"), (None, "naïve 漢字 😀 don't"), (6, "word " * 30000), (7, "\x00\t\r\n")]


def library_count(path, text):
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(*r, 1, "c") for r in TEXTS], "doc_id bigint, text string, n_tokens int, content string").repartition(3)
    got = token_counts.token_counts(docs, path, limit=4)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := library_count(path, t or ""), n > 4) for i, t in TEXTS]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_only_distinct_misses_are_encoded_and_kept(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    first = token_counts.count_tokens(docs, BYTES, cache).collect()
    stored = lambda: spark.read.schema(token_counts.SCHEMA).parquet(cache)
    assert stored().count() == len({t or "" for _, t in TEXTS})
    # marked counts show that a second run reads them
    version = token_counts.tokenizer_digest(BYTES)
    more = spark.createDataFrame([*TEXTS, (9, "new")], "doc_id bigint, text string")
    again = token_counts.count_tokens(more, BYTES, cache)
    assert sorted(map(repr, map(tuple, again.filter("doc_id IS NULL OR doc_id <> 9").collect()))) == sorted(map(repr, map(tuple, first)))
    assert stored().count() == len({t or "" for _, t in TEXTS}) + 1
    spark.createDataFrame([(bytes.fromhex(hashlib.sha256(b"kept").hexdigest()), 77, version)], token_counts.SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    kept = token_counts.count_tokens(spark.createDataFrame([(1, "kept")], "doc_id bigint, text string"), BYTES, cache)
    assert [r["n_tokens"] for r in kept.collect()] == [77]
    # another tokenizer has a partition of its own
    token_counts.count_tokens(docs.limit(2), public_tokenizers.path("piece_bpe_32k.model"), cache).collect()
    assert {r[0] for r in stored().select("tokenizer").distinct().collect()} == {version, token_counts.tokenizer_digest(public_tokenizers.path("piece_bpe_32k.model"))}


def test_texts_that_normalise_alike_are_one_entry(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "Same  Words"), (2, "same words")], "doc_id bigint, text string")
    got = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache, normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert [tuple(r) for r in got.orderBy("doc_id").select("n_bytes", "n_tokens").collect()] == [(11, 2), (10, 2)]
    assert spark.read.parquet(cache).count() == 1


def test_counts_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.token_counts(empty, BYTES, cache=str(tmp_path / "c")).count() == 0


# ---------------------------------------------------------------- what travels
def test_tables_of_this_process_do_not_travel(spark):
    text_module.powers(text_module.STEP, 3_000_000)
    for function in (text_module.span_hash, phrase_mining.count_words, phrase_mining.longer):
        assert len(cloudpickle.dumps(function)) < 1_000_000
    assert pickle.loads(pickle.dumps(text_module._powers)) == {}


def test_queries_are_registered():
    assert {"op11_phrase_mining", "op12_conversation_trie", "op13_token_counts"} <= set(queries.QUERIES)
