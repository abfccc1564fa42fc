"""Cases of the second review: added tokens, long unknown units, labels of a filtered stage."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evalloom.llm import queries
from evalloom.llm.packing import Encoder
from evalloom.llm.piece_sampling import Pieces, Sampler, decode

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MARKED = [
    "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|> hi", "x<|endoftext|><|endoftext|>y", "end \n<|endoftext|>\n\n next", "<|endoftext| >", "a  <|endoftext|>  b",
    " <|endoftext|>", "it's<|endoftext|>'s 12", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", "日本<|endoftext|>語",
]


def test_added_tokens_get_the_ids_of_the_unmodified_tokenizer():
    tokenizer = Tokenizer.from_file(BPE)
    encode, rng = Encoder(BPE, added=True), np.random.default_rng(2)
    alphabet = [" ", " ", "\n", "a", "'s", "é", "1", "\t", "日", "<|endoftext|>", "<|", "|>"]
    for text in MARKED + ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(2000)]:
        assert np.frombuffer(encode(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_query_counts_added_tokens_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(MARKED)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in queries.op10_best_fit_packing(spark, str(tmp_path)).collect()}
    for i, text in enumerate(MARKED):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), text


def test_long_unknown_units_leave_their_neighbours_alone():
    vocabulary = Pieces(PIECES)
    plain = ["the quick brown fox", "it's then 12 times", "Por que não"]
    unknown = [c for c in map(chr, range(0x10000, 0x10080)) if c not in vocabulary.ids]
    odd = ["".join(unknown[(7 * i + n) % len(unknown)] for i in range(n)) for n in range(40, 61)]
    alone, bounds = Sampler(vocabulary).sample(np.arange(3), plain)
    want = [alone[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    texts = [odd[0], *odd, *plain, " ".join(odd), *odd[::-1]]
    keys = np.arange(len(texts)) + 100
    at = texts.index(plain[0])
    keys[at : at + 3] = np.arange(3)
    sampler = Sampler(vocabulary)
    ids, bounds = sampler.sample(keys, texts)
    parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert np.isfinite(sampler.cdf).all()
    assert [decode(vocabulary, p) for p in parts] == texts
    assert [p.tolist() for p in parts[at : at + 3]] == want
    for unit in (" " + odd[7], " a" + odd[0] + "then"):
        one = Sampler(vocabulary)
        one._learn([unit])
        cdf, node, source, _ = vocabulary.lattice(unit)
        assert np.allclose(one.cdf, np.array(node) + np.array(cdf)) and one.source.tolist() == source


def test_classifier_stage_learns_from_the_labels_of_its_own_input(spark, tmp_path):
    """The labels of documents that an earlier stage dropped have the smallest hashes and are far more than the bound."""
    ids = [r["id"] for r in spark.range(8000).orderBy("id").selectExpr("id", "xxhash64(id) h").orderBy("h").collect()]
    mine = ids[-400:]
    rng = np.random.default_rng(4)
    bad = {i for k, i in enumerate(mine) if k % 5 == 0}
    good_words, bad_words = ["river", "stone", "walked", "morning", "letter"], ["BUY", "$$$", "click", "###", "WIN"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(bad_words if i in bad else good_words, 60))) for i in mine], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.classifier_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == set(mine) - bad
