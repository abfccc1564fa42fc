"""Groups of near copies cost rows in proportion to their size; a sampler that forgets units gives the same ids."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from evalloom.llm import anchors, minhash
from evalloom.llm.piece_sampling import Pieces, Sampler


def near_copies(n, seed=5):
    rng = random.Random(seed)
    base = [str(rng.random()) for _ in range(100)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(100), rng.randint(0, 5)):
            words[at] = str(rng.random())
        rows.append((i, " ".join(words)))
    return rows


def test_rows_follow_the_size_of_a_group(spark, monkeypatch):
    made = {}
    write = minhash.cut_lineage

    def counted(df, purpose):
        out = write(df, purpose)
        made[purpose] = made.get(purpose, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "cut_lineage", counted)
    monkeypatch.setattr(minhash, "BLOCK", 256)
    for n in (200, 800):
        made.clear()
        rows = near_copies(n)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for _, t in rows]
        parts = list(range(n))
        for a in range(n):
            for b in range(a):
                if parts[a] != parts[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low, high = sorted((parts[a], parts[b]))
                    parts = [low if p == high else p for p in parts]
        assert got == dict(enumerate(parts))
        # a few of the 25 bands of a class, however many classes share them
        assert made["near-pairs"] + made["near-rows"] + made["links"] <= 5 * n


def test_forgotten_units_give_the_same_ids():
    vocabulary = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgñ語🙂") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    whole, bounds = Sampler(vocabulary).sample(np.arange(60), texts)
    small = Sampler(vocabulary, kept=40)
    for i, text in enumerate(texts):
        ids, _ = small.sample(np.array([i]), [text])
        assert ids.tolist() == whole[bounds[i] : bounds[i + 1]].tolist()
    assert len(small.known) == small.uses.n == small.length.n <= 40 + 60


def test_shards_are_dealt_once_and_copies_merged_before(spark):
    """Contents travel once: one exchange, before which copies are one row with their count."""
    rows = [(bytes([i % 7]) * 16, i % 3, bytes([i % 7]) if i < 100 else None, i) for i in range(1000)]
    found = spark.createDataFrame(rows, "digest binary, name bigint, content binary, doc_id bigint").coalesce(1)
    want = {}
    for digest, name, content, doc in rows:
        n, low = want.get((digest, name), (0, doc))
        want[digest, name] = (n + 1, min(low, doc))

    def solve(bodies, copies, lows):
        return range(len(bodies)), pa.array(bodies, pa.binary()), pa.array(copies), pa.array(lows)

    shards = anchors.by_shard(found, solve, "digest binary, content binary, copies bigint, low bigint")
    assert shards._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = shards.collect()
    assert all(r.content == r.digest[:1] for r in got)
    assert sorted((bytes(r.digest), r.copies, r.low) for r in got) == sorted((d, *v) for (d, _), v in want.items())
    merged = pa.Table.from_batches(anchors._merge_copies([pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], ["digest", "name", "content", "doc_id"])]))
    assert merged.num_rows == 21
