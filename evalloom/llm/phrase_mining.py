"""Phrase collocations per language, counted by double-array tries.

Levels follow Apriori: a phrase of k + 1 words is looked at only where both phrases of k
words in it are frequent.  Which are is told by a bit table of fixed size that every
task holds (a bit set by chance lets a phrase in, none is lost), and tasks add up what they
meet, so that only phrases that reach the bound enter a trie.  Candidates of one length
are dealt by hash to shards of at most some ``PER_SHARD`` phrases; a shard is a double-array
trie over (language, word, word, ...), made in the task that counts by it.  One pass over the texts
adds up, in each task, the phrases that another bit table says may be candidates and
sends them to their shard, where numpy advances the states of all of them together, one word
a level, and adds their counts at the accepting states.

Bounds hold at every size: bit tables ``BITS``, phrases of one trie ``PER_SHARD``, and
``HELD`` different phrases that a task holds before it hands them on.  More frequent phrases
mean more shards, neither more passes over the texts nor larger tables, and no trie travels.  Words are equal when their 64-bit hashes are.

Cases: a null text is empty, a null language ``und``; repeated rows count each;
documents of any length are read in pieces at row ends; an empty table gives no rows;
columns besides ``text`` and ``lang`` are ignored.  Languages are told apart by 64-bit hashes too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.common import cut_lineage
from evalloom.llm.text import LOWER, STEP, Words, mix, pieces, running, span_hash

BITS, PER_SHARD, HELD = 1 << 26, 600_000, 400_000
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
PHRASE_WORD = ~BREAK
PHRASE_WORD[[0x20, 0x09]] = False


class Corpus:
    """The words of one piece of text: ``hashes``, ``lang`` (the hash of each word's language), and whether the ``next`` word belongs to the same phrase."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        self.words = Words(data, offsets, PHRASE_WORD)
        self.hashes = span_hash(running(data), self.words.starts, self.words.ends)
        self.langs, at = np.unique(rows.column(rows.schema.get_field_index("lh")).to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
        self.at_lang = at[self.words.row]
        self.lang = self.langs[self.at_lang]
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(BREAK[data], out=breaks[1:])
        self.next = np.zeros(len(self.hashes), bool)
        if len(self.hashes) > 1:
            self.next[:-1] = (breaks[self.words.starts[1:]] == breaks[self.words.ends[:-1]]) & (self.words.row[1:] == self.words.row[:-1])

    def string(self, i: int) -> str:
        return self.words.data[self.words.starts[i] : self.words.ends[i]].tobytes().decode("utf-8", "replace")


def phrase_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    out = lang
    for w in words:
        out = mix(out * STEP + w)
    return out


def languages(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lh"))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("und"))).alias("lh"))


class Tally:
    """Counts of keys (lang, word hashes...) met by a task, handed on when ``HELD`` are held."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, lang: np.ndarray, words: list[np.ndarray]) -> None:
        self._put(np.stack([lang, *words]), np.ones(len(lang), np.int64))

    def _put(self, keys: np.ndarray, n: np.ndarray) -> None:
        if not keys.shape[1]:
            return
        named = phrase_hash(keys[0], list(keys[1:]))
        _, first, back = np.unique(named, return_index=True, return_inverse=True)
        self.parts.append((keys[:, first], np.bincount(back, n, len(first)).astype(np.int64)))
        self.size += len(first)

    def rows(self, all_of_it: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts and (all_of_it or self.size > HELD):
            keys, n = (np.concatenate([p[i] for p in self.parts], axis=-1) for i in (0, 1))
            self.parts, self.size = [], 0
            self._put(keys, n)
            if all_of_it or self.size > HELD // 2:  # else most were repeats: go on gathering
                yield self.parts[0]
                self.parts, self.size = [], 0


def _rows(keys: np.ndarray, n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(k).view(np.int64)) for k in keys], pa.array(n)], names)


def count_words(docs: DataFrame) -> DataFrame:
    """(lh, h1, f): every word of every language."""

    def run(batches):
        tally = Tally(2)
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                piece = Corpus(rows, data, offsets)
                tally.add(piece.lang, [piece.hashes])
                for keys, n in tally.rows():
                    yield _rows(keys, n, ["lh", "h1", "f"])
        for keys, n in tally.rows(True):
            yield _rows(keys, n, ["lh", "h1", "f"])

    return texts(docs).mapInArrow(run, "lh bigint, h1 bigint, f bigint").groupBy("lh", "h1").agg(F.sum("f").alias("f"))


def spelled(docs: DataFrame, table) -> DataFrame:
    """(h, word): the strings of the words that are set in the broadcast ``table``, and perhaps some more."""

    def run(batches):
        held: dict[int, str] = {}
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                piece = Corpus(rows, data, offsets)
                hashes, first = np.unique(piece.hashes, return_index=True)
                for h, i in _set_ones(hashes, first, table.value):
                    if h not in held:
                        held[h] = piece.string(i)
                if len(held) > HELD // 2:
                    yield listed(held)
                    held = {}
        yield listed(held)

    def listed(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.fromiter(held, np.uint64, len(held)).view(np.int64)), pa.array(held.values(), pa.string())], ["h", "word"])

    return texts(docs).mapInArrow(run, "h bigint, word string").distinct()


def _set_ones(hashes: np.ndarray, first: np.ndarray, table: np.ndarray):
    on = is_set(table, hashes)
    return zip(hashes[on].tolist(), first[on].tolist(), strict=True)


def bit_table(frequent: DataFrame, columns: list[str], bits: int = BITS) -> np.ndarray:
    """A packed table of ``bits`` bits with the bit of each phrase's hash set.

    Tasks set the bits of the slices that their phrases fall into; a slice is 8 KB, so the
    driver gets the table's own size, whatever the number of phrases.
    """
    slice_bits = 1 << 16

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            first, *words = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            at = np.unique(phrase_hash(first, words) % np.uint64(bits)).astype(np.int64)
            for k, part in zip(*_runs(at // slice_bits, at % slice_bits), strict=True):
                held.setdefault(int(k), np.zeros(slice_bits, bool))[part] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["slice", "set"])

    def join(batches):
        at, have = None, None
        for batch in batches:
            out = []
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != at:
                    if have is not None:
                        out.append((at, have.tobytes()))
                    at, have = k, np.zeros(slice_bits // 8, np.uint8)
                have |= np.frombuffer(part, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["slice", "set"])
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([have.tobytes()], pa.binary())], ["slice", "set"])

    kind = "slice bigint, set binary"
    got = frequent.select(*columns).mapInArrow(run, kind).repartition("slice").sortWithinPartitions("slice").mapInArrow(join, kind)
    table = np.zeros(bits // 8, np.uint8)
    for row in got.toLocalIterator():
        table[row["slice"] * slice_bits // 8 : (row["slice"] + 1) * slice_bits // 8] = np.frombuffer(row["set"], np.uint8)
    return table


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted keys and the values of each."""
    if not len(keys):
        return keys, []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.r_[0, cuts]], np.split(values, cuts)


def is_set(table: np.ndarray, named: np.ndarray) -> np.ndarray:
    at = (named % np.uint64(len(table) * 8)).astype(np.int64)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


class DoubleArray:
    """A trie of phrases (language, word, ...) as ``base`` and ``check``.

    The hashes that occur are numbered, and a number is spelled in as many bytes as the
    largest one needs, so a node has at most 256 children and state s has one for byte c
    where ``check[base[s] + c] == s``.  Nodes with many children are placed first, at a
    tried base whose cells are free or else behind all others; the nodes with one child,
    most of them, then fill the cells that are left, all at once.
    """

    def __init__(self, phrases: np.ndarray):
        """``phrases``: one row of uint64 hashes for each phrase, language first, all of one length, no row twice."""
        self.symbols, coded = np.unique(phrases, return_inverse=True)
        coded = coded.reshape(phrases.shape)
        self.shifts = [8 * j for j in reversed(range(max(1, (max(len(self.symbols) - 1, 1).bit_length() + 7) // 8)))]
        order = np.lexsort(coded.T[::-1])
        count = len(coded)
        # nodes of a level are the distinct beginnings of that many bytes; number 0 is the root
        parents, spelled, nodes = [], [], 1
        above = np.zeros(count, np.int64)
        for number in coded[order].T:
            for shift in self.shifts:
                byte = number >> shift & 255
                fresh = np.r_[np.ones(min(count, 1), bool), (np.diff(above) != 0) | (np.diff(byte) != 0)]
                parents.append(above[fresh])
                spelled.append(byte[fresh])
                above = np.cumsum(fresh) - 1 + nodes
                nodes += int(fresh.sum())
        parent, byte = np.concatenate(parents), np.concatenate(spelled)
        slot = self._place(parent, byte)
        cell = np.r_[0, slot]  # of each node; the root has cell 0
        self.base = np.zeros(self.size, np.int32)
        self.check = np.full(self.size, -1, np.int32)
        self.check[slot] = cell[parent]
        self.base[cell[parent]] = slot - byte
        self.accepting = np.full(self.size, -1, np.int32)
        self.accepting[cell[above]] = order
        self.count = count

    def _place(self, parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The cell of each node but the root, whose siblings (neighbours here) stand at base + byte."""
        begins = np.r_[np.zeros(min(len(parent), 1), np.int64), np.flatnonzero(np.diff(parent)) + 1]
        sizes = np.diff(np.r_[begins, len(parent)])
        taken = np.zeros(2 * len(parent) + 2048, bool)
        taken[0] = True
        end = int(sizes[sizes > 1].sum()) + 512  # bases are tried below it; it moves on where none is free
        slot = np.zeros(len(parent), np.int64)
        rng = np.random.default_rng(7)
        many = np.flatnonzero(sizes > 1)
        for f in many[np.argsort(-sizes[many], kind="stable")]:
            own = byte[begins[f] : begins[f] + sizes[f]]
            tried = rng.integers(1, end, 96) - own[0]
            free = ~taken[tried[:, None] + own].any(1)
            if free.any():
                base = int(tried[free.argmax()])
            else:
                end += 256  # beyond the last cell that a tried base has reached
                base = end - int(own[0])
            if end + 768 > len(taken):
                taken = np.r_[taken, np.zeros(len(taken), bool)]
            taken[base + own] = True
            slot[begins[f] : begins[f] + sizes[f]] = base + own
        single = begins[sizes == 1]
        gaps = np.flatnonzero(~taken)
        if len(gaps) < len(single):
            gaps = np.r_[gaps, len(taken) + np.arange(len(single) - len(gaps))]
        slot[single] = gaps[: len(single)]
        self.size = max(int(slot.max()), 0) + 1 if len(slot) else 1
        return slot

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, hashes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == hashes, at, -1)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        to = self.base[state].astype(np.int64) + byte
        to[(to < 1) | (to >= self.size)] = 0
        return np.where(self.check[to] == state, to, -1)

    def advance(self, langs: np.ndarray, lang: np.ndarray, words: np.ndarray, follows: np.ndarray, depth: int) -> np.ndarray:
        """The phrase (row number) of ``depth`` words that begins at each position, or -1.

        ``langs[lang]`` is the language of a position; ``follows`` says whether the next word belongs to the same piece.
        """
        out = np.full(len(words), -1, np.int64)
        if not self.count or not len(words):
            return out
        numbers = self._numbers(words)
        roots = self._numbers(langs)
        at_lang = np.where(roots >= 0, 0, -1)
        for shift in self.shifts:
            at_lang = np.where(at_lang >= 0, self._step(np.maximum(at_lang, 0), roots >> shift & 255), -1)
        place = np.arange(len(words))
        state = at_lang[lang]
        for k in range(depth):
            on = (state >= 0) & (follows[place + k - 1] if k else True)
            place, state = place[on], state[on]
            number = numbers[place + k]
            for shift in self.shifts:
                on = (state >= 0) & (number >= 0)
                place, state, number = place[on], state[on], number[on]
                state = self._step(state, number >> shift & 255)
        done = state >= 0
        out[place[done]] = self.accepting[state[done]]
        return out


def _columns(depth: int) -> list[str]:
    return ["lh", *[f"h{i + 1}" for i in range(depth)]]


def met(docs: DataFrame, depth: int, wanted) -> DataFrame:
    """(lh, h1.., n): phrases of ``depth`` words that ``wanted(lang, words)`` lets in, added up by the tasks that meet them."""
    names = _columns(depth)

    def run(batches):
        tally = Tally(depth + 1)
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                piece = Corpus(rows, data, offsets)
                if not len(piece.hashes):
                    continue
                tongue = piece.lang
                n = len(piece.hashes) - depth + 1
                if n < 1:
                    continue
                shift = [piece.hashes[k : k + n] for k in range(depth)]
                whole = np.ones(n, bool)
                for k in range(depth - 1):
                    whole &= piece.next[k : k + n]
                at = np.flatnonzero(whole)
                at = at[wanted(tongue[at], [s[at] for s in shift])]
                tally.add(tongue[at], [s[at] for s in shift])
                for keys, seen in tally.rows():
                    yield _rows(keys, seen, [*names, "n"])
        for keys, seen in tally.rows(True):
            yield _rows(keys, seen, [*names, "n"])

    return texts(docs).mapInArrow(run, ", ".join(f"{n} bigint" for n in [*names, "n"]))


def longer(docs: DataFrame, table, depth: int, least: int) -> DataFrame:
    """Phrases of ``depth`` words, (lh, h1.., seen), both of whose parts are set in the broadcast ``table`` and that are met ``least`` times."""

    def wanted(lang, words):
        on = is_set(table.value, phrase_hash(lang, words[:-1]))
        on[on] = is_set(table.value, phrase_hash(lang[on], [w[on] for w in words[1:]]))
        return on

    return met(docs, depth, wanted).groupBy(*_columns(depth)).agg(F.sum("n").alias("seen")).filter(F.col("seen") >= least)


def count_phrases(docs: DataFrame, candidates: DataFrame, depth: int, per_shard: int = PER_SHARD, bits: int = BITS) -> DataFrame:
    """(lh, h1.., f) of the written ``candidates``, by one pass over the texts however many they are.

    Candidates and the phrases that may be candidates by the bit table go to their shard by hash;
    its task makes the trie of its candidates, some ``per_shard`` at most, and walks all phrases through it.
    """
    spark = docs.sparkSession
    names = _columns(depth)
    least_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shards = max(least_shards, -(-candidates.count() // per_shard))
    table = spark.sparkContext.broadcast(bit_table(candidates, names, bits))

    def run(batches):
        held, trie, keys, total = [], None, None, None
        for batch in batches:
            *phrase, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            phrase = np.stack(phrase, axis=1).view(np.uint64)
            own = int(np.searchsorted(n, 1))  # candidates come first, with 0
            if own:
                held.append(phrase[:own])
            if own == len(n) or not held:
                continue
            if trie is None:
                keys = np.concatenate(held)
                trie, total = DoubleArray(keys), np.zeros(len(keys), np.int64)
            phrase, n = phrase[own:], n[own:]
            langs, lang = np.unique(phrase[:, 0], return_inverse=True)
            follows = np.tile(np.arange(depth) < depth - 1, len(phrase))
            got = trie.advance(langs, np.repeat(lang, depth), phrase[:, 1:].reshape(-1), follows, depth)[::depth]
            np.add.at(total, got[got >= 0], n[got >= 0])
        if trie is not None:
            yield _rows(keys[total > 0].T, total[total > 0], [*names, "f"])

    seen = met(docs, depth, lambda lang, words: is_set(table.value, phrase_hash(lang, words)))
    both = candidates.select(*names, F.lit(0).cast("bigint").alias("n")).unionByName(seen)
    counted = both.repartition(shards, *names).sortWithinPartitions("n").mapInArrow(run, ", ".join(f"{n} bigint" for n in [*names, "f"]))
    counted = cut_lineage(counted, "phrases")
    table.destroy()
    return counted


def first_rows(rows: DataFrame, key: str, order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each key with their ``rank`` from 1.

    Rows are sorted over all tasks; a rank is the place in a part of that order plus the
    rows of the key in the parts before.
    """
    whole = [F.asc(key), *order]
    ordered = cut_lineage(rows.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("part", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy(key, "part").agg(F.count(F.lit(1)).alias("here"))
    ahead = F.coalesce(F.sum("here").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # only a key's first parts can hold its first rows
    sizes = sizes.select(key, "part", ahead.alias("ahead")).filter(F.col("ahead") < top)
    local = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))
    ranked = ordered.join(sizes, [key, "part"]).withColumn("rank", (F.col("ahead") + local).cast("bigint"))
    return ranked.filter(F.col("rank") <= top).drop("part", "ahead")


def score_phrases(frequent: DataFrame, two: DataFrame, three: DataFrame, share: int) -> DataFrame:
    """(lh, h1, h2, h3, a, l, r, score) of the phrases that no longer one tells; ``h3`` is null for two words."""
    word = lambda i: frequent.select("lh", F.col("h1").alias(f"h{i}"), F.col("f").alias(f"f{i}"))

    def score(left: str, right: str):
        return F.expr(f"(CAST(f AS DECIMAL(14,0)) * CAST(f AS DECIMAL(14,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST({left} AS DECIMAL(14,0)) * CAST({right} AS DECIMAL(14,0)))")

    holds = three.select("lh", "h1", "h2", "f").unionByName(three.select("lh", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f"))
    holds = holds.groupBy("lh", "h1", "h2").agg(F.max("f").alias("inside"))
    told = two.join(holds, ["lh", "h1", "h2"], "left").filter(F.coalesce(100 * F.col("inside") < share * F.col("f"), F.lit(True)))
    short = told.join(word(1), ["lh", "h1"]).join(word(2), ["lh", "h2"])
    short = short.select("lh", "h1", "h2", F.lit(None).cast("bigint").alias("h3"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    full = three.join(word(1), ["lh", "h1"]).join(word(3), ["lh", "h3"])
    full = full.join(two.select("lh", "h1", "h2", F.col("f").alias("f12")), ["lh", "h1", "h2"]).join(two.select("lh", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("f23")), ["lh", "h2", "h3"])
    full = full.withColumn("c1", score("f1", "f23")).withColumn("c2", score("f12", "f3")).withColumn("first", F.col("c1") <= F.col("c2"))
    full = full.select("lh", "h1", "h2", "h3", F.col("f").alias("a"), F.when(F.col("first"), F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(F.col("first"), F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("c1", "c2").alias("score"))
    return short.unionByName(full)


def mine_phrases(docs: DataFrame, least: int = 10, share: int = 50, per_shard: int = PER_SHARD, bits: int = BITS, top: int | None = None) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 and 3 words that are frequent and not told by a longer one.

    ``score`` is floor(1000000 * a * a / (l * r)) of the cut with the lowest; a phrase goes where a candidate one word longer has
    at least ``share`` percent of its occurrences.  With ``top`` only phrases that reach the score and count of their language's
    ``top``-th are spelled out, ties included.
    """
    spark = docs.sparkSession
    words = cut_lineage(count_words(docs), "words")
    totals = words.groupBy("lh").agg(F.sum("f").alias("n")).join(languages(docs).distinct(), "lh")
    frequent = words.filter(F.col("f") >= least)
    ones = spark.sparkContext.broadcast(bit_table(frequent, ["lh", "h1"], bits))
    two = cut_lineage(longer(docs, ones, 2, least), "pairs")
    ones.destroy()
    two = count_phrases(docs, two, 2, per_shard, bits).filter(F.col("f") >= least)
    pairs = spark.sparkContext.broadcast(bit_table(two, ["lh", "h1", "h2"], bits))
    three = cut_lineage(longer(docs, pairs, 3, least), "triples")
    pairs.destroy()
    three = count_phrases(docs, three, 3, per_shard, bits).filter(F.col("f") >= least)

    scored = cut_lineage(score_phrases(frequent, two, three, share), "scored")
    if top is not None:
        last = first_rows(scored, "lh", [F.desc("score"), F.desc("a")], top).groupBy("lh").agg(F.min(F.struct("score", "a")).alias("last"))
        scored = cut_lineage(scored.join(last, "lh").filter(F.struct("score", "a") >= F.col("last")).drop("last"), "first")
    parts = F.explode(F.array_compact(F.array("h1", "h2", "h3")))
    wanted = spark.sparkContext.broadcast(bit_table(scored.select(parts.alias("h")).distinct(), ["h"], bits))
    strings = cut_lineage(spelled(docs, wanted), "strings")
    wanted.destroy()
    word = lambda i: strings.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"))
    named = scored.join(word(1), "h1").join(word(2), "h2").join(word(3), "h3", "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    return named.join(totals, "lh").select("lang", "phrase", "a", "l", "r", "n", "score")


def best_phrases(docs: DataFrame, top: int = 2000, **bounds) -> DataFrame:
    """Each language's first ``top`` phrases by score, occurrences and text."""
    found = mine_phrases(docs, top=top, **bounds)
    return first_rows(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
