"""License scans: a positional index of rare licence words.

Every template is indexed by its words with the highest inverse document
frequency over the whole corpus (one counting pass).  A file's occurrences of
indexed words vote for (template, start); a start with enough votes is compared
word by word and must hold the template's mandatory phrase.  Templates and the
index are a fixed table of this module, so they travel with the tasks.

Cases: a null or empty text has no words and no labels; a text that repeats a
phrase counts every place; rows without an id are left out; repeated rows each get
their row; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import keyed_texts
from evalloom.llm.text import LICENCE_WORD, LOWER, Words, ids_of, pieces, running, span_hash

# Base phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Label, template words, mandatory phrase.
TEMPLATES = [
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
VOCABULARY = sorted({w for phrase in [*BASE, *(t for _, t, _ in TEMPLATES), *(m for _, _, m in TEMPLATES)] for w in phrase.split()})
RARE, MATCH = 4, 0.6


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    split = Words(data, np.array([0, len(data)]), LICENCE_WORD)
    return split.hashes()


_HASHES = _hash_words(VOCABULARY)
_ORDER = np.argsort(_HASHES)
_CODE = {w: i for i, w in enumerate(VOCABULARY)}


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a piece as places in the vocabulary, -1 for all others."""
    words = Words(LOWER[data], offsets, LICENCE_WORD)
    hashes = span_hash(running(words.data), words.starts, words.ends)
    known = _HASHES[_ORDER]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return words, np.where(known[at] == hashes, _ORDER[at], -1)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Documents that hold each licence word (then: all documents), over the whole corpus."""

    def run(batches):
        total = np.zeros(len(VOCABULARY) + 1, np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch):
                words, codes = _codes(data, offsets)
                held = np.unique(words.row[codes >= 0] * len(VOCABULARY) + codes[codes >= 0])
                total[:-1] += np.bincount(held % len(VOCABULARY), minlength=len(VOCABULARY))
                total[-1] += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["code", "n"])

    out = np.zeros(len(VOCABULARY) + 1, np.int64)
    got = keyed_texts(docs).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


class Index:
    """Postings (template, place) of each template's rarest words."""

    def __init__(self, frequency: np.ndarray):
        idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1]))
        self.templates = [np.array([_CODE[w] for w in text.split()]) for _, text, _ in TEMPLATES]
        self.must = [np.array([_CODE[w] for w in phrase.split()]) for _, _, phrase in TEMPLATES]
        found = []
        for t, words in enumerate(self.templates):
            rare = sorted(set(words.tolist()), key=lambda c: (-idf[c], c))[:RARE]
            found += [(c, t, q) for q, c in enumerate(words.tolist()) if c in rare]
        found.sort()
        self.word, self.template, self.place = (np.array(x) for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.word, np.arange(len(VOCABULARY) + 1))
        self.postings = np.bincount(self.template, minlength=len(self.templates))

    def matches(self, words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, template and share of equal words of every verified place."""
        at = np.flatnonzero(codes >= 0)
        per = self.first[codes[at] + 1] - self.first[codes[at]]
        hit = np.repeat(at, per)
        posting = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.first[codes[at]], per)
        start = hit - self.place[posting]
        row, template = words.row[hit], self.template[posting]
        # a template may begin before the text: its words there count as missing
        key, votes = np.unique(np.stack([row, template, start]), axis=1, return_counts=True) if len(hit) else (np.zeros((3, 0), int), np.zeros(0, int))
        enough = votes >= np.maximum(1, np.ceil(MATCH * np.minimum(self.postings[key[1]], RARE)).astype(int))
        out = []
        for row, t, start in key[:, enough].T.tolist():
            low, high = int(words.bounds[row]), int(words.bounds[row + 1])
            text = self.templates[t]
            a, b = max(start, low), min(start + len(text), high)
            share = float((codes[a:b] == text[a - start : b - start]).sum()) / len(text)
            must = self.must[t]
            near = codes[a : min(b + 2, high)]
            whole = any((near[i : i + len(must)] == must).all() for i in range(len(near) - len(must) + 1))
            if share >= MATCH and whole:
                out.append((row, t, share))
        r, t, s = zip(*out, strict=True) if out else ((), (), ())
        return np.array(r, int), np.array(t, int), np.array(s, float)


def scan(docs: DataFrame, frequency: np.ndarray) -> DataFrame:
    base = [(np.array([_CODE[w] for w in phrase.split()]), label) for phrase, label in BASE.items()]

    def run(batches):
        index = Index(frequency)
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                words, codes = _codes(data, offsets)
                n = len(offsets) - 1
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                plain: list[set] = [set() for _ in range(n)]
                for phrase, label in base:
                    start = np.flatnonzero(codes == phrase[0])
                    for j, code in enumerate(phrase[1:].tolist(), 1):
                        start = start[start + j < len(codes)]
                        start = start[(codes[start + j] == code) & (words.row[start + j] == words.row[start])]
                    row, place = words.row[start], start - words.bounds[words.row[start]]
                    count += np.bincount(row, minlength=n)
                    np.minimum.at(first, row, place)
                    np.maximum.at(last, row, place)
                    for r in np.unique(row).tolist():
                        plain[r].add(label)
                labels = [set(x) for x in plain]
                score = np.where(count > 0, 0.5, 0.0)
                for r, t, share in zip(*index.matches(words, codes), strict=True):
                    labels[r].add(TEMPLATES[t][0])
                    score[r] = max(score[r], share)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids_of(rows)), pa.array(words.counts.astype(np.int64)), pa.array(count),
                        pa.array(first, mask=count == 0), pa.array(last, mask=count == 0),
                        pa.array([",".join(sorted(x)) for x in plain], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return keyed_texts(docs).mapInArrow(run, schema)


def license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs, document_frequency(docs))
