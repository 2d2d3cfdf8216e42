"""License scans by an exact set-similarity join.

Blocks are the lines of a text and, as notices are wrapped, every run of words over
more than one line that is as long as a template or up to 1 / threshold of it.  Tokens are ordered by how many documents of the
whole corpus hold them, rarest first.  A template of n tokens meets threshold c in
a block if at least o = ceil(c*n) of its tokens are there; then one of its first
n-o+1 tokens is there too (prefix filter), the block has o tokens (length
filter), and enough tokens follow the first common one (positional filter).
Survivors are counted exactly, so no block is missed and none is invented.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, words_of

# Phrases of the base scan, and notices as their licenses word them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
#: Share of a template's distinct tokens that a block must hold.
CONTAINMENT = 0.9


def token_frequencies(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents of the corpus each template token occurs.  The result has the size of the templates."""
    wanted = frozenset(vocabulary)

    def count(batches):
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in wanted.intersection(words_of(t)):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class Index:
    """Templates in global token order with the inverted list of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.items, self.spans, self.prefix = [], [], defaultdict(list)
        self.rank: dict[bytes, tuple[int, bytes]] = {}
        for label, text in templates:
            tokens = sorted(set(words_of(text)), key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            k = len(self.items)
            self.items.append((label, tokens, need, frozenset(tokens)))
            self.spans.append(math.ceil(len(words_of(text)) / threshold - 1e-9))
            for w in tokens:
                self.rank[w] = (frequency.get(w, 0), w)
            for at, w in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix[w].append((k, at))
        self.keys = frozenset(self.prefix)

    def met(self, block: frozenset) -> dict[int, float]:
        """Containment by number of the templates that the block meets."""
        hits = self.keys & block
        if not hits:
            return {}
        own = sorted(block & self.rank.keys(), key=self.rank.__getitem__)
        met: dict[int, float] = {}
        tried = set()
        for j, w in enumerate(own):
            for k, at in self.prefix.get(w, ()):
                _, tokens, need, as_set = self.items[k]
                if k in tried or len(block) < need:
                    continue
                tried.add(k)  # w is their first common token: own is in global order
                if 1 + min(len(tokens) - at - 1, len(own) - j - 1) < need:
                    continue
                if (n := len(as_set & block)) >= need:
                    met[k] = n / len(tokens)
        return met

    def runs(self, words: list[bytes], k: int) -> list[tuple[float, int, int]]:
        """Where template k is met by as many words as its length allows: (containment, first word, end), the best of those that overlap."""
        _, tokens, need, as_set = self.items[k]
        held: dict[bytes, int] = defaultdict(int)
        at = [i for i, w in enumerate(words) if w in as_set]
        found: list[tuple[float, int, int]] = []
        head = 0
        for i in at:
            held[words[i]] += 1
            while at[head] <= i - self.spans[k] or held[words[at[head]]] > 1:
                if not (left := held[words[at[head]]] - 1):
                    del held[words[at[head]]]
                else:
                    held[words[at[head]]] = left
                head += 1
            if (n := len(held)) >= need:
                one = (n / len(tokens), at[head], i + 1)
                if found and one[1] < found[-1][2]:
                    found[-1] = max(found[-1], one, key=lambda x: x[0])
                else:
                    found.append(one)
        return found

    def matches(self, lines: list[list[bytes]]) -> list[tuple[int, str, float, bool]]:
        """(line, label, containment, inner) of every block that meets a template, by the line it begins in.

        Inner is what is only met as part of a larger template that is met in the same place.
        """
        words = [w for line in lines for w in line]
        possible = self.met(frozenset(words))
        if not possible:
            return []
        line_of = [n for n, line in enumerate(lines) for _ in line]
        first, blocks = 0, []  # (template, first word, end, containment)
        for line in lines:
            blocks += [(k, first, first + len(line), c) for k, c in self.met(frozenset(line)).items()]
            first += len(line)
        in_lines = list(blocks)
        for k in possible:
            for c, a, b in self.runs(words, k):
                # what one line holds is found in that line
                if line_of[a] != line_of[b - 1] and not any(k == x and a < to and at < b for x, at, to, _ in in_lines):
                    blocks.append((k, a, b, c))
        found: dict[tuple[int, str], tuple[bool, float]] = {}
        for k, a, b, c in blocks:
            inner = any(self.items[k][3] < self.items[x][3] and a < to and at < b for x, at, to, _ in blocks)
            key = (line_of[a], self.items[k][0])
            # what is met on its own counts before what is part of another template
            found[key] = max(found.get(key, (False, 0.0)), (not inner, c))
        return [(n, label, c, not own) for (n, label), (own, c) in sorted(found.items())]


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, phrases=PHRASES, threshold: float = CONTAINMENT) -> DataFrame:
    """Find license phrases and every line or run of words over lines that meets a license template.

    Returns one row per input row: key, n_words, n_base, first_word, last_word,
    base_labels, labels, score, blocks (number of the first line, label, containment, inner).  Every
    block that meets a template is among the blocks; ``labels`` leaves out those that are only inner to
    another one, as a text under CC BY-SA is not one under CC BY.  Null and
    empty texts have no words; repeated rows repeat; texts of any length are scanned whole; an empty
    table gives no rows; other columns are left out.
    """
    small_batches(docs.sparkSession)
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    index = Index(templates, token_frequencies(docs, vocabulary, text), threshold)
    wanted = [(words_of(p), label) for p, label in phrases.items()]
    lasts = {p[-1] for p, _ in wanted}
    block_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("inner", pa.bool_())]))

    def one(t: str | None) -> tuple:
        words = words_of(t)
        if index.keys.isdisjoint(words) and lasts.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, []
        starts, base = [], set()
        for phrase, label in wanted:
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    starts.append(at)
                    base.add(label)
        found = index.matches([words_of(line) for line in (t or "").split("\n")])
        blocks = [{"line": n, "label": label, "containment": c, "inner": inner} for n, label, c, inner in found]
        score = 1.0 if starts else max((b["containment"] for b in blocks), default=0.0)
        labels = base | {b["label"] for b in blocks if not b["inner"]}
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), block_type]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(batches):
        for batch in batches:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, *names])

    chosen = docs.select(docs[key], docs[text])
    return chosen.mapInArrow(
        run,
        f"`{key}` {dict(chosen.dtypes)[key]}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "blocks array<struct<line:bigint,label:string,containment:double,inner:boolean>>",
    )
