"""Language identification of mixed-language text.

Per-word scores come from byte n-grams counted by language over all training
texts, in tables of fixed size.  The script of a word narrows the languages that
it may have; Viterbi with a switching penalty then labels spans of words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS = 17
SLOTS = 1 << BITS
SCRIPTS = 16
#: Log-odds that a change of language between two words costs.
SWITCH = 6.0
#: A language is a candidate for a script if at least this share of its words have it.
SCRIPT_SHARE = 0.01
#: Characters that are labelled at once.
CHUNK = 2_000_000
LETTER = re.compile(r"[^\W\d_]")
_MARKS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _script_table() -> np.ndarray:
    """Script number by byte: what a UTF-8 lead byte tells, 0 for other bytes."""
    out = np.zeros(256, np.int8)
    ranges = [(0x61, 0x7A), (0xC3, 0xC9), (0xCE, 0xCF), (0xD0, 0xD3), (0xD4, 0xD5), (0xD6, 0xD7), (0xD8, 0xDB), (0xE0, 0xE0), (0xE1, 0xE1), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED), (0xF0, 0xF4)]
    for k, (a, b) in enumerate(ranges):
        out[a : b + 1] = 1 if k < 2 else k
    return out


_SCRIPT = _script_table()


def split_words(text: str) -> list[bytes]:
    """Lower-cased runs of letters; characters outside ASCII count as letters."""
    return text.lower().encode("utf-8", "replace").translate(_MARKS).split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: slots of their byte 2-, 3- and 4-grams (ends count as a byte), the word of each slot, and the words' scripts."""
    raw = np.frombuffer(b" " + b" ".join(words) + b"  ", np.uint8)
    blank = raw == 32
    word = np.cumsum(blank) - 1
    code = raw.astype(np.uint64)
    slots, owners = [], []
    for n in (2, 3, 4):
        last = len(raw) - n + 1
        gram = np.zeros(last, np.uint64)
        for i in range(n):
            gram = gram * np.uint64(257) + code[i : i + last] + np.uint64(1)
        inner = np.ones(last, bool)
        for i in range(1, n - 1):
            inner &= ~blank[i : i + last]
        if n == 2:
            inner = ~(blank[:last] & blank[1:])
        h = (gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        # a gram that begins with a blank belongs to the word after it, which is the word number there
        slots.append((h >> np.uint64(64 - BITS))[inner].astype(np.int64))
        owners.append(word[:last][inner])
    begins = np.flatnonzero(blank)[: len(words)]
    script = np.maximum.reduceat(_SCRIPT[raw], begins) if words else np.zeros(0, np.int8)
    return np.concatenate(slots), np.minimum(np.concatenate(owners), max(len(words) - 1, 0)), script


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Count n-grams and scripts by language over all rows with text and language.

    The counts per language have SLOTS + SCRIPTS entries at most, however large the
    corpus; they are summed and turned into scores in the executors, and the model has half a
    megabyte a language.  No labelled row: a model without languages, which predicts ``und``.
    Null texts and languages teach nothing; repeated rows count as often as they are there.
    """
    small_batches(labelled.sparkSession)

    def count(batches):
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(SLOTS + SCRIPTS))
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[l].update(split_words(t))
            for l, counter in words.items():
                if counter:
                    slot, owner, script = word_features(list(counter))
                    n = np.fromiter(counter.values(), np.float64, len(counter))
                    total[l][:SLOTS] += np.bincount(slot, n[owner], SLOTS)
                    total[l][SLOTS:] += np.bincount(script, n, SCRIPTS)
        for l, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "slot", "n"])

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).mapInArrow(count, "lang string, slot int, n double")
    summed = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(lambda t: _language(t), "lang string, score binary, allowed binary").collect()
    langs = sorted(r["lang"] for r in summed)
    score, allowed = np.zeros((len(langs), SLOTS), np.float32), np.zeros((len(langs), SCRIPTS), bool)
    for r in summed:
        k = langs.index(r["lang"])
        score[k], allowed[k] = np.frombuffer(r["score"], np.float32), np.frombuffer(r["allowed"], bool)
    return {"langs": langs, "score": score - score.mean(axis=0, keepdims=True) if langs else score, "allowed": allowed}


def _language(counts: pa.Table) -> pa.Table:
    """One language from its counts: log-likelihood by slot and whether it has a script, packed, so that the driver gets half a megabyte a language."""
    total = np.bincount(counts.column("slot").to_numpy(), counts.column("n").to_numpy(), SLOTS + SCRIPTS)
    grams = total[:SLOTS] + 0.5
    share = total[SLOTS:] / max(total[SLOTS:].sum(), 1)
    score = np.log(grams / grams.sum()).astype(np.float32)
    return pa.table({"lang": counts.column("lang")[:1], "score": pa.array([score.tobytes()], pa.binary()), "allowed": pa.array([(share >= SCRIPT_SHARE).tobytes()], pa.binary())})


def word_scores(words: list[bytes], model: dict) -> np.ndarray:
    """Log-likelihood of each distinct word by language, less the languages' mean."""
    slot, owner, script = word_features(words)
    out = np.stack([np.bincount(owner, s[slot], len(words)) for s in model["score"]], axis=1)
    fits = model["allowed"][:, script].T
    fits[~fits.any(axis=1)] = True
    return np.where(fits, out, -1e6)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word.  scores: words of all texts, one after the other; lengths: words by text."""
    texts = np.argsort(-lengths, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])[texts]
    lengths, n_lang = lengths[texts], scores.shape[1]
    back = np.zeros(scores.shape, np.int16)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    value = np.zeros((len(lengths), n_lang))
    own = np.arange(n_lang, dtype=np.int16)
    for t, a in enumerate(active):
        v = value[:a]
        best = v.argmax(axis=1)
        change = v[np.arange(a), best] - penalty
        stay = v >= change[:, None]
        at = offsets[:a] + t
        back[at] = np.where(stay, own, best[:, None])
        value[:a] = np.where(stay, v, change[:, None]) + scores[at]
    path = np.zeros(len(scores), np.int16)
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = offsets[:a] + t
        path[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return path


def identify(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id", penalty: float = SWITCH) -> DataFrame:
    """Label the language spans of every text and name the language with most letters.

    Returns one row per input row: key, lang_pred, score (share of the letters in
    lang_pred), spans (lang:first-last in words, comma-joined).  Null texts and
    texts without a letter are ``und`` with score 0; ties go to the language first
    in code-point order; repeated rows repeat; texts of any length are labelled whole; an empty
    table gives no rows; other columns are left out.
    """
    small_batches(docs.sparkSession)
    label = _labeller(model, penalty)

    def run(batches):
        for batch in batches:
            rows = label(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows])],
                names=[key, "lang_pred", "score", "spans"],
            )

    chosen = docs.select(docs[key], docs[text])
    return chosen.mapInArrow(run, f"`{key}` {dict(chosen.dtypes)[key]}, lang_pred string, score double, spans string")


def keep_identified(docs: DataFrame, model: dict, text: str = "text", least: float = 0.5, penalty: float = SWITCH) -> DataFrame:
    """The rows of docs whose text has a language for ``least`` of its letters.

    Null texts, texts without a letter and mixtures without such a language go; all
    columns stay, and repeated rows repeat.
    """
    small_batches(docs.sparkSession)
    label, at = _labeller(model, penalty), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            rows = label(batch.column(at).to_pylist())
            yield batch.filter(pa.array([r[0] != "und" and r[1] >= least for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _labeller(model: dict, penalty: float):
    langs = model["langs"]

    def label(texts: list[str | None]) -> list[tuple[str, float, str]]:
        """In pieces of about CHUNK characters; a longer text is a piece of its own."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= CHUNK:
                out += piece(part)
                part, size = [], 0
        return out + piece(part)

    def piece(texts: list[str | None]) -> list[tuple[str, float, str]]:
        number: dict[bytes, int] = {}
        split = [split_words(t) if t and LETTER.search(t) and langs else [] for t in texts]
        ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64)
        lengths = np.array([len(w) for w in split], np.int64)
        out = [("und", 0.0, "")] * len(texts)
        if not len(ids):
            return out
        distinct = list(number)
        path = viterbi(word_scores(distinct, model)[ids], lengths, penalty)
        letters = np.fromiter(map(len, distinct), np.float64, len(distinct))[ids]
        ends = np.cumsum(lengths)
        for k, (n, end) in enumerate(zip(lengths, ends)):
            if n:
                p = path[end - n : end]
                weight = np.bincount(p, letters[end - n : end], len(langs))
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [n]])
                spans = ",".join(f"{langs[p[a]]}:{a}-{b - 1}" for a, b in zip(cuts[:-1], cuts[1:]))
                out[k] = (langs[weight.argmax()], float(weight.max() / weight.sum()), spans)
        return out

    return label


def held_out(key: Column) -> Column:
    """The fold that the model never learns from.  A null key belongs to the training fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
