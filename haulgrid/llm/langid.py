"""Language of whole texts and of spans in them.

The letters' script narrows each word's candidates to the languages that use it. Each word has a score for each
candidate, from counts of its trigrams of bytes and of the word itself in the learning texts. Viterbi over the words,
with a penalty for each change of language, labels spans; a text's language is the one that holds most letters.

Most texts have one language throughout, which can be shown without Viterbi: if against that language no other
gains as much as the penalty on any stretch of words, no path with changes can win. Only other texts run it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.scratch import Scratch, in_arrow
from haulgrid.llm.textbytes import LOWER, U64, chunks, word_hashes, words

BUCKETS = 1 << 16
#: Log-odds that a change of language costs, and most that one word can tell.
SWITCH, CLIP = 20.0, 12.0
#: Languages that are learned at most, those with the most learning texts; languages that a task counts before it hands them on.
LANGS, HELD = 256, 32
#: A script is a language's if so many of its words are written in it.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"

#: Scripts by the first byte of UTF-8 (ranges of 64 code points for two bytes, 4096 for three).
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "southeast", "kana", "han", "hangul", "other")
_SCRIPT = np.zeros(256, np.int8)
_SCRIPT[0xC3:0xCA] = 1
_SCRIPT[0xCD:0xD0] = 2
_SCRIPT[0xD0:0xD5] = 3
_SCRIPT[0xD6:0xD8] = 4
_SCRIPT[0xD8:0xDD] = 5
_SCRIPT[0xE0] = 6
_SCRIPT[0xE1] = 7
_SCRIPT[0xE3] = 8
_SCRIPT[0xE4:0xEA] = 9
_SCRIPT[0xEA:0xEE] = 10
_SCRIPT[0xF0:0xF5] = 11

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xE2] = _LETTER[0xE3:0xEF] = _LETTER[0xF0:0xF5] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Letter bytes: ASCII letters, and sequences whose first byte is in a range of letters."""
    if not len(data) or data.max() < 0x80:
        return _LETTER[data]
    lead = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, np.arange(len(data))))
    out = _LETTER[data[lead]]
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # × and ÷
    out[signs] = out[signs + 1] = False
    return out


def features(data: np.ndarray, offsets: np.ndarray):
    """Trigram buckets of all letters, each word's first letter among them, word buckets, scripts, lengths, and words' offsets."""
    starts, ends, at = words(_letters(data), offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, at
    low = LOWER[data].copy()
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    low[accent] += 32
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)
    b = low[place].astype(np.int64)
    left, right = np.concatenate([[0], b[:-1]]), np.concatenate([b[1:], [0]])
    left[first] = 0
    right[first + lengths - 1] = 0
    grams = ((left * 0x1F35 + b) * 0x2F0B + right * 0x61C9 + (b << 7)) % 65521
    script = np.maximum(np.maximum.reduceat(_SCRIPT[data[place]], first).astype(np.int64) - 1, 0)
    spelt = (word_hashes(low, starts, ends) >> U64(48)).astype(np.int64)
    return grams, first, spelt, script, lengths, at


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and their log-probabilities of trigrams, words and scripts, from all rows with a text and a lang.

    The driver receives one number for each language and bucket, of LANGS languages at most (512 KB each): a bound that does
    not grow with the documents, however many labels they have. Empty tables, and such without a lang, give no language.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = sorted(r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect())
    size = 2 * BUCKETS + len(SCRIPTS)

    def run(batches):
        number = {x: k for k, x in enumerate(langs)}
        held: dict[int, np.ndarray] = {}

        def counted():
            for k, total in held.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(k * size + some), pa.array(total[some])], ["cell", "n"])
            held.clear()

        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()])
            for i, j, data, offsets in chunks(batch.column(1)):
                grams, first, spelt, script, lengths, at = features(data, offsets)
                lang = np.repeat(own[i:j], np.diff(at))
                for k in np.unique(lang[lang >= 0]).tolist():
                    total = held.setdefault(k, np.zeros(size, np.int64))
                    for values, of in ((grams, np.repeat(lang, lengths)), (spelt + BUCKETS, lang), (script + 2 * BUCKETS, lang)):
                        total += np.bincount(values[of == k], minlength=size)
                if len(held) > HELD:
                    yield from counted()
        yield from counted()

    cells = known.transform(in_arrow, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = Scratch(docs.sparkSession, "lang").table(cells, "cells").toArrow()
    counts = np.zeros(max(1, len(langs)) * size)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(-1, size)

    def logs(part: np.ndarray) -> np.ndarray:
        out = np.log((part + 0.5) / (part.sum(axis=1, keepdims=True) + 0.5 * part.shape[1]))
        return np.ascontiguousarray((out - out.max(axis=0)).T.astype(np.float32))

    scripts = counts[:, 2 * BUCKETS :]
    uses = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE
    uses = uses | ~uses.any(axis=0)  # a script that no language uses tells nothing
    return langs, logs(counts[:, :BUCKETS]), logs(counts[:, BUCKETS : 2 * BUCKETS]), np.where(uses, 0, -CLIP).T.astype(np.float32)


def word_scores(parts, model) -> np.ndarray:
    """Words by languages: log-odds against the best language, CLIP at most."""
    grams, first, spelt, script, _, _ = parts
    _, trigram, word, scripts = model
    if not len(first):
        return np.zeros((0, trigram.shape[1]), np.float32)
    total = np.add.reduceat(trigram[grams], first, axis=0) + word[spelt] + scripts[script]
    total -= total.max(axis=1, keepdims=True)
    return np.maximum(total, -CLIP)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path; ties stay with the language before, then the lower number."""
    n, k = scores.shape
    best = scores[0].astype(np.float64)
    came = np.zeros((n, k), np.int32)
    own = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        change = best[top] - switch > best
        came[t] = np.where(change, top, own)
        best = np.where(change, best[top] - switch, best) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t][path[t]]
    return path


def label(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """As ``viterbi``; where no stretch gains half the penalty, the one best language without running it.

    A path of m + 1 stretches pays m penalties, and each stretch gains the most that any does over the best language.
    """
    total = scores.sum(axis=0, dtype=np.float64)
    top = int(total.argmax())
    gain = np.cumsum(scores.astype(np.float64) - scores[:, top : top + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
    if 2 * (gain - low).max() < switch:
        return np.full(len(scores), top)
    return viterbi(scores, switch)


def _predictions(texts, model, with_spans: bool):
    langs = model[0]
    for i, j, data, offsets in chunks(texts):
        parts = features(data, offsets)
        scores, lengths, at = word_scores(parts, model) if langs else None, parts[4], parts[5]
        for d in range(j - i):
            a, b = at[d], at[d + 1]
            if not langs or not any(ch.isalpha() for ch in _some(data, offsets, d)):
                yield UNKNOWN, 0.0, []
                continue
            if a == b:  # letters outside the ranges above
                yield langs[0], 0.0, []
                continue
            path = label(scores[a:b])
            held = np.bincount(path, weights=lengths[a:b], minlength=len(langs))
            top = int(held.argmax())
            spans = []
            if with_spans:
                cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), b - a]
                spans = [{"first_word": x, "words": y - x, "lang": langs[path[x]]} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield langs[top], float(held[top] / held.sum()), spans


def _some(data: np.ndarray, offsets: np.ndarray, d: int) -> str:
    """The text; only its start if that has an ASCII letter already."""
    head = data[offsets[d] : offsets[d + 1]]
    start = bytes(head[:64])
    return "a" if any(65 <= x <= 90 or 97 <= x <= 122 for x in start) else bytes(head).decode("utf-8", "ignore")


SPANS = "array<struct<first_word:long,words:long,lang:string>>"


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def detect(docs: DataFrame, model, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row; ``und``, 0 and no spans if the text is null or has no letters.

    score is the share of letters in spans of lang_pred; ties go to the first language by name. Without learned languages
    all are ``und``. Repeated rows are each returned; a null doc_id stays null; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            rows = list(zip(*_predictions(batch.column(1), held.value, with_spans), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.float64()), pa.array(rows[2], kind)], ["doc_id", "lang_pred", "score", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.transform(in_arrow, run, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the number of spans; learned from the documents that aren't held out."""
    model = learn(docs.where(~held_out()))
    return detect(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def in_a_language(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """``docs`` without the rows that are ``und``, or have no language with a share of ``least``.

    A null text has no language. Repeated rows are each judged, a null doc_id is kept like any other, an empty table stays
    empty, and all columns stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in _predictions(batch.column(at), held.value, False)], pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)
