"""Documents scored by masked pseudo-likelihood: every word is predicted from the words on both of its sides.

A word is a token. Words belong to CLASSES by their last two bytes; the LEAVES - 1 most frequent words of each class are
leaves of their own (some 4,000 words), all rarer ones share leaf 0 and are spelt. With the WINDOW words before and after it

    log p(word | window) = log p(class | window) + log p(leaf | class, window) [+ log p(spelling | class), if leaf 0]

*Network.* The window's words are embedded, weighted by place and summed; of that a tanh layer feeds a softmax over the
classes and, for each class, one over its leaves. It is trained in numpy on every word of every document: in each of ROUNDS
rounds all tasks train a copy on their share of the documents, and the copies' means, weighted by words, go into the next.
What a task sends back is a model, so it doesn't grow with the documents.

*Spelling.* Rare words are spelt from the end, each byte after the two after it, by smoothed counts over all rare words of the
corpus. What is spelt is known to be in the class and no leaf, so the probabilities of a class's words, of all there can be, add
up to one.

*Memory.* A network of bounded size can't hold a corpus, so all sentences are counted. In one that occurs elsewhere, word for
word, each word is copied from there with a chance of a half (two thirds if there are two other places), else predicted.
The sentence's own occurrence is not counted. Counts of words and of sentences grow with the corpus; they stay in shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haulgrid.llm.scratch import Scratch, in_arrow
from haulgrid.llm.textbytes import _BASE, _BYTE_CODE, CHUNK_BYTES, LOWER, U64, chunks, mix, signed, word_hashes, words

CLASSES, LEAVES, HIDDEN = 64, 64, 24
#: Words seen on each side; the id of what lies beyond a text's borders.
WINDOW, BORDER = 2, 64 * 64
#: Places that are laid out together, with their surroundings; BATCH is a multiple.
RUN = 16
#: Passes of a model through the tasks, each over other documents; words of a step, at most; step size.
ROUNDS, BATCH, RATE = 3, 8192, 0.1
#: Words of a sentence that are remembered together; a longer one is cut, a shorter one than LEAST is not remembered.
LEAST, MOST = 4, 32
#: What the coarser distribution weighs in a spelling's.
SMOOTH = 4.0

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 58, 59, 63]] = True
#: Symbols of spellings: lower-case letters, digits and other bytes from 1 on; 0 is a word's border.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[np.flatnonzero(_LETTER[LOWER] & (LOWER == np.arange(256)))] = np.arange(1, 165)
SYMBOLS = 165
#: The symbol of each byte of a text; 0 where it is no letter.
_OF_BYTE = np.where(_LETTER, _SYMBOL[LOWER], 0).astype(np.int32)
#: Bytes handled at once where no order is shuffled, so that arrays stay in a core's cache.
NEAR = 1 << 18
#: Where the words of a window stand in a run, from the window's first.
_PLACES = [k for k in range(2 * WINDOW + 1) if k != WINDOW]


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK_BYTES + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_CODE, _POWER, _INVERSE = _BYTE_CODE[LOWER], _powers(int(_BASE)), _powers(pow(int(_BASE), -1, 1 << 64))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``word_hashes`` of the words in lower case, by running sums over all bytes; a longer text than a chunk goes there."""
    if len(data) > CHUNK_BYTES:
        return word_hashes(LOWER[data], starts, ends)
    sums = np.zeros(len(data) + 1, np.uint64)
    code = _CODE.take(data)
    code *= _POWER[: len(data)]
    np.cumsum(code, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: hash, ending (last two symbols), offsets of each text's words, sentence numbers, cells of spelling."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.at = words(_LETTER[data], offsets)
        self.hashes = _hashes(data, self.starts, self.ends)
        symbol = self.symbol = np.zeros(len(data) + 2, np.int32)
        np.take(_OF_BYTE, data, out=symbol[:-2], mode="clip")
        self.after = symbol[1:-1].copy()  # the byte after each, in its word
        borders = offsets[(offsets > 0) & (offsets < len(data))]
        self.after[borders - 1] = 0
        last, before = symbol[self.ends - 1], symbol[np.maximum(self.ends - 2, 0)]
        self.ending = last * SYMBOLS + np.where(self.ends - self.starts > 1, before, 0)
        self._data = data

    def sentences(self) -> np.ndarray:
        """The number of each word's sentence, or of its part of MOST words."""
        n = len(self.starts)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(self.starts, np.flatnonzero(_STOP[self._data]))] = True  # the word after each stop, if any
        first[self.at] = True
        begins = np.flatnonzero(first[:n])
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        return np.cumsum(place % MOST == 0) - 1

    def spellings(self) -> tuple[np.ndarray, np.ndarray]:
        """(second after, after, byte) of each byte as one number, and of each word's border before its first byte."""
        n = len(self.after)
        cells = np.zeros(n, np.int32)
        np.multiply(self.after[1:], self.after[:-1] > 0, out=cells[:-1])
        for symbol in (self.after, self.symbol[:n]):
            cells *= SYMBOLS
            cells += symbol
        long = self.ends - self.starts > 1
        fronts = (np.where(long, self.symbol[np.minimum(self.starts + 1, n)], 0) * SYMBOLS + self.symbol[self.starts]) * SYMBOLS
        return cells, fronts


def class_of(ending: np.ndarray) -> np.ndarray:
    return (mix(ending.astype(np.uint64) + U64(1)) % U64(CLASSES)).astype(np.int64)


def _listed(items: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join(items), np.uint8)
    return Words(data, np.array([0, len(data)]))


class Vocabulary:
    """Hashes of the words that are leaves, in order, and the id (class * LEAVES + leaf) of each."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        # Places by the first 16 bits of a hash: a list for each, of as many places as the longest has, else -1.
        heads = (self.hashes.view(U64) >> U64(48)).astype(np.int64)
        by = np.argsort(heads, kind="stable")
        nth = np.arange(len(by)) - np.searchsorted(heads[by], heads[by])
        self.lists = np.full((int(nth.max(initial=-1)) + 1, 1 << 16), -1, np.int32)
        self.lists[nth, heads[by]] = by

    def of(self, found: Words) -> np.ndarray:
        out = class_of(found.ending) * LEAVES
        hashes, heads = signed(found.hashes), (found.hashes >> U64(48)).astype(np.int64)
        for listed in self.lists:
            spot = listed[heads]
            at = np.flatnonzero(spot >= 0)
            at = at[self.hashes[spot[at]] == hashes[at]]
            out[at] = self.ids[spot[at]]
        return out


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All words in runs of RUN, each with the WINDOW ids before and after it (int16); BORDER between texts and at the end.

    The words stand in order in the runs' middles, so that the windows of a run are its own slices.
    """
    sizes = np.diff(at)
    text = np.repeat(np.arange(np.count_nonzero(sizes)), sizes[sizes > 0])
    spots = np.arange(len(ids)) + WINDOW * (text + 1)
    n = -(-(int(spots[-1]) + 1 - WINDOW) // RUN) if len(ids) else 0
    out = np.full(max(n, 1) * RUN + 2 * WINDOW, BORDER, np.int16)
    out[spots] = ids
    return np.lib.stride_tricks.sliding_window_view(out, RUN + 2 * WINDOW)[::RUN][:n]


# The network


def fresh(share: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Parameters (embeddings, weights by place, class and leaf layers) that start from each id's share of all words."""
    rng = np.random.default_rng(seed)
    share = share.reshape(CLASSES, LEAVES)
    of = share.sum(axis=1)
    with np.errstate(divide="ignore"):
        leaves = np.where(share > 0, np.log(share / np.maximum(of, 1e-300)[:, None]), -30.0)
        classes = np.where(of > 0, np.log(of), -30.0)
    shapes = ((BORDER + 1, HIDDEN), (len(_PLACES), HIDDEN), (HIDDEN, CLASSES), (CLASSES, HIDDEN, LEAVES))
    net = [rng.normal(0, s, x) for x, s in zip(shapes, (0.2, 0.0, 0.1, 0.1), strict=True)]
    net[1] += 1.0
    return [x.astype(np.float32) for x in (*net, classes, leaves)]


_ONES = np.ones(max(64, BATCH), np.float32)


def _steep(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether the exponentials of these layers could grow too large or all too small, whatever the hidden units (-1 to 1)."""
    spread = np.abs(weights).sum(axis=-2)
    return bool((bias + spread).max() > 70 or (bias - spread).max(axis=-1).min() < -70)


def _exp(z: np.ndarray, steep: bool) -> np.ndarray:
    """Exponentials of rows in place, less their maximum if it takes that."""
    if steep:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _own(z: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where one column (``of``) of each row is among all values."""
    return np.arange(0, z.size, z.shape[1]) + of


def _log_share(z: np.ndarray, of: np.ndarray, steep: bool) -> np.ndarray:
    """The logarithm of the softmax of one column (``of``) of each row."""
    if steep:
        z -= z.max(axis=1, keepdims=True)
    own = z.ravel().take(_own(z, of))
    return own - np.log(np.exp(z, out=z) @ _ONES[: z.shape[1]])


def _slope(z: np.ndarray, of: np.ndarray, steep: bool) -> np.ndarray:
    """The gradient of the mean loss, where ``of`` has each row's true column, in place."""
    _exp(z, steep)
    z *= (1 / (len(z) * (z @ _ONES[: z.shape[1]])))[:, None]
    z.reshape(-1)[_own(z, of)] -= np.float32(1 / len(z))
    return z


def _by_id(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the runs' middles that hold words, by the words' ids, and those ids."""
    middle = runs[:, WINDOW : WINDOW + RUN].ravel()
    order = np.argsort(middle, kind="stable")
    ids = middle[order]
    n = int(np.searchsorted(ids, BORDER))  # the largest id
    return order[:n], ids[:n].astype(np.int64)


def _hidden(net: list[np.ndarray], runs: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden units of the words at the places of ``order``, and the embeddings of all runs (a row each)."""
    x = net[0].take(runs.ravel(), axis=0).reshape(len(runs), -1)
    gates = np.tile(net[1], RUN)
    total = x[:, : RUN * HIDDEN] * gates[0]
    part = np.empty_like(total)
    for k, gate in zip(_PLACES[1:], gates[1:], strict=True):
        total += np.multiply(x[:, k * HIDDEN : (k + RUN) * HIDDEN], gate, out=part)
    h = total.reshape(-1, HIDDEN).take(order, axis=0)
    return np.tanh(h, out=h), x


def _class_layer(net: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """What the softmax over the classes is of."""
    z = h @ net[2]
    z += net[4]
    return z


def _leaf_layer(net: list[np.ndarray], h: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """What the softmax over the leaves of each word's class is of, and (class, first, end) of the words of each, in order."""
    edges = np.searchsorted(kinds, np.arange(CLASSES + 1))
    spans = [(int(c), int(edges[c]), int(edges[c + 1])) for c in np.flatnonzero(np.diff(edges))]
    z = np.empty((len(h), LEAVES), np.float32)
    for c, a, b in spans:
        part = z[a:b]
        np.matmul(h[a:b], net[3][c], out=part)
        part += net[5][c]
    return z, spans


def predict(net: list[np.ndarray], runs: np.ndarray, ids: np.ndarray, step: int = BATCH) -> np.ndarray:
    """log p(id | window) of each word; ``runs``: the windows of the words with these ids."""
    out, done = np.empty(len(ids), np.float32), 0
    steep = _steep(net[2], net[4]), _steep(net[3], net[5])
    for lo in range(0, len(runs), step // RUN):
        some = runs[lo : lo + step // RUN]
        order, own = _by_id(some)
        h, kinds = _hidden(net, some, order)[0], own // LEAVES
        logs = np.zeros(len(some) * RUN, np.float32)
        logs[order] = _log_share(_class_layer(net, h), kinds, steep[0]) + _log_share(_leaf_layer(net, h, kinds)[0], own % LEAVES, steep[1])
        out[done : done + len(own)] = logs[some[:, WINDOW : WINDOW + RUN].ravel() != BORDER]
        done += len(own)
    return out


def fit(net: list[np.ndarray], past: list[np.ndarray], runs: np.ndarray, rate: float = RATE) -> None:
    """One step of Adagrad on the words of these runs, in place; ``past`` has the sums of squared gradients."""
    order, ids = _by_id(runs)
    kinds = ids // LEAVES
    h, x = _hidden(net, runs, order)
    d = _slope(_class_layer(net, h), kinds, _steep(net[2], net[4]))
    e, spans = _leaf_layer(net, h, kinds)
    _slope(e, ids % LEAVES, _steep(net[3], net[5]))
    back = d @ net[2].T
    leaf, border = np.zeros_like(net[3]), np.zeros_like(net[5])
    for c, a, b in spans:
        np.matmul(h[a:b].T, e[a:b], out=leaf[c])
        np.matmul(_ONES[: b - a], e[a:b], out=border[c])
        back[a:b] += e[a:b] @ net[3][c].T
    back *= 1 - h * h

    def move(k: int, rows, gradient: np.ndarray) -> None:
        by = gradient * gradient
        by += past[k][rows]
        past[k][rows] = by
        np.sqrt(by, out=by)
        by += 1e-6
        np.divide(gradient, by, out=by)
        by *= rate
        net[k][rows] -= by

    everything = slice(None)
    for k, gradient in ((2, h.T @ d), (3, leaf), (4, _ONES[: len(d)] @ d), (5, border)):
        move(k, everything, gradient)
    slopes = np.zeros((len(runs) * RUN, HIDDEN), np.float32)
    slopes[order] = back
    slopes = slopes.reshape(len(runs), -1)
    dx, gates, part = np.zeros_like(x), np.empty_like(net[1]), np.empty_like(slopes)
    for row, k in enumerate(_PLACES):
        span = slice(k * HIDDEN, (k + RUN) * HIDDEN)
        np.multiply(slopes, x[:, span], out=part)
        gates[row] = (_ONES[: len(part)] @ part).reshape(RUN, HIDDEN).sum(axis=0)
        dx[:, span] += np.multiply(slopes, np.tile(net[1][row], RUN), out=part)
    flat = runs.ravel()
    by = np.argsort(flat, kind="stable")
    met = flat[by]
    begins = np.flatnonzero(np.diff(met, prepend=np.int16(-1)))
    move(1, everything, gates)
    move(0, met[begins], np.add.reduceat(dx.reshape(-1, HIDDEN).take(by, axis=0), begins, axis=0))


def _flat(net: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in net])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([x.size for x in like])[:-1]
    return [x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(flat, cuts), like, strict=True)]


# What is gathered from the documents


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), its class, and count over all documents."""

    def run(batches):
        for batch in batches:
            parts = [Words(data, offsets) for _, _, data, offsets in chunks(batch.column(0), NEAR)]
            hashes = np.concatenate([signed(x.hashes) for x in parts]) if parts else np.zeros(0, np.int64)
            kinds = np.concatenate([class_of(x.ending) for x in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(hashes)
            hashes, kinds = hashes[order], kinds[order]
            begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
            counts = np.diff(begins, append=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[begins]), pa.array(kinds[begins], pa.int32()), pa.array(counts, pa.int64())], ["word", "class", "n"])

    found = _texts(docs).transform(in_arrow, run, "word long, class int, n long")
    return found.groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The words that are leaves, and each id's share of all words. The driver gets LEAVES words of each class at most."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "word"))
    top = counts.select("word", "class", "n", rank.alias("leaf")).where(F.col("leaf") < LEAVES).collect()
    share = np.zeros(CLASSES * LEAVES)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        share[r["class"] * LEAVES] = r.n
    for r in top:
        share[r["class"] * LEAVES + r.leaf] = r.n
        share[r["class"] * LEAVES] -= r.n
    share[::LEAVES] += 1  # there may always be a rare word
    ids = np.array([r["class"] * LEAVES + r.leaf for r in top], np.int64)
    return Vocabulary(np.array([r.word for r in top], np.int64), ids), share / share.sum()


def _count_spelt(counts: np.ndarray, found: Words, ids: np.ndarray) -> None:
    """Adds the cells of the words that are no leaf."""
    cells, fronts = found.spellings()
    rare = ids % LEAVES == 0
    marks = np.zeros(len(cells) + 1, np.int8)
    marks[found.starts[rare]] += 1
    marks[found.ends[rare]] -= 1
    np.add.at(counts, cells[np.cumsum(marks[:-1], dtype=np.int8).view(bool)], 1)
    np.add.at(counts, fronts[rare], 1)


BLOCK = 1 << 15
_PART = "block int, weight double, cells binary, data binary"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["block", "weight", "cells", "data"])


def trained(docs: DataFrame, words_of: Vocabulary, share: np.ndarray, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """The network after one pass over all words, the counts of all cells of spelling, and the words of the vocabulary."""
    context = docs.sparkSession.sparkContext
    net = fresh(share)
    past = [np.full(x.shape, 1e-7, np.float32) for x in net]
    spelt, leaves = np.zeros(SYMBOLS**3, np.int64), set()
    for number in range(rounds):
        held = context.broadcast((words_of, net, past))

        def run(batches, held=held, number=number):
            known, net, past = held.value[0], *([x.copy() for x in held.value[k]] for k in (1, 2))
            rng, total, spelt, leaves = np.random.default_rng(number), 0, np.zeros(SYMBOLS**3, np.int64), []
            unmet = np.arange(CLASSES * LEAVES) % LEAVES > 0
            for batch in batches:
                for _, _, data, offsets in chunks(batch.column(0)):
                    found = Words(data, offsets)
                    ids = known.of(found)
                    _count_spelt(spelt, found, ids)
                    place = np.full(CLASSES * LEAVES, -1)
                    place[ids] = np.arange(len(ids))
                    for leaf in np.flatnonzero((place >= 0) & unmet):
                        leaves.append(LOWER[data[found.starts[place[leaf]] : found.ends[place[leaf]]]].tobytes())
                    unmet &= place < 0
                    window = windows(ids, found.at)
                    order = rng.permutation(len(window))
                    for lo in range(0, len(order), BATCH // RUN):
                        fit(net, past, window[order[lo : lo + BATCH // RUN]])
                    total += len(ids)
            if total:
                flat = np.concatenate([_flat(net), np.sqrt(_flat(past))])
                blocks = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
                cells = np.flatnonzero(spelt)
                yield _parts([(-2, 0.0, b"", b" ".join(leaves)), (-1, 0.0, cells.tobytes(), spelt[cells].tobytes()), *((k, float(total), b"", x) for k, x in enumerate(blocks))])

        def mean(batches):
            """The weighted means of the blocks, the sums of the counts and the words that were met; one of each is held at a time."""
            sums: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["block"] == -2:
                        sums.setdefault(-2, [0.0, set()])[1].update(row["data"].split())
                    elif row["block"] == -1:
                        total = sums.setdefault(-1, [0.0, np.zeros(SYMBOLS**3, np.int64)])
                        total[1][np.frombuffer(row["cells"], np.int64)] += np.frombuffer(row["data"], np.int64)
                    else:
                        values = np.frombuffer(row["data"], np.float32)
                        total = sums.setdefault(row["block"], [0.0, np.zeros(len(values))])
                        total[0] += row["weight"]
                        total[1] += row["weight"] * values
            rows = []
            for k, (w, x) in sums.items():
                if k == -2:
                    rows.append((k, w, b"", b" ".join(sorted(x))))
                elif k == -1:
                    rows.append((k, w, np.flatnonzero(x).tobytes(), x[x > 0].tobytes()))
                else:
                    rows.append((k, w, b"", (x / w).astype(np.float32).tobytes()))
            yield _parts(rows)

        share_of = docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(rounds)) == number)
        parts = _texts(share_of).coalesce(2 * context.defaultParallelism).transform(in_arrow, run, _PART)
        means = parts.repartition(16, "block").transform(in_arrow, mean, _PART).collect()
        held.unpersist()
        blocks = {r.block: r for r in means}
        if -1 in blocks:
            leaves.update(bytes(blocks.pop(-2).data).split())
            spelt[np.frombuffer(blocks[-1].cells, np.int64)] += np.frombuffer(blocks.pop(-1).data, np.int64)
            flat = np.concatenate([np.frombuffer(blocks[k].data, np.float32) for k in sorted(blocks)])
            size = len(flat) // 2
            net, past = _shaped(flat[:size], net), _shaped(flat[size:] ** 2, past)
    return net, spelt, sorted(leaves)


def spelling(counts: np.ndarray) -> np.ndarray:
    """log p(byte | the two after it) for all cells, smoothed by p(byte | the one after it) and that by p(byte)."""
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    p = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SYMBOLS)
    ones = counts.sum(axis=0)
    p = (ones + SMOOTH * p) / (ones.sum(axis=1, keepdims=True) + SMOOTH)
    p = (counts + SMOOTH * p[None, :, :]) / (counts.sum(axis=2, keepdims=True) + SMOOTH)
    return np.log(p).ravel().astype(np.float32)


def _spelling_logs(table: np.ndarray, found: Words) -> np.ndarray:
    cells, fronts = found.spellings()
    sums = np.concatenate([[0.0], np.cumsum(table[cells], dtype=np.float64)])
    return sums[found.ends] - sums[found.starts] + table[fronts]


def class_masses(table: np.ndarray, leaves: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The logarithm of what a class's spellings weigh, all there can be but those of its leaves (log weights, ids)."""
    logs = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    last = logs[0, 0, 1:]  # a word's last byte, and the one before it or none
    pairs = np.exp(last[:, None] + logs[0, 1:, :])
    ending = np.arange(1, SYMBOLS)[:, None] * SYMBOLS + np.arange(SYMBOLS)[None, :]
    mass = np.bincount(class_of(ending.ravel()), weights=pairs.ravel(), minlength=CLASSES)
    taken = np.bincount(ids // LEAVES, weights=np.exp(leaves), minlength=CLASSES)
    return np.log(np.maximum(mass - taken, 1e-9 * mass))


class Model:
    """All that it takes to score a text, of a size that doesn't grow with the documents."""

    def __init__(self, known: Vocabulary, net: list[np.ndarray], spelt: np.ndarray, leaves: list[bytes]):
        """``spelt``: counts of cells; ``leaves``: the words of the vocabulary."""
        self.known, self.net, self.table = known, net, spelling(spelt)
        found = _listed(leaves)
        self.masses = class_masses(self.table, _spelling_logs(self.table, found), known.of(found))

    def logs(self, found: Words) -> np.ndarray:
        """log p of each word by the network and, if rare, its spelling."""
        ids = self.known.of(found)
        out = predict(self.net, windows(ids, found.at), ids).astype(np.float64)
        rare = np.flatnonzero(ids % LEAVES == 0)
        out[rare] += _spelling_logs(self.table, found)[rare] - self.masses[ids[rare] // LEAVES]
        return out


def learn(docs: DataFrame, scratch: Scratch) -> Model:
    """A model of all words of all documents."""
    known, share = vocabulary(scratch.table(word_counts(docs), "words"))
    net, spelt, leaves = trained(docs, known, share)
    return Model(known, net, spelt, leaves)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pll (summed log-probabilities) and score (their mean) of every row.

    A null text, or one without words, has 0 tokens, pll 0 and a null score. Repeated rows are each returned and counted;
    a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    return _scored(docs, learn(docs, scratch), scratch)


def _scored(docs: DataFrame, learned: Model, scratch: Scratch) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(learned)

    def part(rows, ids, data, offsets):
        found = Words(data, offsets)
        logs = model.value.logs(found)
        pll = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[found.at])
        if not len(logs):
            sentences = [np.zeros(0, np.int64), *[np.zeros(0, np.float32)] * 2]
            ends = np.zeros(len(found.at), np.int64)
        else:
            number = found.sentences()
            begins = np.flatnonzero(np.diff(number, prepend=-1))
            place = np.arange(len(logs)) - begins[number]
            keys = signed(mix(np.add.reduceat(mix(found.hashes + mix(place.astype(np.uint64))), begins)))
            p = np.exp(logs)
            gains = [np.add.reduceat(np.log(w + (1 - w) * p) - logs, begins).astype(np.float32) for w in (1 / 2, 2 / 3)]
            long = np.diff(np.append(begins, len(logs))) >= LEAST
            sentences = [keys[long], *(g[long] for g in gains)]
            ends = np.searchsorted(begins[long], found.at)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in sentences]
        return pa.RecordBatch.from_arrays([rows, ids, pa.array(np.diff(found.at), pa.int64()), pa.array(pll, pa.float64()), *lists], ["row", "doc_id", "n_tokens", "pll", "sentences", "once", "twice"])

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2), NEAR):
                yield part(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), data, offsets)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, n_tokens long, pll double, sentences array<long>, once array<float>, twice array<float>"
    parts = scratch.table(source.transform(in_arrow, run, schema), "parts", from_scan=True)
    counts = parts.select(F.explode("sentences").alias("sentence")).groupBy("sentence").agg(F.count("*").alias("n")).where("n > 1")
    each = parts.select("row", F.explode(F.arrays_zip("sentences", "once", "twice")).alias("s")).select("row", "s.*").withColumnRenamed("sentences", "sentence")
    gains = each.join(counts, "sentence").groupBy("row").agg(F.sum(F.when(F.col("n") == 2, F.col("once")).otherwise(F.col("twice")).cast("double")).alias("gain"))
    pll = F.col("pll") + F.coalesce("gain", F.lit(0.0))
    return parts.join(gains, "row", "left").select("doc_id", "n_tokens", pll.alias("pll"), F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")).alias("score"))
