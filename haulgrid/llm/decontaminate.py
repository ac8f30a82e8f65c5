"""Benchmark decontamination by template canonicalisation.

Words of items and documents become templates: numbers, units after a number and names become typed placeholders, all
else is lower-cased. Windows of templates are hashed and joined; for each occurrence of an item in a document the
placeholders' values must be consistent (one value of the item always stands for one value of the document, and the other
way round). An item that occurs with other numbers or names is thus found as well, and told apart.

A title-case word that opens a sentence may be a name or not, so windows with one have two templates: with the word itself,
and with a name in its place. An occurrence is judged by the first kind alone and by both together; either is enough.

Documents are read in one pass that hands on only windows that a bitmap of the benchmark's windows lets through; the
join decides. The bitmap has a size bound; for a larger benchmark all windows go to the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.llm.scratch import Scratch, in_arrow
from haulgrid.llm.textbytes import LOWER, U64, chunks, mix, signed, word_hashes, words

WIDTH = 8
#: An occurrence counts from this share of an item's windows on.
COVERAGE = 0.5
#: Words of an unbroken run that count whatever their share, and words that may stand between an item's runs.
RUN, GAP = 13, 8
#: Words of a window that must not be placeholders; one with fewer is entered with its values instead.
LITERALS = 4
#: Windows of a benchmark for which a bitmap (16 bits each) is used: 8 MB at most.
BITMAP_WINDOWS = 1 << 22

#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "s ms sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros usd eur gbp degree degrees hz khz mhz ghz w kw v volt volts watt watts kmh mph kph"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = _SMALL[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 59, 63, 124]] = True
_NUM, _UNIT, _NAME = (U64(x) for x in (0x6E756D, 0x756E6974, 0x6E616D65))


def _hash_words(items: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(items).encode(), np.uint8)
    starts, ends, _ = words(data != 32, np.array([0, len(data)]))
    return np.sort(word_hashes(data, starts, ends))


_UNIT_HASHES = _hash_words(UNITS)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Templates of all words (literal hash or placeholder), the same with sentence openers as names, their values, and the offsets of each text's words."""
    is_word = _LETTER[data]
    if len(data) > 2:  # a point or comma between digits belongs to the number
        inner = np.zeros(len(data), bool)
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        is_word |= inner
    low = LOWER[data].copy()
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[accent] += 32  # capital letters of Latin-1
    starts, ends, at = words(is_word, offsets)
    values = word_hashes(low, starts, ends)
    templates = values.copy()
    if not len(starts):
        return templates, templates, values, at
    first = np.zeros(len(starts), bool)
    first[at[:-1][at[:-1] < len(starts)]] = True
    number = _DIGIT[data[starts]]
    after = np.concatenate([[False], number[:-1]]) & ~first
    unit = np.zeros(len(starts), bool)
    near = np.flatnonzero(after & ~number)
    unit[near] = np.isin(values[near], _UNIT_HASHES)
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~is_word)])
    opens = first | (stops[starts] > np.concatenate([[0], stops[ends[:-1]]]))
    title = _UPPER[data[starts]] & (ends - starts > 1) & _SMALL[data[np.minimum(starts + 1, len(data) - 1)]]
    templates[number] = _NUM
    templates[unit] = _UNIT
    title &= ~number & ~unit
    named = templates.copy()
    templates[title & ~opens] = _NAME
    named[title] = _NAME
    return templates, named, values, at


_WEIGHT = mix(np.arange(1, 65, dtype=np.uint64)) | U64(1)


def _windows(templates: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(begins), U64(width))
    for k in range(width):
        out += templates[begins + k] * _WEIGHT[k]
    return signed(mix(out))


WINDOWS = "id long, hash long, at int, width int, of int, of_typed int, typed boolean, opener boolean, slots array<long>"


def template_windows(df: DataFrame, key: str, width: int = WIDTH, bitmaps: dict[int, bytes] | None = None, item: bool = False) -> DataFrame:
    """Windows of each text: hash, place, width, the text's numbers of windows and of typed ones, whether it is one, and slots.

    A slot is a placeholder's value, else 0. A window with too few literals is not typed: it stands for its own values.
    ``opener``: the window's template with names for sentence openers, which is entered beside the first where it differs.

    An item shorter than ``width`` is one window of its own width (so documents are also read at each such width).
    """
    widths = sorted(bitmaps) if bitmaps else [width]

    def part(ids, data, offsets):
        templates, named, values, at = canonical(data, offsets)
        forms = [(x, np.where(x == values, U64(0), values), np.concatenate([[0], np.cumsum(x == values)])) for x in (templates, named)]
        counts = np.diff(at)
        for w in widths:
            own = np.maximum(counts - w + 1, 0)
            if item:
                own = np.where(counts < width, (counts == w).astype(int), own if w == width else 0)
            total = int(own.sum())
            if not total:
                continue
            text = np.repeat(np.arange(len(counts)), own)
            place = np.arange(total) - np.repeat(np.cumsum(own) - own, own)
            begins = at[:-1][text] + place
            literals = [of[begins + w] - of[begins] for _, _, of in forms]
            least = min(LITERALS, w)
            typed = literals[0] >= least
            of_typed = np.bincount(text[typed], minlength=len(counts))
            for opener, (form, slots, _) in enumerate(forms):
                rows = np.flatnonzero((literals[1] >= least) & (literals[1] < literals[0])) if opener else np.arange(total)
                hashes = _windows(form, begins[rows], w)
                if not opener:
                    few = np.flatnonzero(~typed)
                    hashes[few] = _windows(values, begins[few], w)
                if bitmaps:
                    bits = np.frombuffer(bitmaps[w], np.uint8)
                    spot = hashes.view(np.uint64) & U64(len(bits) * 8 - 1)
                    there = (bits[(spot >> U64(3)).astype(np.int64)] >> (spot & U64(7)).astype(np.uint8)) & 1 > 0
                    rows, hashes = rows[there], hashes[there]
                n, of = len(rows), text[rows]
                if not n:
                    continue
                held = np.where(typed[rows][:, None], slots[begins[rows][:, None] + np.arange(w)], U64(0)).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(signed(held), pa.int64()))
                columns = [hashes, place[rows].astype(np.int32), np.full(n, w, np.int32), own[of].astype(np.int32), of_typed[of].astype(np.int32), typed[rows], np.full(n, bool(opener))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *map(pa.array, columns), lists], ["id", "hash", "at", "width", "of", "of_typed", "typed", "opener", "slots"])

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                yield from part(batch.column(0).slice(i, j - i), data, offsets)

    source = df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return source.transform(in_arrow, run, WINDOWS)


def _bitmap(hashes: DataFrame, count: int) -> bytes:
    bits = 1 << max(16, (16 * count - 1).bit_length())
    spots = hashes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("s")).distinct().toArrow().column(0).to_numpy()
    flags = np.zeros(bits, np.uint8)
    flags[spots] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def item_widths(benchmark: DataFrame, width: int) -> list[int]:
    """The widths of windows that the items need: ``width``, and the lengths of shorter items."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(np.diff(canonical(data, offsets)[3]), width)), pa.int32())], ["w"])

    found = benchmark.select(F.col("text").cast("string").alias("text")).transform(in_arrow, run, "w int").distinct().collect()
    return sorted({width} | {r.w for r in found if r.w >= LITERALS})


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """One row for each occurrence: doc_id, item_id, start (word), coverage, and whether its slots differ (changed).

    An occurrence has consistent slots, and is at least ``coverage`` of an item's windows at one distance in a document, or
    at distances within GAP words of the next, or an unbroken run of RUN words. Where at least half of an item's windows
    are typed, their share alone is enough. Nulls and empty texts have no windows, nor have items under four words; a null
    doc_id or item_id is not reported. Repeated rows count once. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    widths = item_widths(benchmark, width)
    items = None
    for w in widths:
        own = template_windows(benchmark, "item_id", width, {w: b"\xff" * 8192}, item=True)
        items = own if items is None else items.unionByName(own)
    # A window that an item repeats is entered once, at its first place, so that no pairs of repeats arise.
    once = F.row_number().over(Window.partitionBy("id", "hash", "opener").orderBy("at"))
    items = items.where("id is not null").withColumn("_once", once).where("_once = 1").drop("_once")
    plain = items.where("not opener").groupBy("id").agg(F.max("of").alias("all"), F.max("of_typed").alias("all_typed"), F.count("*").cast("int").alias("of"), F.count_if("typed").cast("int").alias("of_typed"))
    items = scratch.table(items.drop("of", "of_typed").join(plain, "id"), "items")
    counts = {r.width: r["count"] for r in items.groupBy("width").count().collect()}
    if not counts:
        counts = {width: 0}
    bitmaps = {w: _bitmap(items.where(F.col("width") == w), n) if n <= BITMAP_WINDOWS else b"\xff" * 8192 for w, n in counts.items()}
    found = template_windows(docs, "doc_id", width, bitmaps).where("id is not null")
    pairs = found.select(F.col("id").alias("doc_id"), "hash", F.col("at").alias("doc_at"), "width", F.col("opener").alias("doc_opener"), F.col("slots").alias("doc_slots")).join(
        items.select(F.col("id").alias("item_id"), "hash", "at", "width", "of", "of_typed", "all", "all_typed", "typed", "opener", F.col("slots").alias("item_slots")), ["hash", "width"]
    )
    opener = (F.col("opener") | F.col("doc_opener")).alias("opener")
    pairs = scratch.table(pairs.select("doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("start"), "at", "width", "of", "of_typed", "all", "all_typed", "typed", opener, "doc_slots", "item_slots").distinct(), "pairs")
    met = pairs.groupBy("doc_id", "item_id").agg(F.countDistinct(F.col("start") + F.col("at")).alias("met"))
    # Windows are looked at by distance, by distances near each other, and by unbroken runs.
    places = pairs.select("doc_id", "item_id", "start", "at").distinct()
    both = Window.partitionBy("doc_id", "item_id").orderBy("start")
    near = places.select("doc_id", "item_id", "start").distinct().withColumn("far", (F.col("start") - F.coalesce(F.lag("start").over(both), F.col("start")) > GAP).cast("int"))
    near = near.select("doc_id", "item_id", "start", F.sum("far").over(both.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))
    line = Window.partitionBy("doc_id", "item_id", "start").orderBy("at")
    places = places.withColumn("island", F.col("at") - F.row_number().over(line)).join(near, ["doc_id", "item_id", "start"])
    kinds = ((0, F.col("start"), F.lit(0)), (1, F.col("cluster"), F.lit(0)), (2, F.col("start"), F.col("island")))
    runs = [[F.struct(F.lit(k).alias("kind"), F.lit(openers).alias("openers"), x.cast("long").alias("x"), y.cast("long").alias("y")) for k, x, y in kinds] for openers in (0, 1)]
    pairs = pairs.join(places, ["doc_id", "item_id", "start", "at"]).withColumn("run", F.explode(F.when(F.col("opener"), F.array(*runs[1])).otherwise(F.array(*runs[0], *runs[1]))))
    run = ["doc_id", "item_id", "cluster", "run"]
    spans = pairs.groupBy(*run).agg(F.min("start").alias("start"), F.countDistinct("at").alias("n"), F.count_distinct(F.when(F.col("typed"), F.col("at"))).alias("n_typed"), F.max("of").alias("of"), F.max("of_typed").alias("of_typed"), F.max("all").alias("all"), F.max("all_typed").alias("all_typed"), F.max("width").alias("width"))
    # Each slot of the item with the value it has in the document: all through an occurrence, one stands for one.
    slots = pairs.select(*run, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).select(*run, F.col("s.item_slots").alias("theirs"), F.col("s.doc_slots").alias("ours"))
    slots = slots.where("theirs <> 0 and ours <> 0").distinct().groupBy(*run).agg(F.count("*").alias("both"), F.countDistinct("theirs").alias("a"), F.countDistinct("ours").alias("b"), F.max((F.col("theirs") != F.col("ours")).cast("int")).alias("changed"))
    typed = F.when(F.col("of_typed") * 2 >= F.col("of"), F.col("n_typed") / F.col("of_typed")).otherwise(0.0)
    found = spans.join(slots, run, "left").where(F.col("both").isNull() | ((F.col("both") == F.col("a")) & (F.col("both") == F.col("b")))).withColumn("coverage", F.greatest(F.col("n") / F.col("of"), typed))
    # Of an item that repeats itself, a document must hold as many windows as the share asks for, repeats included.
    found = found.join(met, ["doc_id", "item_id"]).withColumn("coverage", F.least("coverage", F.lit(1.0)))
    enough = F.col("met") >= coverage * F.when(typed >= coverage, F.least("all", "all_typed")).otherwise(F.col("all"))
    whole = (F.col("run.kind") < 2) & (F.col("coverage") >= coverage) & ((F.col("of") == F.col("all")) | enough)
    unbroken = (F.col("run.kind") == 2) & (F.col("n") + F.col("width") - 1 >= RUN)
    rank = F.col("run.kind") * 2 + F.col("run.openers")
    found = found.where(whole | unbroken).withColumn("first", F.min(rank).over(Window.partitionBy("doc_id", "item_id", "cluster"))).where(rank == F.col("first"))
    return found.select("doc_id", "item_id", "start", "coverage", (F.coalesce("changed", F.lit(0)) == 1).alias("changed"))


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document with a benchmark item: its items (joined), best coverage, whether one is changed."""
    found = leaks(docs, benchmark)
    best = found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("changed").alias("changed"))
    items = F.concat_ws(",", F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")))
    return best.groupBy("doc_id").agg(F.count("*").alias("n_items"), items.alias("items"), F.max("coverage").alias("coverage"), F.max("changed").alias("changed"))
