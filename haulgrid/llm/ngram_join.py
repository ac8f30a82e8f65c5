"""Jaccard join of documents on word n-grams with a count-vector R-tree.

A document is the set of its hashed n-grams. The hash splits the n-grams into groups twice over.

*Blocks.* Documents with J >= t differ in at most k = (1 - t) / t * n n-grams, so of the first k + SHARED groups that
are not empty, in the order of the hash, SHARED at least are the same in both (a group that differs uses up a difference,
and the equal ones come before k differences have). Each document is entered under the checksum of each of these groups. The
groups' width depends on a level of the set's size; a document whose partner might be on the next level is entered
on both. Sets under 64 use single n-grams. No linked pair is lost, and documents that only share a passage rarely meet.
(A level's groups are so many that k + SHARED are filled for any hash that spreads; the odds of fewer are below 1e-9 a set.)

*Points.* Low bits of the hash deal the n-grams to 128 groups whose counts are a point. The sum of coordinate minima
bounds the overlap of two sets from above. An R-tree, packed by size and coordinates, holds a block's points (with
neighbouring groups taken together) with the maxima of its nodes; pairs of nodes under the bound are left out with all
below. Surviving pairs are verified on the sets themselves.

A block never yields all of its pairs. Each member is first joined with the member it shares most blocks with as a pivot,
then with the few that its bounds bring nearest; components are formed, and only then pairs are sought between members
of different components. Blocks over TILE members are cut into tiles, so that no task holds more than two tiles at
once; members of a block's main component meet the others only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.components import connected_components
from haulgrid.llm.scratch import Scratch, few, in_arrow, small
from haulgrid.llm.textbytes import LOWER, SPACE, U64, chunks, mix, sequence_hash, signed, windows, word_hashes, words

GROUPS = 128
#: As many in the points of single pairs, which are compared once more before the sets are.
WIDE = 1024
#: Blocks that a linked pair has in common at least.
SHARED = 3
TILE = 512
FANOUT = 8
#: Pairs that each member of a block tries before all pairs across components are sought.
NEAREST = 4
_C1, _C2 = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_LEVEL = mix(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's n-grams; one for a shorter text, none without words."""
    for i, j, data, offsets in chunks(texts):
        starts, ends, at = words(~SPACE[data], offsets)
        hashes = word_hashes(LOWER[data], starts, ends)
        grams, places = windows(hashes, at, width)
        for d in range(j - i):
            count = at[d + 1] - at[d]
            if count >= width:
                u = np.sort(grams[places[d] : places[d + 1]])
                yield u[np.concatenate([[True], u[1:] != u[:-1]])]
            elif count:
                yield np.array([sequence_hash(hashes[at[d] : at[d + 1]])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_key(u: np.ndarray) -> int:
    """One signed 64-bit key for equal sets."""
    return xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63)


def signatures(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """The checksums under which a set is entered; none if no other set can be linked with it."""
    n = len(u)
    k = n * (den - num) // num
    if k < 1:
        return np.zeros(0, np.int64)
    most = n * den // num  # a partner's size
    wide = 0.6 * num / (den - num)
    out = []
    if n < 64:
        out.append(mix(u[: k + SHARED] * _C1))
    level = n.bit_length() - 1
    for b in [level, level + 1] if most >= 2 << level else [level]:
        if b < 6:
            continue
        m = -(-(2 << b) // wide)
        group = ((u >> U64(32)) * U64(int(m))) >> U64(32)
        begins = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        end = begins[k + SHARED] if len(begins) > k + SHARED else n
        begins = begins[: k + SHARED]
        out.append(mix(np.add.reduceat(u[:end], begins) * _C1 + group[begins] * _C2 + _LEVEL[b]))
    return signed(np.concatenate(out))


def enter(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key of the set and its signatures, these only once in a task for equal sets."""

    def run(batches):
        seen: set[int] = set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for u in shingle_sets(batch.column(1), width):
                key = set_key(u)
                new = len(u) > 0 and key not in seen
                if new:
                    seen.add(key)
                sizes.append(len(u))
                keys.append(key)
                sigs.append(signatures(u, num, den) if new else none)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else none
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists], ["doc_id", "text_hash", "n_shingles", "key", "sigs"])

    return docs.withColumn("text_hash", F.xxhash64("text")).transform(in_arrow, run, "doc_id long, text_hash long, n_shingles long, key long, sigs array<long>")


def point(u: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The counts of a set's groups; a set too large for a byte each has a point that bounds nothing."""
    counts = np.bincount((u & U64(groups - 1)).astype(np.int64), minlength=groups)
    return np.full(groups, 255, np.uint8) if counts.max(initial=0) >= 255 else counts.astype(np.uint8)


def points(docs: DataFrame, width: int) -> DataFrame:
    """key, n, point and wide point (bytes) and grams (the set) of each text (doc_id, text, key) whose set has that key."""
    names = ["key", "n", "point", "wide", "grams"]

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for u, wanted in zip(shingle_sets(batch.column(1), width), batch.column(2).to_pylist(), strict=True):
                if set_key(u) != wanted:
                    continue
                for column, value in zip(rows, (wanted, len(u), point(u).tobytes(), point(u, WIDE).tobytes(), signed(u)), strict=True):
                    column.append(value)
                if len(rows[0]) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _KINDS, strict=True)], names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _KINDS, strict=True)], names)

    return docs.select("doc_id", "text", "key").transform(in_arrow, run, "key long, n long, point binary, wide binary, grams array<long>")


_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))


def _coordinates(column: pa.Array) -> np.ndarray:
    """Points as rows of numbers; one that bounds nothing is very large."""
    counts = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(np.int32)
    counts[(counts == 255).all(axis=1)] = 1 << 24
    return counts


def _overlap(counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sums of coordinate minima of pairs of points."""
    parts = [np.minimum(counts[i[k : k + 16384]], counts[j[k : k + 16384]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 16384)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def tree_pairs(counts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i != j, of points whose bound allows a link, by a self-join of a packed R-tree, some at a time."""
    order = np.lexsort((counts[:, 1], counts[:, 0], sizes))
    high, low_n, high_n = [counts[order]], [sizes[order]], [sizes[order]]
    while len(high[-1]) > 1:
        edges = np.arange(0, len(high[-1]), FANOUT)
        high.append(np.maximum.reduceat(high[-1], edges))
        low_n.append(np.minimum.reduceat(low_n[-1], edges))
        high_n.append(np.maximum.reduceat(high_n[-1], edges))
    stack = [(len(high) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 32768:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        near = (high_n[level][j] * den >= low_n[level][i] * num) & (high_n[level][i] * den >= low_n[level][j] * num)
        i, j = i[near], j[near]
        most = np.minimum(high[level][i], high[level][j]).sum(axis=1, dtype=np.int64)
        fits = most * (num + den) >= num * (low_n[level][i] + low_n[level][j])
        i, j = i[fits], j[fits]
        if not level:
            if len(i):
                yield order[i], order[j]
            continue
        n = len(high[level - 1])
        a = (i[:, None] * FANOUT + np.arange(FANOUT)[None, :]).repeat(FANOUT, axis=1).ravel()
        b = np.tile(j[:, None] * FANOUT + np.arange(FANOUT)[None, :], (1, FANOUT)).ravel()
        keep = (a < n) & (b < n) & ((a < b) | ((a == b) & (level > 1)))
        stack.append((level - 1, a[keep], b[keep]))


def _tile_pairs(tiles: DataFrame, num: int, den: int, nearest: int | None) -> DataFrame:
    """(a, b, once for each tile) of the pairs in different components that the tile's R-tree can't rule out.

    With ``nearest``, only so many of each member's pairs, those with the highest bounds.
    """

    def chosen(i, j, of, keys, n, comp, side, cross, fine):
        """The pairs of rows (i, j) of tile ``of`` that are in question; cross: whether each pair's tile has two sides."""
        keep = (comp[i] != comp[j]) & ((side[i] != side[j]) | ~cross) & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)
        i, j, of = i[keep], j[keep], of[keep]
        most = _overlap(fine, i, j)
        keep = most * (num + den) >= num * (n[i] + n[j])
        i, j, of, bound = i[keep], j[keep], of[keep], most[keep] / (n[i] + n[j])[keep]
        if nearest and len(i):
            own, other, at = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
            order = np.lexsort((keys[other], -np.tile(bound, 2), own, np.tile(of, 2)))
            change = (np.diff(own[order]) != 0) | (np.diff(np.tile(of, 2)[order]) != 0)
            begins = np.concatenate([[0], np.flatnonzero(change) + 1])
            rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            some = np.unique(at[order[rank < nearest]])
            i, j = i[some], j[some]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[i], keys[j])), pa.array(np.maximum(keys[i], keys[j]))], ["a", "b"])

    def pairs(rows: pa.Table, cuts: np.ndarray):
        """The pairs of whole tiles, which lie between the cuts: small ones together, each other by its tree."""
        keys, n, comp, side = (rows.column(c).to_numpy() for c in ("key", "n", "comp", "side"))
        fine = _coordinates(rows.column("point").combine_chunks())
        starts, sizes = cuts[:-1], np.diff(cuts)
        two = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size <= 24:
                x, y = np.triu_indices(size, 1)
                step = max(1, (1 << 18) // max(1, len(x)))
                for k in range(0, len(at), step):
                    some = at[k : k + step]
                    i, j = ((starts[some][:, None] + z[None, :]).ravel() for z in (x, y))
                    of = np.repeat(some, len(x))
                    yield chosen(i, j, of, keys, n, comp, side, two[of], fine)
            else:
                for t in at:
                    lo, hi = cuts[t], cuts[t + 1]
                    coarse = fine[lo:hi].reshape(hi - lo, GROUPS // 2, 2).sum(axis=2)
                    found = [(i + lo, j + lo) for i, j in tree_pairs(coarse, n[lo:hi], num, den)]
                    if found:
                        i, j = (np.concatenate(z) for z in zip(*found, strict=True))
                        yield chosen(i, j, np.full(len(i), t), keys, n, comp, side, np.full(len(i), two[t]), fine)

    def run(batches):
        held: list[pa.RecordBatch] = []  # the last tile, as far as it has come
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            tile = np.stack([rows.column(k).to_numpy() for k in range(3)])
            begins = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1
            if len(begins):
                yield from pairs(rows.slice(0, begins[-1]), np.concatenate([[0], begins]))
                held = rows.slice(begins[-1]).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield from pairs(rows, np.array([0, rows.num_rows]))

    tile = ["sig", "row", "col"]
    return tiles.select(*tile, "key", "comp", "side", "n", "point").repartition(*tile).sortWithinPartitions(*tile).transform(in_arrow, run, "a long, b long")


def _single_tiles(blocks: DataFrame) -> DataFrame:
    """Blocks (sig, key, comp) cut into tiles; members of different tiles don't meet."""
    sizes = blocks.groupBy("sig").agg(F.ceil(F.count("*") / (2 * TILE)).alias("tiles"))
    at = F.pmod(F.xxhash64("key", F.lit(9)), F.col("tiles"))
    return blocks.join(sizes, "sig").select("sig", at.alias("row"), at.alias("col"), "key", "comp", F.lit(0).cast("long").alias("side"))


def _all_tiles(blocks: DataFrame) -> DataFrame:
    """Blocks cut into tiles in which all members of different components meet.

    Blocks of NEAREST + 1 members are left out: all their pairs have been tried. Those outside the block's main component are dealt to sides 0, 1, ..., those in it to sides -1, -2, ...; each pair of
    sides is a tile, but for two of the main component. A member is copied to as many tiles as there are sides to meet.
    """
    parts = blocks.groupBy("sig", "comp").agg(F.count("*").alias("c"))
    sizes = parts.groupBy("sig").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"))
    sizes = sizes.select("sig", "all", F.col("main.comp").alias("main"), F.ceil(F.col("main.c") / TILE).alias("mains"), F.ceil((F.col("all") - F.col("main.c")) / TILE).alias("others"))
    inside = F.col("comp") == F.col("main")
    side = F.when(inside, -1 - F.pmod(F.xxhash64("key", F.lit(9)), "mains")).otherwise(F.pmod(F.xxhash64("key", F.lit(9)), "others"))
    first = F.when(inside, F.lit(0).cast("long")).otherwise(-F.col("mains"))
    cut = blocks.join(sizes, "sig").where(F.col("all") > NEAREST + 1).withColumn("side", side).withColumn("other", F.explode(F.sequence(first, F.col("others") - 1)))
    return cut.select("sig", F.least("side", "other").alias("row"), F.greatest("side", "other").alias("col"), "key", "comp", "side")


def _both_sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with these columns of both sets. Only what is in a pair moves, and an a once for all its pairs."""
    pairs = small(pairs)
    one, two = (sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    firsts = small(pairs.select("a").distinct())
    return two.join(pairs, "b").join(one.join(firsts, "a", "left_semi"), "a")


def _near(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose wide points' bound allows a link."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = np.arange(part.num_rows)
                counts = np.concatenate([_coordinates(part.column(4)), _coordinates(part.column(5))])
                n = part.column(2).to_numpy() + part.column(3).to_numpy()
                yield part.select([0, 1]).filter(pa.array(_overlap(counts, rows, rows + len(rows)) * (num + den) >= num * n))

    sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    return _both_sides(pairs, sets, "n", "wide").where(sizes).select("a", "b", "n_a", "n_b", "wide_a", "wide_b").transform(in_arrow, run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that are linked, by the sets themselves."""
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return _both_sides(pairs, sets, "n", "grams").where(both * den >= (F.col("n_a") + F.col("n_b") - both) * num).select("a", "b")


def components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a set's key) and component_id of every row of ``docs``: linked are sets with J >= num / den.

    component_id is the least doc_id that links reach. A null text or one without words is linked with nothing: its
    component is its own doc_id. A null doc_id takes part, but is never a component's id while another is there.
    Equal texts are linked, repeated rows included (each is returned). An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entered = scratch.table(enter(docs, width, num, den), "entered", from_scan=True)
    rows = entered.select(F.explode("sigs").alias("sig"), "key")
    shared = rows.groupBy("sig").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("sig", "low")
    blocks = scratch.table(rows.join(shared, "sig").distinct(), "blocks")
    labels = _linked(docs, entered, blocks, scratch, width, num, den) if not blocks.isEmpty() else None

    own = entered.select("doc_id", "text_hash", "n_shingles", "key")
    if labels is not None:
        own = own.join(labels.withColumnRenamed("node", "key"), "key", "left")
    else:
        own = own.withColumn("component", F.lit(None).cast("long"))
    own = own.withColumn("component", F.coalesce("component", "key"))
    rows = entered.count()
    ids = scratch.table(own.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "ids", rows=rows)
    out = own.join(small(ids), "component", "left")
    return few(out, rows).select("doc_id", "text_hash", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _linked(docs: DataFrame, entered: DataFrame, blocks: DataFrame, scratch: Scratch, width: int, num: int, den: int) -> DataFrame:
    members = blocks.select("key").distinct()
    rows = entered.count()
    reps = scratch.table(entered.join(members, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("rep")), "reps", rows=rows)
    ids = small(reps)
    sets = scratch.table(points(docs.join(ids, docs["doc_id"].eqNullSafe(ids["rep"])), width), "sets", from_scan=True)
    if sets.count() > reps.count():  # repeated rows
        sets = scratch.table(sets.dropDuplicates(["key"]), "sets-once")

    # One pivot for each member, the one it shares most blocks with.
    shared = blocks.where("key <> low").groupBy("key", "low").agg(F.count("*").alias("c"))
    pairs = shared.groupBy("key").agg(F.max(F.struct("c", "low")).alias("best")).select(F.least("key", "best.low").alias("a"), F.greatest("key", "best.low").alias("b")).distinct()
    tried = scratch.table(pairs, "pairs-0", rows=rows)
    near = scratch.table(_near(tried, sets, num, den), "near-0", rows=rows)
    links = scratch.table(_verified(near, sets, num, den), "links-0", rows=rows)
    labels = connected_components(links, scratch, "star-0", rows)

    # The nearest pairs, and then whatever is left, whole: all pairs across components that the trees can't rule out. Linked
    # pairs meet in SHARED blocks. Where all but one of these are large, they meet so often among the second step's tiles;
    # else so often in small blocks, where all pairs are nearest.
    for step, tiles, nearest in (("nearest", _single_tiles, NEAREST), ("all", _all_tiles, None)):
        unsettled = _unsettled(blocks, labels, scratch, f"open-{step}")
        if unsettled.isEmpty():
            return labels
        pairs = _tile_pairs(tiles(unsettled).join(sets.select("key", "n", "point"), "key"), num, den, nearest)
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED - 1).select("a", "b")
        pairs = scratch.table(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{step}", rows=rows)
        tried = tried.unionByName(pairs)
        near = scratch.table(_near(pairs, sets, num, den), f"near-{step}", rows=rows)
        found = scratch.table(_verified(near, sets, num, den), f"links-{step}", rows=rows)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = connected_components(links, scratch, f"star-{step}", rows)
    return labels


def _unsettled(blocks: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(sig, key, comp) of the blocks whose members are in several components."""
    own = blocks.select("sig", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", F.coalesce("component", "key").alias("comp"))
    several = own.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
    return scratch.table(own.join(several, "sig").select("sig", "key", "comp"), name)


def ngram_report(docs: DataFrame) -> DataFrame:
    """n_shingles and component_id of each document: four-word shingles, J >= 0.85."""
    return components(docs, 4, 85, 100).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, the one with the least doc_id; repeated rows with a doc_id stay once.

    Decided by doc_id and text, so rows with one doc_id and different texts are judged each on its own. Rows without words
    and rows whose component has no doc_id at all stay; a row without a doc_id goes if its component has one.
    """
    scratch = Scratch(docs.sparkSession, "one")
    found = scratch.table(components(docs, width, num, den), "found")
    grouped = found.where("n_shingles > 0 and component_id is not null")
    kept_of = grouped.where("doc_id = component_id").groupBy("component").agg(F.min("text_hash").alias("kept_hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash"))
    gone = scratch.table(grouped.join(kept_of, "component").where(~stays).select("doc_id", "text_hash").distinct(), "gone")
    twice = found.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    twice = scratch.table(twice, "twice")

    def of(rows: DataFrame, how: str) -> DataFrame:
        some = small(rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
        return lambda df: df.join(some, F.col("doc_id").cast("long").eqNullSafe(some["_id"]) & (F.xxhash64(F.col("text").cast("string")) == some["_hash"]), how)

    kept = docs.transform(of(gone, "left_anti"))
    if twice.isEmpty():
        return kept
    return kept.transform(of(twice, "left_anti")).unionByName(kept.transform(of(twice, "left_semi")).dropDuplicates(["doc_id", "text"]))
