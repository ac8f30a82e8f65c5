"""Each operator against a brute-force version, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haulgrid.llm import decontaminate, langid, lm_score, media, ngram_join, packing, pii, sharding, tokenfile, urlfilter
from haulgrid.llm.queries import QUERIES, tokenizer_path
from haulgrid.llm.scratch import Scratch
from haulgrid.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 40_000 + "end"
#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, "one", "en", "a", 3), (5, "the cat sat on the mat and ate the rat.", "en", "a", 39),
    (6, "the cat sat on the mat and ate the rat.", "en", "a", 39), (6, "the cat sat on the mat and ate the rat.", "en", "a", 39), (None, "the cat sat on the mat and ate the rat.", None, "a", 39),
    (7, LONG, "de", "b", None), (8, "12345 67890 !!! é中文 \U0001f600", "fr", "b", 20), (9, "<|endoftext|> x y", "fr", "b", 3), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    clash = ["sig", "key", "n", "start", "ids", "size", "shard", "g", "host", "path", "id", "hash", "score", "spans", "_terms", "label"]
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in clash}).cache()


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


ALL = {
    "pack": lambda d: packing.packing_report(d, tokenizer_path()),
    "media": media.media_report,
    "shard": sharding.shard,
    "tokens": lambda d: tokenfile.token_report(d, tokenizer_path()),
    "ngrams": ngram_join.ngram_report,
    "pii": pii.find,
    "lm": lm_score.score,
    "lang": langid.language_report,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_and_empty_tables(odd, name):
    assert ALL[name](odd.limit(0)).count() == 0
    got = ALL[name](odd).collect()
    seen = Counter({(r.doc_id, r.start): 1 for r in got if r.start == 0}) if name == "pack" else None
    assert len(got) == len(ODD) if name != "pack" else len(seen) == len({x[0] for x in ODD})


@pytest.mark.parametrize("path", ["docs", "odd"])
def test_encoder_equals_library(path, request):
    e = Encoder(tokenizer_path())
    for _, text in texts_of(request.getfixturevalue(path)):
        assert not text or e.encode(text) == e.whole(text)
    for text in ("a  b", " lead", "trail ", "x\n\ny", "x \ny", "it's don't", "a1b2 c.d,e", "Über naïve.", "tab\ty", "zero\0byte"):
        assert e.encode(text) == e.whole(text), text


@pytest.mark.parametrize("path", ["docs", "odd"])
def test_packing(path, request):
    df = request.getfixturevalue(path)
    e = Encoder(tokenizer_path())
    want = defaultdict(list)
    for k, t in texts_of(df):
        want[k].append((e.whole(t) if t else b"") + np.array([1], "<u4").tobytes())
    rows = packing.pack(df, tokenizer_path()).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.length > 0
        pieces[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for k, docs_of in want.items():
        assert sum(len(x[1]) for x in pieces[k]) == sum(map(len, docs_of))
        if len(docs_of) == 1:
            assert b"".join(x[1] for x in sorted(pieces[k])) == docs_of[0] and {x[2] for x in pieces[k]} == {len(docs_of[0]) // 4}
    for parts in windows.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] <= packing.WINDOW
    if path == "docs":
        total = sum(r.length for r in rows)
        assert total / (len(windows) * packing.WINDOW) > 0.98


def test_differencing():
    rng = random.Random(3)
    for n, parts in ((1, 1), (5, 2), (40, 7), (384, 130)):
        sizes = [rng.randint(1, 2047) for _ in range(n)]
        at = packing.differencing(sizes, parts)
        sums = np.bincount(at, weights=sizes, minlength=parts)
        assert sums.sum() == sum(sizes) and at.max(initial=0) < parts
        if n >= 5 * parts:
            assert sums.max() - sums.min() < 200
        at, windows = packing.divide(sizes)
        assert np.bincount(at, weights=sizes, minlength=windows).max() <= 2048
    with pytest.raises(ValueError, match="exceeds"):
        packing.divide([3000])


def test_token_files(spark, docs, odd, tmp_path):
    e = Encoder(tokenizer_path())
    for df in (docs, odd):
        start, want = 0, []
        for k, t in sorted(texts_of(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
            ids = (e.whole(t) if t else b"") + np.array([2], "<u4").tobytes()
            want.append((k, start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
        folder, entries = tokenfile.write(df, tokenizer_path(), root=f"file://{tmp_path}", files=3)
        got = tokenfile.read(spark, folder, entries).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
        name = f"{folder.removeprefix('file://')}/part-{entries[0]['part']:06d}.arrow"
        with pa.memory_map(name) as source:
            file = tokenfile.TokenFile(source)
            ids, mask = file.sequence(0)
            assert len(ids) == len(mask) == tokenfile.LENGTH and ids.base is not None
            assert mask.sum() == min(tokenfile.LENGTH, entries[0]["n_tokens"])
            assert (file.ids(0, 5) == ids[:5]).all()


def test_media_round_trip(docs, odd):
    for df in (docs, odd):
        want = {}
        for k, t in texts_of(df):
            raw = (t or "").encode()
            p = media.padded(raw)
            m = media.encode(p)
            want[k, t] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest())
        got = media.media_report(df).collect()
        assert sorted([tuple(r)[1:7] for r in got]) == sorted(want[k, t] for k, t in texts_of(df))


def test_media_walks_other_files():
    one = media.encode(media.padded(b"x" * 20_000))
    track = media.parse(one)[0]
    assert (track.codec, track.handler, track.width, track.duration, len(track.keys)) == ("raw", "vide", 24, 35, 2)
    assert media.payload(one, track) == media.padded(b"x" * 20_000)
    moov = one.index(b"moov") - 4
    size = int.from_bytes(one[moov : moov + 4], "big")
    big = one[:moov] + (1).to_bytes(4, "big") + b"moov" + (size + 8).to_bytes(8, "big") + one[moov + 8 :]
    assert media.parse(big)[0].codec == "raw"  # a 64-bit size
    for bad in (one[:100], b"\0\0\0\4abcd", one[:moov] + one[moov : moov + 60]):
        with pytest.raises(ValueError, match="cut off|malformed"):
            media.parse(bad)
    assert media.parse(b"") == []


def _sized(media_file, old, new):
    """The file with a sample table replaced and all sizes around it (and places after it) mended."""
    at = media_file.index(old[4:8]) - 4
    assert media_file[at : at + len(old)] == old
    out, grown = bytearray(media_file[:at] + new + media_file[at + len(old) :]), len(new) - len(old)
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        where = media_file.index(kind) - 4
        out[where : where + 4] = (int.from_bytes(media_file[where : where + 4], "big") + grown).to_bytes(4, "big")
    where = out.index(b"stco") + 12
    for k in range(int.from_bytes(out[where - 4 : where], "big")):
        spot = where + 4 * k
        out[spot : spot + 4] = (int.from_bytes(out[spot : spot + 4], "big") + grown).to_bytes(4, "big")
    return bytes(out)


def test_media_compact_sizes():
    text = media.padded(b"abc" * 500)
    one = media.encode(text)
    at = one.index(b"stsz") - 4
    table = one[at : at + 20]
    wide = media._full(b"stz2", 0, bytes([0, 0, 0, 16]), (3).to_bytes(4, "big"), (576).to_bytes(2, "big") * 3)
    track = media.parse(_sized(one, table, wide))[0]
    assert track.sizes.tolist() == [576] * 3 and media.payload(_sized(one, table, wide), track) == text
    for bits, sizes, want in ((8, bytes([200, 100, 7]), [200, 100, 7]), (4, bytes([0x9F, 0x30]), [9, 15, 3])):
        small = media._full(b"stz2", 0, bytes([0, 0, 0, bits]), (3).to_bytes(4, "big"), sizes)
        track = media.parse(_sized(one, table, small))[0]
        assert track.sizes.tolist() == want and np.diff(track.offsets).tolist() == want[:2]
    for bad, why in ((media._full(b"stz2", 0, bytes([0, 0, 0, 5]), bytes(4)), "5 bits"), (media._full(b"stz2", 0, bytes([0, 0, 0, 16]), (3).to_bytes(4, "big"), b"ab"), "cut off")):
        with pytest.raises(ValueError, match=why):
            media.parse(_sized(one, table, bad))


def fragmented(parts, from_fragment=True):
    """A file whose samples lie in fragments: (sizes, durations or None, whether each is a keyframe) and their bytes."""
    import struct

    whole = media.encode(media.padded(b""))
    at = whole.index(b"moov") - 4
    old = whole[at:]
    empty = media._box(b"stbl", *(media._full(k, 0, bytes(4)) for k in (b"stts", b"stsc", b"stco")), media._full(b"stsz", 0, bytes(8)), old[old.index(b"stsd") - 4 :][: int.from_bytes(old[old.index(b"stsd") - 4 :][:4], "big")])
    mdhd = media._full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 25, 0, 0, 0))
    hdlr = media._full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"x\0")
    tkhd = media._full(b"tkhd", 3, struct.pack(">III", 0, 0, 7), bytes(68))
    trex = media._full(b"trex", 0, struct.pack(">IIIII", 7, 1, 2, 576, 0x10000))
    out = whole[:at] + media._box(b"moov", media._box(b"trak", tkhd, media._box(b"mdia", mdhd, hdlr, media._box(b"minf", empty))), media._box(b"mvex", trex))
    for sizes, durations, keys, payload in parts:
        flags = 0x1 | (0x200 if sizes else 0) | (0x100 if durations else 0) | 0x400
        n = len(keys)

        def moof(offset, sizes=sizes, durations=durations, keys=keys, flags=flags, n=n):
            rows = b"".join(b"".join(struct.pack(">I", x) for x in ([durations[k]] if durations else []) + ([sizes[k]] if sizes else []) + [0 if keys[k] else 0x10000]) for k in range(n))
            run = media._full(b"trun", flags, struct.pack(">Ii", n, offset), rows)
            head = media._full(b"tfhd", 0x20000, struct.pack(">I", 7)) if from_fragment else media._full(b"tfhd", 0x1, struct.pack(">IQ", 7, len(out)))
            return media._box(b"moof", media._full(b"mfhd", 0, bytes(4)), media._box(b"traf", head, run))

        size = len(moof(0))
        out += moof(size + 8) + media._box(b"mdat", payload)
    return out


@pytest.mark.parametrize("from_fragment", [True, False])
def test_media_fragments(spark, from_fragment):
    parts = [([3, 5, 2], [1, 1, 4], [True, False, True], b"aaabbbbbcc"), (None, None, [True], b"z" * 576)]
    whole = fragmented(parts, from_fragment)
    track = media.parse(whole)[0]
    assert track.sizes.tolist() == [3, 5, 2, 576] and track.keys.tolist() == [0, 2, 3] and track.duration == 8
    assert media.payload(whole, track) == b"aaabbbbbcc" + b"z" * 576
    rows = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[:-1])), (3, bytearray(whole.replace(b"tfhd", b"xxxx")))], "a int, media binary")
    found = {r.a: r.probe for r in media.probe(rows).collect()}
    assert found[1].samples == 4 and len(found[1].keyframes) == 3 and found[1].error is None
    assert "cut off" in found[2].error and "header" in found[3].error


def test_media_errors_are_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk that is no file")), (2, None)], "a int, media binary")
    assert [r.probe.error is not None for r in media.probe(df).collect()] == [True, True]


def test_sharding(spark, docs, odd):
    many = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)], "doc_id long, text string")
    for df in (docs, odd, many):
        rows = sharding.shard(df).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in texts_of(df))
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        assert {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32].add(r.shard)
    pairs = [s for c, s in shards.items() if c != zlib.crc32(b"same")]
    assert sum(len(s) > 1 for s in pairs) <= 0.08 * len(pairs)  # pairs stay together
    assert len(shards[zlib.crc32(b"same")]) == 8  # 1000 rows, shards of 125


def test_groups_stay_together(spark):
    """Each group is on no more shards than it needs, but for the few that no shard had room for."""
    rng = random.Random(11)
    sizes = [300, 130, 125, 126, 90, 70, *[rng.randint(2, 40) for _ in range(60)]]
    texts = [f"g{k}" for k, n in enumerate(sizes) for _ in range(n)]
    texts += [f"single {k}" for k in range(3001 - len(texts))]
    rng.shuffle(texts)
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    on = defaultdict(Counter)
    for r in rows:
        on[texts[r.doc_id]][r.shard] += 1
    groups = {t: c for t, c in on.items() if t[0] == "g"}
    over = {t: len(c) - -(-sum(c.values()) // 126) for t, c in groups.items()}
    assert sum(v > 0 for v in over.values()) <= 4 and max(over.values()) <= 1
    assert len(groups["g0"]) == 3 and len(groups["g1"]) == 2 and len(groups["g4"]) == 1
    counts = Counter(r.shard for r in rows)
    assert sorted(set(counts.values())) == [125, 126] and len(counts) == 24
    # Links that a shard's border cuts, against documents dealt at random.
    links = sum(n * (n - 1) // 2 for n in sizes)
    cut = links - sum(n * (n - 1) // 2 for c in groups.values() for n in c.values())
    assert cut < 0.35 * links and links * 23 / 24 > 2.5 * cut


def test_sharding_of_fewer_rows_than_shards(spark):
    for texts in (["a"] * 7, ["a", "a", "b"], [None] * 3 + [""] * 30):
        rows = sharding.shard(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == len(texts) and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    for j, s in enumerate(sets):
        for i in {i for x in s for i in held[x] if i < j}:
            both = len(s & sets[i])
            if den * both >= num * (len(s) + len(sets[i]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(k, least.get(r, k))
    return [(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def copies(spark):
    """Families of near copies at all degrees, short and long, with passages that many share."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for family in range(60):
        base = rng.choices(vocabulary, k=rng.choice([4, 7, 12, 20, 40, 66, 90, 130, 260, 600]))
        if family % 3 == 0:
            base = passage + base
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 60))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t).title() if rng.random() < 0.3 else " \n".join(t)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


@pytest.mark.parametrize("case", [("copies", 4, 85, 100), ("copies", 5, 80, 100), ("copies", 2, 50, 100), ("odd", 4, 85, 100), ("docs", 5, 80, 100)])
def test_ngram_join(case, request):
    name, width, num, den = case
    df = request.getfixturevalue(name)
    got = ngram_join.components(df, width, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(texts_of(df), width, num, den))


def test_ngram_oracle(spark):
    import duckdb

    from haulgrid.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLE_SQL['op6_ngram_join']})").fetchall()
    assert sorted(map(tuple, QUERIES["op6_ngram_join"](spark, DATA).collect())) == sorted(want)


def test_large_blocks_are_cut(spark, monkeypatch, copies):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    monkeypatch.setattr(ngram_join, "NEAREST", 1)
    got = ngram_join.components(copies, 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(texts_of(copies), 4, 85, 100))


def test_tree_pairs_are_all_within_the_bound():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.15, (90, 64)) + np.repeat(rng.poisson(3.0, (9, 64)), 10, axis=0)
    n = counts.sum(axis=1)
    got = {(min(a, b), max(a, b)) for i, j in ngram_join.tree_pairs(counts, n, 80, 100) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for j in range(90) for i in range(j) if n[i] * 100 >= 80 * n[j] and n[j] * 100 >= 80 * n[i] and np.minimum(counts[i], counts[j]).sum() * 180 >= 80 * (n[i] + n[j])}
    assert want and got == want


def test_one_of_each(copies, odd):
    kept = Counter(r.doc_id for r in ngram_join.one_of_each(copies).collect())
    assert kept == Counter({c for _, _, c in brute_components(texts_of(copies), 5, 80, 100)})
    rows = ngram_join.one_of_each(odd).collect()
    assert Counter(r.doc_id for r in rows if r.doc_id is not None) == Counter([1, 2, 3, 4, 5, 7, 8, 9]) and ngram_join.one_of_each(odd).columns == odd.columns


def test_one_of_each_by_text(spark):
    same, other, third = (" ".join(f"{w}{k}" for k in range(30)) for w in ("one", "two", "three"))
    rows = [(6, same), (6, other), (3, same), (None, same), (None, third), (None, third), (9, other + " more"), (9, other + " more"), (None, None), (8, None), (8, None), (7, same.upper())]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, same), (6, other), (None, third), (None, third), (None, None), (8, None)])


def test_leaks_against_brute_force(spark, docs):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in benchmark.collect()}
    want = {k for k, t in texts_of(docs) if any(" ".join(i) in " ".join(words(t)) for i in items.values())}
    assert {r.doc_id for r in decontaminate.leak_report(docs, benchmark).collect()} == want and want


def test_templates(spark):
    item = "In the old town of Arles a farmer sold 12 kg of apples for 30 dollars and then walked home again."
    other = "Yes. In the old town of Reims a farmer sold 15 km of apples for 99 euros and then walked home again. So it was."
    broken = "In the old town of Arles a farmer sold 12 kg of apples for 30 dollars; 12 or 13 trees stood there."
    benchmark = spark.createDataFrame([(1, item), (2, "short item of five"), (3, None), (4, ""), (None, item), (5, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    rows = [(1, item), (2, other), (3, item.upper()), (4, "nothing of the kind, at all, is to be found here in this text"), (5, None), (6, ""), (None, item), (7, "a short item of five words"), (8, broken), (9, "3 4 5 6 7 8 9 1 2"), (1, item)]
    got = {r.doc_id: r for r in decontaminate.leak_report(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert set(got) == {1, 2, 3, 7, 8}
    assert not got[1].changed and got[2].changed and got[2].items == "1" and got[7].items == "2"
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leak_report(spark.createDataFrame(rows, "doc_id long, text string"), empty).count() == 0
    assert decontaminate.leak_report(spark.createDataFrame([], "doc_id long, text string"), benchmark).count() == 0


NAMES = "Alice Bruno Carla Diego Elena Fabio Greta Henri Irene Jonas Karin Lukas".split()


def word_problem(rng, names, numbers):
    """Three sentences that begin with names, about numbers; the same parts in any wording that the generator chose."""
    a, b, c = names
    things = rng.choice(["red apples", "glass marbles", "paper boats", "wooden spoons"])
    place = rng.choice(["the village market", "a small harbour", "the old station"])
    return (
        f"{a} buys {numbers[0]} {things} at {place} early in the morning. {b} carries {numbers[1]} more of them home in a heavy basket. "
        f"{c} counts everything twice and gives {numbers[2]} of them back to {a} before dinner. How many {things} remain on the kitchen table?"
    )


def test_generated_items(spark):
    """Word problems with sentences opened by names, and items full of numbers: all verbatim ones and all changed ones are found."""
    rng = random.Random(6)
    items, rows, want = [], [], {}
    prose = lambda: " ".join(rng.choices("the river runs slowly past green hills while people walk along its quiet banks every summer".split(), k=30)).capitalize() + "."
    for k in range(40):
        seed, before, after = rng.random(), rng.sample(range(2, 99), 3), rng.sample(range(100, 999), 3)
        who = rng.sample(NAMES, 6)
        items.append((k, word_problem(random.Random(seed), who[:3], before)))
        rows.append((len(rows), f"{prose()} {items[-1][1]} {prose()}"))
        want[rows[-1][0]] = (k, False)
        if k % 2:
            rows.append((len(rows), f"{prose()} {word_problem(random.Random(seed), who[3:], after)} {prose()}"))
            want[rows[-1][0]] = (k, True)
    for k in range(40, 60):
        numbers = [str(x) for x in rng.sample(range(10, 999), rng.randint(4, 14))]
        items.append((k, rng.choice(["Compute", "Add up", "Evaluate now"]) + " " + " + ".join(numbers)))
        rows.append((len(rows), f"{prose()} {items[-1][1]} {prose()}"))
        want[rows[-1][0]] = (k, False)
    rows += [(1000 + k, prose() + " " + prose()) for k in range(40)]
    # Two different values of the item for one, and one for two: not the same question.
    a, b, c = NAMES[:3]
    rows.append((2000, word_problem(random.Random(1), (a, b, c), (7, 7, 7))))
    items.append((61, word_problem(random.Random(1), NAMES[3:6], (11, 12, 13))))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    # Items of the same wording are each other's variants; every document has its own item, verbatim or changed.
    for d, (k, changed) in want.items():
        assert any(r.doc_id == d and r.item_id == k and r.changed == changed for r in found), (d, k)
    assert {r.doc_id for r in found} <= set(want) | {2000} and not any(r.doc_id == 2000 and r.item_id == 61 for r in found)


def test_leaks_on_odd_input(spark, odd):
    """Nulls, empty and very long texts, repeated rows, clashing columns, on both sides."""
    clash = {c: F.lit("x") for c in ("id", "hash", "at", "width", "typed", "slots", "doc_id", "coverage", "run")}
    benchmark = spark.createDataFrame([(1, "the cat sat on the mat and ate the rat."), (1, "the cat sat on the mat and ate the rat."), (2, LONG), (3, None), (None, LONG), (4, "")], "item_id long, text string").withColumns(clash)
    got = decontaminate.leak_report(odd, benchmark).collect()
    assert {r.doc_id for r in got} == {5, 6, 7} and len(got) == 3
    assert decontaminate.leak_report(odd.limit(0), benchmark).count() == 0


def test_slots_must_be_consistent(spark):
    item = "every box holds 7 pens and each of those 7 pens costs as much as 9 small cups do"
    rows = [(1, item.replace("7", "5").replace("9", "4")), (2, item.replace("7", "5", 1))]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1} and found[0].changed


def brute_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans(docs):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab.@-+%1 2(4)5é_") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    fixed = ["4111 1111 1111 1111", "a@b", "a@b.c@d.e", "x@@y.z", ".@a.b", "999.1.1.1", "1.2.3.4.5.6.7.8", "+1 (988) 555-2485", "a@b.c.@d.e", "0004.1.1.0255"]
    for text in [*made, *fixed, *(t for _, t in texts_of(docs))]:
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_query(spark, docs):
    want = {}
    for k, t in texts_of(docs):
        s = brute_spans(t)
        want[k] = (*(sum(x[2] == kind for x in s) for kind in pii.KINDS), hashlib.sha256(",".join(f"{c}:{a}:{b}" for a, b, c in s).encode()).hexdigest())
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(docs).collect()}
    assert got == want


def test_revealing_terms(spark):
    rng = random.Random(2)
    other = "lorem ipsum dolor sit amet elit sed tempor magna aliqua".split()
    rows = []
    for i in range(100):
        filler = " ".join(rng.choices(other, k=8))
        rows.append((i, f"{filler} Zorbanek wrote from zed@mail.org {' '.join(rng.choices(other, k=6))}" if i < 8 else filler))
    rows += [(200, None), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (pii.TERMS, 2):  # terms that every task gets, and a join
        found = {r.term: r.action for r in pii.revealing_terms(df, most).collect()}
        assert found == {"zorbanek": "remove", "wrote": "remove", "from": "remove"}
        spans = {r.doc_id: r.spans for r in pii.find(df, most).collect()}
        assert "name:" in spans[0] and "email:" in spans[0] and spans[20] == spans[200] == ""
        clean = {r.doc_id: r.text for r in pii.sanitise(df, most).collect()}
        assert "Zorbanek" not in clean[0] and "[EMAIL]" in clean[0] and clean[20] == rows[20][1] and clean[200] is None


def brute_disclosures(rows):
    """(term, entity) to (share, bits), by the definition."""
    texts = [t or "" for _, t in rows]
    words = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", t)] for t in texts]
    around, holds = defaultdict(set), defaultdict(set)
    for d, t in enumerate(texts):
        spans = brute_spans(t)
        free = [w for w in words[d] if not any(a < w[1] and w[0] < b for a, b, _ in spans)]
        for a, b, kind in spans:
            entity = f"{kind}:{t[a:b]}"
            holds[entity].add(d)
            line = [w[2] for w in free if w[1] <= a] + [None] + [w[2] for w in free if w[0] >= b]
            middle = line.index(None)
            for k, w in enumerate(line):
                if w and abs(k - middle) <= 5:
                    around[w, entity].add(tuple(line[max(0, k - 2, middle - 7) : k]) + ("|",) + tuple(line[k + 1 : min(k + 3, middle + 8)]))
    having = defaultdict(set)
    for d, found in enumerate(words):
        for w in found:
            having[w[2]].add(d)
    out = {}
    for (term, entity), kinds in around.items():
        if len(kinds) >= 3:
            share = len(having[term] & holds[entity]) / len(having[term])
            out[term, entity] = (share, math.log2(share / (len(holds[entity]) / len(texts))))
    return out


@pytest.mark.parametrize("most", [pii.TERMS, 3])
def test_disclosure_by_documents(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "LIST", 2)
    rng = random.Random(8)
    pool = [f"{a}{b}" for a in ("kor", "lim", "nat") for b in ("ab", "ed", "os", "un")]
    some = lambda k: " ".join(rng.choices(pool, k=k))
    rows = []
    for i in range(100):  # one entity in all documents; a term in ten of them, two with another entity
        far = " ".join(["filler"] * 60)
        rows.append((i, f"{some(6)} all@where.org {some(5)}" + (f" {far} Quorten {some(1)} ab@two.org {some(2)} Quorten {some(4)} ab@two.org" if i < 2 else " Quorten" if i < 10 else "")))
    rows += [(100 + i, f"{some(4)} {rng.choice(['x@y.org', '10.0.0.1', 'zé@é.com, +1 (988) 555-2485'])} {some(4)} 10.0.0.1") for i in range(40)]
    rows += [(200, None), (201, ""), (0, rows[0][1])]
    got = {(r.term, r.entity): (r.share, r.bits) for r in pii.disclosures(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most).collect()}
    want = brute_disclosures(rows)
    assert set(got) == set(want) and want
    assert all(math.isclose(got[k][0], want[k][0]) and math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)
    assert got["quorten", "email:ab@two.org"][0] == 3 / 11
    everywhere = [v for (_, e), v in brute_disclosures([(i, f"{some(6)} all@where.org {some(5)}") for i in range(60)]).items() if e == "email:all@where.org"]
    assert everywhere and all(share == 1 and bits == 0 for share, bits in everywhere)


def test_sanitise_keeps_columns(odd):
    got = pii.sanitise(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert Counter(r.text for r in got.collect()) == Counter(r.text for r in odd.collect())


def test_parts_and_numbers_of_items(spark):
    sums = "Compute 12 + 35 + 48 + 7 and then 19 - 4"
    long = " ".join(f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so") for b in ("ban", "cor", "dus", "fel", "gim", "hov", "jat", "kep"))
    short = "a wooden bridge crosses the quiet stream behind our mill where grey herons wait for small silver fish to swim slowly past them at dusk"
    words = short.split()
    items = [(1, sums), (2, long), (3, short), (4, "Add 3 4 5")]
    rows = [(1, f"so {sums} gives"), (2, " ".join(long.split()[10:35])), (3, " ".join([*words[:12], "indeed", *words[12:]])), (4, "we add 3 4 5 here"), (5, "Compute 13 + 36 + 49 + 8 and then 20 - 5"), (6, " ".join(long.split()[:11])), (7, "add 4 5 6")]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k in (1, 2, 3, 4)} and not any(r.changed for r in found)


def lm_words(text):
    """The words as bytes in lower case, and whether each begins a sentence, by the definition."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    found = [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[0-9a-z\x80-\xff]+", raw)]
    return [w for w, _, _ in found], [k == 0 or any(c in b"\n\r!.:;?" for c in raw[found[k - 1][2] : at]) for k, (_, at, _) in enumerate(found)]


def brute_lm(model, texts):
    """(words, pll) of each text: each word's log-probability by plain loops over the model's parameters."""
    symbol = {b: int(lm_score._SYMBOL[b]) for b in range(256)}

    def ending(w):
        return symbol[w[-1]] * 165 + (symbol[w[-2]] if len(w) > 1 else 0)

    def spelt(w):
        cells, late, last = [], 0, 0
        for b in reversed(w):
            cells.append((late * 165 + last) * 165 + symbol[b])
            late, last = last, symbol[b]
        return sum(float(model.table[c]) for c in [*cells, (late * 165 + last) * 165])

    def class_of(w):
        return int(lm_score.class_of(np.array([ending(w)]))[0])

    def id_of(w):
        spot = np.flatnonzero(model.known.hashes == lm_score.signed(lm_score._listed([w]).hashes)[0])
        return int(model.known.ids[spot[0]]) if len(spot) else class_of(w) * 64

    def soft(z, k):
        return float(z[k] - z.max() - np.log(np.exp(z - z.max()).sum()))

    embed, place, top, leaf, top0, leaf0 = (x.astype(np.float64) for x in model.net)
    sentences, held = Counter(), []
    for t in texts:
        w, first = lm_words(t)
        ids, parts = [id_of(x) for x in w], []
        for k in range(len(w)):
            if first[k] or len(parts[-1]) == 32:
                parts.append([])
            parts[-1].append(k)
        logs = []
        for k, i in enumerate(ids):
            window = [ids[k + o] if 0 <= k + o < len(ids) else 4096 for o in (-2, -1, 1, 2)]
            h = np.tanh(sum(embed[x] * place[n] for n, x in enumerate(window)))
            value = soft(h @ top + top0, i // 64) + soft(h @ leaf[i // 64] + leaf0[i // 64], i % 64)
            logs.append(value + (spelt(w[k]) - float(model.masses[i // 64]) if i % 64 == 0 else 0.0))
        held.append((logs, [[tuple(w[k] for k in p), p] for p in parts]))
        sentences.update(s for s, _ in held[-1][1])
    out = []
    for logs, parts in held:
        total = 0.0
        for s, p in parts:
            weight = 0.0 if len(s) < 4 else {1: 0.0, 2: 1 / 2}.get(sentences[s], 2 / 3)
            total += sum(math.log(weight + (1 - weight) * math.exp(logs[k])) for k in p)
        out.append((len(logs), total))
    return out


def test_lm_scores_against_brute_force(spark, docs, odd, tmp_path):
    long = " ".join(f"wort{k % 7}" for k in range(70))
    extra = ["Same line of words here. Another one that stands alone", "same LINE of words here! And so on", "same line, of words here?", "zzqna vvkng", "cabana rambling", long, long + " end", "a", "a.b.c d e f g", None, ""]
    for df in (spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts_of(docs)[:25])] + [(1, t) for t in extra], "doc_id long, text string").repartition(3), odd):
        model = lm_score.learn(df, Scratch(spark, "test"))
        texts = texts_of(df)
        got = lm_score._scored(df, model, Scratch(spark, "test")).collect()
        want = brute_lm(model, [t for _, t in texts])
        assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((k or 0, n) for (k, _), (n, _) in zip(texts, want, strict=True))
        assert np.allclose(sorted(r.pll for r in got), sorted(x for _, x in want), rtol=2e-4, atol=2e-2)
        assert all((r.score is None) == (r.n_tokens == 0) and (r.score is None or math.isclose(r.score, r.pll / r.n_tokens)) for r in got)


def test_lm_probabilities_add_up():
    """Over all words of a class: its leaves, and all spellings that can be (of three bytes at most, the rest is under 1)."""
    rng = np.random.default_rng(3)
    counts = np.zeros(lm_score.SYMBOLS**3, np.int64)
    words = [bytes(rng.choice(list(b"abc"), rng.integers(1, 4))) for _ in range(4000)]
    found = lm_score._listed(words)
    cells, n = np.unique(np.concatenate([found.spellings()[0][found.symbol[: len(found.after)] > 0], found.spellings()[1]]), return_counts=True)
    counts[cells] = n
    leaves = [b"abc", b"cab", b"a"]
    ids = lm_score.class_of(lm_score._listed(leaves).ending) * 64 + 1
    model = lm_score.Model(lm_score.Vocabulary(lm_score.signed(lm_score._listed(leaves).hashes), ids), lm_score.fresh(np.full(4096, 1 / 4096)), counts * 1000, leaves)
    every = [bytes(x) for n in (1, 2, 3) for x in __import__("itertools").product(b"abc", repeat=n)]
    rare = [w for w in every if w not in leaves]
    found = lm_score._listed(rare)
    kinds = lm_score.class_of(found.ending)
    p = np.exp(lm_score._spelling_logs(model.table, found) - model.masses[kinds])
    sums = np.bincount(kinds, weights=p, minlength=64)[np.unique(kinds)]
    assert (sums < 1.0001).all() and (sums > 0.98).all()


def test_lm_learns_words_and_neighbours(spark):
    """Held-out text: better than each word's share of the corpus, and than the class network that stood here before."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    counts = lm_score.word_counts(df.where(~held))
    known, share = lm_score.vocabulary(counts)
    model = lm_score.learn(df.where(~held), Scratch(spark, "test"))
    total = alone = n = 0
    for _, t in texts_of(df.where(held)):
        data = np.frombuffer(t.encode(), np.uint8)
        found = lm_score.Words(data, np.array([0, len(data)]))
        ids = known.of(found)
        logs = model.logs(found)
        net = lm_score.predict(model.net, lm_score.windows(ids, found.at), ids)
        total, alone, n = total + net.sum(), alone + np.log(share[ids]).sum(), n + len(ids)
        assert np.isfinite(logs).all()
    assert n > 10_000 and total / n > alone / n + 0.3


def test_lm_tells_texts_apart(spark, docs):
    rows = [(k, t) for k, t in texts_of(docs) if t and len(t.split()) > 30][:60]
    twice = rows[:10]
    rows += [(1000 + k, t) for k, t in twice]  # occur twice in the corpus
    rows += [(5000, "zzqna vvkng"), (5001, "cabana rambling")]
    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = sorted(got[k] for k, _ in rows[10:60])
    assert sum(got[k] > once[45] for k, _ in twice) >= 9 and all(math.isclose(got[k], got[k + 1000], rel_tol=1e-6) for k, _ in twice)
    assert abs(got[5000] - got[5001]) > 0.01


def test_lm_hashes_are_those_of_word_hashes():
    """Those of a chunk come from running sums over its bytes, those of a longer text from word_hashes itself."""
    from haulgrid.llm.textbytes import LOWER, word_hashes

    rng = np.random.default_rng(7)
    for data in (rng.integers(0, 256, 5000), np.full(3000, 97), np.zeros(0), np.frombuffer(b"Ab aB ab" * 200_000, np.uint8)):
        data = data.astype(np.uint8)
        found = lm_score.Words(data, np.array([0, len(data) // 3, len(data)]))
        assert (found.hashes == word_hashes(LOWER[data], found.starts, found.ends)).all()
        assert all((found.hashes[k] == lm_score._listed([data[found.starts[k] : found.ends[k]].tobytes()]).hashes).all() for k in range(min(50, len(found.starts))))


def test_lm_runs_hold_each_word_once():
    """Every word stands once in the middle of a run, between its neighbours; little is laid out twice (it was four times)."""
    rng = np.random.default_rng(5)
    for sizes in ([], [0, 0], [1], [0, 3, 0, 0, 700, 1, 2, 0], [1] * 50, [5000], list(rng.integers(0, 60, 300))):
        at = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        ids = rng.integers(0, 4096, at[-1])
        runs, got = lm_score.windows(ids, at), []
        for run in runs:
            got += [tuple(run[k : k + 5]) for k in range(len(run) - 4) if run[k + 2] != lm_score.BORDER]
        want = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            text = [4096, 4096, *ids[a:b], 4096, 4096]
            want += [tuple(text[k : k + 5]) for k in range(b - a)]
        assert got == want
        assert np.asarray(runs).size <= 1.3 * (len(ids) + 2 * np.count_nonzero(sizes)) + 40
        assert len(lm_score.predict(lm_score.fresh(np.full(4096, 1 / 4096)), runs, ids)) == len(ids)


def test_lm_step_follows_the_gradient():
    """One step's squared gradients and moves, against differences of the loss by plain loops."""
    rng = np.random.default_rng(6)
    at = np.array([0, 1, 1, 9, 40, 42])
    ids = rng.choice([0, 1, 64, 65, 66, 130, 4095], 42)
    for scale in (1.0, 60.0):  # small layers, and such as would overflow
        net = [x.astype(np.float32) for x in lm_score.fresh(np.full(4096, 1 / 4096))]
        net[1] += rng.normal(0, 0.2, net[1].shape).astype(np.float32)
        net[4] *= np.float32(scale)
        net[4][1] += np.float32(scale - 1)

        def loss(net):
            total = 0.0
            for a, b in zip(at[:-1], at[1:], strict=True):
                text = [4096, 4096, *ids[a:b], 4096, 4096]
                for k in range(b - a):
                    h = np.tanh(sum(net[0][text[k + o]] * net[1][n] for n, o in enumerate((0, 1, 3, 4))))
                    c, leaf = divmod(text[k + 2], 64)
                    for z, own in ((h @ net[2] + net[4], c), (h @ net[3][c] + net[5][c], leaf)):
                        total -= z[own] - z.max() - np.log(np.exp(z - z.max()).sum())
            return total / len(ids)

        spots = [(0, (4096, 3)), (0, (64, 0)), (0, (130, 7)), (0, (77, 1)), (1, (0, 2)), (1, (3, 5)), (2, (4, 1)), (2, (9, 63)), (3, (1, 5, 2)), (3, (0, 2, 0)), (3, (63, 1, 63)), (4, (1,)), (5, (1, 2)), (5, (30, 2))]
        slopes = []
        for part, spot in spots:
            sides = []
            for by in (1e-4, -1e-4):
                moved = [x.astype(np.float64) for x in net]
                moved[part][spot] += by
                sides.append(loss(moved))
            slopes.append((sides[0] - sides[1]) / 2e-4)
        before, past = [x.copy() for x in net], [np.full(x.shape, 1e-7, np.float32) for x in net]
        lm_score.fit(net, past, lm_score.windows(ids, at))
        assert sum(abs(x) > 1e-4 for x in slopes) >= 10
        for (part, spot), slope in zip(spots, slopes, strict=True):
            assert math.isclose(past[part][spot], 1e-7 + slope * slope, rel_tol=2e-2, abs_tol=2e-9), (part, spot)
            want = -lm_score.RATE * slope / (math.sqrt(1e-7 + slope * slope) + 1e-6)
            assert math.isclose(net[part][spot] - before[part][spot], want, rel_tol=2e-2, abs_tol=1e-4), (part, spot)


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_report(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    for r in got[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_learned_counts(spark):
    """Scores of words by plain counts of trigrams, words and scripts."""
    rng = random.Random(12)
    texts = [(" ".join("".join(rng.choice("abcdeäé") for _ in range(rng.randint(1, 6))) for _ in range(30)), rng.choice(["x", "y", "z"])) for _ in range(60)]
    df = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([*texts, (None, "x"), ("abc", None), ("", "w")])], "doc_id long, text string, lang string").repartition(3)
    langs, trigram, word, scripts = langid.learn(df)
    assert langs == ["w", "x", "y", "z"]
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    bucket = lambda a, b, c: ((a * 0x1F35 + b) * 0x2F0B + c * 0x61C9 + (b << 7)) % 65521
    counts = {g: Counter() for g in langs}
    for t, g in texts:
        for w in low(t).split():
            counts[g].update(bucket(a, b, c) for a, b, c in zip(b"\0" + w, w, w[1:] + b"\0", strict=False))
    for cell in {c for g in langs for c in counts[g]}:
        logs = [math.log((counts[g][cell] + 0.5) / (sum(counts[g].values()) + 0.5 * 65536)) for g in langs]
        assert np.allclose(trigram[cell], np.array(logs) - max(logs), atol=1e-5)
    assert scripts[0].tolist() == [-12.0, 0.0, 0.0, 0.0]


def test_many_labels(spark, monkeypatch):
    """Labels beyond those that are learned: the most frequent ones are."""
    monkeypatch.setattr(langid, "LANGS", 3)
    monkeypatch.setattr(langid, "HELD", 1)
    rows = [(k, f"{g} " * 5, g) for k, g in enumerate(["aa"] * 5 + ["bb"] * 4 + ["cc"] * 3 + [f"d{x}" for x in "efghij"])]
    assert langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))[0] == ["aa", "bb", "cc"]


def test_language_spans(spark):
    one, two = "the house of the king and the river is near the town where they lived", "la casa del rey y el río está cerca de la ciudad donde ellos vivían"
    learned = [(i, " ".join(random.Random(i).sample(s.split(), 10)), lang) for i in range(80) for s, lang in ((one, "en"), (two, "es"), ("дом короля и река рядом с городом где они жили вместе", "ru"))]
    model = langid.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    rows = [(1, f"{one} {one} {two} {two} {two}"), (2, "города реки"), (3, None), (4, "123 !"), (5, "king"), (6, "Kª")]
    got = {r.doc_id: r for r in langid.detect(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "es"] and got[1].lang_pred == "es" and 0.5 < got[1].score < 1
    assert got[2].lang_pred == "ru" and got[3].lang_pred == got[4].lang_pred == "und" and got[4].score == 0
    assert got[5].lang_pred == "en" and got[6].lang_pred in ("en", "es", "ru")
    none = langid.detect(spark.createDataFrame(rows, "doc_id long, text string"), langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_label_is_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.normal(0, 3, (rng.integers(1, 60), 3))
        scores[:: rng.integers(1, 9)] += rng.normal(0, 6, 3)
        path = langid.label(scores, 8.0)
        cost = lambda p: scores[np.arange(len(p)), p].sum() - 8.0 * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert math.isclose(cost(path), cost(langid.viterbi(scores, 8.0)), abs_tol=1e-6)


def test_label_of_two_languages_beside_the_best():
    one = np.array([0.0] * 3 + [-12.0] * 3)
    scores = np.stack([one, one[::-1], np.full(6, -5.0)], axis=1)
    assert langid.label(scores, 20.0).tolist() == langid.viterbi(scores, 20.0).tolist() == [0] * 3 + [1] * 3


def brute_urls(rows, labels):
    """page_id to (host, path, rule, verdict), from the rules and the tree of all segments as described."""
    pages, leaf = {}, defaultdict(lambda: [0, 0, 0])
    for k, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        kind = lambda x: "<n>" if re.fullmatch("[0-9]+", x) else re.sub("^[0-9]+", "<n>", x) if re.fullmatch("[0-9]+[.][a-z]+", x) else "<h>" if re.fullmatch("[0-9a-f]{8,}", x) else x
        key = (host, tuple(kind(x) for x in path.split("/") if x))
        bad = labels.get(k)
        for n, v in enumerate((1, bad is not None, bad or 0)):
            leaf[key][n] += v
        fits = [(h + p, a) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        pages[k] = (host, path, max(fits, key=lambda x: len(x[0]), default=(None, None)), key)
    template, deepest = {}, 0

    def descend(node, leaves, level):
        """Names the children of a node, from the root down."""
        nonlocal deepest
        deepest = max(deepest, level)
        kids = defaultdict(list)
        for x in leaves:
            kids[x[1][level - 1] if len(x[1]) >= level else ""].append(x)
        total = sum(leaf[x][0] for x in leaves)
        named = defaultdict(list)
        for child, own in kids.items():
            rare = child and len(set(kids) - {""}) > 32 and sum(leaf[x][0] for x in own) * 32 < total
            named["*" if rare else child] += own
        for name, own in named.items():
            if name == "":
                template.update({x: node for x in own})
            elif len(own) == 1:
                template[own[0]] = (*node, name, *own[0][1][level:])
            else:
                descend((*node, name), own, level + 1)

    for host in {h for h, _ in leaf}:
        descend((), [x for x in leaf if x[0] == host], 1)
    group = defaultdict(lambda: [0, 0, True])
    for x, v in leaf.items():
        g = group[x[0], template[x]]
        g[0] += v[1]
        g[1] += v[2]
    for level in range(deepest, 0, -1):
        branches = defaultdict(list)
        for (host, t), v in group.items():
            if v[2] and len(t) >= level - 1:
                branches[host, t[: level - 1], t[:level]].append(v)
        parents = defaultdict(list)
        for (host, parent, _), held in branches.items():
            parents[host, parent].append((max(v[0] for v in held), max(v[1] for v in held), held))
        for of in parents.values():
            p = (sum(b for _, b, _ in of) + 1) / (sum(a for a, _, _ in of) + 2)
            like = [a == 0 or abs(b / a - p) <= 1.96 * math.sqrt(p * (1 - p) / a) for a, b, _ in of]
            sums = [sum(x[k] for x, y in zip(of, like, strict=True) if y) for k in (0, 1)]
            for (_, _, held), y in zip(of, like, strict=True):
                for v in held:
                    v[:] = [*sums, True] if y else [v[0], v[1], False]
    known = [v for k, v in labels.items() if k in pages and v is not None]
    prior = sum(known) / len(known) if known else 0.0
    out = {}
    for k, (host, path, (rule, action), key) in pages.items():
        a, b, _ = group[host, template[key]]
        out[k] = (host, path, rule, action or ("block" if (b + 10 * prior) / (a + 10) >= 0.5 else "allow"))
    return out


def test_url_filter(spark):
    rng = random.Random(9)
    rows, labels = [], {}
    for k in range(1500):
        host = rng.choice(["a.org", "B.net", "www.example.com", "x.example.com", "q.com", "spam.org"])
        path = rng.choice([f"/en/{k}", f"/es/{k}.html", f"/tag/{rng.randint(0, 400)}x/p", f"/fr/{k}/", "/a/b/c/d/e", "", f"/{k:08x}"])
        rows.append((k, rng.choice(["http://", "https://"]) + host + path + rng.choice(["", "?q=://x/y", "#z"])))
        if rng.random() < 0.5:
            labels[k] = int(rng.random() < (0.9 if host == "spam.org" or "/tag/" in path and host == "a.org" else 0.1))
    rows += [(9001, None), (9002, "no scheme"), (9003, "://"), (9004, "http://EXAMPLE.com/en/"), (9005, "http://example.com"), (9006, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "bad": F.lit("x"), "s1": F.lit(2)}).repartition(4)
    known = spark.createDataFrame(list(labels.items()), "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, known).collect()}
    want = brute_urls(rows, labels)
    assert got == want and {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}
    assert urlfilter.judge(pages.limit(0), known).count() == 0 and urlfilter.judge(pages, known.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_url_tree_against_brute_force(spark):
    """Random trees of up to nine segments, with bad branches at all depths; a very long url, nulls, repeats, clashing columns."""
    rng = random.Random(21)
    rows, labels = [], {}
    for k in range(1200):
        path = [rng.choice("ab") for _ in range(rng.randint(0, 7))] + rng.choice([[f"{k}.html"], [str(k)], [], [f"{k:09x}"], [f"p{rng.randint(0, 60)}"]])
        rows.append((k, f"http://{rng.choice(['h.org', 'i.org'])}/" + "/".join(path)))
        if rng.random() < 0.7:
            labels[k] = int(rng.random() < (0.95 if path[:4] == ["a", "b", "b", "a"] or path[:2] == ["b", "b"] else 0.15))
    rows += [(5000, "http://h.org/" + "/".join(f"s{i}" for i in range(3000))), (5001, None), (5002, "x" * 200_000), (5003, "http://h.org//a///b//")]
    clash = {c: F.lit("x") for c in ("s", "t", "n", "bad", "child", "own", "open", "rule", "verdict", "template", "_rule", "level")}
    pages = spark.createDataFrame([*rows, rows[3], (None, rows[4][1])], "page_id long, url string").withColumns(clash).repartition(3)
    known = spark.createDataFrame(list(labels.items()), "page_id long, bad int")
    got = urlfilter.judge(pages, known).collect()
    assert Counter(r.page_id for r in got) == Counter([k for k, _ in rows] + [3, None])
    want = brute_urls([*rows, (-3, rows[3][1]), (-4, rows[4][1])], labels | {-3: labels.get(3)})
    assert all((r.host, r.path, r.rule, r.verdict) == want[-4 if r.page_id is None else r.page_id] for r in got)
    assert {"allow", "block"} == {r.verdict for r in got}


def test_url_branches_at_any_depth(spark):
    rows, labels, want = [], {}, {}
    for k in range(240):
        at = ("en/2024/01/casino/{}.html", "en/2024/01/news/{}.html", "a/b/c/d/e/spam/f/{}", "a/b/c/d/e/fine/f/{}")[k % 4]
        rows.append((k, f"https://h.org/{at.format(k)}"))
        want[k] = "block" if k % 2 == 0 else "allow"
        if k < 160:
            labels[k] = int(k % 2 == 0)
    rows.append((999, "https://h.org/" + "/".join(f"s{i}" for i in range(400))))  # a long path alone is no level more
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, bad int"))
    got = {r.page_id: r for r in found.collect()}
    assert {k: got[k].verdict for k in want} == want and len(got) == 241
    assert got[0].template == "en/<n>/<n>/casino/<n>.html" and got[2].template == "a/b/c/d/e/spam/f/<n>"


def test_url_query(spark):
    pages, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("pages", "labels"))
    quality = {r.doc_id: int(r.quality == 0) for r in labels.collect()}
    rows = [(r.page_id, r.url) for r in pages.collect()]
    known = {k: quality[int(m[1])] for k, u in rows if (m := re.search(r"/([0-9]+)(?:[.][a-z]+)?/?(?:[?#].*)?$", u)) and int(m[1]) in quality}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op9_url_templates"](spark, DATA).collect()}
    assert got == brute_urls(rows, known)
