"""Personal data: patterns, and terms that reveal what they protect.

The base patterns find emails, addresses of machines, cards and phones. Their values are the protected entities. A
term that stands near an entity, over and over in different surroundings, and hardly anywhere else, discloses it
although no pattern matches. All probabilities are shares of documents:

    p(entity | term) = documents with both / documents with the term,  p(entity) = documents with the entity / all
    disclosure in bits = log2 p(entity | term) / p(entity)

Terms over the thresholds of share and bits are removed or, if less certain, generalised.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.scratch import Scratch, in_arrow

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that are its context, and on each side of a term that tell surroundings apart.
CONTEXT, AROUND = 5, 2
#: Different surroundings in which a term must meet an entity; share of its documents that hold the entity, from which
#: it is generalised or removed; bits it must give away.
SUPPORT, GENERALISE, REMOVE, BITS = 3, 0.8, 0.95, 3.0
#: Terms, or pairs of them with entities, that every task gets whole, some 20 MB; more are joined by a shuffle.
TERMS = 200_000
#: Different words that a task counts before it hands them on; terms of an entity that are looked for at once.
HELD, LIST = 300_000, 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, str]


def _emails(text: str) -> list[Span]:
    """As the pattern's leftmost matches: a local part is all that can stand before an @, after the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points by the base patterns, by start, then kind as listed."""
    out = _emails(text) if "@" in text else []
    if _DIGITS.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(ch.isdigit() for ch in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _words(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def _contexts(text: str, spans: list[Span]) -> set[tuple[str, str, int]]:
    """(entity, term, surroundings) of the words near each entity that are in no entity themselves."""
    found, end, k = [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            end, k = max(end, spans[k][1]), k + 1
        if m.start() >= end:
            found.append(m)
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    out, reach = set(), CONTEXT + AROUND
    for start, end, kind in spans:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        line = [m.group().lower() for m in found[max(0, before - reach) : before]] + [""] + [m.group().lower() for m in found[after : after + reach]]
        middle = line.index("")
        for k, term in enumerate(line):
            if term and abs(k - middle) <= CONTEXT:
                around = "\0".join(line[max(0, k - AROUND) : k] + ["\1"] + line[k + 1 : k + 1 + AROUND])
                out.add((f"{kind}:{text[start:end]}", term, int.from_bytes(hashlib.blake2b(around.encode(), digest_size=8).digest(), "little", signed=True)))
    return out


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def entity_documents(docs: DataFrame) -> DataFrame:
    """entities, words (each once) and near (entity, term, around) of each document that has an entity."""
    schema = "entities array<string>, words array<string>, near array<struct<entity:string,term:string,around:long>>"
    kind = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("around", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text in batch.column(1):
                t = text.as_py() or ""
                if "@" not in t and not _DIGITS.search(t):
                    continue
                spans = base_spans(t)
                if spans:
                    near = [dict(zip(("entity", "term", "around"), x, strict=True)) for x in sorted(_contexts(t, spans))]
                    for column, value in zip(rows, (sorted({f"{k}:{t[a:b]}" for a, b, k in spans}), sorted(_words(t)), near), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.list_(pa.string())), pa.array(rows[1], pa.list_(pa.string())), pa.array(rows[2], kind)], ["entities", "words", "near"])

    return _source(docs).transform(in_arrow, run, schema)


def document_counts(docs: DataFrame, terms: DataFrame, most: int = TERMS) -> DataFrame:
    """term, documents: of all documents, how many hold each term (one row each). One pass, whatever their number."""
    wanted = frozenset(r.term for r in terms.collect()) if terms.count() <= most else None

    def run(batches):
        counts: dict[str, int] = {}

        def counted():
            rows = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "documents"])
            counts.clear()
            return rows

        for batch in batches:
            for text in batch.column(1):
                found = _words(text.as_py() or "")
                for term in found if wanted is None else wanted.intersection(found):
                    counts[term] = counts.get(term, 0) + 1
                if len(counts) > HELD:
                    yield counted()
        yield counted()

    found = _source(docs).transform(in_arrow, run, "term string, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))
    return found if wanted is not None else found.join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, most: int = TERMS) -> DataFrame:
    """term, entity, share (p(entity | term)) and bits of all pairs that meet in SUPPORT different surroundings."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.table(entity_documents(docs), "entities", from_scan=True)
    near = found.select(F.explode("near").alias("n")).select("n.*").groupBy("entity", "term", "around").agg(F.count("*"))
    pairs = scratch.table(near.groupBy("entity", "term").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= SUPPORT).select("entity", "term"), "pairs")
    count = pairs.count()
    if not count:
        return docs.sparkSession.createDataFrame([], "term string, entity string, share double, bits double")
    bounded = F.broadcast if count <= most else lambda df: df
    # Documents with both, of those that have an entity; an entity's terms are looked for some at a time.
    lots = pairs.groupBy("entity").agg(F.ceil(F.count("*") / LIST).alias("lots"))
    lists = pairs.join(lots, "entity").groupBy("entity", F.pmod(F.xxhash64("term"), F.col("lots")).alias("lot")).agg(F.collect_list("term").alias("terms"))
    each = found.select(F.explode("entities").alias("entity"), "words").join(bounded(lists), "entity")
    both = each.select("entity", F.explode(F.array_intersect("words", "terms")).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    counts = scratch.table(document_counts(docs, scratch.table(pairs.select("term").distinct(), "terms"), most), "counts")
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("holding")).join(bounded(pairs.select("entity").distinct()), "entity", "left_semi")
    rows = scratch.table(both, "both").join(bounded(counts), "term").join(bounded(entities), "entity")
    share = F.col("both") / F.col("documents")
    return rows.select("term", "entity", share.alias("share"), F.log2(share / (F.col("holding") / F.lit(float(docs.count())))).alias("bits"))


def revealing_terms(docs: DataFrame, most: int = TERMS) -> DataFrame:
    """term, entity, share, bits and action (generalise or remove) of the terms over the thresholds."""
    found = disclosures(docs, most).where((F.col("share") >= GENERALISE) & (F.col("bits") >= BITS))
    return Scratch(docs.sparkSession, "pii").table(found.withColumn("action", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise")), "revealing")


def all_spans(text: str, terms: dict[str, str]) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: a revealing term is ``term`` (generalised) or ``name`` (removed)."""
    base = base_spans(text)
    if not terms:
        return base, base
    more = [(*m.span(), "name" if terms[w] == "remove" else "term") for m in _WORD.finditer(text) if (w := m.group().lower()) in terms]
    order = (*KINDS, "name", "term")
    return base, sorted(base + more, key=lambda s: (s[0], order.index(s[2]), s[1]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, named by the first."""
    out, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            out += [text[end:start], "" if kind == "name" else f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def _with_terms(docs: DataFrame, terms: DataFrame, most: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with one more column, the last (its revealing terms and their actions), and the terms that hold for all rows.

    Up to ``most`` terms go to every task. More are joined with the words of the texts, in one pass, and come back by text.
    """
    found = terms.groupBy("term").agg(F.max("action").alias("action"))
    name = "_terms"
    while name in docs.columns:
        name += "_"
    if found.count() <= most:
        return docs.withColumn(name, F.lit(None).cast("map<string,string>")), {t: a for t, a in found.collect()}

    def run(batches):
        for batch in batches:
            rows = [(a.as_py(), b.as_py(), w) for a, b, text in zip(*batch.columns, strict=True) for w in _words(text.as_py())]
            for lo in range(0, len(rows), 1 << 16):
                columns = zip(*rows[lo : lo + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["k1", "k2", "term"])

    text = F.col("text").cast("string")
    keys = (F.xxhash64(text), F.xxhash64(text, F.lit(1)))
    words = docs.where("text is not null").select(keys[0].alias("k1"), keys[1].alias("k2"), text.alias("text")).transform(in_arrow, run, "k1 long, k2 long, term string")
    maps = words.join(found, "term").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias(name))
    maps = Scratch(docs.sparkSession, "pii").table(maps, "maps")
    return docs.join(maps, (keys[0] == maps["k1"]) & (keys[1] == maps["k2"]), "left").select(*[docs[f"`{c}`"] for c in docs.columns], maps[name]), {}


def find(docs: DataFrame, most: int = TERMS) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and spans (all of them, in code points) of each row.

    A null text is empty and has no spans. Repeated rows are each returned; a null doc_id stays null; an empty table
    gives no rows; other columns are ignored.
    """
    source = _source(docs)
    marked, common = _with_terms(source, revealing_terms(docs, most), most)

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                base, spans = all_spans(text.as_py() or "", common or dict(own.as_py() or []))
                kinds = [s[2] for s in base]
                for column, value in zip(rows, (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                    column.append(value)
            kind = [*[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, kind, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return marked.transform(in_arrow, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitise(docs: DataFrame, most: int = TERMS) -> DataFrame:
    """``docs`` with its text sanitised; all other columns, and a null text, as they are; an empty table stays empty.

    Repeated rows, and rows without a doc_id, are each returned.
    """
    marked, common = _with_terms(docs, revealing_terms(docs, most), most)
    at, terms_at = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = []
            for text, own in zip(batch.column(at), batch.column(terms_at), strict=True):
                t = text.as_py()
                texts.append(None if t is None else redacted(t, all_spans(t, common or dict(own.as_py() or []))[1]))
            columns = batch.columns[:terms_at]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:terms_at])

    return marked.transform(in_arrow, run, docs.schema)
