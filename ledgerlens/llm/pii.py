"""PII: pattern spans, plus information-theoretic sanitisation of the terms that stand with them.

Patterns find the protected entities.  Over the corpus, the words of the documents that hold an entity are counted: a term t
reveals entity e by the share PMI(t, e) / IC(e) of the entity's information, with p(e), p(t), p(e|t) estimated from
document counts over all documents.  Terms above the removal threshold are removed, terms above the generalisation
threshold are replaced by their class.  A term must have been seen with the entity in several distinct contexts, so
copies of one passage are no evidence.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, small_batches, stored, values

KINDS = ("email", "ip", "card", "phone")
ADDED = ("remove", "generalise")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": "", "generalise": "[TERM]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a start inside a run of digits can only match where the start of the run does: the look-behind saves those attempts
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def _emails(text: str):
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the @ signs in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the pattern kinds, by kind and start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    first = _DIGIT.search(text)
    if first:
        at = first.start()
        for m in _IP.finditer(text, at):
            if all(len(p := part.lstrip("0")) < 4 and (not p or int(p) <= 255) for part in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text, at):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _entity(text: str, kind: int, a: int, b: int) -> int:
    value = text[a:b].lower() if kind == 0 else re.sub(r"[^0-9.]", "", text[a:b])
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{value}") - (1 << 63)


def _term(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _words(text: str, spans) -> list[tuple[str, int, int]]:
    """(lower-case word, start, end) of the words of the text that no span overlaps."""
    taken, out, i, reach = sorted((a, b) for _, a, b in spans), [], 0, 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][1])
            i += 1
        if m.start() >= reach:
            out.append((m.group().lower(), m.start(), m.end()))
    return out


def _evidence(text: str, spans, words: int, chars: int):
    """The entities of a text, each with the hash of the words around its mentions, and its distinct terms, each with
    the hash of the words around its first occurrence."""
    around: dict[int, set[str]] = {}
    taken = sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        lo, hi = max(0, a - chars), min(len(text), b + chars)
        left = [m for m in _WORD.finditer(text, lo, a) if m.start() > lo or lo == 0][-words:]
        right = [m for m in _WORD.finditer(text, b, hi) if m.end() < hi or hi == len(text)][:words]
        first, last = bisect.bisect_left(taken, (lo - chars, 0)), bisect.bisect_left(taken, (hi, 0))
        near = [m.group().lower() for m in left + right
                if not any(x < m.end() and m.start() < y for x, y in taken[first:last])]
        around.setdefault(_entity(text, kind, a, b), set()).add("\x1f".join(near))
    entities = [(e, _term("\x1e".join(sorted(c)))) for e, c in around.items()]
    every, terms = [w for w, _, _ in _words(text, spans)], {}
    for i, w in enumerate(every):
        if w not in terms:
            terms[w] = _term("\x1f".join(every[max(0, i - words):i + words + 1]))
    return entities, [(_term(w), c) for w, c in terms.items()]


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SEEN = pa.list_(pa.struct([("hash", pa.int64()), ("context", pa.int64())]))
_HITS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_SEEN_TYPE = "array<struct<hash:long,context:long>>"
_SPAN_TYPE = "array<struct<kind:int,start:int,end:int>>"
SLOTS = 1 << 22  # slots of the filter that texts are searched with for judged terms; the join after it is exact
_SHIFT = 22


def _scan(rows: DataFrame) -> DataFrame:
    """``rows(row, carried, text)`` with ``spans`` and the distinct ``entities``."""
    def scan(batches):
        for b in batches:
            spans, entities = [], []
            for text in values(b.column(2)):
                found = base_spans(text) if text else []
                spans.append([{"kind": k, "start": a, "end": e} for k, a, e in found])
                entities.append(sorted({_entity(text, *x) for x in found}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, _SPAN), pa.array(entities, pa.list_(pa.int64()))],
                                             names=[*b.schema.names, "spans", "entities"])

    carried = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(scan, f"row long, carried {carried}, text string, spans {_SPAN_TYPE}, entities array<long>")


def _seen(rows: DataFrame, words: int, chars: int) -> DataFrame:
    """``row, entities, terms`` of ``rows(row, text, spans)``, both with their contexts."""
    def seen(batches):
        for b in batches:
            entities, terms = [], []
            for text, spans in zip(values(b.column(1)), values(b.column(2)), strict=True):
                e, t = _evidence(text, [(s["kind"], s["start"], s["end"]) for s in spans], words, chars)
                entities.append([{"hash": h, "context": c} for h, c in e])
                terms.append([{"hash": h, "context": c} for h, c in t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(entities, _SEEN), pa.array(terms, _SEEN)],
                                             names=["row", "entities", "terms"])

    return rows.mapInArrow(seen, f"row long, entities {_SEEN_TYPE}, terms {_SEEN_TYPE}")


def _term_counts(rows: DataFrame) -> DataFrame:
    """Documents holding each term, over all documents: ``term, docs``."""
    def count(batches):
        for b in batches:
            # the distinct words of every document, counted once a batch before anything is shuffled
            seen: dict[str, int] = {}
            for text, spans in zip(values(b.column(0)), values(b.column(1)), strict=True):
                for w in {w for w, _, _ in _words(text, [(s["kind"], s["start"], s["end"]) for s in spans])} if spans else \
                        {w.lower() for w in set(_WORD.findall(text))}:
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(map(_term, seen), pa.int64()), pa.array(seen.values(), pa.int64())],
                                             names=["term", "docs"])

    return rows.select("text", "spans").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def _disclosing(scanned: DataFrame, words: int, chars: int, min_contexts: int, generalise_at: float,
                remove_at: float) -> DataFrame | None:
    """``entity, term, kind`` of the terms that reveal an entity beyond a threshold (None: none can).

    Entity and term count once a document.  share >= s asks for docs(t) <= both * (n / docs(e)) ** (1 - s): terms that
    stand in more documents than that of every entity beside them go before the pairs are made.
    """
    found = scanned.where(F.size("entities") > 0)
    # a pair has one context a document, so an entity needs as many documents
    entities = stored(found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("entity_docs")).where(F.col("entity_docs") >= min_contexts), "pii-entities")
    if entities.isEmpty():
        return None
    n_docs = float(scanned.count())
    held = found.select("row", F.explode("entities").alias("entity"))
    counted = attach(held, ["entity"], entities, F.col("row")).where("entity_docs is not null")
    most = F.col("entity_docs") * F.pow(F.lit(n_docs) / F.col("entity_docs"), F.lit(1.0 - generalise_at)) * (1 + 1e-9)
    known = stored(counted.groupBy("row").agg(F.collect_list(F.struct("entity", "entity_docs")).alias("known"),
                                              F.max(most).alias("most")), "pii-rows")
    seen = stored(_seen(found.select("row", "text", "spans").join(known.select("row"), "row", "left_semi"), words, chars)
                  .join(known, "row"), "pii-seen")
    terms = seen.select("row", "most", F.explode("terms").alias("t")).select(
        "row", "most", F.col("t.hash").alias("term"), F.col("t.context").alias("context"))
    counts = _term_counts(scanned.where("text is not null")).where(F.col("docs") >= min_contexts)
    rare = attach(terms, ["term"], counts, F.col("row")).where(F.col("docs") <= F.col("most")).select(
        "row", "term", "context", "docs")
    mentions = seen.select("row", F.explode("known").alias("k"), "entities").select(
        "row", "k.entity", "k.entity_docs",
        F.get(F.filter("entities", lambda e: e["hash"] == F.col("k.entity")), F.lit(0))["context"].alias("near"))
    pair = mentions.join(rare, "row").groupBy("entity", "term", "entity_docs", "docs", F.xxhash64("near", "context").alias("context")).agg(
        F.count(F.lit(1)).alias("n")).groupBy("entity", "term", "entity_docs", "docs").agg(
        F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= min_contexts)
    info = F.log2(F.lit(n_docs) / F.col("entity_docs"))
    pmi = F.log2(F.col("both") / F.col("docs")) + info
    judged = pair.withColumn("share", F.when(info > 0, pmi / info).otherwise(0.0))
    kind = F.when(F.col("share") >= remove_at, F.lit(len(KINDS))).otherwise(F.lit(len(KINDS) + 1))
    return stored(judged.where(F.col("share") >= generalise_at).select("entity", "term", kind.alias("kind")), "pii-terms")


def _occurrences(scanned: DataFrame, bad: DataFrame) -> DataFrame:
    """``row, term, entities, at``: where terms that may be judged stand in the texts, all that are and few others."""
    slots = np.zeros((2, SLOTS), bool)  # by the low bits of the hash and by those above: a frequent word rarely passes both
    for i, part in enumerate((F.col("term"), F.shiftright("term", _SHIFT))):
        slots[i, bad.select(part.bitwiseAND(SLOTS - 1).alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    held = scanned.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def search(batches):
        (low, high), known = np.unpackbits(held.value).astype(bool).reshape(2, SLOTS), {}
        for b in batches:
            hits = []
            for text, spans in zip(values(b.column(1)), values(b.column(2)), strict=True):
                if len(known) > 200_000:
                    known.clear()
                some = False
                for w in set(_WORD.findall(text)):
                    if w not in known:
                        h = _term(w.lower())
                        known[w] = h if low[h & (SLOTS - 1)] and high[(h >> _SHIFT) & (SLOTS - 1)] else None
                    some = some or known[w] is not None
                found = []
                if some:
                    for w, a, e in _words(text, [(s["kind"], s["start"], s["end"]) for s in spans]):
                        h = _term(w)
                        if low[h & (SLOTS - 1)] and high[(h >> _SHIFT) & (SLOTS - 1)]:
                            found.append({"term": h, "start": a, "end": e})
                hits.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(hits, _HITS)], names=["row", "entities", "hits"])

    hits = scanned.where("text is not null").select("row", "text", "spans", "entities").mapInArrow(
        search, "row long, entities array<long>, hits array<struct<term:long,start:int,end:int>>").where(F.size("hits") > 0)
    return hits.select("row", "entities", F.explode("hits").alias("x")).groupBy("row", "x.term").agg(
        F.first("entities").alias("entities"), F.collect_list(F.struct("x.start", "x.end")).alias("at"))


def find_pii(documents: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False,
             context_words: int = 6, context_chars: int = 160, min_contexts: int = 2, generalise_at: float = 0.8,
             remove_at: float = 0.95) -> DataFrame:
    """The carried columns (as struct ``carried``) and ``spans``: array of (kind, start, end), by kind and start.

    Kinds 0 to 3 are the patterns of ``KINDS``, leftmost and non-overlapping per kind on the whole text; 4 and 5 are
    the terms to remove and to generalise: words anywhere in an entity's documents that reveal at least ``remove_at`` /
    ``generalise_at`` of its information and stand in documents with it in ``min_contexts`` distinct contexts.  A
    document's context of entity and term is the ``context_words`` words (within ``context_chars`` characters) around
    the mentions of the entity and the ``context_words`` words around the term.  Judged terms count wherever they stand in the
    documents that hold the entity, terms to remove in all documents.  Null and empty texts have no spans; every input
    row gives one row, repeated rows included; an empty table gives none.  ``text`` is kept only with ``keep_text``.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.monotonically_increasing_id().alias("row"),
                            F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("carried"),
                            F.col(text_col).cast("string").alias("text"))
    scanned = stored(_scan(rows), "pii-scan")
    kept = ["carried", "spans"] + (["text"] if keep_text else [])
    bad = _disclosing(scanned, context_words, context_chars, min_contexts, generalise_at, remove_at)
    if bad is None or bad.isEmpty():
        return scanned.select(*kept)
    # a term is judged by the entities of its document, and by any entity (null) where it is to be removed
    anywhere = bad.where(F.col("kind") == len(KINDS)).select(F.lit(None).cast("long").alias("entity"), "term", "kind").distinct()
    found = stored(_occurrences(scanned, bad), "pii-found")
    asked = found.select("row", "term", F.explode(F.concat("entities", F.array(F.lit(None).cast("long")))).alias("entity"))
    told = attach(asked, ["entity", "term"], bad.unionByName(anywhere), F.col("row")).where("kind is not null").groupBy(
        "row", "term").agg(F.min("kind").alias("kind"))
    told = stored(told, "pii-told")  # only judged terms are opened to their places
    hit = found.join(told, ["row", "term"]).select("row", "kind", F.explode("at").alias("x"))
    more = hit.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "x.start", "x.end"))).alias("more"))
    return scanned.join(more, "row", "left").withColumn(
        "spans", F.concat("spans", F.coalesce("more", F.array().cast(_SPAN_TYPE)))).select(*kept)


def span_text(spans: str, kinds=KINDS + ADDED):
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The same rows and columns with every span of the text replaced by its mark, removed or generalised.

    Where spans overlap, they are replaced as one by the mark of the first.  Texts without spans stay as they are.
    """
    columns = documents.columns
    found = find_pii(documents, text_col, tuple(c for c in columns if c != text_col), keep_text=True, **options)
    marks = [MARKS[k] for k in KINDS + ADDED]

    def replace(batches):
        for b in batches:
            out = []
            for text, spans in zip(values(b.column(1)), values(b.column(2)), strict=True):
                parts, at = [], 0
                for s in sorted(spans or [], key=lambda s: (s["start"], s["kind"])):
                    if s["start"] >= at:
                        parts += [text[at:s["start"]], marks[s["kind"]]]
                    at = max(at, s["end"])
                out.append(text if at == 0 else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["carried", "text"])

    carried = found.schema["carried"].dataType.simpleString()
    clean = found.where(F.size("spans") == 0).select("carried", "text")
    changed = found.where(F.size("spans") > 0).select("carried", "text", "spans").mapInArrow(
        replace, f"carried {carried}, text string")
    both = clean.unionByName(changed)
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in columns])
