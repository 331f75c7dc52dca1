"""Piece encoding by Gumbel top-k sampling without replacement over the segmentation lattice, and decoding.

A text is cut into chunks that no piece crosses; each chunk has a lattice of vocabulary pieces whose edges carry
probabilities proportional to exp(alpha * score), normalised by backward sums.  A segmentation of the text is a path
through all its chunks.  The search is perturbed A*: the best perturbed path of a subtree is a sample of it; every step
of the path leaves a subtree behind (the other edges there), which enters a queue with a Gumbel value truncated at its
parent's.  Taking the best subtree k times gives k distinct segmentations, sampled without replacement; the best value
still queued is the threshold of their inclusion scores.  Random numbers are hashes of the row key, so a row's samples
do not depend on the rows around it.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import release_memory, small_batches, values

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 2e-4
BATCH_CHARS = 400_000  # texts handled at once
BUILD_CHARS = 60_000  # characters of new lattices built at once
CACHED_CHUNKS = 150_000  # lattices kept by a task
MARKS = 1 << 22

_GOLD, _M1, _M2, _BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3))
_WHOLE = re.compile(r"(?s).+")


def _chunk_pattern(pieces: list[str]) -> re.Pattern:
    """Cuts a text where no piece crosses: before spaces, around line ends and where other characters meet a mark.

    Marks are the ASCII punctuation characters that in no piece follow another character than a space or a mark.
    """
    if any("\n" in p or " " in p.lstrip(" ") for p in pieces):
        return _WHOLE
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    while True:
        after = {y: x for p in pieces for x, y in zip(p, p[1:], strict=False) if y in marks and x != " " and x not in marks}
        if not after:
            break
        # a rare sign in front of a mark becomes a mark itself, anything a word is made of ends the mark
        for y, x in after.items():
            if x.isalpha() or x.isdecimal():
                marks.discard(y)
            else:
                marks.add(x)
    if not marks:
        return re.compile(r" *[^ \n]+| +|\n")
    m = "".join(map(re.escape, sorted(marks)))
    return re.compile(rf" *[{m}]*[^ \n{m}]+| *[{m}]+| +|\n")


class Vocabulary:
    """Pieces of a SentencePiece model: prefix hashes for matching, log weights, bytes for decoding."""

    def __init__(self, path: str = TOKENIZER, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = len(sp)
        least = min(max(sp.get_score(i), -2.0 * size) for i in range(size))
        self.weight = np.array([alpha * max(sp.get_score(i), least) for i in range(size)] + [alpha * (least - size)])
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.raw: list[bytes] = []
        pieces: dict[int, int] = {}
        texts = []
        for i in range(size):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw.append(bytes([int(text[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
                continue
            text = text.replace("▁", " ")
            self.raw.append(text.encode())
            texts.append(text)
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for n, c in enumerate(text, 1):
                    h = h * _BASE + np.uint64(ord(c) + 1)
                    key = int(h)
                    pieces[key] = i if n == len(text) else pieces.get(key, -1)
        self.prefix = np.array(sorted(pieces), np.uint64)
        self.prefix_id = np.array([pieces[int(h)] for h in self.prefix], np.int32)
        self.longest = max(map(len, texts))
        self.chunk = _chunk_pattern(texts)


class _Column:
    """A growing array."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1024, dtype), 0

    def add(self, values):
        need = self.n + len(values)
        if need > len(self.data):
            grown = np.empty(max(need, len(self.data) * 5 // 4), self.data.dtype)
            grown[:self.n] = self.data[:self.n]
            self.data = grown
        self.data[self.n:need] = values
        self.n = need


class Lattices:
    """Lattices of distinct chunks.  Node v's edges are first[v]..first[v+1], most probable first."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.raw_bytes = np.frombuffer(b"".join(vocabulary.raw), np.uint8)  # all pieces' bytes and where each begins
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in vocabulary.raw])])
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.first = _Column(np.int32)  # per node
        self.first.add([0])
        # per edge; piece -1-c: character c in bytes; span -n: n characters to the end of the chunk
        self.piece, self.span = _Column(np.int32), _Column(np.int8)
        self.cum, self.logp, self.rest = _Column(np.float32), _Column(np.float64), _Column(np.float32)
        self.kept = [c.n for c in self._columns()]
        self.marks = bytearray(MARKS)

    def ids(self, chunks: list[str]) -> np.ndarray:
        """First node of every chunk's lattice, good until the next call; unknown chunks are built."""
        for column, n in zip(self._columns(), self.kept, strict=True):
            column.n = n  # the lattices only the last texts needed
        node = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(node < 0).tolist()
        if missing:
            new = list(dict.fromkeys(map(chunks.__getitem__, missing)))
            # most chunks occur once: a chunk is kept from its second time on
            once, marks = [], self.marks
            again = []
            for c in new:
                h = hash(c) & (MARKS - 1)
                (again if marks[h] else once).append(c)
                marks[h] = 1
            if len(self.known) + len(again) > CACHED_CHUNKS and self.known:
                self.clear()
                return self.ids(chunks)
            found = dict(zip(again, self._build(again), strict=True))
            self.known.update(found)
            self.kept = [c.n for c in self._columns()]
            found.update(zip(once, self._build(once), strict=True))
            node[missing] = [found[chunks[i]] for i in missing]
        return node

    def _columns(self):
        return self.first, self.piece, self.span, self.cum, self.logp, self.rest

    def _build(self, chunks: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(chunks):
            end, size = at, 0
            while end < len(chunks) and size < BUILD_CHARS:
                size += len(chunks[end])
                end += 1
            out += self._build_some(chunks[at:end])
            at = end
        return out

    def _build_some(self, chunks: list[str]) -> list[int]:
        v = self.v
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lens)
        rem = np.repeat(ends, lens) - np.arange(len(chars))
        at, h, n, found = np.arange(len(chars)), np.zeros(len(chars), np.uint64), 0, []
        while len(at):
            h = h * _BASE + (chars[at + n] + np.uint64(1))
            n += 1
            look = np.minimum(np.searchsorted(v.prefix, h), len(v.prefix) - 1)
            hit = v.prefix[look] == h
            ids = v.prefix_id[look]
            full = hit & (ids >= 0)
            starts, ids = at[full], ids[full]
            if n == 1:
                lone = at[~full]
                starts = np.concatenate([starts, lone])
                ids = np.concatenate([ids, -1 - chars[lone].astype(np.int32)])
            if len(starts):
                found.append((n, starts, ids))
            go = hit & (rem[at] > n)
            at, h = at[go], h[go]
        # one column per character, one row per piece length that occurs, the longest first
        found.reverse()
        ahead = np.array([n for n, _, _ in found], np.int64)
        weight = np.full((len(found), len(chars)), -np.inf)
        piece = np.zeros((len(found), len(chars)), np.int32)
        for r, (_, starts, ids) in enumerate(found):
            weight[r, starts] = v.weight[np.where(ids >= 0, ids, len(v.weight) - 1)]
            piece[r, starts] = ids
        node = np.arange(len(chars)) + np.repeat(np.arange(len(chunks)), lens)  # every chunk has one more node: its end
        beta = np.zeros(len(chars) + len(chunks) + ahead.max(initial=1))
        order = np.argsort(rem, kind="stable")  # from the chunk ends backwards
        cuts = np.searchsorted(rem[order], np.arange(1, rem.max() + 2)) if len(rem) else np.zeros(1, int)
        fits = np.searchsorted(-ahead, -np.arange(1, len(cuts)))  # no piece is longer than what is left of the chunk
        for a, b, r in zip(cuts, cuts[1:], fits, strict=False):
            i = order[a:b]
            val = weight[r:, i] + beta[node[i] + ahead[r:, None]]
            top = val.max(0)
            val -= top
            beta[node[i]] = top + np.log(np.exp(val, out=val).sum(0))
        there = np.ascontiguousarray((weight > -np.inf).T)
        count = there.sum(1)
        row, col = np.nonzero(there)
        logp = np.minimum(weight[col, row] + beta[node[row] + ahead[col]] - beta[node[row]], 0.0)
        logp[count[row] == 1] = 0.0
        p = np.exp(logp)
        cum = np.zeros(there.shape)
        cum[row, col] = p
        cum = np.cumsum(cum, axis=1, out=cum)[row, col]
        cum[np.append(row[1:] != row[:-1], True)] = 2.0
        with np.errstate(divide="ignore"):
            rest = np.log1p(-p)
        span = ahead[col]
        edges_of = np.zeros(len(chars) + len(chunks), np.int64)
        edges_of[node] = count
        first_node = self.first.n - 1
        self.first.add(self.piece.n + np.cumsum(edges_of))
        self.piece.add(piece[col, row])
        self.span.add(np.where(rem[row] == span, -span, span))
        self.cum.add(cum)
        self.logp.add(logp)
        self.rest.add(rest)
        return (first_node + np.concatenate([[0], (ends + np.arange(1, len(chunks) + 1))[:-1]])).tolist()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """In (0, 1), from hashed keys."""
    with np.errstate(over="ignore"):
        z = _mix(key + np.uint64(stream + 1) * _GOLD)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _walk(lat: Lattices, node: np.ndarray, key: np.ndarray):
    """One sampled path per start node: (edges in order of start node and step, log E per step, steps per start)."""
    first, cum, span = lat.first.data, lat.cum.data, lat.span.data
    inst, levels = np.arange(len(node)), []
    steps = np.zeros(len(node), np.int64)
    t = 0
    while len(inst):
        k = key[inst]
        u = _uniform(k, 2 * t)
        e = first[node].astype(np.int64)
        more = np.nonzero(u > cum[e])[0]
        while len(more):
            e[more] += 1
            more = more[u[more] > cum[e[more]]]
        levels.append((inst, e, np.log(-np.log(_uniform(k, 2 * t + 1)))))
        steps[inst] += 1
        step = span[e]
        go = step > 0
        inst, node = inst[go], node[go] + step[go]
        t += 1
    offset = np.concatenate([[0], np.cumsum(steps)])
    edges, log_e = np.empty(offset[-1], np.int64), np.empty(offset[-1])
    for t, (i, e, x) in enumerate(levels):
        edges[offset[i] + t] = e
        log_e[offset[i] + t] = x
    return edges, log_e, steps


def _row_key(key, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(key), seed)


def sample_batch(lat: Lattices, texts: list[str], keys: list, k: int, seed: int):
    """Per text a list of up to k (edges, log probability, perturbed value) in sampled order, and the threshold kappa."""
    chunk = lat.v.chunk
    per_doc = [chunk.findall(" " + t) if t else [] for t in texts]
    node = lat.ids([c for d in per_doc for c in d])
    doc_len = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
    doc_at = np.concatenate([[0], np.cumsum(doc_len)])
    seeds = np.array([_row_key(x, seed) for x in keys], np.uint64)
    with np.errstate(over="ignore"):
        inst_no = np.arange(len(node)) - np.repeat(doc_at[:-1], doc_len)
        key = _mix(np.repeat(seeds, doc_len) + inst_no.astype(np.uint64) * _M2)
        edges, log_e, steps = _walk(lat, node, key)
    logp_of, rest_of = lat.logp.data, lat.rest.data
    lp = logp_of[edges]
    step_at = np.concatenate([[0], np.cumsum(steps)])
    head = step_at[doc_at]  # first step of every text
    left = rest_of[edges] - log_e
    step_inst = np.repeat(np.arange(len(node)), steps)
    out, heaps, roots = [], [], -np.log(-np.log(_uniform(seeds, 0)))
    serial = itertools.count()  # queue entries with equal values keep their order
    for d in range(len(texts)):
        a, b = head[d], head[d + 1]
        path = (edges[a:b], step_inst[a:b])
        run = np.cumsum(lp[a:b])  # per text, so that its neighbours in the batch leave no trace in the last digits
        out.append([(path[0], float(run[-1]) if b > a else 0.0, float(roots[d]))])
        heap: list = []
        _push(heap, serial, run - lp[a:b] + left[a:b], 0, path, run - lp[a:b], float(roots[d]), k)
        heaps.append(heap)
    for turn in range(1, k):
        jobs, starts, where = [], [], []
        for d, heap in enumerate(heaps):
            if not heap or len(out[d]) < turn:
                continue
            g, _, path, s, prefix, used = heapq.heappop(heap)
            g = -g
            e0 = int(path[0][s])
            v = int(np.searchsorted(lat.first.data[:lat.first.n], np.int32(e0), side="right")) - 1
            options = [e for e in range(int(lat.first.data[v]), int(lat.first.data[v + 1])) if e not in used]
            weights = np.exp(logp_of[options])
            u1, u2 = _uniform(np.array([seeds[d]]), 1000 + 2 * turn)[0], _uniform(np.array([seeds[d]]), 1001 + 2 * turn)[0]
            pick = options[min(int(np.searchsorted(np.cumsum(weights), u1 * weights.sum())), len(options) - 1)]
            if len(options) > 1:  # what is left at this node stays a subtree of its own
                left = float(prefix + math.log(sum(math.exp(logp_of[e]) for e in options if e != pick)))
                queued = -float(np.logaddexp(-g, math.log(-math.log(u2)) - left))
                heapq.heappush(heap, (-queued, next(serial), path, s, prefix, (*used, pick)))
            inst = int(path[1][s])
            begin = [] if lat.span.data[pick] < 0 else [v + int(lat.span.data[pick])]
            nodes = np.concatenate([np.array(begin, np.int64), node[inst + 1:doc_at[d + 1]]])
            of = np.concatenate([np.full(len(begin), inst), np.arange(inst + 1, doc_at[d + 1])])
            jobs.append((d, g, path, s, prefix, pick, inst))
            starts.append(nodes)
            where.append(of)
        if not jobs:
            break
        counts = [len(x) for x in starts]
        nodes, of = np.concatenate(starts), np.concatenate(where)
        with np.errstate(over="ignore"):
            sub = _mix(key[of] + np.uint64(turn) * _GOLD)
        edges2, log_e2, steps2 = _walk(lat, nodes, sub)
        step_inst2 = np.repeat(of, steps2)
        at2 = np.concatenate([[0], np.cumsum(steps2)])[np.concatenate([[0], np.cumsum(counts)])]
        for (d, g, path, s, prefix, pick, inst), a, b in zip(jobs, at2, at2[1:], strict=False):
            tail, tail_lp = edges2[a:b], logp_of[edges2[a:b]]
            start = prefix + float(logp_of[pick])
            run = np.cumsum(tail_lp)
            ahead = start + run - tail_lp
            new = (np.concatenate([path[0][:s], [pick], tail]), np.concatenate([path[1][:s], [inst], step_inst2[a:b]]))
            out[d].append((new[0], start + (float(run[-1]) if len(run) else 0.0), g))
            _push(heaps[d], serial, ahead + rest_of[tail] - log_e2[a:b], s + 1, new, ahead, g, k - turn)
    return out, [-heap[0][0] if heap else -math.inf for heap in heaps]


def _push(heap, serial, value, offset, path, before, top, keep):
    """Queue the ``keep`` best subtrees left along a path, their Gumbel values truncated at ``top``."""
    if not len(value):
        return
    best = np.argpartition(-value, keep - 1)[:keep] if len(value) > keep else np.arange(len(value))
    for i in best:
        if value[i] > -math.inf:
            s = offset + int(i)
            queued = -float(np.logaddexp(-top, -value[i]))
            heapq.heappush(heap, (-queued, next(serial), path, s, float(before[i]), (int(path[0][s]),)))


def token_ids(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    piece = lat.piece.data[edges]
    odd = np.nonzero(piece < 0)[0]
    if not len(odd):
        return piece
    parts, at = [], 0
    byte_ids = lat.v.byte_ids
    if piece[odd].min() >= -128:  # one byte each, as line ends are
        piece[odd] = byte_ids[-1 - piece[odd]]
        return piece
    for i in odd:
        raw = chr(-1 - int(piece[i])).encode("utf-8", "surrogatepass")
        parts += [piece[at:i], byte_ids[list(raw)]]
        at = i + 1
    return np.concatenate([*parts, piece[at:]])


def _bytes_of(lat: Lattices, ids: np.ndarray, lens) -> list[bytes]:
    """Decoded bytes of many id sequences that stand one after the other: one gather from the pieces' bytes."""
    begin, size = lat.raw_at[ids], lat.raw_at[ids + 1] - lat.raw_at[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    joined = lat.raw_bytes[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    at = ends[np.concatenate([[0], np.cumsum(lens)])].tolist()
    return [joined[a:b].removeprefix(b" ") for a, b in zip(at, at[1:], strict=False)]


def decode(vocabulary: Vocabulary, ids) -> str:
    """Text of the ids: pieces and bytes joined, the space in front of the first piece dropped."""
    return b"".join(map(vocabulary.raw.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def decode_ids(samples: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """The same rows with a column ``decoded``: the text of the ids (null for null, empty for no ids)."""
    small_batches(samples.sparkSession)
    held = samples.sparkSession.sparkContext.broadcast(vars(Vocabulary(tokenizer)))

    def run(batches):
        vocabulary = object.__new__(Vocabulary)
        vars(vocabulary).update(held.value)
        for b in batches:
            texts = [None if x is None else decode(vocabulary, x) for x in values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["carried", "decoded"])

    columns = samples.columns
    source = samples.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("carried"), F.col(ids_col).alias("ids"))
    out = source.mapInArrow(run, f"carried {source.schema['carried'].dataType.simpleString()}, decoded string")
    return out.select(*[F.col(f"carried.`{c}`").alias(c) for c in columns], "decoded")


SAMPLES = "rank int, ids array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def encode_samples(documents: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   tokenizer: str = TOKENIZER, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """Up to k distinct segmentations of every whole text, sampled without replacement; one row per sample.

    ``rank`` is the sampling order, ``log_prob`` the segmentation's log probability, ``perturbed`` its Gumbel value,
    ``log_inclusion`` the log probability of a value above the threshold (0 when all segmentations are listed) and
    ``round_trip`` whether the ids, decoded, give the text.  Texts with fewer segmentations give fewer rows; an empty text has one, without pieces; a null text gives one row
    with nulls.  Rows with equal id and text get equal
    samples.  An empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(vars(Vocabulary(tokenizer, alpha)))  # as large as the vocabulary file

    def encode(batches):
        vocabulary = object.__new__(Vocabulary)
        vars(vocabulary).update(held.value)
        lat = Lattices(vocabulary)
        for b in batches:
            keys, texts, at, size = b.column(0).to_pylist(), [], 0, 0
            for text in values(b.column(1)):
                texts.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    yield _encoded(lat, b.column(0).slice(at, len(texts)), keys[at:at + len(texts)], texts, k, seed)
                    texts, at, size = [], at + len(texts), 0
            if texts:
                yield _encoded(lat, b.column(0).slice(at, len(texts)), keys[at:], texts, k, seed)
        lat.clear()
        release_memory()

    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(encode, f"doc_id {kind}, {SAMPLES}")


def _encoded(lat: Lattices, id_column, keys, texts, k, seed) -> pa.RecordBatch:
    found, kappa = sample_batch(lat, [t or "" for t in texts], keys, k, seed)
    row, rank, ids, size, logp, value, incl = [], [], [], [], [], [], []
    for d, samples in enumerate(found):
        if texts[d] is None:
            row.append(d), rank.append(1), ids.append(None), size.append(None)
            logp.append(None), value.append(None), incl.append(None)
            continue
        for r, (edges, lp, g) in enumerate(samples, 1):
            tokens = token_ids(lat, edges)
            row.append(d), rank.append(r), ids.append(tokens), size.append(len(tokens))
            logp.append(lp), value.append(g)
            x = lp - kappa[d]  # log(1 - exp(-exp(x)))
            incl.append(0.0 if x > 5 else x if x < -30 else math.log(-math.expm1(-math.exp(x))))
    lens = np.array([0 if x is None else len(x) for x in ids], np.int64)
    flat = np.concatenate([x for x in ids if x is not None and len(x)]) if lens.any() else np.empty(0, np.int32)
    data = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    same = [None if data[d] is None else text == data[d] for d, text in zip(row, _bytes_of(lat, flat, lens), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)),
                                     pa.array(flat.astype(np.int32)), mask=pa.array([x is None for x in ids]))
    return pa.RecordBatch.from_arrays(
        [id_column.take(pa.array(row, pa.int64())), pa.array(rank, pa.int32()), lists, pa.array(size, pa.int32()),
         pa.array(logp, pa.float64()), pa.array(value, pa.float64()), pa.array(incl, pa.float64()), pa.array(same, pa.bool_())],
        names=["doc_id", "rank", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"])
