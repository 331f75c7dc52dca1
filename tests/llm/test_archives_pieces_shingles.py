"""op3, op4 and op10: round trips and brute force on small tables."""

import base64
import collections
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import jaccard_join, piece_sampling, warc
from ledgerlens.llm.piece_sampling import (
    Lattices,
    Vocabulary,
    decode,
    decode_ids,
    encode_samples,
    sample_batch,
    token_ids,
)

# ---------------------------------------------------------------- WARC

PAGES = [(5, "http://a/é x\r\ny", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, None), (8, "http://c", ""), (7, "u", None),
         (11, "http://d", "é" * 70_000), (12, "v", "\r\n\r\nWARC/1.1\r\n"), (3, "http://b", "<p>same</p>"), (None, "w", "<p>same</p>")]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, sha int, n int")


def test_warc_round_trip(spark):
    folder = warc.archive_folder(spark)
    index = warc.write_warc(_pages(spark, PAGES), folder)
    assert index.count() == len(PAGES)
    got = warc.read_warc(index, folder).collect()
    want = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if p is not None and (h or "") == (html or "")]
        first = None if page_id is None or page_id == min(same) else min(same)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page_id, "response" if first is None else "revisit", first, digest, len(body), body if first is None else None))
    key = lambda x: str(x)
    assert sorted([(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes,
                    None if r.payload is None else bytes(r.payload)) for r in got], key=key) == sorted(want, key=key)
    some = warc.read_warc(index.where("page_id = 11"), folder).collect()
    assert [(r.page_id, len(r.payload)) for r in some] == [(11, 140_000)]
    assert index.where("page_id = 5").first().payload_digest == base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()


def test_warc_least_bytes_and_empty(spark):
    folder = warc.archive_folder(spark)
    index = warc.write_warc(_pages(spark, PAGES[:5]), folder, revisit_min_bytes=1)
    got = warc.read_warc(index, folder, with_payload=False).collect()
    assert {r.page_id for r in got if r.record_type == "revisit"} == {5}
    empty = warc.write_warc(_pages(spark, PAGES).limit(0), folder)
    assert empty.count() == 0 and warc.read_warc(empty, folder).count() == 0


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 10), ("a", 5000, 10), ("b", 0, 10)]
    groups = list(warc.coalesce_ranges(rows, gap=100, most=200))
    assert [len(g) for g in groups] == [3, 1, 1]
    assert [len(g) for g in warc.coalesce_ranges(rows, gap=0, most=10)] == [1, 1, 1, 1, 1]


# ---------------------------------------------------------------- pieces

@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary()


def _segmentations(v, text):
    by_text = {raw.decode(): i for i, raw in enumerate(v.raw) if i not in set(v.byte_ids.tolist()) and raw}
    s, out = " " + text, {}

    def go(i, ids, w):
        if i == len(s):
            out[tuple(ids)] = w
            return
        for j in range(i + 1, min(len(s), i + v.longest) + 1):
            if s[i:j] in by_text:
                go(j, [*ids, by_text[s[i:j]]], w + v.weight[by_text[s[i:j]]])
        if s[i] not in by_text:
            go(i + 1, ids + [int(v.byte_ids[b]) for b in s[i].encode()], w + v.weight[-1])

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: w - z for k, w in out.items()}


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    text, n = "the nt\n漢", 4000
    p = _segmentations(vocabulary, text)
    lat = Lattices(vocabulary)
    found, kappa = sample_batch(lat, [text] * n, list(range(n)), 3, 0)
    first, second, mass = collections.Counter(), collections.Counter(), []
    for samples, threshold in zip(found, kappa, strict=True):
        ids = [tuple(token_ids(lat, e).tolist()) for e, _, _ in samples]
        assert len(set(ids)) == 3 and all(abs(p[i] - lp) < 1e-6 for i, (_, lp, _) in zip(ids, samples, strict=True))
        values = [g for *_, g in samples]
        assert values == sorted(values, reverse=True) and values[-1] >= threshold
        first[ids[0]] += 1
        second[ids[1]] += 1
        mass.append(sum(math.exp(lp) / -math.expm1(-math.exp(lp - threshold)) for _, lp, _ in samples))
    q = {k: math.exp(x) for k, x in p.items()}
    for a in sorted(q, key=q.get)[-4:]:
        then = sum(q[b] * q[a] / (1 - q[b]) for b in q if b != a)
        assert abs(first[a] / n - q[a]) < 0.03 and abs(second[a] / n - then) < 0.03
    assert abs(np.mean(mass) - 1) < 0.02  # inclusion scores weigh the samples to the whole


def test_all_segmentations_are_listed_when_few(vocabulary):
    lat = Lattices(vocabulary)
    found, kappa = sample_batch(lat, ["a", ""], [1, 2], 9, 0)
    assert {tuple(token_ids(lat, e).tolist()) for e, _, _ in found[0]} == set(_segmentations(vocabulary, "a"))
    assert kappa == [-math.inf, -math.inf] and len(found[1]) == 1


def test_encode_round_trip_and_odd_rows(spark, vocabulary):
    import sentencepiece

    texts = ["Hello  world\nfoo bar ", "", None, " a", "▁x\t☃ 漢字\x00", "née.com's (x)!", "ab " * 40_000, "x" * 3000, "Hello  world\nfoo bar "]
    rows = [(i if i < 8 else 0, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, ids int")
    got = encode_samples(df, k=3).collect()
    plain = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.TOKENIZER)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        if r.ids is not None:
            assert decode(vocabulary, r.ids) == texts[r.doc_id]
            if r.doc_id not in (4,):  # the library reads the sign of a space as a space
                assert plain.decode(list(r.ids)) == texts[r.doc_id]
    assert len(by[1]) == 1 and by[1][0].ids == [] and by[1][0].log_inclusion == 0
    assert len(by[2]) == 1 and by[2][0].ids is None
    assert len(by[0]) == 6 and len({tuple(r.ids) for r in by[0]}) == 3  # equal rows, equal samples
    again = encode_samples(df.repartition(4), k=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert encode_samples(df.limit(0)).count() == 0
    back = decode_ids(encode_samples(df, k=2)).collect()
    assert {r.doc_id for r in back} == set(range(8)) and all(r.decoded == texts[r.doc_id] for r in back)


def test_every_sample_is_decoded(spark, vocabulary):
    texts = ["Hello  world\nfoo bar ", "", None, "▁x\t☃ 漢字\x00", "née.com's (x)!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = encode_samples(df, k=2).collect()
    assert all(r.round_trip is (None if r.doc_id == 2 else True) for r in got) and {r.doc_id for r in got} == set(range(5))
    # ids that do not give their text back are told
    lat = Lattices(vocabulary)
    keys, odd = pa.array([0, 1]), ["the nt", "漢"]
    assert set(piece_sampling._encoded(lat, keys, [0, 1], odd, 2, 0).column("round_trip").to_pylist()) == {True}
    broken = Vocabulary()
    broken.raw = [x if x.isascii() else b"?" for x in broken.raw]
    same = piece_sampling._encoded(Lattices(broken), keys, [0, 1], odd, 2, 0)
    assert {(i, t) for i, t in zip(same.column("doc_id").to_pylist(), same.column("round_trip").to_pylist(), strict=True)} == {
        (0, True), (1, False)}


# ---------------------------------------------------------------- shingles

def _plain_components(rows):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, sh(t)) for i, t in rows]
    comp = {i: i for i, _ in sets if i is not None}
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1:]
             if None not in (a, b) and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    for _ in range(len(comp)):
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


def _jaccard_rows(seed):
    rng = np.random.RandomState(seed)
    words = np.array([f"W{i}" for i in range(400)])
    rows, passage = [], " ".join(rng.choice(words, 50))
    for base in range(12):
        text = list(rng.choice(words, rng.randint(6, 90)))
        for _ in range(rng.randint(1, 14)):
            edited = list(text)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randint(len(edited))] = str(rng.choice(words))
            cut = rng.randint(0, 4)
            rows.append(" ".join(edited[cut:]) + (" " + passage if base % 3 == 0 else ""))
    rows += [rows[0], rows[0].lower(), rows[3].replace(" ", "\n\t"), None, "", "  ", "one two", "ONE two", "one two", "a b c d e", "a b c d e f",
             "x " * 40_000, "x " * 20]
    ids = rng.permutation(len(rows))
    return [(int(i), t) for i, t in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HUB_ROWS", 3)  # several blocks a group
    monkeypatch.setattr(jaccard_join, "QUERY_ROWS", 2)
    rows = [*_jaccard_rows(seed), (None, "a b c d e"), (3, "a b c d e f g")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, n int, fp int, rep int, grp int")
    got = jaccard_join.jaccard_components(df.repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _plain_components(rows)


def test_jaccard_without_the_grouping_step_finds_the_same(spark, monkeypatch):
    # the opened groups alone must be exact: no min-hash links, no frequent shingles
    empty = lambda classes, docs: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(jaccard_join, "_similar_groups", empty)
    monkeypatch.setattr(jaccard_join, "_frequent", lambda texts: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    rows = _jaccard_rows(5)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _plain_components(rows)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_lengths_hold_the_shared_shingles():
    for n_x in range(1, 120):
        for n_y in range(n_x, min(150, n_x * 5 // 4) + 1):
            least = -(-80 * (n_x + n_y) // 180)  # smallest overlap of a link
            if least > n_x:
                continue
            need = jaccard_join.least_shared(n_x)
            small, large = jaccard_join.prefix_lengths(n_x)[0], jaccard_join.prefix_lengths(n_y)[1]
            # the need-th common shingle stands at most at n - overlap + need
            assert min(n_x, n_x - least + need) <= small and min(n_y, n_y - least + need) <= large


def test_room_holds_for_groups_across_a_multiple_of_forty(spark):
    # X and Y share 36 of 40 and 41 shingles (0.80); X' is X without the first shared one and too far from Y
    x, y = [*range(1000, 1004), *range(36)], [*range(2000, 2005), *range(36)]
    rows = []
    for rep, grp, order in ((1, 1, x), (2, 1, [t for t in x if t != 0]), (3, 3, y)):
        small, large = jaccard_join.prefix_lengths(len(order))
        rows.append((rep, grp, len(order), small, order[:max(small, large)]))
    assert jaccard_join.linked(36, 40, 41) and not jaccard_join.linked(35, 39, 41)
    grouped = spark.createDataFrame(rows, "rep long, grp long, n long, small int, prefix array<long>")
    assert [tuple(r) for r in jaccard_join._qualifying(grouped).collect()] == [(1, 3)]
