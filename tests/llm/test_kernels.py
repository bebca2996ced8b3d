"""The numpy kernels of the corpus operators against brute force."""

import gzip
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sylvan.llm import neardup, packing, quality, repair, text as T, tokens, topk, toxicity, warc

WORDS = st.lists(st.text(alphabet="abcd \n\té", max_size=30), max_size=12)


@given(WORDS)
@settings(max_examples=80, deadline=None)
def test_words_and_shingles(texts):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    begin, end, first = T.words(data, offsets)
    want = [[w for w in __import__("re").findall(r"[^\x20\x09-\x0d]+", t)] for t in texts]
    raw = data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(begin, end)]
    assert got == [w for x in want for w in x]
    assert np.diff(first).tolist() == [len(x) for x in want]
    h = T.hash_spans(data, begin, end)
    by_hash = {}
    for w, k in zip(got, h.tolist()):
        assert by_hash.setdefault(k, w) == w
    s, owner = T.shingles(h, first)
    grams = [[tuple(x[i : i + 5]) for i in range(len(x) - 4)] or ([tuple(x)] if x else []) for x in want]
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(g) for g in grams]
    seen = {}
    for g, k in zip([x for y in grams for x in y], s.tolist()):
        assert seen.setdefault(k, g) == g


def test_spans_hash_alike_wherever_they_lie():
    data = np.frombuffer(b"xx word yy word", np.uint8)
    h = T.hash_spans(data, np.array([3, 11]), np.array([7, 15]))
    assert h[0] == h[1] != T.hash_spans(data, np.array([0]), np.array([2]))[0]


@pytest.mark.parametrize("weighted", [False, True])
def test_dart_signatures_estimate_similarity(weighted):
    rng = random.Random(3)
    a = {rng.getrandbits(60): rng.choice([1, 2, 3]) if weighted else 1 for _ in range(300)}
    b = dict(list(a.items())[:240]) | {rng.getrandbits(60): 1 for _ in range(60)}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    element = np.array([*a, *b], np.uint64)
    weight = np.array([*a.values(), *b.values()], float)
    sig = neardup.dart_signatures(element, weight, np.repeat([0, 1], [len(a), len(b)]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert (sig != np.uint64(2**64 - 1)).all()


def test_dart_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    sets = [rng.integers(1, 2**62, n).astype(np.uint64) for n in (1, 7, 900, 0, 30)] * 20
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig = neardup.dart_signatures(np.concatenate(sets), np.ones(len(owner)), owner, len(sets), 192)
    for k in (0, 1, 2, 4):
        alone = neardup.dart_signatures(sets[k], np.ones(len(sets[k])), np.zeros(len(sets[k]), int), 1, 192)
        assert (alone[0] == sig[k]).all() and (sig[k] == sig[k + 5]).all()


TRICKY = ["", "a", "a b", " a", "a ", "a  b", "a\n b", "a \nb", "\n", "it's 's 'll x", "<|endoftext|> a", "x <|endoftext|>", "naïve “q” ½ m² 12ab", "　a b", "a b c", "tab\tx y", "日本語 テキスト です", "a" * 500 + " b", "é" * 300 + " ü", "1 22 333", "--- ### a"]


def test_encoder_gives_the_library_ids():
    path = tokens.tokenizer_path()
    rng = random.Random(5)
    alphabet = "ab tion\n.,;'é#12 \t“"
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    want = [e.ids for e in tokens.encoder(path).library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new, then remembered
        got = dict(tokens.encoded(pa.array([*texts, None], pa.string()), path))
        assert [got[i].tolist() for i in range(len(texts))] == want and got[len(texts)].tolist() == []


def test_encoder_starts_its_memory_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    monkeypatch.setattr(tokens, "MOST_PIECES", 10)
    monkeypatch.setattr(T, "STEP_BYTES", 200)
    own = tokens.Encoder(tokens.tokenizer_path())
    texts = [f"w{i} x{i % 7} y{i % 3} tail" for i in range(100)]
    for t in texts:
        data, offsets = T.utf8(pa.array([t]))
        assert own.encode(data, offsets)[0].tolist() == own.library.encode(t, add_special_tokens=False).ids


@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=8), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_grammar_round_trip(docs, least):
    ids = np.array([x for d in docs for x in d], np.int32)
    n = np.array([len(d) for d in docs], np.int64)
    s = repair.load(repair.dump(repair.compress(ids, n, list(range(len(docs))), least=least)))
    assert s.expand(s.sequence).tolist() == ids.tolist()
    for k, d in enumerate(docs):
        assert s.document(k).tolist() == d
        for a in range(0, len(d), 7):
            assert s.part(k, a, min(a + 5, len(d))).tolist() == d[a : min(a + 5, len(d))]


def test_grammar_finds_repetition_and_stays_within_documents():
    ids = np.tile(np.array([7, 8, 9, 7, 8], np.int32), 200)
    s = repair.compress(ids, np.full(100, 10, np.int64), list(range(100)))
    assert len(s.sequence) < len(ids) / 3 and s.symbols.sum() == len(s.sequence) and (s.lengths >= 2).all()


def test_grammar_replaces_until_no_pair_is_frequent():
    rng = np.random.default_rng(6)
    passage = rng.integers(100, 5000, 600)
    docs = [np.concatenate([rng.integers(0, 90, 50), passage, rng.integers(0, 90, 30)]).astype(np.int32) for _ in range(40)] + [np.full(333, 7, np.int32)]
    s = repair.compress(np.concatenate(docs), np.array(list(map(len, docs))), list(range(len(docs))))
    assert s.lengths.max() >= 300 and [x.tolist() for x in map(s.document, range(41))] == [d.tolist() for d in docs]
    edges = np.cumsum(s.symbols)
    left = [(a, b) for k, (a, b) in enumerate(zip(s.sequence[:-1].tolist(), s.sequence[1:].tolist())) if k + 1 not in set(edges.tolist())]
    once = {}
    for k, p in enumerate(left):  # occurrences without overlaps
        if p[0] != p[1] or once.get(p, (0, -9))[1] != k - 1:
            once[p] = (once.get(p, (0, 0))[0] + 1, k)
    assert max(n for n, _ in once.values()) < repair.LEAST


def brute_level(levels, size, capacity):
    best = None
    for h in range(capacity - size, -1, -1):
        if h and not levels[h]:
            continue
        n = levels.copy()
        if h:
            n[h] -= 1
        if h + size < capacity:
            n[h + size] += 1
        cost = int((n[1:capacity] ** 2).sum())
        if best is None or cost < best[0]:
            best = (cost, h)
    return best


def test_packing_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    p = packing.SumOfSquares(64)
    for k in range(600):
        size = int(rng.integers(1, 65))
        before = int((p.level[1:64] ** 2).sum())
        h = p.best_level(size)
        cost, _ = brute_level(p.level, size, 64)
        n = p.level.copy()
        if h:
            n[h] -= 1
        if h + size < 64:
            n[h + size] += 1
        assert int((n[1:64] ** 2).sum()) == cost, before
        p.add(k, np.arange(size, dtype=np.int32))
    p.finish()
    fills = [sum(len(x[2]) for x in w) for w, _ in p.closed]
    assert all(f == 64 or f & (f - 1) == 0 for f in fills) and sum(f < 64 for f in fills) <= 6


def test_packing_holds_few_sequences_open():
    p = packing.SumOfSquares(100, most_open=10)
    for k in range(500):
        p.add(k, np.full(60, k, np.int32))
        assert p.n_open <= 10
    p.finish()
    seen = {}
    for w, _ in p.closed:
        for tag, start, ids in w:
            seen.setdefault(tag, []).append((start, ids))
    assert all(sum(len(i) for _, i in sorted(v, key=lambda x: x[0])) == 60 for v in seen.values()) and len(seen) == 500


def test_packing_cuts_where_the_sum_of_squares_is_least():
    rng = np.random.default_rng(8)
    p = packing.SumOfSquares(64, most_open=6)
    for k in range(800):
        size = int(rng.integers(1, 64))
        if p.best_level(size, p.n_open < 6) is None:
            costs = {}
            for h in np.flatnonzero(p.level):
                n = p.level.copy()
                n[h] -= 1
                n[h + size - 64] += 1
                costs[int(h)] = int((n[1:64] ** 2).sum())
            assert costs[p.best_cut(size)] == min(costs.values()) and all(h + size > 64 for h in costs)
        p.add(k, np.full(size, k, np.int32))


def test_nearly_all_sequences_are_filled_while_documents_come():
    rng = np.random.default_rng(9)
    sizes = np.minimum(rng.lognormal(6.5, 0.9, 8000).astype(int) + 1, 20_000)
    p = packing.SumOfSquares(2048)
    for k, n in enumerate(sizes):
        p.add(k, np.zeros(n, np.int32))
    online = len(p.closed)
    p.finish()
    fills = [sum(len(x[2]) for x in w) for w, _ in p.closed]
    assert sum(fills) == sizes.sum() and all(f == 2048 or f & (f - 1) == 0 for f in fills) and sum(f < 2048 for f in fills) <= 11
    assert online > 0.95 * len(p.closed) and [c for _, c in p.closed] == [False] * online + [True] * (len(p.closed) - online)


def test_loser_tree_merges():
    rng = random.Random(1)
    for n in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(n)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_warc_records_round_trip():
    payload = "häßlich\r\n\r\nbody".encode()
    r = warc.parse(gzip.decompress(gzip.compress(warc.record(5, "http://a.b/\r\nX: y", "2020-01-01T00:00:00Z", payload, None, False))))
    assert (r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) == (5, len(payload), "response", None)
    v = warc.parse(warc.record(9, "", "2020-01-01T00:00:00Z", payload, 5, True))
    assert (v["payload_digest"], v["payload_bytes"], v["record_type"], v["refers_to"]) == (r["payload_digest"], len(payload), "revisit", 5)
    with pytest.raises(ValueError):
        warc.parse(warc.record(5, "u", "2020-01-01T00:00:00Z", payload, None, False).replace(b"body", b"bodY"))
    assert warc.url_key("https://www.Example.com:443/A?b=1") == "com,example)/a?b=1"
    assert warc.url_key("http://[bad/") and warc.url_key("") == ")/"


def test_branch_and_bound_is_exact():
    rng = np.random.default_rng(4)
    rows = topk.quantised(rng.normal(0, 0.2, (48, 700)))
    rows[:, 100:300] = rows[:, [5]]  # ties
    ids = rng.permutation(700)
    tails = [np.sqrt((rows[e:] ** 2).sum(axis=0)) for e in [*range(0, 48, topk.GROUP), 48]]
    for q in range(0, 700, 37):
        s = topk.Search(rows[:, q], int(ids[q]), 5)
        e = topk.Search(rows[:, q], int(ids[q]), 5)
        for a in range(0, 700, 64):
            s.offer(rows[:, a : a + 64], ids[a : a + 64], [t[a : a + 64] for t in tails])
            e.offer_exactly(rows[:, a : a + 64], ids[a : a + 64])
        want = sorted((-float(rows[:, q] @ rows[:, c]), int(ids[c])) for c in range(700) if c != q)[:5]
        assert [(-x, i) for x, i in zip(s.score, s.ids)] == want
        assert [(-float(x), i) for x, i in zip(e.score, e.ids)] == want


def test_context_sums():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = rng.integers(0, 5, size=rng.integers(1, 8))
        first = np.concatenate([[0], np.cumsum(n)])
        own = rng.integers(-3, 4, (first[-1], 4)).astype(np.float32)
        who = np.repeat(np.arange(len(n)), n)
        want = np.array([sum((own[j] for j in range(len(own)) if 0 < abs(i - j) <= 2 and who[i] == who[j]), np.zeros(4)) for i in range(len(own))]).reshape(own.shape)
        assert not len(own) or (quality._contexts(own, first) == want).all()


def test_isotonic_is_monotone_and_close():
    rng = np.random.default_rng(0)
    s = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * s))).astype(float)
    x, p = toxicity.isotonic(s, y)
    assert (np.diff(p) >= -0.2).all() and np.abs(np.interp(s, x, p) - 1 / (1 + np.exp(-2 * s))).mean() < 0.05


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(toxicity.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity.Boosted(np.empty(0, np.uint64)).fit(x[:2000], y[:2000])
    assert ((m.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_toxic_features_see_through_spelling():
    texts = ["You are an idiot", "you IDIOT!!", "1d1ot you", "id*iot", "fine words here", ""]
    data, offsets = T.utf8(pa.array(texts))
    f = toxicity.features(data, offsets, np.empty(0, np.uint64))
    fixed, hidden = f[:, toxicity.NAMES.index("fixed_count")], f[:, toxicity.NAMES.index("hidden_share")]
    assert fixed.tolist() == [1, 1, 0, 1, 0, 0] and (hidden > 0).tolist() == [False, False, True, True, False, False]
    assert f[0, toxicity.NAMES.index("near_person")] > 0 and (f[5] == 0).all()


def test_crc_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 256], np.int32).astype("<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\0\x01\0\0")
