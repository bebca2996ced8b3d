"""The two classifiers against plain versions, and their quality on documents that they never learnt from."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan.llm import learn, quality, text as T, toxicity

SF = "/root/testdata/sf0.1"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def hashed(raw):
    data = np.frombuffer(raw, np.uint8)
    return int(T.hash_spans(data, np.array([0]), np.array([len(raw)]))[0])


def letters(raw, table):
    return bytes(b for b in (int(table[x]) for x in raw) if b)


def texts_of(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = "the quick Brown fox you YOUR idiot 1d1ot tr@sh stu.pid m*ron müll dich clean words 42 !!! #x| Ein Haus naïve a".split()
    return ["", None, " \n", "you"] + [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) + rng.choice(["", ".", "!", "\nnext line?"]) for _ in range(n)]


def plain_toxic(text, learnt):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    n, size = max(len(words), 1), max(len(raw), 1)
    fixed_words = {letters(w.encode(), toxicity._LETTER) for w in toxicity.LEXICON}
    persons = {letters(w.encode(), toxicity._LETTER) for w in toxicity.SECOND_PERSON}
    is_symbol = lambda b: not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or 48 <= b <= 57)
    own = [letters(w, toxicity._LETTER) for w in words]
    fixed, new = [x in fixed_words for x in own], [hashed(x) in learnt for x in own]
    person = [x in persons for x in own]
    hit = [a or b for a, b in zip(fixed, new)]
    near = [any(person[j] for j in range(max(0, i - 3), min(len(words), i + 4)) if j != i) for i in range(len(words))]
    inner = [len(w) - len(x) for w, x in zip(words, own)]
    hidden = [letters(w, toxicity._READ) in fixed_words and not f or h and k > 0 and not is_symbol(w[-1]) for w, f, h, k in zip(words, fixed, hit, inner)]
    caps = [sum(65 <= b <= 90 for b in w) for w in words]
    return [
        sum(fixed) / n, min(sum(fixed), 20), sum(new) / n, min(sum(new), 20), sum(a and b for a, b in zip(hit, near)) / n, sum(person) / n,
        sum(caps) / size, sum(c >= 2 and c == len(x) for c, x in zip(caps, own)) / n, raw.count(b"!") / size, raw.count(b"?") / size,
        sum(map(is_symbol, raw)) / size, sum(48 <= b <= 57 for b in raw) / size, sum(hidden) / n, sum(k > 2 for k in inner) / n,
        sum(map(len, words)) / n, sum(a == b for a, b in zip(own, own[1:])) / n, np.log1p(len(words)),
    ]


def test_toxic_features_against_the_plain_version():
    texts = texts_of(200, 1)
    learnt = np.sort(np.array([hashed(b"fox"), hashed(b"haus")], np.uint64))
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    got = toxicity.features(data, offsets, learnt)
    want = np.array([plain_toxic(t, set(learnt.tolist())) for t in texts])
    assert got.shape == want.shape and np.allclose(got, want)


def plain_shape(w):
    kinds = ["a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in w]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k).encode("latin-1")


def plain_vectors(texts):
    """Word vectors by one loop over all pairs of neighbours, and each text's words with their own index vectors."""
    r, mask = quality.index_vectors(), quality.BUCKETS - 1
    table, seen = np.zeros((quality.BUCKETS, quality.DIM)), []
    for t in texts:
        words = WORD.findall((t or "").encode())
        bucket = [hashed(bytes(b + 32 if 65 <= b <= 90 else b for b in w)) & mask for w in words]
        own = [r[b] + r[quality.BUCKETS + (hashed(plain_shape(w)) & mask)] for b, w in zip(bucket, words)]
        for i, b in enumerate(bucket):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if i != j:
                    table[b] += own[j]
        seen.append((bucket, own))
    return table / np.maximum(np.sqrt((table**2).sum(axis=1, keepdims=True)), 1e-9), seen


def plain_pooled(vectors, seen):
    rows = [np.concatenate([vectors[b].mean(axis=0), np.mean(own, axis=0), [np.log1p(len(b))]]) if b else np.zeros(quality.FEATURES) for b, own in seen]
    return np.array(rows)


def tables(spark):
    texts = texts_of(300, 2)
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "you"), (None, "a null id"), (7, texts[8])]
    labels = [(k, int("idiot" in (t or "") or "1d1ot" in (t or "")), int("fox" in (t or ""))) for k, t in enumerate(texts)] + [(None, 1, 1), (5, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def plain_sample(rows, labels, column):
    """The documents learnt from, in order of id: the least text of each, and the greatest label."""
    import zlib

    truth = defaultdict(list)
    for r in labels.collect():
        if r["doc_id"] is not None and r[column] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            truth[r["doc_id"]].append(r[column])
    out = []
    for d in sorted(truth):
        found = [t for k, t in rows if k == d]
        if found:
            out.append((d, min((t for t in found if t is not None), default=None), max(truth[d])))
    return out


def test_quality_scores_against_the_plain_version(spark):
    rows, docs, labels = tables(spark)
    vectors, seen = plain_vectors([t for _, t in rows])
    assert np.allclose(quality.word_vectors(docs), vectors, atol=1e-6)
    by_text = {t: s for (_, t), s in zip(rows, seen)}
    sample = plain_sample(rows, labels, "quality")
    x = plain_pooled(vectors.astype(np.float32), [by_text[t] for _, t, _ in sample]).astype(np.float32).astype(float)
    network = quality.Network().fit(x, np.array([y for _, _, y in sample], float))
    want = dict(zip((t for _, t in rows), network.probability(plain_pooled(vectors, seen))))
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(abs(r["score"] - want[r["text"]]) < 2e-3 for r in out)


def test_toxic_scores_against_the_plain_version(spark):
    rows, docs, labels = tables(spark)
    sample = plain_sample(rows, labels, "toxic")
    half = {r[0]: r[1] for r in spark.createDataFrame([(d,) for d, _, _ in sample], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))).collect()}

    def words_of(part):
        n, toxic, seen = Counter(y for _, _, y in part), Counter(), Counter()
        for _, t, y in part:
            own = {x for x in (letters(w, toxicity._LETTER) for w in WORD.findall((t or "").encode())) if len(x) > 1}
            seen.update(own)
            toxic.update(own if y else ())
        if not n[0] or not n[1]:
            return set()
        odds = {w: np.log((toxic[w] + 0.5) / (n[1] + 1)) - np.log((seen[w] - toxic[w] + 0.5) / (n[0] + 1)) for w in seen if toxic[w] >= toxicity.LEAST_DOCS}
        best = sorted((w for w in odds if odds[w] >= toxicity.LEAST_ODDS), key=lambda w: (-odds[w], np.uint64(hashed(w)).view(np.int64)))[: toxicity.LEARNT]
        return {hashed(w) for w in best}

    of_other = [words_of([r for r in sample if half[r[0]] == 1]), words_of([r for r in sample if half[r[0]] == 0])]
    everything = words_of(sample)
    model = toxicity.Boosted(np.sort(np.array(list(everything), np.uint64)))
    model.fit(np.array([plain_toxic(t, of_other[half[d]]) for d, t, _ in sample]), np.array([y for _, _, y in sample], float))
    want = {t: p for t, p in zip([t for _, t in rows], model.probability(np.array([plain_toxic(t, everything) for _, t in rows])))}
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(abs(r["score"] - want[r["text"]]) < 1e-6 for r in out)


def ranked(score, y):
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(score, kind="stable")
    s, rank = score[order], np.empty(len(score))
    first = np.searchsorted(s, s, "left")
    rank[order] = (first + np.searchsorted(s, s, "right") + 1) / 2
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def calibration_error(score, y, bins=10):
    at = np.minimum((score * bins).astype(int), bins - 1)
    return sum(abs(score[at == b].mean() - y[at == b].mean()) * (at == b).mean() for b in range(bins) if (at == b).any())


@HERE
@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_documents(spark, module, column):
    """Of sf0.1, the labelled quarter that no fold learnt from: order of the scores, and how far they are from shares."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = module.scored(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("held_out").join(labels.select("doc_id", column), "doc_id").where(f"{column} is not null").collect()
    score, y = np.array([r["score"] for r in out]), np.array([r[column] for r in out])
    auc, error = ranked(score, y), calibration_error(score, y)
    print(f"{column}: {len(y)} held out, AUC {auc:.4f}, calibration error {error:.4f}")
    assert len(y) > 500 and auc > 0.98 and error < 0.03
