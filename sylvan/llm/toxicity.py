"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of two lexicons (a fixed one, and one learnt from the labelled sample; each half of the
sample is measured with the words learnt from the other half, so that the trees see what they are worth),
how near second-person words stand to a lexicon word, capitals, punctuation, and obfuscation (lexicon words
found only after dropping symbols or reading digits as letters, and words with symbols inside). Each text is
measured whole, in numpy on flat bytes. Trees are fitted by histograms on three quarters of the sample; on
the last quarter, isotonic regression maps their output to probabilities.

The fitted model has a fixed size (trees, calibration knots, a lexicon of at most ``LEARNT`` words' hashes)
and alone is broadcast. Scoring is one narrow pass.

Defined results. Null or empty text: all features 0, which have a score too. Very long texts: whole, each by itself
in memory. Null label or doc_id: not learnt from; of several labels of an id the greatest counts, of several texts
the least. Ties: words with equal odds go by hash, equal texts have equal scores, and a score of the threshold is
predicted 1. Repeated rows: scored alike. No labels of both kinds: every score is the share of 1 among those
there are, 0.5 without any. Empty table: no rows. Other columns, whatever their names, are carried along by
``classify``; one that is named score gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from sylvan.llm import learn, text as T
from sylvan.llm.arrow import in_arrow
from sylvan.llm.columns import extended, without
from sylvan.session import cut

#: Insults in the four languages of the corpus.
LEXICON = (
    "idiot idiots moron morons stupid trash pathetic worthless disgusting clown scum loser losers dumb fool jerk garbage filth "
    "imbecile cretin bastard bitch crap damn hate shut vermin ugly liar coward freak pig "
    "dumm dummkopf trottel depp blöd blödmann abschaum versager müll widerlich arschloch schwein hassen "
    "imbécile crétin connard salaud ordure débile minable abruti pourriture merde "
    "idiota imbécil estúpido estúpida basura asqueroso patético payaso inútil perdedor tonto escoria mierda"
).split()
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros".split()
NEAR = 3
#: Words learnt at most, from how many toxic documents at least, with what log odds at least.
LEARNT, LEAST_DOCS, LEAST_ODDS = 200, 4, 3.0
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 80, 3, 48, 0.15, 20
NAMES = (
    "fixed_share fixed_count learnt_share learnt_count near_person persons capital_letters capital_words exclaims questions "
    "symbols digits hidden_share broken_words word_length repeats length"
).split()


def _classes() -> np.ndarray:
    """Lower-case letters as they are, capitals made small, anything else 0; bytes of other alphabets are letters."""
    t = np.zeros(256, np.uint8)
    t[97:123], t[65:91] = np.arange(97, 123), np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_LETTER = _classes()
_READ = _LETTER.copy()
for _a, _b in zip("013457@$!", "oieastasi"):
    _READ[ord(_a)] = ord(_b)


def _letters_only(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number) of each word's letters under a table, others dropped."""
    seen = table[data]
    keep = seen > 0
    place = np.concatenate([[0], np.cumsum(keep)])
    a, b = place[begin], place[end]
    return T.hash_spans(seen[keep], a, b), b - a


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words as ``_letters_only`` makes them."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return np.unique(_letters_only(data, ends - [len(w) for w in raw], ends, _LETTER)[0])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a small set: a table over 16 bits first, then exactly."""
    table = np.zeros(1 << 16, bool)
    table[known & np.uint64(0xFFFF)] = True
    out = table[h & np.uint64(0xFFFF)]
    at = np.flatnonzero(out)
    out[at] = np.isin(h[at], known)
    return out


_FIXED, _PERSON = word_hashes(LEXICON), word_hashes(SECOND_PERSON)


def features(data: np.ndarray, offsets: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES))."""
    begin, end, first = T.words(data, offsets)
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), np.diff(first))
    n = np.maximum(np.diff(first), 1).astype(np.float64)
    per = lambda x: np.bincount(owner, x, docs)
    h, letters = _letters_only(data, begin, end, _LETTER)
    fixed, new = _among(h, _FIXED), _among(h, learnt) if len(learnt) else np.zeros(len(h), bool)
    person = _among(h, _PERSON)
    read, _ = _letters_only(data, begin, end, _READ)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    capital, letter = count((data >= 65) & (data <= 90)), count(_LETTER[data] > 0)
    symbol = count((_LETTER[data] == 0) & ~((data >= 48) & (data <= 57)))
    spread = np.zeros(len(h), bool)
    hit = fixed | new
    for k in range(1, NEAR + 1):
        same = owner[k:] == owner[:-k]
        spread[k:] |= person[:-k] & same
        spread[:-k] |= person[k:] & same
    inner = (end - begin) - letters
    hidden = (_among(read, _FIXED) & ~fixed) | (hit & (inner > 0) & (symbol[end] - symbol[np.maximum(end - 1, begin)] == 0))
    caps_word = (capital[end] - capital[begin] >= 2) & (capital[end] - capital[begin] == letters)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    of_text = lambda c: (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    cols = [
        per(fixed) / n, np.minimum(per(fixed), 20), per(new) / n, np.minimum(per(new), 20), per(hit & spread) / n, per(person) / n,
        of_text(capital), per(caps_word) / n, of_text(count(data == 33)), of_text(count(data == 63)),
        of_text(symbol), of_text(count((data >= 48) & (data <= 57))), per(hidden) / n, per(inner > 2) / n,
        per((end - begin).astype(np.float64)) / n, per(again) / n, np.log1p(np.diff(first)),
    ]
    return np.stack(cols, axis=1) if docs else np.empty((0, len(NAMES)))


class Boosted:
    """Regression trees on the gradient of the logistic loss, split by histograms; then isotonic knots."""

    def __init__(self, learnt: np.ndarray, share: float = 0.5) -> None:
        self.learnt, self.share = learnt, share
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.share = float(y.mean()) if len(y) else 0.5
        if len(y) < 40 or not 0 < self.share < 1:
            return self
        order = np.random.default_rng(11).permutation(len(y))
        rest, seen = order[: len(y) // 4], order[len(y) // 4 :]
        xs, ys = x[seen], y[seen]
        share = np.clip(ys.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in xs.T]
        edges = [np.unique(np.concatenate([e, np.quantile(c[c > 0], np.linspace(0, 1, 12)[:-1]) - 1e-12])) if (c > 0).any() else e for e, c in zip(edges, xs.T)]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, xs.T)], axis=1)
        f = np.full(len(ys), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, edges, p - ys, p * (1 - p))
            self.trees.append(tree)
            f += self._tree(tree, xs)
        self.knots = isotonic(self.raw(x[rest]), y[rest])
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree of DEPTH levels as arrays: feature (-1: no split), threshold, leaf values."""
        inner = (1 << DEPTH) - 1
        feature, threshold, value = np.full(inner, -1), np.zeros(inner), np.zeros(1 << DEPTH)
        node = np.zeros(len(g), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best, pick = 1e-6, None
            if len(at) >= 2 * LEAST_LEAF:
                total_g, total_h = g[at].sum(), h[at].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[at, j]
                    cg, ch, cn = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[at], h[at], None))
                    gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                    gain[(cn < LEAST_LEAF) | (len(at) - cn < LEAST_LEAF)] = -1
                    if gain.max() > best:
                        best, pick = float(gain.max()), (j, int(gain.argmax()))
            if pick:
                feature[k], threshold[k] = pick[0], edges[pick[0]][pick[1]]
                node[at] = 2 * k + 1 + (binned[at, pick[0]] > pick[1])
            else:
                node[at] = 2 * k + 1
        for leaf in range(1 << DEPTH):
            at = node == inner + leaf
            value[leaf] = -RATE * g[at].sum() / (h[at].sum() + 1) if at.any() else 0.0
        return feature, threshold, value

    def _tree(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > threshold[node]))
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((self._tree(t, x) for t in self.trees), np.full(len(x), self.start))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the best non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of score
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5 * b[0] / b[1]) / (b[1] + 0.5) for b in blocks])


def _learn_words(sample: DataFrame) -> np.ndarray:
    """Hashes of the words that mark label 1 in the sample: counts of documents by word, then the best odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(0))
            label = np.array(batch.column(1).to_pylist(), np.int64)
            for a, b in T.steps(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                begin, end, first = T.words(part, off)
                h, letters = _letters_only(part, begin, end, _LETTER)
                owner = np.repeat(np.arange(b - a), np.diff(first))
                v, t, _ = T.distinct(h[letters > 1], owner[letters > 1])
                yield pa.RecordBatch.from_pydict({"h": pa.array(v.view(np.int64)), "toxic": pa.array(label[a:b][t])})

    counts = sample.groupBy("label").count().collect()  # two rows
    n = {r["label"]: r["count"] for r in counts}
    if not n.get(0) or not n.get(1):
        return np.empty(0, np.uint64)
    per = in_arrow(sample.select("text", "label"), run, "h long, toxic long").groupBy("h").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n[0] + 1))
    best = per.where(F.col("t") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.col("odds").desc(), "h").limit(LEARNT).select("h")
    return np.sort(np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = learn.MOST_ROWS) -> Boosted:
    sample = cut(learn.labelled_sample(docs, labels, target, most))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    sample = sample.withColumn("half", half.cast("int"))
    of_other = [_learn_words(sample.where(F.col("half") == 1)), _learn_words(sample.where(F.col("half") == 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(1))
            own = np.array(batch.column(3).to_pylist(), np.int64)
            for a, b in T.steps(offsets):
                x, y = (features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words) for words in of_other)
                x = np.where(own[a:b, None] == 0, x, y)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "label": batch.column(2).slice(a, b - a), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    rows = in_arrow(sample.select("doc_id", "text", "label", "half"), run, "doc_id long, label int, x binary").collect()  # at most ``most`` rows
    rows.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float64).reshape(-1, len(NAMES))
    return Boosted(_learn_words(sample)).fit(x, np.array([r["label"] for r in rows], np.float64))


def classify(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = learn.MOST_ROWS) -> DataFrame:
    """The documents with ``score``, the probability of label 1."""
    docs = without(docs, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, target, most))
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = T.utf8(batch.column(at))
            scores = [model.probability(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.learnt)) for a, b in T.steps(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], names=names)

    return in_arrow(docs, run, extended(docs, score=DoubleType()))


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = classify(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", learn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
