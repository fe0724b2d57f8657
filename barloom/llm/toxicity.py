"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystrom landmarks.

An instance is the window of WINDOW bytes at a word's start, and in words that go on behind it every STARTS bytes until
the word's end is covered, so that each span of SPAN bytes of a word lies whole in a window (scripts without spaces are
long words). Bytes are A-Z lower-cased and put into 32 classes. The kernel of
two windows sums, over all byte subsequences of length 4 that span at most SPAN bytes, the products of their weights
DECAY^gaps: a letter put into an insult, or an ending put behind its stem, leaves most of them. Labelled documents are
cut into sentences; a toxic document's label goes to its highest-scoring windows (its witnesses), clean documents give
their highest-scoring windows, and the machine is trained again with new witnesses ROUNDS times. In the landmarks'
feature space the machine is linear, so its kernel expansion is summed up once into a table over subsequences: scoring a
window is a sum of look-ups. A text's score is a logistic function of its TOP highest windows (one stray likeness is
not yet an insult), fitted on training documents that the machine did not see.

Training uses at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean labelled rows of up to SAMPLE_BYTES bytes, those whose
ids hash lowest; scoring reads every byte of every text. Defined results: null or wordless texts get the score of a
window at FLOOR; without toxic or without clean training rows every score is the share of toxic ones (0 if there are
none); labels that are null are no labels; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, pieces, released, texts_of, tidy

WINDOW, SPAN, DECAY, FLOOR, THRESHOLD = 12, 6, 0.6, -3.0, 0.3
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 4000, 8000
LANDMARKS, ROUNDS, PIECE = 320, 3, 1 << 20
#: Windows that training handles at once.
ROWS = 2048
#: Highest windows of a text that its score depends on; witnesses of a toxic text that score above what is usual (the
#: quantile of the clean texts' highest windows), and of one without such windows.
TOP, WITNESSES, USUAL, FEWER = 4, 3, 0.9, 3
#: Offsets of a subsequence's 2nd, 3rd and 4th byte.
OFFSETS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
STARTS = WINDOW - SPAN + 1


def _classes() -> np.ndarray:
    out = np.full(256, 30, np.uint8)  # digits, signs
    for k in range(26):
        out[65 + k] = out[97 + k] = k
    out[[9, 10, 11, 12, 13, 32]] = 31
    out[128:192] = 27 + np.arange(64) % 3  # continuation bytes
    out[192:] = 26
    return out


CLASSES = _classes()


def coded(data: np.ndarray) -> np.ndarray:
    return CLASSES[data]


def strings(code: np.ndarray, place: np.ndarray, offsets: tuple[int, int, int]) -> np.ndarray:
    """The class strings of four places each; the code goes on far enough."""
    out = code[place].astype(np.int32)
    for o in offsets:
        out = out << 5 | code[place + o]
    return out


def window_places(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where windows begin: at word starts, and every STARTS bytes in a word until a window reaches its end."""
    letter = code < 30
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    inside = starts[starts < len(code)]
    begin[inside] = letter[inside]
    first = np.flatnonzero(begin)
    stop = np.append(np.flatnonzero(~letter | begin), len(code))
    size = stop[np.searchsorted(stop, first, "right")] - first
    n = 1 + np.maximum(0, -((WINDOW - size) // STARTS))
    return np.repeat(first, n) + STARTS * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))


WEIGHTS = np.array([DECAY ** (c - 3) for _, _, c in OFFSETS], np.float32)


def window_scores(code: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The machine's value for the windows at the given ascending places."""
    out = np.zeros(len(at))
    for low in range(0, len(code), PIECE):
        x = code[low : low + PIECE + WINDOW + SPAN].astype(np.int32)
        n = len(x)
        x = np.concatenate([x, np.full(SPAN, 31, np.int32)])
        first = x[:n] << 15
        g = np.zeros(n + STARTS)
        for (a, b, c), w in zip(OFFSETS, WEIGHTS, strict=True):
            g[:n] += w * table[first | (x[a : n + a] << 10) | (x[b : n + b] << 5) | x[c : n + c]]
        s = np.concatenate([[0.0], np.cumsum(g)])
        i, j = np.searchsorted(at, [low, low + PIECE])
        p = at[i:j] - low
        out[i:j] = s[p + STARTS] - s[p]
    return out


def sentences(text: bytes) -> list[tuple[int, int]]:
    """Sentences end at . ! ? or a line's end."""
    a = np.frombuffer(text, np.uint8)
    cut = np.flatnonzero((a == 46) | (a == 33) | (a == 63) | (a == 10)) + 1
    ends = np.append(cut, len(a))
    begins = np.append(0, cut)
    return [(int(i), int(j)) for i, j in zip(begins, ends, strict=True) if j > i]


def top_scores(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, TOP): the highest values of each owner in descending order, FLOOR where there are fewer."""
    out = np.full((n, TOP), FLOOR)
    order = np.lexsort((-value, owner))
    o = owner[order]
    rank = np.arange(len(o)) - np.searchsorted(o, o)
    keep = rank < TOP
    out[o[keep], rank[keep]] = np.maximum(value[order[keep]], FLOOR)
    return out


class Sample:
    """Labelled sentences: their windows' places and document, in one coded array."""

    def __init__(self, texts: list[bytes]):
        # sentences of a text stay apart: spaces of a window's length between them
        parts, doc, starts, at, self.begin = [], [], [], 0, []
        for d, t in enumerate(texts):
            self.begin.append(at)
            for i, j in sentences(t):
                parts.append(t[i:j] + b" " * WINDOW)
                starts.append(at)
                doc.append(d)
                at += j - i + WINDOW
        self.code = coded(np.frombuffer(b"".join(parts), np.uint8))
        starts = np.array(starts, np.int64)
        self.at = window_places(self.code, starts)
        self.sentence = np.searchsorted(starts, self.at, "right") - 1
        self.doc = np.array(doc, np.int64)[self.sentence] if len(starts) else np.zeros(0, np.int64)
        self.docs = len(texts)

    def best(self, score: np.ndarray, k: int) -> np.ndarray:
        """The k best windows of each document."""
        order = np.lexsort((-score, self.doc))
        d = self.doc[order]
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        return order[rank < k]

    def top(self, score: np.ndarray) -> np.ndarray:
        return top_scores(score, self.doc, self.docs)

    def features(self, windows: np.ndarray) -> np.ndarray:
        """(windows, STARTS * len(OFFSETS)): the class strings of the subsequences in each window."""
        x, place = np.concatenate([self.code, np.full(WINDOW + SPAN, 31, np.uint8)]), self.at[windows]
        return np.stack([strings(x, place + s, o) for s in range(STARTS) for o in OFFSETS], 1)


FEATURE_WEIGHTS = np.tile(WEIGHTS, STARTS)


def first_scores(toxic: Sample, clean: Sample) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of four-byte strings by the share of documents that have them: the first witnesses."""

    def share(s: Sample) -> np.ndarray:
        out = np.zeros(1 << 20, np.int64)
        begin = np.append(s.begin, len(s.code))
        for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):  # a document's places lie together
            x = np.concatenate([s.code[i : j + 3], np.full(3, 31, np.uint8)])
            out[np.unique(strings(x, np.arange(j - i), (1, 2, 3)))] += 1
        return out

    t, c = share(toxic), share(clean)
    odds = np.log((t + 0.5) / (toxic.docs + 1)) - np.log((c + 0.5) / (clean.docs + 1))
    odds = np.where(t >= 3, odds, np.minimum(odds, 0))

    def score(s: Sample) -> np.ndarray:
        x = np.concatenate([s.code, np.full(SPAN, 31, np.uint8)])
        return sum(odds[strings(x, s.at + k, (1, 2, 3))] for k in range(3))

    return score(toxic), score(clean)


class Kernel:
    """The subsequence kernel against landmark windows, and the landmarks' feature space."""

    def __init__(self, landmarks: np.ndarray):
        self.strings, where = np.unique(landmarks, return_inverse=True)
        m = len(landmarks)
        self.z = np.zeros((len(self.strings) + 1, m))
        np.add.at(self.z, (where.reshape(landmarks.shape), np.arange(m)[:, None]), FEATURE_WEIGHTS[None, :])
        inner = self.z.T @ self.z
        value, vector = np.linalg.eigh(inner)
        keep = value > 1e-6 * value.max()
        self.whiten = vector[:, keep] / np.sqrt(value[keep])

    def map(self, features: np.ndarray) -> np.ndarray:
        out = np.empty((len(features), self.whiten.shape[1]), np.float32)
        for i in range(0, len(features), ROWS):
            f = features[i : i + ROWS]
            at = np.minimum(np.searchsorted(self.strings, f), len(self.strings) - 1)
            at = np.where(self.strings[at] == f, at, len(self.strings))  # the last row is zero
            part = np.zeros((len(f), self.z.shape[1]))
            for k in range(f.shape[1]):
                part += FEATURE_WEIGHTS[k] * self.z[at[:, k]]
            out[i : i + ROWS] = part @ self.whiten
        return out

    def table(self, weights: np.ndarray) -> np.ndarray:
        """The linear machine in landmark space as weights of subsequences."""
        out = np.zeros(1 << 20, np.float32)
        out[self.strings] = (self.z[:-1] @ (self.whiten @ weights)).astype(np.float32)
        return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the support vectors."""
    w, n = np.zeros(x.shape[1] + 1), x.shape[1]
    penalty = np.full(n + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        support = np.flatnonzero(y * (x @ w[:-1].astype(np.float32) + w[-1]) < 1)
        h, g = np.diag(penalty), np.zeros(n + 1)
        for i in range(0, len(support), ROWS):
            k = support[i : i + ROWS]
            a = np.column_stack([x[k], np.ones(len(k))]).astype(np.float64)
            h += a.T @ (a * cost[k][:, None])
            g += a.T @ (cost[k] * y[k])
        new = np.linalg.solve(h, g)
        if np.abs(new - w).max() < 1e-6:
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def _logistic(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a text's highest window values, and the offset, of the logistic curve; damped Newton."""
    s = np.column_stack([score, np.ones(len(score))])
    prior = np.append(1 / np.arange(1, score.shape[1] + 1), 0.0)
    w, ridge = prior.copy(), np.append(np.full(score.shape[1], 1.0), 1e-3)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(s @ w, -40, 40)))
        h = s.T @ (s * (p * (1 - p))[:, None]) + np.diag(ridge)
        w = w - np.clip(np.linalg.solve(h, s.T @ (p - target) + ridge * (w - prior)), -1, 1)
    return w


class Model:
    """Table of subsequence weights, the machine's offset, and the logistic curve; or a constant."""

    def __init__(self, table=None, bias=0.0, curve=None, constant=None):
        self.table, self.bias, self.curve, self.constant = table, bias, curve, constant

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        best = np.full((len(starts), TOP), FLOOR)
        for i, j in pieces(starts, ends, PIECE):
            size = ends[i:j] - starts[i:j] + WINDOW  # texts apart by a window of spaces
            begin = np.cumsum(size) - size
            code = np.full(int(size.sum()), 31, np.uint8)
            code[np.arange(starts[i], ends[j - 1]) + np.repeat(begin - starts[i:j], ends[i:j] - starts[i:j])] = coded(data[starts[i] : ends[j - 1]])
            at = window_places(code, begin)
            if len(at):
                best[i:j] = top_scores(window_scores(code, self.table, at) + self.bias, np.searchsorted(begin, at, "right") - 1, j - i)
        return 1 / (1 + np.exp(-np.clip(best @ self.curve[:-1] + self.curve[-1], -40, 40)))


def train(toxic: list[bytes], clean: list[bytes]) -> Model:
    """Fit on labelled texts; every fourth text only calibrates."""
    if not toxic or not clean:
        return Model(constant=1.0 if toxic else 0.0)
    fit, rest = ([t for i, t in enumerate(x) if i % 4] for x in (toxic, clean)), ([t for i, t in enumerate(x) if not i % 4] for x in (toxic, clean))
    (tf, cf), (tr, cr) = fit, rest
    t, c = Sample(tf or toxic), Sample(cf or clean)
    if not len(t.at) or not len(c.at):
        return Model(constant=len(toxic) / (len(toxic) + len(clean)))
    st, sc = first_scores(t, c)
    table, bias = None, 0.0
    for _ in range(ROUNDS):
        high = np.quantile(c.top(sc)[:, 0], USUAL)
        pos, neg = t.best(st, WITNESSES), c.best(sc, 3)
        clear = pos[st[pos] > high]
        few = t.best(st, FEWER)
        pos = np.concatenate([clear, few[~np.isin(t.doc[few], t.doc[clear])]])
        other = np.unique(np.linspace(0, len(c.at) - 1, min(len(c.at), 2 * c.docs)).astype(int))
        neg = np.unique(np.concatenate([neg, other]))
        fp, fn = t.features(pos), c.features(neg)
        # landmarks: witnesses with different beginnings, the commonest first, and clean windows
        _, first, count = np.unique(fp[:, 0], return_index=True, return_counts=True)
        zp = first[np.argsort(-count, kind="stable")][: LANDMARKS * 3 // 4]
        more = np.setdiff1d(np.linspace(0, len(fp) - 1, min(len(fp), LANDMARKS * 3 // 4)).astype(int), zp)[: max(0, LANDMARKS * 3 // 4 - len(zp))]
        zn = np.linspace(0, len(fn) - 1, min(len(fn), LANDMARKS // 4)).astype(int)
        kernel = Kernel(np.concatenate([fp[zp], fp[more], fn[zn]]))
        x = kernel.map(np.concatenate([fp, fn]))
        y = np.concatenate([np.ones(len(fp)), -np.ones(len(fn))])
        w, bias = train_svm(x, y, np.where(y > 0, len(fn) / len(fp) / 3, 1.0))
        table = kernel.table(w)
        st, sc = window_scores(t.code, table, t.at) + bias, window_scores(c.code, table, c.at) + bias
    held = [(Sample(x), lab) for x, lab in ((tr or toxic, 1), (cr or clean, 0))]
    best = [s.top(window_scores(s.code, table, s.at) + bias) if len(s.code) else np.full((s.docs, TOP), FLOOR) for s, _ in held]
    return Model(table, bias, _logistic(np.concatenate(best), np.concatenate([np.full(len(b), lab, float) for b, (_, lab) in zip(best, held, strict=True)])))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on the labelled documents that aren't held out."""
    rows = labels.where(~held_out(key) & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).dropDuplicates(["k"])
    short = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(key).alias("k"), F.xxhash64(key).alias("h"))
    rows = rows.join(short, "k", "left_semi").withColumn("h", F.xxhash64("k"))
    chosen = rows.where("y = 1").orderBy("h", "k").limit(SAMPLE_TOXIC).unionByName(rows.where("y = 0").orderBy("h", "k").limit(SAMPLE_CLEAN))
    # the limits bound what is broadcast and collected: at most 6000 rows of 8 kB, a fifth of it on average
    got = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "h", "t").toArrow()
    rows = sorted(set(zip(got.column("h").to_pylist(), got.column("k").to_pylist(), got.column("y").to_pylist(), got.column("t").cast(pa.binary()).to_pylist(), strict=True)))
    del got
    return tidy(train([t for _, _, y, t in rows if y == 1], [t for _, _, y, t in rows if y == 0]))


def toxicity(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with one more column, the probability of a toxic label; it replaces a column of its name."""
    docs = docs.drop(name) if name != text else docs.withColumnRenamed(text, text := free_name("text", docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    schema = StructType([*docs.schema, StructField(name, DoubleType())])

    def score(batches):
        for b in batches:
            tab = pa.Table.from_batches([b])
            yield from tab.append_column(name, pa.array(shared.value.scores(*texts_of(tab, text)), pa.float64())).to_batches()

    return docs.mapInArrow(released(score), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    scored = toxicity(docs, fit(docs, labels), name="score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
