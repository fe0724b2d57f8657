"""Language-model scoring by context-tree weighting over bytes, and a word-unigram base score.

A-Z are lower-cased, for words and model alike. Each byte is decomposed into eight binary decisions; the contexts of a decision are the bits of its byte so far and the
0, 1, ... DEPTH bytes before it. A node of the tree mixes its Krichevsky-Trofimov estimate with the product of its
children (contexts one byte longer), half and half; a prediction walks from the longest context that training has
visited to the root, mixing the estimates of all depths by their posterior weights (a context that it hasn't visited
predicts one half). The model's score is the base-10
logarithm of the text's probability, -log10(2) times its code length in bits. A text starts in the context of DEPTH
zero bytes and ends with one more zero byte as its end.

The probability of a byte depends on the DEPTH bytes before it only. So the distinct strings of DEPTH + 1 bytes are
counted, dealt by the last two context bytes, whose subtrees are whole in their bucket. The nodes above (contexts of 0
and 1 bytes) need the sums of all subtrees: a table of a fixed size, 257 x 255 nodes. Then batches of documents ask the
buckets for the log-probabilities of their distinct strings and sum the answers. Words go the same way, by hash.

Defined results: null text is empty and scores its end only; training rows are those with crc32(id) mod 5 <> 1; with no
training rows every estimate is its prior; an empty table gives no rows; repeated rows train as often as they occur.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, U, Words, batch_count, find, groups_of, in_batches, joined, pieces, saved, squeezed, texts_of, tidy, unsqueezed

DEPTH = 5
BATCH, PIECE = 8 << 20, 1 << 20
LN2, LN10 = math.log(2.0), math.log(10.0)
END_OF_TEXT = U(0x5851F42D4C957F2D)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5: shifted Stirling series, within 1e-13 of the value."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 9
        shift[small] += np.log(y[small])
        y[small] += 1
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - 2 * 0.5723649429247001 - log_gamma(a + b + 1.0)


def _grams(data, starts, ends, depth):
    """Per place (and each text's end) the bytes before it and its own, packed into 64 bits; and the text of each."""
    size = ends - starts + 1 + depth
    total = int(size.sum())
    buf = np.zeros(total, np.uint64)
    begin = np.cumsum(size) - size
    shift = np.repeat(begin + depth - starts, ends - starts)
    buf[np.arange(starts[0], ends[-1]) + shift] = data[starts[0] : ends[-1]]
    out = np.zeros(total, np.uint64)
    for k in range(depth + 1):
        out[depth:] |= buf[depth - k : total - k] << U(8 * k)
    inside = np.ones(total, bool)
    for k in range(depth):
        inside[begin + k] = False
    return out[inside], np.repeat(np.arange(len(starts)), ends - starts + 1)


def _context_bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    last_two = (gram >> U(8)) & U(0xFFFF)
    return ((last_two * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) % buckets


class Batch:
    def __init__(self, tab: pa.Table):
        data, self.starts, self.ends = texts_of(tab)
        self.data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.train = tab.column("train").to_numpy(zero_copy_only=False).astype(bool)

    def parts(self, depth: int):
        """Pieces of whole texts, few enough that a text's number fits beside a gram."""
        most = 1 << (64 - 8 * (depth + 1))
        for i, j in pieces(self.starts, self.ends + 1, PIECE):
            for k in range(i, j, most):
                yield k, min(k + most, j)

    def grams(self, i, j, depth):
        """Sorted (gram, text) of all places, packed into 64 bits, and where each distinct gram starts."""
        g, text = _grams(self.data, self.starts[i:j], self.ends[i:j], depth)
        both = (g << U(64 - 8 * (depth + 1))) | text.astype(np.uint64)
        both.sort()
        return both, groups_of(both >> U(64 - 8 * (depth + 1)))

    def words(self, i, j):
        base = self.starts[i]
        w = Words(self.data[base : self.ends[j - 1]], self.starts[i:j] - base, self.ends[i:j] - base)
        return np.concatenate([w.hash, np.full(j - i, END_OF_TEXT)]), np.concatenate([w.text, np.arange(j - i)])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]):
    """Distinct keys with their counts summed."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    run = groups_of(k)
    return k[run], np.add.reduceat(c, run) if len(run) else c


def _distinct(b: Batch, depth: int):
    """Distinct grams and word hashes of the texts, with how often they occur."""
    grams, gram_counts, words = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for i, j in b.parts(depth):
        both, run = b.grams(i, j, depth)
        grams.append(both[run] >> U(64 - 8 * (depth + 1)))
        gram_counts.append(np.diff(np.append(run, len(both))))
        words.append(b.words(i, j)[0])
        if len(grams) > 3:
            grams, gram_counts = ([x] for x in _merge(grams, gram_counts))
    word = np.sort(np.concatenate(words))
    run = groups_of(word)
    return _merge(grams, gram_counts), (word[run], np.diff(np.append(run, len(word))))


def _dealt(keys: tuple[np.ndarray, np.ndarray], kind: int, buckets: int):
    """Keys and counts by bucket, ascending within: the order of requests, and so of answers."""
    k, c = keys
    bucket = _context_bucket(k, buckets) if kind == 0 else ((k >> U(40)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    k, c, bucket = k[order], c[order], bucket[order]
    cut = groups_of(bucket)
    return k, c, bucket[cut], cut


def _count(batches, depth: int, buckets: int):
    """Training counts of grams (kind 0) and word hashes (kind 1), per bucket."""
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            found = _distinct(Batch(pa.Table.from_batches([b.slice(i, 4096)])), depth)
            for kind in (0, 1):
                k, c, bucket, cut = _dealt(found[kind], kind, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cut), kind), pa.int32()), pa.array(bucket, pa.int32()), *(pa.array([squeezed(y) for y in np.split(x, cut[1:])] if len(cut) else [], pa.binary()) for x in (_steps(k, cut), c.astype(np.uint32)))],
                    ["kind", "bucket", "keys", "counts"],
                )


def _steps(k: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Differences of the keys within each part."""
    d = np.diff(k, prepend=U(0))
    d[cut] = k[cut]
    return d


def _summed(tab: pa.Table) -> pa.Table:
    """Bucket: all batches' counts as one row."""
    k, c = _merge(_keys(tab), [x.astype(np.int64) for x in unsqueezed(tab, "counts", np.uint32)])
    return pa.table({"kind": tab.column("kind").slice(0, 1), "bucket": tab.column("bucket").slice(0, 1), "keys": pa.array([squeezed(_steps(k, np.zeros(1, int)))], pa.binary()), "counts": pa.array([squeezed(c)], pa.binary())})


def _ask(tab: pa.Table, depth: int, buckets: int) -> pa.Table:
    """Batch: its distinct keys, per bucket."""
    found = _distinct(Batch(tab), depth)
    parts = []
    for kind in (0, 1):
        k, _, bucket, cut = _dealt(found[kind], kind, buckets)
        parts.append(pa.table({
            "kind": pa.array(np.full(len(cut), kind), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "batch": pa.array(np.full(len(cut), tab.column("batch")[0].as_py()), pa.int32()),
            "keys": pa.array([squeezed(x) for x in np.split(_steps(k, cut), cut[1:])] if len(cut) else [], pa.binary()),
        }))
    return pa.concat_tables(parts)


def _keys(tab: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(x) for x in unsqueezed(tab, "keys", U)]


class Level:
    """The binary nodes of all contexts of one length: zeros, ones, ln KT, ln of the weighted probability."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, length: int):
        mask = (U(1) << U(8 * (length + 1))) - U(1) if length < 7 else U(0xFFFFFFFFFFFFFFFF)
        self.length = length
        g = grams & mask
        context, byte = g >> U(8), (g & U(255)).astype(np.int64)
        keys, ones, weights = [], [], []
        for bit in range(8):
            keys.append((context << U(8)) | ((1 << bit) | (byte >> (8 - bit))).astype(np.uint64))
            ones.append(((byte >> (7 - bit)) & 1).astype(bool))
            weights.append(counts)
        keys, ones, weights = np.concatenate(keys), np.concatenate(ones), np.concatenate(weights).astype(np.float64)
        seen = weights > 0
        keys, ones, weights = keys[seen], ones[seen], weights[seen]
        self.keys, inv = np.unique(keys, return_inverse=True)
        b = np.bincount(inv, weights=np.where(ones, weights, 0), minlength=len(self.keys))
        a = np.bincount(inv, weights=weights, minlength=len(self.keys)) - b
        self.a, self.b, self.kt = a, b, log_kt(a, b)
        self.weighted = self.kt

    def parent_keys(self) -> np.ndarray:
        """Keys of these nodes' parents: one context byte less, the same bits of the byte."""
        keep = (U(1) << U(8 * self.length)) - U(1)  # length - 1 context bytes and the bits
        return self.keys & keep

    def mix(self, below: Level) -> None:
        self.children = np.bincount(find(self.keys, below.parent_keys()), weights=below.weighted, minlength=len(self.keys))
        self.weighted = np.logaddexp(self.kt, self.children) - LN2


def _ends(mask_len: int) -> U:
    return (U(1) << U(8 * mask_len)) - U(1)


def _predict(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """ln probability of each gram's last byte; levels[d] are the contexts of d bytes."""
    out = np.zeros(len(grams))
    byte = (grams & U(255)).astype(np.int64)
    for bit in range(8):
        prefix, one = ((1 << bit) | (byte >> (8 - bit))).astype(np.uint64), ((byte >> (7 - bit)) & 1).astype(bool)
        p = np.full(len(grams), 0.5)  # a node that training has not visited: one half, as all below it
        for level in reversed(levels):
            context = (grams >> U(8)) & _ends(level.length) if level.length else np.zeros(len(grams), np.uint64)
            at = find(level.keys, (context << U(8)) | prefix)
            have = at >= 0
            at = np.where(have, at, 0)
            if not len(level.keys):
                continue
            n = level.a[at] + level.b[at]
            own = (np.where(one, level.b[at], level.a[at]) + 0.5) / (n + 1.0)
            if level is levels[-1]:
                here = own
            else:  # posterior weight of this node's own estimate against its children
                w = np.exp(level.kt[at] - LN2 - level.weighted[at])
                here = w * own + (1 - w) * p
            p = np.where(have, here, p)
        out += np.log(p)
    return out


def _tops(tab: pa.Table, depth: int) -> pa.Table:
    """Bucket: for each node of a two-byte context its counts and weighted probability; words (node -1): V and N."""
    k, c = _keys(tab)[0], unsqueezed(tab, "counts", np.int64)[0]
    if tab.column("kind")[0].as_py() == 1:
        node, sums = np.array([-1]), [np.array([len(c)]), np.array([c.sum()]), np.zeros(1)]
    else:
        top = _subtree(k, c, depth)[0]
        node, inv = np.unique(top.parent_keys(), return_inverse=True)
        sums = [np.bincount(inv, weights=x, minlength=len(node)) for x in (top.a, top.b, top.weighted)] if len(node) else [np.zeros(0)] * 3
    return pa.table({"node": pa.array(node.astype(np.int64)), "a": pa.array(sums[0].astype(np.int64)), "b": pa.array(sums[1].astype(np.int64)), "weighted": pa.array(sums[2], pa.float64())})


def _subtree(k: np.ndarray, c: np.ndarray, depth: int) -> list[Level]:
    """Levels 2 to depth of the grams' contexts, mixed from the longest up."""
    train = c > 0
    levels = [Level(k[train], c[train], d) for d in range(2, depth + 1)]
    for low in range(len(levels) - 2, -1, -1):
        levels[low].mix(levels[low + 1])
    return levels


def upper_levels(node: np.ndarray, a: np.ndarray, b: np.ndarray, weighted: np.ndarray) -> list[Level]:
    """Levels 0 and 1 from the sums over the two-byte contexts below each node of level 1."""
    one, zero = (object.__new__(Level) for _ in range(2))
    order = np.argsort(node)
    one.length, one.keys, one.a, one.b = 1, node[order].astype(np.uint64), a[order].astype(float), b[order].astype(float)
    one.kt, one.children = log_kt(one.a, one.b), weighted[order]
    one.weighted = np.logaddexp(one.kt, one.children) - LN2
    zero.length = 0
    zero.keys, inv = np.unique(one.parent_keys(), return_inverse=True)
    zero.a, zero.b, zero.children = (np.bincount(inv, weights=x, minlength=len(zero.keys)) for x in (one.a, one.b, one.weighted)) if len(inv) else (np.zeros(0),) * 3
    zero.kt = log_kt(zero.a, zero.b)
    zero.weighted = np.logaddexp(zero.kt, zero.children) - LN2
    return [zero, one]


def _answer(asked: pa.Table, counts: pa.Table, depth: int, upper: list[Level]) -> pa.Table:
    """Bucket: to each batch its grams' ln probabilities, or its words' counts, in the order asked."""
    if not asked.num_rows:
        return pa.table({"batch": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "answers": pa.array([], pa.binary())})
    keys = _keys(asked)
    k = np.unique(np.concatenate(keys))
    have, c = (_keys(counts)[0], unsqueezed(counts, "counts", np.int64)[0]) if counts.num_rows else (np.zeros(0, U), np.zeros(0, np.int64))
    if asked.column("kind")[0].as_py() == 1:
        at = find(have, k)
        value = np.where(at >= 0, c[at] if len(c) else 0, 0).astype(np.int64)
    else:
        levels = upper + _subtree(have, c, depth)
        value = np.concatenate([_predict(k[i : i + 100_000], levels) for i in range(0, len(k), 100_000)])
    return pa.table({"batch": asked.column("batch"), "kind": asked.column("kind"), "bucket": asked.column("bucket"), "answers": pa.array([squeezed(value[np.searchsorted(k, x)]) for x in keys], pa.binary())})


def _score(docs: pa.Table, answers: pa.Table, depth: int, buckets: int, n: int, v: int) -> pa.Table:
    """Batch: sum the answers over each text's places and words."""
    b = Batch(docs)
    found = _distinct(b, depth)
    known = []
    for kind, dtype in ((0, np.float64), (1, np.int64)):
        part = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("bucket")
        k = _dealt(found[kind], kind, buckets)[0]
        order = np.argsort(k)
        known.append((k[order], joined(unsqueezed(part, "answers", dtype), dtype)[order]))
    score, base, tokens, hits = (np.zeros(len(b.starts)) for _ in range(4))
    for i, j in b.parts(depth):
        both, run = b.grams(i, j, depth)
        value = known[0][1][np.searchsorted(known[0][0], both[run] >> U(64 - 8 * (depth + 1)))]
        text = (both & U((1 << (64 - 8 * (depth + 1))) - 1)).view(np.int64)
        score[i:j] = np.bincount(text, weights=np.repeat(value, np.diff(np.append(run, len(both)))), minlength=j - i) / LN10
        h, t = b.words(i, j)
        c = known[1][1][np.searchsorted(known[1][0], h)]
        base[i:j] = np.bincount(t, weights=np.log10((c + 0.5) / (n + 0.5 * (v + 1))), minlength=j - i)
        tokens[i:j], hits[i:j] = np.bincount(t, minlength=j - i), np.bincount(t, weights=c > 0, minlength=j - i)
    return pa.table({
        "id": docs.column("id"), "held_out": pa.array(~b.train), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(hits.astype(np.int64)),
        "train_tokens": pa.array(np.full(len(b.starts), n)), "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(b.ends - b.starts),
    })


def ctw_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, batch_bytes: int = BATCH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes)"""
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    n, total = batch_count(docs, batch_bytes, text)
    buckets = max(8, total >> 20)  # of about 1 MB of text each
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    batched = in_batches(docs, n, key, text).withColumn("train", ~held_out)
    training = batched.where("train").select("text", "train")
    counts = saved(training.mapInArrow(lambda it: _count(it, depth, buckets), "kind int, bucket int, keys binary, counts binary").groupBy("kind", "bucket").applyInArrow(lambda t: tidy(_summed(t)), "kind int, bucket int, keys binary, counts binary"))
    # 257 x 255 nodes at most, and the words' totals: a bounded table
    tops = counts.groupBy("kind", "bucket").applyInArrow(lambda t: tidy(_tops(t, depth)), "node long, a long, b long, weighted double")
    rows = tops.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("weighted")).toArrow()
    node, a, b, w = (rows.column(c).to_numpy() for c in ("node", "a", "b", "weighted"))
    words, nodes = node == -1, node != -1
    distinct, tokens = (int(x[words].sum()) for x in (a, b))
    upper = upper_levels(node[nodes], a[nodes], b[nodes], w[nodes])
    asked = batched.groupBy("batch").applyInArrow(lambda t: tidy(_ask(t, depth, buckets)), "kind int, bucket int, batch int, keys binary")
    answers = asked.groupBy("kind", "bucket").cogroup(counts.groupBy("kind", "bucket")).applyInArrow(lambda q, c: tidy(_answer(q, c, depth, upper)), "batch int, kind int, bucket int, answers binary")
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    out = batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda d, s: tidy(_score(d, s, depth, buckets, tokens, distinct)), schema)
    return out.withColumn("id", F.nullif(F.col("id"), F.lit(int(NO_ID))))


def query(spark, sf_dir: str) -> DataFrame:
    return ctw_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
