"""Removal of repeated byte strings by suffix sorting with hash comparisons.

Each byte covered by a LENGTH-byte string that also starts in a document with a smaller id goes. All suffixes of a
corpus can't be shuffled, so each LENGTH-byte window is dealt to its anchor, the K-byte string of least hash in it
(leftmost of equals): equal windows have equal anchors at equal offsets. Rounds:

1. Batches send the hashes of their anchors to buckets, which answer with those seen in two documents or more.
2. Batches send the distinct stretches of text around such anchors. A bucket sorts the window suffixes of all
   stretches of an anchor by mergesort; two suffixes are compared by binary search for their longest common extension
   over prefix polynomial hashes, and neighbours found equal are compared byte by byte. Each window so gets the
   smallest id that holds it.
3. Batches mark the windows held by a smaller id and cut the marked bytes out.

Defined results: null text is empty; rows that share an id never remove bytes of one another; a null id ranks last;
texts below LENGTH bytes keep all bytes; an empty table gives no rows. A 64-bit hash that two different strings share
stops the job (then choose another seed) instead of giving a wrong result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import NO_ID, PrefixHash, U, batch_count, blobs, find, free_name, groups_of, in_batches, joined, mix, packed, pieces, spread, squeezed, texts_of, tidy, unsqueezed

LENGTH, K = 50, 26
#: Bytes of text in a batch, and handled at once in it.
BATCH, PIECE = 2 << 20, 1 << 18
HIGH, SPREAD = U(0xFFFFFFFF00000000), U(0x9E3779B97F4A7C15)


class Anchors:
    """Anchors of a batch: place, first window, number of windows, hash of the anchor and of the stretch."""

    def __init__(self, tab: pa.Table, seed: int, stretches: bool = True):
        self.data, starts, ends = texts_of(tab)
        self.ids, self.starts, self.ends = tab.column("id").to_numpy(), starts, ends
        found = []
        for i, j in pieces(starts, ends, PIECE):
            base = starts[i]
            found.append(_anchors(self.data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base, int(base), i, seed, stretches))
        self.place, self.first, self.windows, self.text, self.hash, self.stretch = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (int, int, int, int, U, U))


def _anchors(data, starts, ends, base, i, seed, stretches):
    width = LENGTH - K + 1
    none = tuple(np.zeros(0, t) for t in (int, int, int, int, U, U))
    if len(data) < LENGTH:
        return none
    prefix = PrefixHash(data, seed)
    grams = mix(prefix.every(K))
    best = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    long = np.flatnonzero(ends - starts >= LENGTH)
    window = spread(starts[long], ends[long] - starts[long] - LENGTH + 1)
    if not len(window):
        return none
    place = (best[window] & U(0xFFFFFFFF)).astype(np.int64)
    run = groups_of(place)
    place, first = place[run], window[run]
    windows = np.diff(np.append(run, len(window)))
    text = np.searchsorted(starts[long], first, "right") - 1
    stretch = _stretch_hash(prefix, first, windows, place - first) if stretches else np.zeros(len(run), np.uint64)
    return place + base, first + base, windows, long[text] + i, grams[place], stretch


def _stretch_hash(prefix, first, windows, offset):
    return mix(prefix.of(first, windows + (LENGTH - 1)) + windows.astype(np.uint64) * U(0xA24BAED4963EE407) + offset.astype(np.uint64) * U(0x9FB21C651E98DF25))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


def _seen(tab: pa.Table, bits: int, seed: int) -> pa.Table:
    """Round 1, batch: per bucket the distinct anchor hashes (32 bits after the bucket's), twice if in two documents."""
    a = Anchors(tab, seed, stretches=False)
    _, doc = np.unique(a.ids, return_inverse=True)
    short = a.hash >> U(32 - bits)
    order = np.lexsort((doc[a.text], short))
    short, doc = short[order], doc[a.text][order]
    new = np.ones(len(short), bool)
    new[1:] = (short[1:] != short[:-1]) | (doc[1:] != doc[:-1])
    short = short[new]
    third = np.zeros(len(short), bool)
    third[2:] = short[2:] == short[:-2]
    short = short[~third]
    bucket = (short >> U(32)).astype(np.int64)
    cut = groups_of(bucket)
    b = tab.column("batch")[0].as_py()
    return pa.table({
        "bucket": pa.array(bucket[cut], pa.int32()),
        "batch": pa.array(np.full(len(cut), b), pa.int32()),
        "body": pa.array([packed(x.astype(np.uint32)) for x in np.split(short, cut[1:])] if len(cut) else [], pa.binary()),
    })


def _shared(tab: pa.Table) -> pa.Table:
    """Round 1, bucket: answer each batch with those of its hashes that came twice."""
    parts = blobs(tab, "body", np.uint32)
    batch = tab.column("batch").to_pylist()
    every = joined(parts, np.uint32)
    every.sort()
    run = groups_of(every)
    twice = every[run][np.diff(np.append(run, len(every))) > 1]
    body = [packed(np.unique(x[find(twice, x) >= 0])) for x in parts]
    return pa.table({"batch": pa.array(batch, pa.int32()), "bucket": tab.column("bucket"), "body": pa.array(body, pa.binary())}).filter(pa.array([len(x) > 0 for x in body]))


def _stretches(docs: pa.Table, answers: pa.Table, bits: int, seed: int) -> pa.Table:
    """Round 2, batch: the distinct stretches around shared anchors, each with the smallest id that has it."""
    empty = pa.table({"bucket": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("offset", "windows", "ids", "body")}})
    if not docs.num_rows or not answers.num_rows:
        return empty
    a = Anchors(docs, seed)
    shared = np.sort(joined([x.astype(np.uint64) | (U(k) << U(32)) for k, x in zip(answers.column("bucket").to_pylist(), blobs(answers, "body", np.uint32), strict=True)], U))
    at = np.flatnonzero(find(shared, a.hash >> U(32 - bits)) >= 0)
    at = at[np.lexsort((a.ids[a.text[at]], a.stretch[at]))]
    run = groups_of(a.stretch[at])
    size = a.windows[at] + (LENGTH - 1)
    same = np.repeat(at[run], np.diff(np.append(run, len(at))))
    _must_equal(a.data, a.first[at], a.first[same], np.minimum(size, a.windows[same] + LENGTH - 1), size == a.windows[same] + LENGTH - 1)
    at = at[run]
    bucket = _bucket(a.hash[at], bits)
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order]
    cut = groups_of(bucket)
    out = {"offset": [], "windows": [], "ids": [], "body": []}
    for x in np.split(at, cut[1:]) if len(cut) else []:
        out["offset"].append(packed((a.place[x] - a.first[x]).astype(np.uint8)))
        out["windows"].append(packed(a.windows[x].astype(np.uint8)))
        out["ids"].append(squeezed(a.ids[a.text[x]]))
        out["body"].append(squeezed(a.data[spread(a.first[x], a.windows[x] + LENGTH - 1)]))
    b = docs.column("batch")[0].as_py()
    return pa.table({"bucket": pa.array(bucket[cut], pa.int32()), "batch": pa.array(np.full(len(cut), b), pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})


def _must_equal(data, one, other, length, alike) -> None:
    good = bool(alike.all())
    for i in range(0, len(one), 20000):
        x = slice(i, i + 20000)
        good = good and bool((data[spread(one[x], length[x])] == data[spread(other[x], length[x])]).all())
    if not good:
        raise RuntimeError("two different strings share a 64-bit hash: run again with another seed")


class SuffixOrder:
    """Order of suffixes of one byte array (first LENGTH bytes) within groups, by mergesort with hash comparisons."""

    def __init__(self, data: np.ndarray, prefix: PrefixHash):
        self.data, self.prefix = data, prefix

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension, LENGTH at most: binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH, np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix.of(a, mid) == self.prefix.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(a, b)
        last = np.minimum(e, LENGTH - 1)
        return np.where(e == LENGTH, or_equal, self.data[a + last] < self.data[b + last])

    def sort(self, suffix: np.ndarray, group_start: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: each suffix finds its rank in the run it is merged with."""
        size = np.diff(np.append(group_start, len(suffix)))
        start, stop = np.repeat(group_start, size), np.repeat(group_start + size, size)
        place = np.arange(len(suffix))
        width = 1
        while width < size.max(initial=1):
            live = np.flatnonzero(stop - start > width)
            s, e = start[live], stop[live]
            run = (live - s) // width
            odd = (run & 1).astype(bool)
            low = np.minimum(s + np.where(odd, run - 1, run + 1) * width, e)
            high = np.minimum(low + width, e)
            first = low.copy()
            while True:
                act = np.flatnonzero(low < high)
                if not len(act):
                    break
                mid = (low[act] + high[act]) >> 1
                less = self.before(suffix[mid], suffix[live[act]], odd[act])  # stable: the left run's equals stay first
                low[act] = np.where(less, mid + 1, low[act])
                high[act] = np.where(less, high[act], mid)
            place = np.arange(len(suffix))
            place[live] = s + (run - odd) * width + (live - s - run * width) + (low - first)
            merged = suffix.copy()
            merged[place] = suffix
            suffix, width = merged, 2 * width
        return suffix


def _smallest(tab: pa.Table, seed: int) -> pa.Table:
    """Round 2, bucket: for each window of each stretch the smallest id that holds it, as runs, to each batch."""
    offset, windows = (joined(blobs(tab, c, np.uint8), np.uint8).astype(np.int64) for c in ("offset", "windows"))
    ids, data = joined(unsqueezed(tab, "ids", np.int64), np.int64), joined(unsqueezed(tab, "body", np.uint8), np.uint8)
    count = np.array([len(x) for x in blobs(tab, "offset", np.uint8)])
    start = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
    # stretches of one anchor stay together; the others are sorted a few at a time, so that memory is bounded
    anchor = np.zeros(len(start), np.uint64)
    for k in range(K):
        anchor = (anchor + data[start + offset + k]) * SPREAD
    parts = max(1, len(data) // PIECE)
    part = ((anchor >> U(40)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    stretch, runs, lengths, owners, distinct = [], [], [], [], np.zeros(len(part), np.int64)
    seen = 0
    for mine in np.split(order, groups_of(part[order])[1:]) if len(order) else []:
        own = data[spread(start[mine], windows[mine] + LENGTH - 1)]
        which, *found = _runs(own, offset[mine], windows[mine], ids[mine], seed)
        distinct[mine] = which + seen
        seen += len(found[0])
        for to, x in zip((stretch, runs, lengths, owners), found, strict=True):
            to.append(x)
    stretch, runs, lengths, owners = joined(stretch, U), joined(runs, np.int64), joined(lengths, np.uint8), joined(owners, np.int64)
    first = np.cumsum(runs) - runs
    out = {"stretch": [], "runs": [], "lengths": [], "ids": []}
    for k in np.split(distinct, np.cumsum(count)[:-1]):
        r = spread(first[k], runs[k])
        out["stretch"].append(packed(stretch[k]))
        out["runs"].append(packed(runs[k].astype(np.uint8)))
        out["lengths"].append(packed(lengths[r]))
        out["ids"].append(packed(owners[r]))
    return pa.table({"batch": tab.column("batch"), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})


def _runs(data: np.ndarray, offset: np.ndarray, windows: np.ndarray, ids: np.ndarray, seed: int):
    """Which distinct stretch each stretch is; of the distinct ones the hash, number of runs of windows with one smallest id, and the runs' lengths and ids."""
    start = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
    prefix = PrefixHash(data, seed)
    stretch = _stretch_hash(prefix, start, windows, offset)
    order = np.lexsort((ids, stretch))
    run = groups_of(stretch[order])
    sizes = np.diff(np.append(run, len(order)))
    rep = order[run]  # the distinct stretches
    same = np.repeat(rep, sizes)
    _must_equal(data, start[order], start[same], np.minimum(windows[order], windows[same]) + LENGTH - 1, windows[order] == windows[same])
    distinct = np.empty(len(order), np.int64)
    distinct[order] = np.repeat(np.arange(len(rep)), sizes)
    # windows of the distinct stretches, each with the stretch's smallest id; then the smallest of equal windows
    n = windows[rep]
    first = np.cumsum(n) - n
    suffix, least = spread(start[rep], n), np.repeat(ids[rep], n)
    anchor = mix(prefix.of(start[rep] + offset[rep], K))
    away = np.repeat(offset[rep], n) - (np.arange(len(suffix)) - np.repeat(first, n))
    key = mix(np.repeat(anchor, n) + away.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    by = np.argsort(key, kind="stable")
    cut = groups_of(key[by])
    many = np.diff(np.append(cut, len(by))) > 1
    inside = np.repeat(many, np.diff(np.append(cut, len(by))))
    by = by[inside]
    if len(by):
        at = np.full(len(data), -1, np.int32)
        at[suffix] = np.arange(len(suffix), dtype=np.int32)
        sorter = SuffixOrder(data, prefix)
        ordered = sorter.sort(suffix[by], groups_of(key[by]))
        equal = np.zeros(len(ordered), bool)
        equal[1:] = (key[at[ordered[1:]]] == key[at[ordered[:-1]]]) & (sorter.extension(ordered[1:], ordered[:-1]) == LENGTH)
        again = np.flatnonzero(equal)
        _must_equal(data, ordered[again], ordered[again - 1], np.full(len(again), LENGTH), np.ones(1, bool))
        heads = np.flatnonzero(~equal)
        lowest = np.minimum.reduceat(least[at[ordered]], heads)
        least[at[ordered]] = np.repeat(lowest, np.diff(np.append(heads, len(ordered))))
    # runs of equal ids within each distinct stretch
    head = np.ones(len(least), bool)
    head[1:] = least[1:] != least[:-1]
    head[first] = True
    heads = np.flatnonzero(head)
    run_len, run_id = np.diff(np.append(heads, len(least))), least[heads]
    runs = np.add.reduceat(head.astype(np.int64), first)
    return distinct, stretch[rep], runs, run_len.astype(np.uint8), run_id


def _cut(docs: pa.Table, answers: pa.Table, seed: int) -> pa.Table:
    """Round 3, batch: mark the windows that a smaller id holds and keep the other bytes."""
    a = Anchors(docs, seed)
    covered = np.zeros(len(a.data) + 1, np.int32)
    if answers.num_rows and len(a.stretch):
        stretch, runs = joined(blobs(answers, "stretch", U), U), joined(blobs(answers, "runs", np.uint8), np.uint8).astype(np.int64)
        lengths, least = joined(blobs(answers, "lengths", np.uint8), np.uint8).astype(np.int64), joined(blobs(answers, "ids", np.int64), np.int64)
        begin = np.cumsum(runs) - runs
        order = np.argsort(stretch, kind="stable")
        hit = find(stretch[order], a.stretch)
        at = np.flatnonzero(hit >= 0)
        which = order[hit[at]]
        r = spread(begin[which], runs[which])
        owner = np.repeat(at, runs[which])
        before = np.cumsum(lengths) - lengths
        window = a.first[owner] + before[r] - before[np.repeat(begin[which], runs[which])]
        drop = least[r] < a.ids[a.text[owner]]
        np.add.at(covered, window[drop], 1)
        np.add.at(covered, window[drop] + lengths[r][drop] - 1 + LENGTH, -1)
    gone = np.cumsum(covered)[:-1] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    full = np.flatnonzero(a.ends > a.starts)
    begins[a.starts[full]] = gone[a.starts[full]]
    removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
    removed, spans = removed[a.ends] - removed[a.starts], spans[a.ends] - spans[a.starts]
    kept = a.data[~gone]
    size = a.ends - a.starts - removed
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed(kept))]).cast(pa.binary())
    return pa.table({
        "id": docs.column("id"), "n_bytes": pa.array(a.ends - a.starts), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
        "body": body, **({"kept": (k := docs.column("kept")).cast(pa.struct([f.with_nullable(True) for f in k.type]))} if "kept" in docs.column_names else {}),
    })


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), seed: int = 1, batch_bytes: int = BATCH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, body, kept): body holds the bytes that stay, kept a struct of the columns keep."""
    n, total = batch_count(docs, batch_bytes, text)
    bits = min(30, max(3, (max(1, total) >> 20).bit_length()))  # buckets for about 1 MB of text each
    batched = in_batches(docs, n, key, text, keep)
    seen = batched.groupBy("batch").applyInArrow(lambda t: tidy(_seen(t, bits, seed)), "bucket int, batch int, body binary")
    shared = seen.groupBy("bucket").applyInArrow(_shared, "batch int, bucket int, body binary")
    out = batched.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(lambda d, s: tidy(_stretches(d, s, bits, seed)), "bucket int, batch int, offset binary, windows binary, ids binary, body binary")
    least = out.groupBy("bucket").applyInArrow(lambda t: tidy(_smallest(t, seed)), "batch int, stretch binary, runs binary, lengths binary, ids binary")
    schema = "id long, n_bytes long, n_removed long, n_spans long, body binary"
    if keep:
        schema += f", kept {batched.schema['kept'].dataType.simpleString()}"
    cut = batched.groupBy("batch").cogroup(least.groupBy("batch")).applyInArrow(lambda d, s: tidy(_cut(d, s, seed)), schema)
    return cut.withColumn("id", F.nullif(F.col("id"), F.lit(int(NO_ID))))


def cut_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of the text (and its length counted anew): what is left of a character that lost a byte goes too, null stays null."""
    rest, none = tuple(c for c in docs.columns if c not in (key, text, length)), free_name("no_text", docs.columns)
    types = dict(docs.dtypes)
    cut = suffix_dedup(docs.withColumn(none, F.col(text).isNull()), key, text, keep=(*rest, none))

    def whole(batches):
        for b in batches:
            body = b.column(b.schema.get_field_index("body")).to_pylist()
            yield b.set_column(b.schema.get_field_index("body"), "body", pa.array([x.decode("utf-8", "ignore") for x in body], pa.string()))

    names = [c for c in cut.columns if c in ("id", "kept", "body")]
    schema = StructType([StructField(c, StringType()) if c == "body" else cut.schema[c] for c in names])
    out = cut.select(*names).mapInArrow(whole, schema)
    body = F.when(~F.col("kept").getField(none), F.col("body"))
    at = {key: F.col("id").cast(types[key]), text: body, length: F.char_length(body).cast(types.get(length, "long"))}
    return out.select(*[at[c].alias(c) if c in at else F.col("kept").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("body", 256).alias("kept_sha256"))
