"""Components of documents whose word-shingle sets have a Jaccard similarity of PERCENT / 100 or more.

Universe-partition pigeonhole: two sets within the similarity differ in at most H elements, H fixed by the size band of
the larger one. Hashing splits the universe of shingles into segments. A segment used plainly (worth 1) must agree as a
whole; one used with its one-deletion neighbourhood (worth 2) may differ in one element. If the segments' worth adds up
to more than H, similar sets share a signature of some segment. Per band the allocation of least expected cost, from
the band's number of sets, is taken: more segments with neighbourhoods cost more signatures and bring fewer candidates.

Equal sets are one node, so copies are never paired. A set's sketch (its histogram over BINS hash values and the parities
of some more) bounds from below how far two sets differ; pairs that the bound rules out are never verified. In a
signature's group all members meet the smallest one; each set is verified against the remaining partner it shares most
signatures with, and linked sets form components. Then rounds: of the pairs of a group that lie in two components and
pass the bound, each component gives the few most promising to verification (large groups in blocks), and components
that a link joins become one. Groups of which all such pairs have been tried are done; the others go on, with more
pairs a component. No link between different components is lost, and pairs within one are never made.

Defined results: documents with null text or without words have no shingles, link with nothing and are their own
component; a document of fewer words than a shingle has its whole sequence as one; rows sharing an id are one node if
their texts' sets are equal; null ids stay null in component_id where a component holds nothing else.
Sets are compared by 64-bit hashes of shingles; two sets with one 64-bit set hash but different sets stop the job.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, blobs, forgetful, groups_of, joined, mix, packed, pieces, planes, released, rising, saved, spread, texts_of, tidy, unplaned, unrisen, unsqueezed

SHINGLE, PERCENT, PIECE = 4, 85, 1 << 19
#: Weights of a signature and of a candidate pair in the cost of an allocation.
SIGNATURE_COST, PAIR_COST = 1.0, 50.0
#: Bins of a set's sketch; members of a group that one task compares with one another.
BINS, MEMBERS = 64, 1024
#: Pairs that each component of a group gives to verification in the first round, and how many times as many in each further one.
FIRST_PAIRS, MORE_PAIRS = 4, 16


class Sets:
    """Distinct shingle hashes of texts: sorted by (text, hash); size and hash of each text's set."""

    def __init__(self, data, starts, ends, k: int = SHINGLE):
        w = Words(data, starts, ends)
        n = np.maximum(w.count - k + 1, np.minimum(w.count, 1))
        first = spread(w.first, n)
        text = np.repeat(np.arange(len(starts)), n)
        h = np.zeros(len(first), np.uint64)
        padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
        last = (w.first + w.count)[text]
        for j in range(k):
            h = h * U(0x9E3779B97F4A7C15) + np.where(first + j < last, mix(padded[first + j] + U(j + 1)), U(0))
        h = mix(h)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.hash, self.text = h[new], text[new]
        self.size = np.bincount(self.text, minlength=len(starts))
        self.first = np.cumsum(self.size) - self.size
        self.id, self.check = self._sum(self.hash * U(0xD6E8FEB86659FD93) ^ (self.hash >> U(31))), self._sum(mix(self.hash ^ U(0x5851F42D4C957F2D)))

    def sketches(self, percent: int) -> list[bytes]:
        """Per text: how many shingles have each of BINS hash values, 255 at most; then the parities of other hash values,
        eight times as many as similar sets may differ in, so that few differences cancel out."""
        bits = np.array([1 << max(9, (16 * int(n) * (100 - percent) // (100 + percent)).bit_length()) for n in self.size], np.int64)
        out = [b""] * len(bits)
        for size in np.unique(bits).tolist():
            texts = np.flatnonzero(bits == size)
            row = np.full(len(bits), -1)
            row[texts] = np.arange(len(texts))
            mine = row[self.text] >= 0
            at, h = row[self.text[mine]], self.hash[mine]
            counts = np.bincount(at * BINS + (h & U(BINS - 1)).astype(np.int64), minlength=len(texts) * BINS).reshape(-1, BINS)
            odd = np.zeros(len(texts) * size, np.uint8)
            np.bitwise_xor.at(odd, at * size + (h >> U(20) & U(size - 1)).astype(np.int64), np.uint8(1))
            whole = np.concatenate([np.minimum(counts, 255).astype(np.uint8), np.packbits(odd.reshape(-1, size), axis=1)], axis=1)
            for t, x in zip(texts.tolist(), whole, strict=True):
                out[t] = x.tobytes()
        return out

    def _sum(self, x):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return mix(s[self.first + self.size] - s[self.first] + self.size.astype(np.uint64)).view(np.int64)


def band_limits(percent: int, longest: int) -> list[int]:
    """Smallest size of each band: a partner is in the same band or the one below."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return out


def allocation(sizes: dict[int, int], percent: int) -> dict[int, tuple[int, int]]:
    """Per band (segments, how many of them with neighbourhoods) of least expected cost. sizes: sets per band."""
    limits = band_limits(percent, 1)
    out = {}
    for band in range(max(sizes, default=-1) + 2):
        while len(limits) < band + 2:
            limits.append(max(limits[-1] + 1, -(-100 * limits[-1] // percent)))
        top = limits[band + 1] - 1
        differ = 2 * top * (100 - percent) // (100 + percent)
        sets = sizes.get(band, 0) + sizes.get(band - 1, 0)
        if not differ:
            out[band] = (0, 0)  # only equal sets are similar
            continue
        best = None
        for wide in range((differ + 1) // 2 + 1):
            segments = max(differ + 1 - wide, wide)
            mean = top / segments
            plain, near = math.exp(-2 * mean), (math.exp(-mean) * (1 + mean)) ** 2  # both without, or with one element
            cost = SIGNATURE_COST * sets * (segments + wide * mean) + PAIR_COST * sets * sets / 2 * ((segments - wide) * plain + wide * near)
            if best is None or cost < best[0]:
                best = (cost, segments, wide)
        out[band] = best[1:]
    return out


def signatures(s: Sets, limits: np.ndarray, segments: np.ndarray, wide: np.ndarray):
    """(signature, text, own): of each set for its own band and as the smaller partner for the band above."""
    sig, text, own = [], [], []
    live = np.flatnonzero(s.size > 0)
    for up in (0, 1):
        band = np.searchsorted(limits, s.size[live], "right") - 1 + up
        use = segments[band] > 0
        t, b = live[use], band[use]
        m = segments[b]
        base = np.cumsum(m) - m
        el = spread(s.first[t], s.size[t])
        row = np.repeat(np.arange(len(t)), s.size[t])
        h = s.hash[el]
        seg = ((h >> U(32)) * m[row].astype(np.uint64) >> U(32)).astype(np.int64)
        value = mix(h + U(0x632BE59BD9B4E019))
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, base[row] + seg, value)
        segment = np.arange(len(total)) - np.repeat(base, m)
        salt = mix((np.repeat(b, m).astype(np.uint64) << U(32)) + segment.astype(np.uint64))
        sig.append(mix(total + salt))
        text.append(np.repeat(t, m))
        own.append(np.full(len(total), 1 - up, np.uint8))
        near = np.flatnonzero(seg < wide[b][row])  # the first segments have neighbourhoods
        at = base[row[near]] + seg[near]
        sig.append(mix(total[at] - value[near] + salt[at]))
        text.append(t[row[near]])
        own.append(np.full(len(near), 1 - up, np.uint8))
    return np.concatenate(sig), np.concatenate(text), np.concatenate(own)


def _facts(batches, percent: int, k: int):
    for b in batches:
        tab = pa.Table.from_batches([b])
        data, starts, ends = texts_of(tab)
        for i, j in pieces(starts, ends, PIECE):
            s = Sets(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], k)
            yield from pa.table({"doc_id": tab.column("doc_id").slice(i, j - i), "n": pa.array(s.size, pa.int64()), "sid": pa.array(s.id), "chk": pa.array(s.check), "bins": pa.array([*s.sketches(percent)], pa.binary())}).to_batches()


def _own_texts(batches, k: int):
    """A text for each set, by the set's own hash: ids may be null or repeated."""
    seen = set()  # equal sets of the task send one text
    for b in batches:
        tab = pa.Table.from_batches([b])
        data, starts, ends = texts_of(tab)
        for i, j in pieces(starts, ends, PIECE):
            s = Sets(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], k)
            keep = []
            for t in np.flatnonzero(s.size > 0).tolist():
                if (x := int(s.id[t])) not in seen:
                    seen.add(x)
                    keep.append(t)
            yield from pa.table({"sid": pa.array(s.id[keep]), "text": tab.column("text").slice(i, j - i).take(pa.array(keep, pa.int64()))}).to_batches()


def _signed(batches, limits, segments, wide, bits, k: int):
    """Per bucket of signatures one row: signatures (32 bits after the bucket's), place of the set, sets, own band."""
    for b in batches:
        data, starts, ends = texts_of(pa.Table.from_batches([b]))
        for i, j in pieces(starts, ends, 2 * PIECE):
            s = Sets(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], k)
            _, rep = np.unique(s.id, return_index=True)  # equal sets of the piece sign once
            keep = np.zeros(len(s.size), bool)
            keep[rep] = True
            s.size = np.where(keep, s.size, 0)
            sig, text, own = signatures(s, limits, segments, wide)
            order = np.argsort(sig)
            sig, text, own = sig[order] >> U(32 - bits), text[order], own[order]
            bucket = (sig >> U(32)).astype(np.int64)
            cut = groups_of(bucket)
            rows = []
            for x in np.split(np.arange(len(sig)), cut[1:]) if len(cut) else []:
                who, place = np.unique(text[x], return_inverse=True)
                rows.append((int(bucket[x[0]]), rising(sig[x].astype(np.uint32)), planes(place.astype(np.uint16)), packed(s.id[who]), packed(np.packbits(own[x])), len(x)))
            yield from pa.table({c: pa.array([r[at] for r in rows], t) for at, (c, t) in enumerate((("bucket", pa.int32()), ("sigs", pa.binary()), ("place", pa.binary()), ("sids", pa.binary()), ("own", pa.binary()), ("n", pa.int32())))}).to_batches()


def _groups(tab: pa.Table) -> pa.Table:
    """Bucket: members of each signature's group but its pivot, with the pivot; groups of equal members once, counted."""
    sig = joined([unrisen(x, np.uint32) for x in unsqueezed(tab, "sigs", np.uint8)], np.uint32)
    place, who = [unplaned(x, np.uint16) for x in unsqueezed(tab, "place", np.uint8)], blobs(tab, "sids", np.int64)
    sid = joined([w[p] for w, p in zip(who, place, strict=True)], np.int64)
    own = joined([np.unpackbits(np.frombuffer(o, np.uint8))[:n] for o, n in zip(tab.column("own").to_pylist(), tab.column("n").to_pylist(), strict=True)], np.uint8)
    order = np.lexsort((sid, 1 - own, sig))  # sets in their own band first: the first is the pivot
    sig, sid, own = sig[order], sid[order], own[order]
    start = groups_of(sig)
    size = np.diff(np.append(start, len(sig)))
    good = (size > 1) & (own[start] == 1) if len(start) else np.zeros(0, bool)
    rows = spread(start[good], size[good])
    group = np.repeat(np.arange(int(good.sum())), size[good])
    sid = sid[rows]
    order = np.lexsort((sid, group))  # a set can come twice (neighbourhoods): once is enough
    new = np.ones(len(sid), bool)
    new[1:] = (sid[order][1:] != sid[order][:-1]) | (group[order][1:] != group[order][:-1])
    keep = np.zeros(len(sid), bool)
    keep[order[new]] = True
    pivot = sid[np.searchsorted(group, group)] if len(sid) else sid
    sid, group, pivot = sid[keep], group[keep], pivot[keep]
    members = np.zeros(int(good.sum()), np.uint64)
    np.add.at(members, group, mix(sid.view(np.uint64)))
    heads = mix(members + (pivot[groups_of(group)].view(np.uint64) if len(group) else members))
    _, first, count = np.unique(heads, return_index=True, return_counts=True)
    times = np.zeros(len(heads), np.int64)
    times[first] = count
    size = np.bincount(group, minlength=len(heads))
    out = (sid != pivot) & (times[group] > 0)
    g = group[out]
    return pa.table({"grp": pa.array(heads[g].view(np.int64)), "size": pa.array(size[g], pa.int32()), "times": pa.array(times[g]), "pivot": pa.array(pivot[out]), "sid": pa.array(sid[out])})


def _bound(na, ha, nb, hb) -> tuple[np.ndarray, np.ndarray]:
    """Largest intersection, and union then, that sketches of one length allow: counts and parities differ by no more than the sets do."""
    differ = np.maximum(np.abs(ha[:, :BINS].astype(np.int16) - hb[:, :BINS]).sum(1), np.bitwise_count(ha[:, BINS:] ^ hb[:, BINS:]).sum(1, dtype=np.int64))
    most = (na + nb - differ) // 2
    return most, na + nb - most


def _possible(na, ha, nb, hb, percent: int) -> np.ndarray:
    most, union = _bound(na, ha, nb, hb)
    return 100 * most >= percent * union


def _matrix(sketches: list[bytes], length: int) -> np.ndarray:
    """Sketches as rows of the given length: the halves of longer parities are added up."""
    sizes = np.array([len(x) for x in sketches], np.int64)
    out = np.zeros((len(sketches), length), np.uint8)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(sketches[k] for k in at.tolist()), np.uint8).reshape(-1, size)
        odd = x[:, BINS:]
        while odd.shape[1] > length - BINS:
            odd = odd[:, : odd.shape[1] // 2] ^ odd[:, odd.shape[1] // 2 :]
        out[at, :BINS], out[at, BINS:] = x[:, :BINS], odd
    return out


def _possible_pairs(batches, percent: int):
    for b in batches:
        tab = pa.Table.from_batches([b])
        na, nb, ha, hb = tab.column("na").to_numpy(), tab.column("nb").to_numpy(), tab.column("ha").to_pylist(), tab.column("hb").to_pylist()
        size, good = np.array([min(len(x), len(y)) for x, y in zip(ha, hb, strict=True)], np.int64), np.zeros(b.num_rows, bool)
        for length in np.unique(size).tolist():
            every = np.flatnonzero(size == length)
            for at in np.split(every, np.arange(2048, len(every), 2048)):
                one, two = (_matrix([h[k] for k in at.tolist()], length) for h in (ha, hb))
                good[at] = _possible(na[at], one, nb[at], two, percent)
        yield from tab.select(["a", "b", "shared"]).filter(pa.array(good)).to_batches()


def _cross_pairs(tab: pa.Table, percent: int, most: int) -> pa.Table:
    """(grp, a, b): of each group (or two blocks of it) the pairs that lie in two components and pass the bound, for each
    component its `most` best; a row without a pair for groups that have more."""
    part = tab.column("part").to_numpy()
    order = np.argsort(part, kind="stable")
    part = part[order]
    grp, sid, label, side, n = (tab.column(c).to_numpy()[order] for c in ("grp", "sid", "label", "side", "n"))
    bins = tab.column("bins").to_pylist()
    pairs, more = [np.zeros((3, 0), np.int64)], []
    head = groups_of(part)
    for a, z in zip(head.tolist(), np.append(head[1:], len(part)).tolist(), strict=True):
        some = [bins[k] for k in order[a:z].tolist()]
        sketch = _matrix(some, min(map(len, some)))
        one, two, good = [], [], []
        for i in range(a, z):  # one member against those after it
            j = np.arange(i + 1, z)
            j = j[(label[j] != label[i]) & ((side[j] != side[i]) | (side[i] < 0))]
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            if len(j):
                shared, union = _bound(n[i], sketch[i - a][None], n[j], sketch[j - a])
                fits = 100 * shared >= percent * union
                one.append(np.full(int(fits.sum()), i))
                two.append(j[fits])
                good.append(shared[fits] / union[fits])
        if not one or not sum(map(len, one)):
            continue
        one, two, good = np.concatenate(one), np.concatenate(two), np.concatenate(good)
        kept = np.zeros(len(one), bool)
        for mine in (label[one], label[two]):  # the rank of each pair among those of its component
            by = np.lexsort((-good, mine))
            start = groups_of(mine[by])
            kept[by] |= np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by)))) < most
        if not kept.all():
            more.append(int(grp[a]))
        one, two = sid[one[kept]], sid[two[kept]]
        pairs.append(np.stack([np.full(len(one), grp[a]), np.minimum(one, two), np.maximum(one, two)]))
    x = np.unique(np.concatenate(pairs, 1)[1:], axis=1)
    none = [None] * len(more)
    return pa.table({"grp": pa.array([None] * x.shape[1] + more, pa.int64()), "a": pa.array([*x[0].tolist(), *none], pa.int64()), "b": pa.array([*x[1].tolist(), *none], pa.int64())})


def _comparison(percent: int, most: int):
    return lambda t: tidy(_cross_pairs(t, percent, most))


def _verified(batches, k: int):
    """Sizes of intersection and union of the two texts' sets."""
    for b in batches:
        tab = pa.Table.from_batches([b])
        one, two = texts_of(tab, "text_a"), texts_of(tab, "text_b")
        inter, union = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for i, j in pieces(one[1] + two[1], one[2] + two[2], PIECE):
            x, y = (Sets(d[s[i] : e[j - 1]], s[i:j] - s[i], e[i:j] - s[i], k) for d, s, e in (one, two))
            text, h = np.concatenate([x.text, y.text]), np.concatenate([x.hash, y.hash])
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            both = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
            inter[i:j] = np.bincount(text[1:][both], minlength=j - i)
            union[i:j] = x.size + y.size - inter[i:j]
        yield from tab.select(["a", "b"]).append_column("inter", pa.array(inter)).append_column("uni", pa.array(union)).to_batches()


def _verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, inter, uni) of pairs (a, b) of set ids."""
    t = texts.select("sid", "text")
    both = pairs.join(t.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b").join(t.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(released(lambda it: _verified(it, k)), "a long, b long, inter long, uni long")


def components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): label is the smallest node of the component.

    Each round hooks every label to its smallest neighbour, follows the pointers, and contracts the edges. Pointers are
    followed in a written table, so a plan has a join for each jump and not twice as many as for the jump before.
    """
    edges = edges.where("a <> b").distinct()
    labels = None
    while True:
        edges = forgetful(saved(edges))
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = forgetful(saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))))
        while True:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("top"))
            if parent.join(up, "label").where("top <> label").isEmpty():
                break
            for _ in range(jumps):
                parent = parent.join(up, "label").select("node", F.col("top").alias("label"))
            parent = saved(parent)
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = saved(labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        la, lb = parent.select(F.col("node").alias("a"), F.col("label").alias("la")), parent.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = edges.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id)"""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    facts = saved(docs.mapInArrow(released(lambda it: _facts(it, percent, shingle)), "doc_id long, n long, sid long, chk long, bins binary"))
    classes = forgetful(saved(facts.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("chk").alias("chk"), F.max("chk").alias("chk2"), F.min("bins").alias("bins"))))
    sums = classes.agg(F.count_if(F.expr("n <> n2 OR chk <> chk2")).alias("clash"), F.max("n").alias("longest"), F.sum("n").alias("elements")).first()
    if sums["clash"]:
        raise RuntimeError("two different sets share a 64-bit hash: run again with another hash")
    label = _labels(docs, classes, sums["longest"] or 0, sums["elements"] or 0, percent, shingle)
    # components over set ids; a component's id is its smallest document
    labelled = classes.select("sid", "first").join(label, "sid", "left").select("sid", "first", F.coalesce("label", "sid").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(lowest, "label").select("sid", "component_id")
    found = facts.where("n > 0").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(facts.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (sid, label) after the links (a, b)."""
    at = lambda c: label.select(F.col("sid").alias(c), F.col("label").alias(f"l{c}"))
    tops = components(links.join(at("a"), "a").join(at("b"), "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")))
    return forgetful(saved(label.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("sid", F.coalesce("top", "label").alias("label"))))


def _labels(docs: DataFrame, classes: DataFrame, longest: int, elements: int, percent: int, shingle: int) -> DataFrame:
    """(sid, label) of sets that share a signature with another: equal labels are one component."""
    limits = np.array(band_limits(percent, max(1, longest)))
    band = F.lit(-1)
    for x in limits.tolist():  # some tens of bands: they grow with the logarithm of the longest set
        band = band + (F.col("n") >= x).cast("int")
    sizes = {r["band"]: r["count"] for r in classes.groupBy(band.alias("band")).count().collect()}
    plan = allocation(sizes, percent)
    segments, wide = (np.array([plan.get(k, (0, 0))[i] for k in range(len(limits) + 1)]) for i in (0, 1))
    bits = min(30, max(3, (max(1, elements) >> 19).bit_length()))
    signed = docs.select("text").mapInArrow(released(lambda it: _signed(it, limits, segments, wide, bits, shingle)), "bucket int, sigs binary, place binary, sids binary, own binary, n int")
    groups = forgetful(saved(signed.groupBy("bucket").applyInArrow(lambda t: tidy(_groups(t)), "grp long, size int, times long, pivot long, sid long")))
    nodes = groups.select("sid").union(groups.select(F.col("pivot").alias("sid"))).distinct()
    wanted = saved(classes.select("sid", "n", "bins").join(nodes, "sid", "left_semi"))
    own = docs.select("text").mapInArrow(released(lambda it: _own_texts(it, shingle)), "sid long, text string")
    texts = forgetful(saved(own.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])))
    # first each set with the partner it shares most signatures with
    known = lambda c: wanted.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bins").alias(f"h{c}"))
    pairs = groups.groupBy(F.col("pivot").alias("a"), F.col("sid").alias("b")).agg(F.sum("times").alias("shared"))
    pairs = forgetful(saved(pairs.join(known("a"), "a").join(known("b"), "b").select("a", "b", "shared", "na", "ha", "nb", "hb").mapInArrow(lambda it: _possible_pairs(it, percent), "a long, b long, shared long")))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    checked = forgetful(saved(_verify(best.select("a", "b"), texts, shingle)))
    similar = F.col("inter") * 100 >= F.col("uni") * percent
    label = _merged(wanted.select("sid", F.col("sid").alias("label")), checked.where(similar).select("a", "b"))
    tried = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # then what still lies in two components
    tasks, most, member = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), FIRST_PAIRS, groups.select("grp", "sid", "size").unionByName(groups.select("grp", F.col("pivot").alias("sid"), "size").distinct())
    while True:
        member = member.join(label, "sid")
        split = member.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("grp")
        member = forgetful(saved(member.join(split, "grp", "left_semi")))
        found = saved(_dealt(member.join(wanted.select("sid", "n", "bins"), "sid"), tasks).groupBy("task").applyInArrow(_comparison(percent, most), "grp long, a long, b long").distinct())
        checked = forgetful(saved(_verify(saved(found.where("a IS NOT NULL").select("a", "b").join(tried, ["a", "b"], "left_anti")), texts, shingle)))
        links = checked.where(similar).select("a", "b")
        if not links.isEmpty():
            label = _merged(label, links)
        tried = tried.unionByName(checked.select("a", "b"))
        left = found.where("grp IS NOT NULL").select("grp").distinct()
        if left.isEmpty():
            return label
        member, most = member.join(left, "grp", "left_semi").drop("label"), MORE_PAIRS * most


def _dealt(member: DataFrame, tasks: int) -> DataFrame:
    """Members of groups with the task that compares them: a group of up to MEMBERS is one part, of a larger one each pair of blocks."""
    blocks = F.ceil(F.col("size") / MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    member = member.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    return member.select("grp", part.alias("part"), side.cast("long").alias("side"), "sid", "label", "n", "bins", F.when(F.col("blocks") == 1, F.pmod(part, F.lit(tasks))).otherwise(part).alias("task"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), f AS (SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM s
), e AS (SELECT DISTINCT rep, n, unnest(s) AS x FROM f WHERE doc_id = rep
), k AS (
  SELECT *, row_number() OVER (PARTITION BY rep ORDER BY c, x) AS place FROM (SELECT rep, n, x, count(*) OVER (PARTITION BY x) AS c FROM e)
), p AS (SELECT rep, n, x FROM k WHERE place <= n - (85 * n + 99) // 100 + 1
), c AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), v AS (
  SELECT c.a, c.b, count(*) AS i, any_value(x.n) AS na, any_value(y.n) AS nb FROM c JOIN e x ON x.rep = c.a JOIN e y ON y.rep = c.b AND y.x = x.x GROUP BY 1, 2
), l AS (SELECT a, b FROM v WHERE 100 * i >= 85 * (na + nb - i)
), g AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
, reach AS (
  WITH RECURSIVE r(node, top) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.b, r.top FROM r JOIN g ON g.a = r.node)
  SELECT node, min(top) AS top FROM r GROUP BY node
)
SELECT f.doc_id, f.n::BIGINT AS n_shingles, CASE WHEN f.n = 0 THEN f.doc_id ELSE coalesce(reach.top, f.rep) END AS component_id
FROM f LEFT JOIN reach ON reach.node = f.rep
"""
