"""How the sources of a language differ in the terms they use, by sorting and streaming over runs.

Tasks count the terms of their documents for each (lang, source), a few MB at a time, so that a term costs one row for
each lot of documents and not one for each occurrence. These rows are dealt by (lang, term) and sorted within partitions
by (lang, term, source, document); a scan over the sorted stream sums each run, gives the term's number of documents and
its counts by source, and drops terms of too few documents. Shares need the sums over all kept terms, so a second scan
over the kept runs, each with its source's sum joined on, emits the run's part of every pair of sources and of every
source's terms; Spark adds up the parts.

Sources that a run lacks have the count 0. A run of K sources emits parts for its K present ones only: with p(c) the
share of a count c, the sum of f(p_i, p_j) over all terms is that of f(p_i, 0_j) + f(0_i, p_j) - f(0_i, 0_j), which needs
only how often each count occurs in a source, plus a correction over the terms that both sources have. A scan holds one
Arrow batch, open runs and sums by pair that are handed on at BUFFER of them; nothing is collected or broadcast by hand.

Defined results: null text, lang and source count as empty; every row is a document of its own, so repeated rows count
twice and ids are not looked at; groups without terms take part with counts of 0; a language without kept terms has pairs
of value 0 and no terms; a language with one source has no pairs; ties go to the smaller item in UTF-8 order; texts count
whole; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import groups_of, pieces, released, saved, spread, table, texts_of

#: A term is kept with so many documents; a source's terms are listed to this rank; shares are in billionths.
LEAST, TOP, UNIT = 3, 200, 10**9
#: Bytes of text counted at once, and entries after which a scan hands its sums on.
LOT, BUFFER = 12 << 20, 1 << 20
PARTIAL = "lang string, term string, source string, document long, df long, n long"
KEPT = "lang string, term string, source string, n long, total long"


def term_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to terms: letters and all of 128 and more."""
    low = data | 32
    return (data >= 128) | ((low >= 97) & (low <= 122))


def _codes(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    col = pc.fill_null(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, "").dictionary_encode()
    return np.asarray(col.indices, np.int64), col.dictionary


def words_in(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the runs of bytes inside begin, which never cross texts, and the runs with A-Z lower-cased."""
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    full = starts[ends > starts]
    begin[full] = inside[full]
    place = np.flatnonzero(begin)
    del begin
    letters = data[inside]
    letters[(letters >= 65) & (letters <= 90)] += 32
    gaps = np.flatnonzero(~inside)  # a run's letters come after all letters before it
    offsets = np.append(place - np.searchsorted(gaps, place), len(letters))
    return place, pa.Array.from_buffers(pa.large_string(), len(place), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])


def count_lot(tab: pa.Table, first: int) -> pa.RecordBatch:
    """A lot's rows (lang, term, source, document, df, n): in how many of its documents a term occurs and how often, for each source; document is the lot's first."""
    data, starts, ends = texts_of(tab)
    place, terms = words_in(data, starts, ends, term_bytes(data))
    terms = terms.dictionary_encode()
    term, names = np.asarray(terms.indices, np.int64), terms.dictionary
    doc = np.searchsorted(starts, place, "right") - 1
    lang, langs = _codes(tab.column("lang"))
    source, sources = _codes(tab.column("source"))
    each = np.sort(doc * len(names) + term)  # by document, then term
    at = groups_of(each)
    times = np.diff(np.append(at, len(each)))
    doc, term = np.divmod(each[at], max(len(names), 1))
    group = (lang * max(len(sources), 1) + source)[doc] * len(names) + term
    order = np.argsort(group, kind="stable")
    group, times = group[order], times[order]
    at = groups_of(group)
    n = np.add.reduceat(times, at) if len(at) else times
    df = np.diff(np.append(at, len(group)))
    group, term = np.divmod(group[at], max(len(names), 1))
    lang, source = np.divmod(group, max(len(sources), 1))
    return pa.record_batch({
        "lang": langs.take(pa.array(lang)).cast(pa.string()), "term": names.take(pa.array(term)).cast(pa.string()), "source": sources.take(pa.array(source)).cast(pa.string()),
        "document": pa.array(np.full(len(at), first), pa.int64()), "df": pa.array(df, pa.int64()), "n": pa.array(n, pa.int64()),
    })


@released
def _count(batches):
    first = 0
    for lot in lots(batches, LOT):
        yield count_lot(lot, first)
        first += lot.num_rows


def lots(batches, limit: int, text: str = "text") -> Iterator[pa.Table]:
    """A task's rows in tables of about limit bytes of text."""
    held, size = [], 0
    for batch in batches:
        tab = pa.Table.from_batches([batch])
        _, starts, ends = texts_of(tab, text)
        for i, j in pieces(starts, ends, limit):
            held.append(tab.slice(i, j - i))
            size += int(ends[j - 1] - starts[i])
            if size >= limit:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def runs(batches, keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A sorted stream in tables that hold whole runs of equal keys, and where each run starts."""
    rest = None
    for batch in batches:
        tab = pa.Table.from_batches([batch])
        tab = pa.concat_tables([rest, tab]).combine_chunks() if rest is not None else tab
        if not tab.num_rows:
            continue
        at = starts_of(tab, keys)
        if at[-1]:
            yield tab.slice(0, int(at[-1])), at[:-1]
        rest = tab.slice(int(at[-1]))
    if rest is not None and rest.num_rows:
        yield rest, starts_of(rest, keys)


def starts_of(tab: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.zeros(max(tab.num_rows - 1, 0), bool)
    for k in keys:
        col = tab.column(k).combine_chunks()
        new |= np.asarray(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)))
    return np.concatenate([[0], np.flatnonzero(new) + 1])


@released
def _merge(batches):
    """Sums of a run (lang, term, source), so that the rows of one lot become one of the partition."""
    for tab, at in runs(batches, ("lang", "term", "source")):
        out = {k: tab.column(k).take(pa.array(at)) for k in ("lang", "term", "source", "document")}
        out |= {k: pa.array(np.add.reduceat(tab.column(k).to_numpy(), at)) for k in ("df", "n")}
        yield from pa.table(out).to_batches()


def _keep(least: int):
    @released
    def run(batches):
        """Of runs (lang, term) in enough documents: the count of each source, and of all."""
        for tab, at in runs(_merge(batches), ("lang", "term")):
            size = np.diff(np.append(at, tab.num_rows))
            df, n = (np.add.reduceat(tab.column(k).to_numpy(), at) for k in ("df", "n"))
            total = np.repeat(n, size)
            out = tab.select(["lang", "term", "source", "n"]).append_column("total", pa.array(total))
            yield from out.filter(pa.array(np.repeat(df >= least, size))).to_batches()

    return run


def share(count: np.ndarray, base: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT (count + 1) / base), by long division in steps of 1000, which stays within 64 bits."""
    whole, rest = np.divmod(count + 1, base)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, base)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def _sorted_by_run(df: DataFrame, *more: str) -> DataFrame:
    """Dealt by (lang, term) and sorted by (lang, term, ...) within partitions; a hash before them lets the sort compare numbers first."""
    h = F.xxhash64("lang", "term")
    return df.withColumn("h", h).repartition("h").sortWithinPartitions("h", "lang", "term", *more).drop("h")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, source, n, total): counts of every term in `least` documents of its language, for the sources that have it."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return _sorted_by_run(docs.mapInArrow(_count, PARTIAL), "source", "document").mapInArrow(_keep(least), KEPT)


def _group_ids(tab: pa.Table, known: dict) -> np.ndarray:
    """Numbers of the rows' (lang, source), the same for a whole task."""
    lang, langs = _codes(tab.column("lang"))
    source, sources = _codes(tab.column("source"))
    each, back = np.unique(lang * len(sources) + source, return_inverse=True)
    names = zip(langs.take(pa.array(each // len(sources))).to_pylist(), sources.take(pa.array(each % len(sources))).to_pylist(), strict=True)
    return np.array([known.setdefault(x, len(known)) for x in names], np.int64)[back]


@released
def _pairs(batches):
    """Of runs (lang, term) with their sources' bases: what a pair of sources that both have the term is off by, summed by pair."""
    known: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}

    def emit() -> pa.RecordBatch:
        names = list(known)
        a, b = [names[k >> 32] for k in sums], [names[k & 0xFFFFFFFF] for k in sums]
        out = pa.record_batch([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])
        sums.clear()
        return out

    for tab, at in runs(batches, ("lang", "term")):
        group = _group_ids(tab, known)
        n, base = tab.column("n").to_numpy(), tab.column("base").to_numpy()
        p, zero = share(n, base), share(np.zeros_like(n), base)
        size = np.diff(np.append(at, len(n)))
        width, start = np.repeat(size, size), np.repeat(at, size)
        for a, b in pieces(np.cumsum(width) - width, np.cumsum(width), BUFFER):
            i, j = np.repeat(np.arange(a, b), width[a:b]), spread(start[a:b], width[a:b])
            i, j = i[i != j], j[i != j]
            off = apart(p[i], p[j]) - apart(p[i], zero[j]) - apart(zero[i], p[j]) + apart(zero[i], zero[j])
            pair = group[i] << 32 | group[j]
            order = np.argsort(pair, kind="stable")
            first = groups_of(pair[order])
            for k, x in zip(pair[order][first].tolist(), np.add.reduceat(off[order], first).tolist() if len(first) else [], strict=True):
                sums[k] = sums.get(k, 0) + x
            if len(sums) > BUFFER:
                yield emit()
    if sums:
        yield emit()


def _share(count: str, base: str) -> str:
    """share() in SQL."""
    return f"(1 + ((CAST({count} AS DECIMAL(20,0)) + 1) * {UNIT}) DIV {base})"


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) DIV ({q})"


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from each other source of its language, and its terms above the language's share."""
    kept = saved(kept_terms(docs, least))
    kinds = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    groups = kinds.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").selectExpr("lang", "source", "coalesce(v, 0) v", "coalesce(n, 0) + coalesce(v, 0) base", "coalesce(`all`, 0) + coalesce(v, 0) lang_base")
    groups = saved(groups.withColumn("zero", F.expr(f"CASE WHEN v > 0 THEN {_share('0', 'base')} END")))

    rows = kept.join(groups.select("lang", "source", "base", "lang_base"), ["lang", "source"])
    found = rows.withColumns({"p": F.expr(_share("n", "base")), "q": F.expr(_share("total", "lang_base"))}).where("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))

    off = _sorted_by_run(rows.select("lang", "term", "source", "n", "base"), "source").mapInArrow(_pairs, "lang string, source string, item string, value long")
    often = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups.select("lang", "source", "base", "zero"), ["lang", "source"]).withColumn("p", F.expr(_share("n", "base")))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), "v")
    sided = often.join(others, "lang").where("source <> item")
    once = "CAST({} - {} AS DECIMAL(38,0)) * times"
    ours = sided.selectExpr("lang", "source", "item", f"{once.format(_apart('p', 'other'), _apart('zero', 'other'))} value")
    theirs = sided.selectExpr("lang", "item source", "source item", f"{once.format(_apart('other', 'p'), _apart('other', 'zero'))} value")
    plain = groups.join(others.drop("v"), "lang").where("source <> item").selectExpr("lang", "source", "item", f"coalesce(CAST({_apart('zero', 'other')} AS DECIMAL(38,0)) * v, 0) value")
    pairs = off.withColumn("value", F.col("value").cast("decimal(38,0)")).unionByName(ours).unionByName(theirs).unionByName(plain)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", place).select(columns).unionByName(found.withColumn("rank", place).where(F.col("rank") <= top).select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + z.v) AS p, 1 + {UNIT}::HUGEINT * (k.total + 1) // (z.n + z.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN size z ON z.lang = g.lang LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) p
  ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= {TOP}
"""
