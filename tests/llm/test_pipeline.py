from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from barloom.llm import toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, a long shared passage, a benchmark passage and insults; labels that teach them."""
    r = random.Random(11)
    words = ["".join(r.choice("aeiourstlnmd") for _ in range(r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs: dict[int, str | None] = {i: text(r.randint(60, 160)) for i in range(300)}
    labels = []
    for i in range(300):
        toxic = i < 120
        if toxic:
            w = docs[i].split()
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["blockhead", "numbskull", "dimwit"])
            docs[i] = " ".join(w)
        labels.append((i, int(toxic)))
    base, passage, item = text(200), text(70), text(40)
    docs |= {400: base, 401: base, 402: base + " end", 410: text(80) + " " + passage + " " + text(30), 411: text(50) + " " + passage, 420: text(60) + " " + item + " " + text(20), 430: None, 431: "", 432: text(90)}
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in docs.items()]
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(30))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, docs, passage


def test_stages_in_order_do_what_they_say(spark, folder):
    out, docs, passage = folder
    frame, kept = spark.read.parquet(f"{out}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, out)
        rows = frame.collect()
        kept[name] = {r["doc_id"]: r["text"] for r in rows}
        frame = spark.createDataFrame(rows, frame.schema)
        if name != "bpe":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tox = set(docs) - set(kept["toxicity"])
    assert len(tox & set(range(120))) >= 110 and not tox & set(range(150, 1000))
    assert {401, 402} & set(kept["ngram_jaccard_join"]) == set() and 400 in kept["ngram_jaccard_join"]
    assert passage in kept["suffix_array_dedup"][410] and passage[10:-10] not in kept["suffix_array_dedup"][411]
    assert set(kept["suffix_array_dedup"]) - set(kept["benchmark_decontamination"]) == {420}
    assert kept["bpe"].keys() == kept["benchmark_decontamination"].keys() and {430, 431, 432} <= kept["bpe"].keys()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_take_empty_tables(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0


def test_threshold_is_the_operators():
    assert toxicity.THRESHOLD == 0.3 and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_near_copies_share_four_fifths_of_their_five_word_strings(spark):
    words = [f"w{k}" for k in range(49)]
    changed, more = [*words[:24], "x", *words[25:]], [*words[:20], "y", *words[21:24], "x", *words[25:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(more))], "doc_id long, text string")  # 40 of 50, 36 of 54
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs.where("doc_id < 3"), "").collect()}
    assert kept == {1}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs.where("doc_id <> 2"), "").collect()}
    assert kept == {1, 3}


def test_stages_take_columns_with_their_helpers_names(spark, folder):
    """Extra columns of any name, also those that stages use inside, come out as they went in; null texts stay null."""
    names = ["toxicity", "toxicity_score", "gone", "found", "ids", "n_tokens", "round_trip", "decoded", "id", "body", "kept", "no_text", "batch", "sid", "label", "FOUND_"]
    frame = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id >= 280")
    frame = frame.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names])
    want = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        rows, schema = (x := stage(spark, frame, folder[0])).collect(), x.schema
        frame = spark.createDataFrame(rows, schema)
        assert frame.columns[: len(want)] == want and (name == "bpe" or frame.columns == want)
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in names)
    assert {"ids_", "n_tokens_", "round_trip_"} <= set(frame.columns) and [r["text"] for r in rows if r["doc_id"] == 430] == [None]
