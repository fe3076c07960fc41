import os
import subprocess
import sys

import corpus_pipeline
import pytest
from corpusloom.llm import packing, quality, toxicity
from corpusloom.llm.common import table, tokenizer_path
from pyspark import cloudpickle
from pyspark.sql import functions as F


def test_stages_against_plain_python(spark, sf):
    """Every stage keeps what a plain loop over its operator's own parts keeps, and hands on the columns of documents."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}

    model = quality.train(docs, labels)
    left = {i for i, r in rows.items() if quality.verdicts(model, [r["text"].encode()])["kept"][0]}
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == left

    index = toxicity.train(kept, labels, F.lit(True))
    left = {i for i in left if toxicity.verdicts(index, [rows[i]["text"].encode()])[0][0] < 0.5}
    kept = corpus_pipeline.toxic_texts(spark, kept, sf)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == left

    from .test_operators import brute_links, spans_of

    groups = brute_links([(i, rows[i]["text"]) for i in left], 5, 80)
    left = {i for i in left if groups[i][1] == i}
    kept = corpus_pipeline.near_duplicates(spark, kept, sf)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == left

    clean = corpus_pipeline.secrets(spark, kept, sf)
    assert clean.columns == columns
    for r in clean.collect():
        assert not spans_of(r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["text"] == rows[r["doc_id"]]["text"]) == (not spans_of(rows[r["doc_id"]]["text"]))

    from corpusloom.llm import packing

    from .test_operators import cluster_of, library_counts, plain_best_fit, without_number

    texts = [(r["doc_id"], r["source"], r["text"]) for r in clean.collect()]
    wanted = plain_best_fit([(i, source, cluster_of(t), n) for (i, source, t), n in zip(texts, library_counts([t for _, _, t in texts]), strict=True)], packing.CAPACITY)
    for found in (corpus_pipeline.packed(spark, clean, sf), corpus_pipeline.run(spark, sf)):
        rows = [(r["doc_id"], r["piece"], r["begin"], r["length"], r["bin"], r["offset"]) for r in found.collect()]
        assert without_number(rows) == without_number(wanted)


def test_stages_are_these():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_join", "secret_scan", "best_fit_packing"]


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a strong potion for their old friends in town"


def odd_documents(spark):
    rows = [
        (1, PROSE, "en", "a", 9, "x"), (2, PROSE, "en", "a", 9, "x"), (2, PROSE, "en", "a", 9, "y"), (None, PROSE, "en", None, None, "x"),
        (3, None, None, None, None, None), (4, "", "en", "b", 0, "x"), (5, f"{PROSE} token = 'abcdefgh1234'", "en", "b", 9, "x"),
        (6, "word " * 20_000 + PROSE, "en", "c", 9, "x"), (7, "other words " + " ".join(f"w{i}" for i in range(60)), "en", "c", 9, "x"),
        (5, "one more text of the same id " + " ".join(f"v{i}" for i in range(60)), "en", "b", 9, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string")


def test_stages_on_odd_rows(spark, sf):
    docs = odd_documents(spark)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert function(spark, docs.limit(0), sf).count() == 0
    kept = corpus_pipeline.quality_rules(spark, docs, sf).collect()
    assert not [r for r in kept if r["doc_id"] in (3, 4)] and sum(r["doc_id"] == 2 for r in kept) == 2
    assert corpus_pipeline.toxic_texts(spark, docs, sf).count() == docs.count()
    left = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == [1, 3, 4, 5, 6, 7] and sum(r["doc_id"] is None for r in left) == 1
    clean = corpus_pipeline.secrets(spark, docs, sf).collect()
    assert len(clean) == docs.count() and [r["text"] for r in clean if r["doc_id"] == 3] == [None]
    assert [r["text"].endswith("[assign]'") for r in clean if r["doc_id"] == 5 and "fox" in r["text"]] == [True]
    assert corpus_pipeline.packed(spark, docs, sf).select("doc_id").distinct().count() == 8
    assert corpus_pipeline.packed(spark, docs.limit(0), sf).count() == 0


def test_near_duplicates_go_by_id_and_text(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(3, b, 1), (5, a, 1), (5, b, 1), (6, a, 2), (6, a, 1), (5, a, 0)], "doc_id bigint, text string, more int")
    left = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted((r["doc_id"], r["text"] == a, r["more"]) for r in left) == [(3, False, 1), (5, True, 0)]


LEFT_BEHIND = """
import pickle, re, sys
import pyarrow as pa

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

run = pickle.load(open(sys.argv[1], "rb"))
batch = lambda k: pa.record_batch({"doc_id": pa.array(range(2000), pa.int64()), "source": pa.array(["x"] * 2000), "cluster": pa.nulls(2000, pa.int64()),
    "text": pa.array([" ".join(f"{(k * 2000 + i) * 15 + j:x}w" * 3 for j in range(15)) * 12 for i in range(2000)])})
rows = lambda n: sum(b.num_rows for b in run(map(batch, range(n))))
assert rows(1) == 2000
before = held()
assert rows(10) == 20000
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_back_what_packing_took(spark, sf, monkeypatch, tmp_path):
    """The process that counted tokens lives on beside the next stages, so what it used must not stay with it."""
    seen = []
    frame = type(table(spark, sf, "documents"))
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *rest, **more: seen.append(run) or whole(self, run, *rest, **more))
    packing.measured(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), "doc_id", "source", "text", None)
    (tmp_path / "run").write_bytes(cloudpickle.dumps(seen[-1]))
    got = subprocess.run([sys.executable, "-c", LEFT_BEHIND, str(tmp_path / "run")], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)}, check=True)
    assert float(got.stdout) < 12
