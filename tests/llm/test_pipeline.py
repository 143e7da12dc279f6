"""The stages one by one, and their chain, on rows with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_operators import DOC, brute_components, check_lines

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(2, 4)))
    passage = " ".join(word() for _ in range(60))
    data, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        lines = [" ".join(words[k : k + 15]) for k in range(0, len(words), 15)]
        if i % 10 == 1:
            lines.insert(1, passage)
        data.append((i, "\n".join(lines)))
        labels.append((i, 0, int(toxic)))
    model = next(t for d, t in data if d % 4 == 2 and d % 10 != 1 and len(t.split()) > 100)
    copy = model.split(" ")
    copy[3] = "changed"
    data += [(600, model), (601, " ".join(copy)), (602, ""), (603, None), (None, None)]
    base = str(tmp_path_factory.mktemp("corpus"))
    rows = [(d, t, "en", f"s{(d or 0) % 3}", None if t is None else len(t)) for d, t in data]
    spark.createDataFrame(rows, DOC).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, data, {d for d, _, t in labels if t}


def test_stages(spark, planted, tmp_path):
    base, data, toxic = planted
    docs = spark.read.parquet(f"{base}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if k < 4 else []
        out = stage(spark, docs, base)
        if k < 4:
            assert out.columns == NAMES
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.collect()
        if name == "toxicity":
            assert {r["doc_id"] for r in kept[name]} == {d for d, _ in data} - toxic
        elif name == "line_dedup":
            ids = {r["doc_id"] for r in kept[name]}
            assert {d for d, _ in before} - ids == {600}
            got = {r["doc_id"]: r["text"] or "" for r in kept[name]}
            lines = {d: (t or "").split("\n") for d, t in before}
            assert sum(len(x.split("\n")) < len(lines[d]) for d, x in got.items()) > 20
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept[name])
        elif name == "near_duplicates":
            groups = brute_components(before)
            assert {r["doc_id"] for r in kept[name]} == {d for d, n, c in groups if d == c or not n}
        elif name == "mix_sources":
            assert {r["doc_id"] for r in kept[name]} <= {d for d, _ in before} and len(kept[name]) > len(before)
    assert sum(r["piece"] == 0 for r in kept["pack"]) == len(kept["mix_sources"])
    assert len(kept["pack"]) == len({(r["sequence_id"], r["offset"]) for r in kept["pack"]})


def test_run(spark, planted):
    out = pipeline.run(spark, planted[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.filter(F.col("length") > 2048).count() == 0


def test_empty_tables(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], DOC).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    assert pipeline.run(spark, base).count() == 0


def test_lines_checker_is_used():
    check_lines([(0, "a b")], {0: ([], "a b")})
