"""The corpus pipeline: each stage keeps the columns, and its decisions hold for what the next one reads."""

import gc
import os
from collections import Counter

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from orbitframe.llm import toxicity
from orbitframe.llm.common import discard, stage, table
from orbitframe.llm.mixing import mix
from orbitframe.llm.neardup import classes

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, SF))
        assert docs.columns == before.columns, name
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0, name
        if name == "substrings":
            assert docs.count() == before.count()
    assert docs.count() > 0


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of the smallest table and planted ones: copies, near copies, a shared passage, a benchmark item."""
    docs = table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    base = {"lang": "en", "source": "planted", "n_chars": 0}
    own = [" ".join(f"w{d}x{k}" for k in range(200)) for d in range(12)]
    passage = " ".join(f"shared{k}" for k in range(60))
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    rows += [base | {"doc_id": 10_000 + d, "text": t} for d, t in enumerate(own)]
    rows += [base | {"doc_id": 11_000 + d, "text": own[0]} for d in range(3)] + [base | {"doc_id": 12_000, "text": own[1] + " and one more"}]
    rows += [base | {"doc_id": 13_000 + d, "text": own[2 + d].replace("w", f"v{d}") + " " + passage} for d in range(3)] + [base | {"doc_id": 14_000, "text": own[6].replace("w", "u") + " " + item}]
    return spark.createDataFrame(rows, docs.schema)


def test_stages_on_planted_documents(spark, planted):
    """Each stage on the same input: near duplicates by brute force, the others on what was planted."""
    kept = {r["doc_id"] for r in STAGES["near_duplicates"](spark, planted, SF).collect()}
    sets, holders, parent = {}, {}, {}
    for r in planted.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        parent[r["doc_id"]] = r["doc_id"]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for e in sets[i] for j in holders.get(e, ())).items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for e in sets[i]:
            holders.setdefault(e, []).append(i)
    assert kept == {i for i in sets if root(i) == i} and not {11_000, 11_001, 11_002, 12_000} & kept

    texts = {r["doc_id"]: r["text"] for r in STAGES["substrings"](spark, planted, SF).collect()}
    assert "shared7" in texts[13_000] and all("shared7" not in texts[13_000 + d] and f"v{d}" in texts[13_000 + d] for d in (1, 2)) and texts[10_005] == planted.where("doc_id = 10005").first()["text"]

    clean = {r["doc_id"] for r in STAGES["decontamination"](spark, planted, SF).collect()}
    assert 14_000 not in clean and set(range(10_000, 10_012)) <= clean

    labels = table(spark, SF, "labels")
    model = toxicity.fit(planted, labels, F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(planted, model).collect()}
    assert {r["doc_id"] for r in STAGES["toxicity"](spark, planted, SF).collect()} == {i for i, s in scores.items() if s < 0.3}

    mixed = STAGES["mixing"](spark, planted, SF)
    rule = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mix(planted).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in rule.items() if n}


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty and repeated rows, and no rows at all pass every stage with the columns of documents."""
    schema = table(spark, SF, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "no id here at all", "en", None, 17), (4, "x " * 3000, "en", "b", 6000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= 2 * docs.count(), name


CLASHING = ["__id", "__n", "__k", "__source", "__doc_id", "__t", "__kept", "__size", "__ID_", "t", "n", "h", "size", "copies", "kept", "class_id", "own", "node", "comp", "score", "y", "item_id", "target", "whole", "last"]


def test_stages_with_clashing_names(spark, planted):
    """Columns with the names that stages use inside change nothing and are carried."""
    some = planted.where("doc_id >= 10000 or doc_id % 4 = 0")
    more = some.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, step in corpus_pipeline.STAGES:
        plain, out = step(spark, some, SF), step(spark, more, SF)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING), name
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in plain.collect()), name


def test_repeated_labelled_ids_are_one_row(spark):
    """20000 rows of one labelled id do not swell the sample that a classifier learns from."""
    from orbitframe.llm import quality
    from orbitframe.llm.common import one_row

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    labelled = labels.where("quality = 0").orderBy("doc_id").first()["doc_id"]
    copies = docs.where(F.col("doc_id") == labelled).crossJoin(spark.range(20_000)).drop("id")
    many = docs.unionByName(copies.withColumn("text", F.when(F.rand(1) < 0.5, F.col("text")).otherwise("another text")))
    picked, counts = toxicity.sample(many, labels, "toxic", F.lit(True), 2000)
    assert one_row(picked.select("doc_id", F.col("text").cast("binary").alias("text"), "y")).count() == sum(counts.values()) == labels.select("doc_id").distinct().count()
    a, b = (quality.fit(d, labels, F.lit(True)) for d in (docs.unionByName(copies), docs))
    assert a.vectors.shape == b.vectors.shape and abs(a.vectors - b.vectors).max() < 1e-5


def test_stages_leave_nothing_behind(spark):
    """What was shuffled for a stage table goes when it is written, and tables that nothing reads any more are deleted."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(2):  # else those of earlier tests may go meanwhile
        gc.collect()
        spark._jvm.System.gc()
    before = disk.getAllFiles().size()
    counts = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert disk.getAllFiles().size() <= before and counts.count() == 7
    own = os.path.dirname(counts.inputFiles()[0]).removeprefix("file:")
    assert os.path.isdir(own)
    discard(counts)
    assert not os.path.exists(own)
    with pytest.raises(ValueError):
        discard(table(spark, SF, "documents"))

    there = set(os.listdir(os.path.dirname(own)))
    found = classes(table(spark, SF, "documents"))
    new = [os.path.join(os.path.dirname(own), x) for x in os.listdir(os.path.dirname(own)) if x not in there]
    left = [x for x in new if any(f.startswith("part-") for f in os.listdir(x))]
    assert len(left) <= 2, left
    assert found.count() == table(spark, SF, "documents").count()  # signatures and classes
