"""Language identification and toxicity: held-out accuracy, awkward rows."""

import pytest
from pyspark.sql import functions as F

from llm_cases import AWKWARD, frame
from sparkcast.llm import language_id as L, queries as Q, toxicity as T

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = Q.op5_language_id(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_are_apart():
    for n in (2, 4, 7, 20):
        c = L.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_language_awkward(spark):
    df = frame(spark, AWKWARD)
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = L.train(train)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert len(got) == len(AWKWARD)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 910)) and got[909].lang_pred != "und"
    assert {r.lang_pred for r in L.identify(df, L.train(train.limit(0))).collect()} == {"und"}
    one = L.identify(df, L.train(train.filter("lang = 'en'")))
    assert {r.lang_pred for r in one.collect()} == {"en", "und"}
    assert L.identify(df.limit(0), model).count() == 0
    assert {r.doc_id for r in L.keep_identified(df).collect()} == {i for i, _ in AWKWARD} - {900, 901, 902, 910}


def test_ambiguous_texts_are_flagged(spark):
    train = spark.createDataFrame([("aaaa bbbb aaab " * 20, "x"), ("cccc dddd cccd " * 20, "y")], "text string, lang string")
    rows = L.identify(spark.createDataFrame([("aaaa bbbb",), ("aaaa bbbb cccc dddd",), ("zq",)], "text string"), L.train(train)).collect()
    flags = {r.text: r.ambiguous for r in rows}
    assert not flags["aaaa bbbb"] and flags["zq"]


@pytest.fixture(scope="module")
def toxic(spark):
    import random
    random.seed(6)
    words, bad = [f"w{i}" for i in range(200)], ["nastyone", "vileword", "rudething"]
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(random.choice(words) for _ in range(random.randint(2, 9))) for _ in range(random.randint(1, 30))]
        y = int(i % 4 == 0)
        if y:
            k = random.randrange(len(sentences))
            sentences[k] += " " + random.choice(bad)
        docs.append((i, ". ".join(sentences)))
        labels.append((i, y))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_finds_sentences(spark, toxic):
    docs, labels = toxic
    model = T.train(docs, labels.filter("doc_id % 3 <> 1"))
    rows = T.score(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    for r in rows:
        for s in r.offending if r.toxic else []:
            part = r.text.encode()[s["first"]:s["after"]].decode()
            assert any(b in part for b in ("nastyone", "vileword", "rudething"))
        if r.predicted:
            assert r.offending


def test_toxicity_held_out(spark):
    out = Q.op7_toxicity(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(SF + "/labels.parquet"), "doc_id").filter("held_out").collect()
    a, b = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((x > y) + (x == y) / 2 for x in a for y in b) / (len(a) * len(b)) > 0.9
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * len(b)


def test_toxicity_awkward(spark, toxic):
    docs, labels = toxic
    extra = spark.createDataFrame([(None, 1), (5, None), (0, 0)], "doc_id long, toxic int")
    model = T.train(docs, labels.unionByName(extra))
    df = frame(spark, AWKWARD)
    rows = T.score(df.withColumn("score", F.lit("old")), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score < 0.7 and r.predicted == 0 for r in rows)
    assert {r.score for r in rows if not r.text} == {min(r.score for r in rows)}
    none = T.train(docs, labels.limit(0))
    assert all(r.score < 0.1 for r in T.score(df.filter("doc_id <> 907"), none).collect()) and T.score(df.limit(0), model).count() == 0
