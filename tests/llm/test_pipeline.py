"""The corpus pipeline against brute force, stage by stage."""

import sys

import pytest

sys.path.insert(0, "/root/repo")
import corpus_pipeline as C  # noqa: E402
from llm_cases import AWKWARD  # noqa: E402
from sparkcast.llm.util import save  # noqa: E402
from test_text_joins import brute_components, brute_repeats  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import public_tokenizers as P
    docs = spark.read.parquet(SF + "/documents.parquet")
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["language", "near_copies", "passages", "benchmark", "tokens"]

    before = rows(docs)
    now = save(stages["language"](spark, docs, SF))
    assert now.columns == COLUMNS and rows(now) == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}

    before = rows(now)
    now = save(stages["near_copies"](spark, now, SF))
    assert now.columns == COLUMNS and rows(now) == {i: before[i] for i in {int(c) for _, _, c in brute_components(sorted(before.items()))}}

    before = rows(now)
    now = save(stages["passages"](spark, now, SF))
    after = rows(now)
    gone = {int(i): n for i, _, n, _, _ in brute_repeats(sorted(before.items()), C.PASSAGE, "first")}
    assert now.columns == COLUMNS and all(r.n_chars == len(r.text) for r in now.collect())
    for i, t in before.items():
        left = after.get(i)
        # characters that a span cuts stay whole
        lost = len(t.encode()) - len((left or "").encode())
        assert (left is None and gone[i] > 0) or gone[i] - 8 <= lost <= gone[i] if gone[i] else left == t
    assert any(gone.values())

    before = after
    now = save(stages["benchmark"](spark, now, SF))
    items = [r.text for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    assert now.columns == COLUMNS and rows(now) == {i: t for i, t in before.items() if not any(x in t for x in items)}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(C.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = stages["tokens"](spark, now, SF)
    assert {r.doc_id: r.ids for r in final.collect()} == {i: enc.encode_ordinary(t) for i, t in rows(now).items()}


def test_run_counts(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"] and 0 < out.count() < 200


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage_takes_awkward_and_empty(spark, name):
    df = spark.createDataFrame([(i, t, None if i == 903 else "en", None, None) for i, t in AWKWARD + AWKWARD[3:5]],
                               "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(C.STAGES)[name]
    out = stage(spark, df, SF)
    assert out.count() <= len(AWKWARD) + 2 and stage(spark, df.limit(0), SF).count() == 0
    if name != "tokens":
        assert out.columns == COLUMNS and out.dtypes == df.dtypes


@pytest.mark.parametrize("word", ["a", "to"])
def test_passage_of_51_short_words_goes(spark, word):
    """Planted in the middle of two texts, it stays in the first only."""
    planted = " ".join(word[:-1] + chr(97 + i % 26) if len(word) > 1 else chr(97 + i * i % 26) for i in range(51))
    around = [[" ".join(f"before{i}in{n}" for i in range(60)), " ".join(f"{n}after{i}" for i in range(60))] for n in (1, 2)]
    docs = spark.createDataFrame([(n, f"{b} {planted} {a}", "en", "s", 0) for n, (b, a) in enumerate(around)], "doc_id long, text string, lang string, source string, n_chars long")
    after = rows(dict(C.STAGES)["passages"](spark, docs, SF))
    assert planted in after[0] and planted not in after[1]
    assert all(part in after[n] for n in (0, 1) for part in around[n])


@pytest.mark.parametrize("name", ["language", "passages"])
def test_texts_go_through_python_once(spark, name, capsys):
    """A filter on a function's result doesn't bring a second copy of the function into its tasks."""
    df = spark.createDataFrame([(i, f"some words of text {i}", "en" if i % 2 else "de", "s", 20) for i in range(6)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(C.STAGES)[name](spark, df, SF)
    out.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1 and out.count() == 6


def test_benchmark_without_items_needs_no_python_rows(spark, capsys):
    """Nothing is made of a Python list: it would take Python workers of another kind on every executor."""
    from sparkcast.llm.decontaminate import find_leaks
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string").select("*")
    items = spark.range(0).selectExpr("id as item_id", "cast(id as string) as text")
    out = find_leaks(spark.range(1).selectExpr("id as doc_id", "'a text' as text"), items)
    out.explain()
    assert "ExistingRDD" not in capsys.readouterr().out
    assert out.dtypes == [("doc_id", "bigint"), ("item_id", "bigint"), ("score", "double"), ("question_overlap", "double"), ("answer_overlap", "double")]
    assert out.count() == 0 and find_leaks(docs, items).count() == 0
