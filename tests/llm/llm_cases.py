"""Awkward documents that every text operator must take."""

AWKWARD = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  two"), (905, "a b c d e"), (906, "x" * 50_000),
           (907, "same words again " * 400), (908, "same words again " * 400), (909, "né 漢字 \U0001F600 " * 30), (None, "no id here at all"), (910, "12 34 !!")]


def frame(spark, docs):
    """With extra columns whose names clash with what operators add."""
    return spark.createDataFrame([(i, t, "en", "s", 7, "mine") for i, t in docs],
                                 "doc_id long, text string, lang string, source string, n_tokens long, _maybe_not string")
