"""What reaches the driver from operators whose tables grow with the input."""

import contextlib
import io

from textloom.llm import spelling


def test_tables_of_words_are_not_broadcast(spark):
    """Their files are small when packed, their rows aren't: a broadcast would collect the vocabulary on the driver."""
    docs = spark.createDataFrame([(i, "spelling spelling " * 6 + "speling speling spellings spellings other-word") for i in range(4)], "doc_id long, text string")
    got, out = spelling.variants(docs), io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain()
    assert "Broadcast" not in out.getvalue() and out.getvalue().count("SortMergeJoin") == 2
    assert {r.word: (r.form, r.root, r.n) for r in got.collect() if r.word != "spellings"} == {"spelling": (None, "spelling", 48), "speling": (None, "speling", 8)}
    few = spelling.near_pairs(spark.createDataFrame([("spelling", 5), ("speling", 2)], "word string, n long"))
    assert "Broadcast" not in few._jdf.queryExecution().executedPlan().toString() and few.count() == 1
