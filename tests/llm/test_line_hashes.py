"""op2: which lines are hashed, and how often."""

import re

from seqfold.llm import line_dedup


def test_lines_are_hashed_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = line_dedup._lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove(") == 1


def test_lines_with_a_word(spark):
    """Lines of white space only have no hash; equal words have equal ones, whatever the white space; all other differ."""
    lines = ["", " ", "\t \r", "\x0b\x0c", "a", " a\t", " ", "a b", "a  b\r", "ab", "b a", "a b c d", "a b c d e", "a b  c\td e", "a b c de", "a b c d f", "a b c d e f", "b c d e f", "　 x"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (None, "a"), (3, ""), (4, "\n")], "doc_id long, text string")
    got = {r.at: (r.h1, r.h2, r.k2) for r in line_dedup._lines(docs).collect() if r.doc_id == 1}
    words = {i: tuple(re.findall(r"[^\x20\x09-\x0D]+", x)) for i, x in enumerate(lines)}
    assert set(got) == {i for i, w in words.items() if w} and line_dedup._lines(docs).where("doc_id IS NULL OR doc_id <> 1").count() == 0
    for i in got:
        assert (got[i][2] is None) == (len(words[i]) < line_dedup.MIN_WORDS)
        for j in got:
            assert (got[i][:2] == got[j][:2]) == (words[i] == words[j])
