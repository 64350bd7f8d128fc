"""Columns that bear the names of helper columns, and texts of white space only, through the stages that keep whole rows."""

import pytest
from pyspark.sql import functions as F

from turnstile.llm import decontaminate, line_dedup, ngram_join, quality

NAMES = ["_word", "_bits", "_gone", "_h", "h", "h1", "doc", "of", "band", "root", "rep", "k", "key", "gone", "kept_text", "lines"]


@pytest.fixture(scope="module")
def named(odd):
    """The awkward rows with every helper name as a further column."""
    return odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in NAMES])


STAGES = {
    "quality": lambda df, bench: quality.keep_good(df),
    "lines": lambda df, bench: line_dedup.drop_repeated_lines(df),
    "near": lambda df, bench: ngram_join.keep_one_of_each(df),
    "leaks": lambda df, bench: decontaminate.keep_clean(df, bench),
}


@pytest.mark.parametrize("stage", STAGES)
def test_helper_names_are_free(spark, named, odd, none, stage):
    bench = spark.createDataFrame([(1, "the old mill by the river was sold to a new owner in spring number 4 and then some more words follow", "x")], "item_id long, text string, _word string")
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    out = STAGES[stage](named, bench)
    assert out.columns == named.columns
    key = lambda df: sorted(repr((r["doc_id"], r["text"])) for r in df.collect())
    assert key(out) == key(STAGES[stage](plain, bench))
    assert {r["_gone"] for r in out.select("_gone").collect()} <= {"_gone"}
    assert STAGES[stage](none, bench).count() == 0


def test_texts_of_blanks_are_their_own_class(spark, shared):
    blanks = [" ", " ", "　\n", "\x1c", "\x1c", "", " ", " "]
    df = spark.createDataFrame(list(enumerate(blanks)), "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"], r["copies"]) for r in ngram_join.classed(df).collect()} == {(i, i, 0, 1) for i in range(len(blanks))}
    assert ngram_join.keep_one_of_each(df).count() == len(blanks)
