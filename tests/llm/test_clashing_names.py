"""Input columns named like those that an operator makes or uses inside."""

import pytest
from pyspark.sql import functions as F

from panelfill.llm import decontaminate, order_minhash, pii, quality_rules, url_rules

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
TEXTS = [(1, "mail a.b@c-d.org now"), (2, PASSAGE), (3, None), (4, "")]


def clashing(frame, names):
    return frame.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def test_made_columns_replace_those_of_the_input(spark, plain):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.example.org/es/x"), (2, None)], "page_id long, url string")
    for operator, module, made, frame in [
            (lambda d: decontaminate.find_passages(d, items), decontaminate, ["n_words", "n_hit", "spans", "items"], plain),
            (quality_rules.with_verdict, quality_rules, ["n_words", "base_failed", "rejected_by", "kept"], plain),
            (url_rules.with_verdict, url_rules, ["host", "path", "rule", "pattern", "verdict"], pages),
            (pii.with_spans, pii, ["base", "spans"], plain)]:
        want, got = operator(frame), operator(clashing(frame, module.TAKEN))
        assert rows(got, frame.columns[0], *made) == rows(want, frame.columns[0], *made)
        assert len(got.columns) == len(set(got.columns))
        carried = [c for c in module.TAKEN if c not in want.columns]
        assert all(v == "clash" for r in got.select(*carried).collect() for v in r)


def test_documents_keep_their_own_columns(spark, plain):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    own = clashing(plain, ["spans", "n_words", "base"])
    kept = decontaminate.without_documents(own, items)
    assert kept.columns == own.columns and rows(kept, *own.columns) == rows(own.where("doc_id <> 2"), *own.columns)
    cut = pii.redacted(own)
    assert cut.columns == own.columns
    assert {r.doc_id: (r.text, r.spans) for r in cut.collect()} == {
        1: ("mail <email> now", "clash"), 2: (PASSAGE, "clash"), 3: (None, "clash"), 4: ("", "clash")}


def test_empty_table_has_no_classes(plain):
    assert order_minhash.with_class(plain.limit(0)).count() == 0 and order_minhash.without_near_duplicates(plain.limit(0)).count() == 0
