"""Tables whose texts are all null, empty or blank, and tables with odd columns, through every operator."""

import pytest

from medgraph.llm import exact, lines, lm, packing, quality, sharding, simhash, suffix, tokens, toxicity
from medgraph.llm.queries import vocabulary

OPERATORS = {
    "quality": lambda d, labels: quality.judge(d, labels),
    "toxicity": lambda d, labels: toxicity.score(d, labels),
    "lines": lambda d, labels: lines.dedup_lines(d),
    "exact": lambda d, labels: exact.exact_groups(d),
    "suffix": lambda d, labels: suffix.repeat_digests(d),
    "tokens": lambda d, labels: tokens.token_digests(d, vocabulary()),
    "lm": lambda d, labels: lm.score(d),
    "packing": lambda d, labels: packing.pack_documents(d, vocabulary()),
    "sharding": lambda d, labels: sharding.shard_documents(d),
    "simhash": lambda d, labels: simhash.near_groups(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_each(spark, name):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (None, None, None), (2, "", "b")], "doc_id long, text string, block string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in OPERATORS[name](docs, labels).collect()) == sorted(["1", "2", "2", "3", "None"])
