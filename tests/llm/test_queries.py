import os

import duckdb
import pytest

from docloom.llm.queries import QUERIES, SQL
from docloom.llm.tokenizer import VOCABULARY, count_tokens

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_says_the_same(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    got = QUERIES[name](spark, DATA)
    theirs = connection.execute(SQL[name])
    order = [c[0] for c in theirs.description]
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(theirs.fetchall())


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is not there")
def test_long_texts_are_counted_in_pieces():
    from docloom.llm import tokenizer

    text = "Some words, 12 numbers and übergrößen in a row. " * 9000
    assert count_tokens(text, VOCABULARY) == len(tokenizer.encoding(VOCABULARY).encode_ordinary(text))
    assert count_tokens("", VOCABULARY) == 0
