import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import piece_table as X
from docspark.llm import queries as Q
from docspark.llm import token_counts

LIB = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
TABLE = X.ChunkTable(Q.piece_model(), rows=500)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", "▁", "the", "<s>", "\t", "\x00", "é", "中", "😀", "\r\n"])), max_size=12))
def test_ids_are_the_librarys(parts):
    t = "".join(parts)
    assert TABLE.encode([t, t])[1].tolist() == LIB.encode(t)


def test_long_texts_and_a_full_table():
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 70))) for _ in range(400)) for _ in range(5)] + ["a" * 20000, ""]
    assert [x.tolist() for x in TABLE.encode(texts)] == LIB.encode(texts)


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op4_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIB.encode(texts[r.doc_id]) + [2]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids)))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (None, "", "k"), (2, " a", "k"), (2, " a", "k")], "doc_id long, text string, ids string")
    rows = X.encode_decode(df, Q.piece_model()).collect()
    assert len(rows) == 4 and [list(r.ids) for r in rows if r.doc_id in (1, None)] == [[2], [2]] and {r.decoded for r in rows} == {"", " a"}
    assert X.encode_decode(df.limit(0), Q.piece_model()).count() == 0


def test_lengths_and_histogram(spark):
    sf = "/root/testdata/sf0.001"
    lengths = sorted(len(LIB.encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = Q.op8_token_counts(spark, sf).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in rows] == sorted(set(lengths))
    for r in rows:
        at = r.n_tokens
        assert r.n_docs == lengths.count(at) and r.docs_from == sum(x >= at for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= at)
        assert r.tokens_total == sum(lengths) and r.truncated_total == sum(min(x, at) for x in lengths)
        assert r.docs_to == sum(x <= at for x in lengths) and r.share_to == pytest.approx(r.docs_to / len(lengths))
    hist = Q.op8_token_counts(spark, sf)
    got = {(r.kind, r["at"]): r.value for r in token_counts.answers(hist, [0, 100, 10**6], [0.5, 1.0]).collect()}
    assert got == {("limit", 0.0): 0, ("limit", 100.0): sum(min(x, 100) for x in lengths), ("limit", 1e6): sum(lengths), ("quantile", 0.5): lengths[(len(lengths) + 1) // 2 - 1], ("quantile", 1.0): lengths[-1]}


def test_histogram_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 0)], "doc_id long, n_tokens long")
    assert [(r.n_docs, r.docs_from, r.truncated_total) for r in token_counts.histogram(df).collect()] == [(2, 2, 0)]
    assert token_counts.histogram(df.limit(0)).count() == 0


def test_a_worker_keeps_its_table_over_tasks():
    model = Q.piece_model()
    first = X.worker_table(model)
    first.encode(["some words", "more words"])
    again = X.worker_table(model)
    assert again is first and "▁words" in again.table
