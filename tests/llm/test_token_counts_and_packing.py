import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rateframe.llm import encoding, packing, queries, textops, token_counts
from tests.llm.helpers import prose, table

PATH = encoding.vocabulary_path()
TEXTS = [
    "Plain words, with marks. And (brackets)!!", None, "", " \n\t ", "it's 'tis don't I'VE 1234 ab12cd !!!??",
    "a<|endoftext|>b <|startoftext|> c <|EndOfText|>", "İstanbul ΣΑΣ x́ ́a é ÀÉ×÷ É9é.É,é ŉ", "日本語 テスト 🎉🎉 x y　z",
    "\x1c a\x1db \x85 c\x0bd\x0ce", prose(1, 5000), "x" * 3000, "Plain words, with marks. And (brackets)!!",
]


@pytest.fixture(scope="module")
def expected():
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_counts_equal_the_library(spark, expected):
    docs = table(spark, enumerate(TEXTS), extra=True)
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, PATH, 10).collect()}
    for i, ids in enumerate(expected):
        assert found[i].n_tokens == len(ids) and found[i].over_limit == (len(ids) > 10)
        assert found[i].n_bytes == len((TEXTS[i] or "").encode())


def test_every_prefix_count_equals_encoding_the_prefix(spark):
    docs = table(spark, enumerate(TEXTS))
    tokenizer = Tokenizer.from_file(PATH)
    rows = token_counts.prefix_counts(docs, PATH).withColumn("cut", token_counts.longest_prefix(7)).collect()
    for row in rows:
        text = TEXTS[row.doc_id] or ""
        for end, count in list(zip(row.ends, row.counts))[:200]:
            assert count == len(tokenizer.encode(text[:end], add_special_tokens=False).ids)
        assert row.cut == max([e for e, c in zip(row.ends, row.counts) if c <= 7], default=0)


def test_query_answers_from_stored_prefixes(spark, data):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = queries.op10_prefix_token_counts(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), size(text), size(text) > queries.MAX_TOKENS)
        assert size(text[: r.kept_points]) <= queries.MAX_TOKENS and (r.over_limit or r.kept_points == len(text.rstrip()))


def test_tokens_until_a_point(spark):
    counts = token_counts.prefix_counts(table(spark, [(1, "one two three")]), PATH)
    assert [counts.select(token_counts.tokens_until(p)).first()[0] for p in (0, 3, 4, 13)] == [0, 1, 1, 3]


def test_forgetting_units_changes_nothing():
    import pyarrow as pa

    column = pa.array(TEXTS)
    small, large = encoding.UnitEncoder(PATH, remembered=3), encoding.UnitEncoder(PATH)
    for _ in range(2):
        assert small.encode(column)[0].tolist() == large.encode(column)[0].tolist()


@pytest.mark.parametrize("window", [8, 2048])
def test_pieces_join_to_the_documents(spark, expected, window):
    docs = table(spark, enumerate(TEXTS), extra=True).repartition(3)
    pieces = packing.pack(docs, PATH, 1, window).toPandas()
    for i, ids in enumerate(expected):
        own = pieces[pieces.doc_id == i].sort_values("start")
        joined = b"".join(own.ids)
        assert np.frombuffer(joined, "<u4").tolist() == [*ids, 1] and (own.doc_tokens == len(ids) + 1).all()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.cut_before.tolist() == [s > 0 for s in own.start]
        assert own.cut_after.tolist() == [True] * (len(own) - 1) + [False]
    sizes = []
    for _, sequence in pieces.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]]
        sizes.append(int(sequence.length.sum()))
    assert all(s == window for s in sizes[:-1]) and 0 < sizes[-1] <= window


def test_rows_without_id_and_repeated_rows_are_packed(spark):
    docs = table(spark, [(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b")])
    pieces = packing.pack(docs, PATH, 1, 2048).withColumn("crc", F.crc32("ids")).collect()
    assert len(pieces) == 4 and len({p.crc for p in pieces}) == 1 and sum(p.length for p in pieces) == 12
    assert pieces[0].crc == zlib.crc32(bytes(pieces[0].ids))


def test_empty_tables(spark):
    none = table(spark, [])
    assert token_counts.count_tokens(none, PATH, 10).count() == 0
    assert token_counts.prefix_counts(none, PATH).count() == 0
    assert packing.pack(none, PATH, 1, 8).count() == 0


def test_a_worker_forgets_its_encoder_when_another_map_begins(spark):
    """The encoder of a worker stayed through all later stages, which held it beside their own."""

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(textops._REMEMBERED)] * batch.num_rows, pa.int64())], ["n"])

    def held_after_loading(batches):
        encoding.encoder(encoding.vocabulary_path())
        yield from held(batches)

    docs = spark.range(4).coalesce(1)
    for _ in range(2):
        assert {r.n for r in textops.map_batches(docs, held_after_loading, "n long").collect()} == {2}
        assert {r.n for r in textops.map_batches(docs, held, "n long").collect()} == {1}
