"""What a worker holds while it encodes, and what it keeps afterwards."""

import gc
import tracemalloc

import public_tokenizers
import pyarrow as pa

from eventloom.llm import bpe, langid


def runs(spark, monkeypatch):
    """The functions that workers run to encode and to predict a language."""
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")), langid.predict(docs, model)


def batch(*texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), pa.array(["en"] * n)], names=["doc_id", "text", "lang"])


def test_encoding_holds_little(spark, monkeypatch):
    encode, _ = runs(spark, monkeypatch)
    few = batch(*["the cat sat on the mat, 12 times. "] * 3)
    expected = [out.column(1).to_pylist() for out in encode(iter([few]))][0][0]
    tracemalloc.start()
    many, n = batch(*[few.column(1)[0].as_py() * 30] * 4000), 0  # 4 MB
    for out in encode(iter([many])):
        n += out.num_rows
        assert out.column(1)[0].as_py()[: len(expected) - 1] == expected[:-1]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 4000
    assert most < 32 << 20


def test_long_words_do_not_add_up():
    book = bpe.Codebook(lambda words: [[len(w)] for w in words.to_pylist()], False)
    for i in range(40):
        word = bytes([i]) * (1 << 20)
        place = book.numbers(pa.array([word], pa.large_binary()))
        assert book.ids[book.id_bounds[place[0]] : book.id_bounds[place[0] + 1]].tolist() == [1 << 20]
    assert sum(map(len, book.number)) <= 1 << 24
    huge = pa.array([b"x" * (1 << 25), b"y"], pa.large_binary())
    places = book.numbers(huge)
    assert book.ids[book.id_bounds[places]].tolist() == [1 << 25, 1]
    assert book.ids[book.id_bounds[book.numbers(huge)]].tolist() == [1 << 25, 1]


def test_a_later_stage_drops_the_codebook(spark, monkeypatch):
    encode, predict = runs(spark, monkeypatch)
    books = lambda: [x for x in gc.get_objects() if isinstance(x, bpe.Codebook)]
    for texts in (["one two", None], ["one two"]):  # the second task goes on with the first one's words
        assert sum(out.num_rows for out in encode(iter([batch(*texts)]))) == len(texts)
    assert len(books()) == 1
    assert sum(out.num_rows for out in predict(iter([batch("one two", "")]))) == 2
    gc.collect()
    assert not books()
