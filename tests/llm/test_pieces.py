import numpy as np
import public_tokenizers
import sentencepiece
from chronomesh.llm.pieces import decode_texts, encode_texts, pieces
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ours(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in pieces(PATH).encode(texts)]


@given(st.lists(st.one_of(st.text(alphabet="abehinorstT. \n\té日😀", max_size=60), st.text(max_size=30)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(texts):
    assert ours(texts) == [LIBRARY.encode(t) for t in texts]
    for t in texts:
        if "▁" not in t:
            assert pieces(PATH).decode(pieces(PATH).encode([t])[0]) == t


def test_odd_texts():
    texts = ["", " ", "  ", "   a", "a   ", "a  b   c", *(" " * n + "x" for n in range(40)), *(" " * n for n in range(40)), "\0a\0", "<s>", "</s><unk>", "<0x41>", "a▁b", "x" * 3000, "日本" * 500, "wwwwww==>>//" * 40]
    assert ours(texts) == [LIBRARY.encode(t) for t in texts]


def test_long_runs_without_spaces():
    texts = ["abcde" * 20_000, "a " + "é" * 40_000 + " b", "http://" + "x/y?z=" * 10_000]
    assert ours(texts) == [LIBRARY.encode(t) for t in texts]


def test_documents_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    encoded = encode_texts(docs, PATH)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert got == {i: LIBRARY.encode(t) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in decode_texts(encoded, PATH).collect()} == texts
    assert encode_texts(docs.limit(0), PATH).count() == 0


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "a b", 0), (1, "", 0), (1, "", 0)], "doc_id long, text string, ids int")
    rows = encode_texts(df, PATH).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 0, 8]
