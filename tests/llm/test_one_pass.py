"""Byte-level BPE and its way back in one pass over the texts."""

from murmura.llm import byte_bpe


def test_encoding_with_bytes_is_one_pass_and_what_two_give(spark):
    texts = ["", None, "plain words  and\nlines ", "a <|endoftext|> é 漢字 ‍", "zx" * 3000]
    df = spark.createDataFrame([(k, t, b"old") for k, t in enumerate(texts)], "doc_id long, text string, decoded binary")
    known = byte_bpe.vocabulary()
    one = byte_bpe.encode(df, *known, with_bytes=True)
    two = byte_bpe.decode(byte_bpe.encode(df.drop("decoded"), *known), *known)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert one.columns == two.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r.doc_id: bytes(r.decoded).decode() for r in one.collect()} == {k: t or "" for k, t in enumerate(texts)}
