import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tripleloom.llm.packing import Encoder, pack, pieces, write_buckets

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  ", "\n", "a  ", "a \n b", "x\n\n y  z", "   b", "don't  they'll\t go", "　a 　 b",
       "1 22  333\r\n4", "<|endoftext|> a", "é è\x85 ü", "a\x1c b", "日本 語", "w" * 5000, "#$%  &&& ** \n", "\n a", "end \n"]


def model():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_units_encode_as_whole_texts():
    draw = random.Random(5)
    signs = [" ", "  ", "\n", "\t", "a", "Bc", "é", " ", " ", "1", "'s", "!", "日", "\x85", "\x1c", " ", "　"]
    texts = ODD + ["".join(draw.choices(signs, k=draw.randrange(1, 30))) for _ in range(3000)]
    ids, bounds = Encoder(PATH)(pa.array(texts))
    tokenizer = model()
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == expected(tokenizer, text), repr(text)


def test_added_tokens_keep_their_ids():
    tokenizer = Tokenizer.from_file(PATH)
    draw, end = random.Random(6), "<|endoftext|>"
    signs = [" ", "  ", "\n", "a", "Bc", "é", end, end, "<|endof", "text|>", "日", "<", "1"]
    texts = [*ODD, end, end + end, f" {end} ", f"a  {end}  b", f"a {end}", "<|endof", "text|> a", "x" + end, end + "\n"]
    texts += ["".join(draw.choices(signs, k=draw.randrange(1, 20))) for _ in range(3000)]
    ids, bounds = Encoder(PATH, added=True)(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == expected(tokenizer, text), repr(text)


def test_query_gives_added_tokens_their_ids(spark, tmp_path):
    spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(Tokenizer.from_file(PATH), "a <|endoftext|> b")
    from tripleloom.llm.queries import QUERIES
    rows = QUERIES["op5_power_of_two_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_tokens for r in rows} == {len(want)}


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_pieces_are_powers_of_two(n):
    got = pieces(n)
    assert sum(got) == n and all(p & (p - 1) == 0 and p <= 1024 for p in got) and got == sorted(got, reverse=True)


def check(rows, packed):
    tokenizer = model()
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in packed}) == len(packed)
    for doc_id, text in rows:
        ids = np.array(expected(tokenizer, text), dtype="<u4")
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids))
            assert r.length & (r.length - 1) == 0 and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            if "ids" in r:
                assert r.ids == ids[at:at + r.length].tolist()
            at += r.length
        assert at == len(ids)
    assert not by_doc


def test_odd_texts(spark, tmp_path):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    packed = pack(docs, PATH)
    check(rows, packed.collect())
    write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("size(ids) <> shiftleft(1, bucket)").isEmpty() and back.count() == packed.count()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], pack(docs, PATH, with_ids=False).collect())


def test_empty_table_repeats_and_bad_length(spark):
    schema = "doc_id long, text string"
    assert pack(spark.createDataFrame([], schema), PATH).collect() == []
    twice = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], schema), PATH).collect()
    assert len({r.sequence_id for r in twice}) == len(twice) and sum(r.length for r in twice) == 9
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], schema), PATH, length=1000)
