"""Encoding, decoding, bit packing and sequences against the libraries and exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtally.llm import bitpack, bpe, packing, queries, shared, vocabulary
from fieldtally.llm.shared import folder

ALPHABETS = [
    "aAstmdrevl  \n\t''''.!?12",
    "'sre ve ll  'LL 'dé漢字　٣ \x1c",
    "\U0001f600ßKİ x' \r\n--__",
]
ODD = ["", " ", "a" * 3000, "'" * 999, " " * 500 + "x", "\n" * 700, "ab" * 900, "<|endoftext|>", "\0\0 a"]


def texts(n=3000, seed=5):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choices(rnd.choice(ALPHABETS), k=rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktokens():
    ranks = bpe.read_ranks(queries.RANKS)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(queries.VOCABULARY)
    t.encode_special_tokens = True
    return t


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_slices_and_merges_are_those_of_the_library(tiktokens):
    given = texts()
    ids, counts, _, _ = bpe.rank_encoder(queries.RANKS)(given)
    assert split(ids, counts) == [tiktokens.encode_ordinary(t) for t in given]


def test_slices_of_the_other_library(tokenizer):
    given = texts(seed=8)
    ids, counts, _, _ = vocabulary.encoder(queries.VOCABULARY)(given)
    assert split(ids, counts) == [e.ids for e in tokenizer.encode_batch(given, add_special_tokens=False)]


END = "<|endoftext|>"


def test_documents_are_encoded_as_by_the_library(spark):
    """Special tokens in a text were encoded as ordinary text."""
    library = Tokenizer.from_file(queries.VOCABULARY)
    rnd = random.Random(3)
    some = [f"a{END}b", END, END * 3, f" {END} x  ", f"{END}\n", "<|endoftext", f"<|endoftext{END}|>", f"{'w ' * 9000}{END}'s"]
    mixed = ["".join(rnd.choice([END, *texts(40, k)]) for _ in range(5)) for k in range(60)]
    for given in (some, ["", *some, ""], mixed, texts(50), []):
        ids, counts = vocabulary.document_encoder(queries.VOCABULARY)(given)
        wanted = [library.encode(t, add_special_tokens=False).ids for t in given]
        assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]
    docs = spark.createDataFrame([(1, f"a{END}b"), (2, None)], "doc_id long, text string")
    path = folder(spark, "test-special")
    bitpack.write(docs, path, queries.VOCABULARY, end_id=2, shards=2)
    want = {1: np.array([64, 50256, 65, 2], dtype="<u4").tobytes(), 2: np.array([2], dtype="<u4").tobytes()}
    assert {r.doc_id: bytes(r.ids) for r in bitpack.read(spark, path).collect()} == want
    rows = packing.pack(docs, queries.VOCABULARY, 2).collect()
    assert {r.doc_id: bytes(r.ids) for r in rows} == want


def test_offsets_decode_single_slices(tiktokens):
    text = "it's  been 12 days..."
    ids, _, firsts, n = bpe.rank_encoder(queries.RANKS)([text])
    slices = [tiktokens.decode(part.tolist()) for part in np.split(ids, firsts[1:])]
    assert n.tolist() == [7]
    assert slices == ["it", "'s", " ", " been", " 12", " days", "..."]


def test_a_full_cache_forgets_and_stays_right(monkeypatch, tiktokens):
    monkeypatch.setattr(bpe, "CACHE", 64)
    encoder = bpe.SliceEncoder(bpe._tiktoken_classes(), bpe.Ranks(bpe.read_ranks(queries.RANKS)).encode)
    for seed in range(4):
        given = texts(200, seed)
        ids, counts, _, _ = encoder(given)
        assert split(ids, counts) == [tiktokens.encode_ordinary(t) for t in given]
    assert len(encoder.known.keys) < 4000


def test_slices_with_equal_hashes_are_told_apart(monkeypatch, tiktokens):
    same = np.zeros(0x110000, dtype=np.uint64)
    monkeypatch.setattr(bpe, "_values", lambda: (same, same))
    encoder = bpe.SliceEncoder(bpe._tiktoken_classes(), bpe.Ranks(bpe.read_ranks(queries.RANKS)).encode)
    ids, counts, _, _ = encoder(["ab cd", "ef gh"])
    assert split(ids, counts) == [tiktokens.encode_ordinary(t) for t in ("ab cd", "ef gh")]


def frame(spark):
    rows = [(1, "It's here."), (2, None), (3, ""), (1, "It's here."), (None, "x y"), (9, "word " * 30000)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(7).alias("ids"))


def test_encode_and_decode_frames(spark, tiktokens):
    found = bpe.encode(frame(spark), queries.RANKS, decoded="same")
    found = found.withColumn("back", bpe.decoder(queries.RANKS)("ids"))
    assert found.columns == ["doc_id", "text", "ids", "id_offsets", "same", "back"]
    rows = found.collect()
    assert len(rows) == 6
    for r in rows:
        assert list(r.ids) == tiktokens.encode_ordinary(r.text or "")
        assert bytes(r.back) == bytes(r.same) == (r.text or "").encode()


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packed_ids_come_back(width):
    rnd = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rnd.integers(0, 1 << width, n, dtype=np.uint64).astype("<u4")
        payload = bitpack.pack(ids, width, block=128)
        assert np.array_equal(bitpack.unpack(payload), ids)
        for a, b in ((0, 10), (60, 70), (127, 129), (500, 2000), (5, 5)):
            assert np.array_equal(bitpack.unpack(payload, a, b), ids[a:b])


def test_packed_size_and_refusals():
    assert bitpack.width_of(50257) == 16 and bitpack.width_of(1) == 1 and bitpack.width_of(257) == 9
    assert len(bitpack.pack(np.zeros(6400, dtype="<u4"), 9)) < 6400 * 9 / 8 + 100
    with pytest.raises(ValueError, match="more than"):
        bitpack.pack(np.array([8]), 3)
    with pytest.raises(ValueError, match="not a payload"):
        bitpack.unpack(b"XXXX" + bytes(40))


def test_dataset_is_in_order(spark, tokenizer):
    docs = frame(spark)
    path = folder(spark, "test-ids")
    bitpack.write(docs, path, queries.VOCABULARY, end_id=2, shards=3, segment_ids=5)
    rows = sorted(bitpack.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 9]
    text = {None: "x y", 1: "It's here.", 2: "", 3: "", 9: "word " * 30000}
    start = 0
    for r in rows:
        ids = np.append(tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2).astype("<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)


def test_empty_tables(spark):
    none = frame(spark).where("doc_id > 100")
    path = folder(spark, "test-none")
    bitpack.write(none, path, queries.VOCABULARY, end_id=2)
    assert bitpack.read(spark, path).count() == 0
    assert packing.pack(none, queries.VOCABULARY, end_id=1).count() == 0
    assert bpe.encode(none, queries.RANKS).count() == 0


def test_leftovers_keep_their_ids(spark):
    big = [(2**60 + 1, "a b"), (2**60 + 3, "c"), (None, "d e f"), (2**60 + 5, None)]
    docs = spark.createDataFrame(big, "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, queries.VOCABULARY, 1).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in big)
    assert len({r.sequence_id for r in rows}) == 1
    names = packing.pack(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"), queries.VOCABULARY, 1)
    assert sorted(map(str, (r.doc_id for r in names.collect()))) == sorted(str(i) for i, _ in big)


def check_packing(rows, wanted, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == wanted.keys()
    for doc, pieces in by_doc.items():
        got = sorted((p.start, p.length, bytes(p.ids)) for p in pieces)
        assert all(p.doc_tokens == len(wanted[doc]) for p in pieces)
        at = 0
        for start, length, ids in got:
            assert start == at and ids == wanted[doc][at : at + length].tobytes() and length > 0
            at += length
        assert at == len(wanted[doc])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(map(len, wanted.values())), len(by_sequence)


@pytest.mark.parametrize(("window", "open_windows", "group"), [(64, 4, 2), (2048, 64, 64), (16, 1, 1)])
def test_every_id_is_in_one_piece(spark, tokenizer, testdata, window, open_windows, group):
    docs = spark.read.parquet(f"{testdata}/documents.parquet").where("doc_id < 300").repartition(5)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b c"), (-3, "x" * 90000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    wanted = {
        r.doc_id: np.append(tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1).astype("<u4")
        for r in docs.collect()
    }
    pieces = packing.pack(
        docs, queries.VOCABULARY, 1, window=window, open_windows=open_windows, group=group
    ).collect()
    tokens, sequences = check_packing(pieces, wanted, window)
    if window == 2048:
        assert tokens / (sequences * window) > 0.98


def test_repeated_rows_are_packed_again(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")
    rows = packing.pack(docs, queries.VOCABULARY, 1).collect()
    assert sum(r.length for r in rows) == 5 * rows[0].doc_tokens


def test_registered_queries(spark, testdata, tokenizer, tiktokens):
    made = queries.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{testdata}/documents.parquet").collect()}
    start, wanted = 0, {}
    for doc in sorted(docs):
        ids = np.append(tokenizer.encode(docs[doc], add_special_tokens=False).ids, 2).astype("<u4")
        wanted[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = made["op5_binary_ids"](spark, testdata).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == wanted and len(rows) == len(docs)
    rows = made["op10_byte_bpe"](spark, testdata).collect()
    import hashlib

    for r in rows:
        ids = tiktokens.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    rows = made["op3_packing"](spark, testdata).collect()
    assert sum(r.length for r in rows) == start


def test_rows_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        shared.ship(spark)
        texts = spark.range(9000).coalesce(1).selectExpr("repeat('x', 2000) AS x")
        rows = texts.mapInArrow(sizes, "n long, b long").collect()
        assert sum(r.n for r in rows) == 9000 and max(r.b for r in rows) < 1.2 * shared.BATCH
        spark.conf.set(name, "1000000")
        shared.ship(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.set(name, before)
