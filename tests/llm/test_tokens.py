"""Token counts and encoding against the libraries of the vocabularies."""

import base64
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from samples import TEXTS
from tokenizers import Tokenizer

from siftrank.llm.bpe import PIECES, distinct_pieces
from siftrank.llm.byte_bpe import decoded_ids, encoded_documents
from siftrank.llm.token_counts import token_counts

PATTERN = public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIGNS = ["a", "The", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", chr(0x3000), chr(0x2009)]
SIGNS += [".", "'s", "'ll", "1", chr(0xB2), "<|endoftext|>", "中文", "😀", "\r\n", chr(0x200B), "\x0b", "ing"]


def mixed_texts(n):
    r = random.Random(7)
    return ["".join(r.choices(SIGNS, k=r.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_hold_whole_pre_tokens():
    texts, pattern = mixed_texts(3000), regex.compile(PATTERN)
    for first, pieces, which, rows in distinct_pieces(pa.array([*texts, None, ""])):
        for k in range(len(rows) - 1):
            text = ([*texts, None, ""][first + k]) or ""
            found = [pieces[i] for i in which[rows[k] : rows[k + 1]]]
            assert found == PIECES.findall(text)
            assert [w for p in found for w in pattern.findall(p)] == pattern.findall(text)


def test_counts(spark, tokenizer):
    texts = mixed_texts(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in token_counts(docs, JSON, PATTERN, limit=10).collect()}
    for k, text in enumerate(texts):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (found[k].n_tokens, found[k].n_bytes) == (n, len(text.encode())), repr(text)
        assert found[k].over_limit == (n > 10)


def test_counts_of_odd_rows(odd, nothing, tokenizer):
    found = sorted(map(tuple, token_counts(odd, JSON, PATTERN).collect()), key=repr)
    want = []
    for i, text in TEXTS:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 1024))
    assert found == sorted(want, key=repr)
    assert token_counts(nothing, JSON, PATTERN).collect() == []


@pytest.mark.parametrize("size", [3_000_000, 40])
def test_encoding_round_trip(spark, odd, encoding, size):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(100 + k, t) for k, t in enumerate(mixed_texts(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = encoded_documents(docs, RANKS, PATTERN, block_pieces=size).collect()
    want = []
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()))
    got = [(r.doc_id, r.n_tokens, bytes(r.token_ids), bytes(r.decoded)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_nothing_to_encode(nothing):
    assert encoded_documents(nothing, RANKS, PATTERN).collect() == []


def test_decoding_by_join(spark, encoding):
    tokens = spark.createDataFrame(
        [(k, encoding.decode_single_token_bytes(k)) for k in range(300)], "code int, bytes binary"
    )
    rows = spark.createDataFrame([(1, [72, 69, 299]), (2, []), (3, None)], "id long, codes array<int>")
    twice = rows.unionByName(rows)
    assert decoded_ids(twice, tokens).count() == twice.count()
    assert {(r.id, bytes(r.decoded)) for r in decoded_ids(twice, tokens).collect()} == {
        (r.id, bytes(r.decoded)) for r in decoded_ids(rows, tokens).collect()
    }
    found = {r.id: bytes(r.decoded) for r in decoded_ids(rows, tokens).collect()}
    assert found == {1: encoding.decode_bytes([72, 69, 299]), 2: b"", 3: b""}
    unknown = spark.createDataFrame([(1, [999])], "id long, codes array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        decoded_ids(unknown, tokens).collect()
