"""The stages of the corpus pipeline on a small corpus, against plain Python."""

import base64
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from test_similar import brute

import corpus_pipeline
from siftrank.llm.queries import QUERIES
from siftrank.llm.secrets import spans_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    items = [r.choices(words, k=30) for _ in range(3)]
    rows, toxic = [], []
    for k in range(160):
        own = r.choices(words, k=60)
        toxic.append((k, int(k % 4 == 0)))
        if k % 4 == 0:
            for _ in range(8):
                own.insert(r.randrange(50), "zonkest")
        elif k % 10 == 1:
            own[20:20] = items[k % 3]
        elif k % 10 == 3:
            own[5:5] = ["password=abcdef123456"]
        rows.append([k, " ".join(own), "en", "s", 0])
    for k in range(160, 190):
        rows.append([k, rows[k - 150][1] + (" more" if k % 2 else ""), "en", "s", 0])
    rows += [[200, None, None, None, None], [201, "", "en", "s", 0], [201, "", "en", "s", 0]]
    rows += [rows[2], [None, "a lone text without any id to speak of", "en", "s", 5]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(
        [(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"
    ).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append(sorted(docs.collect(), key=repr))
    clean, single, safe, masked = kept
    assert clean == sorted((r for r in before if "zonk" not in (r.text or "")), key=repr)
    # ids are distinct here but for rows that are equal
    ids = {}
    for i, n, component in brute([(r.doc_id, r.text) for r in clean], 5, 80):
        ids[i] = n == 0 or component == i
    want = [r for k, r in enumerate(clean) if ids[r.doc_id] and (not r.text or r not in clean[:k])]
    assert single == want
    assert safe == [r for r in single if r.doc_id is None or r.doc_id % 10 != 1 or r.doc_id >= 160]
    for old, new in zip(safe, sorted(masked, key=repr), strict=True):
        assert new.doc_id == old.doc_id and not spans_of(new.text)
        assert ("[SECRET]" in (new.text or "")) == ("password" in (old.text or ""))
        assert new.n_chars == (len(new.text) if new.text is not None else old.n_chars)
    assert any("[SECRET]" in (r.text or "") for r in masked)

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    found = corpus_pipeline.run(spark, folder).collect()
    expected = []
    for r in masked:
        codes = encoding.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(codes), struct.pack(f"<{len(codes)}I", *codes), r.text or ""))
    got = [(r.doc_id, r.n_tokens, bytes(r.token_ids), r.text) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "empty")
        assert docs.collect() == []


def test_columns_of_any_name_and_long_texts(spark, folder):
    """Columns named like those that stages make, no ``n_chars``, and a text of a megabyte."""
    rows = [(1, "a b c d e f", "r1", "c", 1), (1, "a b c d e f", "r1", "c", 1), (2, None, "r", None, 2)]
    rows += [(3, "long word " * 100_000 + "password=abcdef123456", "r", "c", 3), (4, "", None, "c", 4)]
    schema = "doc_id long, text string, row string, copy string, `_row` int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("row", "string"), ("copy", "string"), ("_row", "int")]
    found = {r.doc_id: r for r in docs.collect()}
    assert len(found) == docs.count() == 4
    assert tuple(found[1])[2:] == ("r1", "c", 1)
    assert found[3].text.endswith("word [SECRET]") and len(found[3].text) > 1_000_000
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id: r.text for r in ids.collect()}[3] == found[3].text


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
