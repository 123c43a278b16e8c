"""Vocabularies that are tables."""

import random

from siftrank import experiment, simple_run
from siftrank.operators import hits as hits_module
from siftrank.operators.hits import document_hits, document_hits_among
from siftrank.operators.topics import last_wins
from siftrank.plans import jobs
from siftrank.sources.text import parse_topics, topics_from_text


def counted(hits):
    return sorted((str(r.doc_id), r.dl, sorted(r.tf.items())) for r in hits.collect())


def corpus(spark, seed, n=80):
    rng = random.Random(seed)
    rows = [(f"d{i % 70}", " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(50)))) for i in range(n)]
    rows += [(None, "w1 w2 w1"), ("none", None), ("empty", ""), ("other", "x y z")]
    return spark.createDataFrame(rows, "doc_id string, text string").repartition(3)


def test_joined_words_are_those_named_in_a_plan(spark, monkeypatch):
    docs = corpus(spark, 1)
    names = [f"w{k}" for k in range(0, 90, 4)] + ["unseen"]
    words = spark.createDataFrame([(w,) for w in [*names, *names[:5], None]], "term string")
    expected = counted(document_hits(docs, names))
    assert counted(document_hits_among(docs, words)) == expected
    monkeypatch.setattr(hits_module, "BROADCAST_WORDS", 3)
    assert counted(document_hits_among(docs, words)) == expected
    none = document_hits_among(docs, words.where("false"))
    assert counted(none) == counted(document_hits(docs, []))


def test_many_words_leave_no_other_in_the_stored_hits(spark, monkeypatch):
    """Thirty thousand topic words, of which the documents have a few."""
    lines = [f"{q}:" + " ".join(f"v{q * 1000 + k}" for k in range(1000)) for q in range(30)]
    lines += ["40:w1 w2 w3", "41:w7 unseen w7"]
    topics = last_wins(parse_topics(topics_from_text(spark, "\n".join(lines))))
    docs = corpus(spark, 2)
    stored = []

    def kept(df, name):
        stored.append(written(df, name))
        return stored[-1]

    written = jobs.written
    monkeypatch.setattr(jobs, "written", kept)
    many = simple_run(docs, topics, k=20)
    rows = sorted(map(tuple, many.collect()))
    words = {word for r in stored[0].collect() for word in r.tf}
    assert words == {"w1", "w2", "w3", "w7"}
    assert "In(" not in stored[0]._jdf.queryExecution().analyzed().toString()
    few = last_wins(parse_topics(topics_from_text(spark, "\n".join(lines[-2:]))))
    assert sorted(map(tuple, simple_run(docs, few, k=20).collect())) == rows
    scored = experiment(docs, topics, k=5).select("qid", "model", "doc_id", "rank").collect()
    alone = experiment(docs, few, k=5).select("qid", "model", "doc_id", "rank").collect()
    assert sorted(map(str, scored)) == sorted(map(str, alone))
