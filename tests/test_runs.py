"""Statistics, models, candidate generation and ranking."""

import random
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from siftrank import BASELINES, baseline_run, bm25, experiment, lambda_sweep, simple_run, term_statistics
from siftrank.plans import jobs
from siftrank.operators.hits import document_hits, term_frequencies
from siftrank.operators.models import interpolated_lm, unsmoothed_lm
from siftrank.operators.scoring import best, floors, not_below, score_documents
from siftrank.operators.statistics import collection_stats
from siftrank.operators.topics import last_wins, topic_slices
from siftrank.session import intermediate_tables, salts_for, shared_folder, written
from siftrank.sources.text import parse_topics, parse_weighted_topics, topics_from_text

DOCS = [("d1", "a b a"), ("d2", "b c"), ("d3", ""), ("d4", "a"), ("d4", "a")]
TOPICS = "1:a b\n2:a a\n3:a zz\n4:zz\n5:---"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


def topics(spark, text):
    return last_wins(parse_topics(topics_from_text(spark, text)))


def rows(run, *columns):
    return sorted(tuple(r) for r in run.select(*columns).collect())


class Settings(dict):
    @property
    def conf(self):
        return self


def test_intermediate_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert written(spark.range(3), "some").inputFiles()[0].startswith(f"file://{folder}/some-")
    unset = Settings({"spark.sql.warehouse.dir": "hdfs://host/house/"})
    assert shared_folder(unset) == "hdfs://host/house/_intermediate"
    with intermediate_tables(spark):
        table = written(spark.range(3), "short_lived")
        path = Path(table.inputFiles()[0].removeprefix("file://"))
        assert path.exists()
    assert not path.parent.exists()
    assert salts_for(Settings({"spark.sql.shuffle.partitions": "8000"})) == 512


def test_hits(spark, docs):
    hits = document_hits(docs, ["a", "b", "zz"])
    found = sorted((r.doc_id, r.dl, r.tf) for r in hits.collect())
    assert found == [
        ("d1", 3, {"a": 2, "b": 1}),
        ("d2", 2, {"b": 1}),
        ("d3", 0, {}),
        ("d4", 1, {"a": 1}),
        ("d4", 1, {"a": 1}),
    ]
    assert term_frequencies(hits).count() == 5
    assert collection_stats(hits).first()[:2] == (5, 7)


def test_missing_text_is_an_empty_document(spark):
    docs = spark.createDataFrame([("x", None), ("y", "a")], "doc_id string, text string")
    assert rows(document_hits(docs, ["a"]), "doc_id", "dl") == [("x", 0), ("y", 1)]


def test_statistics(spark, docs):
    weighted = term_statistics(docs, topics(spark, TOPICS))
    found = {r.qid: [tuple(t) for t in r.terms] for r in weighted.collect()}
    assert found == {
        "1": [("a", 1, 3, 4), ("b", 1, 2, 2)],
        "2": [("a", 1, 3, 4), ("a", 1, 3, 4)],
        "3": [("a", 1, 3, 4), ("zz", 1, 0, 0)],
        "4": [("zz", 1, 0, 0)],
        "5": [],
    }
    assert {(r.n_docs, r.coll_len) for r in weighted.collect()} == {(5, 7)}


def test_statistics_of_an_empty_collection(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    weighted = term_statistics(none, topics(spark, "1:a"))
    assert [(r.n_docs, r.coll_len) for r in weighted.collect()] == [(0, 0)]
    assert baseline_run(none, weighted).count() == 0


def test_unsmoothed_run(spark, docs):
    run = rows(simple_run(docs, topics(spark, TOPICS)), "qid", "doc_id", "score")
    expected = [
        ("1", "d1", 2 / 3),
        ("2", "d1", 4 / 3),
        ("2", "d4", 1.0),
        ("2", "d4", 1.0),
        ("5", "d1", 3.0),
        ("5", "d2", 2.0),
        ("5", "d4", 1.0),
        ("5", "d4", 1.0),
    ]
    assert [r[:2] for r in run] == [r[:2] for r in expected]
    assert [r[2] for r in run] == pytest.approx([r[2] for r in expected])


def test_unknown_terms_are_dropped_by_the_baselines(spark, docs):
    run = experiment(docs, topics(spark, TOPICS), [unsmoothed_lm()])
    assert rows(run, "qid", "doc_id", "score") == [
        ("1", "d1", pytest.approx(2 / 3)),
        ("2", "d1", pytest.approx(4 / 3)),
        ("2", "d4", 1.0),
        ("2", "d4", 1.0),
        ("3", "d1", 2.0),
        ("3", "d4", 1.0),
        ("3", "d4", 1.0),
    ]


def test_frequent_terms_weigh_negative_in_bm25(spark, docs):
    run = experiment(docs, topics(spark, "2:a"), [bm25()]).collect()
    assert len(run) == 3 and all(r.score < 0 for r in run)


def test_sweep_is_by_repeated_addition():
    assert [m.name for m in lambda_sweep()] == ["LMs0.1", "LMs0.3", "LMs0.5", "LMs0.7", "LMs0.9"]
    assert [m.name for m in BASELINES] == ["LMno", *[m.name for m in lambda_sweep()], "LMdi", "BM25"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_models_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    docs = [
        (f"d{rng.randrange(30)}", " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 40]))))
        for _ in range(60)
    ]
    asked = {
        f"q{i}": rng.choices([*words, "unseen"], k=rng.choice([1, 2, 3, 6])) for i in range(10)
    }
    n, length, df, cf = brute.statistics(docs, [*words, "unseen"])
    frame = spark.createDataFrame(docs, "doc_id string, text string").repartition(5)
    lines = "\n".join(f"{q}:{' '.join(terms)}" for q, terms in asked.items())
    weighted = {
        q: [(t, 1, df[t], cf[t]) for t in terms if cf[t]] for q, terms in asked.items()
    }
    weighted = {q: terms for q, terms in weighted.items() if terms}
    run = experiment(frame, topics(spark, lines)).collect()
    for model in BASELINES:
        found = {}
        for r in run:
            if r.model == model.name:
                found.setdefault(r.qid, []).append((r.doc_id, r.score))
        expected = brute.run(model.name, weighted, docs, n, length)
        assert found.keys() == expected.keys()
        for qid, pairs in expected.items():
            got = sorted(found[qid])
            assert [d for d, _ in got] == [d for d, _ in pairs]
            assert [s for _, s in got] == pytest.approx([s for _, s in pairs])


def test_query_weights(spark):
    """Weights above 1 and of 0, from a file that another program wrote."""
    docs = [("d1", "a b a c"), ("d2", "a"), ("d3", "b b c c"), ("d4", "x y z")]
    text = "#ANY-COMMENT: x\n#ANY-LENGTH:40\n#ANY-NDOCS:9\n1:a=3=2=3 b=1=2=3\n2:b=0=2=3 c=2=2=3"
    weighted = parse_weighted_topics(topics_from_text(spark, text))
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    run = baseline_run(frame, weighted).collect()
    asked = {"1": [("a", 3, 2, 3), ("b", 1, 2, 3)], "2": [("b", 0, 2, 3), ("c", 2, 2, 3)]}
    for model in BASELINES:
        expected = brute.run(model.name, asked, docs, 9, 40)
        for qid, pairs in expected.items():
            got = sorted((r.doc_id, r.score) for r in run if (r.qid, r.model) == (qid, model.name))
            assert [d for d, _ in got] == [d for d, _ in pairs], model.name
            assert [s for _, s in got] == pytest.approx([s for _, s in pairs])


def test_scores_that_are_no_number_are_left_out(spark, docs):
    text = "#ANY-LENGTH:7\n#ANY-NDOCS:2\n1:a=1=9=4"
    weighted = parse_weighted_topics(topics_from_text(spark, text))
    assert baseline_run(docs, weighted, [bm25()]).count() == 0
    assert baseline_run(docs, weighted, [interpolated_lm(0.5)]).count() == 3


def test_underflow_drops_documents(spark):
    docs = spark.createDataFrame([("d1", "a " + "b " * 999)], "doc_id string, text string")
    long_query = "1:" + "a " * 120
    assert simple_run(docs, topics(spark, long_query)).count() == 0
    assert simple_run(docs, topics(spark, "1:" + "a " * 90)).count() == 1


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(0, 4000, 1, 7).select(
        F.concat(F.lit("q"), (F.col("id") % 3).cast("string")).alias("qid"),
        F.lit("M").alias("model"),
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"),
        (F.pmod(F.xxhash64("id"), F.lit(97)) + 1.0).alias("score"),
    )


def test_ties_are_ordered_by_document(spark, scored):
    top = best(scored, 40).orderBy("qid", "rank").collect()
    everything = scored.collect()
    for qid in ("q0", "q1", "q2"):
        expected = sorted(
            ((-r.score, r.doc_id) for r in everything if r.qid == qid)
        )[:40]
        assert [(-r.score, r.doc_id) for r in top if r.qid == qid] == expected
        assert [r["rank"] for r in top if r.qid == qid] == list(range(1, 41))


@pytest.mark.parametrize("k", [1, 7, 50, 400])
def test_floors_leave_the_run_as_it_is(scored, k):
    columns = ("qid", "doc_id", "score", "rank")
    expected = rows(best(scored, k), *columns)
    for fraction in (0.0, 0.1, 0.7):
        floor = floors(scored.sample(fraction, seed=3), k)
        assert rows(best(not_below(scored, floor), k), *columns) == expected


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(0, 3000, 1, 5).selectExpr(
        "concat('d', id) AS doc_id",
        "array_join(transform(sequence(0, id % 37), i -> concat('w', (i * id + id) % 11)), ' ') AS text",
    )


@pytest.mark.parametrize("k", [1, 10, 2999])
def test_runs_are_the_same_with_and_without_floors(spark, many, k):
    asked = topics(spark, "1:w1 w2\n2:w3\n3:w4 w5 w6\n4:w10 unseen")
    columns = ("qid", "model", "rank", "doc_id", "score")
    sampled = experiment(many, asked, k=k)
    assert k > 10 or "floor" in sampled._jdf.queryExecution().optimizedPlan().toString()
    part = topic_slices(term_statistics(many, asked))[0]
    kept = part.topics.select("qid", F.filter("terms", lambda t: t["cf"] > 0).alias("terms"), "n_docs", "coll_len")
    scored = score_documents(document_hits(many, part.vocabulary), kept, BASELINES, part.longest)
    assert rows(sampled, *columns) == rows(best(scored, k), *columns)
    two_jobs = baseline_run(many, term_statistics(many, asked), k=k)
    assert rows(two_jobs, *columns) == rows(sampled, *columns)


def test_long_topics_leave_others_as_they_are(spark, many):
    short = "1:w1 w2\n2:w3 w4 w5 w6 w7"
    columns = ("qid", "doc_id", "score", "rank")
    alone = rows(simple_run(many, topics(spark, short)), *columns)
    asked = short + "\n3:" + " ".join(["w0 w1 w2 w3 w4 w5"] * 10)
    both = simple_run(many, topics(spark, asked))
    assert rows(both.where("qid <> '3'"), *columns) == alone
    texts = {r.doc_id: r.text for r in many.collect()}
    for r in both.where("qid = '3'").collect():
        found, product = brute.tokens(texts[r.doc_id]), 1.0
        for term in ["w0", "w1", "w2", "w3", "w4", "w5"] * 10:
            product *= found.count(term) / len(found)
        assert r.score == product * len(found)


@pytest.mark.parametrize(("salts", "parts"), [(2, 3), (5, 1), (16, 9)])
def test_salting_and_partitioning_do_not_change_the_run(scored, salts, parts):
    columns = ("qid", "doc_id", "score", "rank")
    expected = rows(best(scored, 100), *columns)
    assert rows(best(scored.repartition(parts), 100, salts), *columns) == expected


def test_rank_is_pushed_below_the_shuffle(scored):
    plan = best(scored, 1000, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and "WindowGroupLimit" in plan
    longer = best(scored, 2000, 4)._jdf.queryExecution().executedPlan().toString()
    assert longer.count("Partial") >= 2 and "WindowGroupLimit" in longer
    assert rows(best(scored, None), "rank")[-1] == (1334,)


def test_large_topic_sets_run_in_slices(spark, docs):
    asked = topics(spark, TOPICS + "\n6:c b\n7:c\n8:a")
    slices = topic_slices(asked, max_positions=3)
    assert len(slices) > 1
    assert sorted(r.qid for s in slices for r in s.topics.collect()) == list("12345678")
    whole = rows(simple_run(docs, asked), "qid", "doc_id", "score", "rank")
    parts = []
    for piece in slices:
        parts += rows(simple_run(docs, piece.topics), "qid", "doc_id", "score", "rank")
    assert sorted(parts) == whole
    with pytest.raises(ValueError, match="a topic has 2 terms"):
        topic_slices(asked, max_positions=1)


def test_text_is_read_once_however_many_slices(spark, docs, tmp_path, monkeypatch):
    asked = topics(spark, TOPICS + "\n6:c b\n7:c\n8:a")
    columns = ("qid", "doc_id", "score", "rank")
    weights = ("qid", "n_docs", "coll_len", "terms")
    whole = rows(simple_run(docs, asked), *columns), rows(term_statistics(docs, asked), *weights)
    whole += (rows(experiment(docs, asked), "model", *columns),)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    counted = docs.select("doc_id", seen("text").alias("text"))
    monkeypatch.setattr(jobs, "MAX_POSITIONS", 2)
    monkeypatch.setattr(jobs, "topic_slices", lambda t: topic_slices(t, 3))
    parts = rows(simple_run(counted, asked), *columns), rows(term_statistics(counted, asked), *weights)
    parts += (rows(experiment(counted, asked), "model", *columns),)
    assert parts == whole
    assert read.value == 3 * len(DOCS)


def test_only_hits_are_shuffled(spark, docs):
    weighted = topic_slices(term_statistics(docs, topics(spark, TOPICS)))[0].topics
    hits = document_hits(docs, ["a", "b"])
    plan = score_documents(hits, weighted, BASELINES, 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_conjunctive_models_do_not_aggregate_what_they_drop(spark, many):
    """Frequent words are in nearly all documents, the rare one is in few."""
    docs = many.selectExpr("doc_id", "if(doc_id LIKE 'd100%', concat(text, ' rare'), text) AS text")
    words = [f"w{n}" for n in range(11)]
    asked = topics(spark, "1:" + " ".join(words * 4 + ["rare"]) + "\n2:rare")
    weighted = topic_slices(term_statistics(docs, asked))[0].topics
    hits = written(document_hits(docs, [*words, "rare"]), "hits")
    holders = sorted(r.doc_id for r in docs.where("text LIKE '%rare'").collect())
    assert 0 < len(holders) < 20
    for models in ([unsmoothed_lm()], BASELINES):
        scored = score_documents(hits, weighted, models, 45).where("model = 'LMno'")
        assert sorted(r.doc_id for r in scored.where("qid = '2'").collect()) == holders
    plan = score_documents(hits, weighted, [unsmoothed_lm()], 45)
    plan.collect()
    nodes, groups = [plan._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            if node.nodeName() == "ObjectHashAggregate" and "doc_id" in node.toString().split("\n")[0]:
                groups.append(node.metrics().apply("numOutputRows").value())
            nodes += [node.children().apply(n) for n in range(node.children().size())]
    assert groups and max(groups) <= 2 * len(holders)


def test_topics_that_share_an_id_count_as_one(spark):
    """Retrieved is what matches as many positions as the longest of those that match has."""
    rng = random.Random(4)
    words = [f"w{n}" for n in range(7)]
    docs = [(f"d{n}", " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 8])))) for n in range(80)]
    qids = [None, None, "1", "1", "2", "3", "3", "3"]
    asked = [(q, rng.choices([*words, "unseen"], k=rng.choice([1, 2, 3, 4]))) for q in qids]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    topic_frame = spark.createDataFrame(asked, "qid string, terms array<string>")
    hits = document_hits(frame, words)
    weighted = topic_frame.selectExpr(
        "qid",
        "transform(terms, t -> named_struct('term', t, 'qtf', 1, 'df', crc32(t) % 9, 'cf', 1)) AS terms",
        "80 AS n_docs",
        "500 AS coll_len",
    )
    expected = []
    for qid in {q for q, _ in asked}:
        positions = [(n, t, len(terms)) for q, terms in asked if q == qid for n, t in enumerate(terms)]
        for doc_id, text in docs:
            found = brute.tokens(text)
            met = [p for p in positions if p[1] in found]
            if met and len(met) == max(p[2] for p in met):
                product = 1.0
                for n in sorted({p[0] for p in met}):
                    product *= max(found.count(t) / len(found) for at, t, _ in met if at == n)
                expected.append((str(qid), doc_id, product * len(found)))
    scored = score_documents(hits, weighted, [unsmoothed_lm()], 4).collect()
    assert sorted((str(r.qid), r.doc_id, r.score) for r in scored) == sorted(expected)
    assert len(expected) > 20
