"""Exchange formats: key-value text, topics, statistics, runs."""

import gzip

import pytest
from pyspark.sql import functions as F

from siftrank import (
    baseline_run,
    bm25,
    dirichlet_lm,
    experiment,
    read_anchors,
    read_documents,
    read_keyval,
    read_run,
    read_topics,
    read_weighted_topics,
    term_statistics,
)
from siftrank.sinks.text import (
    trec_run,
    write_anchors,
    write_run,
    write_run_by_model,
    write_stats_file,
    write_trec_run,
)
from siftrank.sources.text import parse_topics, read_topic_lines, topics_from_text

DOCS = [("d1", "a b a"), ("d2", "b c"), ("d3", ""), ("d4", "a")]


def lines_of(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


def write(path, text):
    path.write_text(text)
    return str(path)


def test_keyval_keeps_later_tabs(spark, tmp_path):
    path = write(tmp_path / "a.txt", "d1\thttp://a\tone\ttwo\nd2\nd3\t\n")
    assert sorted(tuple(r) for r in read_keyval(spark, path).collect()) == [
        ("d1", "http://a\tone\ttwo"),
        ("d2", ""),
        ("d3", ""),
    ]


def test_keyval_reads_gzip_and_globs(spark, tmp_path):
    for name in ("x1", "x2"):
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(f"{name}\ttext\n")
    found = read_documents(spark, str(tmp_path / "x*"), "keyval")
    assert sorted(r.doc_id for r in found.collect()) == ["x1", "x2"]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="WARC or KEYVAL"):
        read_documents(spark, "nowhere", "csv")


def test_anchors_roundtrip(spark, tmp_path):
    anchors = spark.createDataFrame(
        [("d1", "http://a", ["one", " ", "three"]), ("d2", "http://b", ["x"])],
        "doc_id string, url string, anchors array<string>",
    )
    folder = str(tmp_path / "out")
    write_anchors(anchors, folder)
    assert all(p.suffix == ".gz" for p in (tmp_path / "out").glob("part-*"))
    assert sorted(map(tuple, read_anchors(spark, folder).collect())) == sorted(map(tuple, anchors.collect()))
    text = {r.doc_id: r.text for r in read_keyval(spark, folder).collect()}
    assert text == {"d1": "http://a\tone\t \tthree", "d2": "http://b\tx"}
    with pytest.raises(Exception, match="(?i)exists"):
        write_anchors(anchors, folder)


def test_topics(spark, tmp_path):
    path = write(tmp_path / "t", "51:a:b\nWT1:X y\n7:old\n7: New \n8:---\n")
    found = {r.qid: r.terms for r in read_topics(spark, path).collect()}
    assert found == {"51": ["a"], "wt1": ["x", "y"], "7": ["", "new"], "8": []}
    assert read_topic_lines(spark, path).count() == 5


@pytest.mark.parametrize("line", ["51:", "no colon", "", ":", "5:::"])
def test_malformed_topics(spark, line):
    with pytest.raises(Exception, match="topic line without a query"):
        parse_topics(topics_from_text(spark, f"1:a\n{line}\n2:b")).collect()


def test_runs_refuse_topics_with_statistics(spark, tmp_path):
    path = write(tmp_path / "t", "#ANY-LENGTH:7\n1:a=1=2=3\n")
    with pytest.raises(Exception, match="carries statistics already"):
        read_topics(spark, path).collect()
    # the statistics job takes the numbers for terms
    path = write(tmp_path / "u", "1:a=1=2=3\n")
    assert read_topic_lines(spark, path).first().terms == ["a", "1", "2", "3"]


def test_stats_file(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    topics = read_topic_lines(spark, write(tmp_path / "t", "2:b a b\n1:a zz\n2: c\n9:---"))
    folder = tmp_path / "stats"
    write_stats_file(term_statistics(docs, topics), str(folder), "some/docs", "ANY")
    assert lines_of(folder) == [
        "#ANY-COMMENT: query term weight, document frequency, collection frequency (for each term)",
        "#ANY-COLLECTION:some/docs",
        "#ANY-LENGTH:6",
        "#ANY-NDOCS:4",
        "2:b=1=2=2 a=1=2=3 b=1=2=2",
        "1:a=1=2=3 zz=1=0=0",
        "2:=1=0=0 c=1=1=1",
        "9:",
    ]
    weighted = read_weighted_topics(spark, str(folder)).collect()
    assert {r.qid: [tuple(t) for t in r.terms] for r in weighted} == {
        "1": [("a", 1, 2, 3)],
        "2": [("c", 1, 1, 1)],
        "9": [],
    }
    assert {(r.n_docs, r.coll_len) for r in weighted} == {(4, 6)}
    assert isinstance(read_weighted_topics(spark, str(folder)).first().terms[0].qtf, int)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("1:a=1=2=3", "no collection statistics"),
        ("#ANY-LENGTH:0\n#ANY-NDOCS:4\n1:a=1=2=3", "no collection statistics"),
        ("#ANY-LENGTH:5\n#ANY-NDOCS:4\n1:a=1=2", "error in query format"),
        ("#ANY-LENGTH:5\n#ANY-NDOCS:4\n1:a=1=2=3=4", "error in query format"),
        ("#ANY-LENGTH:5\n#ANY-NDOCS:4\n1:a=-1=2=3", "error in query format"),
    ],
)
def test_malformed_stats_files(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        read_weighted_topics(spark, write(tmp_path / "t", text)).collect()


@pytest.fixture(scope="module")
def run(spark):
    docs = spark.createDataFrame([*DOCS, ("d5", "x"), ("d6", "y z")], "doc_id string, text string")
    lines = parse_topics(topics_from_text(spark, "wt09-12:a b\nwt09-3:b c")).drop("seq")
    return experiment(docs, lines, [dirichlet_lm(), bm25()]).cache()


def test_run_files(spark, tmp_path, run):
    write_run(run, str(tmp_path / "run"))
    back = read_run(spark, str(tmp_path / "run"))
    key = ("qid", "model", "doc_id", "score")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, run.select(*key).collect()))
    write_run_by_model(run, str(tmp_path / "by"))
    only = read_run(spark, str(tmp_path / "by" / "model=BM25"))
    assert {r.model for r in only.collect()} == {"BM25"}
    write_run(run.filter("model = 'LMdi'"), str(tmp_path / "plain"), tagged=False)
    assert {r.model for r in read_run(spark, str(tmp_path / "plain"), "mine").collect()} == {"mine"}


def test_a_reader_of_one_model_opens_no_other_folder(spark, tmp_path, run):
    folder = str(tmp_path / "by")
    write_run_by_model(run, folder)
    found = read_run(spark, folder, model="BM25")
    expected = run.filter("model = 'BM25'").select("qid", "model", "doc_id", "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(model" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert all("model=BM25" in r[0] for r in found.select(F.input_file_name()).distinct().collect())
    write_run(run, str(tmp_path / "one"))
    assert read_run(spark, str(tmp_path / "one"), model="LMdi").count() == run.filter("model = 'LMdi'").count()
    assert read_run(spark, str(tmp_path / "one"), model="none").count() == 0


def test_trec_run_lines(spark, tmp_path, run):
    found = [r.value.split("\t") for r in trec_run(run, model="BM25").collect()]
    assert [(f[0], f[1], f[3], f[5]) for f in found] == [
        ("3", "Q0", "1", "BM25"),
        ("3", "Q0", "2", "BM25"),
        ("12", "Q0", "1", "BM25"),
        ("12", "Q0", "2", "BM25"),
        ("12", "Q0", "3", "BM25"),
    ]
    assert [f[2] for f in found] == ["d2", "d1", "d1", "d4", "d2"]
    folder = tmp_path / "trec"
    write_trec_run(run, str(folder), model="BM25", tag="mine", strip_prefix="")
    assert lines_of(folder)[0].startswith("wt09-12\tQ0\t")
    assert lines_of(folder)[0].endswith("\tmine")


def test_trec_run_takes_one_model(run):
    with pytest.raises(Exception, match="several models"):
        trec_run(run).collect()
    only = run.filter("model = 'BM25'")
    assert trec_run(only).count() == only.count()


def test_weighted_run_equals_experiment(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    path = write(tmp_path / "t", "1:a b\n2:c zz\n")
    folder = str(tmp_path / "stats")
    write_stats_file(term_statistics(docs, read_topic_lines(spark, path)), folder, "x")
    two_step = baseline_run(docs, read_weighted_topics(spark, folder))
    one_step = experiment(docs, read_topics(spark, path))
    order = ["qid", "model", "rank"]
    assert two_step.orderBy(*order).collect() == one_step.orderBy(*order).collect()
    assert one_step.filter(F.col("rank") == 1).count() > 0
