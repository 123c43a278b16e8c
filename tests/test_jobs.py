"""The command line, from an archive to run lines, in both input formats."""

import pytest

from siftrank.__main__ import main


def record(doc_id, url, page):
    body = f"HTTP/1.1 200 OK\n\n{page}"
    return (
        "WARC/1.0\nWARC-Type: response\n"
        f"WARC-TREC-ID: {doc_id}\nWARC-Target-URI: {url}\nContent-Length: {len(body)}\n\n{body}\n\n"
    )


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    (root / "web").mkdir()
    (root / "web" / "a.warc").write_text(
        record("D1", "http://x.nl/", "<p>horse horse <a href=/two>green hooves</a> text")
        + record("D2", "http://x.nl/two", "<p>hooves <a href='http://x.nl'>a horse</a> and more")
    )
    (root / "web" / "b.warc").write_text(
        record("D3", "http://y.nl/", "<p>nothing <a href='http://x.nl/index.html'>home horse</a>")
        + "".join(record(f"E{i}", f"http://z.nl/{i}", "<p>other words") for i in range(4))
    )
    (root / "topics").write_text("wt09-2:horse hooves\nwt09-10:horse\n")
    main(["anchors", f"{root}/web", f"{root}/anchors"])
    return root


def lines(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


def test_anchor_text(spark, place):
    found = sorted(r.value for r in spark.read.text(f"{place}/anchors").collect())
    assert found == ["D1\thttp://x.nl\ta horse\thome horse", "D2\thttp://x.nl/two\tgreen hooves"]


@pytest.mark.parametrize(
    ("source", "kind", "first", "n_docs"),
    [("web", "WARC", "D1", 7), ("anchors", "KEYVAL", "D1", 2)],
)
def test_runs(spark, place, source, kind, first, n_docs):
    docs = f"{place}/{source}"
    out = {job: f"{place}/{kind}-{job}" for job in ("run", "stats", "baselines", "by", "trec", "one")}
    main(["run", "--format", kind, docs, out["run"], f"{place}/topics"])
    rows = [line.split("\t") for line in lines(place / f"{kind}-run")]
    assert first in {doc for qid, doc, _ in rows if qid == "wt09-10"}
    assert all(float(score) > 0 for _, _, score in rows)

    main(["stats", "--format", kind.lower(), docs, f"{place}/topics", out["stats"], "--program", "ANY"])
    stats = lines(place / f"{kind}-stats")
    assert stats[1] == f"#ANY-COLLECTION:{docs}"
    assert stats[3] == f"#ANY-NDOCS:{n_docs}"
    assert [line.split(":")[0] for line in stats[4:]] == ["wt09-2", "wt09-10"]

    main(["baselines", "--format", kind, docs, out["baselines"], out["stats"], "-k", "5"])
    main(["baselines", "--format", kind, docs, out["by"], out["stats"], "--by-model"])
    assert (place / f"{kind}-by" / "model=LMs0.5").is_dir()

    main(["trec", out["baselines"], out["trec"], "--model", "LMs0.5", "--tag", "mine"])
    fields = [line.split("\t") for line in lines(place / f"{kind}-trec")]
    assert [f[0] for f in fields] == sorted((f[0] for f in fields), key=int)
    assert {f[1] for f in fields} == {"Q0"} and {f[5] for f in fields} == {"mine"}
    assert [f[3] for f in fields if f[0] == "2"] == [str(i + 1) for i in range(len([f for f in fields if f[0] == "2"]))]

    main(["experiment", "--format", kind, docs, f"{place}/{kind}-whole", f"{place}/topics", "-k", "5"])
    assert sorted(lines(place / f"{kind}-whole")) == sorted(lines(place / f"{kind}-baselines"))

    with pytest.raises(Exception, match="several models"):
        main(["trec", out["baselines"], out["one"]])
    with pytest.raises(Exception, match="(?i)exists"):
        main(["run", "--format", kind, docs, out["run"], f"{place}/topics"])


def test_every_line_of_a_run_is_formatted(spark, place):
    run = "\n".join(f"9\tdoc{k:05d}\t{(k * 7) % 400 + 0.5}" for k in range(1500))
    (place / "long").write_text(run)
    main(["trec", f"{place}/long", f"{place}/long-trec", "--tag", "t"])
    fields = [line.split("\t") for line in lines(place / "long-trec")]
    assert [int(f[3]) for f in fields] == list(range(1, 1501))
    assert [(-float(f[4]), f[2]) for f in fields] == sorted((-float(f[4]), f[2]) for f in fields)
    main(["trec", f"{place}/long", f"{place}/cut-trec", "--tag", "t", "-k", "10"])
    assert lines(place / "cut-trec") == lines(place / "long-trec")[:10]


def test_tables_are_owned(spark):
    """Folders and catalogue entries of a call go with it."""
    from pathlib import Path

    from siftrank.session import intermediate_tables, new_folder, new_table, shared_folder, written

    with intermediate_tables(spark):
        table, folder = new_table("owned"), new_folder(spark, "owned")
        spark.range(3).write.option("path", folder).saveAsTable(table)
        other = written(spark.range(5), "other")
        assert spark.table(table).count() == 3 and other.count() == 5
        assert spark.catalog.tableExists(table)
    with intermediate_tables(spark):
        with intermediate_tables(spark):
            gone, kept = written(spark.range(2), "inner"), written(spark.range(4), "outer", outlives=True)
            assert gone.count() == 2
        assert kept.count() == 4
        assert not list(Path(shared_folder(spark).removeprefix("file:")).glob("inner*"))
    assert not list(Path(shared_folder(spark).removeprefix("file:")).glob("outer*"))
    assert not spark.catalog.tableExists(table)
    assert not list(Path(shared_folder(spark).removeprefix("file:")).glob("o*er*"))


def test_no_folder_of_one_machine_on_a_cluster():
    import pytest

    from siftrank.session import shared_folder

    class Session:
        def __init__(self, master, warehouse, folder=None):
            self.conf = {"spark.sql.warehouse.dir": warehouse} | ({"spark.checkpoint.dir": folder} if folder else {})
            self.sparkContext = type("Context", (), {"master": master})

    assert shared_folder(Session("local[4]", "file:/w")) == "file:/w/_intermediate"
    assert shared_folder(Session("yarn", "hdfs://w/")) == "hdfs://w/_intermediate"
    assert shared_folder(Session("yarn", "file:/w", "s3://f")) == "s3://f"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session("spark://h:7077", "file:/w"))
