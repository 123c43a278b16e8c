"""Jobs for ``spark-submit`` or ``python -m siftrank``.

    anchors   WEB OUT                 anchor text of a web archive, gzip text
    run       DOCS OUT TOPICS         unsmoothed language model
    stats     DOCS TOPICS OUT         topic file with term statistics
    baselines DOCS OUT STATS          all baseline models, from such a file
    experiment DOCS OUT TOPICS        the two at once, reading the documents once
    trec      RUN OUT                 run lines of one model, sorted
"""

import argparse

from pyspark.sql import SparkSession

from siftrank.operators.anchors import anchor_parts
from siftrank.operators.scoring import best
from siftrank.plans.jobs import (
    TOP,
    baseline_run,
    experiment,
    simple_run,
    term_statistics,
)
from siftrank.session import intermediate_tables
from siftrank.sinks.anchors import write_anchor_parts
from siftrank.sinks.text import (
    write_run,
    write_run_by_model,
    write_stats_file,
    write_trec_run,
)
from siftrank.sources.text import (
    read_documents,
    read_run,
    read_topic_lines,
    read_topics,
    read_weighted_topics,
)
from siftrank.sources.warc import read_warc, warc_pages


def anchors(spark: SparkSession, args: argparse.Namespace) -> None:
    pages = warc_pages(read_warc(spark, args.web), need_id=False)
    # what pages are there is in the headers of their records
    urls = warc_pages(read_warc(spark, args.web, payload=False), need_id=False)
    found = anchor_parts(pages, args.page_chars, args.max_chars, urls=urls)
    write_anchor_parts(found, args.out)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    docs = read_documents(spark, args.docs, args.format)
    write_run(simple_run(docs, read_topics(spark, args.topics), args.k), args.out, tagged=False)


def stats(spark: SparkSession, args: argparse.Namespace) -> None:
    docs = read_documents(spark, args.docs, args.format)
    weighted = term_statistics(docs, read_topic_lines(spark, args.topics))
    write_stats_file(weighted, args.out, args.docs, args.program)


def baselines(spark: SparkSession, args: argparse.Namespace) -> None:
    docs = read_documents(spark, args.docs, args.format)
    found = baseline_run(docs, read_weighted_topics(spark, args.stats), k=args.k)
    (write_run_by_model if args.by_model else write_run)(found, args.out)


def whole_experiment(spark: SparkSession, args: argparse.Namespace) -> None:
    docs = read_documents(spark, args.docs, args.format)
    found = experiment(docs, read_topics(spark, args.topics), k=args.k)
    (write_run_by_model if args.by_model else write_run)(found, args.out)


def trec(spark: SparkSession, args: argparse.Namespace) -> None:
    ranked = best(read_run(spark, args.run, model=args.model), args.k)
    write_trec_run(
        ranked, args.out, model=args.model, tag=args.tag, strip_prefix=args.strip_prefix
    )


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(
        prog="siftrank", description=__doc__, formatter_class=argparse.RawTextHelpFormatter
    )
    jobs = top.add_subparsers(dest="job", required=True)

    def job(action, *places: str, name: str = "") -> argparse.ArgumentParser:
        sub = jobs.add_parser(name or action.__name__)
        sub.set_defaults(action=action)
        for place in places:
            sub.add_argument(place)
        if "docs" in places:
            sub.add_argument("--format", default="WARC", help="WARC or KEYVAL")
        return sub

    sub = job(anchors, "web", "out")
    sub.add_argument("--page-chars", type=int, help="how much of a page is searched, if not all")
    sub.add_argument("--max-chars", type=int, help="how many characters a page gathers at most")
    job(run, "docs", "out", "topics").add_argument("-k", type=int, default=TOP)
    job(stats, "docs", "topics", "out").add_argument(
        "--program", default="RUN", help="word that starts the header lines"
    )
    for sub in (
        job(baselines, "docs", "out", "stats"),
        job(whole_experiment, "docs", "out", "topics", name="experiment"),
    ):
        sub.add_argument("-k", type=int, default=TOP)
        sub.add_argument("--by-model", action="store_true", help="one folder per model")
    sub = job(trec, "run", "out")
    sub.add_argument("-k", type=int, help="how many lines a topic gets, if not all")
    sub.add_argument("--model", help="the model to select, if the run has several")
    sub.add_argument("--tag", help="run tag in place of the model's name")
    sub.add_argument("--strip-prefix", default="^wt09-", help="pattern cut off topic ids")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"siftrank {args.job}").getOrCreate()
    with intermediate_tables(spark):
        args.action(spark, args)


if __name__ == "__main__":
    main()
