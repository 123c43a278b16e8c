"""

Every query runs over whole tables. Scores are rounded in the result only:
ranks come from the unrounded ones.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from siftrank import (  # noqa: E402
    BASELINES,
    anchor_documents,
    anchor_experiment,
    anchor_parts,
    baseline_run,
    bm25,
    dirichlet_lm,
    experiment,
    lambda_sweep,
    read_anchors,
    read_documents,
    read_run,
    read_topics,
    read_weighted_topics,
    simple_run,
    term_statistics,
    unsmoothed_lm,
)
from siftrank.functions.text import query_terms
from siftrank.operators.hits import document_hits, document_hits_among, term_frequencies
from siftrank.operators.links import anchor_text_documents, extract_links, page_keys
from siftrank.operators.statistics import collection_stats
from siftrank.operators.topics import last_wins, topic_slices
from siftrank.session import new_folder, spread
from siftrank.sinks.anchors import write_anchor_parts
from siftrank.sinks.text import (
    stats_file_lines,
    trec_run,
    write_anchors,
    write_run,
    write_run_by_model,
    write_stats_file,
    write_trec_run,
)
from siftrank.sources.text import parse_topics, topics_from_text
from siftrank.sources.warc import (
    archive_report,
    page_documents,
    read_warc,
    warc_documents,
    warc_pages,
)

# The fifty topics of the TREC 2010 web track, then topics in the
# words of the test tables: frequent and rare ones, repeated, unknown and empty
# terms, a term in more than half of the documents, a second colon.
TOPICS = """
51:horse hooves
52:avp
53:discovery channel store
54:president of the united states
55:iron
56:uss yorktown charleston sc
57:ct jobs
58:penguins
59:how to build a fence
60:bellevue
61:worm
62:texas border patrol
63:flushing
64:moths
65:korean language
66:income tax return online
67:vldl levels
68:pvc
69:sewing instructions
70:to be or not to be that is the question
71:living in india
72:the sun
73:neil young
74:kiwi
75:tornadoes
76:raised gardens
77:bobcat
78:dieting
79:voyager
80:keyboard reviews
81:afghanistan
82:joints
83:memory
84:continental plates
85:milwaukee journal sentinel
86:bart sf
87:who invented music
88:forearm pain
89:ocd
90:mgb
91:er tv show
92:the wall
93:raffles
94:titan
95:earn money at home
96:rice
97:south africa
98:sat
99:satellite
100:rincon puerto rico
101:the and of
102:la de que
103:Thon ther
104:to be or to
105:the zzqxv
106: leading delimiter
107:tion:cut here
108:are these from
109:schkeit stau
110:that was with this for
111:nicht und der
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scan.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return scan.select(F.col("page_id").cast("string").alias("doc_id"), "url", "html")


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, and one empty page behind each URL they link to.

    Hardly any link of the test tables leads to a page of theirs.
    """
    return _with_targets(_pages(spark, sf_dir))


def _with_targets(pages: DataFrame) -> DataFrame:
    targets = (
        extract_links(pages, page_chars=None)
        .groupBy(F.col("target_url").alias("url"))
        .agg(F.min("src_doc_id").alias("first"))
        .select(F.concat(F.lit("t"), "first").alias("doc_id"), "url", F.lit("").alias("html"))
    )
    return pages.unionByName(targets)


def _topics(spark: SparkSession) -> DataFrame:
    return last_wins(parse_topics(topics_from_text(spark, TOPICS), reject_stats=True))


def _table_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of the benchmark table as a topic."""
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return table.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"),
        query_terms(F.col("text")).alias("terms"),
    )


def _shown(run: DataFrame) -> DataFrame:
    return run.select(
        "qid", "model", "doc_id", F.round("score", 8).alias("score"), F.col("rank").cast("int").alias("rank")
    )


def doc_tokens_length(spark, sf_dir):
    return document_hits(_docs(spark, sf_dir), []).select("doc_id", "dl")


def html_to_text(spark, sf_dir):
    return page_documents(_pages(spark, sf_dir))


def link_extract(spark, sf_dir):
    links = extract_links(_pages(spark, sf_dir), page_chars=None)
    return links.select("src_doc_id", "pos", "anchor_text")


def absolute_urls(spark, sf_dir):
    links = extract_links(_pages(spark, sf_dir), page_chars=None)
    return links.select("src_doc_id", "pos", "target_url")


def page_url_keys(spark, sf_dir):
    return page_keys(_pages(spark, sf_dir))


def _joined(anchors, *more):
    return anchors.select("doc_id", "url", *more, F.array_join("anchors", "\t").alias("anchors"))


def anchor_docs(spark, sf_dir):
    return _joined(anchor_documents(_linked_pages(spark, sf_dir), page_chars=None))


def anchor_cap(spark, sf_dir):
    return _joined(
        anchor_documents(_linked_pages(spark, sf_dir), page_chars=None, max_chars=60)
    )


# Small enough that pages have several parts.
PART_CHARS = 5
HUB_CHARS = 100


def anchor_part_rows(spark, sf_dir):
    parts = anchor_parts(_linked_pages(spark, sf_dir), part_chars=PART_CHARS)
    return _joined(parts, "part", "last")


def anchor_parts_of_a_hub(spark, sf_dir):
    """Every second page links to one more page, which gets most links by far."""
    hub = F.concat(F.lit('<a href="http://hub.example/all">from '), "doc_id", F.lit("</a>"), "html")
    html = F.when(F.col("doc_id").cast("long") % 2 == 0, hub).otherwise(F.col("html"))
    pages = _pages(spark, sf_dir).withColumn("html", html)
    parts = anchor_parts(_with_targets(pages), part_chars=HUB_CHARS)
    return _joined(parts, "part", "last")


def anchor_files_of_parts(spark, sf_dir):
    """Parts written as lines of text, and read again."""
    folder = new_folder(spark, "anchors")
    parts = anchor_parts(_linked_pages(spark, sf_dir), part_chars=PART_CHARS)
    write_anchor_parts(parts, folder)
    return _joined(read_anchors(spark, folder))


def anchor_bm25(spark, sf_dir):
    return _shown(anchor_experiment(_linked_pages(spark, sf_dir), _topics(spark), [bm25()]))


def anchor_text_bm25(spark, sf_dir):
    anchors = anchor_documents(_linked_pages(spark, sf_dir))
    return _shown(experiment(anchor_text_documents(anchors), _topics(spark), [bm25()]))


def anchor_left_out(spark, sf_dir):
    """How many links the limit of 60 characters leaves out."""
    anchors = anchor_documents(_linked_pages(spark, sf_dir), max_chars=60)
    return anchors.select("doc_id", F.size("anchors").alias("n_kept"), "n_left_out")


# What is done to the links of each fifth of the pages, so that links of
# every form occur.
LINK_FORMS = [
    ('href="/', 'href="'),
    ('href="/', 'href="http://www.example.com/up/../'),
    ('href="/', 'href="../'),
    ('">', '/index.html">'),
    ("<a href", '<a rel="nofollow" href'),
]


def _shaped_pages(spark, sf_dir):
    """The pages with links of all forms, and with index pages in their own URLs."""
    html = F.col("html")
    for n, (old, new) in enumerate(LINK_FORMS):
        changed = F.replace(F.col("html"), F.lit(old), F.lit(new))
        html = F.when(F.col("doc_id").cast("long") % len(LINK_FORMS) == n, changed).otherwise(html)
    url = F.concat("url", F.lit("/Index.html"))
    return _pages(spark, sf_dir).select("doc_id", url.alias("url"), html.alias("html"))


def link_forms(spark, sf_dir):
    return extract_links(_shaped_pages(spark, sf_dir))


def linked_pages_of_all_forms(spark, sf_dir):
    pages = _shaped_pages(spark, sf_dir)
    targets = extract_links(pages).groupBy(F.col("target_url").alias("url"))
    ends = targets.agg(F.min("src_doc_id").alias("first")).select(
        F.concat(F.lit("t"), "first").alias("doc_id"), "url", F.lit("").alias("html")
    )
    return _joined(anchor_documents(pages.unionByName(ends)))


def page_keys_of_all_forms(spark, sf_dir):
    return page_keys(_shaped_pages(spark, sf_dir))


def html_with_headers(spark, sf_dir):
    """Protocol headers before each page, and an index page in each URL."""
    pages = _shaped_pages(spark, sf_dir)
    header = F.lit("HTTP/1.1 200 OK\nServer: any\n\n")
    return page_documents(pages.withColumn("html", F.concat(header, "html")))


def _with_empty_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.unionByName(
        docs.select(F.concat(F.lit("e"), "doc_id").alias("doc_id"), F.lit(" --- ").alias("text"))
    )


def lm_with_empty_documents(spark, sf_dir):
    return _shown(simple_run(_with_empty_documents(spark, sf_dir), _topics(spark)))


def statistics_with_empty_documents(spark, sf_dir):
    return collection_stats(document_hits(_with_empty_documents(spark, sf_dir), []))


def trec_prefixed_lines(spark, sf_dir):
    """Topic ids with a prefix that run lines leave out."""
    topics = _topics(spark).withColumn("qid", F.concat(F.lit("wt09-"), "qid"))
    run = experiment(_docs(spark, sf_dir), topics, lambda_sweep(0.7, 1.0))
    return trec_run(_rounded(run), tag="b").select("value")

def query_vocab_tf(spark, sf_dir):
    words = topic_slices(_topics(spark))[0].vocabulary
    hits = document_hits(_docs(spark, sf_dir), words)
    return term_frequencies(hits).select("doc_id", "dl", "term", "tf")


def table_vocab_tf(spark, sf_dir):
    """As with a vocabulary that is too large to be named in a plan."""
    words = _table_topics(spark, sf_dir).select(F.explode("terms").alias("term"))
    hits = document_hits_among(_docs(spark, sf_dir), words)
    return term_frequencies(hits).select("doc_id", "dl", "term", "tf")


def collection_statistics(spark, sf_dir):
    return collection_stats(document_hits(_docs(spark, sf_dir), []))


def query_term_stats(spark, sf_dir):
    weighted = term_statistics(_docs(spark, sf_dir), _topics(spark))
    return weighted.select("qid", F.posexplode("terms").alias("pos", "t")).select(
        "qid", "pos", "t.term", "t.qtf", "t.df", "t.cf"
    )


def weighted_topics_text(spark, sf_dir):
    lines = parse_topics(topics_from_text(spark, TOPICS))
    return stats_file_lines(term_statistics(_docs(spark, sf_dir), lines), "documents")


def lm_topk(spark, sf_dir):
    return _shown(simple_run(_docs(spark, sf_dir), _topics(spark)))


def zero_term_topic(spark, sf_dir):
    topics = topics_from_text(spark, "201:---\n202:the\n203: ; ")
    return _shown(simple_run(_docs(spark, sf_dir), last_wins(parse_topics(topics)), k=50))


def _baseline(models):
    def query(spark, sf_dir):
        return _shown(experiment(_docs(spark, sf_dir), _topics(spark), models))

    return query


def baselines_two_pass(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    weighted = term_statistics(docs, _topics(spark))
    return _shown(baseline_run(docs, weighted, [dirichlet_lm(), bm25()], k=100))


def table_topics_bm25(spark, sf_dir):
    return _shown(experiment(_docs(spark, sf_dir), _table_topics(spark, sf_dir), [bm25()]))


def _rounded(run):
    return run.withColumn("score", F.round("score", 6))


def trec_run_lines(spark, sf_dir):
    run = experiment(_docs(spark, sf_dir), _topics(spark), [*lambda_sweep(0.3, 0.4), bm25()])
    return trec_run(_rounded(run), model="LMs0.7", tag="lm07").select("value")


def run_roundtrip(spark, sf_dir):
    run = experiment(_docs(spark, sf_dir), _topics(spark), [dirichlet_lm(), bm25()])
    folder = new_folder(spark, "run")
    write_run(run, folder)
    return read_run(spark, folder).select("qid", "model", "doc_id", F.round("score", 8).alias("score"))


def run_of_one_model(spark, sf_dir):
    """A run with a folder per model, of which one is read."""
    run = experiment(_docs(spark, sf_dir), _topics(spark), [dirichlet_lm(), bm25()])
    folder = new_folder(spark, "run")
    write_run_by_model(run, folder)
    run = read_run(spark, folder, model="BM25")
    return run.select("qid", "model", "doc_id", F.round("score", 8).alias("score"))


def existing_run_is_kept(spark, sf_dir):
    """A second run into the same folder is refused and changes nothing."""
    run = experiment(_docs(spark, sf_dir), _topics(spark), [bm25()])
    folder = new_folder(spark, "run")
    write_run(run, folder)
    try:
        write_run(run.limit(1), folder)
        refused = False
    except AnalysisException:
        refused = True
    counted = read_run(spark, folder).agg(F.count("*").alias("n_lines"))
    return counted.withColumn("refused", F.lit(refused))


def trec_file_order(spark, sf_dir):
    """The place of each line in a written run."""
    run = experiment(_docs(spark, sf_dir), _topics(spark), [bm25()])
    folder = new_folder(spark, "trec")
    write_trec_run(_rounded(run), folder)
    line = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(folder).select("value", line.alias("at"))
    nth = F.row_number().over(Window.orderBy("at"))
    fields = F.split("value", "\t")
    return lines.select(nth.alias("nth"), fields[0].alias("qid"), fields[2].alias("doc_id"))


def keyval_roundtrip(spark, sf_dir):
    folder = new_folder(spark, "anchors")
    write_anchors(anchor_documents(_linked_pages(spark, sf_dir), page_chars=None), folder)
    return read_documents(spark, folder, "keyval")


def anchors_scan(spark, sf_dir):
    folder = new_folder(spark, "anchors")
    write_anchors(anchor_documents(_linked_pages(spark, sf_dir), page_chars=None), folder)
    return read_anchors(spark, folder).select(
        "doc_id", "url", F.size("anchors").alias("n_anchors")
    )


def _topic_file(spark, sf_dir):
    folder = new_folder(spark, "topics")
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one_line = F.regexp_replace("text", r"\s+", " ")
    table.select(
        F.concat(F.lit("WT-"), F.col("item_id").cast("string"), F.lit(":"), one_line)
    ).write.text(folder)
    return folder


def topics_scan(spark, sf_dir):
    topics = read_topics(spark, _topic_file(spark, sf_dir))
    return topics.select("qid", F.posexplode("terms").alias("pos", "term"))


def weighted_topics_scan(spark, sf_dir):
    topics = read_topics(spark, _topic_file(spark, sf_dir)).withColumn("seq", F.col("qid"))
    folder = new_folder(spark, "stats")
    write_stats_file(term_statistics(_docs(spark, sf_dir), topics), folder, "documents")
    weighted = read_weighted_topics(spark, folder)
    return weighted.select(
        "qid", "n_docs", "coll_len", F.posexplode("terms").alias("pos", "t")
    ).select("qid", "n_docs", "coll_len", "pos", "t.term", "t.qtf", "t.df", "t.cf")


def _archive(spark, sf_dir, pages=None, before="", lead="", packed=True):
    """Pages as a web archive, one record per row, each after ``before`` and with
    ``lead`` before its payload."""
    folder = new_folder(spark, "warc")
    pages = _pages(spark, sf_dir) if pages is None else pages
    record = F.concat(
        F.lit(before),
        F.lit("WARC/0.18\nWARC-Type: response\nWARC-Target-URI: "),
        "url",
        F.lit("\nWARC-TREC-ID: "),
        "doc_id",
        F.lit("\nContent-Type: application/http; msgtype=response\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\n\n" + lead),
    )
    # as bytes: payloads need not be text
    record = F.concat(record.cast("binary"), F.col("html").cast("binary"), F.lit("\n").cast("binary"))
    pages.select(record.cast("string")).write.text(folder, compression="gzip" if packed else "none")
    return folder


def warc_scan(spark, sf_dir):
    return read_warc(spark, _archive(spark, sf_dir)).select(
        F.col("headers")["WARC-TREC-ID"].alias("doc_id"),
        F.col("headers")["WARC-Target-URI"].alias("url"),
        "warc_type",
        "content_length",
        F.md5("content").alias("content_md5"),
    )


def warc_docs(spark, sf_dir):
    return warc_documents(read_warc(spark, _archive(spark, sf_dir)))


def warc_anchor_documents(spark, sf_dir):
    archive = _archive(spark, sf_dir, _linked_pages(spark, sf_dir))
    return _joined(anchor_documents(warc_pages(read_warc(spark, archive), need_id=False)))


# An information record, a request, and a length that is none.
OTHER_RECORDS = (
    "WARC/0.18\nWARC-Type: warcinfo\nContent-Length: 4\n\nnone\n\n"
    "WARC/0.18\nWARC-Type: request\nContent-Length: 3\n\nGET\n\n"
    "WARC/0.18\nWARC-Type: response\nContent-Length: 99999999999\n"
    "WARC-TREC-ID: none\n\nContent-Length: 5\n\nplain\n\n"
)


def warc_scan_mixed(spark, sf_dir):
    """Responses between other records, with a bad length stated first in each third one."""
    records = read_warc(spark, _archive(spark, sf_dir, before=OTHER_RECORDS))
    return records.select(
        F.col("headers")["WARC-TREC-ID"].alias("doc_id"),
        "content_length",
        F.md5("content").alias("content_md5"),
    )


def warc_pieces(spark, sf_dir):
    """Plain archives read in pieces; ``numbered`` if a file's records count from 1 on."""
    records = read_warc(spark, _archive(spark, sf_dir, packed=False), piece_bytes=20_000)
    nth = F.row_number().over(Window.partitionBy("path").orderBy("record_no"))
    return records.select(
        F.col("headers")["WARC-TREC-ID"].alias("doc_id"),
        F.md5("content").alias("content_md5"),
        (F.col("record_no") == nth).alias("numbered"),
    )


def warc_headers(spark, sf_dir):
    """What headers say, the payloads being passed over."""
    records = read_warc(spark, _archive(spark, sf_dir, packed=False), payload=False)
    return records.select(
        F.col("headers")["WARC-TREC-ID"].alias("doc_id"),
        F.col("headers")["WARC-Target-URI"].alias("url"),
        "content_length",
        F.col("content").isNull().alias("passed_over"),
    )


def warc_report(spark, sf_dir):
    report = archive_report(spark, _archive(spark, sf_dir, before=OTHER_RECORDS), "response")
    return report.agg(F.sum("n_records").alias("n_records"), F.bool_and("whole").alias("whole"))


def warc_line_ends(spark, sf_dir):
    """Line ends before each payload, which its length does not count."""
    return read_documents(spark, _archive(spark, sf_dir, lead="\r\n\r\n"), "WARC")


def warc_bad_bytes(spark, sf_dir):
    """A byte that is no text in every tenth page."""
    bad = F.concat(F.lit("bad ").cast("binary"), F.unhex(F.lit("FF")), F.lit(" byte ").cast("binary"))
    html = F.col("html").cast("binary")
    html = F.when(F.col("doc_id").cast("long") % 10 == 0, F.concat(bad, html)).otherwise(html)
    pages = _pages(spark, sf_dir).withColumn("html", html)
    return warc_documents(read_warc(spark, _archive(spark, sf_dir, pages)))


PAGE_CHARS = 700


def links_within_a_limit(spark, sf_dir):
    links = extract_links(_pages(spark, sf_dir), page_chars=PAGE_CHARS)
    return links.select("src_doc_id", "pos", "target_url", "anchor_text")


def warc_anchors(spark, sf_dir):
    pages = read_warc(spark, _archive(spark, sf_dir)).select(
        F.col("headers")["WARC-TREC-ID"].alias("doc_id"),
        F.regexp_replace(F.col("headers")["WARC-Target-URI"], "^https", "http").alias("url"),
        F.col("content").cast("string").alias("html"),
    )
    links = extract_links(pages, page_chars=None)
    return links.groupBy("target_url").agg(F.count("*").alias("n_links"))


def entry(spark: SparkSession) -> DataFrame:
    """All baseline models over the smallest tables."""
    return _baseline(BASELINES)(spark, "/root/testdata/sf0.001")


def _added() -> tuple[dict, dict]:
    """Queries and SQL of the text preparation operators, if they are there."""
    try:
        import corpus_pipeline
        from siftrank.llm.queries import ORACLE_SQL, QUERIES
    except ImportError as missing:
        if getattr(missing, "name", None) not in ("corpus_pipeline", "siftrank.llm"):
            warnings.warn(f"without the text preparation queries: {missing}", stacklevel=2)
        return {}, {}
    sql = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return QUERIES | {"pipeline": corpus_pipeline.run}, ORACLE_SQL | sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own_queries() | _added()[0]


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "doc_tokens_length": doc_tokens_length,
        "html_to_text": html_to_text,
        "link_extract": link_extract,
        "absolute_urls": absolute_urls,
        "page_url_keys": page_url_keys,
        "anchor_documents": anchor_docs,
        "anchor_cap": anchor_cap,
        "anchor_part_rows": anchor_part_rows,
        "anchor_parts_of_a_hub": anchor_parts_of_a_hub,
        "anchor_files_of_parts": anchor_files_of_parts,
        "query_vocab_tf": query_vocab_tf,
        "table_vocab_tf": table_vocab_tf,
        "collection_stats": collection_statistics,
        "query_term_stats": query_term_stats,
        "weighted_topics_text": weighted_topics_text,
        "lm_topk": lm_topk,
        "lmno_topk": _baseline([unsmoothed_lm()]),
        "lms_sweep_topk": _baseline(lambda_sweep()),
        "lmdi_topk": _baseline([dirichlet_lm()]),
        "bm25_topk": _baseline([bm25()]),
        "baselines_all": _baseline(BASELINES),
        "baselines_two_pass": baselines_two_pass,
        "zero_term_topic": zero_term_topic,
        "table_topics_bm25": table_topics_bm25,
        "baselines_k10": lambda spark, sf_dir: _shown(
            experiment(_docs(spark, sf_dir), _topics(spark), BASELINES, k=10)
        ),
        "lmno_long_topics": lambda spark, sf_dir: _shown(
            experiment(_docs(spark, sf_dir), _table_topics(spark, sf_dir), [unsmoothed_lm()])
        ),
        "anchor_text_bm25": anchor_text_bm25,
        "anchor_left_out": anchor_left_out,
        "link_forms": link_forms,
        "linked_pages_of_all_forms": linked_pages_of_all_forms,
        "page_keys_of_all_forms": page_keys_of_all_forms,
        "html_with_headers": html_with_headers,
        "lm_with_empty_documents": lm_with_empty_documents,
        "statistics_with_empty_documents": statistics_with_empty_documents,
        "trec_prefixed_lines": trec_prefixed_lines,
        "warc_anchor_documents": warc_anchor_documents,
        "warc_scan_mixed": warc_scan_mixed,
        "trec_run_lines": trec_run_lines,
        "run_roundtrip": run_roundtrip,
        "run_of_one_model": run_of_one_model,
        "trec_file_order": trec_file_order,
        "existing_run_is_kept": existing_run_is_kept,
        "anchor_bm25": anchor_bm25,
        "keyval_roundtrip": keyval_roundtrip,
        "anchors_scan": anchors_scan,
        "topics_scan": topics_scan,
        "weighted_topics_scan": weighted_topics_scan,
        "warc_scan": warc_scan,
        "warc_pieces": warc_pieces,
        "warc_headers": warc_headers,
        "warc_report": warc_report,
        "warc_line_ends": warc_line_ends,
        "warc_bad_bytes": warc_bad_bytes,
        "links_within_a_limit": links_within_a_limit,
        "warc_documents": warc_docs,
        "warc_links": warc_anchors,
    }


# --- the same in SQL -------------------------------------------------------

_HTML_TEXT = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?s)^.*?<', '<'), '(?is)<script(.*?)</script>', ' ', 'g'), "
    "'<[^>]+>', ' ', 'g'), '[ \\n\\r\\t]+', ' ', 'g')"
)
_PAGE_TEXT = (
    "regexp_replace(url, '(?i)/index\\.[a-z]{3,4}$', '/') || chr(9) || " + _HTML_TEXT
)
_PAGE_URL = "regexp_replace({}, '/$|/index\\.[a-z][a-z][a-z][a-z]?$', '')"
_LINK = """'(?is)<a ([^>]*)href=["'']?([^> ''"]+)([^>]*)>(.*?)</a>'"""

_LINKS = rf"""
stripped AS (
  SELECT CAST(page_id AS VARCHAR) AS src_doc_id, {_PAGE_URL.format("url")} AS base,
         regexp_replace(html, '(?is)<script(.*?)</script>', ' ', 'g') AS html
  FROM pages),
elements AS (
  SELECT src_doc_id, base, unnest(regexp_extract_all(html, {_LINK}, 0)) AS element,
         generate_subscripts(regexp_extract_all(html, {_LINK}, 0), 1) - 1 AS pos
  FROM stripped),
parts AS (
  SELECT src_doc_id, pos, regexp_replace(base, '^[a-z]+://', '') AS base,
         regexp_replace(regexp_extract(element, {_LINK}, 2), '[ \n\r\t]', '', 'g') AS href,
         regexp_replace(regexp_extract(element, {_LINK}, 4),
                        '<[^>]+>|[ \n\t\r]+', ' ', 'g') AS anchor_text
  FROM elements
  WHERE NOT regexp_matches(
    regexp_extract(element, {_LINK}, 1) || regexp_extract(element, {_LINK}, 3),
    '(?i)rel=["'']?nofollow')),
joined AS (
  SELECT src_doc_id, pos, anchor_text,
         CASE WHEN starts_with(href, '/') THEN regexp_replace(base, '/.*$', '') || href
              WHEN regexp_matches(href, '^[a-z]+://') THEN regexp_replace(href, '^[a-z]+://', '')
              ELSE regexp_replace(base, '/[^/]+$', '') || '/' || href END AS url
  FROM parts),
links AS (
  SELECT src_doc_id, CAST(pos AS INTEGER) AS pos, anchor_text,
         'http://' || {_PAGE_URL.format("regexp_replace(url, '/.[^/]+/[.][.]/|//', '/', 'g')")}
           AS target_url
  FROM joined)"""

_ANCHORS = (
    _LINKS
    + """,
linked AS (
  SELECT CAST(page_id AS VARCHAR) AS doc_id, """
    + _PAGE_URL.format("url")
    + """ AS url FROM pages
  UNION ALL
  SELECT 't' || min(src_doc_id), """
    + _PAGE_URL.format("target_url")
    + """ FROM links GROUP BY target_url),
keys AS (SELECT url, min(doc_id) AS doc_id FROM linked GROUP BY url),
met AS (
  SELECT doc_id, url, src_doc_id, pos, anchor_text,
         coalesce(sum(length(anchor_text) + 1) OVER (
           PARTITION BY url ORDER BY src_doc_id, pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM keys JOIN links ON url = target_url),
anchor_docs AS (
  SELECT doc_id, url, string_agg(anchor_text, chr(9) ORDER BY src_doc_id, pos) AS anchors,
         count(*) AS n
  FROM met WHERE length(url) + used < {cap} GROUP BY doc_id, url)"""
)


def _shaped(sql: str) -> str:
    """``sql`` over the pages with links of all forms."""
    html = "html"
    for n, (old, new) in enumerate(LINK_FORMS):
        html = f"CASE WHEN page_id % {len(LINK_FORMS)} = {n} THEN replace(html, '{old}', '{new}') ELSE {html} END"
    pages = f"shaped AS (SELECT page_id, url || '/Index.html' AS url, {html} AS html FROM pages)"
    return pages + "," + sql.replace("FROM pages", "FROM shaped")


def _anchors(cap: int = 10**15) -> str:
    return _ANCHORS.replace("{cap}", str(cap))


def _pieces(chars: int) -> str:
    return f"""
pieces AS (
  SELECT doc_id, url, CAST(used // {chars} AS BIGINT) AS part,
         string_agg(anchor_text, chr(9) ORDER BY src_doc_id, pos) AS anchors
  FROM met GROUP BY ALL)
SELECT doc_id, url, part, part = max(part) OVER (PARTITION BY url) AS last, anchors FROM pieces"""


def _topic_values(text: str) -> str:
    lines = text.strip("\n").split("\n")
    rows = ",".join(f"({n}, '{line}')" for n, line in enumerate(lines))
    return f"""
lines(seq, line) AS (VALUES {rows}),
fields AS (SELECT seq, string_split(lower(line), ':') AS f FROM lines),
queries AS (SELECT seq, f[1] AS qid, f[2] AS query FROM fields)"""


_TABLE_TOPICS = """
queries AS (SELECT item_id AS seq, 'b' || item_id AS qid, lower(text) AS query FROM benchmark)"""

# a query's first term is empty when it starts with a delimiter
_TOPIC_TERMS = """,
words AS (
  SELECT seq, qid, CASE WHEN regexp_matches(query, '^[^0-9a-z]+[0-9a-z]') THEN [''] ELSE [] END
         || regexp_extract_all(query, '[0-9a-z]+') AS terms FROM queries),
topics AS (
  SELECT seq, qid, unnest(terms) AS term,
         CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS pos FROM words)"""

_DOCS = """,
docs AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS terms
  FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents)),"""

_ANCHOR_DOCS = """,
docs AS (
  SELECT doc_id, regexp_extract_all(lower(url || chr(9) || anchors), '[0-9a-z]+') AS terms
  FROM anchor_docs),"""

_COUNTS = """
numbered AS (SELECT row_number() OVER () AS row_key, doc_id, terms FROM docs),
tf AS (
  SELECT row_key, doc_id, dl, term, count(*) AS tf
  FROM (SELECT row_key, doc_id, len(terms) AS dl, unnest(terms) AS term FROM numbered)
  WHERE term IN (SELECT term FROM topics)
  GROUP BY row_key, doc_id, dl, term),
coll AS (SELECT count(*) AS n_docs, sum(len(terms)) AS coll_len FROM numbered),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
weighted AS (
  SELECT seq, qid, pos, topics.term, 1 AS qtf,
         coalesce(df, 0) AS df, CAST(coalesce(cf, 0) AS BIGINT) AS cf
  FROM topics LEFT JOIN stats ON topics.term = stats.term)"""


def _matches(kept: str) -> str:
    """Matched term positions of all candidate pairs, topics as ``kept`` has them."""
    return f""",
kept AS ({kept}),
sizes AS (SELECT qid, count(*) AS n_terms FROM kept GROUP BY qid),
hit AS (
  SELECT kept.qid, pos, kept.term, qtf, df, cf, row_key, doc_id, CAST(dl AS DOUBLE) AS dl,
         CAST(tf AS DOUBLE) AS tf, CAST(n_docs AS DOUBLE) AS n, CAST(coll_len AS BIGINT) AS c,
         n_terms
  FROM kept JOIN tf ON kept.term = tf.term JOIN sizes ON sizes.qid = kept.qid CROSS JOIN coll)"""


_OCCURRING = "SELECT * FROM weighted WHERE cf > 0"


def _lm(model: str) -> str:
    return f"""
  SELECT qid, '{model}' AS model, doc_id,
         list_reduce(list(tf / dl ORDER BY pos), lambda a, x: a * x) * any_value(dl) AS score
  FROM hit GROUP BY qid, row_key, doc_id HAVING count(*) = any_value(n_terms)"""


def _lms(weight: float) -> str:
    return f"""
  SELECT qid, 'LMs{weight:.1f}' AS model, doc_id, s + ln(dl) AS score FROM (
    SELECT qid, row_key, doc_id, any_value(dl) AS dl,
           sum(qtf * ln(1 + (tf * CAST(c AS DOUBLE) * CAST({weight!r} AS DOUBLE))
             / (CAST(cf AS DOUBLE) * dl * CAST({1 - weight!r} AS DOUBLE))) ORDER BY term) AS s
    FROM hit GROUP BY qid, row_key, doc_id) WHERE s > 0"""


_LMDI = """
  SELECT qid, 'LMdi' AS model, doc_id, s AS score FROM (
    SELECT pairs.qid, pairs.row_key, pairs.doc_id,
           sum(kept.qtf * (ln(coalesce(hit.tf, 0) * (pairs.c // kept.cf) + 2500)
                           - ln(pairs.dl + 2500)) ORDER BY kept.pos) AS s
    FROM (SELECT DISTINCT qid, row_key, doc_id, dl, c FROM hit) AS pairs
    JOIN kept ON kept.qid = pairs.qid
    LEFT JOIN hit ON hit.qid = kept.qid AND hit.pos = kept.pos AND hit.row_key = pairs.row_key
    GROUP BY pairs.qid, pairs.row_key, pairs.doc_id) WHERE s > 0"""

_BM25 = """
  SELECT qid, 'BM25' AS model, doc_id, s AS score FROM (
    SELECT qid, row_key, doc_id,
           sum(qtf * ((CAST(2.2 AS DOUBLE) * tf)
                 / (CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE)
                    * (dl / (CAST(c AS DOUBLE) / n))) + tf))
               * ln((n - df + 0.5) / (df + 0.5)) ORDER BY term) AS s
    FROM hit GROUP BY qid, row_key, doc_id) WHERE s <> 0"""

_SWEEP = [0.1, 0.1 + 0.2, 0.1 + 0.2 + 0.2, 0.1 + 0.2 + 0.2 + 0.2, 0.1 + 0.2 + 0.2 + 0.2 + 0.2]


def _ranked(models: list[str], k: int) -> str:
    return f""",
scored AS ({" UNION ALL ".join(models)}),
run AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY qid, model ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= {k})"""


_SHOW_RUN = " SELECT qid, model, doc_id, round(score, 8) AS score, rank FROM run"


def _run_sql(
    models: list[str],
    k: int = 1000,
    topics: str = "",
    kept: str = _OCCURRING,
    docs: str = _DOCS,
    show: str = _SHOW_RUN,
) -> str:
    topics = topics or _topic_values(TOPICS)
    return (
        "WITH " + topics + _TOPIC_TERMS + docs + _COUNTS + _matches(kept) + _ranked(models, k) + show
    )


def oracle_sql() -> dict[str, str]:
    return _own_sql() | _added()[1]


def _own_sql() -> dict[str, str]:
    documents = "WITH " + _topic_values(TOPICS) + _TOPIC_TERMS + _DOCS + _COUNTS
    anchor_rows = " SELECT doc_id, url, anchors FROM anchor_docs"
    file_topics = """
queries AS (
  SELECT item_id AS seq, 'wt-' || item_id AS qid,
         string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ':')[1] AS query
  FROM benchmark)"""
    sweep = [_lms(w) for w in _SWEEP]
    return {
        "doc_tokens_length": """
            SELECT CAST(doc_id AS VARCHAR) AS doc_id,
                   CAST(len(regexp_extract_all(lower(text), '[0-9a-z]+')) AS BIGINT) AS dl
            FROM documents""",
        "html_to_text": (
            f"SELECT CAST(page_id AS VARCHAR) AS doc_id, {_PAGE_TEXT} AS text FROM pages"
        ),
        "link_extract": f"WITH {_LINKS} SELECT src_doc_id, pos, anchor_text FROM links",
        "absolute_urls": f"WITH {_LINKS} SELECT src_doc_id, pos, target_url FROM links",
        "page_url_keys": (
            f"SELECT {_PAGE_URL.format('url')} AS url, CAST(page_id AS VARCHAR) AS doc_id FROM pages"
        ),
        "anchor_documents": f"WITH {_anchors()} {anchor_rows}",
        "anchor_cap": f"WITH {_anchors(60)} {anchor_rows}",
        "anchor_part_rows": f"WITH {_anchors()},{_pieces(PART_CHARS)}",
        "anchor_parts_of_a_hub": "WITH hubs AS ("
        """SELECT page_id, url, CASE WHEN page_id % 2 = 0
             THEN '<a href="http://hub.example/all">from ' || page_id || '</a>' || html ELSE html END AS html
           FROM pages),"""
        + _anchors().replace("FROM pages", "FROM hubs")
        + f",{_pieces(HUB_CHARS)}",
        "anchor_files_of_parts": f"WITH {_anchors()} {anchor_rows}",
        "query_vocab_tf": documents
        + " SELECT doc_id, CAST(dl AS BIGINT) AS dl, term, CAST(tf AS INTEGER) AS tf FROM tf",
        "table_vocab_tf": f"WITH {_TABLE_TOPICS}{_TOPIC_TERMS}{_DOCS}{_COUNTS}"
        " SELECT doc_id, CAST(dl AS BIGINT) AS dl, term, CAST(tf AS INTEGER) AS tf FROM tf",
        "collection_stats": documents
        + """ SELECT n_docs, CAST(coll_len AS BIGINT) AS coll_len,
              CAST(coll_len AS DOUBLE) / n_docs AS avg_dl FROM coll""",
        "query_term_stats": documents + " SELECT qid, pos, term, qtf, df, cf FROM weighted",
        "weighted_topics_text": documents
        + """ SELECT '#RUN-COMMENT: query term weight, document frequency, '
                     || 'collection frequency (for each term)' AS value
              UNION ALL SELECT '#RUN-COLLECTION:documents'
              UNION ALL SELECT '#RUN-LENGTH:' || CAST(coll_len AS BIGINT) FROM coll
              UNION ALL SELECT '#RUN-NDOCS:' || n_docs FROM coll
              UNION ALL SELECT any_value(qid) || ':' || string_agg(
                term || '=' || qtf || '=' || df || '=' || cf, ' ' ORDER BY pos)
              FROM weighted GROUP BY seq""",
        "lm_topk": _run_sql([_lm("LM")], kept="SELECT * FROM weighted"),
        "lmno_topk": _run_sql([_lm("LMno")]),
        "lms_sweep_topk": _run_sql(sweep),
        "lmdi_topk": _run_sql([_LMDI]),
        "bm25_topk": _run_sql([_BM25]),
        "baselines_all": _run_sql([_lm("LMno"), *sweep, _LMDI, _BM25]),
        "baselines_two_pass": _run_sql([_LMDI, _BM25], k=100),
        "zero_term_topic": """
            WITH lens AS (
              SELECT CAST(doc_id AS VARCHAR) AS doc_id,
                     regexp_extract_all(lower(text), '[0-9a-z]+') AS terms FROM documents),
            scored AS (
              SELECT qid, doc_id, CAST(len(terms) AS DOUBLE) AS score
              FROM lens JOIN (VALUES ('201'), ('203')) AS z(qid) ON len(terms) > 0
              UNION ALL
              SELECT '202', doc_id, CAST(len(list_filter(terms, lambda t: t = 'the')) AS DOUBLE)
                     / len(terms) * len(terms) FROM lens WHERE list_contains(terms, 'the'))
            SELECT qid, 'LM' AS model, doc_id, round(score, 8) AS score,
                   CAST(row_number() OVER (
                     PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM scored QUALIFY rank <= 50""",
        "table_topics_bm25": _run_sql([_BM25], topics=_TABLE_TOPICS),
        "baselines_k10": _run_sql([_lm("LMno"), *sweep, _LMDI, _BM25], k=10),
        "lmno_long_topics": _run_sql([_lm("LMno")], topics=_TABLE_TOPICS),
        "anchor_text_bm25": _run_sql(
            [_BM25], topics=_topic_values(TOPICS), docs="," + _anchors() + _ANCHOR_DOCS
        ),
        "anchor_left_out": f"""WITH {_anchors(60)},
            every AS (SELECT url, count(*) AS n_links FROM met GROUP BY url)
            SELECT doc_id, CAST(n AS INTEGER) AS n_kept, n_links - n AS n_left_out
            FROM anchor_docs JOIN every USING (url)""",
        "link_forms": f"""WITH {_shaped(_LINKS)}
            SELECT src_doc_id, pos, target_url, anchor_text FROM links""",
        "linked_pages_of_all_forms": f"WITH {_shaped(_anchors())} {anchor_rows}",
        "page_keys_of_all_forms": (
            f"""WITH {_shaped("one AS (SELECT 1)")}
            SELECT {_PAGE_URL.format('url')} AS url, CAST(page_id AS VARCHAR) AS doc_id FROM shaped"""
        ),
        "html_with_headers": (
            f"""WITH {_shaped("one AS (SELECT 1)")}
            SELECT CAST(page_id AS VARCHAR) AS doc_id, {_PAGE_TEXT} AS text FROM shaped"""
        ),
        "lm_with_empty_documents": _run_sql(
            [_lm("LM")],
            kept="SELECT * FROM weighted",
            docs=_DOCS.replace(
                "FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents)",
                "FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents "
                "UNION ALL SELECT 'e' || doc_id, ' --- ' FROM documents)",
            ),
        ),
        "statistics_with_empty_documents": documents
        + """ SELECT 2 * n_docs AS n_docs, CAST(coll_len AS BIGINT) AS coll_len,
              CAST(coll_len AS DOUBLE) / (2 * n_docs) AS avg_dl FROM coll""",
        "trec_prefixed_lines": _run_sql(
            [_lms(0.7)],
            show=""" SELECT qid || chr(9) || 'Q0' || chr(9) || doc_id || chr(9) || rank || chr(9)
                     || round(score, 6) || chr(9) || 'b' AS value FROM run""",
        ),
        "warc_anchor_documents": f"WITH {_anchors()} {anchor_rows}",
        "warc_scan_mixed": """
            SELECT CAST(page_id AS VARCHAR) AS doc_id,
                   CAST(octet_length(encode(html)) AS INTEGER) AS content_length,
                   md5(html) AS content_md5 FROM pages
            UNION ALL SELECT 'none', 5, md5('plain') FROM pages""",
        "trec_run_lines": _run_sql(
            [_lms(0.7)],
            show=""" SELECT qid || chr(9) || 'Q0' || chr(9) || doc_id || chr(9) || rank || chr(9)
                     || round(score, 6) || chr(9) || 'lm07' AS value FROM run""",
        ),
        "run_roundtrip": _run_sql(
            [_LMDI, _BM25], show=" SELECT qid, model, doc_id, round(score, 8) AS score FROM run"
        ),
        "run_of_one_model": _run_sql(
            [_BM25], show=" SELECT qid, model, doc_id, round(score, 8) AS score FROM run"
        ),
        "existing_run_is_kept": _run_sql(
            [_BM25], show=" SELECT CAST(count(*) AS BIGINT) AS n_lines, TRUE AS refused FROM run"
        ),
        "trec_file_order": _run_sql(
            [_BM25],
            show=""" SELECT CAST(row_number() OVER (
                         ORDER BY coalesce(try_cast(qid AS INTEGER), 0), qid, rank) AS INTEGER) AS nth,
                       qid, doc_id FROM run""",
        ),
        "anchor_bm25": _run_sql(
            [_BM25], topics=_topic_values(TOPICS), docs="," + _anchors() + _ANCHOR_DOCS
        ),
        "keyval_roundtrip": f"""WITH {_anchors()}
            SELECT doc_id, url || chr(9) || anchors AS text FROM anchor_docs""",
        "anchors_scan": f"""WITH {_anchors()}
            SELECT doc_id, url, CAST(n AS INTEGER) AS n_anchors FROM anchor_docs""",
        "topics_scan": f"WITH {file_topics} {_TOPIC_TERMS} SELECT qid, pos, term FROM topics",
        "weighted_topics_scan": "WITH "
        + file_topics
        + _TOPIC_TERMS
        + _DOCS
        + _COUNTS
        + """ SELECT qid, n_docs, CAST(coll_len AS BIGINT) AS coll_len,
                     CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS INTEGER) AS pos,
                     term, qtf, df, cf
              FROM weighted CROSS JOIN coll WHERE cf > 0""",
        "warc_scan": """
            SELECT CAST(page_id AS VARCHAR) AS doc_id, url, 'response' AS warc_type,
                   CAST(octet_length(encode(html)) AS INTEGER) AS content_length,
                   md5(html) AS content_md5 FROM pages""",
        "warc_pieces": """
            SELECT CAST(page_id AS VARCHAR) AS doc_id, md5(html) AS content_md5, TRUE AS numbered
            FROM pages""",
        "warc_headers": """
            SELECT CAST(page_id AS VARCHAR) AS doc_id, url,
                   CAST(octet_length(encode(html)) AS INTEGER) AS content_length, TRUE AS passed_over
            FROM pages""",
        # one of the records before each page is a response, too
        "warc_report": "SELECT CAST(2 * count(*) AS BIGINT) AS n_records, TRUE AS whole FROM pages",
        "warc_documents": (
            f"SELECT CAST(page_id AS VARCHAR) AS doc_id, {_PAGE_TEXT} AS text FROM pages"
        ),
        "warc_line_ends": (
            f"SELECT CAST(page_id AS VARCHAR) AS doc_id, {_PAGE_TEXT} AS text FROM pages"
        ),
        "warc_bad_bytes": f"""
            WITH marked AS (
              SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN 'bad \ufffd byte ' || html ELSE html END AS html
              FROM pages)
            SELECT CAST(page_id AS VARCHAR) AS doc_id, {_PAGE_TEXT} AS text FROM marked""",
        "links_within_a_limit": f"""
            WITH shortened AS (SELECT page_id, url, substring(html, 1, {PAGE_CHARS}) AS html FROM pages),
            {_LINKS.replace("FROM pages", "FROM shortened")}
            SELECT src_doc_id, pos, target_url, anchor_text FROM links""",
        "warc_links": f"""WITH {_LINKS}
            SELECT target_url, count(*) AS n_links FROM links GROUP BY target_url""",
    }
