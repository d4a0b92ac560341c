"""Registered queries against their SQL on the smallest tables.

By default the headline queries run; STUDYLOOM_ALL=1 runs every one (a quarter of an hour).
"""

import os

import pytest

import __spark_entry__ as entry
from studyloom.queries import registry
from tools.check_oracles import key, norm

SF = "/root/testdata/sf0.001"
HEADLINE = [
    "memory_replay", "memory_replay_incremental", "review_step", "preview_answers", "review_queue", "question_picks", "question_pool", "learn_summary", "document_sentences", "text_blocks",
    "captions_attached", "references_dropped", "narration_split", "web_blocks", "papers_identified", "works_in_library", "catalogue_lookup", "segment_visuals", "visual_stops", "seek_back", "drafts_accepted", "listening_context",
    "answer_visuals", "heard_answers", "plans_parsed", "lessons_parsed", "figure_groups", "page_turns_joined", "reading_order", "file_formats", "openalex_read", "cards_parsed", "markdown_inline", "document_visuals", "stream_reviews", "stream_positions",
]
# queries whose sequences are scanned in buckets
SCANNED = ["figures_attached", "seek_forward", "page_numbers", "section_numbers", "section_starts", "hyphens_mended", "due_cards"]


NAMES = sorted(registry.oracles()) if os.environ.get("STUDYLOOM_ALL") else HEADLINE + SCANNED


def compare(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    res = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in res.fetchall()), key=key)
    assert got and got == want


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_every_query_has_sql():
    own = set(registry.queries())
    assert own == set(registry.oracles()) and own <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
