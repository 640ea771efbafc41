"""Small data folders for the queries of the subpackage."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

TS = pa.timestamp("us")
SCHEMAS = {
    "document_page": {"page_id": pa.int64(), "source_id": pa.string(), "page_number": pa.int32(), "text": pa.string(), "extraction_method": pa.string(), "quality_notes": pa.list_(pa.string()), "ingested_at": TS},
    "normalized_page": {"page_id": pa.int64(), "source_id": pa.string(), "page_number": pa.int32(), "raw_text": pa.string(), "text": pa.string()},
    "benchmark_source": {"source_id": pa.string(), "source_name": pa.string(), "approval": pa.string(), "approval_reference": pa.string(), "insurer_family": pa.string(), "product_family": pa.string(), "source_content_sha256": pa.string(), "registered_at": TS},
    "document_split_assignment": {"source_id": pa.string(), "split": pa.string(), "near_duplicate_family": pa.string()},
    "silver_case": {"case_id": pa.string(), "source_id": pa.string(), "question": pa.string(), "stratum": pa.string(), "hard_negative_category": pa.string(), "annotation_uncertain": pa.bool_(), "initial_disagreement": pa.bool_(), "adjudicated": pa.bool_(), "annotation_outcome": pa.string(), "version": pa.string()},
    "annotation_draft": {"draft_id": pa.int64(), "case_id": pa.string(), "slot_id": pa.string(), "annotator_id": pa.string(), "model_id": pa.string(), "prompt_version": pa.string(), "stratum": pa.string(), "annotation_uncertain": pa.bool_(), "request_timestamp": TS, "retry_count": pa.int32(), "prompt_tokens": pa.int32(), "completion_tokens": pa.int32()},
    "evidence_span": {"span_id": pa.int64(), "case_id": pa.string(), "span_kind": pa.string(), "source_id": pa.string(), "page_number": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "quote": pa.string()},
    "dataset_split_report": {"version": pa.string(), "split": pa.string(), "total_cases": pa.int32(), "non_uncertain_cases": pa.int32(), "adjudicated_non_uncertain_cases": pa.int32(), "initial_disagreements": pa.int32(), "adjudicated_cases": pa.int32(), "uncertain_exclusions": pa.int32()},
    "documents": {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(), "insurer_family": pa.string(), "section_title": pa.string(), "published_at": TS},
    "reading_pair": {"pair_id": pa.int64(), "doc_id_a": pa.int64(), "doc_id_b": pa.int64()},
    "split_target": {"split_name": pa.string(), "share": pa.float64()},
    "pack_budget": {"budget_name": pa.string(), "tokenizer": pa.string(), "capacity_tokens": pa.int32()},
}
#: Names that the operators use inside.
CLASHING = ("t", "k", "n", "hash", "key", "row", "root", "family", "side", "size", "drop", "body", "l", "word")


@pytest.fixture
def make_dir(tmp_path):
    """A function that writes a folder with the rows given (dicts, by table); other tables are empty; `extra` adds columns with clashing names."""

    def make(extra=False, **rows):
        d = tmp_path / f"d{len(list(tmp_path.iterdir()))}"
        d.mkdir()
        for name, schema in SCHEMAS.items():
            own = rows.get(name, [])
            cols = {c: pa.array([r.get(c) for r in own], kind) for c, kind in schema.items()}
            if extra:
                cols |= {c: pa.array(["x"] * len(own), pa.string()) for c in CLASHING if c not in cols}
            pq.write_table(pa.table(cols), d / f"{name}.parquet")
        return str(d)

    return make


def page(i, text, source="s1", number=None, notes=None, method="text"):
    return {"page_id": i, "source_id": source, "page_number": i if number is None else number, "text": text, "extraction_method": method, "quality_notes": notes, "ingested_at": datetime(2031, 1, 1)}


def source(s, name="Northwind Life·Plan", insurer="Northwind", product=None):
    return {"source_id": s, "source_name": name, "insurer_family": insurer, "product_family": product, "registered_at": datetime(2031, 1, 1)}


def rows(df):
    return {tuple(r) for r in df.collect()}
