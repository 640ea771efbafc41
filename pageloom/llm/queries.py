"""Queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import boilerplate, charforms, consensus, encoding, grouping, overlap, packing, readability, scan, tokens

QUERIES = {
    f.__name__: f
    for f in (
        charforms.p1_found, charforms.p1_normalized,
        overlap.p2_found, overlap.p2_sources,
        grouping.p3_found, grouping.p3_splits,
        scan.p4_found, scan.p4_links, scan.p4_repaired,
        encoding.p5_found, encoding.p5_restored,
        boilerplate.p6_found, boilerplate.p6_families, boilerplate.p6_cleaned,
        consensus.p7_found, consensus.p7_reliability, consensus.p7_agreement,
        tokens.p8_ids, tokens.p8_offsets, tokens.p8_roundtrip,
        packing.p9_packed, packing.p9_fill,
        readability.p10_found, readability.p10_levels, readability.p10_profile,
    )
}
SQL = {**consensus.SQL, **grouping.SQL}
