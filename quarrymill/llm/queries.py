"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

#: query name -> module that defines it
_WHERE = {
    "op1_minhash_fingerprints": "minhash",
    "op2_bucket_packing": "packing",
    "op3_flat_graph": "flat_graph",
    "op4_substring_dedup": "substring",
    "op5_hilbert_shards": "hilbert",
    "op6_token_rollup": "rollup",
    "op7_byte_bpe": "bpe",
    "op8_circulant_minhash": "circulant",
    "op9_warc_round_trip": "warc",
    "op10_quality_neighbours": "quality",
}

WORDS = r"[^\x20\x09-\x0D]+"


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


_OP9 = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d),
r AS (SELECT p.*, CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to FROM p LEFT JOIN f USING (d))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc_round_trip": _OP9.strip()}
