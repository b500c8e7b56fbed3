"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from vigil.llm.alignment import op12_alignment
from vigil.llm.chat import OP10_SQL, op10_chat_formatting
from vigil.llm.collocations import OP11_SQL, op11_collocations
from vigil.llm.cotraining import op2_quality_classifier
from vigil.llm.html import op6_html_extraction
from vigil.llm.lm import op8_lm_scoring
from vigil.llm.minhash import op5_minhash
from vigil.llm.packing import op7_packing
from vigil.llm.sanitise import op13_pii
from vigil.llm.secrets import op1_secret_scans
from vigil.llm.sharding import op9_sharding
from vigil.llm.spaced import op4_decontamination
from vigil.llm.vectors import op3_embedding_dedup

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_minhash": op5_minhash,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_pii": op13_pii,
}

#: Links by cosine of all pairs, then reachability.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM u WHERE u.a = c.vec_id) AS n_links, component_id,
  c.vec_id = component_id AS kept
FROM c
"""

SQL = {"op3_embedding_dedup": OP3_SQL, "op10_chat_formatting": OP10_SQL, "op11_collocations": OP11_SQL}
