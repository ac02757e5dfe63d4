"""Queries of the training-data operators, by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from waymark.llm.bytepairs import op11_bytepairs
from waymark.llm.decontaminate import op9_decontaminate
from waymark.llm.htmltext import op10_htmltext
from waymark.llm.langid import op7_langid
from waymark.llm.lempelziv import op8_lempelziv
from waymark.llm.licenses import op4_licenses
from waymark.llm.negatives import SQL as NEGATIVES_SQL
from waymark.llm.negatives import op12_negatives
from waymark.llm.packing import op5_packing
from waymark.llm.pii import op1_pii
from waymark.llm.sharding import op6_sharding
from waymark.llm.simhash import op2_simhash
from waymark.llm.urls import op3_urls
from waymark.llm.variants import op13_variants

QUERIES = {f.__name__: f for f in (op1_pii, op2_simhash, op3_urls, op4_licenses, op5_packing, op6_sharding, op7_langid, op8_lempelziv, op9_decontaminate, op10_htmltext, op11_bytepairs, op12_negatives, op13_variants)}
ORACLE_SQL: dict[str, str] = {"op12_negatives": NEGATIVES_SQL}
