"""Fixed schemas of the store's tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _of(**fields) -> StructType:
    return StructType([StructField(n, t()) for n, t in fields.items()])


MEMORY = _of(
    id=StringType, memory_type=StringType, context=StringType, action=StringType, result=StringType, score=FloatType,
    embedding_context=BinaryType, embedding_action=BinaryType, embedding_result=BinaryType, indexed=BooleanType, tags=StringType,
    project=StringType, parent_id=StringType, source_ids=StringType, insight_type=StringType, created_at=StringType, updated_at=StringType,
    used_count=LongType, last_used_at=StringType, superseded_by=StringType,
)
FEEDBACK = _of(memory_id=StringType, query_id=StringType, searched_at=StringType, judged=BooleanType, judged_at=StringType)
ROUTING = _of(
    query_id=StringType, mode=StringType, search_strategy=StringType, llm_selection=StringType, contextualization=StringType,
    proactivity=StringType, top_k=IntegerType, shadow_rewards=StringType, created_at=StringType,
)
CONSOLIDATION = _of(id=StringType, action=StringType, memory_ids=StringType, reason=StringType, performed_at=StringType, performed_by=StringType)
Q_TABLE = _of(router_level=StringType, state=StringType, action=StringType, value=DoubleType, update_count=LongType, updated_at=StringType)
INSIGHT = _of(id=StringType, context=StringType, action=StringType, result=StringType, insight_type=StringType, source_ids=StringType, tags=StringType)
SCHEMA_META = _of(key=StringType, value=StringType)

# What the type columns may hold.
MEMORY_TYPES = ("decision", "pattern", "bugfix", "context", "antipattern", "insight")
INSIGHT_TYPES = ("cluster", "temporal", "causal")
STATUSES = ("pending", "accepted", "rejected")
#: Columns of the portable JSON form: no vectors, index flag or supersession.
PORTABLE = tuple(
    f for f in MEMORY.fieldNames() if not f.startswith("embedding_") and f not in ("indexed", "superseded_by")
)
