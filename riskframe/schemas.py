"""Table schemas.  Sources read with these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BUG = _struct(
    key=_S, summary=_S, description=_S, priority=_S, status=_S, component=_S,
    created=_S, updated=_S, assignee=_S, reporter=_S, resolution=_S,
    labels=T.ArrayType(_S),
)

METADATA = _struct(key=_S, summary=_S, priority=_S, status=_S, component=_S, created=_S)

INDEX = _struct(
    key=_S, document=_S, metadata=METADATA,
    doc_vec=T.ArrayType(T.FloatType()), query_vec=T.ArrayType(T.FloatType()),
)

RESULT = _struct(
    bug_key=_S, query=_S, risk_score=_I, risk_level=_S, reasoning=_S,
    affected_modules=T.ArrayType(_S), test_scenarios=T.ArrayType(_S),
    recommended_actions=T.ArrayType(_S), analyzed_at=_S, source=_S,
)

DENSITY = _struct(module=_S, bug_density=_D, total_bugs=_L, risk_score=_I, risk_level=_S)

#: Bugs by module, priority and, for recent ones, creation; ``batch`` is the last one counted.
COUNTS = _struct(module=_S, priority=_S, created=_S, bugs=_L, closed=_L, batch=_L)

#: Accepted successes per day, after and before the batch that was counted last.
DAYS = _struct(day=T.DateType(), used=_L, before=_L, batch=_L)

PII_MAP = _struct(original=_S, token=_S, category=_S, seq=_L)

REPLY = _struct(
    reasoning=_S, affected_modules=T.ArrayType(_S), test_scenarios=T.ArrayType(_S),
    recommended_actions=T.ArrayType(_S),
)

_NAMED = _struct(name=_S)
_PERSON = _struct(displayName=_S)

# ``description`` is kept as raw JSON text: it is either a string or a rich-text
# tree, and a recursive tree has no Spark type.
ISSUE_FIELDS = _struct(
    summary=_S, description=_S, priority=_NAMED, status=_NAMED,
    components=T.ArrayType(_NAMED), created=_S, updated=_S, assignee=_PERSON,
    reporter=_PERSON, resolution=_NAMED, labels=T.ArrayType(_S), issuetype=_NAMED,
)
ISSUE = _struct(key=_S, fields=ISSUE_FIELDS)
SEARCH_PAGE = _struct(issues=T.ArrayType(ISSUE), isLast=T.BooleanType(), nextPageToken=_S)
TRACKER_EVENT = _struct(webhookEvent=_S, issue=ISSUE)
