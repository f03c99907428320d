"""Explicit schemas of the stored tables, as DDL text."""

POST = (
    "_id STRING, tid STRING, author STRING, date STRING, lang STRING, content STRING, "
    "location STRING, sal STRING, score INT, tags STRING"
)
# Full post line; only these fields are ever read, so the JSON reader skips the rest.
POST_LINE = (
    "id STRING, value STRUCT<tags: STRING, tokens: STRING>, "
    "doc STRUCT<data: STRUCT<author_id: STRING, created_at: STRING, text: STRING>, "
    "includes: STRUCT<places: ARRAY<STRUCT<full_name: STRING>>>>"
)
# Pretty-printed post array.
POST_OBJECT = (
    "_id STRING, author_id STRING, created_at STRING, text STRING, full_name STRING"
)
STATUS = (
    "server STRING, id BIGINT, created_at TIMESTAMP, language STRING, content STRING, "
    "account STRUCT<id: BIGINT>, tags ARRAY<STRING>"
)
TOOT = (
    "server STRING, tid BIGINT, date STRING, author STRING, lang STRING, content STRING, "
    "score INT, tags STRING"
)
PLACE_VALUE = "STRUCT<ste: STRING, gcc: STRING, sal: STRING>"
VIEW_ROW = (
    "key ARRAY<STRING>, value STRUCT<sum: DOUBLE, count: BIGINT, min: DOUBLE, max: DOUBLE, sumsqr: DOUBLE>"
)

POST_COLUMNS = [field.split()[0] for field in POST.split(", ")]
