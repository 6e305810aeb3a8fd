"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

_STR = T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


CATEGORY = _struct(("category", _STR), ("path", _STR), ("cat_idx", T.IntegerType()))

FEED_ITEM = _struct(
    ("category", _STR), ("pos", T.LongType()), ("href", _STR), ("timestamp", _STR)
)

PAGE = _struct(("page_id", T.LongType()), ("url", _STR), ("html", _STR))

LINK = _struct(("page_url", _STR), ("pos", T.IntegerType()), ("title", _STR), ("url", _STR))

RELATED_STORY = _struct(("title", _STR), ("url", _STR), ("content", _STR), ("date", _STR))

EXTERNAL_SOURCE = _struct(("title", _STR), ("url", _STR), ("content", _STR))

ENTITIES = _struct(
    ("skills", T.ArrayType(_STR)),
    ("companies", T.ArrayType(_STR)),
    ("keywords", T.ArrayType(_STR)),
)

ARTICLE = _struct(
    ("url", _STR),
    ("title", _STR),
    ("content", _STR),
    ("date", _STR),
    ("category", _STR),
    ("related_stories", T.ArrayType(RELATED_STORY)),
    ("external_sources", T.ArrayType(EXTERNAL_SOURCE)),
    ("entities", ENTITIES),
)

ARTICLE_V1 = _struct(("url", _STR), ("title", _STR), ("content", _STR))

RUN_STATE = _struct(("last_run", _STR))

COMMIT = _struct(("run", _STR), ("attempt", _STR), ("seq", T.LongType()), ("mark", _STR))

FEED_OBSERVATION = _struct(
    ("category", _STR), ("run", T.LongType()), ("step", T.LongType()), ("ts_text", _STR), ("observed_at", T.TimestampType())
)

# One row of the flat element table of a page; ``idx``..``last`` spans its descendants. Text
# ranges are [start, end) offsets in UTF-8 bytes into ``inner_text`` (t0, t1; p0, p1 for the
# parent) and ``walk_text`` (w0, w1). ``in_row`` tells that a row of a card holds the element.
DOM_ELEMENT = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("tag", _STR),
        T.StructField("cls", _STR),
        T.StructField("href", _STR),
        T.StructField("url", _STR),
        T.StructField("testid", _STR),
        T.StructField("dir", _STR),
        T.StructField("t0", T.IntegerType()),
        T.StructField("t1", T.IntegerType()),
        T.StructField("w0", T.IntegerType()),
        T.StructField("w1", T.IntegerType()),
        T.StructField("p0", T.IntegerType()),
        T.StructField("p1", T.IntegerType()),
        T.StructField("scrollable", T.BooleanType()),
        T.StructField("in_row", T.BooleanType()),
    ]
)

# What page parsing adds: ``inner_text`` is the text as displayed, ``bare_text`` the same
# without navigation (only where the page has no content element), ``walk_text`` the raw text
# with image names, ``strings`` the text nodes that mention a time.
DOM = T.StructType(
    [
        T.StructField("doc_title", _STR),
        T.StructField("inner_text", _STR),
        T.StructField("bare_text", _STR),
        T.StructField("walk_text", _STR),
        T.StructField("strings", T.ArrayType(_struct(("idx", T.IntegerType()), ("text", _STR)))),
        T.StructField("elements", T.ArrayType(DOM_ELEMENT)),
    ]
)
