"""Explicit schemas of the dumps, the graph tables and the step log."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


def _list_of(tag: str, item: T.DataType) -> T.StructType:
    return _struct(**{tag: T.ArrayType(item)})


# <name id="7">text</name>; the reader calls attributes _x and the text _VALUE.
NAMED_LINK = _struct(_id=STRING, _VALUE=STRING)
CREDIT = _struct(id=STRING)
LISTED_LABEL = _struct(_id=STRING, _name=STRING)

# XML has no column pruning below the parser: keep these as narrow as the use.
ARTIST = _struct(
    id=STRING,
    name=STRING,
    realname=STRING,
    profile=STRING,
    aliases=_list_of("name", NAMED_LINK),
    members=_list_of("name", NAMED_LINK),
    _corrupt_record=STRING,
)
LABEL = _struct(
    id=STRING,
    name=STRING,
    profile=STRING,
    sublabels=_list_of("label", NAMED_LINK),
    _corrupt_record=STRING,
)
MASTER = _struct(main_release=STRING, _corrupt_record=STRING)
RELEASE = _struct(
    _id=STRING,
    title=STRING,
    released=STRING,
    artists=_list_of("artist", CREDIT),
    extraartists=_list_of("artist", CREDIT),
    labels=_list_of("label", LISTED_LABEL),
    _corrupt_record=STRING,
)
RECORDS = {"artist": ARTIST, "label": LABEL, "master": MASTER, "release": RELEASE}

NODES = _struct(
    space=STRING,
    kind=STRING,
    id=STRING,
    id_num=T.LongType(),
    title=STRING,
    name=STRING,
    realname=STRING,
    year=STRING,
    profile=STRING,
)
EDGES = _struct(
    type=STRING,
    src_space=STRING,
    src=STRING,
    dst_space=STRING,
    dst=STRING,
    ordinal=T.LongType(),
)
STEPS = _struct(
    n=T.IntegerType(),
    of=T.IntegerType(),
    name=STRING,
    state=STRING,
    elapsed=T.LongType(),
    ts=STRING,
    _corrupt_record=STRING,
)
