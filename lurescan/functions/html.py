"""HTML source to tokens, elements and text with built-in functions only.

A page is one row, so tokenising inside the projection needs no shuffle and no page is split. The
markup is read as written: comments and raw-text elements are honoured, implied tags are not added
and scripts are not run.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_TEXT = ["script", "style", "xmp", "iframe", "noembed", "noframes", "noscript"]
RAW_WITH_ENTITIES = ["title", "textarea"]

_ATTRS = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+"""
_RAW = "|".join(
    rf"<{t}(?:[\s/]{_ATTRS})?>.*?(?:</{t}\s*+>|\z)" for t in RAW_TEXT + RAW_WITH_ENTITIES
)
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<[!?][^>]*+>|{_RAW}|</[^>]*+>|<[a-z]{_ATTRS}>|[^<]++|<"
OPEN_TAG = rf"(?is)^<[a-z]{_ATTRS}>"
TAG_NAME = r"^<([a-zA-Z][^\s/>]*)"
ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def tokens(html: Column) -> Column:
    """Start tags, end tags, comments, text runs and whole raw-text elements, in page order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    """Lower-case element name of a start tag, '' for every other token."""
    return F.lower(F.regexp_extract(token, TAG_NAME, 1))


def raw_content(token: Column) -> Column:
    """Text between the tags of a raw-text element token."""
    inner = F.regexp_replace(token, OPEN_TAG, "")
    return F.regexp_replace(inner, r"(?is)</[a-z]+\s*+>\z", "")


def attributes(token: Column) -> Column:
    """``array<struct<name, value>>`` of a start tag, names in lower case."""
    inside = F.regexp_replace(
        F.regexp_replace(F.regexp_extract(token, OPEN_TAG, 0), r"^<[^\s/>]+", ""), r"/?>\z", ""
    )
    found = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0))

    def pair(text: Column) -> Column:
        value = F.regexp_replace(text, r"(?s)^[^=]*=?\s*", "")
        quoted = F.regexp_extract(value, r"""(?s)^(["'])(.*)\1$""", 2)
        return F.struct(
            F.lower(F.regexp_extract(text, r"^([^\s=]+)", 1)).alias("name"),
            F.when(value.rlike("^[\"']"), quoted).otherwise(value).alias("value"),
        )

    return F.transform(found, pair)


def nodes(token_array: Column) -> Column:
    """``array<struct<tag, token>>``: the tag is '' for anything but a start tag."""
    return F.transform(
        token_array, lambda t: F.struct(tag_name(t).alias("tag"), t.alias("token"))
    )


def elements(node_array: Column) -> Column:
    """``array<struct<tag, attrs>>`` of the start tags; a bare tag is not searched."""
    none = F.array().cast("array<struct<name:string,value:string>>")
    starts = F.filter(node_array, lambda n: n["tag"] != "")
    return F.transform(
        starts,
        lambda n: F.struct(
            n["tag"].alias("tag"),
            F.when(F.length(n["token"]) <= F.length(n["tag"]) + 3, none)
            .otherwise(attributes(n["token"]))
            .alias("attrs"),
        ),
    )


def attribute(element: Column, name: str) -> Column:
    """Value of an attribute, NULL if the element does not have it; the first one counts."""
    hits = F.filter(element["attrs"], lambda a: a["name"] == name)
    return F.get(F.transform(hits, lambda a: a["value"]), F.lit(0))


def _entity_table() -> Column:
    names = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def decode_entities(text: Column) -> Column:
    """Replace ``&name;``, ``&#65;`` and ``&#x41;``; unknown names stay as they are."""
    table = _entity_table()
    reference = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"

    def split_name(piece: Column) -> Column:
        return F.struct(
            F.regexp_extract(piece, reference, 1).alias("name"), piece.alias("piece")
        )

    def numeric(name: Column) -> Column:
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        known = F.when(F.length(digits) <= 7, digits)  # longer ones are beyond Unicode
        code = F.when(name.rlike("^#[xX]"), F.conv(known, 16, 10)).otherwise(known).try_cast("bigint")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, char).otherwise(F.lit("\ufffd"))

    def named(name: Column) -> Column:
        # the frequent names first, then the full table
        return (
            F.when(name == "amp", "&")
            .when(name == "lt", "<")
            .when(name == "gt", ">")
            .when(name == "quot", '"')
            .when(name == "nbsp", "\u00a0")
            .otherwise(F.try_element_at(table, name))
        )

    def decoded(item: Column) -> Column:
        name, piece = item["name"], item["piece"]
        char = F.when(name == "", F.lit(None)).otherwise(
            F.when(name.startswith("#"), numeric(name)).otherwise(named(name))
        )
        return F.coalesce(
            F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece))),
            F.concat(F.lit("&"), piece),
        )

    pieces = F.split(text, "&", -1)
    tail = F.transform(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), split_name), decoded)
    joined = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    return F.when(text.contains("&"), joined).otherwise(text)


def text_content(node_array: Column) -> Column:
    """Text of the nodes as a DOM gives it: raw-text elements count, entities are decoded."""

    def piece(node: Column) -> Column:
        tag, token = node["tag"], node["token"]
        return (
            F.when(~token.startswith("<") | (token == "<"), decode_entities(token))
            .when(tag.isin(RAW_TEXT), raw_content(token))
            .when(tag.isin(RAW_WITH_ENTITIES), decode_entities(raw_content(token)))
            .otherwise("")
        )

    return F.array_join(F.transform(node_array, piece), "")
