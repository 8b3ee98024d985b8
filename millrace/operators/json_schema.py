"""JSON Schema as one column: a schema compiles to an expression over VARIANT that lists what is wrong with a document.

Keywords: type, const, enum, required, properties, additionalProperties, minProperties, items, prefixItems, minItems,
maxItems, uniqueItems, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, format (date-time,
date), $ref to a place in the schema, allOf, anyOf, oneOf, not, if, then, else. Another keyword that would restrict a document
is an error when the schema is compiled, not passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "array<struct<path:string,message:string>>"
# Keywords that say nothing about a document.
NOTES = frozenset({"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "definitions", "then", "else"})
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
FORMATS = {"date": f"^{_DATE}$", "date-time": rf"^{_DATE}[Tt](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"}


def _none() -> Column:
    return F.array().cast(ERROR)


def _kind(v: Column) -> Column:
    """null, boolean, string, number, array or object; SQL null where there is nothing."""
    named = lambda t: (
        F.when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
        .when(t.isNotNull(), "number")
    )
    return F.get(F.transform(F.array(F.schema_of_variant(v)), named), 0)  # a variant is walked once, not for each name


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.flatten(F.transform(F.array(value), f))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def _same(v: Column, value: Any) -> Column:
    """Whether a variant is a JSON value; numbers by value."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce((_kind(v) == "number") & (_number(v) == float(value)), F.lit(False))
    return F.coalesce(F.to_json(v) == json.dumps(value, ensure_ascii=False, separators=(",", ":")), F.lit(False))


# Keywords that look at the kind of a value, and at its items.
KINDS = frozenset("type additionalProperties minProperties items prefixItems minItems maxItems minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength pattern format".split())
ITEMS = frozenset("items prefixItems minItems maxItems uniqueItems".split())


class Compiler:
    """Of a schema: the errors of a document as an array, or, with quick, only whether it has one. Most documents have none,
    and whether they have costs less than arrays of nothing."""

    def __init__(self, schema: dict, quick: bool = False):
        self.root, self.quick = schema, quick
        # of the value whose keywords are being compiled: its kind, its items and its named fields, each computed once
        self._k: Column | None = None
        self._all: Column | None = None
        self._fields: dict[str, Column] = {}

    def errors(self, v: Column, schema: dict | bool, path: Column) -> Column:
        """What is wrong with a variant that is there. v is named often: it is to be bound, not computed."""
        if isinstance(schema, bool):
            return self._fine() if schema else self._one(F.lit(True), path, "not allowed")
        keywords = [getattr(self, "_" + self._name(k)) for k in schema if k not in NOTES]
        if not keywords:
            return self._fine()
        names = list(dict.fromkeys([*schema.get("required", ()), *(n for n, below in schema.get("properties", {}).items() if self._restricts(below))]))
        known = [F.lit(0).alias("_")]
        known += [_field(v, n).alias(f"f{i}") for i, n in enumerate(names)]
        if ITEMS & set(schema):
            known.append(_items(v).alias("items"))
        late = KINDS & set(schema)

        def judged(x: Column | None, kind: Column | None) -> Column:
            before = self._k, self._all, self._fields
            self._k, self._all, self._fields = kind, None if x is None else x["items"], {n: x[f"f{i}"] for i, n in enumerate(names)}
            found = [check(v, schema, path) for check in keywords]
            self._k, self._all, self._fields = before
            return self._both(*found)

        def with_kind(x: Column | None) -> Column:
            if not late:
                return judged(x, None)
            kind = _kind(v)
            for n in reversed(range(len(names))):  # only an object has fields: one that has is not walked for its kind
                kind = F.when(x[f"f{n}"].isNotNull(), "object").otherwise(kind)
            return self._bound_to(kind, lambda k: judged(x, k))

        return self._bound_to(F.struct(*known), with_kind) if len(known) > 1 else with_kind(None)

    def _fine(self) -> Column:
        return F.lit(False) if self.quick else _none()

    def _both(self, *found: Column) -> Column:
        """All errors of the parts found."""
        if not found:
            return self._fine()
        if self.quick:
            out = found[0]
            for x in found[1:]:
                out = out | x
            return out
        return found[0] if len(found) == 1 else F.concat(*found)

    def _if(self, where: Column, found: Column) -> Column:
        """What is found, where it counts."""
        return F.when(where, found).otherwise(self._fine())

    def _any(self, values: Column, f: Callable[..., Column]) -> Column:
        """All errors of an array's items."""
        return F.array_contains(F.transform(values, f), True) if self.quick else F.flatten(F.transform(values, f))

    def _bound_to(self, value: Column, f: Callable[[Column], Column]) -> Column:
        """f(value), with the value computed once however often f names it."""
        return F.get(F.transform(F.array(value), f), 0) if self.quick else _once(value, f)

    @staticmethod
    def _restricts(schema: dict | bool) -> bool:
        return schema is False or (isinstance(schema, dict) and any(k not in NOTES for k in schema))

    def _name(self, keyword: str) -> str:
        name = {"$ref": "ref", "if": "if_then", "not": "is_not", "type": "is_type", "format": "of_format"}.get(keyword, keyword)
        if name.startswith("_") or not hasattr(self, "_" + name):
            raise ValueError(f"schema keyword {keyword!r} is not supported")
        return name

    def _one(self, broken: Column, path: Column, message: str | Column) -> Column:
        if self.quick:
            return F.coalesce(broken, F.lit(False))
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(path.alias("path"), text.alias("message")))).otherwise(_none())

    @staticmethod
    def _below(path: Column, name: str | Column) -> Column:
        step = F.lit(name) if isinstance(name, str) else name
        return F.when(path == "", step).otherwise(F.concat(path, F.lit("."), step))

    def _part(self, value: Column, schema: dict | bool, path: Column) -> Column:
        """What is wrong with a part of a document, where it has one; value is bound."""
        return self._if(value.isNotNull(), self.errors(value, schema, path))

    def _valid(self, v: Column, schema: dict | bool) -> Column:
        return ~Compiler(self.root, True).errors(v, schema, F.lit(""))

    def _ref(self, v, schema, path):
        at = self.root
        if not schema["$ref"].startswith("#"):
            raise ValueError(f"reference {schema['$ref']!r} leaves the schema")
        for step in schema["$ref"].lstrip("#").strip("/").split("/"):
            at = at[step.replace("~1", "/").replace("~0", "~")] if step else at
        return self.errors(v, at, path)

    def _is_type(self, v, schema, path):
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        whole = (self._k == "number") & (_number(v) == F.floor(_number(v)))
        fits = F.lit(False)
        for t in types:
            fits = fits | (whole if t == "integer" else self._k == t)
        return self._one(~fits, path, "is not of type " + ", ".join(types))

    def _const(self, v, schema, path):
        return self._one(~_same(v, schema["const"]), path, f"is not {json.dumps(schema['const'], ensure_ascii=False)}")

    def _enum(self, v, schema, path):
        texts = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"] if isinstance(x, bool) or not isinstance(x, (int, float))]
        fits = F.coalesce(F.to_json(v).isin(*texts), F.lit(False)) if texts else F.lit(False)
        for x in schema["enum"]:
            if isinstance(x, (int, float)) and not isinstance(x, bool):
                fits = fits | _same(v, x)
        return self._one(~fits, path, "is not one of " + json.dumps(schema["enum"], ensure_ascii=False))

    def _required(self, v, schema, path):
        complete = F.lit(True)
        for n in schema["required"]:
            complete = complete & self._fields[n].isNotNull()
        if self.quick:
            return self._if(~complete, _kind(v) == "object")
        absent = F.array_compact(F.array(*[F.when(self._fields[n].isNull(), F.lit(n)) for n in schema["required"]], F.lit(None).cast("string")))
        each = F.transform(absent, lambda n: F.struct(path.alias("path"), F.concat(n, F.lit(" is required")).alias("message")))
        return F.when(complete, _none()).when(_kind(v) == "object", each).otherwise(_none())

    def _properties(self, v, schema, path):
        fields = self._fields  # null where v is no object
        found = [self._part(fields[name], below, self._below(path, name)) for name, below in schema["properties"].items() if self._restricts(below)]
        return self._both(*found)

    def _additionalProperties(self, v, schema, path):  # noqa: N802
        below, known = schema["additionalProperties"], list(schema.get("properties", {}))
        fields = F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
        more = F.array_sort(fields, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)) if below is False and not self.quick else fields
        if known:
            more = F.filter(more, lambda e: ~e["key"].isin(*known))
        if below is False:
            each = F.size(more) > 0 if self.quick else F.transform(more, lambda e: F.struct(path.alias("path"), F.concat(e["key"], F.lit(" is not allowed")).alias("message")))
        else:
            each = self._any(more, lambda e: self.errors(e["value"], below, self._below(path, e["key"])))
        return self._if(self._k == "object", each)

    def _minProperties(self, v, schema, path):  # noqa: N802
        return self._one((self._k == "object") & (F.size(F.try_variant_get(v, "$", "map<string,variant>")) < schema["minProperties"]), path, f"has under {schema['minProperties']} properties")

    def _items(self, v, schema, path):
        first = len(schema.get("prefixItems", ()))
        each = self._any(self._all, lambda x, i: self._if(i >= first, self.errors(x, schema["items"], self._below(path, i.cast("string")))))
        return self._if(self._k == "array", each)

    def _prefixItems(self, v, schema, path):  # noqa: N802
        found, items = [], self._all
        for i, below in enumerate(schema["prefixItems"]):
            found.append(self._part(F.get(items, i), below, self._below(path, str(i))))
        return self._if(self._k == "array", self._both(*found))

    def _minItems(self, v, schema, path):  # noqa: N802
        return self._one((self._k == "array") & (F.size(self._all) < schema["minItems"]), path, f"has under {schema['minItems']} items")

    def _maxItems(self, v, schema, path):  # noqa: N802
        return self._one((self._k == "array") & (F.size(self._all) > schema["maxItems"]), path, f"has over {schema['maxItems']} items")

    def _uniqueItems(self, v, schema, path):  # noqa: N802
        texts = F.transform(self._all, lambda x: F.to_json(x))
        return self._one(F.lit(bool(schema["uniqueItems"])) & (F.size(F.array_distinct(texts)) < F.size(texts)), path, "has equal items")

    def _bound(self, v, path, wrong: Callable[[Column], Column], message: str):
        return self._one((self._k == "number") & wrong(_number(v)), path, message)

    def _minimum(self, v, schema, path):
        return self._bound(v, path, lambda x: x < schema["minimum"], f"is below {schema['minimum']}")

    def _maximum(self, v, schema, path):
        return self._bound(v, path, lambda x: x > schema["maximum"], f"is above {schema['maximum']}")

    def _exclusiveMinimum(self, v, schema, path):  # noqa: N802
        return self._bound(v, path, lambda x: x <= schema["exclusiveMinimum"], f"is not above {schema['exclusiveMinimum']}")

    def _exclusiveMaximum(self, v, schema, path):  # noqa: N802
        return self._bound(v, path, lambda x: x >= schema["exclusiveMaximum"], f"is not below {schema['exclusiveMaximum']}")

    def _text(self, v, path, wrong: Callable[[Column], Column], message: str):
        return self._one((self._k == "string") & wrong(F.try_variant_get(v, "$", "string")), path, message)

    def _minLength(self, v, schema, path):  # noqa: N802
        return self._text(v, path, lambda x: F.char_length(x) < schema["minLength"], f"is shorter than {schema['minLength']}")

    def _maxLength(self, v, schema, path):  # noqa: N802
        return self._text(v, path, lambda x: F.char_length(x) > schema["maxLength"], f"is longer than {schema['maxLength']}")

    def _pattern(self, v, schema, path):
        return self._text(v, path, lambda x: ~x.rlike(schema["pattern"]), f"does not match {schema['pattern']}")

    def _of_format(self, v, schema, path):
        if schema["format"] not in FORMATS:
            raise ValueError(f"format {schema['format']!r} is not supported")
        return self._text(v, path, lambda x: ~x.rlike(FORMATS[schema["format"]]), f"is not a {schema['format']}")

    def _allOf(self, v, schema, path):  # noqa: N802
        return self._both(*[self.errors(v, s, path) for s in schema["allOf"]])

    def _matches(self, v, options) -> Column:
        n = F.lit(0)
        for s in options:
            n = n + self._valid(v, s).cast("int")
        return n

    def _anyOf(self, v, schema, path):  # noqa: N802
        return self._one(self._matches(v, schema["anyOf"]) == 0, path, "fits none of the forms")

    def _oneOf(self, v, schema, path):  # noqa: N802
        return self._one(self._matches(v, schema["oneOf"]) != 1, path, "does not fit exactly one of the forms")

    def _is_not(self, v, schema, path):
        return self._one(self._valid(v, schema["not"]), path, "has a form that is not allowed")

    def _if_then(self, v, schema, path):
        then, other = (self.errors(v, schema[k], path) if k in schema else self._fine() for k in ("then", "else"))
        return F.when(self._valid(v, schema["if"]), then).otherwise(other)


def schema_errors(document: Column, schema: dict, show: int = 5) -> Column:
    """The first `show` errors of a JSON text, ordered by path and message, as structs (path, message); an empty array if it
    is valid. The path of the document itself is empty. A text that is null or no JSON has the one error `is no JSON`."""
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("is no JSON").alias("message")))
    one, every = Compiler(schema, quick=True), Compiler(schema)
    judged = lambda v: F.when(v.isNull(), broken).when(one.errors(v, schema, F.lit("")), every.errors(v, schema, F.lit(""))).otherwise(_none())
    return F.slice(F.sort_array(_once(F.try_parse_json(document), judged)).cast(ERROR), 1, show)


def invalid_documents(rows: DataFrame, key: str, document: str, schema: dict, show: int = 5) -> DataFrame:
    """key, errors of rows whose document breaks the schema, in one pass."""
    checked = rows.select(key, schema_errors(F.col(document).cast("string"), schema, show).alias("errors"))
    return checked.where(F.size("errors") > 0)
