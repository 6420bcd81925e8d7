"""JSON Schema compiled to Column expressions that give the failing paths of a row.

A schema becomes one expression over a VARIANT: no row leaves the JVM and no validator runs in Python. Supported: booleans as schemas, type, enum,
const, required, properties, additionalProperties, minProperties, items, prefixItems, minItems, maxItems, uniqueItems, contains, minLength, maxLength, pattern, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, multipleOf, if/then/else, dependentRequired, allOf, anyOf, oneOf, not, and $ref into the schema's own $defs (a definition may not hold itself). Any
other keyword that restricts values is an error at compile time, so nothing is passed over in silence. Annotations are ignored.
Patterns are in Java's dialect and match anywhere, as the standard has it.

Defined results: a null text, one that isn't JSON and one in which an object has a key twice fail at the root with keyword "json".
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAILURES = "array<struct<path: string, keyword: string>>"
#: Keywords that restrict nothing.
ANNOTATIONS = frozenset("$schema $id $comment $defs $anchor definitions title description default examples deprecated readOnly writeOnly format".split())


def failures(schema: dict | bool, text: Column) -> Column:
    """array of (path, keyword), in the schema's order, for what a JSON text breaks; empty if it is valid."""
    return failures_of(schema, F.try_parse_json(text))


def failures_of(schema: dict | bool, value: Column) -> Column:
    found = _Compiler(schema if isinstance(schema, dict) else {}).failures(schema, value, F.lit(""))
    return F.when(value.isNull(), _one(F.lit(""), "json")).otherwise(found)


def invalid(df: DataFrame, key: str, text: str, schema: dict | bool) -> DataFrame:
    """(key, path, keyword): a row for each thing that a row's JSON text breaks."""
    return df.select(key, F.explode(failures(schema, F.col(text))).alias("x")).select(key, "x.path", "x.keyword")


def split_valid(df: DataFrame, text: str, schema: dict | bool) -> tuple[DataFrame, DataFrame]:
    """(valid rows, counts (path, keyword, n) of what the others break); array places in paths are counted together as *."""
    judged = df.withColumn("_failures", failures(schema, F.col(text)))
    where = F.regexp_replace("x.path", r"/[0-9]+(?=/|$)", "/*").alias("path")
    counts = judged.select(F.explode("_failures").alias("x")).groupBy(where, F.col("x.keyword").alias("keyword")).agg(F.count("*").alias("n"))
    return judged.filter(F.size("_failures") == 0).drop("_failures"), counts


def envelope(failed: Column) -> Column:
    """What an entry point answers for failures instead of raising: status, detail (the first failure), and how many there are."""
    first = F.get(failed, F.lit(0))
    detail = F.when(F.size(failed) > 0, F.concat_ws(": ", F.when(first["path"] == "", "(root)").otherwise(first["path"]), first["keyword"]))
    return F.struct(F.when(F.size(failed) > 0, "invalid_input").otherwise("ok").alias("status"), detail.alias("detail"), F.size(failed).alias("n_failures"))


def _one(path: Column, keyword: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))).cast(_FAILURES)


def _none() -> Column:
    return F.array().cast(_FAILURES)


def _unless(ok: Column, path: Column, keyword: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(_one(path, keyword))


def _get(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def _member(v: Column, name: str) -> Column:
    """A member of an object; variant paths have no escapes, so odd names are looked up in a map."""
    if "'" in name or "\\" in name:
        return F.try_element_at(_get(v, "map<string,variant>"), F.lit(name))
    return _get(v, "variant", f"$['{name}']")


class _Compiler:
    def __init__(self, root: dict):
        self.root, self.open = root, []

    def failures(self, schema: dict | bool, v: Column, path: Column) -> Column:
        """Failures of a value that is there."""
        if isinstance(schema, bool):
            return _none() if schema else _one(path, "false")
        parts = []
        for word, arg in schema.items():
            if word in ANNOTATIONS or word in ("then", "else", "additionalProperties"):
                continue
            rule: Callable | None = getattr(self, f"_{word.strip('$')}", None)
            if rule is None:
                raise ValueError(f"no such keyword: {word}")
            parts.append(rule(arg, v, path, schema))
        if "additionalProperties" in schema:
            parts.append(self.additional(schema["additionalProperties"], v, path, schema))
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()

    def valid(self, schema: dict | bool, v: Column) -> Column:
        return F.size(self.failures(schema, v, F.lit(""))) == 0

    # what a value is
    def kind(self, v: Column) -> Column:
        return F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))

    def number(self, v: Column) -> Column:
        """The value of a number, null for anything else; what no double holds is compared as a double."""
        return F.when(self.kind(v).isin("bigint", "decimal", "double", "float", "int", "smallint", "tinyint"), _get(v, "double"))

    def is_a(self, name: str, v: Column) -> Column:
        kinds = {"object": ("object",), "array": ("array",), "string": ("string",), "boolean": ("boolean",), "null": ("void",)}
        if name in ("number", "integer"):
            n = self.number(v)
            return n.isNotNull() if name == "number" else F.coalesce(n == F.floor(n), F.lit(False))
        return self.kind(v).isin(*kinds[name])

    def text(self, v: Column) -> Column:
        return F.when(self.is_a("string", v), _get(v, "string"))

    def list(self, v: Column) -> Column:
        return F.when(self.is_a("array", v), _get(v, "array<variant>"))

    def map(self, v: Column) -> Column:
        return F.when(self.is_a("object", v), _get(v, "map<string,variant>"))

    def equals(self, v: Column, value) -> Column:
        if value is None:
            return self.is_a("null", v)
        if isinstance(value, bool):
            return self.is_a("boolean", v) & (_get(v, "boolean") == value)
        if isinstance(value, (int, float)):
            return F.coalesce(self.number(v) == float(value), F.lit(False))
        if isinstance(value, str):
            return F.coalesce(self.text(v) == value, F.lit(False))
        if isinstance(value, list):
            whole = self.list(v)
            return F.coalesce(F.size(whole) == len(value), F.lit(False)) & _all(*[F.coalesce(self.equals(F.get(whole, F.lit(i)), x), F.lit(False)) for i, x in enumerate(value)])
        return F.coalesce(F.size(self.map(v)) == len(value), F.lit(False)) & _all(*[F.coalesce(self.equals(_member(v, k), x), F.lit(False)) for k, x in value.items()])

    # any value
    def _type(self, arg, v, path, schema):
        return _unless(_any(*[self.is_a(x, v) for x in ([arg] if isinstance(arg, str) else arg)]), path, "type")

    def _enum(self, arg, v, path, schema):
        return _unless(_any(*[self.equals(v, x) for x in arg]), path, "enum")

    def _const(self, arg, v, path, schema):
        return _unless(self.equals(v, arg), path, "const")

    def _ref(self, arg, v, path, schema):
        if arg in self.open:
            raise ValueError(f"a definition that holds itself: {arg}")
        if not arg.startswith("#/"):
            raise ValueError(f"no such definition: {arg}")
        found = self.root
        for part in arg[2:].split("/"):
            found = found[part.replace("~1", "/").replace("~0", "~")]
        self.open.append(arg)
        try:
            return self.failures(found, v, path)
        finally:
            self.open.pop()

    def _allOf(self, arg, v, path, schema):  # noqa: N802
        return F.concat(*[self.failures(x, v, path) for x in arg])

    def _anyOf(self, arg, v, path, schema):  # noqa: N802
        return _unless(_any(*[self.valid(x, v) for x in arg]), path, "anyOf")

    def _oneOf(self, arg, v, path, schema):  # noqa: N802
        held = [self.valid(x, v).cast("int") for x in arg]
        return _unless(sum(held[1:], held[0]) == 1, path, "oneOf")

    def _not(self, arg, v, path, schema):
        return _unless(~self.valid(arg, v), path, "not")

    def _if(self, arg, v, path, schema):
        return F.when(self.valid(arg, v), self.failures(schema.get("then", True), v, path)).otherwise(self.failures(schema.get("else", True), v, path))

    # strings and numbers; values of other kinds aren't restricted
    def _bound(self, v: Column, ok: Column, path: Column, word: str) -> Column:
        return F.when(v.isNull(), _none()).otherwise(_unless(ok, path, word))

    def _minLength(self, arg, v, path, schema):  # noqa: N802
        return self._bound(s := self.text(v), F.length(s) >= arg, path, "minLength")

    def _maxLength(self, arg, v, path, schema):  # noqa: N802
        return self._bound(s := self.text(v), F.length(s) <= arg, path, "maxLength")

    def _pattern(self, arg, v, path, schema):
        return self._bound(s := self.text(v), s.rlike(arg), path, "pattern")

    def _minimum(self, arg, v, path, schema):
        return self._bound(n := self.number(v), n >= float(arg), path, "minimum")

    def _maximum(self, arg, v, path, schema):
        return self._bound(n := self.number(v), n <= float(arg), path, "maximum")

    def _exclusiveMinimum(self, arg, v, path, schema):  # noqa: N802
        return self._bound(n := self.number(v), n > float(arg), path, "exclusiveMinimum")

    def _exclusiveMaximum(self, arg, v, path, schema):  # noqa: N802
        return self._bound(n := self.number(v), n < float(arg), path, "exclusiveMaximum")

    def _multipleOf(self, arg, v, path, schema):  # noqa: N802
        return self._bound(n := self.number(v), n / float(arg) == F.floor(n / float(arg)), path, "multipleOf")

    # objects
    def _required(self, arg, v, path, schema):
        keys = F.map_keys(self.map(v))
        lost = [F.when(F.array_contains(keys, F.lit(x)), _none()).otherwise(_one(F.concat(path, F.lit(f"/{x}")), "required")) for x in arg]
        return F.when(keys.isNull(), _none()).otherwise(F.concat(_none(), *lost))

    def _dependentRequired(self, arg, v, path, schema):  # noqa: N802
        keys = F.map_keys(self.map(v))
        lost = [F.when(F.array_contains(keys, F.lit(x)), self._required(y, v, path, schema)).otherwise(_none()) for x, y in arg.items()]
        return F.when(keys.isNull(), _none()).otherwise(F.concat(_none(), *lost))

    def _properties(self, arg, v, path, schema):
        each = []
        for name, inner in arg.items():
            # a JSON null is a value, so what isn't there is told by its key
            there = _member(v, name)
            each.append(F.when(there.isNotNull(), self.failures(inner, there, F.concat(path, F.lit(f"/{name}")))).otherwise(_none()))
        return F.when(self.is_a("object", v), F.concat(_none(), *each)).otherwise(_none())

    def _minProperties(self, arg, v, path, schema):  # noqa: N802
        return self._bound(m := self.map(v), F.size(m) >= arg, path, "minProperties")

    def additional(self, arg, v, path, schema):
        known = list(schema.get("properties", {}))
        others = F.filter(F.map_entries(self.map(v)), lambda x: ~x["key"].isin(*known) if known else F.lit(True))
        if arg is True:
            return _none()
        if arg is False:
            each = F.transform(others, lambda x: F.struct(F.concat(path, F.lit("/"), x["key"]).alias("path"), F.lit("additionalProperties").alias("keyword")))
        else:
            each = F.flatten(F.transform(others, lambda x: self.failures(arg, x["value"], F.concat(path, F.lit("/"), x["key"]))))
        return F.coalesce(each, _none()).cast(_FAILURES)

    # arrays
    def _items(self, arg, v, path, schema):
        skip = len(schema.get("prefixItems", ()))
        each = F.transform(self.list(v), lambda x, i: F.when(i < skip, _none()).otherwise(self.failures(arg, x, F.concat(path, F.lit("/"), i.cast("string")))))
        return F.coalesce(F.flatten(each), _none())

    def _prefixItems(self, arg, v, path, schema):  # noqa: N802
        whole = self.list(v)
        each = [F.when(F.size(whole) > i, self.failures(x, F.get(whole, F.lit(i)), F.concat(path, F.lit(f"/{i}")))).otherwise(_none()) for i, x in enumerate(arg)]
        return F.when(whole.isNull(), _none()).otherwise(F.concat(_none(), *each))

    def _minItems(self, arg, v, path, schema):  # noqa: N802
        return self._bound(a := self.list(v), F.size(a) >= arg, path, "minItems")

    def _maxItems(self, arg, v, path, schema):  # noqa: N802
        return self._bound(a := self.list(v), F.size(a) <= arg, path, "maxItems")

    def _uniqueItems(self, arg, v, path, schema):  # noqa: N802
        texts = F.transform(self.list(v), lambda x: F.to_json(x))
        return self._bound(texts, (F.size(F.array_distinct(texts)) == F.size(texts)) | F.lit(not arg), path, "uniqueItems")

    def _contains(self, arg, v, path, schema):
        return self._bound(a := self.list(v), F.exists(a, lambda x: self.valid(arg, x)), path, "contains")


def _all(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out


def _any(*xs: Column) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x
    return out


def load(text: str) -> dict:
    """A schema from its JSON text."""
    return json.loads(text)
