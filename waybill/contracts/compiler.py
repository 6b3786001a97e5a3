"""JSON Schema to Spark columns: a row's violations without a UDF.

A payload is parsed into a struct of VARIANTs, one for each field that any
contract names at the top, in which a missing field and a JSON null can be told
apart and values keep their JSON types.  ``with_facts`` adds one column of each
kind for each path; the violations are then cheap conditions on these columns,
however many contracts are active.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
#: The variant schemas that are of a JSON type as a whole, and those that begin like one.
_EXACT = {"null": ("VOID",), "string": ("STRING",), "boolean": ("BOOLEAN",), "number": _NUMBERS}
_BEGIN = {"object": "OBJECT<", "array": "ARRAY<", "number": "DECIMAL("}


def _name(prefix: str, path: str) -> str:
    return f"_{prefix}_{path.replace('$', 'root').replace('.', '__')}"


def _walk(schema: dict, path: str = "$") -> Iterable[tuple[str, dict]]:
    yield path, schema
    for name, inner in schema.get("properties", {}).items():
        yield from _walk(inner, f"{path}.{name}")


def _text(value: object) -> str:
    """A string as SQL."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: Iterable[object]) -> str:
    return ", ".join(map(_text, values))


def _is(stated: str, kinds: Iterable[str]) -> str:
    """SQL: whether a variant schema is of one of the JSON types."""
    kinds = list(kinds)
    # An empty object or array has no elements to name.
    exact = [x for k in kinds for x in _EXACT.get(k, (k.upper(),))]
    return "(" + " OR ".join([f"{stated} IN ({_list(exact)})", *[f"startswith({stated}, {_text(_BEGIN[k])})" for k in kinds if k in _BEGIN]]) + ")"


def _kind(stated: str) -> str:
    """SQL: the JSON type of a value by its variant schema, for messages."""
    kinds = ("null", "object", "array", "string", "boolean", "number")
    return f"CASE WHEN {stated} IS NULL THEN 'no JSON' " + " ".join(f"WHEN {_is(stated, [k])} THEN '{k}'" for k in kinds) + " ELSE 'other' END"


def once(column: Column) -> Column:
    """``column``, kept from being computed again above.

    The condition always holds, but the optimizer takes it for changing, so it
    pushes no filter below the projection that has it and merges it with none.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def with_facts(records: DataFrame, raw: str, schemas: Iterable[dict]) -> DataFrame:
    """``records`` with ``fields`` and, for each path, its variant schema (_s), text (_t), number (_n) and keys (_f) as needed."""
    nodes: dict[str, list[dict]] = {}
    for schema in schemas:
        for path, node in _walk(schema):
            nodes.setdefault(path, []).append(node)
    top = sorted(p[2:] for p in nodes if p.count(".") == 1)
    parsed = F.from_json(raw, "struct<" + ",".join(f"`{x}`: variant" for x in top) + ">")
    keys = F.when(F.try_parse_json(raw).isNotNull(), F.json_object_keys(raw))
    out = records.select("*", once(parsed).alias("fields"), once(keys).alias(_name("f", "$")))
    found = [F.when(F.col(_name("f", "$")).isNotNull(), F.lit("OBJECT")).otherwise(F.schema_of_variant(F.try_parse_json(raw))).alias(_name("s", "$"))]
    for path, specs in nodes.items():
        if path == "$":
            continue
        name, _, rest = path[2:].partition(".")
        value = F.variant_get(F.col("fields")[name], f"$.{rest}", "variant") if rest else F.col("fields")[name]
        found.append(once(F.schema_of_variant(value)).alias(_name("s", path)))
        if any("enum" in s or "minLength" in s for s in specs):
            found.append(F.try_variant_get(value, "$", "string").alias(_name("t", path)))
        if any("minimum" in s or "maximum" in s for s in specs):
            found.append(F.try_variant_get(value, "$", "double").alias(_name("n", path)))
        if any(s.get("additionalProperties") is False for s in specs):
            found.append(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")).alias(_name("f", path)))
    return out.select("*", *found)


def violations(schema: dict, path: str = "$") -> list[str]:
    """SQL over the facts, one expression a rule, that gives a violation's text or null.

    As text they can be told apart and parsed together, which takes a fraction of
    the time that building them column by column does.
    """
    found: list[str] = []

    def rule(broken: str, *said: str) -> None:
        found.append(f"CASE WHEN {broken} THEN concat({', '.join(said)}) END")

    stated, text, number = (f"`{_name(x, path)}`" for x in "stn")
    types = schema.get("type")
    if types:
        types = [types] if isinstance(types, str) else types
        missing = "true" if path == "$" else "false"
        rule(f"coalesce(NOT {_is(stated, types)}, {missing})", _text(f"{path}: expected {' or '.join(types)}, found "), _kind(stated))
    if "enum" in schema:
        rule(f"{stated} = 'STRING' AND {text} NOT IN ({_list(x for x in schema['enum'] if x is not None)})", _text(f"{path}: not an accepted value: "), text)
    if "minLength" in schema:
        rule(f"{stated} = 'STRING' AND length({text}) < {schema['minLength']}", _text(f"{path}: shorter than {schema['minLength']}"))
    if "minimum" in schema:
        rule(f"{number} < {schema['minimum']} AND {_is(stated, ['number'])}", _text(f"{path}: under minimum {schema['minimum']}"))
    if "maximum" in schema:
        rule(f"{number} > {schema['maximum']} AND {_is(stated, ['number'])}", _text(f"{path}: above maximum {schema['maximum']}"))
    if "properties" in schema:
        is_object = _is(stated, ["object"])
        for name in schema.get("required", []):
            inner = _name("s", f"{path}.{name}")
            rule(f"{is_object} AND `{inner}` IS NULL", _text(f"{path}: missing field '{name}'"))
        if schema.get("additionalProperties") is False:
            extra = f"array_except(`{_name('f', path)}`, array({_list(schema['properties'])}))"
            rule(f"{is_object} AND size({extra}) > 0", _text(f"{path}: unexpected field '"), f"array_join(sort_array({extra}), '\\', \\'')", _text("'"))
        for name, inner in schema["properties"].items():
            found += violations(inner, f"{path}.{name}")
    return found


def collected(found: list[str], shared: str = "array()") -> Column:
    """The violations of a row, in order of their paths; ``shared`` is an array of some."""
    return F.expr(f"sort_array(concat({shared}, array_compact(array({', '.join(found)}))))") if found else F.expr(f"sort_array({shared})")


def leftover(mapping: dict[str, str]) -> Column:
    """What the mapping to v1 can't move: a container that is there but null stays behind."""
    containers = sorted({p.split(".")[0] for p in mapping})
    told = [f"WHEN `{_name('s', '$.' + c)}` = 'VOID' THEN {_text(f"post-mapping v1 violation: $: unexpected field '{c}'")}" for c in containers]
    return F.expr(f"CASE {' '.join(told)} END") if told else F.lit(None).cast("string")


def canonical_path(target: str, mapping: dict[str, str]) -> str:
    """Where a version keeps what v1 calls ``target``."""
    return next((source for source, to in mapping.items() if to == target), target)


def facts_of(schema: dict, path: str = "", required: bool = True) -> dict[str, dict]:
    """What a contract promises of each path below the root: required, types, values and bounds."""
    found = {}
    if path:
        types = schema.get("type", [])
        found[path] = {"required": required, "types": {types} if isinstance(types, str) else set(types), "values": set(schema["enum"]) if "enum" in schema else None, "least": schema.get("minimum", schema.get("minLength")), "most": schema.get("maximum")}
    for name, inner in schema.get("properties", {}).items():
        found |= facts_of(inner, f"{path}.{name}" if path else name, name in schema.get("required", []))
    return found


def loosened(was: dict, now: dict) -> list[str]:
    """In which ways a path may hold now what it could not hold before."""
    found = []
    if was["required"] and not now["required"]:
        found.append("no longer required")
    if was["types"] and (more := (now["types"] - was["types"]) or (set() if now["types"] else {"anything"})):
        found.append(f"may be {', '.join(sorted(more))}")
    if was["values"] is not None and (now["values"] is None or now["values"] - was["values"]):
        found.append("new values")
    if was["least"] is not None and (now["least"] is None or now["least"] < was["least"]) or was["most"] is not None and (now["most"] is None or now["most"] > was["most"]):
        found.append("wider bounds")
    return found
