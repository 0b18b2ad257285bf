"""Chat formatting by schema fingerprints.

Records are JSON texts of any layout.  The nested field paths of a record (``messages[]``,
``messages[].role``, ...) are read off the schema of its parsed value, whatever the order
of keys and elements.  A mapping is a declaration of where roles and texts are.  It owns the
fingerprints (hashes of the sorted paths) of its required paths with every choice of its
optional ones; a record is its own if the fingerprint of those of the record's paths that the
mapping mentions is among them.  Of several mappings the one with most required paths is
selected and turns the record into canonical turns.

All of it runs in the JVM: parsing, schema, hash, selection and mapping are expressions;
no record is looked at by Python and nothing is shuffled.

Defined cases: text that is null, is no JSON object, or has a layout that no mapping
owns, or several with as many required paths do, gives one row with layout ``null``,
``invalid`` or ``unmapped`` and a null turn, so that no record is lost; fields beside the mapped ones are
ignored, whatever their names; a text that is an array is the texts of its parts (strings, or
objects with ``text``), joined by blank lines, other parts (images) are left out; a text that is an
object is none; turns whose text is null or blank are left out and the others numbered from 0; a
record of which no turn is left gives one row with its layout and a null turn;
unknown roles are kept as they are, in lower case; equal records give equal rows each.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Each:
    """Turns from the objects of an array: the fields that hold role and text."""

    array: str
    role: str
    text: str


@dataclass(frozen=True)
class Pairs:
    """User and assistant turns from an array of [question, answer]."""

    array: str


@dataclass(frozen=True)
class One:
    """A turn of a fixed role, its text the fields' texts joined by blank lines."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Mapping:
    name: str
    required: tuple[str, ...]
    turns: tuple[Each | Pairs | One, ...]
    optional: tuple[str, ...] = ()


def _list(name: str, role: str, text: str) -> tuple[str, ...]:
    return (name, f"{name}[]", f"{name}[].{role}", f"{name}[].{text}")


MAPPINGS = (
    Mapping("messages", _list("messages", "role", "content"), (One("system", ("system",)), Each("messages", "role", "content")), ("system",)),
    Mapping(
        "messages_parts", (*_list("messages", "role", "content"), "messages[].content[]", "messages[].content[].text"),
        (One("system", ("system",)), Each("messages", "role", "content")), ("system", "messages[].content[].type"),
    ),
    Mapping("sharegpt", _list("conversations", "from", "value"), (One("system", ("system",)), Each("conversations", "from", "value")), ("system",)),
    Mapping("dialog", _list("dialog", "speaker", "text"), (Each("dialog", "speaker", "text"),)),
    Mapping("instruction", ("instruction", "output"), (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))), ("system", "input")),
    Mapping("completion", ("prompt", "completion"), (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("completion",))), ("system",)),
    Mapping("response", ("prompt", "response"), (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response",))), ("system",)),
    Mapping("question", ("question", "answer"), (One("user", ("context", "question")), One("assistant", ("answer",))), ("context",)),
    Mapping("history", ("history", "history[]", "history[][]", "query", "response"), (One("system", ("system",)), Pairs("history"), One("user", ("query",)), One("assistant", ("response",))), ("system",)),
    Mapping("history_empty", ("history", "history[]", "query", "response"), (One("system", ("system",)), One("user", ("query",)), One("assistant", ("response",))), ("system",)),
)

def _said(value: Column) -> Column:
    """The text that a variant is: its own, or that of its parts."""
    of_part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.startswith(F.schema_of_variant(p), F.lit("STRING")), F.try_variant_get(p, "$", "string")))
    parts = F.try_variant_get(value, "$", "array<variant>")
    joined = F.array_join(F.filter(F.transform(parts, of_part), lambda t: F.nullif(t, F.lit("")).isNotNull()), "\n\n")
    plain = F.when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT<")), F.try_variant_get(value, "$", "string"))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY<")), joined).otherwise(plain)


_TURN = "struct<role:string,text:string>"


def field_paths(value: Column) -> Column:
    """The sorted distinct paths of a variant's fields and elements, from the text of its schema.

    Names are read as the schema writes them, so one with special signs is in back quotes.
    """
    schema = F.schema_of_variant(value)
    # names (with ": "), openings, closings and types, in order
    tokens = F.regexp_extract_all(schema, F.lit(r"((?:`(?:[^`]|``)*`|[^<>,:` ]+): |OBJECT<|ARRAY<|>|,|[A-Z]+(?:\([0-9,]+\))?)"), 1)
    start = F.struct(F.array(F.lit("")).cast("array<string>").alias("stack"), F.lit("").alias("here"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        top = F.element_at(s["stack"], -1)
        name = F.when(top == "", F.regexp_replace(t, ": $", "")).otherwise(F.concat(top, F.lit("."), F.regexp_replace(t, ": $", "")))
        item = F.concat(s["here"], F.lit("[]"))
        push = lambda x: F.concat(s["stack"], F.array(x))
        state = lambda stack, here, paths: F.struct(stack.alias("stack"), here.alias("here"), paths.alias("paths"))
        return (
            F.when(t == "OBJECT<", state(push(s["here"]), s["here"], s["paths"]))
            .when(t == "ARRAY<", state(push(item), item, F.concat(s["paths"], F.array(item))))
            .when(t == ">", state(F.slice(s["stack"], 1, F.size(s["stack"]) - 1), top, s["paths"]))
            .when(F.endswith(t, F.lit(": ")), state(s["stack"], name, F.concat(s["paths"], F.array(name))))
            .otherwise(s)
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["paths"])))


def fingerprint(paths: Column, mapping: Mapping) -> Column:
    """The hash of the paths that the mapping mentions."""
    known = sorted({*mapping.required, *mapping.optional})
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known)))), "\n"))


def registry(spark, mappings=MAPPINGS) -> dict[str, list[int]]:
    """The fingerprints that each mapping owns, for every choice of optional paths; two mappings can't own the same paths."""
    wanted: dict[str, str] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for some in itertools.combinations(m.optional, n):
                key = "\n".join(sorted({*m.required, *some}))
                if wanted.setdefault(key, m.name) != m.name:
                    raise ValueError(f"{m.name} and {wanted[key]} own the same paths")
    owned: dict[str, list[int]] = {}
    for fp, name in spark.createDataFrame(list(wanted.items()), "paths string, name string").select(F.xxhash64("paths"), "name").collect():
        owned.setdefault(name, []).append(fp)
    return owned


def select_mapping(paths: Column, owned: dict[str, list[int]], mappings=MAPPINGS) -> Column:
    """The name of the owner with most required paths, null without a single one."""
    none = F.lit(None).cast("struct<required:int,name:string>")
    each = [F.when(fingerprint(paths, m).isin(owned[m.name]), F.struct(F.lit(len(m.required)).alias("required"), F.lit(m.name).alias("name"))).otherwise(none) for m in mappings]
    found = F.filter(F.array(*each), lambda x: x.isNotNull())
    best = F.array_max(F.transform(found, lambda x: x["required"]))
    first = F.filter(found, lambda x: x["required"] == best)
    return F.when(F.size(first) == 1, F.try_element_at(first, F.lit(1))["name"])


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _turns(value: Column, source: Each | Pairs | One) -> Column:
    turn = lambda role, text: F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))
    if isinstance(source, One):
        texts = [F.nullif(_said(_get(value, f, "variant")), F.lit("")) for f in source.fields]
        return F.array(turn(F.lit(source.role), F.concat_ws("\n\n", *texts)))
    items = _get(value, source.array, "array<variant>")
    if isinstance(source, Each):
        return F.transform(items, lambda x: turn(_get(x, source.role, "string"), _said(_get(x, source.text, "variant"))))
    pair = lambda x, i: _said(F.try_variant_get(x, f"$[{i}]", "variant"))
    return F.flatten(F.transform(items, lambda x: F.array(turn(F.lit("user"), pair(x, 0)), turn(F.lit("assistant"), pair(x, 1)))))


def canonical(records: DataFrame, id_column: str, record: str = "record", mappings=MAPPINGS, roles: dict = ROLES) -> DataFrame:
    """(id, layout, turn, role, text) from JSON texts."""
    owned = registry(records.sparkSession, mappings)
    base = records.select(records[id_column].alias("id"), records[record].alias("raw")).withColumn("value", F.try_parse_json("raw"))
    is_object = F.startswith(F.schema_of_variant("value"), F.lit("OBJECT<"))
    layout = (
        F.when(F.col("raw").isNull(), F.lit("null")).when(F.col("value").isNull() | ~is_object, F.lit("invalid"))
        .otherwise(F.coalesce(F.when(is_object, select_mapping(F.col("paths"), owned, mappings)), F.lit("unmapped")))
    )
    marked = base.withColumn("paths", field_paths(F.col("value"))).withColumn("layout", layout)
    found = F.lit(None).cast(f"array<{_TURN}>")
    for m in mappings:
        parts = [F.coalesce(_turns(F.col("value"), t), F.array().cast(f"array<{_TURN}>")) for t in m.turns]
        found = F.when(F.col("layout") == m.name, F.concat(*parts)).otherwise(found)
    renamed = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    said = F.filter(found, lambda t: ~F.regexp_like(F.coalesce(t["text"], F.lit("")), F.lit(r"^\s*$")))
    lowered = F.transform(said, lambda t: F.struct(F.lower(F.trim(t["role"])).alias("role"), t["text"].alias("text")))
    clean = F.transform(lowered, lambda t: F.struct(F.coalesce(F.try_element_at(renamed, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))
    return marked.select("id", "layout", F.posexplode_outer(clean).alias("turn", "t")).select(F.col("id").alias(id_column), "layout", "turn", "t.role", "t.text")


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the conversations as JSON of the layouts that datasets come in, chosen by their turns and ids.

    A question with its answer, with a system turn before it or not, is written as instruction,
    completion, response or question by ``conv_id % 4``; others as messages, sharegpt or dialog by
    ``conv_id % 3``, every third of the messages with texts in parts.
    """
    c = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and text is not null")
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    g = grouped.withColumn("roles", F.array_join(F.transform("ts", lambda t: t["role"]), ","))
    text = lambda i: F.element_at("ts", i)["text"]
    each = lambda name, r, t: F.to_json(F.struct(F.col("conv_id").alias("id"), F.transform("ts", lambda x: F.struct(x["role"].alias(r), x["text"].alias(t))).alias(name)))
    alias = F.expr("transform(ts, x -> struct(case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end as `from`, x.text as value))")
    single, with_system, k = F.col("roles") == "user,assistant", F.col("roles") == "system,user,assistant", F.pmod("conv_id", F.lit(4))

    def flat(q: str, a: str) -> Column:
        return F.when(single, F.to_json(F.struct(text(1).alias(q), text(2).alias(a)))).otherwise(F.to_json(F.struct(text(1).alias("system"), text(2).alias(q), text(3).alias(a))))

    flat_layout = (
        F.when(k == 0, flat("instruction", "output")).when(k == 1, flat("prompt", "completion")).when(k == 2, flat("prompt", "response"))
        .otherwise(F.when(single, flat("question", "answer")).otherwise(flat("prompt", "completion")))
    )
    by = F.pmod("conv_id", F.lit(3))
    in_parts = F.to_json(F.struct(F.col("conv_id").alias("id"), F.transform("ts", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))).alias("messages")))
    listed = F.when(F.pmod("conv_id", F.lit(9)) == 0, in_parts).when(by == 0, each("messages", "role", "content")).when(by == 1, F.to_json(F.struct(F.col("conv_id").alias("id"), alias.alias("conversations")))).otherwise(each("dialog", "speaker", "text"))
    return g.select("conv_id", F.when(single | with_system, flat_layout).otherwise(listed).alias("record"))


def oracle() -> str:
    """canonical(as_records(conversations)) as DuckDB SQL on the turns."""
    return """
with c as (select conv_id, turn, role, text from conversations where conv_id is not null and text is not null),
g as (select conv_id, string_agg(role, ',' order by turn, role, text) as roles from c group by 1),
kept as (
  select conv_id, lower(trim(role)) as role, text, row_number() over (partition by conv_id order by turn, c.role, text) - 1 as turn
  from c where not regexp_matches(text, '^\\s*$'))
select conv_id,
  case when roles = 'user,assistant' then ['instruction', 'completion', 'response', 'question'][(conv_id % 4 + 4) % 4 + 1]
    when roles = 'system,user,assistant' then ['instruction', 'completion', 'response', 'completion'][(conv_id % 4 + 4) % 4 + 1]
    when conv_id % 9 = 0 then 'messages_parts'
    else ['messages', 'sharegpt', 'dialog'][(conv_id % 3 + 3) % 3 + 1] end as layout,
  kept.turn::integer as turn, kept.role as role, kept.text as text
from g left join kept using (conv_id)
"""
