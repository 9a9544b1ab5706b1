r"""Chat formatting by schema fingerprints, in DataFrame expressions only.

A layout is known by the fingerprint of its nested field paths: the SHA-256 of the sorted paths,
types left out. The fingerprint selects a declarative :class:`Mapping`, which says where turns,
roles and texts lie; canonical turns are then rendered into one string a conversation::

    <turn role>text</turn>

Control strings all begin with ``<``. Inside roles and texts a backslash becomes ``\b`` and ``<``
becomes ``\l``, so no text can hold a control string, and reading back is exact: ``\l`` first, then
``\b``. The loss mask is a list of (start, length) spans, in code points of the formatted string,
that cover the assistant texts and nothing else.

Defined cases: null texts and roles count as empty, and a null turn number sorts first. Turns with
equal numbers follow each other by role, then text. Repeated rows are repeated turns. A table of rows may hold several layouts,
which :func:`turns_from_rows` tells row by row. A conversation
without turns does not occur in row layouts; a record whose list of messages is empty or null formats
to the empty string. Records with an unknown fingerprint come back from :func:`unmapped`. Extra
columns of a row table are ignored; extra fields of a record change its fingerprint on purpose.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MID, CLOSE = "<turn ", ">", "</turn>\n"
#: Scalar type names as a variant's schema has them, for taking the types out of a path list.
SCALARS = "BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|VOID|BINARY|DATE|UUID|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\\(\\d+,\\s*\\d+\\)"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. ``shape`` as :func:`variant_shape` or :func:`table_shape` writes it.

    kind "rows": a row a turn; ``order``, ``role`` and ``text`` are column names.
    kind "messages": ``list_path`` leads to an array, ``role`` and ``text`` are keys of its items.
    kind "fields": ``fields`` gives (role, path) pairs, one turn for each path that is not null or empty.
    """

    name: str
    shape: str
    kind: str
    order: str = ""
    role: str = ""
    text: str = ""
    list_path: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    #: Source role to canonical role; others stay as they are.
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.shape.encode()).hexdigest()


CHAT_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("turn_rows", "{conv_id,role,text,turn}", "rows", order="turn", role="role", text="text"),
    Mapping("sharegpt_rows", "{conv_id,from,turn,value}", "rows", order="turn", role="from", text="value", roles=CHAT_ROLES),
    Mapping("openai_messages", "{messages:[{content,role}]}", "messages", list_path="$.messages", role="role", text="content"),
    Mapping("sharegpt", "{conversations:[{from,value}]}", "messages", list_path="$.conversations", role="from", text="value", roles=CHAT_ROLES),
    Mapping("alpaca", "{input,instruction,output}", "fields", fields=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("instruction_output", "{instruction,output}", "fields", fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("prompt_completion", "{completion,prompt}", "fields", fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("system_prompt_response", "{prompt,response,system}", "fields", fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)


def table_shape(schema: T.DataType) -> str:
    """Sorted nested field paths of a schema, without types: ``{a,b:[{c}]}``."""
    if isinstance(schema, T.StructType):
        return "{" + ",".join(f.name + (":" + s if (s := table_shape(f.dataType)) else "") for f in sorted(schema.fields, key=lambda f: f.name)) + "}"
    return f"[{table_shape(schema.elementType)}]" if isinstance(schema, T.ArrayType) else ""


def variant_shape(v: Column) -> Column:
    """The same for each row's variant. Items of an array merge their fields; scalar arrays are ``[]``."""
    s = F.schema_of_variant(v)
    s = F.regexp_replace(s, f"(: |<)(?:{SCALARS})(?=[,>]|$)", "$1")
    for pattern, by in (("OBJECT<", "{"), ("ARRAY<", "["), (": ", ":"), (", ", ","), (":(?=[,>])", "")):
        s = F.regexp_replace(s, pattern, by)
    return s


def fingerprint(v: Column) -> Column:
    """The SHA-256 of a row's nested field paths, from a variant."""
    return F.sha2(normal_shape(variant_shape(v)), 256)


def normal_shape(s: Column) -> Column:
    """Closing marks of objects and arrays made alike, so that table and variant shapes compare."""
    return F.translate(s, "}]>", ">>>")


def shape_key(m: Mapping) -> str:
    return hashlib.sha256(m.shape.translate(str.maketrans("}]", ">>")).encode()).hexdigest()


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escaped_role(c: Column) -> Column:
    """A role ends at ``>``, which is therefore escaped there too."""
    return F.replace(escaped(c), F.lit(">"), F.lit("\\g"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def _role(m: Mapping, c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    out = c
    for a, b in m.roles:
        out = F.when(c == a, b).otherwise(out)
    return out


def _item_turn(m: Mapping):
    return lambda x: F.struct(_role(m, F.try_element_at(x, F.lit(m.role))).alias("role"), F.coalesce(F.try_element_at(x, F.lit(m.text)), F.lit("")).alias("text"))


def row_fingerprint(names: list[str]) -> Column:
    """64 bits of the sorted paths of the fields that a row has: those of ``names`` that are not null."""
    has = lambda n: F.when(F.col(n).isNotNull(), n)
    return F.xxhash64(F.concat_ws(",", *[has(n) for n in sorted(names)]))


def row_layouts(columns: list[str], mappings: tuple[Mapping, ...]) -> tuple[list[str], dict[frozenset[str], Mapping]]:
    """(names, layouts): the columns by which row layouts differ, and the layout of each set of them that a row can have: the one
    with most of its role and text there, of equal ones that listed first."""
    usable = [m for m in mappings if m.kind == "rows" and {m.order, m.role, m.text} <= set(columns)]
    names = sorted({c for m in usable for c in (m.order, m.role, m.text)})
    sets = [frozenset(n for i, n in enumerate(names) if bits >> i & 1) for bits in range(1 << len(names))] if usable else []
    return names, {s: max(usable, key=lambda m: len({m.role, m.text} & s)) for s in sets}


def turns_from_rows(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, turns) from a row a turn. The fingerprint of the fields that a row has selects its mapping, row by row: a table may hold several
    layouts, also within a conversation. Null roles and texts are fields that a row lacks, so that sets without them have
    mappings too. A row with the fields of two layouts is read by that listed first. A table without all columns of a row mapping is an error."""
    names, layouts = row_layouts(df.columns, mappings)
    if not layouts:
        raise ValueError(f"no row mapping for {table_shape(df.schema)}")
    used = list({m.name: m for m in layouts.values()}.values())
    order = df.schema[used[0].order].dataType.simpleString()
    turn_type = f"struct<o:{order},role:string,text:string>"
    by_print = F.create_map(*[x for s, m in layouts.items() for x in (F.xxhash64(F.lit(",".join(sorted(s)))), F.lit(m.name))])
    turn = F.lit(None).cast(turn_type)
    for m in used:
        own = F.struct(F.col(m.order).try_cast(order).alias("o"), _role(m, F.col(m.role)).alias("role"), F.coalesce(F.col(m.text), F.lit("")).alias("text"))
        turn = F.when(F.col("__layout") == m.name, own.cast(turn_type)).otherwise(turn)
    told = df.withColumn("__layout", F.element_at(by_print, row_fingerprint(names)))
    grouped = told.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(id_col, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def turns_from_records(df: DataFrame, id_col: str, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, turns) from a JSON record a row; each row's fingerprint selects its mapping.
    Rows whose fingerprint is unknown, or that are no JSON, have null ``layout`` and ``turns``."""
    df = df.select(F.col(id_col), F.try_parse_json(F.col(record)).alias("__v"))
    df = df.withColumn("__f", fingerprint(F.col("__v")))
    turn_type = "array<struct<role:string,text:string>>"
    turns, layout = F.lit(None).cast(turn_type), F.lit(None).cast("string")
    for m in (m for m in mappings if m.kind != "rows"):
        hit = F.col("__f") == shape_key(m)
        layout = F.when(hit, m.name).otherwise(layout)
        if m.kind == "messages":
            items = F.coalesce(F.try_variant_get("__v", m.list_path, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
            own = F.transform(items, _item_turn(m))
        else:
            parts = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.try_variant_get("__v", p, "string"), F.lit("")).alias("text")) for r, p in m.fields])
            own = F.filter(parts, lambda x: x["text"] != "")
        turns = F.when(hit, own.cast(turn_type)).otherwise(turns)
    return df.select(id_col, layout.alias("layout"), turns.alias("turns"))


def unmapped(df: DataFrame, record: str) -> DataFrame:
    """Fingerprints without a mapping, with their shape and count: what to write a mapping for."""
    known = [shape_key(m) for m in MAPPINGS]
    v = F.try_parse_json(F.col(record))
    return df.select(normal_shape(variant_shape(v)).alias("shape"), fingerprint(v).alias("fingerprint")).where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(known)).groupBy("fingerprint", "shape").count()


def formatted(turns: DataFrame) -> DataFrame:
    """(id, ..., turns) to (id, ..., formatted, loss_spans). Spans are cut from the pieces' lengths."""
    df = turns.withColumn("__p", F.transform("turns", lambda t: F.struct(escaped_role(t["role"]).alias("r"), escaped(t["text"]).alias("x"))))
    df = df.withColumn("formatted", F.array_join(F.transform("__p", lambda p: F.concat(F.lit(OPEN), p["r"], F.lit(MID), p["x"], F.lit(CLOSE))), ""))
    head, tail = len(OPEN) + len(MID), len(CLOSE)
    spans = F.aggregate(
        "__p",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("s")),
        lambda a, p: F.struct(
            (a["at"] + head + F.length(p["r"]) + F.length(p["x"]) + tail).alias("at"),
            F.when(p["r"] == "assistant", F.concat(a["s"], F.array(F.struct((a["at"] + head + F.length(p["r"])).cast("long").alias("start"), F.length(p["x"]).cast("long").alias("length")))))
            .otherwise(a["s"]).alias("s"),
        ),
        lambda a: a["s"],
    )
    return df.withColumn("loss_spans", spans).drop("__p", "turns")


def parsed(df: DataFrame) -> DataFrame:
    """Read formatted strings back: ``turns`` from the control strings, ``loss_text`` from the spans."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    head = "(?s)\\A<turn ([^>]*)>"
    turns = F.transform(pieces, lambda x: F.struct(unescaped(F.regexp_extract(x, head, 1)).alias("role"), unescaped(F.regexp_replace(x, head, "")).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return df.withColumn("turns", turns).withColumn("loss_text", loss)
