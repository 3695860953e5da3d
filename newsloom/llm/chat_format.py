"""Chat formatting by schema fingerprints, natively.

A fingerprint is the hash of a record's nested field paths, without types or
order. It selects a declarative mapping, which says where a layout keeps its
turns; so prompt, instruction and message layouts all become the same
canonical turns. Typed tables are fingerprinted once from their schema,
semi-structured columns row by row.

Template, per turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
A control string inside a text gets one backslash after its first character
(one more, if it has some), which can be undone exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]"
_TURN = "array<struct<role:string,text:string>>"


def field_paths(schema: DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields; an array adds [] to its path."""
    if isinstance(schema, StructType):
        paths = []
        for field in schema.fields:
            paths += field_paths(field.dataType, f"{prefix}.{field.name}" if prefix else field.name)
        return paths
    if isinstance(schema, ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: name -> (field paths, turns as (role, path) in order, or the message array with its role and text fields).
LAYOUTS: dict[str, dict] = {
    "rows": {"paths": ["conv_id", "turn", "role", "text"], "rows": ("turn", "role", "text")},
    "prompt": {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "completion": {"paths": ["prompt", "completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "instruction": {"paths": ["instruction", "input", "output"],
                    "turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    "instruction_only": {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "messages": {"paths": ["messages[].role", "messages[].content"], "array": ("messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "array": ("conversations", "from", "value")},
}
#: other names of the canonical roles
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


class UnknownLayout(ValueError):
    """No mapping has the fingerprint of these field paths."""


def layout_of(paths: list[str], layouts: dict[str, dict] | None = None) -> dict:
    layouts = LAYOUTS if layouts is None else layouts
    by_print = {fingerprint(spec["paths"]): spec for spec in layouts.values()}
    try:
        return by_print[fingerprint(paths)]
    except KeyError:
        raise UnknownLayout(f"no mapping for the field paths {sorted(paths)}") from None


def canonical_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for name, canonical in ROLE_NAMES.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _message_turns(messages: Column, role: str, text: str) -> Column:
    return F.transform(messages, lambda m: _turn(canonical_role(m[role]), m[text]))


def typed_turns(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Canonical turns (id, turns) of a typed table in one of the layouts.

    Columns beside the layout's and the id are no part of the fingerprint only
    if the caller drops them first. Rows of the "rows" layout are gathered by
    id in the order of turn, role and text; nulls come first and count as
    empty. A layout's absent text (null) is a turn with an empty text, but a
    null "system" or "input" slot of an instruction record gives no turn.
    """
    paths = field_paths(df.drop(id_column).schema)
    rows_paths = [p for p in LAYOUTS["rows"]["paths"] if p != "conv_id"]
    if fingerprint(paths) == fingerprint(rows_paths):
        turn, role, text = LAYOUTS["rows"]["rows"]
        parts = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        gathered = df.groupBy(F.col(id_column)).agg(F.sort_array(F.collect_list(parts)).alias("turns"))
        return gathered.select(F.col(id_column), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    spec = layout_of(paths)
    if "array" in spec:
        field, role, text = spec["array"]
        turns = F.coalesce(_message_turns(F.col(field), role, text), F.array().cast(_TURN))
    else:
        slots = [F.when(F.lit(role == "assistant" or path == "prompt") | F.col(path).isNotNull(), _turn(F.lit(role), F.col(path))) for role, path in spec["turns"]]
        turns = F.filter(F.array(*slots), lambda t: t.isNotNull())
    return df.select(F.col(id_column), turns.cast(_TURN).alias("turns"))


def row_fingerprint(value: Column) -> Column:
    """Fingerprint of each variant value: its schema without the scalar types."""
    shape = F.regexp_replace(F.schema_of_variant(value), r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?", "")
    shape = F.regexp_replace(shape, r"ARRAY<(?!OBJECT<)[A-Z]+(\([0-9, ]*\))?>", "ARRAY")
    return F.sha2(shape, 256)


def _shape(spec: dict) -> str:
    """The erased schema that a record of the layout has."""
    if "array" in spec:
        field, role, text = spec["array"]
        return f"OBJECT<{field}: ARRAY<OBJECT<{', '.join(sorted((role, text)))}>>>"
    return f"OBJECT<{', '.join(sorted(spec['paths']))}>"


def mixed_turns(df: DataFrame, json_column: str, id_column: str = "conv_id") -> DataFrame:
    """(id, layout, turns) of JSON records of mixed layouts, each row by its own fingerprint.

    layout and turns are null where no mapping has the row's fingerprint, or
    where the JSON is malformed or null; such rows stay, to be counted.
    """
    value = F.try_parse_json(F.col(json_column))
    df = df.select(F.col(id_column), value.alias("_v")).withColumn("_print", row_fingerprint(F.col("_v")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURN)
    for name, spec in LAYOUTS.items():
        if "rows" in spec:
            continue
        same = F.col("_print") == hashlib.sha256(_shape(spec).encode()).hexdigest()
        if "array" in spec:
            field, role, text = spec["array"]
            parsed = F.try_variant_get("_v", f"$.{field}", f"array<struct<`{role}`:string,`{text}`:string>>")
            mapped = _message_turns(parsed, role, text)
        else:
            got = {path: F.try_variant_get("_v", f"$.{path}", "string") for _, path in spec["turns"]}
            slots = [F.when(F.lit(role == "assistant" or path == "prompt") | got[path].isNotNull(), _turn(F.lit(role), got[path])) for role, path in spec["turns"]]
            mapped = F.filter(F.array(*slots), lambda t: t.isNotNull())
        layout = F.when(same, name).otherwise(layout)
        turns = F.when(same, mapped.cast(_TURN)).otherwise(turns)
    return df.select(F.col(id_column), layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def _role_out(role: Column) -> Column:
    """One line: each backslash is followed by a letter that says what it stands for, so no two codes overlap."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))), "")


def read_back(text: Column) -> Column:
    """Canonical turns of a formatted conversation."""
    pieces = F.split(text, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(
        _role_in(F.substr(head(p), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substr(p, F.length(head(p)) + 2)).alias("text")))


def loss_spans(text: Column) -> Column:
    """(start, length) in code points of every assistant text inside the formatted conversation; starts from 0."""
    pieces = F.split(text, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    step = len(END) + 1
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    lead = START + "assistant\n"

    def add(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + len(lead)).alias("start"), (F.length(p) - len(lead)).cast("long").alias("length"))
        return F.struct((acc["at"] + F.length(p) + step).alias("at"),
                        F.when(F.startswith(p, F.lit(lead)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, zero, add, lambda acc: acc["spans"])


def format_conversations(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id, formatted, loss_spans) of a typed table in one of the layouts; loss is on the assistants' texts."""
    out = typed_turns(df, id_column).select(F.col(id_column), formatted(F.col("turns")).alias("formatted"))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted")))


def digests(chats: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """What op9 returns, computed from the formatted text and its loss spans alone."""
    turns = read_back(F.col("formatted"))
    chats = chats.withColumn("_turns", turns).withColumn(
        "_loss", F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    all_turns = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("_loss", "")
    return chats.select(
        F.col(id_column), F.size("_turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
