"""Chat formatting by schema fingerprint.

The field paths that a mapping uses (sorted, scalar types left out) make the shape of a record or a table; the
shape's hash is the fingerprint that selects a declarative mapping to canonical turns, an array of (role, text).
Further keys and columns don't count.  Tables of one row per turn are such a layout too.  The template then writes

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>...

with a loss mask of (head, body, loss) code point counts per turn, and parse() reads it back.
Control strings inside roles and texts get an escape character after their first character; that
character itself is doubled, so unescaping restores every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The control strings of the template.
BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ESC = "␛"
_CONTROL = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>)"

#: Other names of roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _pairs(path: str, role: str, text: str) -> str:
    named = " ".join(f"when '{a}' then '{b}'" for a, b in ROLE_NAMES.items())
    return f"transform(variant_get(v, '$.{path}', 'array<struct<{role}:string,{text}:string>>'), x -> struct(case x.{role} {named} else x.{role} end as role, x.{text} as text))"


def _turns(*fields: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct('{role}' as role, variant_get(v, '$.{name}', 'string') as text)" for role, name in fields) + ")"


def _grouped(rows: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


#: Mappings, the first that fits counts: the scalar paths used, and what gives the turns: SQL over the variant `v` of a record, or a function of a table.
LAYOUTS: dict[str, tuple[tuple[str, ...], str | Callable[[DataFrame], DataFrame]]] = {
    "turn_rows": (("conv_id", "turn", "role", "text"), _grouped),
    "messages": (("messages[].role", "messages[].content"), _pairs("messages", "role", "content")),
    "from_value": (("conversations[].from", "conversations[].value"), _pairs("conversations", "from", "value")),
    "role_text": (("turns[].role", "turns[].text"), _pairs("turns", "role", "text")),
    "instruction_input": (
        ("instruction", "input", "output"),
        "array(struct('user' as role, concat_ws('\\n', variant_get(v, '$.instruction', 'string'), nullif(variant_get(v, '$.input', 'string'), '')) as text), struct('assistant' as role, variant_get(v, '$.output', 'string') as text))",
    ),
    "instruction": (("instruction", "output"), _turns(("user", "instruction"), ("assistant", "output"))),
    "system_prompt_response": (("system", "prompt", "response"), _turns(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "prompt_response": (("prompt", "response"), _turns(("user", "prompt"), ("assistant", "response"))),
    "prompt_completion": (("prompt", "completion"), _turns(("user", "prompt"), ("assistant", "completion"))),
    "question_answer": (("question", "answer"), _turns(("user", "question"), ("assistant", "answer"))),
}
#: The columns of a table with a row per turn.
TURN_ROWS = LAYOUTS["turn_rows"][0]


def _hash(kinds: dict[str, str | None]) -> str:
    return hashlib.sha256(", ".join(f"{p}: {kinds[p]}" for p in sorted(kinds) if kinds[p]).encode()).hexdigest()


#: What is looked up: fingerprint to layout.
FINGERPRINTS = {_hash(dict.fromkeys(paths, "_")): name for name, (paths, _) in LAYOUTS.items()}


def table_fingerprint(schema: T.StructType, paths: tuple[str, ...]) -> str:
    """Fingerprint of a table's columns as far as a mapping uses them."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    kinds = {f.name: "nested" if isinstance(f.dataType, nested) else "_" for f in schema.fields}
    return _hash({p: kinds.get(p) for p in paths})


def _kind(v: str) -> str:
    """SQL: _ for scalars, JSON null too; null if `v` is null (the path lacks)."""
    return f"case when schema_of_variant({v}) rlike '^(OBJECT|ARRAY)<|^VARIANT$' then 'nested' when {v} is not null then '_' end"


def fingerprint(v: str, paths: tuple[str, ...]) -> str:
    """SQL: fingerprint of variant `v` as far as a mapping uses its paths.

    A path in a list counts if some element has it and each that has it has a scalar there; all elements are objects or
    null.  Lists without an object count as having it.
    """
    parts = []
    for path in sorted(paths):
        top, _, field = path.partition("[].")
        if not field:
            kind = _kind(f"variant_get({v}, '$.{top}', 'variant')")
        else:
            inside = _kind(f"variant_get(e, '$.{field}', 'variant')")
            each = f"transform(try_variant_get({v}, '$.{top}', 'array<variant>'), e -> case when schema_of_variant(e) rlike '^OBJECT<' then struct(true as o, {inside} as k) when schema_of_variant(e) = 'VOID' then struct(false as o, cast(null as string) as k) else struct(true as o, 'scalar' as k) end)"
            kind = f"element_at(transform(array({each}), m -> case when m is null then null when not exists(m, x -> x.o) then '_' else nullif(array_join(array_sort(array_distinct(array_compact(transform(m, x -> x.k)))), '|'), '') end), 1)"
        parts.append(f"'{path}: ' || ({kind})")
    return f"sha2(concat_ws(', ', {', '.join(parts)}), 256)"


def canonical_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds layout (null if unknown) and turns (array of role, text) from a column of JSON records.

    Unknown layouts, invalid JSON and null records give null layout and null turns; they are kept so that the
    caller sees them.  A record with an empty list of turns gives an empty array.
    """
    known = records.withColumn("_v", F.expr(f"try_parse_json({record})"))
    of_records = {name: mapping for name, mapping in LAYOUTS.items() if isinstance(mapping[1], str)}
    named = F.create_map(*(F.lit(x) for item in FINGERPRINTS.items() if item[1] in of_records for x in item))
    # a layout's own paths may look like another's, so each is looked up for itself
    found = F.coalesce(*(F.when(named[F.expr(fingerprint("_v", paths))] == name, name) for name, (paths, _) in of_records.items()))
    known = known.withColumn("_layout", found)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (_, sql) in of_records.items():
        turns = F.when(F.col("_layout") == name, F.expr(sql.replace("variant_get(v,", "variant_get(_v,"))).otherwise(turns)
    return known.select(*records.columns, F.col("_layout").alias("layout"), turns.alias("turns"))


def canonical_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turns from a table with a row per turn, in order of turn (null first), then role, then text.

    The mapping is looked up by the fingerprint of the table's columns; columns that it doesn't use are let go.  Null
    roles and texts are empty.  A conversation's turns make one value, as its formatted text does.
    """
    for name, (paths, mapping) in LAYOUTS.items():
        if callable(mapping) and FINGERPRINTS.get(table_fingerprint(rows.schema, paths)) == name:
            return mapping(rows.select(*paths))
    raise ValueError(f"no layout has the columns {rows.schema.simpleString()}")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ESC, ESC * 2), _CONTROL, "$1" + ESC)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESC}({ESC}?)", "$1")


def format_turns(canonical: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Adds formatted (string) and mask (array of head, body, loss) to rows with turns.

    head and body are the code points of a turn's opening and of its escaped text; loss tells whether the body
    is learned from.  Null turns give nulls, no turns the bare opening.
    """
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(F.coalesce(t["role"], F.lit(""))), F.lit(CLOSE)).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (F.coalesce(t["role"], F.lit("")) == learn_from).alias("loss"),
        ),
    )
    out = canonical.withColumn("_parts", parts)
    text = F.concat(F.lit(BOS), F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(EOS))), ""))
    mask = F.transform("_parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["loss"].alias("loss")))
    return out.select(*canonical.columns, text.alias("formatted"), mask.alias("mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds parsed, an array of (role, text, learned): what the formatted text and its mask say."""
    whole = F.split(F.substr("formatted", F.lit(len(BOS) + 1)), EOS, -1)
    marked = formatted.withColumn("_turns", F.slice(whole, 1, F.size(whole) - 1))
    head = r"(?s)^\[INST\](.*?)\[/INST\](.*)$"
    parsed = F.zip_with(
        "_turns",
        "mask",
        lambda t, m: F.struct(
            unescape(F.regexp_extract(t, head, 1)).alias("role"),
            unescape(F.regexp_extract(t, head, 2)).alias("text"),
            F.when(m["loss"], unescape(F.substr(t, m["head"] + 1, m["body"]))).alias("learned"),
        ),
    )
    return marked.select(*formatted.columns, parsed.alias("parsed"))
