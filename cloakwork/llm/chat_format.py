"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is a JSON object, or a struct, in any of several layouts (messages, conversations,
prompt and response, instruction with input and output). Its nested field paths,
without types, are hashed to a fingerprint; the fingerprint selects a declarative
mapping (LAYOUTS) that gives canonical turns (role, text). Structs have one fingerprint, that
of their schema, so rows of turns are never parsed. Turns become one string
under a template that marks them; control strings inside texts are escaped so
that reading the output back gives every text unchanged. The loss mask is the
code point ranges of assistant texts in that string.

Nulls and odd input: a null text or role is empty; a record of an unknown layout
or with broken JSON has null turns and layout 'unknown' and stays in the result; JSON too large
to be parsed is an error;
no turns give an empty string; turns with equal numbers are ordered by role, then
text; repeated rows are turns of their own; a row with a null conversation id is a
conversation of its own; an empty table gives an empty result; other columns are ignored.
A conversation is one output string, so one conversation is what a task must hold; a text may be as long as
a string can be.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"

# Fixed expressions over a record: name, field paths, JSON schema, and turns from the parsed record `r`.
_ROLES = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {0} END"
_TURN = "named_struct('role', {0}, 'text', coalesce({1}, ''))"
LAYOUTS = [
    ("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "messages array<struct<role string, content string>>", f"transform(r.messages, m -> {_TURN.format("coalesce(m.role, '')", 'm.content')})"),
    ("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "conversations array<struct<from string, value string>>", f"transform(r.conversations, m -> {_TURN.format(_ROLES.format("coalesce(m.from, '')"), 'm.value')})"),
    ("prompt_response", "OBJECT<prompt, response>", "prompt string, response string", f"array({_TURN.format("'user'", 'r.prompt')}, {_TURN.format("'assistant'", 'r.response')})"),
    ("prompt_completion", "OBJECT<completion, prompt>", "prompt string, completion string", f"array({_TURN.format("'user'", 'r.prompt')}, {_TURN.format("'assistant'", 'r.completion')})"),
    ("instruction", "OBJECT<instruction, output>", "instruction string, output string", f"array({_TURN.format("'user'", 'r.instruction')}, {_TURN.format("'assistant'", 'r.output')})"),
    ("instruction_input", "OBJECT<input, instruction, output>", "instruction string, input string, output string", f"array({_TURN.format("'user'", "concat(r.instruction, if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input)))")}, {_TURN.format("'assistant'", 'r.output')})"),
    ("question_answer", "OBJECT<data: OBJECT<answer, question>>", "data struct<question string, answer string>", f"array({_TURN.format("'user'", 'r.data.question')}, {_TURN.format("'assistant'", 'r.data.answer')})"),
]
#: Layouts whose list of turns is empty.
EMPTY = {"OBJECT<messages: ARRAY<VOID>>": "messages", "OBJECT<conversations: ARRAY<VOID>>": "conversations"}


#: A variant has at most 2**27 bytes, up to four a byte of JSON: what gives none from here on may be whole JSON.
LARGE_JSON = 1 << 25
#: The parser's own limit on a string is 20,000,000 characters.
LONG_STRINGS = {"maxStringLen": str((1 << 31) - 1)}


def fingerprint(record: Column) -> Column:
    """A hash of the record's nested field paths; leaf types don't take part, except for empty lists."""
    parsed = F.from_json(record, "variant", LONG_STRINGS)
    size = F.octet_length(record)
    too_large = F.concat(F.lit("chat record of "), size.cast("string"), F.lit(" bytes of JSON is broken or too large to be parsed; give it as a struct"))
    parsed = F.coalesce(parsed, F.when(size >= LARGE_JSON, F.raise_error(too_large).cast("variant")))
    paths = F.regexp_replace(F.schema_of_variant(parsed), r": (STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP|DECIMAL\([0-9,]*\))(?=[,>])", "")
    return F.sha2(paths, 256)


def _hash(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()


def schema_paths(kind: T.DataType) -> str:
    """The nested field paths of a type, as LAYOUTS writes them."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{schema_paths(kind.elementType) or 'VOID'}>"
    if not isinstance(kind, T.StructType):
        return ""
    held = sorted((f.name, schema_paths(f.dataType)) for f in kind.fields)
    return f"OBJECT<{', '.join(n + (': ' + p if p else '') for n, p in held)}>"


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """records with `layout` and `turns` in place of the column of JSON or structs."""
    if isinstance(records.schema[column].dataType, T.StructType):
        paths = schema_paths(records.schema[column].dataType)
        name, turns = next(((n, F.expr(e.replace("r.", f"`{column}`."))) for n, p, _, e in LAYOUTS if p == paths), ("unknown", F.lit(None)))
        here = F.col(column).isNotNull()
        return records.select(*[c for c in records.columns if c not in (column, "layout", "turns")], F.when(here, name).otherwise("unknown").alias("layout"), F.when(here, turns).cast(TURNS).alias("turns"))
    marked = records.withColumn("fingerprint", fingerprint(F.col(column)))
    layout, turns = F, F.lit(None).cast(TURNS)
    named = F.lit("unknown")
    for name, paths, schema, expression in LAYOUTS:
        hashes = [_hash(paths), *(_hash(p) for p, n in EMPTY.items() if n == name)]
        here = F.col("fingerprint").isin(hashes)
        named = F.when(here, name).otherwise(named)
        parsed = f"`__{name}`"
        marked = marked.withColumn(f"__{name}", F.when(here, F.from_json(F.col(column), schema, LONG_STRINGS)))
        turns = F.when(here, F.expr(expression.replace("r.", f"{parsed}.").replace(f"o{parsed}.", "or."))).otherwise(turns)
    return marked.select(*[c for c in records.columns if c not in (column, "layout", "turns")], named.alias("layout"), turns.cast(TURNS).alias("turns"))


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"(<(?=\||/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(<|\[)\\(?=\||/?s>|/?INST\])", "$1"), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\;>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\;>"), F.lit("\n")))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations with `formatted` and `loss_spans` (code points, end exclusive) for their `turns`."""
    parts = F.transform(F.coalesce("turns", F.array().cast(TURNS)), lambda t: F.struct(F.concat(F.lit(START), _escape_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (t["role"] == TRAINED).alias("trained")))
    spans = "array<struct<start:bigint,end:bigint>>"
    walked = F.aggregate(
        "__parts",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["trained"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    made = conversations.withColumn("__parts", parts)
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return made.withColumn("formatted", text).withColumn("loss_spans", walked["spans"]).drop("__parts")


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string holds."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(_unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record): a table with a row for each turn, as structs in the messages layout."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    known = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("sorted"))
    grouped = known.union(rows.filter("conv_id is null").select("conv_id", F.array(turn)))
    return grouped.select("conv_id", F.struct(F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")).alias("record"))


def format_chats(records: DataFrame, column: str = "record") -> DataFrame:
    """records, in any layout, with `layout`, `turns`, `formatted` and `loss_spans`."""
    return format_turns(canonical_turns(records, column))
