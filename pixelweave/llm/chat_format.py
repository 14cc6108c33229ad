"""Chat formatting by schema fingerprints, natively.

A record is a JSON value of any layout. Its fingerprint is the hash of its nested field paths (names and array
levels, no types or values); a declarative mapping registered for that fingerprint says where the turns are.
Canonical turns are an array of (role, text).

The template writes each turn as <|role|> text </s>. In roles and texts the characters that open a control string
('<', '[' and '|') and the escape itself ('\\') become two-character codes, so no control string, of this or
another template, survives inside a text, and decoding gives the text back exactly. The loss mask is every
assistant segment: spans(formatted) gives its code-point ranges.

Cases: null text and null role are empty; records whose fingerprint no mapping has, or that aren't JSON, get null
turns and null formatted, so that they can be counted (as do JSON records above the 16 MiB of Spark's variants: give
those as structs); an empty list of turns formats as an empty string; repeated
records are formatted each; an empty table gives an empty result; columns of the input named fingerprint, layout or turns are
replaced, all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
END = "</s>"
#: The escape first, then what opens a control string.
CODES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("|", "\\3"))


@dataclass(frozen=True)
class Mapping:
    """paths: the field paths as fingerprint_text gives them. Either messages (an array's path with role and text
    fields and names for roles) or fields: (role, path) in order."""

    name: str
    paths: str
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    names: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("openai messages", "{messages:[{content,role}]}", messages="messages"),
    Mapping("turn rows", "{turns:[{role,text}]}", messages="turns", text="text"),
    Mapping("sharegpt", "{conversations:[{from,value}]}", messages="conversations", role="from", text="value", names=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt and completion", "{completion,prompt}", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", "{prompt,response}", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", "{instruction,output}", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", "{input,instruction,output}", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system, question, answer", "{answer,question,system}", fields=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)

def fingerprint_text(record: Column) -> Column:
    """The nested field paths of a variant as text: {a,b:[{c}]}. Scalars' types don't count, nor an array's being empty."""
    s = F.schema_of_variant(record)
    s = F.regexp_replace(s, r"(: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z][A-Z0-9_ ]*(\([0-9, ]*\))?", "$1")
    for a, b in (("ARRAY<", "["), ("OBJECT<", "{")):
        s = F.replace(s, F.lit(a), F.lit(b))
    # Closing signs follow from the opening ones; paths need only their order and depth.
    return F.regexp_replace(F.regexp_replace(s, r": (?=[,>]|$)", ""), " ", "")


def _signature(paths: str) -> str:
    """paths of a mapping in the form of fingerprint_text."""
    return paths.replace("}", ">").replace("]", ">")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(fingerprint_text(record))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _turn(role: Column, text: Column, names: tuple[tuple[str, str], ...] = ()) -> Column:
    role = F.coalesce(role, F.lit(""))
    for other, own in names:
        role = F.when(role == other, F.lit(own)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(m: Mapping, record: Column, is_json: bool) -> Column:
    if is_json:
        at = lambda path, kind: F.try_variant_get(record, f"$.{path}", kind)
    else:
        at = lambda path, kind: record[path]
    if m.messages:
        got = at(m.messages, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
        return F.transform(got, lambda x: _turn(x[m.role], x[m.text], m.names))
    return F.array(*(_turn(F.lit(role), at(path, "string")) for role, path in m.fields))


def schema_paths(kind: T.DataType) -> str:
    """The same text as fingerprint_text, from a column's type."""
    if isinstance(kind, T.StructType):
        parts = sorted((f.name, schema_paths(f.dataType)) for f in kind.fields)
        return "{" + ",".join(n + (f":{p}" if p else "") for n, p in parts) + ">"
    if isinstance(kind, T.ArrayType):
        return f"[{schema_paths(kind.elementType)}>"
    return ""


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with fingerprint, layout (a mapping's name, or null) and turns. record: a column of JSON texts, whose
    layouts may differ by row, or a struct, whose layout its type tells.

    The mappings' fingerprints are literals with which a record's own is compared, so nothing is joined.
    """
    kind = records.schema[record].dataType
    is_json = isinstance(kind, T.StringType)
    free = (f"_{i}" for i in range(len(records.columns) + 2) if f"_{i}" not in records.columns)
    value, paths = next(free), next(free)
    out = records.withColumn(value, F.try_parse_json(F.col(record)) if is_json else F.col(record))
    out = out.withColumn(paths, fingerprint_text(F.col(value)) if is_json else F.lit(schema_paths(kind))).withColumn("fingerprint", F.xxhash64(paths))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        own = _signature(m.paths)
        if not is_json and own != schema_paths(kind):
            continue
        prints = [own, *([f"{{{m.messages}:[>>"] if m.messages and is_json else [])]  # an empty list has no fields
        hit = F.col("fingerprint").isin([F.xxhash64(F.lit(p)) for p in prints])
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, _turns(m, F.col(value), is_json).cast(TURNS)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop(value, paths)


def formatted(turns: Column) -> Column:
    """The template over canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>"), escape(t["text"]), F.lit(END))), "")


def read_back(text: Column) -> Column:
    """Canonical turns from a formatted text."""
    segments = F.filter(F.split(text, END, -1), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape(F.substr(s, F.lit(3), F.instr(s, "|>") - F.lit(3))).alias("role"),
            unescape(F.substr(s, F.instr(s, "|>") + F.lit(2))).alias("text"),
        ),
    )


def spans(text: Column) -> Column:
    """The loss mask: (start, length) in code points, from 0, of each assistant's escaped text in a formatted text."""
    segments = F.filter(F.split(text, END, -1), lambda s: s != "")
    head = F.length(F.lit("<|assistant|>"))
    step = lambda acc, s: F.struct(
        (acc["at"] + F.length(s) + len(END)).cast("long").alias("at"),
        F.when(F.startswith(s, F.lit("<|assistant|>")), F.concat(acc["found"], F.array(F.struct((acc["at"] + head).cast("long").alias("start"), (F.length(s) - head).cast("long").alias("length")))))
        .otherwise(acc["found"])
        .alias("found"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found"))
    return F.aggregate(segments, start, step, lambda acc: acc["found"])


def masked(text: Column) -> Column:
    """All text under the loss mask of a formatted text, cut out by its spans and unescaped, in order."""
    return F.array_join(F.transform(spans(text), lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
