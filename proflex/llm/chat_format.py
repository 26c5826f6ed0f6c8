"""Operator 12: chat formatting, with mappings selected by a fingerprint of the schema.

1. Fingerprint.  The nested field paths of a layout (`messages[].role`) are hashed.  A mapping
   declares the paths of one layout and where its turns stand; a table or a record takes the mapping
   whose fingerprint equals that of its own paths, limited to those that the mapping names (so other
   fields do not matter); of several, the one with most paths, then the first in MAPPINGS.
2. Canonical turns.  `canonical_turns` reads a table by its schema, `canonical_records` a column of
   JSON objects in any mixture of layouts, record by record.  Both give one row for each turn.
3. Template.  A turn becomes `<|role|>text</s>`.  In role and text every backslash is doubled, and one
   is set behind the first character of every control string (CONTROL), which no longer is one then;
   so the marks are the only control strings of the output, and reading it back is unambiguous.
4. Loss mask.  `loss_start` and `loss_end` are places in the conversation's formatted text, in code
   points, around the text of each assistant turn.

Formatting needs the turn alone; only the places need the turns before it.  The turns of a
conversation meet in one task as a sorted stream, of which nothing but the running length is kept,
so a conversation may hold any share of all rows.  `read_back` parses the output in the same order.

Edge cases: null texts and roles count as empty; null turns come first, rows of equal turn follow by
role and text; repeated rows are turns of their own; rows of a null conversation are one
conversation; records that are no JSON object or fit no mapping come out with a null role and text
and layout '-' (`canonical_records`) or raise (a table); fields of other types than text are read as
JSON text; empty arrays have no turns; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_stream

# ---- fixed values: the template ----
HEAD, BODY, END = "<|", "|>", "</s>"
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: The first character of a control string, wherever one begins (they may overlap).
CONTROL_START = r"<(?=\||/?s>|</?SYS>>)|\|(?=>)|\[(?=/?INST\])"
LOSS_ROLE = "assistant"

#: Names of roles in layouts that have their own.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    fields   fixed turns: (role, paths joined by a blank line; empty ones are left out)
    array    path of an array of turns, with the names of its role and text fields
    rows     column names (turn, role, text) of a table with one row for each turn
    renamed  whether roles go through ROLE_NAMES"""
    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    array: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    renamed: bool = False

    @property
    def paths(self) -> frozenset[str]:
        named = {p for _, ps in self.fields for p in ps} | set(self.rows or ())
        if self.array:
            path, role, text = self.array
            named |= {f"{path}[].{role}", f"{path}[].{text}"}
        return frozenset(named)


MAPPINGS = [
    Mapping("turn rows", rows=("turn", "role", "text")),
    Mapping("messages", array=("messages", "role", "content")),
    Mapping("conversations", array=("conversations", "from", "value"), renamed=True),
    Mapping("dialog", array=("dialog", "speaker", "text"), renamed=True),
    Mapping("nested messages", array=("data.messages", "role", "content")),
    Mapping("instruction with input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction, context, response", fields=(("user", ("instruction", "context")), ("assistant", ("response",)))),
    Mapping("system, prompt, response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt, response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt, completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system, question, response", fields=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
    Mapping("question, answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
]


def fingerprint(paths) -> str:
    """Digest of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


#: The mappings that share a set of named paths' vocabulary, most paths first.
_RANKED = sorted(enumerate(MAPPINGS), key=lambda m: (-len(m[1].paths), m[0]))
_BY_PRINT = [(fingerprint(m.paths), m) for _, m in _RANKED]


def select_mapping(paths) -> Mapping | None:
    paths = frozenset(paths)
    return next((m for print_of, m in _BY_PRINT if fingerprint(paths & m.paths) == print_of), None)


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Paths of the fields of a schema; `[]` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        below = [schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields]
        return set().union(*below)
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return {prefix}


def value_paths(value, prefix: str = "") -> set[str]:
    """The same for a parsed record; arrays of many elements have the paths of all."""
    if isinstance(value, dict):
        return set().union(*[value_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[value_paths(v, prefix + "[]") for v in value])
    return {prefix}


def _role(role: Column, mapping: Mapping) -> Column:
    role = F.coalesce(role, F.lit(""))
    if not mapping.renamed:
        return role
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.get(F.array(names[F.lower(role)]), F.lit(0)), role)


def canonical_turns(df: DataFrame, id_col: str = "conv_id", id_value: Column | None = None) -> DataFrame:
    """conv, turn, role, text of a table in any layout that MAPPINGS knows."""
    kinds = schema_paths(df.schema)
    mapping = select_mapping(kinds)
    if mapping is None:
        raise ValueError(f"no mapping for fields {sorted(kinds)} ({fingerprint(kinds)})")
    conv = (F.col(id_col) if id_value is None else id_value).alias("conv")
    if mapping.rows:
        turn, role, text = mapping.rows
        return df.select(conv, F.col(turn).cast("long").alias("turn"), _role(F.col(role).cast("string"), mapping).alias("role"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if mapping.array:
        path, role, text = mapping.array
        turns = df.select(conv, F.posexplode(path).alias("turn", "_of"))
        return turns.select("conv", F.col("turn").cast("long"), _role(F.col("_of")[role].cast("string"), mapping).alias("role"),
                            F.coalesce(F.col("_of")[text].cast("string"), F.lit("")).alias("text"))

    def joined(paths):
        present = F.filter(F.array(*[F.col(p).cast("string") for p in paths]), lambda v: v.isNotNull() & (v != ""))
        return F.array_join(present, "\n\n")

    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), joined(paths).alias("text"))
                      for i, (role, paths) in enumerate(mapping.fields)])
    # an absent system prompt is no turn
    kept = F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))
    return df.select(conv, F.explode(kept).alias("_of")).select("conv", "_of.turn", "_of.role", "_of.text")


def record_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of the turns of one parsed record."""
    def at(value, path):
        for name in path.split("."):
            value = value.get(name) if isinstance(value, dict) else None
        return value

    def as_text(value):
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)

    if mapping.array:
        path, role, text = mapping.array
        turns = [(as_text(t.get(role)), as_text(t.get(text))) for t in at(record, path) if isinstance(t, dict)]
        return [(ROLE_NAMES.get(r.lower(), r) if mapping.renamed else r, x) for r, x in turns]
    if mapping.rows:
        return [(as_text(record.get(mapping.rows[1])), as_text(record.get(mapping.rows[2])))]
    turns = [(role, "\n\n".join(t for t in (as_text(at(record, p)) for p in paths) if t)) for role, paths in mapping.fields]
    return [(r, x) for r, x in turns if r != "system" or x]


def canonical_records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv, turn, role, text, layout of JSON objects, each by the mapping of its own fields."""
    id_type = df.schema[id_col].dataType.simpleString()

    def make():
        known: dict[frozenset, Mapping | None] = {}

        def run(rows):
            for conv, line in rows:
                try:
                    record = json.loads(line or "")
                except ValueError:
                    record = None
                mapping = None
                if isinstance(record, dict):
                    paths = frozenset(value_paths(record))
                    if paths not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[paths] = select_mapping(paths)
                    mapping = known[paths]
                if mapping is None:
                    yield conv, None, None, None, "-"
                    continue
                for turn, (role, text) in enumerate(record_turns(record, mapping)):
                    yield conv, turn, role, text, mapping.name
        return run

    return map_stream(df.select(id_col, json_col), make, f"conv {id_type}, turn bigint, role string, text string, layout string")


def escaped(text: Column) -> Column:
    """`text` without control strings, reversibly."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL_START, r"$0\\")


def unescaped(text: str) -> str:
    """The inverse of `escaped`: a pair of backslashes is one, a single one goes."""
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\", "") for part in text.split("\\\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Format canonical turns: conv, place, start, formatted, loss_start, loss_end, one row for each
    turn, in order within its conversation and partition.  The formatted text of a conversation is
    what its rows hold, joined; `start` and the loss mask are places in it."""
    head = F.concat(F.lit(HEAD), escaped(F.col("role")), F.lit(BODY))
    body = escaped(F.col("text"))
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    parts = ordered.select("conv", head.alias("head"), body.alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    conv_type = turns.schema["conv"].dataType.simpleString()

    def make():
        def run(stream):
            for conv, group in groupby(stream, itemgetter(0)):
                start = 0
                for place, (_, head, body, loss) in enumerate(group):
                    first = start + len(head)
                    formatted = f"{head}{body}{END}"
                    yield (conv, place, start, formatted) + ((first, first + len(body)) if loss else (None, None))
                    start += len(formatted)
        return run

    return map_stream(parts, make, f"conv {conv_type}, place bigint, start bigint, formatted string, loss_start bigint, loss_end bigint")


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    body = formatted.index(BODY, len(HEAD))
    if not formatted.startswith(HEAD) or formatted.index(END) != len(formatted) - len(END):
        raise ValueError("not one formatted turn")
    return unescaped(formatted[len(HEAD):body]), unescaped(formatted[body + len(BODY):-len(END)])


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the output of
    `format_turns` where it stands."""
    conv_type = formatted.schema["conv"].dataType.simpleString()

    def make():
        def run(stream):
            for conv, group in groupby(stream, itemgetter(0)):
                turns, masked = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = 0
                for _, start, text, loss_start, loss_end in group:
                    role, said = read_turn(text)
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if loss_start is not None:
                        learnt = unescaped(text[loss_start - start:loss_end - start])
                        loss_chars += len(learnt)
                        masked.update(learnt.encode("utf-8", "surrogatepass"))
                    n, chars = n + 1, chars + len(text)
                yield conv, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars
        return run

    return map_stream(formatted.select("conv", "start", "formatted", "loss_start", "loss_end"), make,
                      f"conv {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The record that the registered query adds, in a layout of its own.
PROBE = "</s>[INST] ok [/INST]"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The registered query: all conversations and one prompt with response, read back."""
    rows = canonical_turns(conversations.select("conv_id", "turn", "role", "text"))
    conv_type = conversations.schema["conv_id"].dataType
    probe = conversations.sparkSession.range(1).select(
        F.lit(-1).cast(conv_type).alias("conv_id"), F.lit(PROBE).alias("prompt"), F.lit(PROBE).alias("response"))
    return read_back(format_turns(rows.unionByName(canonical_turns(probe)))).withColumnRenamed("conv", "conv_id")
