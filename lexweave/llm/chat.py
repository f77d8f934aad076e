"""Chat formatting by schema fingerprinting.

A record is a JSON object in one of many layouts: a prompt with a completion, an
instruction with input and output, a list of messages, and so on. Its schema is
the set of its nested field paths with their kinds (``messages[].role:string``).
Paths that no mapping of the registry names (``model``, ``created``, weights of
messages) are no content and are left out; the 64-bit hash of the others, sorted, is
the record's fingerprint. Numbers and truth values count as texts where a text may
stand. A registry of declarative mappings says which paths hold turns and which role
each has. The first record of a fingerprint selects the mapping: of those whose
``fields`` are all there, the one that covers most of the content, of equal ones the
first; every further record of the fingerprint is converted by one lookup.

Canonical turns have a role (system, user, assistant, tool) and a text. Role names
are mapped by ``ROLES``. Content in parts is joined by line breaks; of a preference
the chosen answer is the turn, the rejected one is none.

Defined results: a record that is null, no JSON object, or without the fields of any
mapping gives one row with turn -1, its fingerprint and the reason in
``status``, as does one that is nested too deep to be read; half a surrogate pair
becomes a question mark; fields of null value count as absent; empty texts give no turn, and a
record without any text has the status ``empty``; unknown roles are kept in lower
case; very long texts are kept whole; rows without id and repeated rows are converted
each; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._words import lean, slices
from lexweave.session import ship

ROLES = {"human": "user", "prompter": "user", "question": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "answer": "assistant", "function": "tool", "developer": "system"}


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    return "number" if isinstance(value, (int, float)) else "object" if isinstance(value, dict) else "array"


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths with kinds; nulls are absent."""
    if value is None:
        return set()
    if isinstance(value, dict):
        out: set[str] = set()
        for k, v in value.items():
            out |= paths(v, f"{at}.{k}" if at else k)
        return out or ({f"{at}:object"} if at else set())
    if isinstance(value, list):
        out = set()
        for v in value:
            out |= paths(v, f"{at}[]")
        return out or {f"{at}[]:none"}
    return {f"{at}:{_kind(value)}"}


def fingerprint(names: set[str]) -> int:
    """Signed 64-bit hash of the sorted paths."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(names)).encode("utf-8", "replace"))
    return h - (1 << 64) if h >= 1 << 63 else h


@dataclass(frozen=True)
class Mapping:
    """One layout.

    ``fields`` are the paths that must be there, ``optional`` content that may be.
    ``turns``: (role, fields joined by a blank line) in order; ``each``: (list, role
    field, text field); ``lines``: a list of texts, or of lists of texts, that
    alternate between user and assistant, before the turns.
    """

    name: str
    fields: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    lines: str | None = None
    optional: tuple[str, ...] = field(default=())

    def content(self) -> set[str]:
        return {*self.fields, *self.optional}


_SYSTEM = ("system", ("system",))


def _of(name: str, user: tuple[str, ...], assistant: str, optional: tuple[str, ...] = ()) -> Mapping:
    """A layout of one question (its last field is the one that must be there) and one answer."""
    return Mapping(name, (f"{user[-1]}:text", f"{assistant}:text"), turns=(_SYSTEM, ("user", user), ("assistant", (assistant,))), optional=("system:text", *(f"{o}:text" for o in optional)))


def _list(name: str, path: str, role: str, text: str, parts: bool = False) -> Mapping:
    return Mapping(name, (f"{path}[].{role}:text", f"{path}[].{text}{'[].text' if parts else ''}:text"), each=(path, role, text), turns=(_SYSTEM,), optional=("system:text",))


MAPPINGS = (
    _list("messages", "messages", "role", "content"),
    _list("message_parts", "messages", "role", "content", True),
    _list("conversations", "conversations", "from", "value"),
    _list("conversation", "conversation", "role", "content"),
    _list("dialogue", "dialogue", "speaker", "text"),
    _list("nested_chat", "data.chat.turns", "speaker", "text"),
    _list("chosen_messages", "chosen", "role", "content"),
    Mapping("instruction", ("instruction:text", "output:text"), turns=(_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input:text", "system:text")),
    Mapping("instruction_response", ("instruction:text", "response:text"), turns=(_SYSTEM, ("user", ("context", "instruction", "input")), ("assistant", ("response",))), optional=("context:text", "input:text", "system:text")),
    _of("prompt_completion", ("prompt",), "completion"),
    _of("prompt_response", ("prompt",), "response"),
    _of("preference", ("prompt",), "chosen", ("rejected",)),
    _of("query_response", ("query",), "response"),
    _of("question_answer", ("context", "question"), "answer", ("context",)),
    _of("inputs_targets", ("inputs",), "targets"),
    _of("input_output", ("input",), "output"),
    Mapping("history", ("history[][]:text", "prompt:text", "response:text"), lines="history", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("dialog", ("dialog[]:text",), lines="dialog"),
    Mapping("prompt", ("prompt:text",), turns=(_SYSTEM, ("user", ("prompt",))), optional=("system:text",)),
)


class Registry:
    """Mappings by fingerprint of the content."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.names = set().union(*(m.content() for m in mappings))
        self.known: dict[int, Mapping | None] = {}

    def content(self, record: object) -> set[str]:
        """Paths of a record that a mapping names."""
        out = (p.rpartition(":") for p in paths(record))
        return {f"{p}:{'text' if kind in ('string', 'number', 'boolean') else kind}" for p, _, kind in out} & self.names

    def select(self, names: set[str]) -> tuple[int, Mapping | None]:
        f = fingerprint(names)
        if f not in self.known:
            fit = [m for m in self.mappings if names.issuperset(m.fields)]
            self.known[f] = max(fit, key=lambda m: len(names & m.content()), default=None)
        return f, self.known[f]


def _get(record: dict, path: str) -> object:
    value: object = record
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    """A text, a number or truth value as JSON has it, or the texts of content in parts."""
    if isinstance(value, str):
        return value
    if isinstance(value, (bool, int, float)):
        return json.dumps(value)
    if isinstance(value, list):
        return "\n".join(t for t in (_text(v.get("text") if isinstance(v, dict) else v) for v in value) if t)
    return ""


def turns_of(record: dict, m: Mapping) -> list[tuple[str, str]]:
    """Canonical turns of a record of this layout."""
    fixed = [(role, "\n\n".join(t for t in (_text(_get(record, f)) for f in fields) if t)) for role, fields in m.turns]
    listed = []
    if m.each:
        path, role, text = m.each
        listed = [(_text(x.get(role)).lower(), _text(x.get(text))) for x in _get(record, path) or () if isinstance(x, dict)]
    if m.lines:
        for line in _get(record, m.lines) or ():
            pair = line if isinstance(line, list) else [line]
            at = 0 if isinstance(line, list) else len(listed)
            listed += [("user" if (at + i) % 2 == 0 else "assistant", _text(t)) for i, t in enumerate(pair)]
    whole = lambda t: t.encode("utf-8", "replace").decode()
    return [(whole(ROLES.get(r, r)), whole(t)) for r, t in (listed + fixed if m.lines else fixed + listed) if t]


def convert(text: str | None, registry: Registry) -> tuple[int | None, str | None, str, list[tuple[str, str]]]:
    """Fingerprint, layout, status and turns of one record."""
    try:
        record = json.loads(text) if text is not None else None
        names = registry.content(record) if isinstance(record, dict) else None
    except (ValueError, RecursionError):
        names = None
    if names is None:
        return None, None, "invalid", []
    f, m = registry.select(names)
    if m is None:
        return f, None, "unknown", []
    turns = turns_of(record, m)
    return f, m.name, "ok" if turns else "empty", turns


def _convert(mappings: tuple[Mapping, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(mappings)
        for b in batches:
            for a, z in slices(b.column(1)):
                rows = []
                for i, text in zip(b.column(0)[a:z].to_pylist(), b.column(1)[a:z].to_pylist()):
                    f, name, status, turns = convert(text, registry)
                    rows += [(i, n, r, t, f, name, status) for n, (r, t) in enumerate(turns)] or [(i, -1, None, None, f, name, status)]
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *[pa.array(c[k], pa.string()) for k in (2, 3)], pa.array(c[4], pa.int64()), *[pa.array(c[k], pa.string()) for k in (5, 6)]], ["conv_id", "turn", "role", "text", "fingerprint", "layout", "status"])

    return run


def canonical(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows (conv_id, turn from 0, role, text, fingerprint, layout, status) of records (conv_id, record)."""
    ship(records.sparkSession)
    return records.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("record").cast("string").alias("record")).mapInArrow(lean(_convert(mappings)), "conv_id bigint, turn bigint, role string, text string, fingerprint bigint, layout string, status string")


def render(conversations: DataFrame) -> DataFrame:
    """Whole conversations as JSON records of mixed layouts: (conv_id, record).

    The layout follows from the conversation's shape, and among those that can
    hold it from a hash of its id.
    """
    c = conversations.filter("conv_id is not null and text is not null and text <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    role, text = lambda i: F.col("t")[i]["role"], lambda i: F.col("t")[i]["text"]
    n = F.size("t")
    pair = (n == 2) & (role(0) == "user") & (role(1) == "assistant")
    triple = (n == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant")
    json_of = lambda *fields: F.to_json(F.struct(*fields))
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(8))
    extra = [F.lit("m-1").alias("model"), F.lit(1700000000).alias("created"), F.array(F.lit("tag"), F.lit("x")).alias("tags")]
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    weighted = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.lit(0.5).alias("weight")))
    parts = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    shared = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    nested = F.transform("t", lambda x: F.struct(F.upper(x["role"]).alias("speaker"), x["text"].alias("text")))
    record = (
        F.when(pair & (pick == 0), json_of(text(0).alias("prompt"), text(1).alias("completion")))
        .when(pair & (pick == 1), json_of(text(0).alias("instruction"), text(1).alias("output"), *extra))
        .when(pair & (pick == 2), json_of(text(0).alias("question"), text(1).alias("answer"), F.lit(3).alias("score")))
        .when(pair & (pick == 3), json_of(text(0).alias("instruction"), F.lit("").alias("context"), text(1).alias("response"), F.lit("qa").alias("category")))
        .when(pair & (pick == 4), json_of(text(0).alias("prompt"), text(1).alias("chosen"), F.lit("no").alias("rejected")))
        .when(pair & (pick == 5), json_of(F.array(text(0), text(1)).alias("dialog"), F.lit(True).alias("done")))
        .when(triple & (pick < 3), json_of(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"), *extra))
        .when(triple & (pick == 3), json_of(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
        .when(pick == 0, json_of(messages.alias("messages")))
        .when(pick == 1, json_of(shared.alias("conversations"), *extra))
        .when(pick == 2, json_of(F.struct(F.struct(nested.alias("turns")).alias("chat")).alias("data")))
        .when(pick == 3, json_of(weighted.alias("messages"), *extra))
        .when(pick == 4, json_of(parts.alias("messages")))
        .when(pick == 5, json_of(parts.alias("messages"), F.struct(F.lit(12).alias("tokens")).alias("usage")))
        .otherwise(json_of(F.col("conv_id").cast("string").alias("id"), messages.alias("messages")))
    )
    return c.select("conv_id", record.alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over the whole conversations table, rendered in mixed layouts: (conv_id, turn, role, text, status)."""
    return canonical(render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).select("conv_id", "turn", "role", "text", "status")


# The round trip: canonical turns are the table's own, numbered within their conversation.
SQL = """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS BIGINT) AS turn, lower(role) AS role, text, 'ok' AS status
FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL AND text <> ''"""
