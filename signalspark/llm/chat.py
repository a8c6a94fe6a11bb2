"""Chat formatting by schema fingerprint.

The nested field paths of a record are hashed; the hash selects a declarative mapping that says where roles and texts
are. A DataFrame's own schema gives one fingerprint for all its rows; JSON records each have theirs. Canonical turns
are rendered with a template that marks turns and escapes control strings reversibly, and can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    fields: (JSON path, role) of single texts in order, with an optional joiner path folded into the first; or
    listed: (path of the list, role field, text field); or row: (conversation, turn, role, text) columns, where every
    row is one turn.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    row: tuple[str, str, str, str] | None = None

    def paths(self) -> tuple[str, ...]:
        if self.listed:
            return tuple(sorted((f"{self.listed[0]}[].{self.listed[1]}", f"{self.listed[0]}[].{self.listed[2]}")))
        return tuple(sorted(self.row or (p for p, _ in self.fields)))

    def fingerprint(self) -> str:
        return fingerprint_of(self.paths())


def fingerprint_of(paths) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: The layouts known so far; users add their own.
MAPPINGS = (
    Mapping("turn_rows", row=("conv_id", "turn", "role", "text")),
    Mapping("messages", listed=("messages", "role", "content")),
    Mapping("conversations", listed=("conversations", "from", "value")),
    Mapping("turns", listed=("turns", "speaker", "text")),
    Mapping("prompt_response", fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question_answer", fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("instruction", fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_input", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("system_prompt", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
)
#: Role names of the layouts, and the canonical ones.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def canonical_role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(role)), role, F.lit(""))


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Every nested field path of a schema; a list adds [] to its path."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def known_paths(mappings) -> set[str]:
    return {p for m in mappings for p in m.paths()}


def mapping_of(schema: T.StructType, mappings=MAPPINGS) -> Mapping:
    """The mapping with the schema's fingerprint. Paths that no mapping names are left out before hashing, so extra
    columns don't matter; if the rest names several layouts at once, the fullest mapping that is whole in it counts."""
    here = set(schema_paths(schema)) & known_paths(mappings)
    by_print = {m.fingerprint(): m for m in mappings}
    found = by_print.get(fingerprint_of(here))
    if found is None:
        found = max((m for m in mappings if set(m.paths()) <= here), key=lambda m: len(m.paths()), default=None)
    if found is None:
        raise ValueError(f"no mapping for the fields {sorted(here)}")
    return found


def turns_of_rows(df: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """(conv_id, turn, part, role, text) of a DataFrame with one turn a row; null texts and roles are empty.

    Roles are taken as they stand. Extra columns are left out."""
    row = mapping_of(df.schema, mappings).row
    if row is None:
        raise ValueError("the rows aren't turns; give records as JSON")
    conv, turn, role, text = (F.col(f"`{c}`") for c in row)
    return df.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.lit(0).alias("part"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def record_fingerprint(body: Column, mappings=MAPPINGS) -> Column:
    """The fingerprint of a JSON record: the known field paths that it has, sorted and hashed; null if it isn't JSON.

    Paths are read off the record's own schema, so a null value still counts as its field.
    """
    record = F.try_parse_json(body)
    present = []
    for path in sorted(known_paths(mappings)):
        top, _, inner = path.partition("[].")
        # schema_of_variant writes OBJECT<name: TYPE, ...>; a list's fields stand in ARRAY<OBJECT<...>>
        shape = F.schema_of_variant(F.try_variant_get(record, f"$.{top}", "variant")) if inner else None
        has = F.coalesce(F.array_contains(F.json_object_keys(body), top), F.lit(False))
        if inner:
            has = has & F.coalesce(F.regexp_like(shape, F.lit(rf"^ARRAY<OBJECT<(?:.*[ ,<])?`?{inner}`?: ")), F.lit(False))
        present.append(F.when(has, F.lit(path)))
    joined = F.array_join(F.array_sort(F.array_compact(F.array(*present))), "\n")
    return F.when(record.isNotNull(), F.sha2(joined.cast("binary"), 256))


def _renamed(role: str, text: str):
    return lambda t: F.struct(t[role].alias("role"), t[text].alias("text"))


def turns_of_records(df: DataFrame, *, id_col: str = "conv_id", body_col: str = "body", mappings=MAPPINGS) -> DataFrame:
    """(conv_id, turn, part, role, text, layout) of JSON records; a record of unknown layout gives one row, turn -1,
    with a null layout and its body as text, so that nothing is lost."""
    body = F.col(f"`{body_col}`")
    layouts = [m for m in mappings if not m.row]
    name = F.create_map(*(F.lit(x) for m in layouts for x in (m.fingerprint(), m.name)))
    marked = df.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), body.alias("body"), F.element_at(name, record_fingerprint(body, mappings)).alias("layout"))
    turns = F.array(F.struct(F.lit("").alias("role"), F.col("body").alias("text")))
    for m in layouts:
        if m.listed:
            top, role, text = m.listed
            listed = F.from_json(F.get_json_object("body", f"$.{top}"), T.ArrayType(T.StructType([T.StructField(role, T.StringType()), T.StructField(text, T.StringType())])))
            read = F.transform(listed, _renamed(role, text))
        else:
            # neighbours of one role, as an instruction and its input, are one turn
            groups: list[tuple[str, list[str]]] = []
            for path, role in m.fields:
                if groups and groups[-1][0] == role:
                    groups[-1][1].append(path)
                else:
                    groups.append((role, [path]))
            read = F.array(*(F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*(F.get_json_object("body", f"$.{p}") for p in paths)), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n").alias("text")) for role, paths in groups))
        turns = F.when(F.col("layout") == m.name, read).otherwise(turns)
    exploded = marked.select("conv_id", "layout", F.posexplode_outer(turns).alias("turn", "t"))
    known = F.col("layout").isNotNull()
    return exploded.select("conv_id", F.when(known, F.coalesce(F.col("turn"), F.lit(0))).otherwise(-1).cast("long").alias("turn"), F.lit(0).alias("part"), canonical_role(F.col("t.role")).alias("role"), F.coalesce(F.col("t.text"), F.lit("")).alias("text"), "layout")


#: The template: a turn is <|turn|>role<|text|>text<|end|>; what an assistant says, with its end, is under the loss.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings with a meaning for a model, in a text written with a mark behind their first character; so is the mark.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARK = "␛"


def escaped(text: Column) -> Column:
    """Reversible: the mark is doubled, and a control string gets a mark behind its first character."""
    out = F.replace(text, F.lit(MARK), F.lit(MARK + MARK))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(control[0] + MARK + "!" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    """The text that was escaped: a mark and ! vanish, a doubled mark is a mark."""
    return F.regexp_replace(text, f"{MARK}(?:!|({MARK}))", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, segment, loss_start, loss_length): the rendered turns, whose concatenation in the order of
    (turn, role, text) is the formatted conversation; loss_start and loss_length are code points in the segment.

    A conversation stays in rows, so a hot one never becomes one string in one task.
    """
    body = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    text = escaped(F.col("text"))
    spoken = F.col("role") == "assistant"
    return turns.select(
        "conv_id",
        "turn",
        "part",
        F.concat(body, text, F.lit(END)).alias("segment"),
        F.when(spoken, F.length(body)).alias("loss_start"),
        F.when(spoken, F.length(text)).alias("loss_length"),
    )


def parsed(segments: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text, loss_text, chars) read back from the rendered turns alone."""
    segment = F.col("segment")
    start = F.length(F.lit(TURN)) + 1
    cut = F.locate(TEXT, segment)  # no escaped role or text holds a marker
    text = F.substring(segment, cut + len(TEXT), F.length(segment) - cut - len(TEXT) - len(END) + 1)
    under_loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.substring(segment, F.col("loss_start") + 1, F.col("loss_length"))))
    return segments.select("conv_id", "turn", "part", unescaped(F.substring(segment, start, cut - start)).alias("role"), unescaped(text).alias("text"), under_loss.alias("loss_text"), F.length(segment).cast("long").alias("chars"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(read_back: DataFrame) -> DataFrame:
    """Digests of each conversation's turns in order (turn, then role and text); a null conv_id is one conversation.

    Rows are sorted within the partitions of conv_id and streamed, a conversation's digest being fed row by row: the
    memory doesn't follow the conversation. Nulls of turn come first. Repeated rows are turns of their own.
    """

    def stream(batches):
        held = None
        for batch in batches:
            rows = []
            for conv, new, role, text, loss, chars in zip(batch["conv_id"], batch["named"], batch["role"], batch["text"], batch["loss_text"], batch["chars"], strict=True):
                key = int(conv) if new else None
                if held is None or held["key"] != key:
                    if held is not None:
                        rows.append(_closed(held))
                    held = {"key": key, "n": 0, "turns": sha256(), "loss": sha256(), "loss_chars": 0, "chars": 0}
                held["n"] += 1
                held["turns"].update(f"{role}\n{text}\n".encode())
                held["chars"] += int(chars)
                if loss is not None:
                    held["loss"].update(loss.encode())
                    held["loss_chars"] += len(loss)
            yield _frame(rows)
        if held is not None:
            yield _frame([_closed(held)])

    ordered = read_back.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNotNull().alias("named"), "turn", "role", "text", "loss_text", "chars")
    parts = ordered.repartition("conv_id", "named").sortWithinPartitions("conv_id", "named", "turn", "role", "text")
    return parts.select("conv_id", "named", "role", "text", "loss_text", "chars").mapInPandas(stream, _DIGEST)


def _closed(held: dict) -> tuple:
    return held["key"], held["n"], held["turns"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out
