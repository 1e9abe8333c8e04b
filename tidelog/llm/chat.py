"""Chat formatting: schema fingerprints select how a record becomes turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

TURNS = "conv_id long, turn long, place int, role string, text string"
CHATS = "conv_id long, formatted string, mask array<struct<start:long,end:long>>"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; elements of a list share the step []."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layouts: field paths, and the turns they hold: (list path or None, role, text).
#: A role that starts with "=" is fixed, any other names a field.
LAYOUTS = [
    ({"role", "text"}, [(None, "role", "text")]),
    ({"messages[].role", "messages[].content"}, [("messages", "role", "content")]),
    ({"conversations[].from", "conversations[].value"}, [("conversations", "from", "value")]),
    ({"prompt", "completion"}, [(None, "=user", "prompt"), (None, "=assistant", "completion")]),
    ({"prompt", "response"}, [(None, "=user", "prompt"), (None, "=assistant", "response")]),
    ({"system", "prompt", "response"}, [(None, "=system", "system"), (None, "=user", "prompt"), (None, "=assistant", "response")]),
    ({"instruction", "output"}, [(None, "=user", "instruction"), (None, "=assistant", "output")]),
    ({"instruction", "input", "output"}, [(None, "=user", "instruction+input"), (None, "=assistant", "output")]),
]
KNOWN = set().union(*(paths for paths, _ in LAYOUTS))
MAPPINGS = {fingerprint(paths): steps for paths, steps in LAYOUTS}
# A list without elements has no paths below it, and no turns.
MAPPINGS |= {fingerprint({f"{steps[0][0]}[]"}): steps for _, steps in LAYOUTS if steps[0][0]}
KNOWN |= {f"{steps[0][0]}[]" for _, steps in LAYOUTS if steps[0][0]}


def mapping(paths: set[str]) -> list[tuple] | None:
    """The mapping that the fingerprint of the paths selects, those that no layout has
    left aside; None if there is none."""
    return MAPPINGS.get(fingerprint(paths & KNOWN))


def turns_of(record: dict) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of a record; None for a layout without a mapping."""
    steps = mapping(field_paths(record))
    if steps is None:
        return None
    out = []
    for path, role, text in steps:
        for x in [record] if path is None else record[path]:
            name = role[1:] if role[0] == "=" else x.get(role) or ""
            parts = [str(x[f]) for f in text.split("+") if x.get(f) is not None]
            out.append((ROLES.get(name, name), "\n\n".join(p for p in parts if p) if "+" in text else "".join(parts)))
    return out


def json_turns(records: DataFrame) -> DataFrame:
    """Turns of records (conv_id, record: a JSON object), each by its own fingerprint. A
    record that unmapped() lists gives one turn without role and text, so that no
    conversation disappears unseen; one with an empty list gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, text in zip(f.conv_id, f.record):
                turns = turns_of(_object(text))
                rows += [(key, 0, i, r, t) for i, (r, t) in enumerate([(None, None)] if turns is None else turns)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "place", "role", "text"])

    return records.select("conv_id", "record").mapInPandas(run, TURNS)


def _object(text: str | None) -> dict:
    """The JSON object of a text; {} for null, broken JSON and other values."""
    try:
        record = json.loads(text) if text is not None else None
    except ValueError:
        record = None
    return record if isinstance(record, dict) else {}


def unmapped(records: DataFrame) -> DataFrame:
    """(conv_id, fingerprint) of the records whose layout has no mapping."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(k, field_paths(_object(t))) for k, t in zip(f.conv_id, f.record)]
            yield pd.DataFrame([(k, fingerprint(p)) for k, p in found if mapping(p) is None], columns=["conv_id", "fingerprint"])

    return records.select("conv_id", "record").mapInPandas(run, "conv_id long, fingerprint string")


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """field_paths() of what rows of a type look like."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind)) if kind.fields else {at}
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


def row_turns(rows: DataFrame) -> DataFrame:
    """Turns of a table whose columns have any of the layouts: the fingerprint of the
    nested paths of its schema selects the mapping, which runs in the JVM. Columns of
    no layout are left aside; ValueError for a table without a mapping."""
    steps = mapping(schema_paths(rows.schema))
    if steps is None:
        raise ValueError(f"no mapping for {sorted(schema_paths(rows.schema))}")

    def turn(x, place, role, text):
        role = F.lit(role[1:]) if role[0] == "=" else F.coalesce(x(role).cast("string"), F.lit(""))
        for a, b in ROLES.items():
            role = F.when(role == a, b).otherwise(role)
        parts = [F.coalesce(x(f).cast("string"), F.lit("")) for f in text.split("+")]
        text = parts[0] if len(parts) == 1 else F.array_join(F.array_remove(F.array(*parts), ""), "\n\n")
        return F.struct(place.cast("int").alias("place"), role.alias("role"), text.alias("text"))

    path, role, text = steps[0]
    if path is None:
        turns = F.array(*[turn(F.col, F.lit(i), role, text) for i, (_, role, text) in enumerate(steps)])
    else:
        turns = F.transform(path, lambda x, i: turn(lambda f: x[f], i, role, text))
    number = F.col("turn").cast("long") if "turn" in rows.columns else F.lit(0).cast("long")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), number.alias("turn"), F.explode(turns).alias("x")).select("conv_id", "turn", "x.place", "x.role", "x.text")


def escape(text: str) -> str:
    r"""No control string (### or </turn>) is left in it; undone by unescape()."""
    text = text.replace("\\", "\\\\").replace("</turn", "<\\/turn")
    return re.sub("#(?=##)", r"#\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted chat and the spans of its loss mask, in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), mask


TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, mask.

    turns come in the order (turn, place, role, text), so repeated rows stay and
    ties are settled by value; null texts and roles are empty; a null conv_id is a
    conversation of its own. Each task streams its sorted rows and holds one
    conversation at a time, which is one output row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, open_ = None, [], False
        out: list[tuple] = []
        size = 0

        def batch():
            spans = [[{"start": a, "end": b} for a, b in m] for _, _, m in out]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "formatted", "mask"])

        for b in batches:
            for k, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_ and k != key:
                    out.append((key, *format_turns(held)))
                    size, held = size + len(out[-1][1]), []
                    if size > 4 << 20:
                        yield batch()
                        out, size = [], 0
                key, open_ = k, True
                held.append((role or "", text or ""))
        if open_:
            out.append((key, *format_turns(held)))
        if out:
            yield batch()

    t = turns.select("conv_id", "turn", "place", "role", "text")
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "role", "text").mapInArrow(run, CHATS)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    # The table as it is: its own field paths select how it becomes turns.
    rows = table(spark, sf_dir, "conversations").unionByName(more, allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for f in frames:
            got = []
            for key, text, mask in zip(f.conv_id, f.formatted, f["mask"]):
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                got.append((key, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(got, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_chats(row_turns(rows)).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
