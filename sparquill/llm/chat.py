"""Chat formatting that is proved by a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic
parser reads the rendered turn back; where the recovered role and text differ
from the source, the conflicting content is escaped and the turn is rendered
and parsed again until they are identical. The parser is back in its first
state after each turn, so turns parsed one by one are the conversation parsed
at once, and a conversation is streamed, never held.

Escapes in texts: a backslash goes into each ``<``, any backslashes, ``|``;
reading takes one out. In roles, backslash, line feed and ``<`` are written as
``\\\\``, ``\\n`` and ``\\l``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import kind, text_batches

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_IN = {"\\\\": "\\", "\\n": "\n", "\\l": "<"}
_ROLE_MARK = re.compile(r"\\[\\nl]")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation, unescaped; None where it breaks the grammar."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find(END, at)
        if line < 0 or end < line or not rendered.startswith("\n", end + len(END)):
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in text:
            return None
        out.append((_ROLE_MARK.sub(lambda m: _ROLE_IN[m[0]], role), unescape(text)))
        at = end + len(END) + 1
    return out


def formatted(role: str | None, text: str | None) -> str:
    """A turn that parses back to its role and text (null: empty), escaped only as far as it must be."""
    role, text = role or "", text or ""
    for r, t in ((role, text), (role, escape(text)), ("".join(_ROLE_OUT.get(c, c) for c in role), escape(text))):
        if parse(out := render(r, t)) == [(role, text)]:
            return out
    raise AssertionError("the last form always parses back")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted): each turn in its rendered form."""
    make = F.udf(formatted, "string", useArrow=True)
    return conversations.select("conv_id", "turn", "role", "text", make("role", "text").alias("formatted"))


def summary(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendered form.

    Turns go by turn, then role and text, nulls first; rows that repeat are
    turns of their own. A null conv_id is a conversation. The loss mask covers
    the texts of assistant turns. A conversation's rows meet in one sorted
    partition and are hashed as they pass; memory is one batch.
    """
    text_batches(conversations.sparkSession)
    key = conversations.select("conv_id", "turn", "role", "text")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in key.columns]
    schema = f"conv_id {kind(conversations, 'conv_id')}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(conversations.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != conv:
                    if now:
                        rows.append(_closed(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                out = formatted(role, text)
                for r, t in parse(out):
                    now[1] += 1
                    now[2].update(f"{r}\n{t}\n".encode())
                    if r == "assistant":
                        now[3] += len(t)
                        now[4].update(t.encode())
                now[5] += len(out)
            if len(rows) >= 1000:
                yield _batch(rows, names, types)
                rows = []
        if now:
            rows.append(_closed(now))
        yield _batch(rows, names, types)

    return key.repartition(n, "conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def summary_sql(source: str) -> str:
    """The same for DuckDB, of a table expression with rows of roles that need no escape."""
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    held = rf"contains(t, '{START}') OR contains(t, '{END}') OR regexp_matches(t, '<\\+\|')"
    return rf"""
    WITH said AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM {source}),
    sized AS (SELECT *, {len(START) + len(END) + 2} + length(r) + length(t) + CASE WHEN {held} THEN len(regexp_extract_all(t, '<\\*\|')) ELSE 0 END AS size FROM said)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {order})) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' {order}) FILTER (r = 'assistant'), '')) AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id
    """


def _closed(c: list) -> tuple:
    return c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
