"""Chat formatting with linked tool calls.

A turn is plain text or holds JSON: an assistant's ``tool_calls`` (each with an
id, a name and arguments), a result (``tool_call_id`` and ``content``), or a
system turn's ``tools`` (name and parameter schema).  Turns become events, parsed
once and kept; results are hash-joined to calls by conversation and identifier,
calls to schemas by conversation and name.  An event's place is (anchor, step,
turn, idx): a result is anchored at the call's turn one step after it, so sorting
by place is a topological order (turns in sequence, a result never before its
call) and no conversation has to be gathered.  Arguments are validated against
the schema, and each event is serialised as canonical JSON: keys sorted, no
spaces, numbers and strings in JSON's own form, lone surrogates escaped.

Defined results: of calls that share an identifier the earliest counts, the
others are ``repeated``; a result without a call is an ``orphan`` at its own
turn; a call without a result is ``unanswered``; a call without a schema isn't
validated (null).  Identifiers and names that aren't strings are compared by
their canonical JSON.  Keys of a turn, a call or a result that the format doesn't
know are kept, and so are entries of ``tool_calls`` that aren't objects, in the
turn's message.  Null or empty text is an empty message; text that is not JSON
(NaN, Infinity, numbers beyond doubles and values nested too deeply are none), or
JSON of another form, is a message as it stands; nulls in the ids keep a row from
linking.  Repeated rows each give their events; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import keep
from .batches import short_batches
from .json_schema import canonical, escaped, parse, problems

EVENT = "array<struct<idx:int,kind:string,call_id:string,name:string,body:string,json:string>>"


def _parsed(text: str):
    """The value of JSON text, other text as it stands."""
    try:
        return parse(text)
    except ValueError:
        return text


def _label(x) -> str | None:
    return None if x is None else escaped(x) if isinstance(x, str) else canonical(x)


def _function(x: dict) -> tuple[str, object, dict]:
    """Name, arguments and other keys of a call or a tool, with or without a ``function`` wrapper."""
    wrapped = isinstance(x.get("function"), dict)
    f = x["function"] if wrapped else x
    args = f.get("arguments", f.get("parameters", {}))
    rest = {k: v for k, v in f.items() if k not in ("name", "arguments", "parameters", "id")}
    if wrapped:
        rest = {k: v for k, v in x.items() if k not in ("function", "id", "name", "arguments")} | ({"function": rest} if rest else {})
    return _label(f.get("name", "")) or "", _parsed(args) if isinstance(args, str) else args, rest


def events(role: str | None, text: str | None) -> list[tuple[int, str, str | None, str | None, str | None, str]]:
    """(idx, kind, call id, name, body, json) of a turn; the body is what is validated or validates."""
    plain = [(0, "message", None, None, None, canonical({"content": text or "", "role": role}))]
    got = _parsed(text) if text and text.lstrip()[:1] == "{" else None
    if not isinstance(got, dict):
        return plain
    if isinstance(got.get("tools"), list):
        schemas = [_function(t) for t in got["tools"] if isinstance(t, dict)]
        return [(0, "message", None, None, None, canonical(got | {"role": role})), *((i + 1, "schema", None, n, canonical(s), "") for i, (n, s, _) in enumerate(schemas))]
    if isinstance(got.get("tool_calls"), list):
        other = [x for x in got["tool_calls"] if not isinstance(x, dict)]
        message = {k: v for k, v in got.items() if k != "tool_calls"} | {"content": got.get("content") or "", "role": role} | ({"tool_calls": other} if other else {})
        out = [(0, "message", None, None, None, canonical(message))]
        for i, c in enumerate(x for x in got["tool_calls"] if isinstance(x, dict)):
            name, args, rest = _function(c)
            whole = rest | {"arguments": args, "id": c.get("id") if c.get("id") is not None else "", "name": name}
            out.append((i + 1, "call", _label(c.get("id")), name, canonical(args), canonical(whole)))
        return out
    if got.get("tool_call_id") is not None:
        whole = {k: v for k, v in got.items() if k != "tool_call_id"} | {"content": got.get("content"), "id": got["tool_call_id"], "role": "tool"}
        return [(0, "result", _label(got["tool_call_id"]), None, None, canonical(whole))]
    return plain


def link(turns: DataFrame) -> DataFrame:
    """``conv_id, anchor, step, turn, idx, kind, status, problems, json`` of every event of ``turns(conv_id, turn, role, text)``."""
    short_batches(turns.sparkSession)

    def read(roles: pd.Series, texts: pd.Series) -> pd.Series:
        names = ("idx", "kind", "call_id", "name", "body", "json")
        return pd.Series([[dict(zip(names, e, strict=True)) for e in events(r, t)] for r, t in zip(roles, texts, strict=True)], dtype=object)

    read.__annotations__ = {"roles": pd.Series, "texts": pd.Series, "return": pd.Series}
    parsed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.explode(F.pandas_udf(read, EVENT)("role", "text")).alias("e"))
    all_ = keep(parsed.select("conv_id", "turn", "e.*"), "events")
    calls, results = all_.filter("kind = 'call'"), all_.filter("kind = 'result'")
    schemas = all_.filter("kind = 'schema'").groupBy("conv_id", "name").agg(F.min_by("body", F.struct("turn", "idx")).alias("schema"))
    first = calls.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "idx")).alias("at"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))

    def check(bodies: pd.Series, schema: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else problems(parse(b), parse(s)) for b, s in zip(bodies, schema, strict=True)], dtype=object)

    check.__annotations__ = {"bodies": pd.Series, "schema": pd.Series, "return": pd.Series}
    checked = calls.join(schemas, ["conv_id", "name"], "left").withColumn("problems", F.pandas_udf(check, "array<string>")("body", "schema"))
    linked = checked.join(first, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    place = lambda anchor, step, idx, status, problems: ("conv_id", anchor.alias("anchor"), step.cast("int").alias("step"), "turn", idx.cast("int").alias("idx"), "kind", status.alias("status"), problems.alias("problems"), "json")
    none, turn, idx, found = F.lit(None).cast("array<string>"), F.col("turn"), F.col("idx"), F.col("at").isNotNull()
    status = F.when(found & (F.struct("turn", "idx") != F.col("at")), "repeated").when(F.col("answered"), "answered").otherwise("unanswered")
    out = linked.select(*place(turn, F.lit(1), idx, status, F.col("problems")))
    placed = results.join(first, ["conv_id", "call_id"], "left")
    placed = placed.select(*place(F.when(found, F.col("at.turn")).otherwise(turn), F.when(found, 2).otherwise(0), F.when(found, F.col("at.idx")).otherwise(0), F.when(found, "linked").otherwise("orphan"), none))
    plain = all_.filter("kind = 'message'").select(*place(turn, F.lit(0), idx, F.lit("plain"), none))
    return plain.unionByName(out).unionByName(placed)
