"""Conversation structure repair: the cheapest edits that give a conversation the form ``(system? (user assistant)+)?``.

Each row's first fault is found first: blank (no character but blanks), duplicate (its role and text stand earlier in the
conversation), truncated (the last character that is no blank is not one of ``.!?``).  A forward Viterbi pass over four states
(nothing yet, after system, after user, after assistant) then carries the least (cost, audit) of each state: a row is kept (0), given
another role (3) or deleted (4, the only way for blank and duplicate rows), a truncated row that stays costs 3, and after each row at most
two inserted turns without text (3 each) close the layer: a third would return to a state it left.  Equal costs go to the audit that is
least in ASCII.  Two equally cheap audits of one state are never prefixes of one another, since what is longer holds more inserts,
so the least audit of each state is all that has to be kept.

States that cannot win any more are left out, and what all others agree on is settled and leaves memory, so a very long conversation holds the
rows that are still open.  Its rows go through one task in order, as its audit and digest do.  Faults are found before, dealt
by conversation, role and text; equal rows are counted together first.

Nulls and edges: a null role or text is one blank; null turns come first, rows of one turn are ordered by role and text;
rows with a null conv_id are one conversation; a role's initial is its first character, and one that is no s, u or a cannot be kept;
other columns are ignored, so names cannot clash; a conversation without rows after damage has zeros and empty texts; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os.path
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: OVER[v][w]: most that it costs to follow, from state w, whatever is cheapest from state v.
OVER = ((0, 6, 7, 4), (0, 0, 3, 0), (3, 3, 0, 3), (0, 6, 3, 0))
#: Rows that stay open before the settled ones are looked for.
OPEN = 256
EDIT = "seq long, edit string, turn long, given string, fault string, role string, text string"
LEGAL = ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows with the fault that crc32 of ``conv_id:turn`` gives them, and how often each is there (0: dropped)."""
    blank = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fault = F.pmod(F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    copies = F.when(fault == 0, F.lit(0)).when(fault == 3, F.lit(2)).otherwise(F.lit(1))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, F.lit("user")).otherwise(as_text("role")).alias("role"), text.alias("text"), copies.alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, first, fault of the different rows of ``rows`` (conv_id, turn, role, text and, if there, n); ``first`` says that one of
    the n is not a duplicate, ``fault`` is blank, truncated or null.  Rows with n = 0 give one row of a conversation with n = 0."""
    blank = F.lit(" ")
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    there = rows.select("conv_id", F.when(n > 0, F.col("turn").cast("long")).alias("turn"), F.when(n > 0, F.coalesce(F.col("role").cast("string"), blank)).alias("role"), F.when(n > 0, F.coalesce(F.col("text").cast("string"), blank)).alias("text"), n.alias("n"))
    each = there.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit("blank")).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.lit("truncated"))
    return each.select("*", (F.row_number().over(earlier) == 1).alias("first"), fault.alias("fault"))


def _better(one, other):
    return other if one is None else one if other is None else min(one, other)


def _then(value, cost: int, edit: str):
    return None if value is None else (value[0] + cost, value[1] + edit)


def closed(layer: list) -> list:
    """The layer with up to two turns inserted."""
    for _ in range(2):
        start, system, user, assistant = layer
        for state in (start, system, assistant):
            user = _better(user, _then(state, INSERT, "I"))
        layer = [start, system, user, _better(assistant, _then(layer[USER], INSERT, "I"))]
    return layer


def step(layer: list, initial: str, fault: str | None) -> list:
    """The least (cost, audit) of each state after one more row, its inserts included."""
    after = [_then(state, DELETE, "D") for state in layer]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if initial == "s":
            after[SYSTEM] = _better(after[SYSTEM], _then(layer[START], KEEP + more, "K"))
        user, assistant = ((KEEP, "K") if initial == i else (REROLE, "R") for i in "ua")
        for state in (START, SYSTEM, ASSISTANT):
            after[USER] = _better(after[USER], _then(layer[state], user[0] + more, user[1]))
        after[ASSISTANT] = _better(after[ASSISTANT], _then(layer[USER], assistant[0] + more, assistant[1]))
    return closed(after)


def pruned(layer: list) -> list:
    """The layer without states that some other state beats whatever comes."""
    return [v if v is None or not any(w is not None and w[0] + OVER[k][j] < v[0] for j, w in enumerate(layer) if j != k) else None for k, v in enumerate(layer)]


def cheapest(rows, most_open: int = OPEN):
    """Yields (edit, row, role after it): the cheapest edits of ``rows``, tuples that begin with role and fault; an inserted turn has no row."""
    layer, held, last = closed([(0, ""), None, None, None]), [], ""  # last: initial of the last turn that was given out

    def settle(audit: str):
        nonlocal last
        at = 0
        for edit in audit:
            row = None
            if edit != "I":
                row, at = held[at], at + 1
            if edit == "D":
                yield edit, row, row[0]
                continue
            role = row[0] if edit == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            yield edit, row, role
        del held[:at]

    for row in rows:
        held.append(row)
        layer = step(layer, row[0][:1], row[1])
        if len(held) % most_open == 0:
            layer = pruned(layer)
            agreed = os.path.commonprefix([v[1] for v in layer if v is not None])
            yield from settle(agreed)
            layer = [v and (v[0], v[1][len(agreed) :]) for v in layer]
    yield from settle(min(v for v in (layer[START], layer[ASSISTANT]) if v is not None)[1])


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, seq, edit, turn, given, fault, role, text: the edits of each conversation in order, by initial (Keep, Rerole, Delete, Insert); ``role``
    and ``text`` are those of the repaired turn, and of what was deleted.  A conversation all of whose rows have n = 0 gives one row with a null edit."""
    edits = StructType([rows.schema["conv_id"], *StructType.fromDDL(EDIT).fields])

    def each(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "first", "fault")]
            yield from zip(*cols, strict=True)

    def single(rows):
        for _, turn, role, text, n, first, fault in rows:
            for k in range(n):
                yield role, fault if fault == "blank" or (first and not k) else "duplicate", turn, text

    def edit(batches):
        schema = to_arrow_schema(edits)
        out: list[tuple] = []
        for conv_id, group in groupby(each(batches), key=lambda r: r[0]):
            seq = 0
            for kind, row, role in cheapest(single(group)):
                seq += 1
                given, fault, turn, text = row or (None, None, None, "")
                out.append((conv_id, seq, kind, turn, given, fault, role, text))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                    out = []
            if not seq:
                out.append((conv_id, 0, *[None] * (len(schema) - 2)))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    found = faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return found.mapInArrow(edit, edits)


def summary(edits: DataFrame, dealt: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the edits of ``repair``; ``dealt`` where these come as it left them."""
    counted = StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    counted = StructType([edits.schema["conv_id"], *counted.fields])
    columns = ["conv_id", "edit", "turn", "given", "fault", "role", "text"]

    def each(batches):
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)

    def fold(batches):
        schema = to_arrow_schema(counted)
        out: list[tuple] = []
        for conv_id, rows in groupby(each(batches), key=lambda r: r[0]):
            counts, audit, digest, first = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], hashlib.sha256(), True
            low = high = before = None
            turns = illegal = cost = 0
            for _, edit, turn, given, fault, role, text in rows:
                if edit is None:
                    continue
                audit.append(edit)
                if edit != "I":
                    if fault:
                        counts[fault] += 1
                    illegal += before is not None and before + given[:1] not in LEGAL
                    before = given[:1]
                    if turn is not None and turn != high:
                        low, high, turns = turn if low is None else low, turn, turns + 1
                cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            out.append((conv_id, 0 if low is None else high - low + 1 - turns, *counts.values(), illegal, cost, "".join(audit), digest.hexdigest()))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    rows = edits if dealt else edits.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.select(*columns).mapInArrow(fold, counted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(repair(damaged(table(spark, sf_dir, "conversations"))), dealt=True)


def _plus(value: str, cost: str, edit: str) -> str:
    return f"printf('%012d', substr({value}, 1, 12)::BIGINT + {cost}) || substr({value}, 13) || {edit}"


_INSERTED = f"""SELECT conv_id, i, st, sy, least(us, {_plus("st", "3", "'I'")}, {_plus("sy", "3", "'I'")}, {_plus("ast", "3", "'I'")}) AS us, least(ast, {_plus("us", "3", "'I'")}) AS ast"""
_STAYS = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'"
_TO = {i: (f"CASE WHEN {_STAYS} THEN CASE WHEN ini = '{i}' THEN 0 ELSE 3 END + more END", f"CASE WHEN ini = '{i}' THEN 'K' ELSE 'R' END") for i in "ua"}

SQL = rf"""
WITH RECURSIVE codes AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marked AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(name)), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS f
  FROM named, codes),
after AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM after),
r AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed)),
layer AS (
  SELECT conv_id, 0::BIGINT AS i, printf('%012d', 0) AS st, NULL::VARCHAR AS sy, printf('%012d', 3) || 'I' AS us, printf('%012d', 6) || 'II' AS ast FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  {_INSERTED} FROM ({_INSERTED} FROM (
    SELECT l.conv_id, r.i, {_plus("st", "4", "'D'")} AS st,
      least({_plus("sy", "4", "'D'")}, {_plus("st", f"CASE WHEN {_STAYS} AND ini = 's' THEN more END", "'K'")}) AS sy,
      least({_plus("us", "4", "'D'")}, {_plus("st", *_TO["u"])}, {_plus("sy", *_TO["u"])}, {_plus("ast", *_TO["u"])}) AS us,
      least({_plus("ast", "4", "'D'")}, {_plus("us", *_TO["a"])}) AS ast
    FROM layer l JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1))),
best AS (SELECT conv_id, arg_max(least(st, ast), i) AS b FROM layer GROUP BY conv_id),
answer AS (SELECT conv_id, substr(b, 1, 12)::BIGINT AS cost, substr(b, 13) AS audit FROM best),
chars AS (SELECT conv_id, p, substr(audit, p, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM answer)),
numbered AS (SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i, sum((e <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS j FROM chars),
kept AS (
  SELECT c.conv_id, c.p, c.e, c.j, r.role, r.text, max((c.j = 1 AND c.e = 'K' AND r.ini = 's')::INT) OVER (PARTITION BY c.conv_id) AS led
  FROM numbered c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i AND c.e <> 'I' WHERE c.e <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired FROM kept GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER ((before || ini) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, a.cost::BIGINT AS cost, a.audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM answer a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
