"""Chat formatting with a template compiler.

``compile_template`` parses a small template language into a syntax tree, folds constants, and makes Python closures of
it.  The language has ``{{ expression }}``, ``{% for x in messages %}``, ``{% if %} {% elif %} {% else %}``,
``{% set %}`` and ``{% generation %}``; expressions have literals, names, fields (``m.role``, ``m['role']``),
``loop.first``, ``loop.last``, ``loop.index``, ``== != + and or not in`` and the filters of FILTERS.  There are no calls
and no attributes of Python objects: a field is a key of a message, so templates cannot reach out.

Rendering is a stream: messages come in one by one, text goes out in pieces with the spans of what the
assistant is to learn.  ``render`` sorts the turns of each conversation within a partition and writes rows of
about PIECE characters, so a conversation of any length is held one turn at a time.  The filter ``guard`` breaks
up control strings inside texts, and ``unguard`` restores them.  ``read_back`` parses the rendered text again.

Nulls and edges: conv_id keeps its type, be it a number or text; a null text or role is empty; a null conv_id is a conversation of its own; turns that are equal, or
null (first), are taken by role and text; repeated rows are turns of their own; other columns are ignored, so
names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, table

CONTROL = ("[INST]", "[/INST]", "</s>", "<|", "|>")
TEMPLATE = """{% for m in messages %}{% if m.role == 'user' %}{{ '[INST]' + ' ' }}{{ m.text | guard }} [/INST]\
{% elif m.role == 'assistant' %} {% generation %}{{ m.text | guard }}{% endgeneration %}</s>\
{% else %}<|{{ m.role | guard }}|>{{ m.text | guard }}<|end|>{% endif %}{% endfor %}"""
PIECE = 4096
_BROKEN = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))


def guard(text: str) -> str:
    """No control string stays whole: a backslash goes after its first character; backslashes are doubled."""
    return _BROKEN.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unguard(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"guard": guard, "trim": str.strip, "upper": str.upper, "lower": str.lower}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()\[\]]))")


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; trees are tuples: (kind, parts...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            kind = ("text", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()

    def next(self, *wanted: str) -> str | None:
        """Takes the next token if it is one of these names or signs."""
        if self.tokens and self.tokens[0][0] in ("name", "sign") and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.next("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.next("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.next("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.sum()
        while sign := self.next("==", "!=", "in"):
            tree = (sign, tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while self.next("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.single()
        while self.next("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", tree, name)
        return tree

    def single(self) -> tuple:
        if not self.tokens:
            raise TemplateError("an expression ends too early")
        if self.next("("):
            tree = self.either()
            if not self.next(")"):
                raise TemplateError("a bracket is not closed")
            return tree
        kind, value = self.tokens.pop(0)
        if kind == "text":
            return ("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return ("constant", int(value))
        if kind == "sign":
            raise TemplateError(f"unexpected {value!r}")
        tree = ("constant", {"true": True, "false": False}[value]) if value in ("true", "false") else ("name", value)
        while sign := self.next(".", "["):
            kind, field = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != ("name" if sign == "." else "text") or sign == "[" and not self.next("]"):
                raise TemplateError(f"no field {field!r}")
            tree = ("field", tree, field if sign == "." else field[1:-1])
        return tree


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: text, out, if, for, set and generation nodes."""
    root: list[tuple] = []
    stack: list[tuple[str, list]] = [("", root)]
    branches: list[list] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("out", _Expression(m[1]).whole()))
        if m[2] is None:
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            f = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(messages)\s*", rest)
            if not f:
                raise TemplateError(f"for {rest!r}: only messages can be gone through")
            body: list[tuple] = []
            stack[-1][1].append(("for", f[1], body))
            stack.append(("for", body))
        elif word == "if":
            branches.append([(_Expression(rest).whole(), [])])
            stack[-1][1].append(("if", branches[-1]))
            stack.append(("if", branches[-1][0][1]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            branches[-1].append((_Expression(rest).whole() if word == "elif" else ("constant", True), []))
            stack[-1] = ("if", branches[-1][-1][1])
        elif word == "set":
            name, equal, value = rest.partition("=")
            if not equal or not name.strip().isidentifier():
                raise TemplateError(f"set {rest!r}")
            stack[-1][1].append(("set", name.strip(), _Expression(value).whole()))
        elif word == "generation":
            body = []
            stack[-1][1].append(("generation", body))
            stack.append(("generation", body))
        elif word[:3] == "end" and len(stack) > 1 and stack[-1][0] == word[3:]:
            if stack.pop()[0] == "if":
                branches.pop()
        else:
            raise TemplateError(f"unexpected tag {m[2]!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


def _text(value: object) -> str:
    return "" if value is None else str(value)


_TWO = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: _text(a) in _text(b), "+": lambda a, b: _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b}


def fold_expression(tree: tuple) -> tuple:
    """The tree with all parts that depend on no name computed."""
    kind = tree[0]
    if kind in ("constant", "name"):
        return tree
    parts = [fold_expression(x) if isinstance(x, tuple) else x for x in tree[1:]]
    if kind in ("and", "or") and parts[0][0] == "constant":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    tree = (kind, *parts)
    if kind != "field" and all(x[0] == "constant" for x in parts if isinstance(x, tuple)):
        return ("constant", evaluator(tree)({}))
    return tree


def fold(nodes: list[tuple]) -> list[tuple]:
    """The nodes with constants computed, neighbouring texts joined and branches that cannot be taken left out."""
    out: list[tuple] = []
    for kind, *rest in nodes:
        found: list[tuple]
        if kind == "out":
            tree = fold_expression(rest[0])
            found = [("text", _text(tree[1]))] if tree[0] == "constant" else [("out", tree)]
        elif kind == "if":
            kept = []
            for test, body in rest[0]:
                test = fold_expression(test)
                if test[0] != "constant" or test[1]:
                    kept.append((test, fold(body)))
                if test[0] == "constant" and test[1]:
                    break
            found = kept[0][1] if kept and kept[0][0][0] == "constant" else [("if", kept)] if kept else []
        elif kind == "for":
            found = [("for", rest[0], fold(rest[1]))]
        elif kind == "set":
            found = [("set", rest[0], fold_expression(rest[1]))]
        elif kind == "generation":
            found = [("generation", fold(rest[0]))]
        else:
            found = [(kind, *rest)]
        for node in found:
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)
    return out


def evaluator(tree: tuple) -> Callable[[dict], object]:
    """A closure that computes the expression from the names in reach."""
    kind = tree[0]
    if kind == "constant":
        return lambda names, value=tree[1]: value
    if kind == "name":
        return lambda names, name=tree[1]: names.get(name)
    if kind == "field":
        inner = evaluator(tree[1])
        return lambda names, field=tree[2]: x.get(field) if isinstance(x := inner(names), dict) else None
    if kind == "filter":
        inner, f = evaluator(tree[1]), FILTERS[tree[2]]
        return lambda names: f(_text(inner(names)))
    if kind == "not":
        inner = evaluator(tree[1])
        return lambda names: not inner(names)
    left, right = evaluator(tree[1]), evaluator(tree[2])
    if kind == "and":
        return lambda names: left(names) and right(names)
    if kind == "or":
        return lambda names: left(names) or right(names)
    two = _TWO[kind]
    return lambda names: two(left(names), right(names))


Writer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _with_loop(messages: Iterable[dict]) -> Iterator[tuple[dict, dict]]:
    """Each message with what ``loop`` tells of it; one message is held back, to know the last."""
    rest = iter(messages)
    held, count = next(rest, None), 0
    while held is not None:
        following, count = next(rest, None), count + 1
        yield held, {"first": count == 1, "last": following is None, "index": count}
        held = following


def writer(nodes: list[tuple]) -> Writer:
    """A closure that writes the nodes: pieces of text, and whether they lie between generation marks."""

    def one(node: tuple) -> Writer:
        kind = node[0]
        if kind == "text":
            return lambda names, marked, text=node[1]: iter(((text, marked),))
        if kind == "out":
            value = evaluator(node[1])
            return lambda names, marked: iter(((_text(value(names)), marked),))
        if kind == "generation":
            inside = writer(node[1])
            return lambda names, marked: inside(names, True)
        if kind == "set":
            value = evaluator(node[2])

            def assign(names, marked):
                names[node[1]] = value(names)
                return iter(())

            return assign
        if kind == "if":
            branches = [(evaluator(test), writer(body)) for test, body in node[1]]

            def choose(names, marked):
                for test, body in branches:
                    if test(names):
                        return body(names, marked)
                return iter(())

            return choose
        body = writer(node[2])

        def repeat(names, marked):
            for message, loop in _with_loop(names["messages"]):
                yield from body(names | {node[1]: message, "loop": loop}, marked)

        return repeat

    parts = [one(n) for n in nodes]

    def write(names, marked):
        for part in parts:
            yield from part(names, marked)

    return write


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (dicts with role and text) to pieces of text and their generation mark."""
    write = writer(fold(parse(source)))
    return lambda messages: write({"messages": messages}, False)


def _sorted_rows(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def render(conversations: DataFrame, template: str = TEMPLATE, piece: int = PIECE) -> DataFrame:
    """conv_id, seq, text, loss: the formatted conversations in pieces, with the spans to learn in each."""
    compile_template(template)  # a template that is wrong fails here
    id_type = conversations.schema["conv_id"].dataType
    first_type = to_arrow_type(id_type)

    def write(batches):
        to_text = compile_template(template)
        schema = pa.schema([("conv_id", first_type), ("seq", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        out: list[dict] = []
        for conv_id, rows in groupby(_sorted_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            seq, parts, spans, size = 0, [], [], 0
            for text, marked in to_text({"role": r[1], "text": r[2]} for r in rows):
                if marked and text:
                    spans.append({"start": size, "end": size + len(text)})
                parts.append(text)
                size += len(text)
                if size >= piece:
                    out.append({"conv_id": conv_id, "seq": seq, "text": "".join(parts), "loss": spans})
                    seq, parts, spans, size = seq + 1, [], [], 0
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
            if parts or not seq:
                out.append({"conv_id": conv_id, "seq": seq, "text": "".join(parts), "loss": spans})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    none = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(write, f"conv_id {id_type.simpleString()}, seq long, text string, loss array<struct<start: int, end: int>>")


_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<\|(?P<role>.*?)\|>(?P<other>.*?)<\|end\|>| (?P<assistant>.*?)</s>", re.S)


def read_turns(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts from what TEMPLATE wrote, given in pieces cut anywhere."""
    held = ""
    for piece in pieces:
        held += piece
        at = 0
        while m := _TURN.match(held, at):
            at = m.end()
            role = "user" if m["user"] is not None else "assistant" if m["assistant"] is not None else unguard(m["role"])
            yield role, unguard(next(x for x in (m["user"], m["assistant"], m["other"]) if x is not None))
        held = held[at:]
    if held:
        raise ValueError(f"no turn: {held[:80]!r}")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text and its spans."""
    id_type = rendered.schema["conv_id"].dataType
    first_type = to_arrow_type(id_type)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(v, first_type if n == "conv_id" else None) for n, v in out.items()], names=list(out))

    def read(batches):
        out: dict[str, list] = {n: [] for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for conv_id, rows in groupby(_sorted_rows(batches, "conv_id", "text", "loss"), key=lambda r: r[0]):
            turns, loss, count, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def pieces(rows=rows, loss=loss):
                nonlocal chars, size
                for _, text, spans in rows:
                    size += len(text)
                    for s in spans:
                        plain = unguard(text[s["start"] : s["end"]])
                        chars += len(plain)
                        loss.update(plain.encode())
                    yield text

            for role, text in read_turns(pieces()):
                count += 1
                turns.update(f"{role}\n{text}\n".encode())
            for name, value in zip(out, (conv_id, count, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True):
                out[name].append(value)
            if len(out["conv_id"]) >= 4096:
                yield batch_of(out)
                out = {n: [] for n in out}
        if out["conv_id"]:
            yield batch_of(out)

    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "text", "loss")
    return rows.mapInArrow(read, f"conv_id {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(stored(render(every), "formatted"))


SQL = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'),
    '</s>', '<' || chr(92) || '/s>'), '<|', '<' || chr(92) || '|'), '|>', '|' || chr(92) || '>')) AS len
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(len + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE length(role) + 11 END)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""
