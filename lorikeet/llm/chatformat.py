"""Chat formatting by a template compiler.

A small template language is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures that append to an output. The language is a sandbox: it has the names below, their
fields, literals, comparisons, and/or/not, listed filters, ``for``, ``if`` and ``generation`` blocks; no
calls, attributes of Python objects, imports or unbounded loops exist in it.

    {% for m in messages %}...{% if m.role == "user" %}...{% elif ... %}...{% else %}...{% endif %}{% endfor %}
    {% generation %}{{ m.text | escape }}{% endgeneration %}      what the loss mask covers
    {{ "a" ~ m.role | upper }}                                      output, joined by ~, filtered

The template of a whole conversation is one loop over its messages, with text before and after. That
lets a distributed job render each message where it is: a conversation of any length is never gathered
to be rendered. Digests over a conversation are then streamed in order of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.common import table

#: The control strings of the default template, and how its texts escape them.
TURN_END = "</turn>"
HEADER = "### "
DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    '{% if m.role == "assistant" %}### Assistant: {% generation %}{{ m.text | escape }}{% endgeneration %}'
    '{% elif m.role == "user" %}### User: {{ m.text | escape }}'
    '{% elif m.role == "system" %}### System: {{ m.text | escape }}'
    "{% else %}### @{{ m.role | escape_role }}: {{ m.text | escape }}{% endif %}"
    " </turn>\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- escaping


def escape(text: str) -> str:
    """Backslashes double, and control strings get one in front; ``unescape`` undoes it exactly."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(TURN_END, "\\" + TURN_END)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:|n)", lambda m: "\n" if m[1] == "n" else m[1], role)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_role": escape_role,
    "upper": str.upper,
    "lower": str.lower,
    "trim": str.strip,
}


# ---------------------------------------------------------------- syntax


@dataclass
class Literal:
    value: object


@dataclass
class Name:
    path: tuple[str, ...]


@dataclass
class Filtered:
    value: object
    name: str


@dataclass
class Operation:
    op: str
    args: list


@dataclass
class Output:
    value: object


@dataclass
class If:
    branches: list  # of (condition or None, block)


@dataclass
class Generation:
    block: list


@dataclass
class For:
    name: str
    block: list


@dataclass
class Scanner:
    tokens: list[tuple[str, str]]
    at: int = 0
    names: set[str] = field(default_factory=set)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def take(self, *values: str) -> bool:
        if self.peek()[0] != "string" and self.peek()[1] in values:
            self.at += 1
            return True
        return False


TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>|~().]))""")


def scan(source: str) -> Scanner:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return Scanner(out)


def expression(s: Scanner, level: int = 0):
    """or < and < not < comparison < ~ < filter."""
    if level in (0, 1):
        word = ("or", "and")[level]
        args = [expression(s, level + 1)]
        while s.take(word):
            args.append(expression(s, level + 1))
        return args[0] if len(args) == 1 else Operation(word, args)
    if level == 2:
        return Operation("not", [expression(s, 2)]) if s.take("not") else expression(s, 3)
    if level == 3:
        left = expression(s, 4)
        for op in ("==", "!=", "<=", ">=", "<", ">"):
            if s.take(op):
                return Operation(op, [left, expression(s, 4)])
        return left
    if level == 4:
        args = [expression(s, 5)]
        while s.take("~"):
            args.append(expression(s, 5))
        return args[0] if len(args) == 1 else Operation("~", args)
    value = primary(s)
    while s.take("|"):
        kind, name = s.next()
        if kind != "name" or name not in FILTERS:
            raise TemplateError(f"no filter {name!r}")
        value = Filtered(value, name)
    return value


def primary(s: Scanner):
    if s.take("("):
        value = expression(s)
        if not s.take(")"):
            raise TemplateError("missing )")
        return value
    kind, text = s.next()
    if kind == "string":
        return Literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
    if kind == "number":
        return Literal(int(text))
    if kind == "name" and text in ("true", "false"):
        return Literal(text == "true")
    if kind == "name":
        path = [text]
        while s.take("."):
            kind, part = s.next()
            if kind != "name" or part.startswith("_"):
                raise TemplateError(f"no field {part!r}")
            path.append(part)
        return Name(tuple(path))
    raise TemplateError(f"unexpected {text!r}")


def whole(source: str):
    s = scan(source)
    value = expression(s)
    if s.peek()[0] != "end":
        raise TemplateError(f"unexpected {s.peek()[1]!r}")
    return value


def parse(template: str) -> list:
    """The syntax tree: a list of nodes."""
    pieces = re.split(r"(\{%.*?%\}|\{\{.*?\}\})", template, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                out.append(Output(whole(piece[2:-2])))
            elif piece.startswith("{%"):
                said = piece[2:-2].strip()
                word, _, rest = said.partition(" ")
                if word in ends:
                    return out, said
                if word == "if":
                    branches, condition = [], whole(rest)
                    while True:
                        inner, end = block("elif", "else", "endif")
                        branches.append((condition, inner))
                        if end == "else":
                            branches.append((None, block("endif")[0]))
                            break
                        if end == "endif":
                            break
                        condition = whole(end.partition(" ")[2])
                    out.append(If(branches))
                elif word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+messages", rest.strip())):
                    out.append(For(m[1], block("endfor")[0]))
                elif word == "generation" and not rest:
                    out.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"can't read {{% {said} %}}")
            elif piece:
                out.append(Output(Literal(piece)))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block()[0]


# ---------------------------------------------------------------- folding


COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def text_of(value: object) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def fold_value(e):
    if isinstance(e, Filtered):
        v = fold_value(e.value)
        return Literal(FILTERS[e.name](text_of(v.value))) if isinstance(v, Literal) else Filtered(v, e.name)
    if isinstance(e, Operation):
        args = [fold_value(a) for a in e.args]
        known = all(isinstance(a, Literal) for a in args)
        if e.op == "not" and known:
            return Literal(not args[0].value)
        if e.op in COMPARE and known:
            return Literal(COMPARE[e.op](args[0].value, args[1].value))
        if e.op == "~":
            joined: list = []
            for a in args:
                if isinstance(a, Literal) and joined and isinstance(joined[-1], Literal):
                    joined[-1] = Literal(text_of(joined[-1].value) + text_of(a.value))
                else:
                    joined.append(Literal(text_of(a.value)) if isinstance(a, Literal) else a)
            return joined[0] if len(joined) == 1 else Operation("~", joined)
        if e.op in ("and", "or"):
            stop = e.op == "or"
            rest = []
            for a in args:
                if isinstance(a, Literal) and bool(a.value) == stop:
                    return Literal(stop)  # operands have no side effects
                if not isinstance(a, Literal):
                    rest.append(a)
            return Literal(not stop) if not rest else rest[0] if len(rest) == 1 else Operation(e.op, rest)
        return Operation(e.op, args)
    return e


def fold(block: list) -> list:
    """Constant expressions become literals, decided branches go, and neighbouring literals join."""
    out: list = []
    for node in block:
        if isinstance(node, Output):
            node = Output(fold_value(node.value))
            if isinstance(node.value, Literal):
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Literal):
                    out[-1] = Output(Literal(text_of(out[-1].value.value) + text_of(node.value.value)))
                    continue
                node = Output(Literal(text_of(node.value.value)))
                if not node.value.value:
                    continue
            out.append(node)
        elif isinstance(node, If):
            branches = []
            for condition, inner in node.branches:
                c = fold_value(condition) if condition is not None else Literal(True)
                if isinstance(c, Literal):
                    if c.value:
                        branches.append((None, fold(inner)))
                        break
                else:
                    branches.append((c, fold(inner)))
            if branches and branches[0][0] is None:
                out = fold([*out, *branches[0][1]])
            elif branches:
                out.append(If(branches))
        elif isinstance(node, For):
            out.append(For(node.name, fold(node.block)))
        else:
            out.append(Generation(fold(node.block)))
    return out


# ---------------------------------------------------------------- closures


class Sink:
    """Output parts, and the (start, end) spans of it that the model is to generate."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def value_closure(e) -> Callable[[dict], object]:
    if isinstance(e, Literal):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        head, tail = e.path[0], e.path[1:]

        def look(env: dict) -> object:
            value = env.get(head)
            for part in tail:
                value = value.get(part) if isinstance(value, dict) else None
            return value

        return look
    if isinstance(e, Filtered):
        inner, f = value_closure(e.value), FILTERS[e.name]
        return lambda env: f(text_of(inner(env)))
    args = [value_closure(a) for a in e.args]
    if e.op == "not":
        return lambda env: not args[0](env)
    if e.op == "and":
        return lambda env: all(a(env) for a in args)
    if e.op == "or":
        return lambda env: any(a(env) for a in args)
    if e.op == "~":
        return lambda env: "".join(text_of(a(env)) for a in args)
    compare = COMPARE[e.op]
    return lambda env: compare(args[0](env), args[1](env))


def block_closure(block: list) -> Callable[[dict, Sink], None]:
    steps = [node_closure(n) for n in block]

    def run(env: dict, out: Sink) -> None:
        for step in steps:
            step(env, out)

    return run


def node_closure(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Literal):
            return lambda env, out, text=node.value.value: out.add(text)
        value = value_closure(node.value)
        return lambda env, out: out.add(text_of(value(env)))
    if isinstance(node, If):
        branches = [(value_closure(c) if c is not None else None, block_closure(b)) for c, b in node.branches]

        def choose(env: dict, out: Sink) -> None:
            for condition, inner in branches:
                if condition is None or condition(env):
                    inner(env, out)
                    return

        return choose
    inner = block_closure(node.block)
    if isinstance(node, Generation):

        def mark(env: dict, out: Sink) -> None:
            start = out.size
            inner(env, out)
            out.spans.append((start, out.size))

        return mark

    def loop(env: dict, out: Sink) -> None:
        messages = env.get("messages") or []
        for i, m in enumerate(messages):
            inner({**env, node.name: m, "index": i}, out)

    return loop


def names_in(node: object) -> set[str]:
    """First parts of the names that a node or block reads; a loop reads ``messages``."""
    if isinstance(node, Name):
        return {node.path[0]}
    if isinstance(node, (list, tuple)):
        return set().union(*map(names_in, node))
    own = {"messages"} if isinstance(node, For) else set()
    return own.union(*map(names_in, vars(node).values())) if hasattr(node, "__dataclass_fields__") else own


class Template:
    """A compiled template. ``render`` makes a whole conversation; ``parts`` renders it message by message."""

    def __init__(self, source: str = DEFAULT_TEMPLATE):
        self.source = source
        tree = fold(parse(source))
        loops = [i for i, n in enumerate(tree) if isinstance(n, For)]
        self.run = block_closure(tree)
        self.by_message = len(loops) == 1
        #: What a message's own rendering can't supply.
        self.missing: set[str] = set()
        if self.by_message:
            i = loops[0]
            self.missing = (names_in(tree[i].block) - {tree[i].name}) & {"index", "messages"}
            self.name = tree[i].name
            self.before, self.body, self.after = block_closure(tree[:i]), block_closure(tree[i].block), block_closure(tree[i + 1 :])

    def __reduce__(self):
        return Template, (self.source,)

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Sink()
        self.run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    def message(self, role: str | None, text: str | None) -> tuple[str, list[tuple[int, int]]]:
        if self.missing:
            raise TemplateError(f"a message alone has no {' and no '.join(sorted(self.missing))}")
        out = Sink()
        self.body({self.name: {"role": role or "", "text": text or ""}}, out)
        return "".join(out.parts), out.spans


# ---------------------------------------------------------------- reading back


MARKS = re.compile(r"\\(?:\\|###|</turn>|:|n)|### (Assistant|User|System|@((?:[^\\:\n]|\\.)*)): | </turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in what the default template made."""
    out, role, start = [], None, 0
    for m in MARKS.finditer(formatted):
        if m[0].startswith("\\"):
            continue
        if m[0].startswith("###"):
            role, start = (unescape_role(m[2]) if m[2] is not None else m[1].lower()), m.end()
        elif role is not None:
            out.append((role, unescape(formatted[start : m.start()])))
            role = None
    return out


#: Turns that hold all marks of the default template and their escapes.
PROBE = [("user", "a\\ ### User: b </turn>\n c"), ("assistant", "### Assistant: \\### </turn>"), ("system", ""), ("tool:x\n", "\\n: d"), ("", "@e")]


def can_read_back(template: Template) -> bool:
    """Whether ``read_back`` and the marked spans give the turns again that the template formats, message by message."""
    made = [template.message(role, text) for role, text in PROBE]
    said = "".join(unescape(text[a:b]) for text, spans in made for a, b in spans)
    return [read_back(text) for text, _ in made] == [[turn] for turn in PROBE] and said == "".join(t for r, t in PROBE if r == "assistant")


# ---------------------------------------------------------------- operator


def format_messages(rows: DataFrame, template: Template) -> DataFrame:
    """Each row's columns with ``formatted`` and ``spans`` (start, end of what the loss covers, in code points).

    Rows need ``role`` and ``text``; nulls count as empty. Messages are rendered where they are.
    """
    if not template.by_message:
        raise TemplateError("the template must have one loop over messages")
    if template.missing:
        raise TemplateError(f"a message alone has no {' and no '.join(sorted(template.missing))}")
    rows = rows.drop("formatted", "spans")
    names, n = rows.columns, len(rows.columns)
    role_at, text_at = names.index("role"), names.index("text")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [template.message(r, t) for r, t in zip(b.column(role_at).to_pylist(), b.column(text_at).to_pylist(), strict=True)]
            cols = [pa.array([f for f, _ in found], pa.string()), pa.array([[{"start": a, "end": e} for a, e in s] for _, s in found], spans)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*(f"c{i}" for i in range(n)), "formatted", "spans"])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema))
    return rows.mapInArrow(run, f"{kinds}, formatted string, spans array<struct<start:long,end:long>>").toDF(*names, "formatted", "spans")


def conversation_digests(formatted: DataFrame, template: Template) -> DataFrame:
    """A row per conversation, read back from the formatted messages in order of turns.

    Conversations are hashed streams: a task holds one batch at a time, however long a conversation is.
    A digest is a chain over all of a conversation, so that much has to pass one task in order.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "spans")
    head, tail = Sink(), Sink()
    template.before({}, head)
    template.after({}, tail)
    outside = head.size + tail.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        done: list[tuple] = []

        def fresh() -> dict:
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": outside}

        def close() -> None:
            done.append((now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        state = fresh()
        for b in batches:
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if started and conv != now:
                    close()
                    state = fresh()
                now, started = conv, True
                state["chars"] += len(text)
                for role, said in read_back(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    state["loss_chars"] += len(said)
                    state["loss"].update(said.encode())
            yield flush()
        if started:
            close()
            yield flush()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Digests of each formatted conversation (conv_id, turn, role, text), read back from what was formatted.

    Raises TemplateError for a template whose turns can't be read back: one with marks or escapes other than
    the default's. ``format_messages`` takes any template with one loop.
    Null roles and texts count as empty; null conv_ids are one conversation; null turns come first; rows
    with equal turns follow each other by role, then text, and repeated rows are repeated turns. Empty
    input gives no rows. Other columns are ignored.
    """
    compiled = Template(template)
    if not compiled.by_message or compiled.missing or not can_read_back(compiled):
        raise TemplateError("turns that this template formats can't be read back")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversation_digests(format_messages(rows, compiled), compiled)


#: Conversation -7: its texts hold the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return format_conversations(rows.unionByName(extra))


OP3_SQL = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS escaped FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + 4 + CASE role WHEN 'assistant' THEN 9 WHEN 'user' THEN 4 WHEN 'system' THEN 6
           ELSE 1 + length(replace(replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>'), ':', '\\:'), chr(10), '\\n')) END
           + 2 + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
