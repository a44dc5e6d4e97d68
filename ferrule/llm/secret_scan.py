"""Secret scan by fixed patterns and by assignment-aware lexing.

The patterns find labelled values, access keys and long hexadecimal runs. The lexer goes
further: it reads source and configuration syntax into (name, literal) pairs, keeps the
literals of a text's constants by name, follows a name on a right-hand side to its literal
(``default = "x"; password = default``), and scores every literal by the name that it reaches:
how sensitive the name's words are, and how far the literal looks random. A literal is
reported where it stands in the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import text_slices

# The base patterns of the contract, with the least length of the value that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")      # the runs of [0-9a-f]+ of 16 characters or more
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "lexed")

#: Words of a name that make it sensitive, alone or as neighbours, with their weight.
SENSITIVE = {("password",): 1.0, ("passwd",): 1.0, ("pwd",): 0.9, ("pass",): 0.9, ("passphrase",): 1.0, ("secret",): 1.0, ("token",): 0.9,
             ("apikey",): 1.0, ("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("auth", "key"): 0.9,
             ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("credential",): 0.9, ("credentials",): 0.9,
             ("authorization",): 0.8, ("bearer",): 0.8, ("connection", "string"): 0.7}
#: Words of a literal that mark a stand-in.
STAND_IN = re.compile(r"(?i)^(?:changeme|change_me|example.*|placeholder|your[-_ ].*|todo|none|null|true|false|xxx+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")
#: The stand-ins that a value of any length may begin with.
STAND_IN_BEGIN = re.compile(r"(?i)example|your[-_ ]")
LEAST_SCORE = 1.0

#: A "/" after ":" is a URL's; after "=" it begins a value.
OPERATOR = re.compile(r"(?<![=!<>:])(?:(?::=|=>|=)(?![=:])|:(?![=:/]))")
NAME_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
NAME_RUN = re.compile(r"[A-Za-z0-9_.\-]*")
GAP = re.compile(r"[ \t]*")
QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
BARE = re.compile(r"[^\s,;'\"`(){}\[\]<>+&|]+")
#: What stands between ":" and "=" in a declaration, brackets left out: a type, which may be borrowed, optional or a union.
TYPE = re.compile(r"""[ \t]*(?:[&*][ \t]*)*+(?:'[a-z_]+[ \t]+)?(?:(?:mut|const|dyn|readonly|unsigned)[ \t]+)?
                      (?:[A-Za-z_][A-Za-z0-9_.]*(?:::[A-Za-z0-9_.]+)*[ \t]*)?[?*&]*[ \t]*
                      (?:\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:::[A-Za-z0-9_.]+)*[ \t]*)*""", re.VERBOSE)
#: A quoted type, as in a forward reference.
QUOTED_TYPE = re.compile(r"""[ \t]*(["'])[A-Za-z_][A-Za-z0-9_.,<>\[\]| \t]*\1[ \t]*""")
BLANKS = re.compile(r"[ \t]+")
SUBSCRIPT = re.compile(r"""\[[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|`([^`\n]*)`|([A-Za-z0-9_.\-]*))[ \t]*\]""")
#: What leads from one term of a value to the next.
JOIN = re.compile(r"[ \t]*(?:\+|\|\||\?\?|or\b)[ \t]*")
#: What may stand before a term: brackets, and a line's end if a literal in quotes follows.
LEAD = re.compile(r"""[ \t]*(?:\(\s*)*(?:\\?\r?\n[ \t]*(?=["'`]))?""")
#: Letters before a literal's quotes, and calls whose first argument is a name.
PREFIX = re.compile(r"""(?:[fFbBrRuU]{1,2}|u8|L)(?=["'])""")
LOOKUP = ("getenv", "get", "env")
ARGUMENT = re.compile(r"[ \t]*,?[ \t]*")
CLOSE = re.compile(r"[ \t]*\)")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    """How sensitive a name is: the largest weight of its words or neighbouring words."""
    words = [w.lower() for w in PART.findall(name)]
    return max([SENSITIVE.get(tuple(words[i:i + n]), 0.0) for n in (1, 2) for i in range(len(words) - n + 1)], default=0.0)


def literal_weight(value: str) -> float:
    """-1 for stand-ins and short values; else up to 0.6 by length, kinds of characters and entropy."""
    if len(value) < 6 or STAND_IN.match(value) or len(set(value)) < 4:
        return -1.0
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    plain = value.isalpha() and (value.islower() or value.istitle())
    return 0.2 * (len(value) >= 8) + 0.2 * (kinds >= 2) + 0.2 * (entropy >= 3.0) - 0.6 * plain


class Value:
    """What a name stands for: spans of its own literals, and the values of the constants that it is made of."""

    __slots__ = ("spans", "parts", "scored")

    def __init__(self, spans: list[tuple[int, int]], parts: list[Value]):
        self.spans, self.parts, self.scored = spans, parts, 0.0

    def sensitive(self, reader: Reader, weight: float) -> Iterator[tuple[int, int]]:
        """Spans that reach the least score under a name of ``weight``, those given out for this weight or more left out.

        So each value is read once for each weight of a name, however long the chains of constants are.
        """
        waiting = [self]
        while waiting:
            value = waiting.pop()
            if value.scored < weight:
                value.scored = weight
                yield from ((a, b) for a, b in value.spans if weight + reader.weight(a, b) >= LEAST_SCORE)
                waiting += value.parts


class Reader:
    """The values of one text, each place read once, however many operators stand in one word or chain of terms."""

    def __init__(self, text: str):
        self.text = text
        self.run = (0, 0, 0)                        # the last bare run: from, to, to without the dots at its end
        self.chains: dict[int, Value | None] = {}   # values by where their first term begins
        self.open: set[str] = set()                 # triple quotes that nothing closes any more
        self.weights: dict[tuple[int, int], float] = {}

    def bare(self, at: int) -> tuple[int, int] | None:
        """Where the bare word at ``at`` ends, with and without the dots at its end; none if there is none."""
        lo, hi, last = self.run
        if not lo <= at < hi:
            if not (m := BARE.match(self.text, at)):
                return None
            hi = last = m.end()
            while last > at and self.text[last - 1] == ".":
                last -= 1
            self.run = (at, hi, last)
        return hi, max(at, last)

    def quoted(self, at: int) -> tuple[int, int, int] | None:
        """A literal in quotes, with letters before them or without: its span and where it ends."""
        if m := PREFIX.match(self.text, at):
            at = m.end()
        for mark in ('"""', "'''"):
            if mark not in self.open and self.text.startswith(mark, at):
                if (end := self.text.find(mark, at + 3)) >= 0:
                    return at + 3, end, end + 3
                self.open.add(mark)
        return (m.start() + 1, m.end() - 1, m.end()) if (m := QUOTED.match(self.text, at)) else None

    def arguments(self, at: int, skip: bool) -> tuple[list[tuple[int, int]], int]:
        """The literals in quotes among a call's arguments, and where the call, or what could be read of it, ends."""
        spans = []
        while True:
            at = ARGUMENT.match(self.text, at).end()
            if q := self.quoted(at):
                spans.append(q[:2])
                at = q[2]
            elif not skip and (m := NAME_RUN.match(self.text, at)) and m.end() > at:
                at = m.end()
            else:
                break
            if skip:
                spans, skip = [], False
        return spans, m.end() if (m := CLOSE.match(self.text, at)) else at

    def value(self, at: int, known: dict[str, Value]) -> Value | None:
        """The value at ``at``: literals quoted or bare, and named constants, joined by +, "or" and the like; none if there is nothing."""
        terms, at = [], LEAD.match(self.text, at).end()
        rest = None
        while at not in self.chains:
            spans, part, end = self.term(at, known)
            terms.append((at, spans, part))
            if end is None or not (m := JOIN.match(self.text, end)):
                break
            at = LEAD.match(self.text, m.end()).end()
        else:
            rest = self.chains[at]
        for start, spans, part in reversed(terms):      # a chain's later terms are a value of their own
            spans = [s for s in spans if s[0] < s[1]]
            parts = [v for v in (part, rest) if v is not None]
            rest = self.chains[start] = Value(spans, parts) if spans or parts else None
        return rest

    def term(self, at: int, known: dict[str, Value]) -> tuple[list[tuple[int, int]], Value | None, int | None]:
        """Spans of one term's literals, the constant that it names, and where it ends (none if there is no term)."""
        text = self.text
        if q := self.quoted(at):
            return [q[:2]], None, q[2]
        if not (run := self.bare(at)):
            return [], None, None
        end, last = run
        plain = NAME_RUN.match(text, at).end() >= last      # no operator in the word: it may be a name
        if text.startswith("(", end) and plain and last > at:
            spans, end = self.arguments(end + 1, text[at:last].rpartition(".")[2].lower() in LOOKUP)
            return spans, None, end
        keys = []
        while n := SUBSCRIPT.match(text, end):              # config["key"] is one term, its key a part of the name
            keys.append(n[n.lastindex])
            end = n.end()
        if plain:
            word = text[at:last]
            if word in ("Bearer", "Basic") and (more := self.bare(start := GAP.match(text, end).end())):
                return [(start, more[0])], None, more[0]
            if v := known.get(".".join([word, *keys])) or known.get(word):
                return [], v, end
        return [(at, last)], None, end

    def weight(self, a: int, b: int) -> float:
        """``literal_weight`` of a span. The long ends of one bare run share a single pass over it."""
        if b - a <= 256:
            return literal_weight(self.text[a:b])
        if (a, b) not in self.weights:
            if not (m := BARE.match(self.text, a)) or m.end() < b:
                self.weights[a, b] = literal_weight(self.text[a:b])
            else:
                self.ends(a, b)
        return self.weights[a, b]

    def ends(self, a: int, b: int) -> None:
        """Weights of what reaches from any operator after ``a``, and from ``a`` itself, to ``b``, in one pass from the end."""
        text, counts, total = self.text, Counter(), 0.0
        lower = upper = digit = other = letters = 0
        begins = {a, *(m.end() for m in OPERATOR.finditer(text, a, b))}
        for i in range(b - 1, a - 1, -1):
            c = text[i]
            n = counts[c]
            total += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
            counts[c] = n + 1
            lower += c.islower()
            upper += c.isupper()
            digit += c.isdigit()
            other += not c.isalnum()
            letters += c.isalpha()
            size = b - i
            if i not in begins or size <= 256:
                continue
            if len(counts) < 4 or STAND_IN_BEGIN.match(text, i):
                self.weights[i, b] = -1.0
                continue
            kinds = (lower > 0) + (upper > 0) + (digit > 0) + (other > 0)
            plain = letters == size and (upper == 0 and lower > 0 or upper == 1 and text[i].isupper())
            self.weights[i, b] = 0.2 + 0.2 * (kinds >= 2) + 0.2 * (math.log2(size) - total / size >= 3.0) - 0.6 * plain


def _name(left: str) -> str:
    """The name, bare or quoted, that ends a text, or the empty text."""
    left = left.rstrip(" \t")
    left = left[:-1] if left[-1:] in ("'", '"', "`") else left
    return left[len(left.rstrip(NAME_CHARS)):].lstrip("0123456789.-")


def _keys(text: str, end: int) -> tuple[int, list[str]]:
    """Where the subscripts that end at ``end`` begin, and their keys in order; ``end`` and none if there are none."""
    keys: list[str] = []
    at = end
    while True:
        lo = at
        while lo and text[lo - 1] in " \t":
            lo -= 1
        if not lo or text[lo - 1] != "]":
            break
        lo -= 1
        while lo and text[lo - 1] in " \t":
            lo -= 1
        hi = lo
        if lo and text[lo - 1] in "\"'`":
            hi -= 1
            lo = text.rfind(text[hi], 0, hi)
            key, quoted = text[lo + 1:hi], True
            if lo < 0 or "\n" in key:
                break
        else:
            while lo and text[lo - 1] in NAME_CHARS:
                lo -= 1
            key, quoted = text[lo:hi], False
        while lo and text[lo - 1] in " \t":
            lo -= 1
        if not lo or text[lo - 1] != "[":
            break
        at = lo - 1
        keys.append(key)
    return at, keys[::-1]


def _is_type(between: str) -> bool:
    """Whether this is a type, its brackets of any depth closed."""
    depth, outside = 0, []
    for c in between:
        depth += (c in "[<") - (c in "]>")
        if depth < 0 or c == "\n":
            return False
        if not depth and c not in "]>":
            outside.append(c)
    return depth == 0 and bool(TYPE.fullmatch(BLANKS.sub(" ", "".join(outside))) or QUOTED_TYPE.fullmatch(between))


def _names(text: str, last: int, end: int) -> tuple[str, list[str]]:
    """The whole name before an operator at ``end``, and the names that its constant goes by.

    ``last`` is the end of the operator before; a key in quotes may hold operators itself.
    """
    begin, keys = _keys(text, end)
    if not keys:
        name = _name(text[last:end])
        return name, [name, name.rpartition(".")[2]]
    while begin and text[begin - 1] in " \t":
        begin -= 1
    lo = begin
    while lo and text[lo - 1] in NAME_CHARS:
        lo -= 1
    base = text[lo:begin].lstrip("0123456789.-")
    name = ".".join([base, *keys]) if base else ""
    own = [name] if any(keys) and not all(k.isdigit() or not k for k in keys) else [name, base]
    return name, own


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, in order, each once.

    A name may have subscripts (``config["db_password"] = ..``, ``char key[32] = ..``) and a type
    (``password: str = ..``, ``const TOKEN: &str = ..``); a declared literal goes by the declared name
    and by what stands before the "=".
    """
    known: dict[str, Value] = {}
    reader = Reader(text)
    found: set[tuple[int, int]] = set()
    last = 0                            # a name holds no operator, so it stands after the last one
    declared: list[str] = []            # the names before the last operator, if that was ":"
    for op in OPERATOR.finditer(text):
        name, own = _names(text, last, op.start())
        between = text[last:op.start()] if op[0] == "=" and declared else "\n"
        if _is_type(between):
            names = [declared[0], *([] if not name or "[" in between else [name])]
            own = declared + (own if len(names) > 1 else [])
        else:
            names = [name] if name else []
        declared = own if op[0] == ":" and name else []
        last = op.end()
        if not names or not (value := reader.value(op.end(), known)):
            continue
        known.update((n, value) for n in own if n)
        if weight := max(map(name_weight, names)):
            found.update(value.sensitive(reader, weight))
    return sorted(found)


def scan(text: str | None) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, value_start)`` in code points, by start and kind; the value is what a redaction takes out.

    The lexer's spans inside a base span aren't repeated. Null counts as empty.
    """
    if not text:
        return []
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        base = sorted(s[1:3] for s in spans)
        far, at, reach = lexed(text), 0, -1         # both by start: of the base spans that begin before, the farthest end
        for a, b in far:
            while at < len(base) and base[at][0] <= a:
                reach = max(reach, base[at][1])
                at += 1
            if b > reach:
                spans.append(("lexed", a, b, a))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int, int]], mark: str) -> str:
    """The text with the values of all spans replaced; overlapping values become one mark."""
    out, at = [], 0
    for lo, hi in sorted((s[3], s[2]) for s in spans):
        if lo >= at:
            out += [text[at:lo], mark]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans``: every row's spans as an array of (kind, start, end, value_start), ordered by start and kind.

    Null and empty texts have none. Rows stay as they are, repeated or not; other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "value_start")
        for part in text_slices(batches, 1):
            spans = [[dict(zip(names, s, strict=True)) for s in scan(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"k": part.column(0), "spans": pa.array(spans, pa.list_(item))})

    schema = f"k {kind}, spans array<struct<kind:string,start:long,end:long,value_start:long>>"
    return docs.select(key, text).mapInArrow(work, schema).withColumnRenamed("k", key)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "<SECRET>", length: str | None = None) -> DataFrame:
    """The same rows and columns, with the value of every found secret replaced by ``mark``.

    Null texts stay null. ``length`` names a column that holds the text's code points; it is set
    anew where a text changed. All other columns pass through untouched.
    """
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            old = part.column(at).to_pylist()
            new = [redact(t, s, mark) if (s := scan(t)) else t for t in old]
            columns = list(part.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                columns[size] = pa.array([len(n) if n is not o else v for o, n, v in zip(old, new, columns[size].to_pylist(), strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(work, docs.schema)


ship_by_value(__name__)
