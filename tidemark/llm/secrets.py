"""Secret scans: assignments are lexed into names and literals, constants are carried on, literals are scored."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, some, spare, strings

# fixed patterns of the base kinds, with the least length of the secret in each
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")
_TARGETS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# words of a target name and how much they tell of a secret
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9,
             "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "authkey": 1.0,
             "bearer": 0.8, "auth": 0.5, "authorization": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.5, "dsn": 0.5}
# words that turn a name into one about a secret, not of one
HARMLESS = {"public", "hash", "length", "len", "name", "id", "url", "path", "file", "field", "type", "count", "min",
            "max", "policy", "expiry", "ttl", "hint", "label", "prompt", "placeholder"}
# words of a placeholder, anywhere in a literal
_PLACEHOLDERS = ("example", "changeme", "change_me", "placeholder", "dummy", "your-", "your_", "your ", "todo", "redacted", "null", "none", "undefined")
_HELD = max(map(len, _PLACEHOLDERS)) - 1
# literals that are white space between chunks are keys wrapped over lines if a chunk has so many characters on average, else prose
LEAST_CHUNK = 16
# lengths beyond it are all alike
_LONGEST = 1e250
# one token of source or configuration: the head of a PEM block, a quote, a name, an operator of assignment or joining,
# or a line's end; every alternative is linear, and any other character is skipped by the search
_LEX = re.compile(r"""(?P<p>-----BEGIN [A-Z0-9 ]{1,60}-----)|(?P<t>\"{3}|'{3})|(?P<q>["'`])"""
                  r"""|(?P<n>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_][\w$]*)*)|(?P<o>:=|=>|==|!=|<=|>=|[=:+])|(?P<e>\n|[;,{}()\[\]])"""
                  r"""|(?P<v>[A-Za-z0-9+/_.~!@%^&*-]+)""", re.A)
# what a quote holds on its line; a backslash takes the next character with it
_INSIDE = {q: re.compile(rf"[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*") for q in "\"'"} | {"`": re.compile(r"[^`\n]*")}
_PEM_END = re.compile(r"-----END [A-Z0-9 ]{1,60}-----")
_ASSIGNS = {"=", ":", ":=", "=>"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a target name is, 0 to 1: its words and neighbouring pairs of words, split at case and signs."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    best = max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)
    return best * (0.3 if words and words[-1] in HARMLESS or "public" in words else 1.0)


def _placeholder(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _PLACEHOLDERS)


class Places:
    """Where the literals of a value are written: one place, or those of two parts, which other values share."""

    __slots__ = ("place", "parts")

    def __init__(self, place: tuple[int, int] | None = None, parts: tuple[Places, ...] = ()):
        self.place, self.parts = place, parts

    def new(self, seen: set[Places]) -> Iterator[tuple[int, int]]:
        """The places that are not yet in ``seen``, which takes them up."""
        left = [self]
        while left:
            node = left.pop()
            if node not in seen:
                seen.add(node)
                left += node.parts
                if node.place:
                    yield node.place


class Value:
    """A literal or the join of two values.

    A value is never written out: it keeps its places, the length, how often each character occurs, the number of gaps of white
    space, its first and last characters, and if it holds a placeholder's word or the head of a private key. All
    follow from the same of its two parts, so values that double with each line cost no more than others.
    """

    __slots__ = ("places", "length", "counts", "gaps", "head", "tail", "idle", "pem")

    def __init__(self, text: str = "", place: tuple[int, int] | None = None):
        stripped = text.strip()
        self.places = Places(place)
        self.counts = Counter(c for c in stripped if not c.isspace()) if any(c.isspace() for c in stripped) else Counter(stripped)
        self.length = float(sum(self.counts.values()))
        self.gaps = float(len(stripped.split()) - 1) if stripped else 0.0
        self.head, self.tail = stripped[:_HELD], stripped[-_HELD:]
        self.idle = _placeholder(stripped)
        self.pem = "-----BEGIN " in stripped and "PRIVATE KEY-----" in stripped

    def __add__(self, other: Value) -> Value:
        if not self.length or not other.length:
            # nothing but places to add
            out = Value.__new__(Value)
            full = self if self.length else other
            for name in ("length", "counts", "gaps", "head", "tail", "idle", "pem"):
                setattr(out, name, getattr(full, name))
        else:
            out = Value.__new__(Value)
            out.length, out.gaps = min(self.length + other.length, _LONGEST), min(self.gaps + other.gaps, _LONGEST)
            out.counts = self.counts.copy()
            for c, n in other.counts.items():
                out.counts[c] = min(out.counts[c] + n, _LONGEST)
            out.idle = self.idle or other.idle or _placeholder(self.tail + other.head)
            out.pem = self.pem or other.pem
            out.head = self.head if len(self.head) == _HELD else (self.head + other.head)[:_HELD]
            out.tail = other.tail if len(other.tail) == _HELD else (self.tail + other.tail)[-_HELD:]
        out.places = Places(None, (self.places, other.places))
        return out

    def _dummy(self) -> bool:
        """A run of one sign, a mark in brackets, or a reference to a variable."""
        own, first, last = self.counts, self.head[:1], self.tail[-1:]
        if self.idle or len({c.lower() for c in own}) == 1 and first in "xX*.":
            return True
        if first == "<" and last == ">" and own[">"] == 1 or self.head[:2] == "{{" and self.tail[-2:] == "}}":
            return True
        word = {c for c in own if not (c.isalnum() or c in "_.")}
        if first == "$" and own["$"] == 1 and word <= {"$", "{", "}"} and own["{"] <= 1 and own["}"] <= 1:
            return (not own["{"] or self.head[1:2] == "{") and (not own["}"] or last == "}")
        return first == last == "%" and own["%"] == 2 and word == {"%"}

    def score(self) -> float:
        """How much it looks like a secret, 0 to 1: length, entropy, kinds of characters; prose and dummies 0."""
        if self.pem:
            return 1.0
        if self.length < 8 or self.gaps and self.length / (self.gaps + 1) < LEAST_CHUNK or self._dummy():
            return 0.0
        total = sum(self.counts.values())
        entropy = -sum(n / total * math.log2(n / total) for n in self.counts.values())
        kinds = sum(any(test(c) for c in self.counts) for test in (str.isdigit, str.islower, str.isupper)) + any(
            not c.isalnum() for c in self.counts)
        if len(self.counts) < 5 or kinds < 2:
            return 0.0
        return min(1.0, entropy / 3.5) * min(1.0, 0.4 + 0.2 * kinds)


def literal_score(value: str) -> float:
    """:meth:`Value.score` of one literal."""
    return Value(value).score()


def _tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, word, start, end): ``s`` strings without their quotes, ``p`` PEM blocks, else as in the pattern."""
    at, dead, whole = 0, dict.fromkeys("\"'`", 0), {}
    while m := _LEX.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "q":
            quote = m.group()
            if m.start() < dead[quote]:
                continue
            end = _INSIDE[quote].match(text, at).end()
            if text[end:end + 1] != quote:
                # unclosed on this line, and so is every later quote of its kind before that end
                dead[quote] = end
                continue
            yield "s", text[at:end], at, end
            at = end + 1
        elif kind in "tp":
            # the next end of its kind; once there is none, none is looked for again
            word, first = m.group(), at if kind == "t" else m.start()
            closing = word if kind == "t" else "-----END "
            if whole.get(closing) == -1:
                continue
            end = whole[closing] = text.find(closing, at)
            if end < 0:
                continue
            if kind == "p":
                tail = _PEM_END.match(text, end)
                end = tail.end() if tail else end + len(closing)
                yield "p", word[11:-5], first, end
                at = end
            else:
                yield "s", text[first:end], first, end
                at = end + 3
        else:
            yield kind, m.group(), m.start(), at


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of each assignment, in order.

    ``name op literal``, ``"name": literal`` and ``name op unquoted-value`` are read; a joined
    expression (``a + "b"``) is the join of its values. Strings may be triple-quoted over lines. A name that was
    assigned before stands for its value, through any number of steps; later assignments overwrite earlier ones. A PEM
    block is a literal, and also assigned to its own label.
    """
    known: dict[str, Value] = {}
    targets, op, value, joined, before = [], "", None, False, None
    for kind, word, a, b in _tokens(text + "\n"):
        if kind == "p":
            block = Value(text[a:b], (a, b))
            yield word, block
        if targets:
            piece = None
            if kind in "sv":
                piece = Value(word, (a, b))
            elif kind == "p":
                piece = block
            elif kind == "n":
                piece = known.get(word) or (Value(word, (a, b)) if value is None and any(c.isdigit() for c in word) else Value())
            if piece is not None and (joined or value is None):
                value, joined, before = piece if value is None else value + piece, False, (kind, word)
                continue
            if kind == "o" and word == "+":
                joined = True
                continue
            if kind == "o" and word in _ASSIGNS and not _reaches(value) and before and before[0] == "n":
                # ``name: type = literal`` keeps its target, ``a = b = literal`` has two
                targets += [before[1]] * (op != ":")
                op, value = word, None
                continue
            for target in targets if _reaches(value) else ():
                known[target] = value
                yield target, value
            targets, op, value, joined = [], "", None, False
        if kind in "ns":
            before = (kind, word)
        elif kind == "o" and word in _ASSIGNS and before and re.fullmatch(r"[\w$.-]+", before[1]):
            targets, op, before = [before[1]], word, None
        elif kind != "v":
            before = None


def _reaches(value: Value | None) -> bool:
    """Whether some literal is part of the value."""
    return value is not None and (value.places.place is not None or bool(value.places.parts))


def spans_of(text: str, least: float = 0.4) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets by start, then kind, then end; code points, end exclusive.

    Base kinds ``assign``, ``access`` and ``hex`` by their patterns; ``literal`` for a literal whose own score
    times that of the name it reaches is at least ``least``, where no base span covers it.
    """
    found = []
    low = text.lower()
    if any(t in low for t in _TARGETS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if ("=" in text or ":" in text or "-----BEGIN " in text) and any(w in low for w in _STEMS):
        base, seen = sorted(found), set()
        # the furthest end of the base spans up to each, so that one look tells if a span lies inside another
        starts, reach = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max))
        extra = set()
        for name, value in assignments(text):
            sensitive = name_score(name)
            if sensitive >= least and sensitive * value.score() >= least:
                extra.update(value.places.new(seen))
        for a, b in extra:
            at = bisect_right(starts, a)
            if not at or reach[at - 1] < b:
                found.append((a, b, "literal"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# every sensitive name holds one of these; other texts need no lexing
_STEMS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "auth", "signature", "salt", "dsn")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.4) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>), one row per row of ``docs``.

    Null text is empty and has no spans. Null or repeated ids and repeated rows are taken as they are; texts are
    read whole; an empty table gives no rows; further columns are ignored. No shuffle.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"start": a, "end": e, "kind": k} for a, e, k in spans_of(t, least)] for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return pick(docs, doc_id=f"{doc_id} bigint", text=f"{text} string").mapInArrow(
        run, "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scan`, by built-in functions."""
    line = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind != 'literal')"
    return scanned.selectExpr(
        "doc_id", *[f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS],
        f"sha2({line.format(base)}, 256) AS base_sha256", f"{line.format('spans')} AS spans")


def _redacted(text: str, least: float) -> str:
    parts, at = [], 0
    for a, b, _ in spans_of(text, least):
        if a >= at:
            parts += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", least: float = 0.4) -> DataFrame:
    """``docs`` with every secret replaced by ``[REDACTED]`` and ``n_chars``, if there, counted anew.

    Overlapping spans are replaced as one. Rows without a secret, null texts too, stay as they are.
    """
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([_redacted(t, least) if t else t for t in some(column)], pa.string())

    name = spare(docs, "clean_text")
    done = docs.withColumn(name, F.arrow_udf(clean, "string", F.ArrowUDFType.SCALAR)(F.col(f"`{text}`")))
    if n_chars in docs.columns:
        changed = F.col(f"`{name}`").eqNullSafe(F.col(f"`{text}`"))
        done = done.withColumn(n_chars, F.when(changed, F.col(f"`{n_chars}`"))
                               .otherwise(F.length(f"`{name}`").cast(docs.schema[n_chars].dataType)))
    return done.withColumn(text, F.col(f"`{name}`")).select(*[f"`{c}`" for c in docs.columns])
