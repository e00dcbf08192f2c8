"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads a text once, as tokens: comments, strings (plain, triple-quoted, escaped), markup elements, section
headings, braces, indented mappings and the pairs of a name and a value (``name = "literal"``, ``"name": "literal"``,
``NAME=literal``, ``<name>literal</name>``, ``name: |`` with its lines), lists of literals under a name (in brackets, or a line
with a dash each) and the arguments of a call whose name is sensitive. Constants are carried through names that are assigned
to other names, in the block where they were bound (braces, or the indented lines of a ``def`` or ``class``), and through ``+``. A literal's score is how sensitive the
name is that it reaches, or the heading it stands under, times how much it looks like a secret. Work is per
text and grows with its length; a compiled filter passes over texts that name nothing sensitive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

#: In this order where two spans start together.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: A name's weight is that of the first stem found in it, separators left out.
SENSITIVE = (
    ("password", 0.95), ("passwd", 0.95), ("passphrase", 0.95), ("pwd", 0.85), ("secret", 0.9), ("privatekey", 0.9), ("apikey", 0.9), ("accesskey", 0.85),
    ("authtoken", 0.9), ("token", 0.8), ("credential", 0.8), ("encryptionkey", 0.85), ("signingkey", 0.85), ("auth", 0.6),
)
#: What a text must hold for each kind; the same or more texts than those with a match. A name without a stem has no weight, so the stems tell for literals, with the separators that ``name_weight`` leaves out.
FILTERS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "literal": "(?i)" + "|".join(r"[_.\-]*".join(stem) for stem, _ in SENSITIVE),
}
#: Names that hold a stem but no secret.
HARMLESS = re.compile(r"(?i)(token(izer|s|_?type|_?count|_?limit|_?id)|max_?token|author|public_?key|_?(file|path|url|name|length|field|hint|policy|expiry)$)")
#: Calls that ask for a secret by its name, or tell of one, hold none.
ASKS = re.compile(r"(?i)(^|[_.])(get|read|load|fetch|find|lookup|describe|list|is|has|check|require|delete|remove|env|environ|count|print|log)([_.A-Z]|$)|^(get|read|load|fetch|find|is|has|check|require|delete|remove)(?-i:[A-Z])")
PLACEHOLDER = re.compile(r"(?i)<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|x+|\*+|\.+|(your|my|example|sample|dummy|test|fake|change_?me|placeholder|redacted|none|null|true|false|undefined)[\w\-]*")
SCORE_FROM = 0.55
#: A literal under a sensitive heading counts as one of that name if its own name says nothing (``VALUE_NAMES``), else at this share.
UNDER_HEADING = 0.7
VALUE_NAMES, LABEL_NAMES = frozenset(("value", "val", "data", "content", "default", "text")), frozenset(("name", "key", "id"))

#: Strings and names of any length; possessive, so that a search never goes back over what it has read.
_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\'|`[^`\n]*+`'
_WORD = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_TYPE = r"(?:&'static[\x20]str|&?str|[Ss]tring|bytes|[Aa]ny|Optional\[str\]|Final(?:\[str\])?)\??"
_TOKEN = re.compile(
    rf"""(?P<scope>(?<![^\n])(?P<margin>[\x20\t]*+)(?:async[\x20]++)?+(?:def|class)[\x20]++{_WORD})"""
    rf"""|(?P<pair>(?P<escape>\\{{0,3}}+)(?P<quote>["']?)(?<![A-Za-z0-9_.\-])(?P<name>{_WORD})(?P=escape)(?P=quote)\]?(?:[\x20\t]*:?[\x20\t]*{_TYPE})?[\x20\t]*(?P<op>:=|=>|\+=|!==?|={{1,3}}|:(?!:|//)))"""
    rf"""|(?P<call>(?<![A-Za-z0-9_.\-])(?P<callee>{_WORD})\()"""
    r"""|(?P<comment>/\*|<!--|(?:(?<=\s)|(?<![\s\S]))(?:\#|//)[^\n]*+)"""
    r"""|(?P<triple>"{3}|'{3})"""
    rf"""|(?P<string>(?<![A-Za-z0-9])(?:{_STRING})|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+")"""
    r"""|(?P<element><(?P<tag>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?P<attributes>(?:\s[^<>]*+)?+)>(?P<body>[^<>]*+)(?P<end></(?P=tag)\s*>)?)"""
    r"""|(?P<closing></(?P<closed>[A-Za-z_][A-Za-z0-9_.:\-]*+)\s*>)"""
    r"""|(?P<heading>(?<![^\n])[\x20\t]*\[{1,2}(?P<section>[^\[\]\n]++)\]{1,2}[\x20\t]*(?![^\n]))"""
    r"""|(?P<brace>[{}])"""
)
_TERM = re.compile(rf"""[\x20\t]*(?:(?P<paren>\(\s*)?+(?:[bBrRuUfF]{{1,2}})?(?:(?P<triple>"{{3}}|'{{3}})|(?P<string>{_STRING})|(?P<escaped>\\+"[^"\\\n]*+\\+"|\\+'[^'\\\n]*+\\+'))|(?P<block>[|>][+\-]?\d?[\x20\t]*+\n)|(?P<brace>\{{)|(?P<ends>(?![^\n])))""")
_BARE = re.compile(r"""[\x20\t]*([^\s,;#"'`(){}\[\]]++)""")
_REFERENCE = re.compile(rf"\$?\{{?({_WORD})\}}?(?=[\s,;)+.]|$)")
_OPEN = re.compile(r"[\x20\t]*+\[")
#: What is passed over among the items of a list: anything without marks.
_PLAIN = re.compile(r"""[^\s,;()"'`\[\]{}]++""")
#: A line with a dash and one value, after blank lines; what holds more than that is left to the tokens.
_DASH = re.compile(rf"""(?:[\x20\t]*+\n)++(?P<margin>[\x20\t]*+)-[\x20\t]++(?:(?P<string>{_STRING})|(?P<bare>[^\s,;#"'`(){{}}\[\]]++))(?=[\x20\t]*+(?:(?<=[\x20\t])\#[^\n]*+)?(?![^\n]))""")
_JOIN = re.compile(r"[\x20\t]*+(?:\n[\x20\t]*+)?[+.][\x20\t]*+(?:\n[\x20\t]*+)?")
_GAP = re.compile(r"\s*+")
_LEAD = re.compile(r"[\x20\t]*+(?:-[\x20\t]++)*+")
_LINE = re.compile(r"[^\n]*+\n?")


def name_weight(name: str) -> float:
    if HARMLESS.search(name):
        return 0.0
    flat = re.sub(r"[_.\-]", "", name).lower()
    return next((w for stem, w in SENSITIVE if stem in flat), 0.0)


def literal_weight(n: int, counts: Counter, quoted: bool) -> float:
    """From 0 to 1, from a literal's length and the counts of its characters: dense and mixed literals weigh more; prose and code nothing."""
    held = {x: c for x, c in counts.items() if c}
    if n < 8 or any(map(str.isspace, held)):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in held.values())
    letters = "".join(held)
    kinds = sum(map(bool, (re.search("[a-z]", letters), re.search("[A-Z]", letters), re.search("[0-9]", letters), re.search("[^A-Za-z0-9]", letters))))
    if kinds < 2 or not quoted and not re.search("[0-9]", letters):
        return 0.0
    return min(1.0, 0.35 + 0.1 * kinds + 0.1 * min(bits, 4.0))


class _Value:
    """A constant: one literal, or several that are put together. Its characters are counted once, when they are asked for."""

    __slots__ = ("counts", "credited", "folded", "n", "parts", "quoted", "span")

    def __init__(self, span: tuple[int, int] | None, quoted: bool, folded: str | None = None, parts: tuple = ()):
        self.span, self.quoted, self.folded, self.parts, self.counts, self.credited = span, quoted, folded, parts, None, False
        self.n = sum(p.n for p in parts) if parts else len(folded) if folded is not None else span[1] - span[0]

    def counted(self, text: str) -> Counter:
        if self.counts is None:  # both parts of a sum were counted when it was made
            self.counts = sum((p.counts for p in self.parts), Counter()) if self.parts else Counter(text[slice(*self.span)] if self.folded is None else self.folded)
        return self.counts

    def placeholder(self, text: str) -> bool:
        return self.span is not None and PLACEHOLDER.fullmatch(text, *self.span) is not None

    def spans(self) -> list[tuple[int, int]]:
        """Places of the literals that weren't given before."""
        found, todo = [], [self]
        while todo:
            value = todo.pop()
            if not value.credited:
                value.credited = True
                todo += value.parts
                if value.span:
                    found.append(value.span)
        return found


class _Frame:
    """What a brace, an element, a heading or an indented mapping opens: the weight of its name and the bindings that its end undoes."""

    __slots__ = ("indent", "kind", "label", "undo", "weight")

    def __init__(self, kind: str, weight: float, label: str = "", indent: int = 0):
        self.kind, self.weight, self.label, self.indent, self.undo = kind, weight, label, indent, []


class _Lexer:
    def __init__(self, text: str):
        self.text, self.held, self.best, self.unclosed = text, {}, {}, set()

    def closing(self, mark: str, at: int, stop: int) -> int:
        """Where ``mark`` comes next; a mark that didn't come once isn't looked for again up to the same end."""
        if (mark, stop) in self.unclosed:
            return -1
        found = self.text.find(mark, at, stop)
        if found < 0:
            self.unclosed.add((mark, stop))
        return found

    def trimmed(self, start: int, stop: int) -> _Value:
        """A literal over one or more lines, without space around it. Indents, line ends and armour lines (``-----``) are no part of it."""
        body = self.text[start:stop]
        start += len(body) - len(body.lstrip())
        lines = [x.strip() for x in body.strip().split("\n")]
        if len(lines) == 1:
            return _Value((start, start + len(lines[0])), True)
        return _Value((start, start + len(body.strip())), True, "".join(x for x in lines if not x.startswith("-----")))

    def block(self, at: int, stop: int, indent: int) -> int:
        """End of the lines from ``at`` on that are indented by more than ``indent``, or blank."""
        while at < stop:
            line = _LINE.match(self.text, at, stop)
            lead = _GAP.match(self.text, at, line.end()).end()
            if lead < line.end() and lead - at <= indent:
                break
            at = line.end()
        return at

    def value(self, at: int, stop: int, indent: int) -> tuple[_Value | None, int, str]:
        """The constant that begins at ``at``, where it ends, and what it was read as."""
        parts, kind, adjacent = [], "", False
        while True:
            m = _TERM.match(self.text, at, stop)
            group = m.lastgroup if m else None
            if group in ("brace", "ends", "paren") or group == "block" and parts:
                kind = kind or group
                break
            if group == "block":
                end = self.block(m.end(), stop, indent)
                return self.trimmed(m.end(), end), end, "block"
            if group == "triple":
                adjacent = adjacent or m["paren"] is not None
                end = self.closing(m["triple"], m.end(), stop)
                if end < 0:
                    break
                parts.append(self.trimmed(m.end(), end))
                at = end + 3
            elif group:
                adjacent = adjacent or m["paren"] is not None
                edge = 1 if group == "string" else (len(m["escaped"]) - len(m["escaped"].lstrip("\\"))) + 1
                parts.append(_Value((m.start(group) + edge, m.end(group) - edge), True))
                at = m.end()
                inner = self.text[slice(*parts[-1].span)] if self.text[parts[-1].span[0]] in "${" else ""
                if inner and (ref := _REFERENCE.fullmatch(inner)) and ref[1] in self.held:
                    parts[-1] = self.held[ref[1]]
            else:
                gap = _GAP.match(self.text, at, stop).end()
                ref = _REFERENCE.match(self.text, gap, stop)
                if not ref or ref[1] not in self.held:
                    break
                parts.append(self.held[ref[1]])
                at = ref.end()
            kind = kind or ("reference" if group is None else "literal")
            join = _JOIN.match(self.text, at, stop)
            after = join.end() if join else _GAP.match(self.text, at, stop).end() if adjacent else None
            if after is None or not self.goes_on(after, stop):
                break
            at = after
        if len(parts) < 2:
            return (parts[0] if parts else None), at, kind
        for part in parts:
            part.counted(self.text)
        made = _Value(None, any(p.quoted for p in parts), parts=tuple(parts))
        made.counted(self.text)
        return made, at, kind

    def goes_on(self, at: int, stop: int) -> bool:
        m = _TERM.match(self.text, at, stop)
        if m and m.lastgroup in ("triple", "string", "escaped"):
            return True
        ref = _REFERENCE.match(self.text, at, stop)
        return bool(ref) and ref[1] in self.held

    def item(self, value: _Value, weight: float) -> None:
        """One value of a list: a secret, or a text that is read by itself."""
        if not self.credit(value, weight) and value.quoted and value.span and value.folded is None and value.n:
            self.region(*value.span, weight)

    def listed(self, at: int, stop: int, weight: float, bare: bool = False) -> int:
        """Reads literals and constants parted by commas, passing over plain words (which are values where they are ``bare``); gives where something else stands."""
        while True:
            at = _GAP.match(self.text, at, stop).end()
            value, end, kind = self.value(at, stop, 0)
            if kind in ("block", "paren", "brace"):
                return at
            if value is not None:
                self.item(value, weight)
            elif plain := _PLAIN.match(self.text, at, stop):
                end = plain.end()
            else:
                return at
            after = _GAP.match(self.text, end, stop).end()
            more = after < stop and self.text[after] == ","
            if value is None and not more and not (bare and after < stop and self.text[after] == "]"):
                return at
            if value is None and bare:
                self.item(_Value((at, end), False), weight)
            if not more:
                return end
            at = after + 1

    def dashes(self, at: int, stop: int, indent: int, weight: float) -> int:
        """Reads the lines of one value each that follow ``at``, indented by ``indent`` at least."""
        while (m := _DASH.match(self.text, at, stop)) and len(m["margin"]) >= indent:
            if m["bare"] is None:
                self.item(_Value((m.start("string") + 1, m.end("string") - 1), True), weight)
            elif re.search(r":$|=", m["bare"]):  # a mapping's or a pair's own name
                break
            else:
                self.item(_Value(m.span("bare"), False), weight)
            at = m.end()
        return at

    def leave(self, blocks: list[_Frame], indent: int = -1) -> None:
        """Ends the blocks by indentation that a line with this indent isn't in; a negative one: all within the last brace."""
        while blocks[-1].kind == "scope" and blocks[-1].indent >= indent:
            self.close(blocks.pop())

    def bind(self, frame: _Frame, name: str, value: _Value) -> None:
        frame.undo.append((name, self.held.get(name)))
        self.held[name] = value

    def close(self, frame: _Frame) -> None:
        for name, before in reversed(frame.undo):
            if before is None:
                self.held.pop(name, None)
            else:
                self.held[name] = before

    def credit(self, value: _Value, weight: float, counts: Counter | None = None) -> bool:
        score = weight * literal_weight(value.n, value.counted(self.text) if counts is None else counts, value.quoted)
        if score < SCORE_FROM or value.placeholder(self.text):
            return False
        for span in value.spans():
            self.best[span] = max(score, self.best.get(span, 0.0))
        return True

    def region(self, at: int, stop: int, inherited: float = 0.0, comment: bool = False) -> None:
        """Reads the tokens from ``at`` to ``stop``; what is bound in here is unbound at the end, but for the whole text."""
        text, frames, blocks = self.text, [_Frame("", inherited)], [_Frame("", 0.0)]
        seen = line = at
        lead = _LEAD.match(text, at, stop).end()
        label, bare_end, counted, counts, braces = "", 0, 0, None, 0
        while m := _TOKEN.search(text, at, stop):
            group, at = m.lastgroup, m.end()
            if (k := text.rfind("\n", seen, m.start())) >= 0:
                line = k + 1
                lead = _LEAD.match(text, line, stop).end()
            seen = m.start()
            weight = frames[-1].weight
            if group == "comment":
                if m["comment"] in ("/*", "<!--"):
                    end = self.closing({"/*": "*/", "<!--": "-->"}[m["comment"]], at, stop)
                    if end < 0:
                        continue
                    self.region(at, end, weight)
                    at = end
                elif comment:
                    at = m.start() + 1  # a mark within a comment is part of it
                else:
                    self.region(m.start() + 1, at, weight, comment=True)
            elif group == "triple":
                if (end := self.closing(m["triple"], at, stop)) >= 0:
                    self.region(at, end, weight)
                    at = end + 3
            elif group == "string":
                self.region(m.start() + 1, at - 1, weight)
            elif group == "element":
                if m["attributes"]:
                    self.region(*m.span("attributes"), weight)
                own = name_weight(m["tag"])
                if m["end"]:
                    value = self.trimmed(*m.span("body"))
                    if not (value.n and self.told(value, m["tag"], own, weight, "")):
                        self.region(*m.span("body"), max(weight, own))
                else:
                    at = m.end("attributes") + 1
                    if own and not m["attributes"].endswith("/"):
                        frames.append(_Frame("element", max(weight, own), m["tag"]))
            elif group == "closing":
                above = len(frames) - 1
                while above > 0 and frames[above].kind != "brace" and frames[above].label != m["closed"]:
                    above -= 1
                if frames[above].kind == "element":  # with what was opened in it and isn't closed
                    del frames[above:]
            elif group == "heading":
                while len(frames) > 1 and frames[-1].kind in ("heading", "mapping"):
                    frames.pop()
                if own := name_weight(m["section"]):
                    frames.append(_Frame("heading", own))
            elif group == "scope":
                self.leave(blocks, len(m["margin"]))
                blocks.append(_Frame("scope", 0.0, indent=len(m["margin"])))
            elif group == "call":
                if (own := name_weight(m["callee"])) and not ASKS.search(m["callee"]):
                    at = self.listed(at, stop, own)
            elif group == "brace":
                if m[0] == "{":
                    frames.append(_Frame("brace", weight))
                    blocks.append(frames[-1])
                    braces += 1
                elif braces:
                    braces -= 1
                    self.leave(blocks)
                    while frames.pop() is not blocks[-1]:
                        pass
                    self.close(blocks.pop())
            else:
                name, op, start = m["name"], m["op"], m.end()
                first = m.start("name") - lead <= 1 and lead >= line and m.start() >= line
                indent = lead - line
                if first:
                    while len(frames) > 1 and frames[-1].kind == "mapping" and frames[-1].indent >= indent:
                        frames.pop()
                    weight = frames[-1].weight
                    self.leave(blocks, indent)
                value, end, kind = self.value(start, stop, indent)
                own = name_weight(name)
                if kind == "brace":
                    frames.append(_Frame("brace", max(weight, own)))
                    blocks.append(frames[-1])
                    braces += 1
                    at = _TERM.match(text, start, stop).end()
                    continue
                if kind == "ends":
                    if own and first and op == ":":
                        frames.append(_Frame("mapping", max(weight, own), indent=indent))
                        at = self.dashes(start, stop, indent, max(weight, own))
                    continue
                if value is None and own and op in ("=", ":", ":=", "=>", "+=") and (opened := _OPEN.match(text, start, stop)):
                    at, label = self.listed(opened.end(), stop, own, bare=op == ":"), ""
                    continue
                known = None
                if value is None:
                    nested = start < bare_end
                    if nested:  # within the last bare value, and ends where that ends
                        begin, end = start, bare_end
                    elif bare := _BARE.match(text, start, stop):
                        begin, end = bare.span(1)
                    else:
                        label = ""
                        continue
                    kind = "" if nested else "bare"
                    value, at = _Value((begin, end), False), begin  # the bare value may hold pairs (``config: pwd=...``)
                    if own or name.lower() in VALUE_NAMES and weight:
                        if not nested or counts is None:
                            counts = Counter(text[begin:end])
                        else:  # counted once for all pairs in a bare value
                            counts.subtract(text[counted:begin])
                        counted, bare_end, known = begin, end, counts
                    elif not nested:
                        bare_end, counts = end, None
                else:
                    at = end
                if op == "+=" and name in self.held:
                    for part in (self.held[name], value):
                        part.counted(text)
                    value = _Value(None, True, parts=(self.held[name], value))
                    value.counted(text)
                if op[0] not in "!" and op not in ("==", "==="):
                    self.bind(blocks[-1], name, value)
                taken = self.told(value, name, own, weight, label, known)
                if taken and kind != "reference":
                    at = end
                elif kind == "literal" and not taken and value.span and value.folded is None and value.n:
                    self.region(*value.span, weight)
                plain = value.span is not None and value.folded is None and kind in ("literal", "bare") and name.lower() in LABEL_NAMES
                label = text[slice(*value.span)] if plain else ""
        for frame in reversed(blocks[1:] + (blocks[:1] if (inherited or stop < len(text)) else [])):
            self.close(frame)

    def told(self, value: _Value, name: str, own: float, around: float, label: str, counts: Counter | None = None) -> bool:
        """Whether the value is a secret by its own name, by the label before it or by what it stands under."""
        neutral = name.lower() in VALUE_NAMES
        weight = own
        if neutral:
            weight = max(own, around, name_weight(label) if label else 0.0)
        elif not own and around and not HARMLESS.search(name):
            weight = UNDER_HEADING * around
        return weight >= SCORE_FROM and self.credit(value, weight, counts)


def lexed_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name, by assignment, through other names, or by what they stand under."""
    lexer = _Lexer(text)
    lexer.region(0, len(text))
    return [(*span, score) for span, score in sorted(lexer.best.items())]


def base_spans(text: str, kinds=("assign", "access", "hex")) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), leftmost and non-overlapping per kind; matches that are too short are dropped after they have been consumed."""
    found = []
    if "assign" in kinds:
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        if kind in kinds:
            found += [(kind, m.start(), m.end(), m.start()) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return found


def spans_of(text: str, kinds=KINDS) -> list[tuple[str, int, int, int]]:
    """All spans by start, then kind; a literal that lies in a span of another kind adds none."""
    found = base_spans(text, kinds)
    if "literal" in kinds and (lexed := lexed_spans(text)):
        ends = {k: [x[2] for x in found if x[0] == k] for k in kinds}  # spans of a kind don't overlap: the first that ends late enough tells
        starts = {k: [x[1] for x in found if x[0] == k] for k in kinds}
        for s, e, _ in lexed:
            at = {k: bisect_left(ends[k], e) for k in kinds}
            if not any(at[k] < len(ends[k]) and starts[k][at[k]] <= s for k in kinds):
                found.append(("literal", s, e, s))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _per_text(texts: pa.Array):
    """For each text its spans; [] where the filters tell that there are none. Null counts as empty."""
    texts = texts.cast(pa.large_string())
    may = {k: pc.fill_null(pc.match_substring_regex(texts, p), False).to_pylist() for k, p in FILTERS.items()}
    for i, here in enumerate(zip(*may.values(), strict=True)):
        yield spans_of(texts[i].as_py(), [k for k, yes in zip(may, here, strict=True) if yes]) if any(here) else []


def _told(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``RESULT``.

    Null and empty texts have no spans; repeated rows give repeated results, an empty table gives none. Texts,
    names and literals may be of any length, and time grows with it. Other columns aren't read.
    """

    def run(batches):
        for batch in batches:
            rows = list(_per_text(batch.column(1)))
            base = [[x for x in spans if x[0] != "literal"] for spans in rows]
            counts = [[sum(x[0] == k for x in spans) for spans in base] for k in KINDS[:3]]
            digests = [hashlib.sha256(_told(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(map(_told, rows), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {RESULT}")


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """``text`` with each secret replaced; the name before an assigned secret stays."""
    out, at = [], 0
    for start, end in sorted((x[3], x[2]) for x in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``; rows without a secret stay as they are. ``length_col``, where there is one, is set anew for changed rows."""

    def run(batches):
        for batch in batches:
            at, names = batch.schema.get_field_index(text_col), batch.schema.names
            found = list(_per_text(batch.column(at)))
            if any(found):
                texts = batch.column(at)
                fresh = [redacted(texts[i].as_py(), spans, mark) if spans else texts[i].as_py() for i, spans in enumerate(found)]
                columns = list(batch.columns)
                columns[at] = pa.array(fresh, batch.schema.field(at).type)
                if length_col in names:
                    k = names.index(length_col)
                    old = batch.column(k).to_pylist()
                    columns[k] = pa.array([len(fresh[i]) if spans else old[i] for i, spans in enumerate(found)], batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
