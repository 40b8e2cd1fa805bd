"""Secret scans by assignment-aware lexing.

A text is lexed as source or configuration, whatever its language: names, strings (also triple-quoted and with prefixes),
bare literals, comments, assignment marks, brackets. Name-literal pairs come from ``name = "literal"``, ``name: type = ...``,
``"name": ...``, ``x["name"] = ...``, ``:=``, ``=>``, ``<name>literal</name>``, ``name``/``value`` pairs of attributes or lists,
``set name literal``, ``--name literal``, ``f("name", "literal")`` and block scalars. A call's literal arguments and a list's
elements flow into its target, the callee's name doesn't. Names that hold constants are resolved, so
``a = "x1"; api_token = a + "y2"`` is one sensitive value from two literals; each literal that flows into a sensitive name is a
span. A literal is scored by how sensitive its target name is and how random it looks, and kept from ``MIN_SCORE`` on.
A quote after a letter opens no string, nor does one whose end has a letter after it: so apostrophes in prose hide nothing.

Fixed patterns (assignments by keyword, access key ids, long hexadecimal runs) give the base spans, which always stay.

Defined results: a null text counts as empty; no spans give empty strings and the digest of the empty string; texts
are scanned whole, in time linear in their length, times the number of different characters where values are joined through
many names (not linear: elements at each level of deeply nested brackets, long white space after a tag with a name attribute);
a value is followed through names however many literals it is joined from: it counts once in a statement that names it more
than once, and as often as it comes in through other names; repeated rows give equal rows; a null doc_id stays null; an empty
table gives no rows; columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantaloom.llm._common import mapped, slices, table, texts_of

#: Base kinds, in the order in which they are listed; the lexer's own kind comes after them.
KINDS = ("assign", "access", "hex", "named")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as all runs of 24 characters or more

#: Parts of a target name and how sensitive each makes it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5, "signing": 0.4, "salt": 0.5, "cookie": 0.5, "session": 0.4,
}
MIN_SCORE = 1.3
MIN_LITERAL = 6
#: Characters, at least, from which on the counts of a constant's value are kept, so that they aren't taken again for each use.
KEPT_FROM = 512
#: Commands that take a name and a value without a mark; words before or within a value; keys of a pair's name and value.
SETTERS = {"set", "setenv", "setx", "env"}
KEYWORDS = {"new", "await", "yield", "return", "if", "else", "or", "and", "not", "bearer", "basic", "digest"}
LABELS, VALUES = {"name", "key", "id"}, {"value", "default", "content", "val"}

#: The parts, less those that hold another; and what leaves of a text its ASCII letters, in lower case, and digits.
_PARTS = [p.encode() for p in SENSITIVE if not any(q in p and q != p for q in SENSITIVE)]
_LOWER = bytes(range(256)).lower()
_MARKS = bytes(b for b in range(256) if b >= 128 or not chr(b).isalnum())
_OPENS, _CLOSED = r"(?<![A-Za-z0-9_\x80-\U0010ffff])(?:[rbfuRBFU]{1,2}(?=[\"']))?", r"(?![A-Za-z0-9_])"
_TOKEN = re.compile(
    rf"""(?P<triple>{_OPENS}(?:\"\"\"|'''))|(?P<string>{_OPENS}(?:"(?:[^"\\\n]|\\.)*"{_CLOSED}|'(?:[^'\\\n]|\\.)*'{_CLOSED}|`[^`\n]*`))"""
    r"""|(?P<comment>(?:(?<=[\s;{}(),])|\A)(?:\#|//|--[ \t])|/\*|<!--)|(?P<assign>=>|:=|[=!]==?|[:=])|(?P<op>[|?&+]|\.\.)"""
    r"""|(?P<name>-{0,2}[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*)|(?P<bare>[A-Za-z0-9+/_.=\-~!@%^*&#$]+)|(?P<end>[;,\n{}()\[\]<>])""",
    re.ASCII,
)
_BARE = re.compile(r"[A-Za-z0-9+/_.=\-~!@%^*&#$]+", re.ASCII)
_NOT_A_NAME = re.compile(r"[0-9+/=~!@%^*&#]").search
_NAME_ONLY = re.compile(r"[A-Za-z_$][A-Za-z_$.\- ]*").fullmatch
#: An element; no part gives back what it took, so that names and values of any length take linear time.
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)>[\t ]*+([^<>\n]*+)</\1[\t ]*+>", re.ASCII)
#: The value after an opening tag with attributes, whose name an attribute gives.
_CONTENT = re.compile(r">[\t ]*([^<>\n]*?)[\t ]*</", re.ASCII)
_BLOCK = re.compile(r"[\t ]*[|>][+-]?[\t ]*\n([\t ]+)(?=\S)", re.ASCII)
#: A type between a colon and the mark of the value; bounded, so that no text takes more than linear time.
_ANNOTATION = re.compile(
    r"""[\t ]*[&*]?(?:'\w{1,40}[\t ]+)?(?:mut[\t ]+)?[A-Za-z_][\w.:]{0,80}(?:\[[^\n=]{0,80}\]|<[^\n=]{0,80}>)?\??(?:[\t ]*\|[\t ]*[A-Za-z_][\w.]{0,80}){0,8}(?:[\t ]+=[\t ]+(?=\S)|[\t ]*=[\t ]*(?=["'`]))""",
    re.ASCII,
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)
#: What ``_NAME_ONLY`` allows, and within it what words are parted by; how far from an end what follows may change a word that scores.
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$.- ")
_GAPS = re.compile(r"[_$.\- ]+")
_REACH = max(map(len, SENSITIVE)) + 4

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and non-overlapping for each kind; code points, end exclusive."""
    found: list[Span] = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """How sensitive a target name is: the best of its words, and pairs such as access key or private key."""
    words = [w.lower() for w in _WORDS.findall(name)]
    singles = [SENSITIVE.get(w, 0.0) for w in words]
    joined = [SENSITIVE.get(a + b, 0.0) or SENSITIVE.get(a, 0.0) + SENSITIVE.get(b, 0.0) for a, b in zip(words, words[1:], strict=False)]
    return min(1.0, max([0.0, *singles, *joined]))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, mixed classes, and entropy in bits a character."""
    if len(value) < MIN_LITERAL or value[0] in "$<{%" or len(counts := Counter(value)) < 4:
        return 0.0
    if _NAME_ONLY(value) and name_score(value):
        return 0.0  # the name of a secret, as in getenv("DB_PASSWORD")
    return _randomness(counts, len(value), len(value))


def _randomness(counts: Mapping[str, float], total: float, length: float) -> float:
    shares = [n / total for n in counts.values()]
    entropy = -sum(p * math.log2(p) for p in shares if p)
    classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, entropy / 4) * 0.6 + 0.2 * min(classes, 3) / 3 + 0.2 * min(1.0, length / 16) if classes > 1 or entropy > 3.2 else 0.0


Piece = tuple[int, int, str]


class _Look:
    """What ``literal_score`` takes of a text, such that it can be joined: the first character, counts of characters (times
    2 ** ``scale``, since a value that is joined with itself grows exponentially) and, of a text of name characters only, whether
    a sensitive word is within it (``hit``) and its ends, where words may yet change (``ends``, with "~" for what is between)."""

    __slots__ = ("counts", "ends", "first", "hit", "scale")

    def __init__(self, text: str = "") -> None:
        self.counts: dict[str, float] = Counter(text)
        self.first, self.scale, self.hit = text[:1], 0, False
        self.ends: str | None = text if _NAME_CHARS.issuperset(self.counts) else None
        self._shorten()

    def add(self, other: _Look) -> None:
        if not self.counts:
            self.counts, self.ends, self.first, self.hit, self.scale = dict(other.counts), other.ends, other.first, other.hit, other.scale
            return
        if self.scale < other.scale:
            self._rescale(other.scale)
        times = 1 if self.scale == other.scale else 2.0 ** (other.scale - self.scale)
        for c, n in other.counts.items():
            self.counts[c] = self.counts.get(c, 0) + n * times
        if sum(self.counts.values()) > 2**900:
            self._rescale(self.scale + 900)
        self.hit = self.hit or other.hit
        self.ends = None if self.ends is None or other.ends is None else self.ends + other.ends
        self._shorten()

    def _rescale(self, scale: int) -> None:
        times = 2.0 ** (self.scale - scale)
        self.counts, self.scale = {c: n * times for c, n in self.counts.items()}, scale

    def _shorten(self) -> None:
        if self.ends is not None:
            self.ends = _GAPS.sub("_", self.ends)
            if len(self.ends) > 2 * _REACH:
                self.hit = self.hit or _has_word(self.ends, closed=False)
                self.ends = f"{self.ends[:_REACH]}~{self.ends[-_REACH:]}"

    def score(self) -> float:
        total = sum(self.counts.values())
        length = math.inf if self.scale else total
        if length < MIN_LITERAL or self.first in "$<{%" or len(self.counts) < 4:
            return 0.0
        if self.ends is not None and self.first not in ".- " and (self.hit or _has_word(self.ends, closed=True)):
            return 0.0
        return _randomness(self.counts, total, length)


def _has_word(text: str, closed: bool) -> bool:
    """Whether ``name_score`` is above 0 for certain: words next to a "~", or to an end that is not closed, may be parts of others."""
    ahead = None
    for m in _WORDS.finditer(text):
        left = text[m.start() - 1] != "~" if m.start() else closed
        right = text[m.end()] != "~" if m.end() < len(text) else closed
        word = m[0].lower()
        if right and (left and word in SENSITIVE or ahead is not None and ahead[1] + 1 >= m.start() and left and ahead[0] + word in SENSITIVE):
            return True
        ahead = (word, m.end()) if left else None
    return False


class _Held:
    """A constant's value: the literals and other constants' values that it is joined from, shared by all it flows into."""

    __slots__ = ("first", "kept", "last", "look", "only", "parts", "taken", "weight")

    def __init__(self, parts: list[Piece | _Held], kept_from: int) -> None:
        self.parts = parts
        self.first, self.last = _first(parts[0]), _last(parts[-1])
        #: ``only``: the literal, if it is one. ``kept``: the look is kept, since it takes many characters to get; else the value
        #: is written out wherever it is used.
        self.only = _only(parts)
        self.weight = sum(p.weight if isinstance(p, _Held) else 8 + len(p[2]) for p in parts)
        self.kept = self.weight > kept_from
        if self.kept:
            self.weight = kept_from // 8
        self.look: _Look | None = None
        self.taken = False


Part = Piece | _Held


def _first(part: Part) -> str:
    return part.first if isinstance(part, _Held) else part[2]


def _last(part: Part) -> str:
    return part.last if isinstance(part, _Held) else part[2]


def _distinct(parts: list[Part]) -> list[Part]:
    return list(dict.fromkeys(parts)) if len(parts) > 1 else parts


def _only(parts: list[Part]) -> str | None:
    """The one literal of the value, if it is one."""
    return None if len(parts) > 1 else parts[0].only if isinstance(parts[0], _Held) else parts[0][2]


def _runs(parts: list[Part]) -> list[str | _Held]:
    """The value's texts written out, but for the values whose look is kept."""
    runs: list[str | _Held] = []
    texts: list[str] = []
    todo = parts[::-1]
    while todo:
        p = todo.pop()
        if not isinstance(p, _Held):
            texts.append(p[2])
        elif p.kept:
            runs += ["".join(texts), p]
            texts = []
        else:
            todo += p.parts[::-1]
    return [*runs, "".join(texts)]


def value_score(parts: list[Part]) -> float:
    """``literal_score`` of the joined value, which isn't written out beyond the parts that are short."""
    runs = _runs(parts)
    if len(runs) == 1:
        return literal_score(runs[0])
    todo = [p for p in runs if isinstance(p, _Held)]
    while todo:
        within = [] if todo[-1].look else _runs(todo[-1].parts)
        if missing := [p for p in within if isinstance(p, _Held) and not p.look]:
            todo += missing
        else:
            p = todo.pop()
            p.look = p.look or _look(within)
    return _look(runs).score()


def _look(runs: list[str | _Held]) -> _Look:
    look = _Look()
    for r in runs:
        if r:
            look.add(r.look if isinstance(r, _Held) else _Look(r))
    return look


def _taken(parts: list[Part]) -> Iterator[Piece]:
    """The value's literals, less those of constants that were taken before."""
    todo = list(parts)
    while todo:
        p = todo.pop()
        if not isinstance(p, _Held):
            yield p
        elif not p.taken:
            p.taken = True
            todo += p.parts


class _Frame:
    """The statement being read within one bracket, or within a comment or string, that end at ``until``."""

    __slots__ = ("assigned", "group", "groups", "kind", "label", "last", "name", "next_name", "resume", "state", "until")

    def __init__(self, kind: str = "", until: int = -1, resume: int = -1) -> None:
        self.kind, self.until, self.resume, self.label = kind, until, until if resume < 0 else resume, ""
        self.reset()

    def reset(self) -> None:
        #: The target; the literals joined last, and those before, apart. ``state``: "" before and in a value, "set" after a
        #: name that takes a value without a mark, "wrapped" when the value is on a further line, "unknown" after a name that
        #: holds no constant, "done" after a value. ``last``: kind of the last token.
        self.name, self.assigned, self.state, self.last, self.next_name = "", False, "", "", ""
        self.group: list[Part] = []
        self.groups: list[list[Part]] = []


def lexed_pairs(text: str, start: int, stop: int) -> Iterator[tuple[str, list[Part]]]:
    """(name, literals and constants' values that flow into it joined) for each value in ``text[start:stop]``."""
    held: dict[str, _Held] = {}
    kept_from = KEPT_FROM if text.isascii() else max(KEPT_FROM, len(set(text)))
    frames = [_Frame()]
    out: list[tuple[str, list[Part]]] = []

    def finish(f: _Frame) -> None:
        """Ends the frame's statement."""
        groups = [g for g in (*f.groups, f.group) if g]
        if f.assigned:
            name, groups = f.name.lower(), [_distinct(g) for g in groups]
            if name in LABELS:
                f.label = _first(groups[0][0]) if groups else f.next_name
            elif groups:
                out.extend((f.name, g) for g in groups)
                if f.label and name in VALUES:
                    out.extend((f.label, g) for g in groups)
                parts = _distinct([p for g in groups for p in g])
                held[f.name] = parts[0] if len(parts) == 1 and isinstance(parts[0], _Held) else _Held(parts, kept_from)
        elif groups and f.kind in ("(", "[", "{"):
            if f.label:
                out.extend((f.label, _distinct(g)) for g in groups)
            elif f.kind == "(" and f.group and (only := _only(_distinct(f.group))) and _NAME_ONLY(only) and name_score(only):
                f.label = only
            outer = frames[-2] if len(frames) > 1 else f
            if outer.assigned:
                outer.groups += groups
            elif outer.kind in ("(", "["):
                outer.groups += groups  # on to the target of an outer bracket
        f.reset()

    def target(f: _Frame, name: str) -> None:
        f.reset()
        f.name, f.assigned = name, True

    def literal(f: _Frame, begin: int, end: int) -> None:
        if f.state == "set":
            target(f, f.name)
        if f.assigned and f.state in ("unknown", "done"):
            return
        if not f.assigned and f.last not in ("op", "string"):
            f.group = []
        f.group.append((begin, end, text[begin:end]))

    at = start
    while True:
        f = frames[-1]
        m = _TOKEN.search(text, at, stop if f.kind != "comment" else f.until)
        if m is None:
            if f.kind == "comment":
                finish(f)
                frames.pop()
                at = f.resume
                continue
            break
        kind, word, at = m.lastgroup, m[0], m.end()
        if kind == "triple":
            end = text.find(word[-3:], at, stop)
            if end < 0:
                continue
            literal(f, at, end)
            at, f.last = end + 3, "string"
        elif kind == "string":
            quote = next(i for i, c in enumerate(word) if c in "\"'`")
            literal(f, m.start() + quote + 1, at - 1)
            f.last = "string"
            if f.kind != "comment" and (":" in word or "=" in word):
                frames.append(_Frame("comment", at - 1, at))  # a header or a list of settings
                at = m.start() + quote + 1
        elif kind == "comment":
            if f.kind == "comment":
                finish(f)
                continue
            mark = {"/*": "*/", "<!--": "-->"}.get(word, "\n")
            until = text.find(mark, at, stop)
            if (not f.assigned or f.group or f.groups or f.state) and f.kind not in ("(", "["):
                finish(f)
            frames.append(_Frame("comment", stop if until < 0 else until))
        elif kind == "assign":
            colon = word == ":"
            if not f.assigned:
                if colon and f.last == "op":
                    continue
                if name := _last(f.group[-1]) if f.last in ("string", "]") and f.group else f.name:
                    target(f, name)
                    if colon and (typed := _ANNOTATION.match(text, at, stop)):
                        # A type, or in prose a name of its own: of the two the more sensitive one.
                        at, f.name = typed.end(), max(name, typed[0].rsplit("=", 1)[0].strip(), key=name_score)
                    elif colon and (block := _BLOCK.match(text, at, stop)):
                        at = _block(text, block, stop, f)
            elif f.state == "done" and f.next_name:
                name = f.next_name
                finish(f)
                target(f, name)
            elif f.state == "wrapped" and f.last == "string" and f.group:
                name = _last(f.group[-1])
                f.group = []
                finish(f)
                target(f, name)
            elif f.state == "unknown" or f.last == "name" and f.next_name:
                # a = b = "...": of the two names the more sensitive one.
                name = max(f.name, f.next_name, key=name_score)
                target(f, name)
            elif f.group:
                f.groups.append(f.group)
                f.group = []
            f.last = "assign"
        elif kind == "op":
            if f.state == "unknown":
                f.state = ""
            f.last = "op"
        elif kind in ("name", "bare"):
            if f.state == "wrapped" and not f.group:
                finish(f)
            if f.state == "set" and not word.startswith("-"):
                target(f, f.name)
            if word.startswith("--") and kind == "name" and len(word) > 2:
                if f.kind not in ("(", "["):
                    finish(f)
                f.name, f.state, f.last = word, "set", "name"
            elif not f.assigned:
                if kind == "bare":
                    f.group, f.last = [], "bare"
                    continue
                if word in held and (f.last == "op" or f.kind in ("(", "[")):
                    if f.last != "op":
                        f.group = []
                    f.group.append(held[word])
                elif f.last != "op":
                    f.group = []
                if f.last == "setter":
                    if not word.startswith("-"):
                        f.name, f.state, f.last = word, "set", "name"
                    continue
                setter = word.lower() in SETTERS and f.last == "" and not f.name
                f.name, f.last = word, "setter" if setter else "name"
            elif f.state == "done":
                f.next_name = word if kind == "name" else f.next_name
            elif kind == "name" and word in held and f.name.lower() not in LABELS:
                f.group.append(held[word])
                f.next_name, f.last = word, "name"
            elif word.lower() in KEYWORDS:
                if f.group:
                    f.groups.append(f.group)
                    f.group = []
                f.state = ""
            elif kind == "name" and text.startswith("(", at):
                f.state, f.next_name, f.last = "", "", "name"  # a callee: its arguments flow, its name doesn't
            elif f.group or f.groups:
                f.state, f.next_name = "done", word if kind == "name" else ""
            elif f.state != "unknown":
                end = _BARE.match(text, m.start(), stop)
                end = at if end is None else end.end()
                while end > at and text[end - 1] == ".":
                    end -= 1
                if _NOT_A_NAME(text, m.start(), end):
                    f.group.append((m.start(), end, text[m.start() : end]))
                    at, f.last = end, "bare"
                else:
                    f.state, f.next_name, f.last = "unknown", word, "name"
            else:
                f.state, f.next_name = "done", word if kind == "name" else ""
        elif word in "([{":
            near = m.start() > start and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_]")
            if word == "[" and near:
                if f.assigned or f.kind == "[":
                    frames.append(_Frame("key"))  # x["key"] as a value: the key is no literal of the value
            else:
                if not f.assigned and f.kind in ("", "{", "comment") and word != "(":
                    finish(f)
                if f.state in ("unknown", "wrapped"):
                    f.state = ""
                frames.append(_Frame(word))
        elif word in ")]}":
            if f.kind in ("(", "[", "{", "key"):
                if f.kind == "key":
                    f.reset()
                finish(f)
                frames.pop()
                frames[-1].last = word
            elif word == "]" and f.last == "string" and not f.assigned:
                f.last = "]"  # x["name"] = ...: the key is the name
            else:
                finish(f)
        elif word == "<":
            if element := _ELEMENT.match(text, m.start(), stop):
                finish(f)
                if value := element[2].rstrip("\t "):
                    out.append((element[1], [(element.start(2), element.start(2) + len(value), value)]))
                at = element.end()
            elif f.kind not in ("(", "["):
                finish(f)
        elif word == ">":
            if f.kind in ("(", "["):
                continue
            finish(f)
            if f.label and (content := _CONTENT.match(text, m.start(), stop)) and content[1]:
                out.append((f.label, [(content.start(1), content.end(1), content[1])]))
            f.label = ""
        elif word == "\n":
            if f.kind in ("(", "[", "key") or f.last == "op" and f.assigned:
                continue
            if f.assigned and not (f.group or f.groups) and f.state == "":
                f.state = "wrapped"
            else:
                finish(f)
        else:  # , ;
            finish(f)
            if word == ";":
                f.label = ""
        if len(out) > 64:
            yield from out
            out.clear()
    while frames:
        finish(frames[-1])
        frames.pop()
    yield from out


def _block(text: str, block: re.Match, stop: int, f: _Frame) -> int:
    """Takes the lines of a block scalar, which begin with as much white space as the first; returns their end."""
    first, indent = block.end(), block[1]
    end = text.find("\n", first, stop)
    while end >= 0 and text.startswith(indent, end + 1):
        end = text.find("\n", end + 1, stop)
    end = stop if end < 0 else end
    f.group.append((first, end, text[first:end]))
    f.last = "string"
    return end


def may_name(text: str) -> bool:
    """False only if the lexer can give no sensitive pair: a pair takes a mark, an element, an option, a call or a setter, and
    the words that score are next to each other in the text when all but letters and digits is left out."""
    squeezed = text.encode("utf-8", "surrogatepass").translate(_LOWER, _MARKS)
    if not any(mark in text for mark in ("=", ":", "--", "</", "(")) and b"set" not in squeezed and b"env" not in squeezed:
        return False
    return any(part in squeezed for part in _PARTS)


def named_spans(text: str) -> list[Span]:
    """Literals that flow into sensitive names; the whole text is lexed."""
    if not may_name(text):
        return []
    found: set[Span] = set()
    for name, parts in lexed_pairs(text, 0, len(text)):
        sensitive = name_score(name)
        if not sensitive:
            continue
        looks = value_score(parts)
        if looks and sensitive + looks >= MIN_SCORE:
            found |= {("named", a, b) for a, b, v in _taken(parts) if len(v) >= 2}
    return sorted(found, key=lambda s: s[1:])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    return base, base + named_spans(text)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named for each row."""
    schema = docs.select("doc_id").schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_named", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(6)]
            for text in texts_of(batch):
                base, spans = scan(text)
                n = Counter(k for k, _, _ in spans)
                for column, x in zip(columns, (n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n["named"]), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return mapped(docs.select("doc_id", "text"), run, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE: dict[str, str] = {}
