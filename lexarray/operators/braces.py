"""Declarations of languages with braces, in one pass: a lexer that knows strings, comments, templates and patterns, and a
stack of open brackets, each with the tokens since its last statement. What stands before a `{` says what it opens."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

_TEXT = {
    "java": r'"""(?:(?:\\.|.)*?"""|.*)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?',
    "go": r'"(?:\\.|[^"\\\n])*"?|`[^`]*`?|\'(?:\\.|[^\'\\\n])*\'?',
    "rust": r'b?r(?P<hash>\#*)"(?:.*?"(?P=hash)|.*)|b?"(?:\\.|[^"\\])*"?|\'(?:\\[^\']*|[^\'\\\n])\'',
    "javascript": r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?',
}
_TEXT["typescript"] = _TEXT["javascript"]
_LEXERS = {k: re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*(?:.*?\*/|.*))|(?P<text>{v})|(?P<word>[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*)|(?P<mark>=>|->|\.\.\.|.)", re.S) for k, v in _TEXT.items()}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_PIECE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{|)", re.S)
_SCRIPTS = ("javascript", "typescript")
_TYPES = {"class", "struct", "interface", "enum", "trait", "impl"}
_FUNCTIONS = {"function", "func", "fn"}
_BEFORE = set("export default public private protected static async abstract final pub unsafe extern const declare get set override readonly synchronized native strictfp".split())
_CONTROL = set("if for while switch catch with synchronized try else do return match loop unsafe new function await typeof".split())
_STARTERS = _TYPES | _FUNCTIONS | set("const let var async export import abstract return if for while do switch try throw type declare static public private protected readonly get set".split())
_VALUES_END = {")", "]", "}"}


class Token(NamedTuple):
    text: str
    at: int
    end: int
    kind: str  # word, text, mark, or group: a pair of brackets and what is inside


def _tokens(text: str, language: str) -> Iterator[Token]:
    lexer, at, n = _LEXERS[language], 0, len(text)
    templates: list[int] = []  # of open ${: how many braces are open inside
    last = ""
    while at < n:
        c = text[at]
        if language in _SCRIPTS and (c == "`" or (c == "}" and templates and not templates[-1])):
            if c == "}":
                templates.pop()
            m = _PIECE.match(text, at + 1)
            if m[1] == "${":
                templates.append(0)
            last, at = '"', m.end()
            continue
        if c == "/" and language in _SCRIPTS and text[at : at + 2] not in ("//", "/*") and not (last[-1:].isalnum() or last in _VALUES_END or last in ('"', "_", "$")) or c == "/" and last in ("return", "typeof", "case") and text[at : at + 2] not in ("//", "/*"):
            m = _PATTERN.match(text, at)
            if m:
                last, at = '"', m.end()
                continue
        m = lexer.match(text, at)
        at = m.end()
        if m.lastgroup == "skip":
            continue
        if templates and m[0] in "{}":
            templates[-1] += 1 if m[0] == "{" else -1
        last = '"' if m.lastgroup == "text" else m[0]
        yield Token(m[0], m.start(), at, m.lastgroup if m.lastgroup != "hash" else "text")


class Declared(NamedTuple):
    kind: str
    name: str
    start: int
    brace: int
    end: int
    depth: int
    bases: list[str] | None
    interfaces: list[str] | None
    types: list[str] | None
    returns: str | None
    signature: str
    branches: int


class _Frame:
    """An open bracket; loop: the body of a do, or the head of a for."""

    def __init__(self, opened: Token, declared: dict | None = None, loop: bool = False) -> None:
        self.opened, self.declared, self.loop = opened, declared, loop
        self.head: list[Token] = []
        self.branches = self.semicolons = 0


def _split(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that no bracket holds."""
    out, depth, a = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] not in ("-", "="):
            depth -= 1
        elif c == mark and depth <= 0 and text[i : i + 2] != "=>":
            out.append(text[a:i])
            a = i + 1
    return [x.strip() for x in [*out, text[a:]] if x.strip()]


def _types(parameters: str, language: str) -> list[str] | None:
    given, out = _split(parameters), []
    for x in given:
        if language == "go":
            parts = x.split(None, 1)
            out += parts[1:]
        elif language == "java":
            parts = re.sub(r"^(?:(?:final|@\w+(?:\([^)]*\))?)\s+)+", "", x).rsplit(None, 1)
            out += parts[:1] if len(parts) > 1 else []
        else:
            name, *kind = _split(x, ":") if "::" not in x else [y.strip() for y in re.split(r"(?<!:):(?!:)", x, maxsplit=1)]
            if kind and not name.endswith("?"):
                out.append(_split(":".join(kind), "=")[0])
    return out or None


def _named(x: str) -> str:
    """A type's name without arguments."""
    return re.split(r"[<({\s]", x.strip(), maxsplit=1)[0]


class _Parser:
    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.found: list[Declared] = []

    def run(self) -> list[Declared]:
        text, language, breaks = self.text, self.language, _line_starts(self.text)
        frames = [_Frame(Token("", 0, 0, "mark"))]
        tokens = list(_tokens(text, language))
        line, before, braces = 0, None, 0
        skip_while = False
        for i, t in enumerate(tokens):
            top = frames[-1]
            own = bisect.bisect_right(breaks, t.at)
            if own != line:
                if language == "go" and before is not None and (before.kind != "mark" or before.text in _VALUES_END) and top.opened.text != "(" or language in _SCRIPTS and t.text in _STARTERS:
                    top.head.clear()
                line = own
            before = t
            if t.kind != "mark":
                if t.kind == "word":
                    self._count(t, top, skip_while, tokens, i)
                skip_while = False
                top.head.append(t)
            elif t.text in "([":
                frames.append(_Frame(t, loop=bool(top.head) and top.head[-1].text == "for" and not (len(top.head) > 1 and top.head[-2].text == ".")))
            elif t.text == "{":
                braces += 1
                if language == "go" and top.head and top.head[-1].text in ("interface", "struct") and i + 1 < len(tokens) and tokens[i + 1].text == "}":
                    frames.append(_Frame(t))  # an empty type, part of the head
                    continue
                frames.append(_Frame(t, self._declared(top.head, t, frames), bool(top.head) and top.head[-1].text == "do"))
            elif t.text in ")]}":
                # a bracket that nothing opened closes nothing; a brace closes what was left open inside it
                match = {")": "(", "]": "[", "}": "{"}[t.text]
                while frames[-1].opened.text != match and frames[-1].opened.text in ("([" if braces or t.text != "}" else "") and len(frames) > 1:
                    frames.pop()
                if len(frames) > 1 and frames[-1].opened.text == match:
                    braces -= match == "{"
                    done = frames.pop()
                    under = frames[-1]
                    under.branches += done.branches + (match == "(" and done.loop and done.semicolons == 2)
                    if t.text != "}":
                        under.head.append(Token(done.opened.text, done.opened.at, t.end, "group"))
                    elif done.declared is None and language == "go" and under.head and under.head[-1].text in ("interface", "struct") and done.opened.at + 1 == t.at:
                        under.head.append(Token("{}", done.opened.at, t.end, "word"))
                    else:
                        skip_while = done.loop
                        if done.declared:
                            self.found.append(Declared(**done.declared, end=t.end, branches=done.branches))
                        under.head.clear()
            elif t.text == ";":
                top.semicolons += 1
                if top.opened.text != "(":
                    top.head.clear()
            else:
                top.head.append(t)
        return sorted(self.found, key=lambda d: (d.start, -d.end))

    def _count(self, t: Token, top: _Frame, skip_while: bool, tokens: list[Token], i: int) -> None:
        """Branches as statements: if, while, switch, try and catch; a for counts when its head closes with two semicolons."""
        follows = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if i and tokens[i - 1].text == "." or follows in (":", "="):
            return
        if t.text in ("if", "switch", "catch", "try") and (follows in "({" or t.text == "if") or t.text == "while" and not skip_while:
            top.branches += 1

    def _declared(self, head: list[Token], brace: Token, frames: list[_Frame]) -> dict | None:
        text, language = self.text, self.language
        words = [x.text if x.kind == "word" else None for x in head]
        typed = next((k for k, w in enumerate(words) if w in _TYPES and not (k and head[k - 1].text == ".")), None)
        called = next((k for k, w in enumerate(words) if w in _FUNCTIONS), None)
        if typed is not None and (called is None or typed < called) and not any(x.text == "=" for x in head[:typed]):
            name = next((k for k in range(typed + 1, len(head)) if words[k]), None)
            if words[typed] == "impl" and name is not None and head[typed + 1].text == "<":  # type arguments first
                depth = 0
                for k in range(typed + 1, len(head)):
                    depth += (head[k].text == "<") - (head[k].text == ">")
                    if not depth:
                        name = next((j for j in range(k + 1, len(head)) if words[j]), None)
                        break
            if language == "go" and typed >= 2 and words[typed - 2] == "type":
                name = typed - 1
            if name is None or words[name] in ("extends", "implements"):
                return None
            after = text[head[name].end : brace.at]
            bases = re.search(r"(?<![\w<])extends\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", _outside(after), re.S)
            interfaces = re.search(r"\bimplements\s+(.*?)(?=\bpermits\b|$)", after, re.S)
            return self._made("class_declaration", head, min(typed, name), name, brace, frames, [_named(x) for x in _split(bases[1])] if bases else None, _split(interfaces[1]) if interfaces else None)
        if called is not None:
            name = called + 1
            while name < len(head) and (head[name].text == "*" or language == "go" and head[name].kind == "group" and name == called + 1):
                name += 1
            group = next((k for k in range(name + 1, len(head)) if head[k].kind == "group" and head[k].text == "("), None)
            return self._made("function_declaration", head, called, name, brace, frames, group=group) if name < len(head) and words[name] and group is not None else None
        if head and head[-1].text == "=>" or any(x.text == "=>" for x in head[-1:]):
            bound = next((k for k, w in enumerate(words) if w in ("const", "let", "var")), None)
            if bound is None or bound + 1 >= len(head) or not words[bound + 1] or not any(x.text == "=" for x in head):
                return None
            group = next((k for k in range(len(head) - 1, -1, -1) if head[k].kind == "group" and head[k].text == "("), None)
            return self._made("function_declaration", head, bound, bound + 1, brace, frames, group=group)
        outer = frames[-1]
        if outer.opened.text == "(" or outer.declared and outer.declared["kind"] != "class_declaration" or not (outer.declared or len(frames) == 1 or language == "java") or language in ("go", "rust"):
            return None
        group = next((k for k in range(len(head)) if head[k].kind == "group" and head[k].text == "(" and k and not head[k - 1].text == "@" and not (k > 1 and head[k - 2].text == "@") and words[_back(head, k)] and words[_back(head, k)] not in _CONTROL), None)
        if group is None or any(w in ("new", "return") for w in words[:group]) or any(x.text in ("=", ".") for x in head[:group]) and language == "java":
            return None
        name = _back(head, group)
        return self._made("method_definition", head, 0 if language == "java" else name, name, brace, frames, group=group)

    def _made(self, kind: str, head: list[Token], first: int, name: int, brace: Token, frames: list[_Frame], bases: list[str] | None = None, interfaces: list[str] | None = None, group: int | None = None) -> dict:
        text, language = self.text, self.language
        while first and (head[first - 1].text in _BEFORE or head[first - 1].text == "type" or head[first - 1].kind == "group" and first > 1 and head[first - 2].text == "pub"):
            first -= 1
        if language == "java":
            first = 0
        types = returns = None
        start = first
        if kind != "class_declaration":
            while language in _SCRIPTS and head[start].text in ("export", "default", "declare"):
                start += 1
            if group is not None:
                types = _types(text[head[group].at + 1 : head[group].end - 1], language)
                after = text[head[group].end : brace.at].strip()
                if language == "java":
                    between = [x.text for x in head[:name]]
                    k = next((j for j in range(name) if head[j].kind == "word" and head[j].text not in _BEFORE and not (j and head[j - 1].text == "@")), name)
                    returns = text[head[k].at : head[name].at].strip() or None if between else None
                elif language == "go":
                    returns = after or None
                else:
                    m = re.match(r"(?:->|:)\s*(.*?)\s*(?:=>\s*$|\bwhere\b|$)", after, re.S)
                    returns = m[1] if m and m[1] else None
        depth = sum(f.declared is not None for f in frames)
        return {"kind": kind, "name": head[name].text, "start": head[first].at, "brace": brace.at, "depth": depth, "bases": bases, "interfaces": interfaces, "types": types, "returns": returns, "signature": text[head[start].at : brace.at].strip()}


def _back(head: list[Token], group: int) -> int:
    """The token before a group's type arguments, if it has any."""
    k, depth = group - 1, 0
    while k > 0 and (head[k].text == ">" or depth):
        depth += (head[k].text == ">") - (head[k].text == "<")
        k -= 1
    return k


def _outside(text: str) -> str:
    """A text whose leading type parameters are blank."""
    lead = re.match(r"\s*<", text)
    if not lead:
        return text
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">" and text[i - 1] not in "-=")
        if c == ">" and not depth:
            return " " * (i + 1) + text[i + 1 :]
    return text


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def declarations(text: str, language: str) -> list[tuple[Declared, int, int]]:
    """What a text declares with a closed body, by start, with first and last lines."""
    breaks = _line_starts(text)
    return [(d, bisect.bisect_right(breaks, d.start), bisect.bisect_right(breaks, d.end - 1)) for d in _Parser(text, language).run()]
