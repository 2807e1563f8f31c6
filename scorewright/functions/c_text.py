"""Reading decompiled C through a small tokenizer: parameters, locals, definitions, and tokens that no compiler takes.

All rules work on tokens, so nothing inside a literal or a comment is ever taken for code. Kernels for vectorised UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F

VARIABLES = "array<struct<name:string,type:string,kind:string,arg_index:int>>"
#: What may begin a declaration, base types (and families of them), and words that are no names.
QUALIFIERS = {"unsigned", "signed", "const", "volatile", "static", "struct", "union", "enum"}
BASES = {"long", "short", "int", "char", "float", "double", "void", "bool", "_DWORD", "_QWORD", "_WORD", "_BYTE", "_BOOL", "size_t", "ssize_t", "ulong", "uint", "ushort", "uchar"}
FAMILIES = ("__int", "undefined")
NO_NAMES = {"if", "else", "while", "for", "return", "switch", "case", "break"}
#: Annotations that only decompilers write, bare ones and those with arguments.
ANNOTATIONS = {"__noreturn", "__pure", "__const", "__packed", "__noreturn__", "__hidden", "__usercall", "__userpurge", "__cdecl", "__stdcall", "__fastcall", "__thiscall", "__vectorcall"}
CALLED_ANNOTATIONS = {"__convention", "__reg", "__stack"}
#: Unsigned types by bytes.
UNSIGNED = {"1": "unsigned char", "2": "unsigned short", "4": "unsigned int", "8": "unsigned long"}

_LEX = re.compile(
    r"""(?P<gap>\s*)(?:
      (?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)
    | (?P<literal>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    | (?P<word>[^\W\d]\w*)
    | (?P<number>\d[\w.]*)
    | (?P<mark>::|<<=|>>=|<<|>>|\S)
    | \Z)""",
    re.S | re.X,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    gap: str
    opens_line: bool


def tokens(code: str, comments: bool = False) -> list[Token]:
    """The tokens of ``code``; comments count as gaps unless asked for."""
    out: list[Token] = []
    gap, fresh = "", True
    for m in _LEX.finditer(code):
        gap += m["gap"]
        fresh = fresh or "\n" in m["gap"]
        kind = m.lastgroup
        if kind in (None, "gap"):
            break
        if kind == "comment" and not comments:
            gap += m[kind]
            continue
        out.append(Token(kind, m[kind], m.start(kind), m.end(kind), gap, fresh))
        gap, fresh = "", False
    return out


def closers(ts: list[Token]) -> dict[int, int]:
    """For each opening bracket the place of its closing one, where it has one."""
    out, stack = {}, []
    for i, t in enumerate(ts):
        if t.kind != "mark":
            continue
        if t.text in _PAIRS:
            stack.append(i)
        elif stack and t.text == _PAIRS[ts[stack[-1]].text]:
            out[stack.pop()] = i
    return out


def _is(ts: list[Token], i: int, *texts: str) -> bool:
    return all(0 <= i + k < len(ts) and ts[i + k].text == x and ts[i + k].kind != "literal" for k, x in enumerate(texts))


def _text(ts: list[Token], first: int, last: int) -> str:
    """The code of tokens ``first`` to ``last`` (exclusive) as it was spaced, without the gap before."""
    return "".join(t.gap * (i > 0) + t.text for i, t in enumerate(ts[first:last]))


def _items(ts: list[Token], first: int, last: int) -> list[tuple[int, int]]:
    """Token ranges between the commas that stand in no bracket."""
    cuts, i, to = [first - 1], first, closers(ts)
    while i < last:
        if _is(ts, i, ","):
            cuts.append(i)
        i = to.get(i, i) + 1
    return [(a + 1, b) for a, b in zip(cuts, [*cuts[1:], last], strict=True)]


def split_commas(text: str) -> list[str]:
    """Parts between commas that stand in no bracket; an empty last part doesn't count."""
    ts = tokens(text)
    places = [0] + [x for _, b in _items(ts, 0, len(ts))[:-1] for x in (ts[b].start, ts[b].end)] + [len(text)]
    parts = [text[a:b] for a, b in zip(places[::2], places[1::2], strict=True)]
    return parts if parts[-1] else parts[:-1]


def definition(code: str, name: str) -> tuple[int, int, int] | None:
    """(start of the name, opening and closing bracket of the parameters) of a function's definition: a body follows."""
    ts = tokens(code)
    to = closers(ts)
    for i, t in enumerate(ts):
        if t.kind == "word" and t.text == name and _is(ts, i + 1, "(") and i + 1 in to and _is(ts, to[i + 1] + 1, "{"):
            return t.start, ts[i + 1].start, ts[to[i + 1]].start
    return None


def parameter(text: str) -> tuple[str, str] | None:
    """(name, type), or None where there is no name. A function pointer's type has ``(*)`` for the name."""
    ts = tokens(text)
    to = closers(ts)
    for i in to:
        named = [t for t in ts[i + 1 : to[i]] if t.kind == "word"]
        if _is(ts, i, "(", "*") and named:
            return named[0].text, (text[: ts[i].start] + "(*)" + text[ts[to[i]].end :]).strip()
    last = len(ts)
    while last and ts[last - 1].text == "]":  # array bounds
        last = next((a for a, b in to.items() if b == last - 1), 0)
    if last < 2 or ts[last - 1].kind != "word":
        return None
    return ts[last - 1].text, text[: ts[last - 1].start].strip()


def _is_base(word: str) -> bool:
    return word in BASES or len(word) > 2 and word.endswith("_t") or word != "__int" and word.rstrip("0123456789") in FAMILIES


def _local(ts: list[Token], i: int) -> tuple[str, str] | None:
    """(name, type) if a declaration begins at ``i``: qualifiers, base type, stars, name, bounds, initialiser."""
    at = i
    while at < len(ts) and ts[at].text in QUALIFIERS:
        at += 1
    if at >= len(ts) or not _is_base(ts[at].text):
        return None
    at += 2 if _is(ts, at, "long", "long") else 1
    while _is(ts, at, "*"):
        at += 1
    if at >= len(ts) or ts[at].kind != "word" or not ts[at].gap or ts[at].text in NO_NAMES:
        return None  # a name at a star doesn't count
    name, kind = ts[at].text, _text(ts, i, at)
    if _is(ts, at + 1, "["):
        at = next((k for k in range(at + 2, len(ts)) if _is(ts, k, "]")), at)
    if _is(ts, at + 1, "=") and any(_is(ts, k, ";") for k in range(at + 2, len(ts))) or _is(ts, at + 1, ";"):
        return name, kind
    return None


def locals_of(code: str) -> list[tuple[str, str]]:
    """(name, type) of the declarations that begin a line."""
    ts = tokens(code)
    found = (_local(ts, i) for i, t in enumerate(ts) if t.opens_line)
    return [x for x in found if x]


def variables(code: str | None, name: str | None) -> list[tuple[str, str, str, int | None]]:
    """(name, type, kind, argument's place): a definition's arguments, unnamed ones too, then other local declarations."""
    code = code or ""
    place = definition(code, name) if name else None
    arguments = [p.strip() for p in split_commas(code[place[1] + 1 : place[2]])] if place else []
    out: list[tuple[str, str, str, int | None]] = [(*(parameter(p) or ("", p)), "arg", i) for i, p in enumerate(arguments) if p not in ("", "void")]
    taken = {v[0] for v in out} - {""}
    return out + [(n, t, "stack", None) for n, t in locals_of(code) if n not in taken]


def _body(ts: list[Token], at: int) -> int | None:
    """The brace after parameters, past annotations and old-style declarations of the parameters."""
    while at < len(ts) and ts[at].kind == "word":
        end = at if ts[at].text in ANNOTATIONS else next((k for k in range(at, len(ts)) if ts[k].kind == "mark" and ts[k].text in ";{}=("), at)
        if end > at and ts[end].text != ";" or end == at and ts[at].text not in ANNOTATIONS:
            return None
        at = end + 1
    return at if _is(ts, at, "{") else None


def _definitions(code: str) -> Iterator[tuple[str, int, int, int]]:
    """(name, start, end, line) of each definition outside of brackets: head, parameters (old-style declarations too) and body."""
    ts = tokens(code)
    to, i, head = closers(ts), 0, 0
    while i < len(ts):
        if _is(ts, i, "#") and ts[i].opens_line:  # a directive is a line, or more where they are continued
            end = re.compile(r"(?:\\\n|[^\n])*").match(code, ts[i].start).end()
            while i < len(ts) and ts[i].start < end:
                i += 1
            head = i
            continue
        if ts[i].kind == "word" and ts[i].text not in NO_NAMES and i > head and i + 1 in to and _is(ts, i + 1, "("):
            body = _body(ts, to[i + 1] + 1)
            if body is not None:
                last = to.get(body, len(ts) - 1)
                yield ts[i].text, ts[head].start, ts[last].end if body in to else len(code), code.count("\n", 0, ts[i].start) + 1
                i = head = last + 1
                continue
        if _is(ts, i, ";"):
            head = i + 1
        i = to.get(i, i) + 1
        if i and _is(ts, i - 1, "}") and not _is(ts, i, ";"):
            head = i


def functions_of(code: str | None) -> list[tuple[str, str]]:
    """(name, text) of the definitions of a whole program; the first of a name counts."""
    out: dict[str, str] = {}
    for name, start, end, _ in _definitions(code or ""):
        out.setdefault(name, code[start:end])
    return list(out.items())


def definition_text(code: str | None, name: str | None, line: int | None = None) -> str | None:
    """The text of ``name``'s definition; of several that nearest to ``line``, the first of equally near ones."""
    found = [(abs((line or 0) - at) if line else 0, i, code[start:end]) for i, (n, start, end, at) in enumerate(_definitions(code or "")) if n == name]
    return min(found)[2] if found else None


def renamed(code: str | None, name: str) -> str | None:
    """``code`` with its first definition's name, wherever it stands as a word of code, replaced by ``name``."""
    first = next(_definitions(code or ""), None)
    if first is None:
        return code
    return "".join([name if t.kind == "word" and t.text == first[0] else t.text for t in _spaced(code)])


def _spaced(code: str) -> Iterator[Token]:
    """All of ``code`` as tokens, gaps and comments included."""
    at = 0
    for t in tokens(code, comments=True):
        if t.start > at:
            yield Token("gap", code[at : t.start], at, t.start, "", False)
        yield t
        at = t.end
    if at < len(code):
        yield Token("gap", code[at:], at, len(code), "", False)


def without_literals(code: str | None) -> str | None:
    """``code`` with empty literals and without comments."""
    if code is None:
        return None
    return "".join(t.text[0] * 2 if t.kind == "literal" else "" if t.kind == "comment" else t.text for t in _spaced(code))


Repair = Callable[[list[Token], int, dict[int, int]], "tuple[int, str | None] | None"]


def _qualified(ts, i, to):
    """``A::B::c`` and ``::c`` are ``c``; a version in the qualifier (``GLIBC_2.2.5``) belongs to it."""
    at = i
    while at < len(ts) and (ts[at].kind in ("word", "number") or _is(ts, at, ".")) and (at == i or not ts[at].gap) and not _is(ts, i, "."):
        at += 1
    if ts[i].kind == "number" or not _is(ts, at, "::") or at > i and ts[at].gap:
        return None
    before = ts[i - 1] if i else None
    called = at == i and before is not None and not ts[i].gap and (before.kind in ("word", "number") or before.text in ")]>")
    return None if called or at + 1 >= len(ts) or ts[at + 1].kind != "word" else (at + 1 - i, "")


def _annotation(ts, i, to):
    if ts[i].kind == "word" and ts[i].text in CALLED_ANNOTATIONS and i + 1 in to:
        return to[i + 1] + 1 - i, None
    if ts[i].kind == "word" and ts[i].text in ANNOTATIONS:
        return 1, None
    return (2, None) if _is(ts, i, "@") and ts[i].gap and i + 1 < len(ts) and ts[i + 1].kind in ("word", "number") else None


def _unsigned_shift(ts, i, to):
    shift = i + 1 < len(ts) and ts[i + 1].text in ("<<", ">>", "<<=", ">>=") and not ts[i + 1].gap and i + 2 < len(ts) and ts[i + 2].gap
    return (1, "") if _is(ts, i, "u") and ts[i].gap and shift else None


def _void_access(ts, i, to):
    return (5, "*(unsigned long *)") if _is(ts, i, "*", "(", "void", "*", ")") else None


def _piece(ts, i, to):
    """``v._4_2_``: two bytes of ``v`` from the fourth."""
    if not (ts[i].kind == "word" and _is(ts, i + 1, ".") and i + 2 < len(ts) and not ts[i + 1].gap and not ts[i + 2].gap):
        return None
    part = ts[i + 2].text.split("_")
    if len(part) != 4 or part[0] or part[3] or not part[1].isdigit() or part[2] not in UNSIGNED:
        return None
    return 3, f"(*({UNSIGNED[part[2]]} *)((char *)&{ts[i].text} + {part[1]}))"


def _computed_goto(ts, i, to):
    close = to.get(i + 1)
    simple = close is not None and not any(t.text in "()" for t in ts[i + 2 : close])
    return (close + 2 - i, "goto *(void *)(") if _is(ts, i, "goto", "(") and simple and _is(ts, close + 1, "(") else None


def _array_result(ts, i, to):
    """``int [4] f(``: a function can't return an array, but a pointer."""
    if not _is(ts, i, "[") or not _is(ts, i + 2, "]") or ts[i + 1].kind != "number" or not _is(ts, i + 4, "(") or ts[i + 3].kind != "word":
        return None
    at = i - 1
    while at >= 0 and (ts[at].kind == "word" or _is(ts, at, "*")) and not ts[at].opens_line:
        at -= 1
    return (4, "*" + ts[i + 3].text) if at >= 0 and ts[at].kind == "word" and ts[at].opens_line else None


def _float_mark(ts, i, to):
    digits = ts[i].text[:-1]
    return (1, digits) if ts[i].kind == "number" and ts[i].text.endswith("f") and digits.isdigit() else None


REPAIRS: tuple[Repair, ...] = (_annotation, _qualified, _unsigned_shift, _void_access, _piece, _computed_goto, _array_result, _float_mark)


def _repeated_structs(ts: list[Token], to: dict[int, int]) -> dict[int, int]:
    """First and last token of each plain struct typedef that a fuller one of its name (or an earlier as full) makes needless."""
    found: dict[str, list[tuple[int, int, int]]] = {}
    for i in range(len(ts)):
        end = to.get(i + 3)
        if end is None or not _is(ts, i, "typedef", "struct") or not _is(ts, i + 3, "{") or any(t.text in "{}" for t in ts[i + 4 : end]):
            continue
        if _is(ts, end + 1, ts[i + 2].text, ";"):
            fields = sum(t.text == ";" for t in ts[i + 4 : end])
            found.setdefault(ts[i + 2].text, []).append((-fields, i, end + 2))
    return {a: b for same in found.values() for _, a, b in sorted(same)[1:]}


def sanitize_tokens(code: str | None) -> str | None:
    """C of which a compiler takes every token, and of repeated struct typedefs only the fullest. Literals and comments stay."""
    if code is None:
        return None
    ts = tokens(code)
    to = closers(ts)
    needless = _repeated_structs(ts, to)
    out, i = [], 0
    while i < len(ts):
        if i in needless:
            out.append(ts[i].gap)
            i = needless[i] + 1
            continue
        width, text = next(filter(None, (r(ts, i, to) for r in REPAIRS)), (1, ts[i].text))
        if text is not None:  # otherwise the gap goes as well
            out.append(ts[i].gap + text)
        i += width
    tail = code[ts[-1].end :] if ts else code
    return "".join(out) + tail


def variables_udf():
    @F.pandas_udf(VARIABLES)
    def run(code: pd.Series, name: pd.Series) -> pd.Series:
        keys = ("name", "type", "kind", "arg_index")
        return pd.Series([[dict(zip(keys, v, strict=True)) for v in variables(c, n)] for c, n in zip(code, name, strict=True)])

    return run


def _strings(change: Callable[[str], str | None]):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for codes in batches:
            yield codes.map(change, na_action="ignore")

    return run


def sanitize_tokens_udf():
    return _strings(sanitize_tokens)


def without_literals_udf():
    return _strings(without_literals)


def renamed_udf():
    """Column function (code, name)."""

    @F.pandas_udf("string")
    def run(code: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([renamed(c, n) if n is not None else c for c, n in zip(code, name, strict=True)], dtype=object)

    return run


def definition_udf():
    """Column function (code, name, line)."""

    @F.pandas_udf("string")
    def run(code: pd.Series, name: pd.Series, line: pd.Series) -> pd.Series:
        return pd.Series([definition_text(c, n, None if pd.isna(at) else int(at)) for c, n, at in zip(code, name, line, strict=True)], dtype=object)

    return run


def functions_udf():
    @F.pandas_udf("array<struct<name:string,code:string>>")
    def run(code: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "code": c} for n, c in functions_of(x)] for x in code])

    return run
