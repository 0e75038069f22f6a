"""Rule-compile-time regex analysis (runs once per pattern, not per page).

* ``n_groups``: capturing groups (version = group 1 when > 0).
* ``clauses``: what every match must contain, as AND of ORs: of each clause at least one literal occurs
  in ``fold(text)``.  Literals are ASCII, lower-cased; an alternation gives one clause with a literal of
  each branch.  Empty: nothing is provable.  ``regex matches text  =>  every clause has a literal in fold(text)``.
* ``java_form``: the pattern in java.util.regex syntax, written out from its parse tree so that it means
  there what it means here: Unicode classes, ``$`` and ``^`` by line feeds, scoped flags.
* ``compiles``: whether java.util.regex itself takes the form.  A pattern without a form or that the engine
  refuses is quarantined (M15: one bad pattern in ``rlike`` would fail the whole query).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # Python >= 3.11
    from re import _constants as _sc
    from re import _parser as _sp
except ImportError:  # pragma: no cover
    import sre_constants as _sc  # type: ignore
    import sre_parse as _sp  # type: ignore

MIN_LITERAL = 3
#: Shorter literals are in nearly every text: no use as a filter.
SHORTEST = 2
#: Clauses kept of a pattern (fewer clauses only let more texts through to the regex).
MOST_CLAUSES = 4


def n_groups(pattern: str) -> int:
    try:
        return re.compile(pattern).groups
    except (re.error, OverflowError, RecursionError):
        return 0


class _Untranslatable(Exception):
    """A construct that java.util.regex has no form for."""


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:x}}}"


#: White space of text patterns (what str.isspace accepts) inside a Java class.
_BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASS = {"DIGIT": r"\p{Nd}", "SPACE": _BLANK, "WORD": r"\p{L}\p{N}_"}
_ASCII_CLASS = {"DIGIT": "0-9", "SPACE": r"\t-\r\x{20}", "WORD": "a-zA-Z0-9_"}


def _category(name: str, flags: int) -> str:
    """CATEGORY_WORD and the like, as an item of a Java class."""
    kind = name.removeprefix("CATEGORY_").removeprefix("NOT_")
    items = (_ASCII_CLASS if flags & re.ASCII else _CLASS)[kind]
    return f"[^{items}]" if "NOT_" in name else items


def _anchor(name: str, flags: int) -> str:
    word = f"[{(_ASCII_CLASS if flags & re.ASCII else _CLASS)['WORD']}]"
    lines = flags & re.MULTILINE
    return {"AT_BEGINNING": r"(?:\A|(?<=\n))" if lines else r"\A", "AT_BEGINNING_STRING": r"\A",
            "AT_END": r"(?=\n|\z)" if lines else r"(?=\n?\z)", "AT_END_STRING": r"\z",
            "AT_BOUNDARY": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            "AT_NON_BOUNDARY": f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"}[name]


def _emit(seq, flags: int) -> str:
    """java.util.regex text of a parsed sequence: every character is escaped, so no Java-only meaning arises."""
    out = []
    for op, av in seq:
        name = str(op)
        if op is _sc.LITERAL:
            out.append(_char(av))
        elif op is _sc.NOT_LITERAL:
            out.append(f"[^{_char(av)}]")
        elif op is _sc.ANY:
            out.append(r"[\s\S]" if flags & re.DOTALL else r"[^\n]")
        elif op is _sc.IN:
            items = [x for x in av if x[0] is not _sc.NEGATE]
            body = "".join(_category(str(v), flags) if o is _sc.CATEGORY else
                           f"{_char(v[0])}-{_char(v[1])}" if o is _sc.RANGE else _char(v) for o, v in items)
            # a negated class of classes: the union first, then its complement
            out.append(f"[^[{body}]]" if len(items) < len(av) else f"[{body}]")
        elif op is _sc.BRANCH:
            out.append("(?:" + "|".join(_emit(x, flags) for x in av[1]) + ")")
        elif op is _sc.SUBPATTERN:
            group, add, drop, inner = av
            body = _emit(inner, (flags | add) & ~drop)
            if drop & re.IGNORECASE:  # rules run case-insensitively; a scope may switch that off and on
                body = f"(?-iu:{body})"
            elif add & re.IGNORECASE:
                body = f"(?iu:{body})"
            out.append(("(" if group is not None else "(?:") + body + ")")
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, inner = av
            most = "" if hi is _sc.MAXREPEAT else str(hi)
            kind = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}[name]
            out.append(f"(?:{_emit(inner, flags)}){{{lo},{most}}}{kind}")
        elif op is _sc.AT:
            out.append(_anchor(str(av), flags))
        elif op in (_sc.ASSERT, _sc.ASSERT_NOT):
            direction, inner = av
            out.append(f"(?{'<' if direction < 0 else ''}{'=' if op is _sc.ASSERT else '!'}{_emit(inner, flags)})")
        elif op is _sc.GROUPREF:
            out.append(f"(?:\\{av})")
        elif name == "ATOMIC_GROUP":
            out.append(f"(?>{_emit(av, flags)})")
        else:
            raise _Untranslatable(name)
    return "".join(out)


def java_form(pattern: str | None) -> str | None:
    """The pattern in java.util.regex syntax, or None if it is no valid regex or has no Java form.

    Written out anew from the parse tree, so what Python accepts and Java reads differently (named groups,
    ``{,n}``, brackets and ``&&`` inside classes) neither fails nor changes its meaning in ``rlike``.
    """
    if pattern is None:
        return None
    try:
        re.compile(pattern)
        parsed = _sp.parse(pattern)
        return _emit(parsed, parsed.state.flags)
    except (re.error, _Untranslatable, OverflowError, RecursionError, KeyError, ValueError):
        return None


def compiles(form: Column) -> Column:
    """Whether java.util.regex compiles the form (NULL and refused forms: false); judged by the engine itself."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.concat(F.lit("(?iu)"), form)).isNotNull()


def is_valid(pattern: str) -> bool:
    return java_form(pattern) is not None


def _least(clause: list[str]) -> tuple:
    """Order of usefulness: long literals, then few of them."""
    return -min(map(len, clause)), len(clause), clause


def _needs(seq) -> list[list[str]]:
    """Clauses of a mandatory sequence of parsed items."""
    out: list[list[str]] = []
    run: list[str] = []

    def flush():
        if run:
            out.append(["".join(run)])
            run.clear()

    for op, av in seq:
        name = str(op)
        if op is _sc.LITERAL and 32 <= av < 127:
            run.append(chr(av).lower())
            continue
        flush()
        if op is _sc.SUBPATTERN:
            out += _needs(av[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and av[0] >= 1:
            out += _needs(av[2])
        elif name == "ATOMIC_GROUP":
            out += _needs(av)
        elif op is _sc.BRANCH:
            each = [_needs(branch) for branch in av[1]]
            if all(each):  # one literal of each branch; a branch that needs nothing voids the clause
                out.append(sorted({lit for found in each for lit in min(found, key=_least)}))
    flush()  # classes, anchors, assertions and optional parts need nothing
    return out


def clauses(pattern: str | None) -> list[list[str]]:
    """AND of ORs of literals that every text with a match contains; [] if nothing of use is provable."""
    try:
        parsed = _sp.parse(pattern)
    except Exception:
        return []
    found = sorted({tuple(c) for c in _needs(parsed)}, key=lambda c: _least(list(c)))
    found = [list(c) for c in found if min(map(len, c)) >= SHORTEST]
    long = [c for c in found if min(map(len, c)) >= MIN_LITERAL]
    return (long or found)[:MOST_CLAUSES]


def mandatory_literal(pattern: str) -> str | None:
    """The longest single literal that every match contains, if it is long enough to filter by."""
    single = [c[0] for c in clauses(pattern) if len(c) == 1 and len(c[0]) >= MIN_LITERAL]
    return max(single, key=len, default=None)


def analyze(pattern: str) -> tuple[int, list[list[str]], bool]:
    if not is_valid(pattern):
        return 0, [], False
    return n_groups(pattern), clauses(pattern), True


#: Characters other than ASCII ones that match an ASCII letter when case is ignored (fixed values); the sigmas are
#: one letter here, so that folding a character does not depend on its neighbours.
_FOLDS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k", "\u03a3": "\u03c3", "\u03c2": "\u03c3"}


def fold(text: str) -> str:
    """Case fold of the text side of the literal prefilter, character by character."""
    for other, letter in _FOLDS.items():  # each a plain search of the text; a translation looks up every character
        text = text.replace(other, letter)
    return text.lower()


def static_domain(pattern: str | None) -> str | None:
    """The host that a script pattern begins with, if it is fixed text: the leading characters of the parse
    tree up to the first part that varies, cut at the path, without scheme and port; NULL unless it has valid labels."""
    try:
        items = list(_sp.parse(pattern))
    except Exception:
        return None
    text = ""
    for op, av in items:
        if op is _sc.AT and not text:
            continue
        if op is _sc.LITERAL:
            text += chr(av)
        elif op is _sc.ANY:  # an unescaped dot of a host name
            text += "."
        elif str(op) == "MAX_REPEAT" and av[:2] == (0, 1) and [o for o, _ in av[2]] == [_sc.LITERAL] and text in ("http", "HTTP"):
            text += chr(av[2][0][1])
        else:
            if str(op).endswith("REPEAT") and [o for o, _ in av[2]] == [_sc.LITERAL]:
                text += chr(av[2][0][1])  # the repeated character itself is fixed
            break
    for scheme in ("https:", "http:", "https", "http", "/"):
        if text.lower().startswith(f"{scheme}/"):
            text = text[len(scheme):].lstrip("/")
            break
    host = text.split("/")[0].split(":")[0]
    labels = host.split(".")
    plain = all(re.fullmatch("[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?", label) for label in labels)
    return host.lower() if len(labels) > 1 and plain else None
