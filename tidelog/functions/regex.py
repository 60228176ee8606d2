"""RE2 expressions for Java's engine, which Spark uses.

What differs and is rewritten: ``$`` and ``^``, ``.``, ``\\s``, ``\\v``, octal escapes, named
groups, class syntax (nested brackets, ``&&``, POSIX names), literal braces. What RE2 doesn't have
(look-around, back-references, possessive and atomic groups) is refused, as are flag U and ``\\C``.
"""

from __future__ import annotations

import re

# RE2's class names.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r\x20", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
_SPACE = r"\t\n\f\r\x20"
_REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")
MAX_REPEAT = 1000


class RegexError(ValueError):
    """The expression isn't RE2, or can't be said in Java's syntax."""


def _escape(expr: str, i: int, in_class: bool) -> tuple[str, int]:
    """Translation of the escape at i, and where it ends."""
    if i + 1 >= len(expr):
        raise RegexError("trailing backslash")
    c = expr[i + 1]
    if c in "sS":
        if c == "s":
            return (_SPACE if in_class else f"[{_SPACE}]"), i + 2
        return f"[^{_SPACE}]", i + 2
    if c == "v":
        return r"\x0B", i + 2
    if c in "dDwWtnrfa":
        return expr[i : i + 2], i + 2
    if c == "x":
        m = re.compile(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))").match(expr, i)
        if not m:
            raise RegexError("bad \\x escape")
        return rf"\x{{{m[1] or m[2]}}}", m.end()
    if c in "pP":
        m = re.compile(r"\\[pP](?:\{(\^?)(\w+)\}|([A-Z]))").match(expr, i)
        if not m:
            raise RegexError("bad character class")
        name, negated = m[2] or m[3], (c == "P") != bool(m[1])
        name = name if len(name) <= 2 else f"Is{name}"
        return rf"\{'P' if negated else 'p'}{{{name}}}", m.end()
    if c in "01234567":
        m = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})").match(expr, i)
        if not m:
            raise RegexError("back-references aren't supported")
        return rf"\x{{{int(m[1], 8):x}}}", m.end()
    if not in_class and c in "AzbB":
        return expr[i : i + 2], i + 2
    if c.isascii() and not c.isalnum():
        return "\\" + c, i + 2
    raise RegexError(f"unknown escape \\{c}")


def _class(expr: str, i: int) -> tuple[str, int]:
    out, start = ["["], i + 1
    i = start
    if expr[i : i + 1] == "^":
        out.append("^")
        i += 1
        start = i
    while i < len(expr):
        c = expr[i]
        if c == "]" and i > start:
            return "".join([*out, "]"]), i + 1
        if expr.startswith("[:", i) and (end := expr.find(":]", i)) > 0:
            name = expr[i + 2 : end]
            if name.lstrip("^") not in POSIX:
                raise RegexError(f"unknown class {name}")
            found = POSIX[name.lstrip("^")]
            out.append(f"[^{found}]" if name.startswith("^") else found)
            i = end + 2
        elif c == "\\":
            piece, i = _escape(expr, i, True)
            out.append(piece)
        else:
            out.append("\\" + c if c in "[]&^#" else c)
            i += 1
    raise RegexError("missing closing ]")


def to_java_regex(expr: str) -> str:
    """An expression that Java's unanchored search matches as RE2 would match ``expr``."""
    out, i, depth = ["(?d)"], 0, [False]  # whether multi-line holds, for each open group
    can_repeat = repeated = False
    while i < len(expr):
        c = expr[i]
        atom = True
        if c == "\\" and expr.startswith("\\Q", i):
            end = expr.find("\\E", i)
            text = expr[i + 2 : end if end >= 0 else len(expr)]
            out.append("".join("\\" + x if x.isascii() and not x.isalnum() and not x.isspace() else x for x in text))
            i = end + 2 if end >= 0 else len(expr)
            atom = bool(text)
        elif c == "\\":
            piece, i = _escape(expr, i, False)
            out.append(piece)
        elif c == "[":
            piece, i = _class(expr, i)
            out.append(piece)
        elif c == "(":
            m = re.compile(r"\((\?P?<[A-Za-z_]\w*>|\?([ims]*)(-[ims]+)?([:)])|\?)?").match(expr, i)
            if m[1] == "?":
                raise RegexError("unsupported group")
            if m[4]:
                if not m[2] and not m[3] and m[4] == ")":
                    raise RegexError("missing flags")
                multi = depth[-1] if "m" not in (m[2] or "") + (m[3] or "") else "m" in (m[2] or "")
                # Multi-line is settled here, where anchors are rewritten.
                flags = (m[2] or "").replace("m", "") + (("-" + rest) if (rest := (m[3] or "-")[1:].replace("m", "")) else "")
                if m[4] == ")":
                    depth[-1] = multi
                    out.append(f"(?{flags})" if flags else "")
                    atom = False
                else:
                    depth.append(multi)
                    out.append(f"(?{flags}:")
                    atom = False
            else:
                depth.append(depth[-1])
                out.append("(")
                atom = False
            i = m.end()
        elif c == ")":
            if len(depth) == 1:
                raise RegexError("unexpected )")
            depth.pop()
            out.append(")")
            i += 1
        elif c in "*+?" or (c == "{" and _REPEAT.match(expr, i)):
            if not can_repeat:
                raise RegexError("missing argument to repetition operator" if not repeated else "invalid nested repetition operator")
            m = _REPEAT.match(expr, i) if c == "{" else None
            if m:
                low, high = int(m[1]), int(m[3]) if m[3] else None
                if low > MAX_REPEAT or (high or 0) > MAX_REPEAT or (high is not None and high < low):
                    raise RegexError("invalid repeat count")
            piece = m[0] if m else c
            i += len(piece)
            if expr[i : i + 1] == "?":
                piece, i = piece + "?", i + 1
            out.append(piece)
            can_repeat, repeated = False, True
            continue
        elif c == "$":
            out.append(r"(?=\n|\z)" if depth[-1] else r"\z")
            i += 1
        elif c == "^":
            out.append(r"(?:\A|(?<=\n))" if depth[-1] else r"\A")
            i += 1
        elif c == "|":
            out.append("|")
            atom = False
            i += 1
        else:
            out.append("\\" + c if c in "{}" else c)
            i += 1
        can_repeat, repeated = atom, False
    if len(depth) > 1:
        raise RegexError("missing closing )")
    return "".join(out)
