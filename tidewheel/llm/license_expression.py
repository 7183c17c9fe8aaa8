"""Licence expressions: identifiers joined by and, or and with, evaluated by a shunting yard.

With binds closest, then and, then or; operators of one kind group to the left. An
expression ends before the first word that cannot continue it; what is left open there (an
operator without a right side, an unclosed parenthesis with its contents kept) is dropped.

Its value: the labels it names and the burden of the licensee, who may choose the lighter
side of an or, has to bear the heavier of an and, and is let off strong copyleft by an
exception.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: What an identifier begins with (up to a digit's hyphen), its label, and its burden:
#: 0 none, 1 notice, 2 weak copyleft, 3 strong copyleft, 4 no commercial or no free use.
FAMILIES = {
    "0bsd": ("bsd", 0),
    "afl": ("afl", 1),
    "agpl": ("agpl", 3),
    "apache": ("apache", 1),
    "artistic": ("artistic", 2),
    "bsd": ("bsd", 1),
    "bsl": ("boost", 1),
    "cc-by": ("cc-by", 1),
    "cc-by-nc": ("cc-by-nc", 4),
    "cc-by-nc-nd": ("cc-by-nc", 4),
    "cc-by-nc-sa": ("cc-by-nc", 4),
    "cc-by-nd": ("cc-by-nd", 4),
    "cc-by-sa": ("cc-by-sa", 3),
    "cc0": ("cc0", 0),
    "cddl": ("cddl", 2),
    "epl": ("epl", 2),
    "eupl": ("eupl", 3),
    "expat": ("mit", 1),
    "gpl": ("gpl", 3),
    "isc": ("isc", 1),
    "lgpl": ("lgpl", 2),
    "licenseref": ("custom", 4),
    "mit": ("mit", 1),
    "mpl": ("mpl", 2),
    "ncsa": ("ncsa", 1),
    "ofl": ("ofl", 2),
    "python": ("python", 1),
    "unlicense": ("unlicense", 0),
    "wtfpl": ("wtfpl", 0),
    "x11": ("mit", 1),
    "zlib": ("zlib", 1),
}
#: Operators and how closely they bind.
BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")


class Value(NamedTuple):
    labels: frozenset[str]
    burden: int


def family(identifier: str) -> tuple[str, int] | None:
    """(label, burden) of an identifier in lower case, by the longest family that it begins with; None if it is none."""
    parts = identifier.rstrip("+.").split("-")
    for n in range(len(parts), 0, -1):
        found = FAMILIES.get("-".join(parts[:n]))
        # A name goes on with a version, a clause count or a manner; other words make it another name.
        if found and (n == len(parts) or parts[0] == "licenseref" or parts[n][:1].isdigit() or parts[n] in ("only", "or")):
            return found
    return None


def evaluate(postfix: list[str]) -> Value:
    """The value of an expression in postfix order."""
    stack: list[Value | str] = []
    for token in postfix:
        if token not in BINDS:
            known = family(token)
            stack.append(Value(frozenset([known[0]]), known[1]) if known else token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(Value(left.labels, min(left.burden, 2) if left.burden == 3 else left.burden))
        else:
            stack.append(Value(left.labels | right.labels, (min if token == "or" else max)(left.burden, right.burden)))
    return stack.pop()


def postfix(text: str, begin: int = 0) -> list[str]:
    """The longest expression at ``begin`` of a text in lower case, in postfix order; empty if there is none."""
    out: list[str] = []
    yard: list[str] = []
    wants, after_with = True, False
    while token := TOKEN.match(text, begin):
        word = token[1]
        if wants:
            if word == "(" and not after_with:
                yard.append(word)
            elif word != ")" and word not in BINDS and (family(word) or after_with and word != "("):
                out.append(word.rstrip("."))
                wants = after_with = False
            else:
                break
        elif word == ")":
            if "(" not in yard:
                break
            while (top := yard.pop()) != "(":
                out.append(top)
        elif (word := word.rstrip(".")) in BINDS and not (word == "with" and out[-1] in BINDS):
            while yard and yard[-1] != "(" and BINDS[yard[-1]] >= BINDS[word]:
                out.append(yard.pop())
            yard.append(word)
            wants, after_with = True, word == "with"
        else:
            break
        if word.endswith(".") and not wants:  # the end of a sentence
            break
        begin = token.end()
    if wants:  # nothing follows the last operator, which goes with the parentheses behind it
        while yard and yard[-1] == "(":
            yard.pop()
        if yard:
            yard.pop()
    out += [t for t in reversed(yard) if t != "("]
    return out
