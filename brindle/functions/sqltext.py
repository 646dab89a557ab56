"""Checks and rewrites of SQL text, before Spark parses it."""

from __future__ import annotations

import re
from collections.abc import Iterator

MOST_BYTES, MOST_PARAMETERS = 100 * 1024, 100
FORBIDDEN = frozenset("attach detach begin commit rollback savepoint release vacuum load_extension".split())
_READS = frozenset("select values explain".split())
_TOKENS = re.compile(
    r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quoted>'(?:[^']|'')*(?:'|\Z)|\"(?:[^\"]|\"\")*(?:\"|\Z)|`(?:[^`]|``)*(?:`|\Z)|\[[^\]]*(?:\]|\Z))"
    r"|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<number>[0-9][0-9A-Za-z_.]*)|(?P<end>;)|(?P<other>\S)",
    re.DOTALL,
)


class SqlError(ValueError):
    """A statement that isn't accepted."""


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of what isn't a comment or blank."""
    for m in _TOKENS.finditer(text):
        if m.lastgroup != "comment":
            yield m.lastgroup or "other", m.group()


def statements(text: str) -> list[str]:
    """The statements of a script, without empty ones; semicolons in quotes and comments don't count."""
    out, start = [], 0
    some = False
    for m in _TOKENS.finditer(text):
        if m.lastgroup == "end":
            if some:
                out.append(text[start : m.start()].strip())
            start, some = m.end(), False
        elif m.lastgroup != "comment":
            some = True
    if some:
        out.append(text[start:].strip())
    return out


def is_read_only(text: str) -> bool:
    """By the first word: WITH and PRAGMA count as writes."""
    first = next((t for k, t in tokens(text) if k == "word"), "")
    return first.lower() in _READS


def returns_rows(text: str) -> bool:
    words = [t.lower() for k, t in tokens(text) if k == "word"]
    return bool(words) and (words[0] in _READS or words[0] in ("with", "pragma") or "returning" in words)


def validate(text: str, parameters: list | None = None, *, one: bool = True) -> None:
    """Raises SqlError for what the surface doesn't accept."""
    if not text.strip():
        raise SqlError("empty statement")
    if len(text.encode()) > MOST_BYTES:
        raise SqlError("the statement is too long")
    if parameters is not None and len(parameters) > MOST_PARAMETERS:
        raise SqlError(f"at most {MOST_PARAMETERS} parameters")
    bad = next((t for k, t in tokens(text) if k == "word" and t.lower() in FORBIDDEN), None)
    if bad:
        raise SqlError(f"{bad} is not allowed")
    words = [t.lower() for k, t in tokens(text) if k == "word"]
    if any(a == "create" and b in ("temp", "temporary") for a, b in zip(words, words[1:])):
        raise SqlError("temporary objects are not supported")
    n = len(statements(text))
    if n == 0 or (one and n > 1):
        raise SqlError("exactly one statement is expected")


def literal(value: object) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (bytes, bytearray)):
        return "X'" + bytes(value).hex().upper() + "'"
    if isinstance(value, float):
        return "9e999" if value == float("inf") else "-9e999" if value == float("-inf") else "NULL" if value != value else repr(value)
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
