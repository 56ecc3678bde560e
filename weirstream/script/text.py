"""From a script's text to its statements: comments, the default template, macros, splitting."""

from __future__ import annotations

import re

from .macros import DEFAULTS, MACROS


def strip_comments(text: str) -> str:
    """Remove -- comments outside single quotes, trim lines and drop blank ones. Quotes may span lines."""
    out, quoted = [], False
    for line in text.splitlines():
        i = 0
        while i < len(line):
            if line[i] == "'":
                quoted = not quoted
            elif not quoted and line.startswith("--", i):
                line = line[:i]
                break
            i += 1
        if line.strip():
            out.append(line.strip())
    return "\n".join(out)


_IMPORT = re.compile(r"<#import\s+[\"']([^\"']+)[\"']\s+as\s+(\w+)\s*/?>")
DEFAULT_IMPORT = "env_local.ftl"


def add_default_template(text: str, default: str = DEFAULT_IMPORT) -> str:
    """Put an import of the default template first if the script has none."""
    return text if _IMPORT.search(text) else f'<#import "{default}" as template>\n{text}'


_MACRO = re.compile(r"<@(\w+)\.(\w+)((?:\s+[\w.\\\-]+\s*=\s*(?:'[^']*'|\"[^\"]*\"))*)\s*/?>(?:\s*</@(?:\w+\.\w+)?>)?", re.S)
_PAIR = re.compile(r"([\w.\\\-]+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\")")


def expand_macros(text: str, values: dict[str, str] | None = None) -> str:
    """Expand <@template.name key='value' .../>; values override the environment's defaults (hosts, folders)."""
    known = DEFAULTS | (values or {})
    names = {m[2] for m in _IMPORT.finditer(text)}
    text = _IMPORT.sub("", text)

    def one(m: re.Match) -> str:
        if m[1] not in names:
            raise ValueError(f"template {m[1]} is not imported")
        if m[2] not in MACROS:
            raise ValueError(f"unknown macro {m[2]}")
        given = {re.sub(r"\\(.)", r"\1", k): a or b for k, a, b in _PAIR.findall(m[3])}
        return MACROS[m[2]].expand(given, known)

    return _MACRO.sub(one, text).strip()


def split_statements(text: str, strict: bool = False) -> list[str]:
    """Statements by semicolons outside single quotes. Strict, as scripts of old expect: what follows a semicolon on its line
    is dropped, and so is a last statement without one."""
    out, current, quoted = [], "", False
    for line in text.splitlines():
        rest = line
        while True:
            end = None
            for i, ch in enumerate(rest):
                if ch == "'":
                    quoted = not quoted
                elif ch == ";" and not quoted:
                    end = i
                    break
            if end is None:
                current += rest + "\n"
                break
            out.append((current + rest[:end]).strip())
            current, rest = "", rest[end + 1 :]
            if strict or not rest.strip():
                break
    if current.strip() and not strict:
        out.append(current.strip())
    return [s for s in out if s]


def prepare(text: str, values: dict[str, str] | None = None, default: str = DEFAULT_IMPORT) -> str:
    return expand_macros(add_default_template(strip_comments(text), default), values)
