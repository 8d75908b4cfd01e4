"""The formatter: one style for blanks and indentation; comments, texts and line ends stay."""

from __future__ import annotations

from ledgerloom.lang import syntax

_PIECE = syntax._TOKEN


def _pieces(line: str, inside: bool) -> tuple[list[str], bool]:
    """The pieces of a line without blanks between them, and whether a text of several lines goes on behind it."""
    return [m.group() for m in _PIECE.finditer(line) if m.lastgroup != "blank" or m.group().startswith("#")], inside


def _joined(pieces: list[str]) -> str:
    out = ""
    before = ""
    for p in pieces:
        tight = not out or p in (",", ")", "]", ":", "?", ".") or before in ("(", "[", ".") or (p == "(" and (before[-1:].isalnum() or before[-1:] in "_`")) or (p == "[" and before == "")
        out += p if tight else " " + p
        before = p
    return out


def formatted(source: str) -> str:
    """The program in the common style: four blanks for each open brace, steps one level deeper, one blank between words, at most one empty
    line. The tokens are the same, so the program is."""
    wanted = syntax.tokens(source)
    out: list[str] = []
    depth, text = 0, ""
    for line in source.split("\n"):
        text = f"{text}\n{line}" if text else line
        if text.count('"""') % 2:  # a text of several lines stays as it is
            continue
        plain = text.strip()
        if "\n" in plain:
            first, *rest = plain.split("\n")
            out += ["    " * depth + first, *rest]
        elif not plain:
            if out and out[-1]:
                out.append("")
        else:
            pieces, _ = _pieces(plain, False)
            closing = len(pieces) and pieces[0] in ("}", "]", ")")
            step = pieces[:1] == ["|>"]
            out.append("    " * (max(0, depth - bool(closing)) + bool(step)) + _joined(pieces))
        marks = [t.text for t in syntax.tokens(text) if t.kind == "op"]
        depth = max(0, depth + sum(marks.count(x) for x in "{[(") - sum(marks.count(x) for x in "}])"))
        text = ""
    result = "\n".join(out).strip("\n") + "\n"
    if [(t.kind, t.text) for t in syntax.tokens(result)] != [(t.kind, t.text) for t in wanted]:
        raise ValueError("the formatter changed a token")
    return result
