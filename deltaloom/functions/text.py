"""Column helpers for lines, paths and globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, where Spark's trim only knows the blank.
_LEADING, _TRAILING = r"(?U)^\s+", r"(?U)\s+$"


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, _LEADING, "")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(trim_start(c), _TRAILING, "")


def is_blank(c: Column) -> Column:
    return trim_start(c) == ""


def lines(text: Column) -> Column:
    """The lines of a text, without the empty one behind a last line break; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty for names that have none or only a leading one."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def normalize_path(path: Column) -> Column:
    """Drops '.' and empty parts and lets '..' take back the part before it, if there is one."""
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(empty)).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(kept, "/")


def glob_to_regex(glob: str) -> str | None:
    """A regular expression that matches whole paths like the glob does; None for an invalid one. '*' and '?' also
    match '/', '**' in a part of its own matches any number of directories, braces hold alternatives."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            at_start, at_end = i == 0 or glob[i - 1] == "/", i + run == len(glob) or glob[i + run] == "/"
            if run == 2 and at_start and at_end:
                if i + run < len(glob):
                    out.append("(?:.*/)?")
                    run += 1
                elif i == 0:
                    out.append(".*")
                else:
                    out.append(".+")
            else:
                out.append(".*")
            i += run
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] not in ("!", "^") else i + 3)
            if end < 0:
                return None
            inner = glob[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            out.append("[" + "^" * negated + inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append("\\" + glob[i])
        else:
            out.append("\\" + c if c in r".+()|^$]" else c)
        i += 1
    return None if depth else "(?s)^" + "".join(out) + "$"
