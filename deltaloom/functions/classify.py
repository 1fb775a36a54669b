"""Classification of files, lines and scores as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension, file_name, trim_all

# Names and patterns of the file categories, in the order in which they are tried.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock", "go.sum")
CATEGORY_RULES: tuple[tuple[str, tuple[tuple[str, tuple[str, ...]], ...]], ...] = (
    ("Lock", (("name is", LOCK_FILES),)),
    ("Generated", (("name has", (".generated.", "_generated.")), ("name ends", (".d.ts", ".pb.go")), ("path has", ("/codegen/", "/generated/")))),
    ("Snapshot", (("extension is", ("snap", "snapshot")), ("path has", ("/__snapshots__/",)))),
    ("Test", (("name has", (".test.", ".spec.")), ("name ends", ("_test.go", "_test.rs")), ("path has", ("/__tests__/", "/test/", "/tests/")), ("path starts", ("test/", "tests/")))),
    ("TypeDefinition", (("path has", ("/types/", "/interfaces/")), ("name ends", (".types.ts", ".types.js")))),
    ("Config", (("name has", (".config.",)), ("name starts", (".eslintrc", ".prettierrc", ".env", "docker-compose")), ("name is", ("Makefile", "Dockerfile")), ("name starts and ends", ("tsconfig", ".json")))),
    ("Style", (("extension is", ("css", "scss", "less")), ("name ends", (".module.css",)), ("name has", (".styled.",)))),
    ("Documentation", (("extension is", ("md", "mdx", "txt")), ("name starts", ("LICENSE", "CHANGELOG")))),
)
CATEGORY_WEIGHTS = {"Lock": 0.0, "Generated": 0.0, "Snapshot": 0.0, "Documentation": 0.2, "Config": 0.3, "Style": 0.4, "Test": 0.5, "TypeDefinition": 0.6, "Unknown": 0.7, "Source": 1.0}
STATUS_CODES = {"Added": "A", "Modified": "M", "Deleted": "D", "Renamed": "R"}
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "rs": "Rust"}
PRIORITIES = ("Deep", "Scan", "Glance", "Skip")


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def _rule(kind: str, values: tuple[str, ...], path: Column) -> Column:
    name = file_name(path)
    if kind == "name starts and ends":
        return name.startswith(values[0]) & name.endswith(values[1])
    subject = {"name": name, "path": path, "extension": extension(path)}[kind.split()[0]]
    test = kind.split()[1]
    if test == "is":
        return subject.isin(*values)
    return _any([{"has": subject.contains, "starts": subject.startswith, "ends": subject.endswith}[test](v) for v in values])


def file_category(path: Column) -> Column:
    """The category of the first rule that a path meets, else Source."""
    out = None
    for category, rules in CATEGORY_RULES:
        met = _any([_rule(kind, values, path) for kind, values in rules])
        out = F.when(met, category) if out is None else out.when(met, category)
    return out.otherwise("Source")


def category_weight(category: Column) -> Column:
    return F.coalesce(*(F.when(category == k, F.lit(v)) for k, v in CATEGORY_WEIGHTS.items()))


def status_code(status: Column) -> Column:
    return F.coalesce(*(F.when(status == k, v) for k, v in STATUS_CODES.items()))


def language(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(*(F.when(ext == k, v) for k, v in LANGUAGES.items()), F.lit("Unknown"))


def is_import_line(line: Column) -> Column:
    t = trim_all(line)
    return (
        t.startswith("import ")
        | (t.startswith("from ") & t.contains(" import "))
        | t.contains("require(")
        | t.startswith("use ")
        | t.startswith("#include")
        | (t.startswith("export ") & t.contains(" from "))
    )


def priority_score(new: Column, modified: Column, category: Column, risk: Column) -> Column:
    """Lines of new logic count three times, of changed logic twice; times the category's weight and the risk."""
    weight = category_weight(category)
    return F.when(weight == 0, F.lit(0.0)).otherwise((3 * new + 2 * modified).cast("double") * weight * risk)


def priority(score: Column) -> Column:
    return F.when(score > 100, "Deep").when(score > 20, "Scan").when(score > 0, "Glance").otherwise("Skip")


def semantic_summary(added: Column, changed: Column, deleted: Column) -> Column:
    """Like '+2fn ~1sig -1fn', without the parts that are zero; null if all are."""
    parts = [F.when(n > 0, F.concat(F.lit(sign), n.cast("string"), F.lit(unit))) for n, sign, unit in ((added, "+", "fn"), (changed, "~", "sig"), (deleted, "-", "fn"))]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def age(at: Column, now: Column, style: str = "list") -> Column:
    """How long ago: minutes, hours from 60 on, days from 24 hours on; style screen says 'just now' for no minute."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    if style == "screen":
        return F.when(days > 0, text(days, "d ago")).when(hours > 0, text(hours, "h ago")).when(minutes > 0, text(minutes, "m ago")).otherwise("just now")
    return F.when(hours < 1, text(minutes, "m ago")).when(hours < 24, text(hours, "h ago")).otherwise(text(days, "d ago"))


def truncate(text: Column, most: int) -> Column:
    """At most so many characters, the last three of them dots if something was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 3)), F.lit("...")))


def sanitize_branch(name: Column) -> Column:
    """Letters, digits and - _ / of any script stay, all else becomes -; none at either end."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}\-_/]", "-"), r"^-+|-+$", "")


def branch_file(branch: Column) -> Column:
    return F.replace(branch, F.lit("/"), F.lit("__"))


def note_id(at: Column, line: Column, before: Column) -> Column:
    return F.concat_ws("_", F.unix_millis(at).cast("string"), F.coalesce(line, F.lit(0)).cast("string"), before.cast("string"))
