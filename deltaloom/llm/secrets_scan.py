"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import hashlib
import json
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import lean

# Public formats of keys, words beside secrets and beside what only looks like one, and path parts.
FORMATS = (
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[0-9A-Za-z]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)
RISKY_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "bearer", "credential", "credentials", "private", "access", "login")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "revision", "version", "etag", "id", "order", "invoice", "card", "phone", "url", "http", "https", "www", "example", "sample", "dummy", "test", "placeholder", "changeme")
HARMLESS_PATHS = ("test", "tests", "example", "examples", "docs", "doc", "fixtures", "sample", "samples", "vendor", "lock", "dist")

#: Runs of key characters with a digit, and quoted values that are assigned; of any length. Possessive, so that no run is read twice.
CANDIDATE = re.compile("|".join([*(f"(?P<{name}>{pattern})" for name, pattern in FORMATS), r"(?P<assigned>(?<=[=:]) ?[\"'][^\s\"']{8,}+[\"'])", r"(?P<entropy>(?<![0-9A-Za-z+/_@.-])(?=[A-Za-z+/_-]*[0-9])[0-9A-Za-z+/_-]{16,}+(?![0-9A-Za-z+/_@-]))"]))
#: What assigns, and the unquoted value behind it: up to white space, a quote, a closing tag or the next name of a list.
ASSIGN = re.compile(r"(?:=>|:=|[=:]{1,2})[ \t]*(?=[^\s\"'=:])")
VALUE = re.compile(r"(?:(?![&;,](?:[\w.-]+[=:]|\s|$)|</|<br)[^\s\"'])+")
#: Characters before and behind a candidate that are looked at.
CONTEXT = 60
TREES, DEPTH, FINDINGS = 40, 10, 4000

FEATURES = ("length", "entropy", "digits", "upper", "lower", "others", "distinct", "changes", "digit_runs", "longest_letters", "vowels", "hex", "dictionary", "format", "assigned", "quoted", "risky_near", "risky_distance", "harmless_near", "harmless_path", "only_digits", "repeats")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text))) if n else 0.0


def vocabulary(path: str) -> frozenset[str]:
    """Words of four small ASCII letters or more that end a word in a public tokenizer's vocabulary."""
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    return frozenset(w[:-4] for w in words if w.endswith("</w>") and len(w) >= 8 and w[:-4].isascii() and w[:-4].isalpha() and w[:-4].islower())


def coverage(text: str, words: frozenset[str]) -> float:
    """Share of the letters that dictionary words of four letters or more cover, longest first from the left."""
    covered = total = 0
    for part in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", text):
        part, i = part.lower(), 0
        total += len(part)
        while i < len(part):
            n = next((n for n in range(min(14, len(part) - i), 3, -1) if part[i : i + n] in words), 0)
            covered += n
            i += n or 1
    return covered / total if total else 0.0


def describe(kind: str, value: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    """FEATURES of a candidate: its length and characters, their transitions, dictionary coverage, path and neighbours."""
    n = len(value)
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value)
    count = {k: kinds.count(k) / n for k in "dulo"}
    near = re.findall(r"[a-z0-9]+", before.lower())[-6:]
    behind = re.findall(r"[a-z0-9]+", after.lower())[:4]
    distance = next((i for i, w in enumerate(reversed(near)) if w in RISKY_WORDS), 9)
    letters = re.findall(r"[A-Za-z]+", value)
    parts = re.findall(r"[a-z0-9]+", path.lower())
    return [
        min(n, 100), entropy(value), count["d"], count["u"], count["l"], count["o"], len(set(value)) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), len(re.findall("d+", kinds)) / n * 10,
        max(map(len, letters), default=0) / n, sum(c in "aeiouAEIOU" for c in value) / max(1, sum(map(len, letters))),
        float(all(c in string.hexdigits for c in value)), coverage(value, words), float(kind not in ("assigned", "entropy")),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before[-1:] != ""),
        float(distance < 9), distance, sum(w in HARMLESS_WORDS for w in near[-3:] + behind[:1]), float(any(p in HARMLESS_PATHS for p in parts)),
        float(value.isdigit()), 1 - len({value[i : i + 2] for i in range(n - 1)}) / max(1, n - 1),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, left child (right is next), share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, left[at] + right, at)
            total += share[at]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, ...]:
    feature, threshold, left, share = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(y)), depth)]
    while todo:
        node, rows, room = todo.pop()
        p = share[node] = float(y[rows].mean()) if len(rows) else 0.0
        if room == 0 or len(rows) < 4 or p in (0.0, 1.0):
            continue
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], y[rows][order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            ones = np.cumsum(t)[cut - 1]
            a, b = ones / cut, (t.sum() - ones) / (len(t) - cut)
            gain = p * (1 - p) - (cut * a * (1 - a) + (len(t) - cut) * b * (1 - b)) / len(t)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float(v[cut[i]] + v[cut[i] - 1]) / 2)
        if best[1] < 0:
            continue
        feature[node], threshold[node], left[node] = best[1], best[2], len(feature)
        for _ in range(2):
            feature.append(-1), threshold.append(0.0), left.append(0), share.append(0.0)
        right = x[rows, best[1]] > best[2]
        todo += [(left[node], rows[~right], room - 1), (left[node] + 1, rows[right], room - 1)]
    return np.array(feature), np.array(threshold), np.array(left), np.array(share)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Bagged trees, each split the best of a random subset of features by Gini impurity."""
    rng = np.random.default_rng(seed)
    return Forest([_grow(x[rows], y[rows], rng, depth) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))])


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, str, int]]:
    """Findings (kind, value, before, after, path, label) as reviewers label them, made by a seeded generator from
    public formats: random keys in assignments and headers against digests, identifiers, numbers, names and samples."""
    rng = np.random.default_rng(seed)

    def pick(items):
        return items[int(rng.integers(len(items)))]

    def chars(alphabet: str, least: int, most: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(least, most + 1))))

    low, high, digits, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    syllables = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "on", "ing")]
    prose = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(k))
    out = []
    for i in range(n - n // 5):
        secret, kind = i % 2, "entropy"
        path = pick(("src/app", "config/prod", "deploy/env", "web", "crawl", "src7", "tests/unit", "docs/guide", "examples"))
        before, after = prose(4) + " ", " " + prose(3)
        if secret:
            form = int(rng.integers(6))
            value = (lambda: chars(hexa, 32, 64), lambda: chars(low + high + digits, 20, 64), lambda: "AKIA" + chars(high + digits, 16, 16), lambda: "ghp_" + chars(low + high + digits, 36, 36), lambda: "sk_live_" + chars(low + high + digits, 24, 24), lambda: chars(low + high + digits + "+/", 24, 48))[form]()
            kind = {2: "aws_key", 3: "github_token", 4: "stripe_key"}.get(form, "entropy")
            if kind == "entropy" or rng.random() < 0.5:  # keys of known formats also stand alone
                quote = pick(('"', "'", "", '"'))
                before += pick(RISKY_WORDS) + pick((" = ", ": ", "=", " ")) + quote
                after = quote + after
            path = pick(("src/app", "config/prod", "deploy/env", "web", "crawl", "src7", "notes"))
        else:
            form = int(rng.integers(9))
            value = (lambda: chars(hexa, 40, 40), lambda: chars(hexa, 32, 32), lambda: "-".join(chars(hexa, k, k) for k in (8, 4, 4, 4, 12)), lambda: chars(digits, 16, 19), lambda: prose(4).replace(" ", "_") + "_" + chars(digits, 1, 3), lambda: "".join(w.title() for w in prose(4).split()) + chars(digits, 1, 2), lambda: pick(("example_api_key_1234", "your-token-here-1", "changeme12345678", "XXXXXXXXXXXXXXX1", "placeholder_0001", "00000000000000000000")), lambda: prose(3).replace(" ", "/") + "/" + chars(digits, 2, 4), lambda: chars(digits, 4, 4) + "-" + chars(digits, 2, 2) + "-" + chars(digits, 2, 2) + "T" + chars(digits, 6, 6))[form]()
            if form in (0, 1, 2):
                before += pick(("commit", "sha1", "md5", "checksum", "revision", "uuid", "digest", "etag")) + pick((" ", ": ", "="))
            elif form == 6:
                before += pick(RISKY_WORDS) + pick((" = ", ": ")) + '"'
                after = '"' + after
                kind = "assigned"
        out.append((kind, value, before[-CONTEXT:], after[:CONTEXT], path, secret))
    # A fifth: passwords and long keys that are assigned, against words, references and numbers that are, and long data.
    marks = "!#$%^*?+@"
    for i in range(n // 5):
        secret, kind, quote = i % 2, "assigned", ""
        word = prose(1)
        before, after = prose(4) + " " + pick(RISKY_WORDS) + pick(("=", ": ", " = ", ":")), pick((" ", "\n", "; ")) + prose(3)
        form = int(rng.integers(4))
        if secret:
            value = (lambda: chars(low + high + digits + marks, 8, 20), lambda: word.title() + chars(digits, 1, 4) + chars(marks, 1, 1) + chars(low + digits, 0, 6), lambda: chars(low + high, 16, 40), lambda: chars(low + high + digits + "+/", 201, 1200))[form]()
            quote = pick(("", "", '"')) if form == 3 else ""
        elif form == 3:
            value, kind = chars(low + high + digits + "+/", 201, 1200), "entropy"
            before = prose(4) + pick((" data:image/png;base64,", " src=data:font/woff;base64,", " sha512-"))
        else:
            value = (lambda: pick((word, word.title(), prose(2).replace(" ", "_"), "true", "null", "None", "string", "required")), lambda: pick(("${" + word.upper() + "}", "os.environ[", "$" + word.upper(), "<your-" + word + ">", "process.env." + word.upper(), "self." + word, word + "()", "https://" + word + ".example.com/" + prose(1))), lambda: chars(digits, 1, 8))[form]()
        out.append((kind, value, (before + quote)[-CONTEXT:], (quote + after)[:CONTEXT], pick(("src/app", "config/prod", "web", "crawl", "notes")), secret))
    return out


def fit(vocabulary_path: str, findings: DataFrame | None = None, *, most: int = 50_000, trees: int = TREES, seed: int = 11) -> Forest:
    """Fits the forest on findings (kind, value, before, after, path, label), most of them at most; without them
    on labelled_findings()."""
    rows = [tuple(r) for r in findings.select("kind", "value", "before", "after", "path", "label").orderBy(F.xxhash64("value", "before", "after")).limit(most).collect()] if findings is not None else labelled_findings()
    words = vocabulary(vocabulary_path)
    x = np.array([describe(*(v or "" for v in r[:5]), words) for r in rows if r[1]], float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r[5] for r in rows if r[1]], float), trees, seed=seed)


def candidates(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, start, value) of what may be a secret."""
    found = []
    for m in CANDIDATE.finditer(text):
        start, value = m.start(), m.group()
        if m.lastgroup == "assigned":
            inner = re.search(r"[^\s\"']+", value)
            start, value = start + inner.start(), inner.group()
        found.append((m.lastgroup, start, value))
    assigned = list(_unquoted(text))
    if not assigned:
        yield from found
        return
    # A whole value goes before the runs in it; keys of known formats and quoted values stay.
    at, kept = 0, []
    for start, value in assigned:
        while at < len(found) and found[at][1] + len(found[at][2]) <= start:
            kept.append(found[at])
            at += 1
        inside = at
        while inside < len(found) and found[inside][1] < start + len(value):
            inside += 1
        if all(kind == "entropy" and start <= i and i + len(v) <= start + len(value) and v != value for kind, i, v in found[at:inside]):
            kept.append(("assigned", start, value))
            at = inside
    yield from kept + found[at:]


def _unquoted(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) of what risky words are assigned to without quotes."""
    at = 0
    while m := ASSIGN.search(text, at):
        at = m.end()
        if text[max(0, m.start() - 80) : m.start()].rstrip(" \t\"')]").lower().endswith(RISKY_WORDS) and (v := VALUE.match(text, at)):
            at = v.end()
            if value := v.group().rstrip(",;.)]}"):
                yield v.start(), value


def scan(docs: DataFrame, forest: Forest, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text", path: str = "source", least: float = 0.5, with_value: bool = False) -> DataFrame:
    """One row per candidate: doc_id, start (code points), length, kind, value_sha256, chance, secret (chance is least
    or more), and the value with with_value.

    Whole texts are searched. Null and empty texts have no candidates; null path is empty; repeated rows give
    their candidates each; null doc_id is kept; an empty table gives an empty result; other columns are ignored.
    No shuffle; the forest is bounded by its trees and depth and broadcast.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary_path)
        for batch in batches:
            rows, x = [], []
            for d, t, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")), strict=True):
                for kind, start, value in candidates(t or ""):
                    end = start + len(value)
                    rows.append((d, start, len(value), kind, hashlib.sha256(value.encode()).hexdigest(), value))
                    x.append(describe(kind, value, t[max(0, start - CONTEXT) : start], t[end : end + CONTEXT], p or "", words))
            if rows:
                chance = held.value.chance(np.array(x))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:5], pa.array(chance), pa.array(chance >= least), *columns[5 : 5 + with_value]], ["doc_id", "start", "length", "kind", "value_sha256", "chance", "secret", "value"][: 7 + with_value])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path"))
    return rows.mapInArrow(lean(run), "doc_id long, start long, length long, kind string, value_sha256 string, chance double, secret boolean" + ", value string" * with_value)


_WORDS: dict[str, frozenset[str]] = {}


def _vocabulary(path: str) -> frozenset[str]:
    if path not in _WORDS:
        _WORDS[path] = vocabulary(path)
    return _WORDS[path]


def findings_frame(spark: SparkSession, n: int = FINDINGS, seed: int = 5) -> DataFrame:
    return spark.createDataFrame(labelled_findings(n, seed), "kind string, value string, before string, after string, path string, label int")
