"""Secret scanning with formats inferred from labelled credentials.

Base rules find assignments, access keys and hex strings. From a sample of the
credentials they mark, a probabilistic automaton is inferred for each kind: the prefix tree of their
character classes, whose states are merged while their continuation frequencies are
compatible under Hoeffding's bound. One more automaton is inferred from other strings of
the same alphabet, some of each frequent shape (words, numbers, dotted numbers) that is not a shape of credentials mostly. Every other candidate string is scored by the likelihood ratio of the kind that suits it best,
times the ratio of that kind's spans to other candidates in the whole corpus: what is more likely a credential
than not is reported as ``format``.
Texts are scanned twice, for the samples and for the scores, so that candidates need not be kept.

Defined results: a null text counts as empty and has no spans; without labelled credentials,
or without other strings of a frequent shape to tell them from, no format is learned and only base spans are returned; an empty table gives no rows; repeated
rows each get their row. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, cut, table, texts

KINDS = ("assign", "access", "hex", "format")
#: re.A keeps "either case" to ASCII letters.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class Formats:
    """Candidates are runs of [A-Za-z0-9+/_.=-] of this length, as in assignments.

    The samples are bounded: ``max_sample`` strings of each kind, and of the others ``per_shape`` strings for
    each of at most ``max_shapes`` shapes that ``min_shape`` different strings have.

    Of longer strings than ``max_chars`` the automata learn the beginning, and nothing about their end.
    """

    min_length: int = 6
    max_sample: int = 2000
    max_shapes: int = 64
    per_shape: int = 100
    min_shape: int = 10
    max_chars: int = 128
    alpha: float = 0.05
    odds: float = 1.0  # least odds of being a credential


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out


def class_table() -> np.ndarray:
    """Bit 1: candidate character, bit 4: lower-case hex digit; code points from 128 on share the last entry."""
    t = np.zeros(129, np.uint8)
    for c in range(128):
        ch = chr(c)
        t[c] = (ch.isalnum() or ch in "+/_.=-") + 4 * (ch in "0123456789abcdef")
    return t


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def scan(text: str, kinds: np.ndarray, least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans, and candidates outside them."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    k = kinds[np.minimum(c, 128)]
    found = base_spans(text)
    found += [(int(a), 2, int(b)) for a, b in zip(*runs((k & 4) > 0, 24), strict=True)]
    found.sort()
    start, end = runs((k & 1) > 0, least)
    if found:
        # Spans that begin before a candidate's end, less those that end before it begins.
        begun, ended = np.array([s for s, _, _ in found]), np.sort([e for _, _, e in found])
        free = np.searchsorted(begun, end, "left") == np.searchsorted(ended, start, "right")
        start, end = start[free], end[free]
    return found, list(zip(start.tolist(), end.tolist(), strict=True))


CLASSES = str.maketrans({c: "a" if c in "abcdef" else "g" if c.islower() else "A" if c.isupper() else "0" for c in map(chr, range(128)) if c.isalnum()})


def symbols(s: str) -> str:
    """Character classes: a hex letters, g other lower case, A upper case, 0 digits, other characters as they are."""
    return s.translate(CLASSES)


SHAPES = str.maketrans({c: "l" if c.islower() else "A" if c.isupper() else "0" for c in map(chr, range(128)) if c.isalnum()})
AGAIN = re.compile(r"(.)\1+")


def shape(s: str) -> str:
    """Runs of lower case, upper case and digits as one character each, other characters as they are."""
    return AGAIN.sub(r"\1", s.translate(SHAPES))


#: Log of the number of characters in a class.
CLASS_SIZE = {"a": math.log(6), "g": math.log(20), "A": math.log(26), "0": math.log(10)}
#: Log-probability of a step where the automaton has no state left.
LOST = math.log(1e-4)


class Automaton:
    """A deterministic probabilistic automaton, inferred by state merging.

    Red states are settled, blue ones are their children: each blue state is merged with the
    first compatible red one or becomes red itself. Two states are compatible when the
    frequencies of ending and of each next symbol, theirs and their children's, differ by less than
    Hoeffding's bound at ``alpha``.
    """

    def __init__(self, words: list[str], alpha: float, most: int | None = None):
        """Of words longer than ``most`` that many symbols count, and no ending."""
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]  # "" counts endings
        for w in words:
            at = 0
            for s in w[:most]:
                self.count[at][s] = self.count[at].get(s, 0) + 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][s]
            if most is None or len(w) <= most:
                self.count[at][""] = self.count[at].get("", 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.infer()

    def differ(self, n: int, a: int, m: int, b: int) -> bool:
        return abs(a / n - b / m) >= self.bound * (n**-0.5 + m**-0.5)

    def compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            a, b = self.count[p], self.count[q]
            n, m = sum(a.values()), sum(b.values())
            if n == 0 or m == 0:
                continue
            if any(self.differ(n, a.get(s, 0), m, b.get(s, 0)) for s in a.keys() | b.keys()):
                return False
            todo += [(self.next[p][s], self.next[q][s]) for s in self.next[p].keys() & self.next[q].keys() if self.next[p][s] != self.next[q][s]]
        return True

    def fold(self, red: int, blue: int, settled: set[int]) -> list[tuple[int, str]]:
        """Add the tree under ``blue`` to ``red``. Loops lead it through other red states too; returned is what any of them got as a new child."""
        todo, new = [(red, blue)], []
        while todo:
            p, q = todo.pop()
            for s, n in self.count[q].items():
                self.count[p][s] = self.count[p].get(s, 0) + n
            for s, child in self.next[q].items():
                if s in self.next[p]:
                    todo.append((self.next[p][s], child))
                else:
                    self.next[p][s] = child
                    if p in settled:
                        new.append((p, s))
        return new

    def infer(self) -> None:
        red, queue = [0], [(0, s) for s in sorted(self.next[0])]
        settled = {0}
        while queue:
            p, s = queue.pop(0)
            blue = self.next[p][s]
            if blue in settled:
                continue
            for r in red:
                if self.compatible(r, blue):
                    self.next[p][s] = r
                    queue += sorted(self.fold(r, blue, settled))
                    break
            else:
                red.append(blue)
                settled.add(blue)
                queue += [(blue, x) for x in sorted(self.next[blue])]
        number = {q: i for i, q in enumerate(red)}
        self.states = [({s: n for s, n in self.count[q].items()}, {s: number[t] for s, t in self.next[q].items()}, sum(self.count[q].values())) for q in red]
        del self.next, self.count
        self.tables = [
            ({x: (math.log((n + 0.01) / (total + 0.4)) - CLASS_SIZE.get(x, 0.0), follow.get(x, -1)) for x, n in count.items()}, math.log(0.01 / (total + 0.4)))
            for count, follow, total in self.states
        ]

    def score(self, word: str) -> float:
        """Log-likelihood of a string of classes, each class spread evenly over its characters."""
        return likelihood(self.tables, word)


def likelihood(tables: list, word: str) -> float:
    at, total = 0, 0.0
    for s in word:
        if at < 0:
            total += LOST - CLASS_SIZE.get(s, 0.0)
            continue
        steps, missed = tables[at]
        found = steps.get(s)
        if found is None:
            total, at = total + missed - CLASS_SIZE.get(s, 0.0), -1
        else:
            total, at = total + found[0], found[1]
    if at < 0:
        return total + LOST
    steps, missed = tables[at]
    return total + (steps[""][0] if "" in steps else missed)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hashed(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def samples(docs: DataFrame, formats: Formats) -> tuple[list[list[str]], list[int]]:
    """Per base kind and last for other candidates: a bounded sample of different strings, those of least hash, and the number of all.

    Each string is cut after max_chars + 1 characters. Each partition hands on its own least ones, among which are the least of all.
    """
    other = len(KINDS) - 1

    def least(strings: set[str], most: int) -> set[str]:
        return strings if len(strings) <= most else set(heapq.nsmallest(most, strings, key=lambda s: (hashed(s), s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, cut_at = class_table(), formats.max_chars + 1
        kept: dict[tuple[int, str], set[str]] = {}
        many: dict[tuple[int, str], int] = {}
        for t in chunks(batches):
            for text in texts(t):
                base, rest = scan(text, kinds, formats.min_length)
                found = [(k, (text[a:b] if k else ASSIGN.match(text, a)[2])[:cut_at]) for a, k, b in base]
                found += [(other, text[a : min(b, a + cut_at)]) for a, b in rest]
                for k, s in found:
                    key = (k, shape(s))
                    kept.setdefault(key, set()).add(s)
                    many[key] = many.get(key, 0) + 1
            kept = {key: least(v, formats.per_shape if key[0] == other else formats.max_sample) for key, v in kept.items()}
        rows = [(k, form, s, hashed(s), many[k, form] if i == 0 else 0) for (k, form), v in kept.items() for i, s in enumerate(v)]
        for i in range(0, len(rows), 10_000):
            columns = zip(*rows[i : i + 10_000], strict=True)
            kinds_of = (pa.int32(), pa.string(), pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds_of, strict=True)], ["kind", "form", "s", "h", "n"])

    found = cut(docs.mapInArrow(run, "kind int, form string, s string, h binary, n long"))
    many = {r.kind: r.n for r in found.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    strings = [[r.s for r in found.filter(F.col("kind") == k).select("h", "s").distinct().orderBy("h", "s").limit(formats.max_sample).collect()] for k in range(other)]
    # Shapes that many other candidates have, and more of them than credentials.
    per_form = found.groupBy("form").agg(
        F.sum(F.when(F.col("kind") == other, F.col("n"))).alias("others"), F.sum(F.when(F.col("kind") < other, F.col("n")).otherwise(0)).alias("own"),
        F.countDistinct(F.when(F.col("kind") == other, F.col("h"))).alias("different"),
    ).filter(f"different >= {formats.min_shape} and others > own")
    forms = per_form.orderBy(F.desc("others"), "form").limit(formats.max_shapes).select("form")
    rows = found.filter(F.col("kind") == other).join(F.broadcast(forms), "form").select("form", "h", "s").distinct()
    for part in (["form", F.crc32("h") % 64], ["form"]):  # in two steps, so that no task gets all strings of a shape
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*part).orderBy("h", "s"))).filter(F.col("at") <= formats.per_shape)
    strings.append([r.s for r in rows.collect()])
    return strings, [many.get(k, 0) for k in range(other + 1)]


def learn(docs: DataFrame, formats: Formats) -> tuple[list, list] | None:
    """(bias, tables) of the automaton of each kind, and the tables of other candidates, as plain values: only those
    are broadcast, as executors may not have this package. None without credentials or without other strings of a frequent shape.

    The bias is the log of the kind's spans by other candidates, and of the least odds.
    """
    strings, many = samples(docs, formats)
    if not any(strings[:-1]) or not strings[-1]:
        return None
    made = [Automaton(sorted(map(symbols, s)), formats.alpha, formats.max_chars).tables for s in strings]  # a bounded number of bounded strings
    bias = [math.log(max(1, n) / max(1, many[-1])) - math.log(formats.odds) for n in many[:-1]]
    return [(b, t) for b, t, s in zip(bias, made, strings, strict=False) if s], made[-1]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", formats: Formats = Formats()) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format."""
    docs = rows_of(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, formats))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_format", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, known = class_table(), {}

        def secret(s: str) -> bool:
            """Scores of short strings are remembered, as words come again and again."""
            if s in known:
                return known[s]
            x = symbols(s)
            own, other = model.value
            hit = max(bias + likelihood(tables, x) for bias, tables in own) > likelihood(other, x)
            if len(s) <= 32:
                if len(known) >= 200_000:
                    known.clear()
                known[s] = hit
            return hit

        for t in chunks(batches):
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(t["doc_id"].to_pylist(), texts(t), strict=True):
                base, rest = scan(text, kinds, formats.min_length)
                more = [(a, 3, b) for a, b in rest if secret(text[a:b])] if model.value else []
                row = [doc_id, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op5_secret_scan": op5_secret_scan}
