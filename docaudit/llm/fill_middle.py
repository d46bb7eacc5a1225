"""Fill-in-middle transformation with cuts found in an indexable skip list.

A text is a list of units (runs of ASCII letters, other characters one by one). Over the units lie
express lanes; each link of a lane skips the same number of links of the lane below and carries how many units
and how many code points it spans. A cut after ``rank`` units is found by walking each lane as far as
the accumulated unit widths allow, then descending; the accumulated code-point widths give its place in the
text. Documents are independent: nothing is shuffled.

Defined results: a null text counts as empty and is plain, as is an empty one; a null id is hashed
as the empty string; repeated rows each get the same row; an empty table gives no rows; extra columns are ignored;
very long texts take lanes of logarithmic number, and a few arrays of their own length in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Cuts:
    """Percentages of documents that are left plain and, of the others, of those with the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20


class SkipList:
    """Units in order; ``lanes[k]`` has a link for each ``fan``^k units, as (units, code points) it spans."""

    def __init__(self, widths: np.ndarray, fan: int = 16):
        self.fan, units = fan, np.ones(len(widths), np.int64)
        self.lanes = [(units, widths.astype(np.int64))]
        while len(self.lanes[-1][0]) > fan:
            starts = np.arange(0, len(self.lanes[-1][0]), fan)
            self.lanes.append(tuple(np.add.reduceat(x, starts) for x in self.lanes[-1]))

    def __len__(self) -> int:
        return len(self.lanes[0][0])

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank; of the whole list at its length."""
        if not 0 <= rank <= len(self):
            raise IndexError(rank)
        units = points = at = 0
        for k, (spans, wide) in enumerate(reversed(self.lanes)):
            at *= self.fan if k else 1
            while at < len(spans) and units + spans[at] <= rank:
                units, points, at = units + int(spans[at]), points + int(wide[at]), at + 1
        return points


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = c | 0x20
    letter = (low >= ord("a")) & (low <= ord("z"))
    first = np.ones(len(c), bool)
    first[1:] = ~(letter[1:] & letter[:-1])
    return np.diff(np.append(np.flatnonzero(first), len(c)))


def transform(text: str, h: tuple[int, int, int, int], cuts: Cuts) -> tuple:
    """n, form, code points of prefix and middle, output."""
    units = SkipList(unit_widths(text))
    n = len(units)
    if not text or h[2] % 100 >= 100 - cuts.plain or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted(units.seek(r % (n + 1)) for r in h[:2])
    prefix, middle, suffix = PREFIX + text[:a], text[a:b], SUFFIX + text[b:]
    if h[3] % 100 < cuts.spm:
        return n, "spm", a, b - a, suffix + prefix + MIDDLE + middle
    return n, "psm", a, b - a, prefix + suffix + MIDDLE + middle


SCHEMA = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: Cuts = Cuts()) -> DataFrame:
    """Per document: its id, n (units), form, prefix_chars, middle_chars, output."""
    digest = F.sha2(F.concat(F.lit(f"{cuts.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    # As unsigned integers of eight hex digits each.
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), *h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            hashes = zip(*(t[f"h{i}"].to_pylist() for i in range(4)), strict=True)
            got = [transform(x, h, cuts) for x, h in zip(texts(t), hashes, strict=True)]
            n, form, prefix, middle, output = zip(*got, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield from pa.table([t["doc_id"], *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]).to_batches()

    made = rows.mapInArrow(run, SCHEMA)
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. In an output that is not plain each marker stands once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = {
    "op12_fill_middle": """
with u as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
h as (
  select doc_id, t, units, len(units) as n,
    ('0x' || substr(d, 1, 8))::bigint % (len(units) + 1) as r1, ('0x' || substr(d, 9, 8))::bigint % (len(units) + 1) as r2,
    ('0x' || substr(d, 17, 8))::bigint % 100 as r3, ('0x' || substr(d, 25, 8))::bigint % 100 as r4 from u),
f as (
  select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r3 >= 90 then 'plain'
    when r4 < 20 then 'spm' else 'psm' end as form,
    array_to_string(units[1:least(r1, r2)], '') as p, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') as m,
    array_to_string(units[greatest(r1, r2) + 1:], '') as s from h)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from f
"""
}
QUERIES = {"op12_fill_middle": op12_fill_middle}
