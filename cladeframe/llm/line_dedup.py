"""Substring dedup by hashing the units of texts: whole lines, and the sentences inside them (operator 7)."""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm._common import Scratch, in_slices

#: Units of a line are the line itself and, as shared passages often stand inside a line, its sentences.
LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^\n.!?]+[.!?]*")
#: Shorter sentences inside lines are hashed together with the words before them, up to so many, so stock phrases don't count.
LEAST_WORDS = 8


def _digest(words: list[str]) -> tuple[int, int]:
    key = " ".join(words)
    return struct.unpack("<qq", hashlib.blake2b((key.rstrip(".!?") or key).encode("utf-8", "surrogatepass"), digest_size=16).digest())


def _bounds(m: re.Match) -> tuple[int, int]:
    return m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())


def line_units(text: str | None, least: int = LEAST_WORDS) -> list[list[tuple[int, int, tuple[int, int]]]]:
    """For each line that is not blank (start, end, digest) in code points of itself, whatever its length, then of what else is hashed inside it."""
    out, recent = [], []
    for line in LINE.finditer(text or ""):
        words = line[0].lower().split()
        if not words:
            continue
        here = [(*_bounds(line), _digest(words))]
        for m in SENTENCE.finditer(text, *line.span()):
            words = m[0].lower().split()
            if not words:
                continue
            if len(words) >= least:
                recent = key = words
            else:
                recent = key = (recent[-(least - 1) :] + words)[-max(least, len(words)) :]
            if len(key) >= least and (d := _digest(key)) != here[0][2]:
                here.append((*_bounds(m), d))
        out.append(here)
    return out


def units(text: str | None, least: int = LEAST_WORDS) -> list[tuple[int, int, tuple[int, int]]]:
    """The units of all lines in order: each line before the sentences inside it."""
    return [u for here in line_units(text, least) for u in here]


def _cut(least: int):
    def run(batches):
        for batch in batches:
            lines = [line_units(t.as_py(), least) for t in batch.column(1)]
            each = [[u for here in ls for u in here] for ls in lines]
            arrays = [pa.array([[pick(u) for u in us] for us in each], pa.list_(kind)) for pick, kind in ((lambda u: u[0], pa.int32()), (lambda u: u[1], pa.int32()), (lambda u: u[2][0], pa.int64()), (lambda u: u[2][1], pa.int64()))]
            inner = pa.array([[n for here in ls for n in (len(here) - 1, *[0] * (len(here) - 1))] for ls in lines], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, inner], names=["doc_id", "starts", "ends", "h1", "h2", "inner"])

    return run


def repeated_units(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document the units that stand earlier in the corpus: doc_id, n_units, n_removed, removed.

    Needs doc_id and text; other columns are ignored. Units are all whole lines, of any length, and the sentences
    inside them, lower-cased with single spaces. A paragraph needs no unit: where it repeats, each of its lines does.
    Of the units of equal 128-bit digest the one of the smallest (doc_id, position) stays, the rest are removed;
    removed has their start:end in code points of the original text, in order, comma-joined, without the sentences of
    lines that are removed. One pass cuts the whole texts; digests are grouped with map-side partial minima, and the
    units join the repeated digests, a join of two plain scans in which Spark splits the partition of a hot digest. A
    null or blank text has no units. Rows that share a doc_id rank equal, so both keep a first occurrence; a null
    doc_id ranks last.
    """
    scratch = Scratch(documents.sparkSession, "units")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = docs.mapInArrow(in_slices(_cut(least_words)), "doc_id long, starts array<int>, ends array<int>, h1 array<long>, h2 array<long>, inner array<int>")
    cut = scratch.write(cut.withColumn("row", F.monotonically_increasing_id()), "cut")
    rank = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.col("at"))
    flat = cut.select("row", "doc_id", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).select("row", rank.alias("rank"), F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    twice = flat.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "first")
    twice = scratch.write(twice, "twice")
    late = flat.join(twice, ["h1", "h2"]).where("rank > first").groupBy("row").agg(F.sort_array(F.collect_list("rank.at")).alias("late"))
    late = scratch.write(late, "late")
    scratch.drop("twice")
    span = lambda k: F.concat_ws(":", F.get("starts", k).cast("string"), F.get("ends", k).cast("string"))
    covered = F.flatten(F.transform("late", lambda k: F.when(F.get("inner", k) > 0, F.sequence(k + 1, k + F.get("inner", k))).otherwise(F.array().cast("array<int>"))))
    out = cut.select("row", "doc_id", "starts", "ends", "inner").join(late, "row", "left").withColumn("late", F.array_except("late", covered))
    return out.select("doc_id", F.size("starts").cast("long").alias("n_units"), F.coalesce(F.size("late"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform("late", span), ","), F.lit("")).alias("removed"))


def without(text: str | None, removed: str) -> str | None:
    """The text without the removed spans; what separates units stays."""
    if not text or not removed:
        return text
    out, at = [], 0
    for span in removed.split(","):
        start, end = map(int, span.split(":"))
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])
