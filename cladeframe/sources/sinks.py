"""Writers: ordered text files, FASTA, FASTQ, and tab-separated tables."""

from __future__ import annotations

import contextlib
import os
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.names import template_sequence
from cladeframe.operators.report import plain_number
from cladeframe.sources.bgzf import EOF, blocks
from cladeframe.sources.text import is_pseudo_path


#: Bytes that an executor packs before it hands them on.
PACK = 1 << 22


@contextlib.contextmanager
def target(path: str):
    """A binary stream to a path: standard output for -, a device as it is, else a file that appears when whole."""
    if path in ("-", "/dev/stdout"):
        yield sys.stdout.buffer
        sys.stdout.buffer.flush()
    elif is_pseudo_path(path):
        with open(path, "wb") as f:
            yield f
    else:
        part = f"{path}.part"
        try:
            with open(part, "wb") as f:
                yield f
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)


def packed(rows: DataFrame, encode, level: int | None) -> DataFrame:
    """data: the rows (ord and more) in the order of ord as bytes, encoded and, with a level, compressed by the executors.

    encode(batch) gives the bytes of each row of an Arrow batch. Each piece of data has whole BGZF blocks, so pieces
    make one stream in the order of the partitions.
    """

    def run(batches):
        pending, size = [], 0

        def piece():
            data = b"".join(pending)
            return pa.RecordBatch.from_arrays([pa.array([data if level is None else b"".join(blocks(data, level))], pa.binary())], names=["data"])

        for batch in batches:
            for one in encode(batch):
                pending.append(one)
                size += len(one)
                if size >= PACK:
                    yield piece()
                    pending, size = [], 0
        if pending:
            yield piece()

    return rows.repartitionByRange("ord").sortWithinPartitions("ord").mapInArrow(run, "data binary")


def write_packed(rows: DataFrame, path: str, encode, level: int | None, head: bytes = b"", tail: bytes = b"") -> None:
    """One local file or standard output: what reaches the driver are pieces that are ready to be written."""
    with target(path) as f:
        f.write(head)
        for r in packed(rows, encode, level).toLocalIterator():
            f.write(r.data)
        f.write(tail)


def _line_bytes(batch):
    for x in batch.column(0).to_pylist():
        yield f"{x}\n".encode()


def write_lines(rows: DataFrame, path: str, head: list[str] = (), column: str = "value", level: int = 5) -> None:
    """The lines in the order of ord, as BGZF if the name ends in .gz, else plain. A path that ends in / is a folder that the executors write."""
    if path.endswith("/"):
        write_folder(rows, path, column, "gzip" if level else "none")
        return
    zipped = level if path.lower().endswith(".gz") else None
    first = "".join(f"{h}\n" for h in head).encode()
    lines = rows.select("ord", F.col(column).alias("value"))
    write_packed(lines, path, lambda batch: _line_bytes(batch.select(["value"])), zipped, first if zipped is None else b"".join(blocks(first, level)), b"" if zipped is None else EOF)


def write_folder(rows: DataFrame, path: str, column: str = "value", compression: str = "none") -> None:
    """The lines as a folder of parts in order, written by the executors: the form for a cluster."""
    rows.repartitionByRange("ord").sortWithinPartitions("ord").select(column).write.option("compression", compression).text(path)


def fasta_lines(templates: DataFrame) -> DataFrame:
    """ord, value: >name, then R1 or R1 N R2 in upper case on one line."""
    return templates.select("ord", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), template_sequence(F.col("r1"), F.col("r2"))).alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", "name", "description")
    return reads.select("ord", F.concat(F.lit("@"), name, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value"))


def fasta_read_lines(reads: DataFrame) -> DataFrame:
    return reads.select("ord", F.concat(F.lit(">"), F.concat_ws(" ", "name", "description"), F.lit("\n"), F.col("seq")).alias("value"))


def _cell(name: str, kind: str) -> Column:
    text = plain_number(F.col(name)) if kind == "double" else F.col(name).cast("string")
    text = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[\t"\r\n]'), quoted).otherwise(text)


def table_lines(rows: DataFrame) -> tuple[str, DataFrame]:
    """Header line, and ord, value of a tab-separated table; nulls are empty, cells are quoted only where they must be."""
    names = [(n, k) for n, k in rows.dtypes if n != "ord"]
    return "\t".join(n for n, _ in names), rows.select("ord", F.concat_ws("\t", *(_cell(n, k) for n, k in names)).alias("value"))
