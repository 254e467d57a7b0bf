"""Readers of single records by name, as a table function of SQL: one stored record makes any number of rows of signals.

A configuration table tells each source's kind and options; ``SELECT ... FROM records, LATERAL read_record(kind, content, options)``
reads sources of several formats in one query. A kind is a function from a record's bytes and its options to signals.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

Reader = Callable[[bytes, dict], Iterator[list]]
KINDS: dict[str, Reader] = {}


def reader(kind: str):
    """Registers a reader; a kind has one."""

    def register(f: Reader) -> Reader:
        if kind in KINDS:
            raise ValueError(f"kind {kind} has a reader")
        KINDS[kind] = f
        return f

    return register


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


@reader("bracketed")
def bracketed(content: bytes, options: dict) -> Iterator[list]:
    """The vectors between the first bracket and the last of each line behind the header; other lines are skipped."""
    for line in content.decode("utf-8", "replace").split("\n")[options.get("header", 0) :]:
        found = re.search(r"\[(.*)\]", line)
        if found:
            yield [number(v) for v in found.group(1).split(",")]


@reader("bytes")
def byte_records(content: bytes, options: dict) -> Iterator[list]:
    """Fixed-size records without their header bytes; a size that doesn't divide is an error."""
    size = options["record_bytes"]
    if len(content) % size:
        raise ValueError(f"the record's size isn't a multiple of {size}")
    for i in range(0, len(content), size):
        yield [float(x) for x in content[i + options.get("header", 0) : i + size]]


@reader("columns")
def columns(content: bytes, options: dict) -> Iterator[list]:
    """Every column of a delimited text is a trace; columns without a value go."""
    rows = list(csv.reader(content.decode("utf-8", "replace").split("\n"), delimiter=options.get("delimiter", ",")))
    for values in zip(*(r for r in rows if r)):
        trace = [number(v) for v in values]
        if any(v is not None for v in trace):
            yield trace


@F.udtf(returnType="row int, signal array<double>")
class ReadRecord:
    def eval(self, kind: str, content: bytes, options: str):
        if kind not in KINDS:
            raise ValueError(f"no reader for kind {kind}; there are {sorted(KINDS)}")
        if content is not None:
            for i, signal in enumerate(KINDS[kind](bytes(content), json.loads(options or "{}"))):
                yield i, signal


def register(spark: SparkSession) -> None:
    """Makes ``read_record`` known to the session's SQL."""
    spark.udtf.register("read_record", ReadRecord)
