"""Records that may hold line ends, from text files that many tasks read.

A lexer is a small automaton over lines: it tells the state at a line's end from the state at its start, and a line that
starts in state 0 begins a record. What one task reads of a file, a piece, then maps every state at its start to one at
its end. The maps of a file's pieces are composed in order, which gives the state at the start of every piece for certain:
nothing about the text is guessed, and no file is too large or too small for it. With these states, pieces are taken apart
into records. Only records that reach over the end of a piece are shuffled, to be put together.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.sources.files import BROADCAST_BYTES, ensure_checkpoint_folder

# Workers need no copy of this package on their path: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORD = "file string, block bigint, number bigint, value string"
FRAGMENT = "file string, origin bigint, block bigint, number bigint, value string"
#: Records are handed on in batches of this many rows or characters.
BATCH_ROWS, BATCH_CHARS = 5_000, 1 << 22


@dataclass(frozen=True)
class Lexer:
    """``line(text, state)`` is the state at the end of a line; 0 is the state at the start of a file and of a record.

    ``easy(text)`` gives these states for all states at the start, where the text shows them at a glance.
    """

    states: int
    line: Callable[[str, int], int]
    easy: Callable[[str], Sequence[int] | None] = lambda text: None


def csv_lexer(separator: str = ",") -> Lexer:
    """State 1 is inside a quoted field. A quote only opens a field at its start, and a doubled one is text."""
    other, sep = rf"[^{re.escape(separator)}]", re.escape(separator)
    quoted = rf'(?:[^"]|"")*+"(?!"){other}*+'
    close = re.compile(rf"{quoted}(?:{sep}|\Z)", re.S)
    fields = re.compile(rf'(?:(?:"{quoted}|(?!"){other}*+)(?:{sep}|\Z))*', re.S)

    def line(text: str, state: int) -> int:
        if '"' not in text:
            return state
        position = 0
        if state:
            match = close.match(text)
            if not match:
                return 1
            position = match.end()
            if position == len(text) and not text.endswith(separator):
                return 0
        return int(fields.match(text, position).end() != len(text))

    return Lexer(2, line, lambda text: None if '"' in text else (0, 1))


def turtle_lexer(graphs: bool = True) -> Lexer:
    """States: 0 between statements, 1 inside one, 2 and 3 inside a long string; 4 to 6 as 1 to 3 in the braces of a graph."""
    token = re.compile(
        r"""[^\S\n]+|\#.*|<[^<>"{}|^`\s]*>|(?P<long>\"{3}|'{3})|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|(?P<mark>[{}.])"""
        r"""|(?:\\.|[^\s<>"'\#{}.\\])(?:\.*(?:\\.|[^\s<>"'\#{}().\[\];,\\]))*|(?P<other>.)""",
        re.X | re.S,
    )
    ends = {2: re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"{3,5}', re.S), 3: re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'{3,5}", re.S)}

    hard = re.compile(r"""[{}#]|\"{3}|'{3}""")
    inside, between, blank = (1, 1, 2, 3, 4, 5, 6), (0, 0, 2, 3, 4, 5, 6), (0, 1, 2, 3, 4, 5, 6)

    def easy(text: str) -> Sequence[int] | None:
        if hard.search(text):
            return None
        bare = text.rstrip()  # only a full stop at the end, which is no escaped one, ends a statement
        return blank if not bare else between if bare.endswith(".") and not bare.endswith("\\.") else inside

    def line(text: str, state: int) -> int:
        position, braces, size = 0, state >= 4, len(text)
        state -= 3 * braces
        while True:
            if state >= 2:
                match = ends[state].match(text, position)
                if not match:
                    return state + 3 * braces
                state, position = 1, match.end()
            if position >= size:
                return state + 3 * braces
            match = token.match(text, position)
            position = match.end()
            kind = match.lastgroup
            if kind == "long":
                state = 2 if match.group() == '"""' else 3
            elif kind == "mark":
                mark = match.group()
                braces = mark == "{" or braces and mark != "}"
                state = int(braces or mark == "{")
            elif kind or not (match.group()[0] == "#" or match.group().isspace()):
                state = 1

    return Lexer(7 if graphs else 4, line, easy)


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines in the order of each piece: value, file, block (where the piece starts), at (their order)."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, first, end) of the rows of each piece in a batch."""
    if not batch.num_rows:
        return
    file, block = batch.column(1), batch.column(2).to_numpy()
    fresh = pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(file)]
    for first, end in zip(cuts, cuts[1:]):
        yield file[first].as_py(), int(block[first]), first, end


def _maps(lexer: Lexer):
    """For every piece: by the state at its start, the state at its end and whether a record begins in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, begins = None, [], []

        def found() -> pa.RecordBatch:
            columns = [[key[0]], [key[1]], [now], [begins]]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(*x) for x in zip(columns, kinds)], ["file", "block", "ends", "begins"])

        for batch in batches:
            for file, block, first, end in _runs(batch):
                if key != (file, block):
                    if key is not None:
                        yield found()
                    key, now, begins = (file, block), list(range(lexer.states)), [False] * lexer.states
                texts = batch.column(0).slice(first, end - first).to_pylist()
                for at in range(0, len(texts), 64):  # states soon become equal and stay so
                    different, place = _different(now)
                    started = [False] * len(different)
                    for text in texts[at : at + 64]:
                        known = lexer.easy(text)
                        for i, state in enumerate(different):
                            started[i] |= state == 0
                            different[i] = known[state] if known else lexer.line(text, state)
                    begins = [b or started[i] for b, i in zip(begins, place)]
                    now = [different[i] for i in place]
        if key is not None:
            yield found()

    return run


def _different(now: list[int]) -> tuple[list[int], list[int]]:
    """The different states of a list, and each one's place among them."""
    different = sorted(set(now))
    return different, [different.index(state) for state in now]


def _composed(frame: pd.DataFrame) -> pd.DataFrame:
    """A file's pieces in order: the state at start and end of each, and the piece in which an open record began."""
    rows, state, origin = [], 0, -1
    for row in frame.sort_values("block").itertuples():
        end = int(row.ends[state])
        rows.append((row.file, row.block, state, end, origin))
        if row.begins[state]:
            origin = row.block
        state = end
    return pd.DataFrame(rows, columns=["file", "block", "state", "end", "origin"])


def pieces(spark: SparkSession, paths: Sequence[str], lexer: Lexer) -> DataFrame:
    """(file, block, state, end, origin) of all pieces, checkpointed: a few numbers for each of the tasks that read."""
    ensure_checkpoint_folder(spark)
    maps = _lines(spark, paths).select("value", "file", "block").mapInArrow(
        _maps(lexer), "file string, block bigint, ends array<int>, begins array<boolean>"
    )
    composed = maps.groupBy("file").applyInPandas(_composed, "file string, block bigint, state int, end int, origin bigint")
    return composed.checkpoint()


def _taken_apart(lexer: Lexer, whole: bool, chunk: int):
    """Whole records of pieces, ``chunk`` characters of them in a row at least; or the fragments of records that are not whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, state, origin, number, lines, size, starts = None, 0, -1, 0, [], 0, False

        def closed(complete: bool) -> None:
            if not lines:
                return
            if whole and starts and complete:
                rows.append((*key, number, "\n".join(lines)))
            elif not whole and not (starts and complete):
                rows.append((key[0], key[1] if starts else origin, key[1], number if starts else None, "\n".join(lines)))

        def batch_of() -> pa.RecordBatch:
            schema = RECORD if whole else FRAGMENT
            fields = [x.split() for x in schema.split(", ")]
            kinds = {"string": pa.string(), "bigint": pa.int64()}
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields]
            )

        waiting = 0
        for batch in batches:
            for file, block, first, end in _runs(batch):
                if key != (file, block):
                    closed(state == 0)
                    key, state, origin = (file, block), batch.column(3)[first].as_py(), batch.column(4)[first].as_py()
                    number, lines, size, starts = 0, [], 0, False
                for text in batch.column(0).slice(first, end - first).to_pylist():
                    if state == 0 and (size >= chunk or not starts):
                        closed(True)
                        number, lines, size, starts = number + starts, [], 0, True
                    lines.append(text)
                    size += len(text) + 1
                    waiting += len(text)
                    known = lexer.easy(text)
                    state = known[state] if known else lexer.line(text, state)
                    if rows and (len(rows) >= BATCH_ROWS or waiting >= BATCH_CHARS):
                        yield batch_of()
                        rows, waiting = [], 0
        closed(state == 0)
        if rows:
            yield batch_of()

    return run


def _with_states(spark: SparkSession, paths: Sequence[str], states: DataFrame, small: bool) -> DataFrame:
    """Lines with the state at the start of their piece, in the order of the piece."""
    columns = ["value", "file", "block", "state", "origin"]
    if small:  # a joined line stays in its place then
        return _lines(spark, paths).join(F.broadcast(states), ["file", "block"]).select(*columns)
    joined = _lines(spark, paths).join(states, ["file", "block"]).repartition("file", "block")
    return joined.sortWithinPartitions("file", "block", "at").select(*columns)


def read_records(spark: SparkSession, paths: Sequence[str], lexer: Lexer, chunk: int = 0) -> DataFrame:
    """(file, block, number, value): the records of text files; those of a piece are numbered from 0.

    ``chunk`` > 0 leaves consecutive records together until they have that many characters.
    """
    states = pieces(spark, paths, lexer)
    known = states.select("file", "block", "state", "origin")
    is_open = "state <> 0 OR end <> 0"
    size, count = states.agg(F.sum(F.length("file") + 40), F.count_if(F.expr(is_open))).first()
    small = (size or 0) <= BROADCAST_BYTES
    whole = _with_states(spark, paths, known, small).mapInArrow(_taken_apart(lexer, True, chunk), RECORD)
    if not count:
        return whole
    open_ones = states.filter(is_open).select("file", "block", "state", "origin")
    fragments = _with_states(spark, paths, open_ones, small).mapInArrow(_taken_apart(lexer, False, chunk), FRAGMENT)
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = fragments.groupBy("file", "origin").agg(
        F.min("number").alias("number"), F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value")
    )
    return whole.unionByName(joined.withColumnRenamed("origin", "block"))
