"""Rows of the INSERT statements of SQL dumps, read as a stream with state.

A dump is text whose statements may hold line ends and semicolons inside literals, stand several to a line,
and be longer than any block. Spark reads the lines, whatever splits a file comes in, and brings a file's lines
together in order; a scanner then goes over them piece by piece and keeps its state from one piece to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}
SCHEMA = "id long, word string, meaning string, file string, pos long"
#: Characters of a piece; a batch of Arrow rows then stays at some 40 MB, however long a file's lines are.
PIECE = 4096


class DumpScanner:
    """Scans the text of one dump, given in pieces, for the value tuples of INSERT statements into a table.

    Strings take backslash escapes, and a doubled quote inside one is no quote but joins two strings. Comments
    (`-- `, `#`, `/* */`) count between statements and between tuples. Blanks around a field go, also
    those inside its quotes.
    """

    OUTSIDE, SKIPPED, VALUES, TUPLE = range(4)
    PLAIN = {
        OUTSIDE: re.compile(r"[^'\"`#/;(\-]+"),
        SKIPPED: re.compile(r"[^'\"`#/;\-]+"),
        VALUES: re.compile(r"[^'\"#/;(\-]+"),
        TUPLE: re.compile(r"[^'\",)]+"),
    }
    QUOTED = {q: re.compile(rf"[^{q}\\]+") for q in "'\"`"}

    def __init__(self, table: str | None = None) -> None:
        name = re.escape(table) if table else r"[^\s`\"(]+"
        self.head_form = re.compile(rf"\s*insert\s+(?:ignore\s+)?into\s+[`\"]?{name}[`\"]?\s*(?:\([^)]*\))?\s*values\s*", re.IGNORECASE)
        self.mode, self.quote, self.comment, self.rest = self.OUTSIDE, "", "", ""
        self.head: list[str] = []
        self.fields: list[str] = []
        self.part: list[str] = []

    def feed(self, piece: str, last: bool = False) -> Iterator[list[str]]:
        """Tuples that end in this piece. `last` says that no piece follows."""
        text, at = self.rest + piece, 0
        while at < len(text):
            if self.comment:
                end = text.find(self.comment, at)
                if end < 0:
                    at = len(text) if last else max(at, len(text) - 1)
                    break
                at, self.comment = end + len(self.comment), ""
            elif self.quote:
                run = self.QUOTED[self.quote].match(text, at)
                if run:
                    self._put(run[0])
                    at = run.end()
                elif text[at] == "\\":
                    if at + 1 == len(text) and not last:
                        break
                    mark = text[at + 1 : at + 2]
                    self._put(ESCAPES.get(mark, mark))
                    at += 2
                else:
                    self._put("" if self.quote == "'" else self.quote)
                    self.quote, at = "", at + 1
            else:
                run = self.PLAIN[self.mode].match(text, at)
                if run:
                    self._put(run[0])
                    at = run.end()
                    continue
                mark = text[at]
                if mark in "-/" and self.mode != self.TUPLE and len(text) - at < 3 and not last:
                    break  # a comment may begin here
                if mark in "'\"`":
                    self.quote = mark
                    self._put("" if mark == "'" else mark)
                elif self.mode == self.TUPLE:
                    self.fields.append("".join(self.part).strip())
                    self.part = []
                    if mark == ")":
                        yield self.fields
                        self.fields, self.mode = [], self.VALUES
                elif mark == "#" or re.match(r"--\s", text[at : at + 3]):
                    self.comment = "\n"
                elif text.startswith("/*", at):
                    self.comment, at = "*/", at + 1
                elif mark == ";":
                    self.mode, self.head = self.OUTSIDE, []
                elif mark == "(" and (self.mode == self.VALUES or self.head_form.fullmatch("".join(self.head))):
                    self.mode = self.TUPLE
                else:
                    self._put(mark)
                at += 1
        self.rest = text[at:]

    def _put(self, text: str) -> None:
        if self.mode == self.TUPLE:
            self.part.append(text)
        elif self.mode == self.OUTSIDE:
            self.head.append(text)
            start = "".join(self.head[:3]).lstrip()[:6].lower()
            if start and not "insert".startswith(start):
                self.mode = self.SKIPPED  # another statement: nothing of it is kept


def _rows(table: str | None):
    def scan(batches):
        import pandas as pd

        file, scanner, pos = None, None, 0
        for pdf in batches:
            rows = []

            def keep(found, rows=rows):
                nonlocal pos
                for fields in found:
                    if len(fields) >= 3:
                        digits = "".join(c for c in fields[0] if c in "0123456789")
                        rows.append((int(digits or 0), fields[1], fields[2], file, pos))
                        pos += 1

            for name, piece in zip(pdf["file"], pdf["piece"], strict=True):
                if name != file:
                    if scanner:
                        keep(scanner.feed("", last=True))
                    file, scanner, pos = name, DumpScanner(table), 0
                keep(scanner.feed(piece))
            yield pd.DataFrame(rows, columns=["id", "word", "meaning", "file", "pos"])

    return scan


def read_sql_dump(spark: SparkSession, glob: str, table: str | None = None) -> DataFrame:
    """(id, word, meaning, file, pos) of the value tuples of three fields or more of dumps, gzipped or plain.

    id is made of the first field's digits (none: 0), pos numbers a file's rows. `table` limits the INSERT
    statements to one table. A file is scanned by one task in bounded memory, as a gzip stream has to be; files
    are dealt over the tasks. Text after the last complete tuple of a torn file is left out.
    """
    lines = spark.read.option("lineSep", "\n").text(glob).select(
        F.concat("value", F.lit("\n")).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    cut = F.regexp_extract_all("value", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    pieces = lines.select("file", "block", "line", F.posexplode(cut).alias("n", "piece"))
    ordered = pieces.repartition("file").sortWithinPartitions("file", "block", "line", "n")
    return ordered.select("file", "piece").mapInPandas(_rows(table), SCHEMA)
