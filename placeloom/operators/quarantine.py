"""Records of delimited files to typed rows, the broken ones apart with their reason.

Blocks of thousands of records are judged at once: one pattern over the whole column for the quoting and the
number of fields, Arrow's CSV reader for what passes, vectorised rules for the typed columns. The block's
verdicts are kept as running sums, so that whether a part of it fails is one subtraction; a failing block is
halved, again and again, until what fails is a single record, which a strict parser then diagnoses. All
others keep the values of the bulk path. Every verdict is of a record alone, so that no result depends
on the block a record falls in.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.runtime import Scratch

DELIMITERS = [",", ";", "\t", "|"]
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"
BLANK = " \t\r\n\v\f\xa0  　﻿"
#: Kinds of columns; a column that a layout doesn't name is text.
LAYOUT = {"lat": "latitude", "lon": "longitude", "country": "country", "captured": "day"}
_ARROW = {"latitude": pa.float64(), "longitude": pa.float64(), "day": pa.date32()}
_SQL = {"latitude": "double", "longitude": "double", "day": "date"}


def split_record(record: str, delimiter: str) -> list[str] | None:
    """The fields of one record, or None where its quoting is broken."""
    fields, at = [], 0
    while True:
        if record[at : at + 1] == '"':
            end = at + 1
            while True:
                end = record.find('"', end)
                if end < 0:
                    return None
                if record[end + 1 : end + 2] == '"':
                    end += 2
                    continue
                break
            fields.append(record[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at < len(record) and record[at] != delimiter:
                return None
        else:
            end = record.find(delimiter, at)
            end = len(record) if end < 0 else end
            if '"' in record[at:end]:
                return None
            fields.append(record[at:end])
            at = end
        if at >= len(record):
            return fields
        at += 1


def typed(value: str, kind: str) -> tuple[bool, object]:
    """Whether a field is valid for its kind, and its value (empty: null)."""
    if kind in ("latitude", "longitude"):
        value = value.strip(BLANK)
        if not value:
            return True, None
        most = 90 if kind == "latitude" else 180
        return (True, float(value)) if re.match(NUMBER, value) and abs(float(value)) <= most else (False, None)
    if kind == "country":
        return (True, value) if re.match(r"^[A-Za-z]{2}$", value) and len(value) == 2 else (False, None)
    if kind == "day":
        if not value:
            return True, None
        try:
            return (True, date.fromisoformat(value)) if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value) else (False, None)
        except ValueError:
            return False, None
    return True, value


def diagnose(record: str, delimiter: str, columns: list[str], layout: dict[str, str]) -> tuple[str | None, dict]:
    """The first reason why a record isn't valid, or None and its typed values."""
    fields = split_record(record, delimiter)
    if fields is None:
        return "broken_quoting", {}
    if len(fields) != len(columns):
        return "wrong_column_count", {}
    out = {}
    for name, value in zip(columns, fields):
        good, out[name] = typed(value, layout.get(name, "text"))
        if not good:
            return "invalid_value", {}
    return None, out


class BulkParser:
    """Parses blocks of records of one delimiter and one list of columns."""

    def __init__(self, delimiter: str, columns: list[str], layout: dict[str, str], names: list[str]):
        self.delimiter, self.columns, self.layout = delimiter, columns, layout
        self.names = names
        d = re.escape(delimiter)
        field = f'(?:"(?:[^"]|"")*"|[^"{d}\r\n]*)'  # a bare line end in a record is text, but not to the reader
        self.whole = rf"(?s)\A{field}(?:{d}{field})" + "{" + str(max(0, len(columns) - 1)) + r"}\z"

    def read(self, records: pa.Array) -> list[pa.Array]:
        """The fields of well-formed records, a column each, as text."""
        body = "\n".join(records.to_pylist()).encode()
        ids = [f"c{i}" for i in range(len(self.columns))]
        table = csv.read_csv(
            io.BytesIO(body + b"\n"),
            read_options=csv.ReadOptions(column_names=ids, use_threads=False, block_size=len(body) + 16),
            parse_options=csv.ParseOptions(delimiter=self.delimiter, newlines_in_values=True, ignore_empty_lines=False),
            convert_options=csv.ConvertOptions(column_types={i: pa.string() for i in ids}, strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
        if len(table) != len(records):
            raise pa.ArrowInvalid("a record is not a line")
        return [table[i].combine_chunks() for i in ids]

    def typed(self, name: str, column: pa.Array) -> tuple[pa.Array | None, pa.Array]:
        """Which fields of a column are valid (None: all), and its values, null where they are not."""
        kind = self.layout.get(name, "text")
        if kind in ("latitude", "longitude"):
            column = pc.utf8_trim(column, BLANK)
            empty, number = pc.equal(column, ""), pc.match_substring_regex(column, NUMBER.replace("^", r"\A").replace("$", r"\z"))
            value = pc.cast(pc.if_else(number, column, None), pa.float64())
            near = pc.fill_null(pc.less_equal(pc.abs(value), 90.0 if kind == "latitude" else 180.0), False)
            return pc.or_(empty, near), value
        if kind == "country":
            return pc.match_substring_regex(column, r"\A[A-Za-z]{2}\z"), column
        if kind == "day":
            empty, shape = pc.equal(column, ""), pc.match_substring_regex(column, r"\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z")
            shape = pc.and_(shape, pc.invert(pc.starts_with(column, "0000")))
            year, month, day = (pc.cast(pc.if_else(shape, pc.utf8_slice_codeunits(column, i, j), "1"), pa.int32()) for i, j in ((0, 4), (5, 7), (8, 10)))
            fourth = lambda n: pc.equal(pc.subtract(year, pc.multiply(pc.divide(year, n), n)), 0)
            leap = pc.and_(fourth(4), pc.or_(pc.invert(fourth(100)), fourth(400)))
            last = pc.if_else(pc.equal(month, 2), pc.add(28, pc.cast(leap, pa.int32())), pc.if_else(pc.is_in(month, pa.array([4, 6, 9, 11], pa.int32())), 30, 31))
            exists = pc.and_(shape, pc.less_equal(day, last))
            return pc.or_(empty, exists), pc.cast(pc.if_else(exists, column, None), pa.date32())
        return None, column

    def bulk(self, records: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Which records of a block are valid, and typed columns of the whole block, null where they are not."""
        if not 0 < len(self.columns) <= 1000:  # no record fits; the pattern counts no further
            return np.zeros(len(records), bool), {}
        good = pc.match_substring_regex(records, self.whole).to_numpy(zero_copy_only=False)
        odd = pc.starts_with(records, "\ufeff").to_numpy(zero_copy_only=False)  # the reader would take it for a mark
        if len(self.columns) < 2:
            odd |= pc.equal(records, "").to_numpy(zero_copy_only=False)
        good &= ~odd
        at = np.flatnonzero(good)
        columns: dict[str, pa.Array] = {}
        if len(at):
            for name, column in zip(self.columns, self.read(records.take(pa.array(at)))):
                valid, columns[name] = self.typed(name, column)
                if valid is not None:
                    good[at[~valid.to_numpy(zero_copy_only=False)]] = False
        place = np.zeros(len(records), np.int64)
        place[at] = np.arange(len(at))
        keep = pa.array(place, mask=~good)
        return good, {n: c.take(keep) for n, c in columns.items() if n in self.names}

    def parse(self, records: pa.Array) -> tuple[list[str | None], dict[str, pa.Array], int]:
        """Reasons and typed columns of a block, in order, and how many records came to the strict parser."""
        good, columns = self.bulk(records)
        bad = np.concatenate([[0], np.cumsum(~good)])
        reasons: list[str | None] = [None] * len(records)
        fixed: dict[int, dict] = {}
        strict, todo = 0, [(0, len(records))]
        while todo:
            low, high = todo.pop()
            if bad[high] == bad[low]:
                continue
            if high - low > 1:
                half = (low + high) // 2
                todo += [(low, half), (half, high)]
                continue
            strict += 1
            reasons[low], values = diagnose(records[low].as_py(), self.delimiter, self.columns, self.layout)
            if reasons[low] is None:
                fixed[low] = values
        if fixed:  # records that only the reader could not take
            rows = np.arange(len(records))
            rows[list(fixed)] = len(records) + np.arange(len(fixed))
            for n in self.names:
                if n in self.columns:
                    kind = _ARROW.get(self.layout.get(n, "text"), pa.string())
                    whole = columns[n].cast(kind) if n in columns else pa.nulls(len(records), kind)
                    columns[n] = pa.concat_arrays([whole, pa.array([v.get(n) for v in fixed.values()], kind)]).take(pa.array(rows))
        return reasons, columns, strict


def file_specs(lines: DataFrame, files: DataFrame, scratch: Scratch) -> DataFrame:
    """``(file_id, delimiter, columns, first)``: what each file's records are read by.

    ``first`` is the header's line number, null without a header. A missing delimiter is the one of
    ``, ; TAB |`` that gives most records outside quotes the width expected of them (that of the
    header or of ``column_names``; without either the commonest width above one); comma when none does.
    """
    seen = lines.filter(F.col("raw_line").isNotNull() & (F.trim(F.translate("raw_line", BLANK, "")) != ""))
    files = files.groupBy("file_id").agg(
        F.max("header_row").alias("header_row"), F.max("delimiter").alias("delimiter"), F.max("column_names").alias("column_names")
    )
    heads = seen.groupBy("file_id").agg(F.min(F.struct("line_no", "raw_line")).alias("head"))
    bare = F.regexp_replace("raw_line", r'"[^"]*"', "")
    widths = seen.select("file_id", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), (F.length(bare) - F.length(F.translate(bare, d, "")) + 1).alias("w")) for i, d in enumerate(DELIMITERS)])).alias("x"))
    widths = widths.groupBy("file_id", "x.d", "x.w").count().groupBy("file_id").agg(F.collect_list(F.struct("d", "w", "count")).alias("widths"))
    spec = scratch.write(files.join(heads, "file_id", "left").join(widths, "file_id", "left"))

    def choose(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                names = list(r.column_names) if r.column_names is not None else []
                header = r.head["raw_line"] if r.header_row and r.head is not None else None
                counts = [(int(x["d"]), int(x["w"]), int(x["count"])) for x in (r.widths if r.widths is not None else [])]
                best, delimiter = 0, r.delimiter
                if not delimiter:
                    delimiter = ","
                    for i, d in enumerate(DELIMITERS):
                        fits = [c for j, w, c in counts if j == i and w > 1 and (w == len(split_record(header, d) or []) if header else w == len(names) or not names)]
                        n = (sum if header or names else max)(fits or [0])
                        if n > best:
                            best, delimiter = n, d
                if header is not None:
                    names = split_record(header, delimiter) or header.split(delimiter)
                names = [n.strip(BLANK).lower() for n in names]
                out.append((r.file_id, delimiter, names, int(r.head["line_no"]) if header is not None else None))
            import pandas as pd

            frame = pd.DataFrame(out, columns=["file_id", "delimiter", "columns", "first"])
            frame["first"] = frame["first"].astype("Int64")
            yield frame

    kind = files.schema["file_id"].dataType.simpleString()
    return scratch.write(spec.mapInPandas(choose, f"file_id {kind}, delimiter string, columns array<string>, first long"))


def parse_records(lines: DataFrame, files: DataFrame, columns: list[str], layout: dict[str, str] | None = None, block: int = 10_000) -> DataFrame:
    """``file_id, line_no, reason`` and the typed ``columns`` of every record.

    ``lines(file_id, line_no, raw_line)``, ``files(file_id, header_row, delimiter, column_names)``.
    ``reason`` is null for a valid record, else the first of ``broken_quoting``, ``wrong_column_count``,
    ``invalid_value`` that holds, and the columns are null. Header lines and blank or null lines are
    no records (a line of nothing but the delimiter is one). Lines of a file that ``files`` doesn't
    describe are read with commas and no columns, so any record of them has a wrong column count.
    Repeated lines of a file count once. A column that a file lacks is null; of two columns of one name
    the last counts. Empty tables give no rows.

    Records are independent: lines stay where they are but for the removal of repeats. The specification,
    one row a file, is written first, so Spark broadcasts it only if its actual size allows.
    """
    layout = LAYOUT if layout is None else layout
    scratch = Scratch(lines.sparkSession, "quarantine")
    lines = lines.select("file_id", F.col("line_no").cast("long").alias("line_no"), "raw_line").filter("raw_line is not null")
    spec = file_specs(lines, files, scratch)
    work = (
        lines.dropDuplicates(["file_id", "line_no"]).join(spec, "file_id", "left")
        .filter("first is null or line_no > first")
        .select("file_id", "line_no", "raw_line", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), F.coalesce("columns", F.expr("array()")).alias("columns"))
    )
    file_type = lines.schema["file_id"].dataType.simpleString()
    kinds = {n: _SQL.get(layout.get(n, "text"), "string") for n in columns}
    schema = f"file_id {file_type}, line_no long, reason string" + "".join(f", `{n}` {t}" for n, t in kinds.items())
    arrow = {n: _ARROW.get(layout.get(n, "text"), pa.string()) for n in columns}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            raw = table["raw_line"].combine_chunks().cast(pa.string())
            groups: dict[tuple, list[int]] = {}
            stripped = pc.utf8_trim(raw, BLANK)
            empty = pc.equal(stripped, "").to_pylist()
            delims, cols, fids = table["delimiter"].to_pylist(), table["columns"].to_pylist(), table["file_id"].to_pylist()
            by_file: dict[object, list[int]] = {}
            for i, fid in enumerate(fids):
                if not empty[i] or delims[i] in (raw[i].as_py() or ""):
                    groups_of = by_file.get(fid)
                    if groups_of is None:
                        groups_of = by_file[fid] = groups.setdefault((delims[i], tuple(cols[i])), [])
                    groups_of.append(i)
            for (delimiter, names), rows in groups.items():
                parser = BulkParser(delimiter, list(names), layout, columns)
                for start in range(0, len(rows), block):
                    at = pa.array(rows[start : start + block], pa.int64())
                    reasons, values, _ = parser.parse(raw.take(at))
                    yield pa.RecordBatch.from_arrays(
                        [table["file_id"].take(at).combine_chunks(), table["line_no"].take(at).combine_chunks(), pa.array(reasons, pa.string())]
                        + [values[c].cast(arrow[c]) if c in values else pa.nulls(len(at), arrow[c]) for c in columns],
                        names=["file_id", "line_no", "reason", *columns],
                    )

    return work.mapInArrow(parse, schema)
