"""Log lines into typed records and rejects with a reason.

The lines of a batch are laid out in one byte buffer. numpy masks of quotes and their
prefix parity tell what is inside quotes; with the masks of separators and record ends
they give every field's place without a parser per line. Counts and type checks on these
places then sort the lines; JSON lines are told apart by the shape that their punctuation has. Which header a line belongs to is an equi-join on
(file, block of lines), so that one very long file is as balanced as many short ones.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship

REASONS = ("column_count", "quoting", "json_syntax", "bad_ts", "bad_answers")
LEAST_TS, TS_END = 946684800, 4102444800
_LABELS = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_UNSET = (b"-", b"(empty)")


@lru_cache(1 << 16)
def valid_answer(text: str) -> bool:
    """An IPv4 or IPv6 address or labels joined by single dots."""
    if not text:
        return False
    if not text.strip("0123456789."):
        return bool(_QUAD.fullmatch(text)) and all(int(x) < 256 for x in text.split("."))
    if ":" in text:
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
        return "%" not in text
    return bool(_LABELS.fullmatch(text))


@lru_cache(256)
def separator_of(header: str | None) -> bytes:
    """The bytes that a #separator line names (\\xHH escapes); a tab where there is none."""
    if not header:
        return b"\t"
    value = header[len("#separator") :].lstrip(" \t")
    return re.sub(rb"\\x([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), value.encode()) or b"\t"


@lru_cache(1024)
def fields_of(header: str, separator: bytes) -> tuple[str, ...]:
    return tuple(x.decode() for x in header.encode()[len("#fields") + len(separator) :].split(separator))


class StructuralIndex:
    """Byte buffer of many records with record ends, quote mask and prefix parity."""

    def __init__(self, records: list[bytes]):
        self.data = b"".join(records)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, records), np.int64, len(records)))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def places(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        """Where `byte` stands, and in which record."""
        at = np.flatnonzero(self.bytes == byte)
        return at, np.searchsorted(self.ends, at, "right")

    def before(self, mask: np.ndarray) -> np.ndarray:
        """Prefix counts: how often mask holds before each place, one more entry than bytes."""
        return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    def quotes(self, escapes: bool) -> np.ndarray:
        """Mask of double quotes; with escapes, without those behind an odd run of backslashes."""
        quote = self.bytes == 34
        return quote & (self.run % 2 == 0) if escapes else quote

    @cached_property
    def run(self) -> np.ndarray:
        """How many backslashes stand right before each place."""
        place = np.arange(len(self.bytes))
        last_other = np.maximum.accumulate(np.where(self.bytes == 92, -1, place))
        return np.concatenate([[0], (place - last_other)[:-1]]).astype(np.int64)


def _spans(index: StructuralIndex, rows: np.ndarray, separator: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a separator in some records, in order, and the record of each."""
    if len(separator) == 1:
        at, row = index.places(separator[0])
        mine = np.zeros(len(index.ends), bool)
        mine[rows] = True
        return at[mine[row]], row[mine[row]]
    found = [(k, m.start()) for k in rows for m in re.compile(re.escape(separator)).finditer(index.data, index.starts[k], index.ends[k])]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 1], pairs[:, 0]


def _valid_times(index: StructuralIndex, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each span is 1 to 10 digits with an optional point and 1 to 9 digits, and a time in range."""
    digit, point = (index.bytes >= 48) & (index.bytes <= 57), index.bytes == 46
    digits, points = index.before(digit), index.before(point)
    n_points = points[b] - points[a]
    places = np.append(np.flatnonzero(point), len(index.bytes))
    whole = np.where(n_points > 0, places[np.minimum(points[a], len(places) - 1)], b) - a
    fraction = b - a - whole - n_points
    fits = (digits[b] - digits[a] + n_points == b - a) & (n_points <= 1) & (whole >= 1) & (whole <= 10) & ((n_points == 0) | ((fraction >= 1) & (fraction <= 9)))
    value = np.zeros(len(a), np.int64)
    for k in range(10):
        more = fits & (k < whole)
        value[more] = value[more] * 10 + index.bytes[a[more] + k] - 48
    return fits & (value >= LEAST_TS) & (value < TS_END)


def _read_answers(index: StructuralIndex, rows: np.ndarray, a: np.ndarray, b: np.ndarray, reasons: list, answers: list) -> None:
    """Splits the answers lists at a..b of `rows` at the commas outside quotes; sets reason and values."""
    empty = np.zeros(len(rows), bool)
    for mark in _UNSET:
        same = b - a == len(mark)
        for k, byte in enumerate(mark):
            same[same] = index.bytes[a[same] + k] == byte
        empty |= same
    rows, a, b = rows[~empty], a[~empty], b[~empty]
    parity = index.before(index.quotes(False))
    comma, row = index.places(44)
    nth = np.full(len(index.ends), -1)
    nth[rows] = np.arange(len(rows))
    owner = nth[row]
    comma, owner = comma[owner >= 0], owner[owner >= 0]
    inside = (comma >= a[owner]) & (comma < b[owner]) & ((parity[comma] - parity[a[owner]]) % 2 == 0)
    comma, owner = comma[inside], owner[inside]
    # an element begins at its list's begin or behind a comma, and ends before a comma or at the list's end
    begin, end, whose = np.concatenate([a, comma + 1]), np.concatenate([b, comma]), np.concatenate([np.arange(len(rows)), owner])
    begin, end = begin[np.lexsort((begin, whose))], end[np.lexsort((end, whose))]
    whose = np.sort(whose)
    quoted = parity[end] > parity[begin]
    for x, y, q, k in zip(begin.tolist(), end.tolist(), quoted.tolist(), rows[whose].tolist()):
        value = index.data[x:y]
        if answers[k] is None:
            answers[k] = []
        if q:
            if len(value) < 2 or value[0] != 34 or value[-1] != 34 or b'"' in value[1:-1].replace(b'""', b""):
                reasons[k] = "quoting"
            answers[k].append(value[1:-1].replace(b'""', b'"').decode())
        else:
            answers[k].append(value.decode())
            if reasons[k] is None and not valid_answer(answers[k][-1]):
                reasons[k] = "bad_answers"


def read_tsv(lines: list[str], separators: list[bytes], fields: list[tuple[str, ...] | None]) -> tuple[list[str | None], list[list[str] | None]]:
    """Reason (None: valid) and parsed answers of each TSV data line. No fields: no line fits."""
    index = StructuralIndex([x.encode() for x in lines])
    n = len(lines)
    reasons: list[str | None] = [None] * n
    answers: list[list[str] | None] = [None] * n
    kinds: dict[tuple, list[int]] = {}
    for k in range(n):
        kinds.setdefault((separators[k], fields[k]), []).append(k)
    for (separator, names), members in kinds.items():
        rows = np.array(members)
        at, row = _spans(index, rows, separator)
        fits = np.bincount(row, minlength=n)[rows] + 1 == (len(names) if names is not None else 0)
        for k in rows[~fits]:
            reasons[k] = "column_count"
        rows = rows[fits]
        if not len(rows):
            continue
        first = np.searchsorted(row, rows)

        def span(name: str) -> tuple[np.ndarray, np.ndarray] | None:
            if name not in names:
                return None
            f = names.index(name)
            a = index.starts[rows] if f == 0 else at[first + f - 1] + len(separator)
            return a, index.ends[rows] if f == len(names) - 1 else at[first + f]

        if (where := span("answers")) is not None:
            _read_answers(index, rows, *where, reasons, answers)
        where = span("ts")
        timed = _valid_times(index, *where) if where is not None else np.zeros(len(rows), bool)
        for k in rows[~timed]:
            if reasons[k] != "quoting":
                reasons[k] = "bad_ts"
    return reasons, [a if r is None else None for a, r in zip(answers, reasons)]


_LITERAL = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
_WANTED = (b"ts", b"answers", b"qtype_name")
#: what a byte can be in JSON, as bits
_BLANK, _MARK, _HEX, _ESCAPED = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
for _bit, _those in ((_BLANK, b" \t\n\r"), (_MARK, b"{}[]:,"), (_HEX, b"0123456789abcdefABCDEF"), (_ESCAPED, b'"\\/bfnrtu')):
    _CLASS[list(_those)] |= _bit


@lru_cache(4096)
def _members(shape: bytes) -> tuple[tuple[int, int, bytes], ...] | None:
    """Of an object's shape (s: a string, v: another value, no blanks) the members: token of the key, first token and
    shape of the value. None: it is no object."""
    try:
        if shape[:1] != b"{" or not isinstance(json.loads(shape.replace(b"s", b'""').replace(b"v", b"0")), dict):
            return None
    except (ValueError, RecursionError):
        return None
    out, depth, token, key, begin, first = [], 0, 0, -1, 0, 0
    for place, byte in enumerate(shape):
        if depth == 1 and byte == 58:  # a colon: its key is the token before
            key, begin, first = token - 1, place + 1, token
        elif depth == 1 and byte in (44, 125) and key >= 0:
            out.append((key, first, shape[begin:place]))
            key = -1
        depth += (byte in (91, 123)) - (byte in (93, 125))
        token += byte in (115, 118)
    return tuple(out)


_FLAT_LIST = re.compile(rb"\[(?:s(?:,s)*)?\]")


def read_json(lines: list[str]) -> tuple[list[str | None], list[list[str] | None]]:
    """Reason (None: valid) and answers of each NDJSON data line.

    Masks and the parity of quotes sort every byte into strings, blanks, punctuation and other values. What is left of
    a line without the content of its tokens is its shape; of the few different shapes there are, each is judged once.
    """
    index = StructuralIndex([x.encode(errors="surrogatepass") + b"\n" for x in lines])
    byte, n = index.bytes, len(lines)
    record = np.repeat(np.arange(n), index.ends - index.starts)
    quote = index.quotes(True)
    upto = index.before(quote)
    odd = ((upto[:-1] - upto[index.starts][record]) & 1).astype(bool)  # in a string, or the quote that ends it
    broken = (upto[index.ends] - upto[index.starts]) % 2 == 1
    broken[record[odd & (byte < 32)]] = True
    # a backslash that is not escaped itself must begin one of the known escapes
    escape = np.flatnonzero(odd & (byte == 92) & (index.run % 2 == 0))
    after = byte[np.minimum(escape + 1, len(byte) - 1)]
    broken[record[escape[(_CLASS[after] & _ESCAPED) == 0]]] = True
    kind = _CLASS[byte]
    coded = escape[after == 117]
    for k in range(2, 6):
        broken[record[coded[(kind[np.minimum(coded + k, len(byte) - 1)] & _HEX) == 0]]] = True
    mark = (kind & _MARK) > 0
    other = ~(odd | quote | ((kind & (_MARK | _BLANK)) > 0))
    begins = other & ~np.concatenate([[False], other[:-1]])
    ends_at = np.flatnonzero(other & ~np.concatenate([other[1:], [False]])) + 1
    kept = (~odd & (quote | mark)) | begins
    shape = np.where(quote, 115, np.where(other, 118, byte)).astype(np.uint8)[kept].tobytes()
    shape_ends = index.before(kept)[index.ends]
    # tokens: strings from quote to quote, other values from begin to end
    places = np.flatnonzero(quote)
    first = ~odd[places]
    opens, closes, values = places[first], np.append(places[1:], 0)[first], np.flatnonzero(begins)
    literal = list(map(index.data.__getitem__, map(slice, values.tolist(), ends_at.tolist())))
    known = {x: bool(_LITERAL.fullmatch(x)) for x in set(literal)}
    broken[record[values[~np.fromiter(map(known.__getitem__, literal), bool, len(literal))]]] = True
    token_at = np.sort(np.concatenate([opens, values]))
    first_token = np.searchsorted(token_at, index.starts).tolist()
    string_end, value_end = dict(zip(opens.tolist(), closes.tolist())), dict(zip(values.tolist(), ends_at.tolist()))
    token_at = token_at.tolist()

    def text(token: int) -> str:
        a = token_at[token]
        inner = index.data[a + 1 : string_end[a]]
        return json.loads(b'"' + inner + b'"') if b"\\" in inner else inner.decode(errors="surrogatepass")

    reasons: list[str | None] = [None] * n
    answers: list[list[str] | None] = [None] * n
    shape_from = 0
    for k, (bad, shape_to, t) in enumerate(zip(broken.tolist(), shape_ends.tolist(), first_token)):
        members = None if bad else _members(shape[shape_from:shape_to])
        shape_from = shape_to
        if members is None:
            reasons[k] = "json_syntax"
            continue
        found: dict[str, tuple[int, bytes]] = {}
        for key, token, kind in members:
            a = token_at[t + key]
            name = index.data[a + 1 : string_end[a]]
            if name in _WANTED or b"\\" in name:
                found[text(t + key)] = (t + token, kind)
        token, kind = found.get("ts", (0, b""))
        try:
            ts = float(index.data[token_at[token] : value_end[token_at[token]]]) if kind == b"v" else -1.0
        except ValueError:  # true, false or null
            ts = -1.0
        if not LEAST_TS <= ts < TS_END:
            reasons[k] = "bad_ts"
            continue
        token, kind = found.get("answers", (0, b""))
        if not kind or (kind == b"v" and index.data[token_at[token] : value_end[token_at[token]]] == b"null"):
            continue
        if not _FLAT_LIST.fullmatch(kind):
            reasons[k] = "bad_answers"
            continue
        mine = [text(token + i) for i in range(kind.count(b"s"))]
        token, kind = found.get("qtype_name", (0, b""))
        if (kind == b"s" and text(token) == "TXT") or all(map(valid_answer, mine)):
            answers[k] = mine
        else:
            reasons[k] = "bad_answers"
    return reasons, answers


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        reason = np.full(len(b), None, object)
        answers = np.full(len(b), None, object)
        for tsv in (True, False):
            rows = np.flatnonzero(b.tsv.to_numpy(bool) == tsv)
            if not len(rows):
                continue
            lines = b.line.iloc[rows].tolist()
            if tsv:
                separators = [separator_of(x if isinstance(x, str) else None) for x in b.separator.iloc[rows]]
                fields = [fields_of(x, s) if isinstance(x, str) else None for x, s in zip(b.fields.iloc[rows], separators)]
                r, a = read_tsv(lines, separators, fields)
            else:
                r, a = read_json(lines)
            reason[rows] = r
            for k, x in zip(rows, a):
                answers[k] = x
        yield b.assign(reason=reason, answers=answers)


def _headers(lines: DataFrame, block: int) -> DataFrame:
    """(f, b, low, high, separator, fields): the headers in force from line low up to below high, once per block."""
    heads = lines.where(F.col("line").startswith("#separator") | F.col("line").startswith("#fields"))
    heads = heads.select("file", "at", *[F.when(F.col("line").startswith(f"#{x}"), F.col("line")).alias(x) for x in ("separator", "fields")])
    over = Window.partitionBy("file").orderBy("at")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select(
        "file", F.col("at").alias("low"), F.lead("at").over(over).alias("high"),
        *[F.last(x, ignorenulls=True).over(upto).alias(x) for x in ("separator", "fields")],
        F.row_number().over(over).alias("nth"), F.max(F.col("fields").isNotNull()).over(Window.partitionBy("file")).alias("tsv")
    )
    heads = heads.where("tsv").drop("tsv")
    ends = lines.groupBy(F.col("file").alias("f")).agg(F.max("at").alias("end"), F.min("at").alias("begin"))
    heads = heads.join(ends, F.col("file") == F.col("f")).select(
        "file", "low", F.coalesce("high", F.col("end") + 1).alias("high"), "separator", "fields", "nth", "begin"
    )
    above = heads.where("nth = 1").select(
        "file", F.col("begin").alias("low"), F.col("low").alias("high"), F.lit(None).cast("string").alias("separator"),
        F.lit(None).cast("string").alias("fields")
    )
    spans = heads.select("file", "low", "high", "separator", "fields").unionByName(above).where("high > low")
    first, last = (F.floor(F.col(x) / block).cast("bigint") for x in ("low", "last"))
    spans = spans.withColumn("last", F.col("high") - 1)
    return spans.select(F.col("file").alias("f"), F.explode(F.sequence(first, last)).alias("b"), "low", "high", "separator", "fields")


def read_lines(
    df: DataFrame, line_id: str = "line_id", file_name: str = "file_name", line_no: str = "line_no", raw_line: str = "raw_line",
    block: int = 8192
) -> DataFrame:
    """Every data line: line_id, file, at, line, tsv, separator, fields, reason (null: valid), answers.

    A trailing carriage return is cut; lines that are null, empty or start with `#` are no data. A
    file with a #fields line is TSV, any other NDJSON. Null file names are one file, a null line
    number stands before all others. A TSV line without #fields above it has `column_count`.
    Repeated rows are judged each; an empty table gives no rows. `block`: lines of one file that
    share a join key.
    """
    ship(df.sparkSession)
    col = lambda c: F.col(f"`{c}`")
    lines = df.select(
        col(line_id).alias("line_id"), F.coalesce(col(file_name), F.lit("")).alias("file"),
        F.coalesce(col(line_no).cast("bigint"), F.lit(-1)).alias("at"), F.regexp_replace(col(raw_line), "\r$", "").alias("line")
    )
    data = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("block", F.floor(F.col("at") / block).cast("bigint"))
    heads = _headers(lines, block)
    joined = data.join(
        heads,
        (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")),
        "left"
    )
    joined = joined.select("line_id", "file", "at", "line", F.col("f").isNotNull().alias("tsv"), "separator", "fields")
    out = joined.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    return joined.mapInPandas(_read, out + ", reason string, answers array<string>")


#: name in the log -> (column, type) of a typed record
RECORD = {
    "ts": ("ts", "double"), "uid": ("uid", "string"), "id.orig_h": ("orig_h", "string"), "id.orig_p": ("orig_p", "int"),
    "id.resp_h": ("resp_h", "string"), "id.resp_p": ("resp_p", "int"), "proto": ("proto", "string"), "service": ("service", "string"),
    "duration": ("duration", "double"), "orig_bytes": ("orig_bytes", "bigint"), "resp_bytes": ("resp_bytes", "bigint"),
    "conn_state": ("conn_state", "string"), "missed_bytes": ("missed_bytes", "bigint"), "history": ("history", "string"),
    "orig_pkts": ("orig_pkts", "bigint"), "resp_pkts": ("resp_pkts", "bigint"), "trans_id": ("trans_id", "int"), "query": ("query", "string"),
    "qtype": ("qtype", "int"), "qtype_name": ("qtype_name", "string"), "rcode": ("rcode", "int"), "rcode_name": ("rcode_name", "string"),
    "ttls": ("ttls", "string"), "rejected": ("rejected", "boolean"),
    "version": ("version", "string"), "cipher": ("cipher", "string"), "server_name": ("server_name", "string"), "established": (
        "established", "boolean"
    ),
    "resumed": ("resumed", "boolean"), "ja3": ("ja3", "string"), "ja3s": ("ja3s", "string"), "validation_status": ("validation_status", "string"),
    "subject": (
        "subject", "string"
    ), "issuer": ("issuer", "string"), "method": ("method", "string"), "host": ("host", "string"), "uri": ("uri", "string"),
    "user_agent": ("user_agent", "string"), "status_code": ("status_code", "int"), "status_msg": ("status_msg", "string"),
    "request_body_len": ("request_body_len", "bigint"), "response_body_len": (
        "response_body_len", "bigint"
    ), "resp_mime_types": ("mime_type", "string"),
}


def typed_records(read: DataFrame) -> DataFrame:
    """The valid lines of read_lines() as typed columns; unset, absent and unreadable values are null.

    Whole numbers may be written with a fraction, which is cut off. Of fields or members of the same name the first
    counts in TSV and the last in NDJSON. Any number of fields is read.
    """
    valid = read.where(F.col("reason").isNull())
    separator = F.regexp_replace(F.coalesce(F.col("separator"), F.lit("#separator \\x09")), r"^#separator\s*", "")
    char = F.when(separator.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.char(F.conv(F.substring(separator, 3, 2), 16, 10).cast("int"))).otherwise(separator)
    pieces = lambda c: F.split(c, F.concat(F.lit(r"\Q"), F.col("char"), F.lit(r"\E")), -1)
    valid = valid.select("*", char.alias("char"))
    text = ", ".join(f"`{n}` string" for n in RECORD)
    valid = valid.select(
        "*",
        F.when(F.col("tsv"), pieces(F.col("fields"))).alias("names"),  # the first piece is the mark #fields
        F.when(F.col("tsv"), pieces(F.col("line"))).alias("values"),
        F.when(~F.col("tsv"), F.from_json("line", text)).alias("j"),
    )

    def value(name: str, kind: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        raw = F.when(F.col("tsv"), F.when(at > 1, F.get("values", at - 2))).otherwise(F.col(f"j.`{name}`"))
        raw = F.when(~raw.isin("-", "(empty)"), raw)
        if kind == "boolean":
            return F.when(raw.isin("T", "true"), True).when(raw.isin("F", "false"), False)
        if kind in ("int", "bigint"):
            return F.coalesce(raw.try_cast(kind), raw.try_cast("double").try_cast(kind))
        return raw.try_cast(kind)

    return valid.select("line_id", F.col("file").alias("file_name"), *[value(n, t).alias(c) for n, (c, t) in RECORD.items()], "answers")
