"""Problem 4: deeply nested records to flat child rows that know their parent and place.

JSON text is not parsed value by value. A batch of texts is one byte buffer; comparing the buffer with
the few characters of JSON's syntax gives a bitmap of quotes, brackets and delimiters, prefix sums over
the bitmaps give "inside a string" (parity of quotes) and the nesting depth, and spans between
delimiters of one depth are the members of a container. Columns that arrive already nested carry the
same index as list offsets (prefix sums of the list lengths), so their rows come from those.

Nothing is shuffled: both operators are one narrow map over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHILD_SCHEMA = "source_table string, line_no bigint, child string, pos int, sub_pos int, child_value string"
_ARROW = pa.schema(
    [
        ("source_table", pa.string()),
        ("line_no", pa.int64()),
        ("child", pa.string()),
        ("pos", pa.int32()),
        ("sub_pos", pa.int32()),
        ("child_value", pa.string()),
    ]
)
#: Bytes of text that are indexed at once; bounds the memory of the bitmaps, not what is read.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_STRUCT = np.zeros(256, bool)
_STRUCT[list(b"{}[],:")] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1
_SCALAR = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]{0,300})(?:\.[0-9]{1,300})?(?:[eE][+-]?[0-9]{1,3})?)[ \t\r\n]*")
QUOTE, BACKSLASH, COLON, COMMA, OPEN_LIST, OPEN_OBJECT = b'"'[0], b"\\"[0], b":"[0], b","[0], b"["[0], b"{"[0]


@dataclass
class Spans:
    """Containers of one depth: the event that opens each, the event that closes it."""

    first: np.ndarray
    last: np.ndarray


class StructuralIndex:
    """Bitmaps, depths and events of many texts that lie one after another in one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        quotes = np.flatnonzero(data == QUOTE)
        if len(quotes):
            quotes = quotes[~self._escaped(quotes)]
        self.quotes = quotes
        events = np.flatnonzero(_STRUCT[data])
        row = np.searchsorted(starts, events, side="right") - 1
        inside = (np.searchsorted(quotes, events) - np.searchsorted(quotes, starts[row])) & 1
        keep = inside == 0
        self.at, self.row = events[keep], row[keep]
        self.char = data[self.at]
        step = _STEP[self.char]
        total = np.cumsum(step)
        first = np.searchsorted(self.row, np.arange(len(starts)))
        base = np.concatenate([[0], total])[first]
        after = total - base[self.row]
        #: Depth of the container that an event belongs to: of a bracket, the container it delimits.
        self.depth = np.where(step < 0, after + 1, after)
        self.step = step
        dark = np.where(_SPACE[data], len(data), np.arange(len(data)))
        self.next_dark = np.append(np.minimum.accumulate(dark[::-1])[::-1], len(data)) if len(data) else np.zeros(1, np.int64)
        self._levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _escaped(self, quotes: np.ndarray) -> np.ndarray:
        slash = self.data == BACKSLASH
        if not slash.any():
            return np.zeros(len(quotes), bool)
        place = np.arange(len(self.data))
        plain = np.maximum.accumulate(np.where(slash, -1, place))
        row = np.searchsorted(self.starts, quotes, side="right") - 1
        before = np.maximum(quotes - 1, 0)
        last = np.where(quotes > 0, plain[before], -1)
        run = quotes - 1 - np.maximum(last, self.starts[row] - 1)
        return (run & 1) == 1

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Events of one depth: those that end a member (comma, closing bracket), and the colons."""
        if depth not in self._levels:
            own = self.depth == depth
            ends = np.flatnonzero(own & ((self.char == COMMA) | (self.step < 0)))
            self._levels[depth] = ends, np.flatnonzero(own & (self.char == COLON))
        return self._levels[depth]

    def opened(self, at: np.ndarray) -> np.ndarray:
        """The events at the byte places ``at``, -1 where none is."""
        k = np.searchsorted(self.at, at)
        k = np.minimum(k, max(len(self.at) - 1, 0))
        return np.where(len(self.at) and self.at[k] == at, k, -1) if len(self.at) else np.full(len(at), -1)

    def tops(self) -> np.ndarray:
        """Of each text, the event that opens its outermost container, -1 if it starts with none."""
        dark = self.next_dark[np.minimum(self.starts, len(self.data))] if len(self.data) else self.starts
        k = self.opened(np.minimum(dark, max(len(self.data) - 1, 0)))
        good = (dark < self.ends) & (k >= 0)
        good &= self.step[k] > 0 if len(self.step) else False
        return np.where(good, k, -1)

    def close(self, opening: np.ndarray, depth: int) -> np.ndarray:
        """The events that close containers of one depth."""
        ends, _ = self.level(depth)
        closing = ends[self.step[ends] < 0]
        k = np.searchsorted(closing, opening, side="right")
        good = k < len(closing)
        last = closing[np.minimum(k, max(len(closing) - 1, 0))] if len(closing) else np.full(len(opening), -1)
        good &= (last >= 0) & (self.row[np.maximum(last, 0)] == self.row[opening]) if len(opening) else good
        return np.where(good, last, -1)

    def member_end(self, begin: np.ndarray, depth: int) -> np.ndarray:
        """The first event of ``depth`` after the events ``begin`` that ends a member."""
        ends, _ = self.level(depth)
        k = np.searchsorted(ends, begin, side="right")
        return ends[np.minimum(k, max(len(ends) - 1, 0))] if len(ends) else np.full(len(begin), -1)

    def keyed(self, opening: np.ndarray, closing: np.ndarray, depth: int, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members named ``key`` of the given objects: (place among ``opening``, value start, value end); the last wins."""
        _, colons = self.level(depth)
        lo, hi = np.searchsorted(colons, opening), np.searchsorted(colons, closing)
        count = np.maximum(hi - lo, 0)
        owner = np.repeat(np.arange(len(opening)), count)
        colon = colons[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] if len(owner) else np.empty(0, np.int64)
        if not len(owner):
            return owner, colon, colon
        shut = np.searchsorted(self.quotes, self.at[colon]) - 1
        left, right = self.quotes[np.maximum(shut - 1, 0)] + 1, self.quotes[np.maximum(shut, 0)]
        want = np.frombuffer(key.encode(), np.uint8)
        same = np.zeros(len(colon), bool)
        fits = np.flatnonzero((right - left == len(want)) & (shut > 0))
        same[fits] = (self.data[left[fits][:, None] + np.arange(len(want))] == want).all(axis=1)
        slashes = np.flatnonzero(self.data == BACKSLASH)
        escaped = np.searchsorted(slashes, right) > np.searchsorted(slashes, left)
        for k in np.flatnonzero(escaped & (shut > 0)):
            same[k] = self._string(left[k], right[k]) == key
        owner, colon = owner[same], colon[same]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        owner, colon = owner[last], colon[last]
        return owner, self.at[colon] + 1, self.at[self.member_end(colon, depth)]

    def elements(self, opening: np.ndarray, closing: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Elements of the given lists: (place among ``opening``, position, start, end)."""
        ends, _ = self.level(depth)
        lo, hi = np.searchsorted(ends, opening), np.searchsorted(ends, closing) + 1
        count = hi - lo
        owner = np.repeat(np.arange(len(opening)), count)
        pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        end = self.at[ends[np.repeat(lo, count) + pos]]
        start = np.where(pos == 0, self.at[opening[owner]] + 1, np.append(0, end[:-1])[: len(end)] + 1)
        dark = self.next_dark[start] < end
        return owner[dark], pos[dark], start[dark], end[dark]

    def sound(self) -> np.ndarray:
        """Of each text, whether it surely is valid JSON with a container outermost, by the index alone.

        What stands between two neighbouring events is decided by the two: nothing, a key, or a value. Brackets must
        match those that open their container. A text with a backslash, a control character in it or an unusual number is left
        undecided (False), not judged.
        """
        n, size = len(self.starts), len(self.data)
        if not len(self.at):
            return np.zeros(n, bool)
        row, char, at, depth, opens, closes = self.row, self.char, self.at, self.depth, self.step > 0, self.step < 0
        bad = np.zeros(n, bool)
        odd = np.flatnonzero((self.data == BACKSLASH) | (self.data < 0x20))
        line = np.searchsorted(self.starts, odd, side="right") - 1
        within = (np.searchsorted(self.quotes, odd) - np.searchsorted(self.quotes, self.starts[line])) & 1 == 1
        bad[line[within | ~_SPACE[self.data[odd]]]] = True
        last = np.append(row[1:] != row[:-1], True)
        first = np.append(True, last[:-1])
        # one container outermost, nothing before and after it, and no depth below it
        has = np.zeros(n, bool)
        has[row] = True
        bad |= ~has
        bad[row[first & ~opens]] = True
        bad[row[last & ~(closes & (depth == 1))]] = True
        bad[row[~last & closes & (depth == 1)]] = True
        bad[row[depth < 1]] = True
        dark = self.next_dark
        bad[row[first & (dark[self.starts[row]] != at)]] = True
        bad[row[last & (dark[np.minimum(at + 1, size)] < self.ends[row])]] = True
        # the bracket that opened the container of each event: the last opening one of its depth
        order = np.lexsort((np.arange(len(at)), depth, row))
        opener = np.empty(len(at), np.int64)
        opener[order] = np.maximum.accumulate(np.where(opens[order], np.arange(len(at)), -1))
        kind = char[order[np.maximum(opener, 0)]]
        inside_object = kind == OPEN_OBJECT
        bad[row[closes & (char - kind != 2)]] = True  # } is two after {, ] two after [
        bad[row[(char == COLON) & ~inside_object]] = True
        # the gap before each event but the first of a text
        k = np.flatnonzero(~first)
        a, b = k - 1, k
        left = dark[at[a] + 1]
        empty = left >= at[b]
        opening, closing = opens[b], closes[b]
        key = (char[b] == COLON) & (((char[a] == COMMA) & inside_object[a]) | (char[a] == OPEN_OBJECT))
        value = ((char[b] == COMMA) | closing) & ((char[a] == COLON) | ((char[a] == COMMA) & ~inside_object[a]) | (char[a] == OPEN_LIST))
        nothing = (closes[a] & ((char[b] == COMMA) | closing)) | (opening & ((char[a] == COLON) | ((char[a] == COMMA) & ~inside_object[a]) | (char[a] == OPEN_LIST))) | (opens[a] & closing)
        quoted = ~empty & (self.data[np.minimum(left, size - 1)] == QUOTE)
        q = np.searchsorted(self.quotes, left)
        shut = self.quotes[np.minimum(q + 1, max(len(self.quotes) - 1, 0))] if len(self.quotes) else np.zeros(len(k), np.int64)
        text = quoted & (q + 1 < len(self.quotes)) & (shut < at[b]) & (dark[np.minimum(shut + 1, size)] >= at[b])
        fine = np.where(empty, nothing, (key & text) | (value & text))
        plain = np.flatnonzero(~empty & value & ~quoted & ~bad[row[b]])
        for i in plain.tolist():
            fine[i] = _SCALAR.fullmatch(self.data[left[i] : at[b[i]]].tobytes()) is not None
        bad[row[b[~fine]]] = True
        return ~bad

    def _string(self, left: int, right: int) -> str | None:
        raw = self.data[left:right].tobytes()
        try:
            return raw.decode() if b"\\" not in raw else json.loads(b'"' + raw + b'"')
        except ValueError:
            return None

    def value(self, start: int, end: int) -> tuple[str | None, bool]:
        """The text of a scalar member, and whether it was quoted; None for null and broken strings."""
        raw = self.data[start:end].tobytes().strip(b" \t\r\n")
        if raw[:1] == b'"':
            return (self._string(start + self.data[start:end].tobytes().index(b'"') + 1, start + self.data[start:end].tobytes().rindex(b'"')), True) if len(raw) > 1 else (None, True)
        return (None, False) if raw in (b"null", b"") else (raw.decode(errors="replace"), False)


def _strict(text: str) -> bool:
    def refuse(_: str) -> None:
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return True


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(texts), np.uint8), ends - size, ends


def _list_rows(index: StructuralIndex, parent: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int, value_key: str, again: list[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
    """Child rows (parent, pos, value) of list-valued members; a quoted list goes to ``again``."""
    if not len(parent):
        return
    dark = index.next_dark[start]
    head = index.data[np.minimum(dark, len(index.data) - 1)]
    for k in np.flatnonzero((head == QUOTE) & (dark < end)):
        text, _ = index.value(start[k], end[k])
        if text is not None:
            again.append((int(parent[k]), text))
    lists, lone = np.flatnonzero(head == OPEN_LIST), np.flatnonzero(head == OPEN_OBJECT)
    groups = []
    if len(lists):
        opening = index.opened(dark[lists])
        closing = index.close(opening, depth)
        fine = closing >= 0
        lists, opening, closing = lists[fine], opening[fine], closing[fine]
        owner, pos, left, right = index.elements(opening, closing, depth)
        groups.append((parent[lists[owner]], pos, left, right, depth + 1))
    if len(lone):
        groups.append((parent[lone], np.zeros(len(lone), np.int64), start[lone], end[lone], depth))
    for own, pos, left, right, level in groups:
        at = index.next_dark[left]
        kind = index.data[at]
        for k in np.flatnonzero((kind != OPEN_OBJECT) & (kind != OPEN_LIST)):
            text, _ = index.value(left[k], right[k])
            if text is not None and text.strip():
                yield int(own[k]), int(pos[k]), text
        objects = np.flatnonzero(kind == OPEN_OBJECT)
        opening = index.opened(at[objects])
        closing = index.close(opening, level)
        fine = (opening >= 0) & (closing >= 0)
        objects, opening, closing = objects[fine], opening[fine], closing[fine]
        member, begin, finish = index.keyed(opening, closing, level, value_key)
        for k, b, f in zip(objects[member].tolist(), begin.tolist(), finish.tolist(), strict=True):
            text, _ = index.value(b, f)
            if text is not None and text.strip():
                yield int(own[k]), int(pos[k]), text


def json_children(texts: list[str | None], children: dict[str, str]) -> list[tuple[int, str, int, str]]:
    """Rows (number of the text, child, pos, value) of the lists ``children`` (list key: value key)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    index = StructuralIndex(*_buffer(raw))
    if not len(index.at):
        return []
    rows: list[tuple[int, str, int, str]] = []
    tops = index.tops()
    fit = np.flatnonzero(tops >= 0)
    fit = fit[index.char[tops[fit]] == OPEN_OBJECT]
    closing = index.close(tops[fit], 1)
    fit, closing = fit[closing >= 0], closing[closing >= 0]
    for list_key, value_key in children.items():
        again: list[tuple[int, str]] = []
        member, start, end = index.keyed(tops[fit], closing, 1, list_key)
        rows += [(p, list_key, pos, v) for p, pos, v in _list_rows(index, fit[member], start, end, 2, value_key, again)]
        if again:  # the list came as quoted JSON text: the same index over its decoded text
            inner = StructuralIndex(*_buffer([t.encode("utf-8", "surrogatepass") for _, t in again]))
            if len(inner.at):
                own = np.array([p for p, _ in again])
                sound = {k for k, (_, t) in enumerate(again) if _strict(t)}
                part = _list_rows(inner, np.arange(len(own)), inner.starts, inner.ends, 1, value_key, [])
                rows += [(int(own[k]), list_key, pos, v) for k, pos, v in part if k in sound]
    sound = index.sound()
    held = {k for k in {r[0] for r in rows} if sound[k] or _strict(texts[k])}  # a broken line has no children; what the index can't vouch for is parsed
    return [r for r in rows if r[0] in held]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    size, begin, total = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), 0, 0
    for k, n in enumerate(size):
        if total and total + n > SLICE_BYTES:
            yield begin, k
            begin, total = k, 0
        total += int(n)
    yield begin, len(size)


def flatten_json(df: DataFrame, children: dict[str, str], *, source: str, line: str = "line_no", text: str = "json_text") -> DataFrame:
    """One row for each non-blank child of the lists ``children`` in the JSON objects of ``text``.

    ``children`` maps a list's key to the key of its elements' value. A list may be an array of objects or
    of plain values, one lone object (pos 0), or such JSON quoted as a string; nulls keep their place.
    No rows: null or empty text, text that is not valid JSON or no object, an absent or null list, null or
    blank values. Numbers come as written. Of a key that occurs twice in one object the last counts.
    Equal lines under different ``line`` values all come out; other columns are not read. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, column = batch.column(0), batch.column(1)
            for a, b in _slices(column):
                rows = json_children(column.slice(a, b - a).to_pylist(), children)
                if rows:
                    own = lines.take(pa.array([a + r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([source] * len(rows)),
                            own.cast(pa.int64()),
                            pa.array([r[1] for r in rows]),
                            pa.array([r[2] for r in rows], pa.int32()),
                            pa.array([0] * len(rows), pa.int32()),
                            pa.array([r[3] for r in rows], pa.string()),
                        ],
                        schema=_ARROW,
                    )

    return df.select(df[line], df[text]).mapInArrow(run, CHILD_SCHEMA)


def _level(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A list column's index: of each element its parent's place, its own position, and the elements."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    parent = np.repeat(np.arange(len(size)), size)
    return parent, np.arange(size.sum()) - first[parent], column.flatten()


def flatten_fields(df: DataFrame, tags: list[str], *, source: str, line: str = "line_no", fields: str = "datafield") -> DataFrame:
    """One row for each non-blank subfield text of the repeated fields whose tag is in ``tags``.

    ``fields`` is ``array<struct<tag, .., subfield array<struct<code, text>>>>``. pos and sub_pos count all
    fields and subfields, null ones too. No rows: null or empty arrays, null structs, null or blank texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(tags)
        for batch in batches:
            parent, pos, field = _level(batch.column(1))
            if not len(field):
                continue
            by_name = dict(zip([f.name for f in field.type], field.flatten(), strict=True))
            hit = pc.fill_null(pc.is_in(by_name["tag"], wanted), False).to_numpy(zero_copy_only=False)
            place = np.flatnonzero(hit)
            outer, sub_pos, sub = _level(by_name["subfield"].take(pa.array(place)))
            if not len(sub):
                continue
            text = dict(zip([f.name for f in sub.type], sub.flatten(), strict=True))["text"]
            full = pc.fill_null(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0), False)
            kept = np.flatnonzero(full.to_numpy(zero_copy_only=False))
            own = place[outer[kept]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([source] * len(kept)),
                    batch.column(0).take(pa.array(parent[own])).cast(pa.int64()),
                    by_name["tag"].take(pa.array(own)),
                    pa.array(pos[own], pa.int32()),
                    pa.array(sub_pos[kept], pa.int32()),
                    text.take(pa.array(kept)),
                ],
                schema=_ARROW,
            )

    return df.select(df[line], df[fields]).mapInArrow(run, CHILD_SCHEMA)
