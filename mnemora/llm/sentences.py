"""Sentences of texts in many languages and scripts.

Transducers read a whole batch of texts, one on what the other gives. The first reads lines and knows in which lines units start,
go on or don't stand (front matter, fenced code, tables, rules). The rules of stops are compiled into tables that are
looked up for all stops at once, see boundaries. The last reads what may end a sentence, with the quotations around it. Those with
states run as compositions of the transition functions of chunks, see transducer.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.boundaries import ALPHA, NEW_BLOCK, Scan, symbols
from mnemora.llm.markup import FIRST_ITEM, GAP, ITEM, RULE, TURN
from mnemora.llm.transducer import states_before

#: Bytes of texts that are read at once, about; a longer text is read by itself.
TOGETHER = 1 << 20

# Line symbols.
PLAIN, BLANK, TICKS, TICKS_INFO, TILDES, TILDES_INFO, HEADING, TABLE, QUOTE, FIRST, OTHER, LINE_RULE, SPEAKER, INDENT, DASHES, OPENING, NEW_TEXT = range(17)
# Line states: outside any block, in front matter, in fences, in a paragraph, item or turn, in a quotation.
OUTSIDE, FRONT, IN_TICKS, IN_TILDES, IN_TEXT, IN_QUOTE = range(6)


def _line_table() -> tuple[np.ndarray, np.ndarray]:
    """After-state by symbol and state, and what the line is: 0 no part of a unit, 1 the start of a block, 2 its continuation."""
    after, part = np.zeros((17, 6), np.uint8), np.zeros((17, 6), np.uint8)
    for s in range(17):
        for q in range(6):
            if s == NEW_TEXT:
                to, is_ = OUTSIDE, 0
            elif q == FRONT:
                to, is_ = (OUTSIDE if s == DASHES else FRONT), 0
            elif q == IN_TICKS:
                to, is_ = (OUTSIDE if s == TICKS else IN_TICKS), 0
            elif q == IN_TILDES:
                to, is_ = (OUTSIDE if s == TILDES else IN_TILDES), 0
            elif s == OPENING:
                to, is_ = FRONT, 0
            elif s in (TICKS, TICKS_INFO):
                to, is_ = IN_TICKS, 0
            elif s in (TILDES, TILDES_INFO):
                to, is_ = IN_TILDES, 0
            elif s in (BLANK, TABLE, LINE_RULE, DASHES):
                to, is_ = OUTSIDE, 0
            elif s == HEADING:
                to, is_ = OUTSIDE, 1
            elif s == QUOTE:
                to, is_ = IN_QUOTE, (2 if q == IN_QUOTE else 1)
            elif s in (FIRST, SPEAKER, INDENT):
                to, is_ = IN_TEXT, 1
            elif s == OTHER:  # a line that starts with a number, which is an item only where no wrapped line goes on
                to, is_ = IN_TEXT, 1
            else:
                to, is_ = (q if q == IN_QUOTE else IN_TEXT), (2 if q in (IN_TEXT, IN_QUOTE) else 1)
            after[s, q], part[s, q] = to, is_
    return after, part


LINE_AFTER, LINE_PART = _line_table()

# States: the last quotation of the sentence, if any, was opened after a colon, or not.
NOT_COLON, COLON = range(2)
SENTENCE_AFTER = np.array([[NOT_COLON, NOT_COLON], [COLON, COLON], [NOT_COLON, NOT_COLON], [NOT_COLON, NOT_COLON], [NOT_COLON, NOT_COLON]], np.uint8)
SENTENCE_ENDS = np.array([[0, 0], [0, 0], [0, 0], [1, 1], [0, 1]], np.uint8)

_FENCE = re.compile(f"{GAP}*(```+|~~~+){GAP}*(\\S?)")
_MARK = re.compile(f"{GAP}*(?:{ITEM}(?:{GAP}*\\[[ xX]\\](?={GAP}))?{GAP}*)")
_FIRST = re.compile(f"{GAP}*{FIRST_ITEM}")
_HEADING = re.compile(r" {0,3}#{1,6}[ \t ]+")
_QUOTE = re.compile(f"{GAP}*(?:>{GAP}?)+{GAP}*")
_RULE = re.compile(f" {{0,3}}{RULE}\\s*\\Z")
_TURN = re.compile(f"{GAP}*{TURN}")
_DASHES = re.compile(r"﻿?---[ \t]*[\r\n]*\Z")
_TURN_STARTS = {x for s in re.findall(r"[^|()?:\\*\[\]  ：]+", TURN) if (x := s[0]).isalpha()}
_TURN_CODES = np.array([ord(c) for c in _TURN_STARTS])


def _symbol(line: str, first: bool) -> tuple[int, int]:
    """The line's symbol, and how many characters of marks it starts with."""
    c = line[:1]
    if c.isalpha() and c not in _TURN_STARTS:
        return PLAIN, 0
    if not (body := line.strip(" \t\r\n 　​")):
        return BLANK, 0
    if first and _DASHES.match(line):
        return OPENING, 0
    c = body[0]
    if c in "`~" and (m := _FENCE.match(line)):
        return ((TICKS_INFO if m[2] else TICKS) if m[1][0] == "`" else (TILDES_INFO if m[2] else TILDES)), 0
    if c in "-*_" and _RULE.match(line):
        return (DASHES if _DASHES.match(line) else LINE_RULE), 0
    if c == "#" and (m := _HEADING.match(line)):
        return HEADING, m.end()
    if c == "|":
        return TABLE, 0
    if c == ">" and (m := _QUOTE.match(line)):
        return QUOTE, m.end()
    if (c in "-*+•" or c.isdigit()) and (m := _MARK.match(line)):
        return (FIRST if _FIRST.match(line) else OTHER), m.end()
    if c in _TURN_STARTS or c == "*":
        if _TURN.match(line):
            return SPEAKER, 0
    return (INDENT if line[0] in " \t 　" else PLAIN), 0


def _blocks(texts: list[str | None], scan: Scan, offsets: list[int]) -> list[list[int]]:
    """``[start, end, symbol]`` of every block that holds units, in order, by places in the batch."""
    codes = scan.codes
    breaks = (codes == 10) | ((codes == 13) & (np.append(codes[1:], 0) != 10))
    first = np.zeros(len(codes) + 1, bool)
    first[1:] = breaks
    begins = np.array([o for o, t in zip(offsets, texts) if t], np.int64)
    if not len(begins):
        return []
    first[begins] = True
    over = np.array([o + len(t or "") for o, t in zip(offsets, texts)], np.int64)
    first[over] = False  # separators start no line
    starts = np.nonzero(first[:-1])[0]
    owner = np.searchsorted(np.array(offsets), starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(codes)), over[owner])
    plain = (scan.bits[starts] & ALPHA != 0) & ~np.isin(codes[starts], _TURN_CODES)
    symbols, marks = np.full(len(starts), PLAIN), np.zeros(len(starts), np.int64)
    for k in np.nonzero(~plain)[0].tolist():
        i, o = owner[k], offsets[owner[k]]
        symbols[k], marks[k] = _symbol(texts[i][starts[k] - o : ends[k] - o], starts[k] == o)
    # every text starts anew
    new = np.searchsorted(owner, np.unique(owner))
    line = np.insert(symbols, new, NEW_TEXT)
    parts = np.delete(LINE_PART[line, states_before(LINE_AFTER, line)], new + np.arange(len(new)))
    blocks: list[list[int]] = []
    numbered, last = False, -1
    kept = np.nonzero(parts)[0]
    for i, part, symbol, a, marked, b in zip(*(x[kept].tolist() for x in (owner, parts, symbols, starts, marks, ends))):
        # a line that starts with a number above 1 goes on with a paragraph, unless the block is a list
        if part == 1 and symbol == OTHER and blocks and not numbered and last == i and blocks[-1][1] == a and blocks[-1][2] in (PLAIN, SPEAKER, INDENT):
            blocks[-1][1] = b
        elif part == 1:
            blocks.append([a + marked, b, symbol])
            numbered, last = symbol in (FIRST, OTHER), i
        else:
            blocks[-1][1] = b
    return blocks


def split(texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
    """Text number, start and end of every unit, in order."""
    sizes = [len(t or "") + 1 for t in texts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    codes = np.frombuffer("".join((t or "") + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return [], [], []
    scan = Scan(codes)
    blocks = _blocks(texts, scan, offsets[:-1])
    if not blocks:
        return [], [], []
    start, end, kind = np.array(blocks, np.int64).T
    of, symbol, place = symbols(scan, start, end)
    told = kind[of] != HEADING
    of, symbol, place = of[told], symbol[told], place[told]
    at = np.searchsorted(of, np.arange(len(blocks)))
    event = np.insert(symbol.astype(np.intp), at, NEW_BLOCK)
    ends = np.delete(SENTENCE_ENDS[event, states_before(SENTENCE_AFTER, event)], at + np.arange(len(at))) > 0
    cuts = np.unique(np.concatenate([start, place[ends & (place > start[of]) & (place < end[of])]]))
    block = np.searchsorted(start, cuts, "right") - 1
    stop = np.minimum(np.append(cuts[1:], len(codes)), end[block])
    for k in np.nonzero(kind[block] == HEADING)[0].tolist():  # closing marks
        i = bisect_right(offsets, int(cuts[k])) - 1
        piece = texts[i][cuts[k] - offsets[i] : stop[k] - offsets[i]].rstrip()
        if piece.endswith((" #", "##")):
            stop[k] = cuts[k] + len(piece.rstrip("#"))
    left = scan.to_shown[np.minimum(cuts, len(codes) - 1)]
    right = scan.ink[stop - 1] + 1
    kept = left < right
    number = np.searchsorted(offsets, left[kept], "right") - 1
    base = np.array(offsets)[number]
    return number.tolist(), (left[kept] - base).tolist(), (right[kept] - base).tolist()


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start_pos, end_pos)``: the sentence units of every text, in code points, the end exclusive.

    A null, empty or blank text has none. Repeated rows give repeated units. Reads two columns, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts = np.nonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // TOGETHER))[0] + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(i, j - i)
                number, starts, ends = split(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(number, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [id_col, "start_pos", "end_pos"])

    narrow = docs.select(F.col(id_col), F.col(text_col))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, start_pos int, end_pos int")
