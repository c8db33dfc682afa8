"""The rules of what ends a sentence, compiled into tables: character classes, a lexicon automaton and decisions.

A lexicon automaton reads backwards from a stop and tells what kind of word stands before it; parities of marks and the
places of neighbouring characters come from scans over all characters. What a stop means is then one lookup by its features in the
table of decisions, which the rules fill once. Nothing here runs once a stop or once a character in Python.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# Sentence symbols: a block's start, a quotation opened after a colon or elsewhere, a sure end, and an end only if the quotation before it was opened after a colon.
NEW_BLOCK, OPEN_COLON, OPEN_PLAIN, ENDS, ENDS_AFTER_COLON = range(5)
NONE = 255

# Word lists made by hand: words that end in a stop which ends no sentence, those of them that stand before numbers, and those that may end one.
NEVER = (
    "Dr Drs Prof Mr Mrs Ms Mx St Sr Sra Srta Dra Hr Fr Frau Mme Mlle Mgr Dott Ing Gen Col Sgt Capt Rev Hon Jr Lt e.g i.e cf viz vs al "
    "bzw vgl evtl ggf inkl zzgl sog z.B d.h u.a z.T ca p.ej p.ex ej ex Sta D Da Uds Ud EE UU cap см См напр им ул д-р г-н т.е др.डॉ डॉ श्री د أ"
).split()
BEFORE_NUMBER = (
    "fig Fig figs Figs No no Nr nr n nº núm num p pp P S s Abb Kap Tab Bd Sec sec Secs Ch ch Chap chap vol Vol Art art approx Approx aprox Aprox ca Ca Env env pág Pág págs "
    "рис Рис гл Гл стр Стр с табл Табл п Eq eq Ref ref chap éd t Ziff Rn Nos"
).split()
MAY_END = "etc usw usf a.m p.m A.M P.M Inc Ltd Co Corp Bros ff f т.д т.п др пр u.s.w o.ä u.ä U.S U.K U.N гг г".split()
# A word list made by hand: German words after which a number with a stop is an ordinal.
ORDINAL_AFTER = "der die das dem den des am im vom zum zur beim ins jede jeder jedem jeden jedes Der Die Das Dem Den Des Am Im Vom Zum Zur Beim Jede Jeder Jedes".split()
#: Flags of words.
IS_NEVER, IS_BEFORE_NUMBER, IS_MAY_END, IS_ORDINAL_AFTER, IS_YEAR = 1, 2, 4, 8, 16
#: Characters of the longest word that may be an abbreviation.
WORD = 14

STOP, WIDE_STOP, DOT, ELLIPSIS, CLOSER, QUOTE, TWO_WAY, OPENER, SPACE, BLANK, ALPHA, UPPER, LOWER, DIGIT, SYMBOL, WORD_EDGE, STRIPPED, ALNUM, THAI, THAI_START, NAMED, NO_OPEN, OPENING, FOLLOWS_OPEN, PIERCING, FAR = (1 << i for i in range(26))
_CHARS = {
    STOP: ".!?…。！？؟।॥", WIDE_STOP: "。！？।॥", DOT: ".", ELLIPSIS: "…", CLOSER: "”’»\"“)]）】」』*_`", QUOTE: "”’»\"“」』", TWO_WAY: "“\"'*_`[",
    OPENER: "“„«「『\"'‘(（[`¿¡【*", WORD_EDGE: " \t\r\n  　([{（«“„\"'‘「『*_—:：", STRIPPED: "[]`,;", NO_OPEN: ".!?…。！？؟।,;", OPENING: "\"“„«「『",
    FOLLOWS_OPEN: "¿¡  ", PIERCING: "'*)",
}
#: Marks whose parity tells whether they close; what each also needs is in ``_closed``.
MARKS = '"`[*_'


def _bits(code: int) -> int:
    c = chr(code)
    bits = sum(bit for bit, chars in _CHARS.items() if c in chars)
    for bit, has in (
        (SPACE, c.isspace() or c == "​"), (BLANK, c.isspace()), (ALPHA, c.isalpha()), (UPPER, c.isupper() or c.istitle()), (LOWER, c.islower()), (DIGIT, c.isdigit()),
        (SYMBOL, unicodedata.category(c) in ("So", "Sc", "Lo", "Sm")), (ALNUM, c.isalnum()), (THAI, "ก" <= c <= "๎"), (THAI_START, "ก" <= c <= "ไ"),
        (NAMED, c.isalnum() or c == "_"), (FAR, code > 0x250),
    ):
        bits |= bit if has else 0
    return bits


class Classes:
    """Class bits of code points, found when first met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        bits = self.table[codes]
        if (missing := bits < 0).any():
            for code in np.unique(codes[missing]).tolist():
                self.table[code] = _bits(code)
            bits = self.table[codes]
        return bits


classes = Classes()


class Lexicon:
    """A deterministic automaton that reads words backwards; state 0 is of no listed word's end."""

    def __init__(self, lists: dict[int, list[str]]):
        letters = sorted({c for words in lists.values() for w in words for c in w})
        self.symbol = np.zeros(0x110000, np.int16)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        nodes: list[dict[int, int]] = [{}, {}]  # 0 leads nowhere, 1 is the start
        flags = [0, 0]
        for flag, words in lists.items():
            for word in words:
                at = 1
                for c in reversed(word):
                    s = int(self.symbol[ord(c)])
                    if s not in nodes[at]:
                        nodes[at][s] = len(nodes)
                        nodes.append({})
                        flags.append(0)
                    at = nodes[at][s]
                flags[at] |= flag
        self.after = np.zeros((len(nodes), len(letters) + 1), np.int16)
        for at, to in enumerate(nodes):
            for s, node in to.items():
                self.after[at, s] = node
        self.flags = np.array(flags, np.int16)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.after[state, self.symbol[codes]]


@cache
def lexicon() -> Lexicon:
    return Lexicon({IS_NEVER: NEVER, IS_BEFORE_NUMBER: BEFORE_NUMBER, IS_MAY_END: MAY_END, IS_ORDINAL_AFTER: ORDINAL_AFTER, IS_YEAR: ["г"]})


# Features of a stop, each with the number of its values; the table of decisions has an axis for each.
#: What follows: nothing that a sentence starts with, a capital, a small letter, a letter without case, a digit, an opening mark, a symbol.
OTHER_NEXT, CAPITAL, SMALL, CASELESS, NUMBER, OPENS, SIGN = range(7)
#: The run of stops: a single point, an ellipsis, one that ends in a doubled ellipsis sign, exclamation and question marks, wide ones, which may be last or only first.
POINT, DOTS, LONG_DOTS, MARKED, WIDE, WIDE_FIRST = range(6)
#: The word before a point that is followed by a space: plain, one that ends no sentence, before numbers, a single letter, the same before numbers, one that may end, an ordinal.
PLAIN_WORD, NEVER_WORD, NUMBER_WORD, LETTER, NUMBER_LETTER, ENDING_LETTER, ORDINAL = range(7)
#: The word before a point that is not: plain, or one before which a digit, a capital, or nothing goes on.
JOINED_DIGIT, JOINED_CAPITAL, JOINED_ALWAYS = 1, 2, 4


def _decision(run: int, after: int, spaced: bool, quoted: bool, closed: bool, word: int, joined: int) -> int:
    """The symbol of a stop, or NONE."""
    plain = ENDS_AFTER_COLON if quoted else ENDS
    caseless, opener = after == CASELESS, after == OPENS
    if after in (SMALL, OTHER_NEXT) and not (run == WIDE and not quoted and not closed and after == SMALL):
        return NONE
    if run in (DOTS, LONG_DOTS):
        sure = after == CAPITAL or opener or (after == NUMBER and spaced)
        return ENDS if sure and not (run == LONG_DOTS and not spaced and after != CAPITAL) else NONE
    if run in (WIDE, WIDE_FIRST):
        return ENDS if opener else plain
    if run == MARKED or closed:
        return plain if caseless else ENDS
    if not spaced:
        stops = joined & JOINED_ALWAYS or (after == NUMBER and joined & JOINED_DIGIT) or (after == CAPITAL and joined & JOINED_CAPITAL)
        return NONE if stops else ENDS
    if word in (NEVER_WORD, LETTER) or (word == NUMBER_LETTER) or (word == NUMBER_WORD and after != CAPITAL):
        return NONE
    return NONE if word == ORDINAL and after == CAPITAL else ENDS


@cache
def decisions() -> np.ndarray:
    """All decisions, by run, next character, space, quotation, closing marks, word and joined word."""
    shape = (6, 7, 2, 2, 2, 7, 8)
    table = np.empty(shape, np.uint8)
    for at in np.ndindex(shape):
        run, after, spaced, quoted, closed, word, joined = at
        table[at] = _decision(run, after, bool(spaced), bool(quoted), bool(closed), word, joined)
    return table


def _last(mask: np.ndarray) -> np.ndarray:
    """For each place the last one up to it, itself included, where the mask holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask), dtype=np.int32), np.int32(-1)))


def _next(mask: np.ndarray) -> np.ndarray:
    """For each place the first one from it on where the mask holds, or the length."""
    n = len(mask)
    return np.minimum.accumulate(np.where(mask, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]


class Scan:
    """Characters of a batch of texts, with what scans over them tell; the last one is a sentinel."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = classes(codes)
        self.to_ink = _next(self.bits & SPACE == 0)
        self.to_shown = _next(self.bits & BLANK == 0)
        self.ink = _last(self.bits & BLANK == 0)
        self.counts = {m: np.concatenate([[0], np.cumsum(codes == ord(m), dtype=np.int32)]) for m in MARKS if (codes == ord(m)).any()}

    def has(self, at: np.ndarray, bit: int) -> np.ndarray:
        return self.bits[at] & bit != 0

    def odd(self, mark: str, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether an odd number of the mark stands between."""
        if mark not in self.counts:
            return np.zeros(len(at), bool)
        return (self.counts[mark][at] - self.counts[mark][low]) % 2 == 1


def _closed(scan: Scan, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the closing marks from ``at`` on end, and whether there is a quotation mark among them."""
    at, quoted = at.copy(), np.zeros(len(at), bool)
    live = np.nonzero(at < high)[0]
    while len(live):
        p = at[live]
        c = scan.codes[p]
        two_way = scan.has(p, TWO_WAY)
        goes_on = scan.has(p + 1, ALNUM)
        even_mark = np.zeros(len(p), bool)
        for m in "`[*_":
            is_ = c == ord(m)
            if is_.any():
                even_mark[is_] = ~scan.odd(m, low[live][is_], p[is_])
        straight = c == ord('"')
        odd_straight = straight.copy()
        odd_straight[straight] = scan.odd('"', low[live][straight], p[straight])
        stops = (two_way & ((goes_on & ~odd_straight) | even_mark)) | (~two_way & ~scan.has(p, CLOSER))
        apart = ((c == 0xA0) | (c == 0x202F)) & (scan.codes[p + 1] == ord("»"))
        live, p = live[~stops | apart], p[~stops | apart]
        apart = apart[~stops | apart]
        quoted[live] |= scan.has(p, QUOTE) | apart
        at[live] = p + 1 + apart
        live = live[at[live] < high[live]]
    return at, quoted


def _words(scan: Scan, low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the word before each place, as far as WORD characters."""
    start = at.copy()
    live = np.arange(len(at))
    for _ in range(WORD):
        live = live[start[live] > low[live]]
        live = live[~scan.has(start[live] - 1, WORD_EDGE)]
        start[live] -= 1
    return start, at


def _read(scan: Scan, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States of the lexicon after reading each stretch backwards."""
    lex, state = lexicon(), state.copy()
    for k in range(int((end - start).max(initial=0))):
        live = np.nonzero((end - 1 - k >= start) & (state > 0))[0]
        state[live] = lex.step(state[live], scan.codes[end[live] - 1 - k])
    return state


def _points(scan: Scan, low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of the words before single points at ``at``: as followed by a space, and as joined."""
    n = len(at)
    start, end = _words(scan, low, at)
    for _ in range(WORD):
        start = np.where((start < end) & scan.has(start, STRIPPED), start + 1, start)
    for _ in range(WORD):
        end = np.where((start < end) & scan.has(end - 1, STRIPPED), end - 1, end)
    flags = lexicon().flags
    first = np.ones(n, np.int64)
    known = flags[_read(scan, start, end, first)]
    size = end - start
    # the part after the last point within the word
    part, has_point = start.copy(), np.zeros(n, bool)
    for k in range(WORD):
        p = end - 1 - k
        inside = (p >= start) & ~has_point
        hit = inside & (scan.codes[np.maximum(p, 0)] == ord("."))
        part[hit] = p[hit] + 1
        has_point |= hit
    letter = (end - part == 1) & scan.has(np.maximum(end - 1, 0), ALPHA)
    of_part = flags[_read(scan, part, end, first)]
    # parts of an abbreviation may stand apart: a letter after spaces after a point
    whole = known.copy()
    years = known & IS_YEAR != 0
    near = at - 1  # the letter
    gap_end = np.where(near > low, scan.ink[np.maximum(near - 1, 0)], near - 1)
    gap_end = np.maximum(gap_end, low - 1)
    apart = letter & ~has_point & (gap_end < near - 1) & (gap_end >= low) & (scan.codes[np.maximum(gap_end, 0)] == ord("."))
    if apart.any():
        k = np.nonzero(apart)[0]
        state = _read(scan, np.maximum(end[k] - 1, 0), end[k], first[k])
        state = lexicon().step(state, np.full(len(k), ord("."))) * (state > 0)
        s, e = _words(scan, low[k], gap_end[k])
        whole[k] = flags[_read(scan, s, e, state)]
        years[k] = False
    number_before = (gap_end >= low) & scan.has(np.maximum(gap_end, 0), DIGIT)
    ending = (whole & IS_MAY_END != 0) & ~(years & ~number_before)
    # a short number after a German article
    digits = (size > 0) & (size < 3)
    for k in range(2):
        digits &= (k >= size) | scan.has(np.maximum(end - 1 - k, 0), DIGIT)
    ordinal = np.zeros(n, bool)
    if digits.any():
        k = np.nonzero(digits)[0]
        before = at[k] - size[k]
        e = np.where(before > low[k], np.maximum(scan.ink[np.maximum(before - 1, 0)], low[k] - 1) + 1, before)
        s, e = _words(scan, low[k], e)
        ordinal[k] = flags[_read(scan, s, e, first[k])] & IS_ORDINAL_AFTER != 0
    never = known & IS_NEVER != 0
    word = np.select(
        [never, letter & ending, letter & (of_part & IS_BEFORE_NUMBER != 0), letter, known & IS_BEFORE_NUMBER != 0, ordinal],
        [NEVER_WORD, ENDING_LETTER, NUMBER_LETTER, LETTER, NUMBER_WORD, ORDINAL], PLAIN_WORD,
    )
    # joined: what follows without a space
    last = np.maximum(end - 1, 0)
    alpha = (size > 0) & scan.has(last, ALPHA)
    before_stop = np.maximum(at - 1, 0)
    all_alpha = size > 0
    for k in range(3):
        all_alpha &= (k >= size) | scan.has(np.maximum(end - 1 - k, 0), ALPHA)
    no_digit = ((at > 0) & scan.has(before_stop, DIGIT)) | (size < 3) | ~alpha | (known & IS_BEFORE_NUMBER != 0)
    no_capital = (size < 2) | (has_point & (known & IS_MAY_END == 0)) | (scan.has(before_stop, UPPER) & (size < 4) & all_alpha) | never
    joined = no_digit * JOINED_DIGIT | no_capital * JOINED_CAPITAL | ((size < 2) | never) * JOINED_ALWAYS
    return word, joined


def symbols(scan: Scan, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(block, symbol, place)`` of all that may end a sentence or opens a quotation in the given blocks, in order; they don't overlap."""
    codes, bits = scan.codes, scan.bits
    block = np.zeros(len(codes) + 1, np.int32)
    block[starts] = 1
    of = np.cumsum(block)[:-1] - 1  # the block that started last
    inside = (of >= 0) & (np.arange(len(codes)) < stops[np.maximum(of, 0)])
    found: list[tuple[np.ndarray, ...]] = []
    # runs of stops
    is_stop = inside & (bits & STOP != 0)
    edge = np.zeros(len(codes), bool)
    edge[starts] = True
    a = np.nonzero(is_stop & (edge | ~np.concatenate([[False], is_stop[:-1]])))[0]
    if len(a):
        b = np.minimum(_next(~is_stop)[a], np.concatenate([a[1:], [len(codes)]]))
        low, high = starts[of[a]], stops[of[a]]
        b = np.minimum(b, high)
        closed, quoted = _closed(scan, low, high, b)
        n = np.minimum(scan.to_ink[np.minimum(closed, len(codes) - 1)], high)
        live = n < high
        a, b, low, high, closed, quoted, n = (x[live] for x in (a, b, low, high, closed, quoted, n))
        nb, after_n = bits[n], bits[np.minimum(n + 1, len(codes) - 1)]
        alpha = nb & ALPHA != 0
        capital = alpha & ((nb & UPPER != 0) | ((nb & LOWER != 0) & (after_n & UPPER != 0) & (after_n & ALPHA != 0)))
        small = alpha & ~capital & (nb & LOWER != 0)
        after = np.select([capital, small, alpha, nb & DIGIT != 0, nb & OPENER != 0, nb & SYMBOL != 0], [CAPITAL, SMALL, CASELESS, NUMBER, OPENS, SIGN], OTHER_NEXT)
        spaced = n > closed
        size = b - a
        dots = np.concatenate([[0], np.cumsum(codes == ord("."), dtype=np.int32)])
        signs = np.concatenate([[0], np.cumsum(codes == ord("…"), dtype=np.int32)])
        double = np.concatenate([[0], np.cumsum((codes[1:] == ord("…")) & (codes[:-1] == ord("…")), dtype=np.int32), [0]])
        all_dots, any_sign = dots[b] - dots[a] == size, signs[b] > signs[a]
        dotted = any_sign | ((size > 1) & all_dots)
        long_dots = dotted & (codes[b - 1] == ord("…")) & (double[b - 1] > double[a])
        run = np.select(
            [long_dots, dotted, bits[b - 1] & WIDE_STOP != 0, bits[a] & WIDE_STOP != 0, ~all_dots], [LONG_DOTS, DOTS, WIDE, WIDE_FIRST, MARKED], POINT
        )
        word, joined = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        point = np.nonzero((run == POINT) & (closed == b))[0]
        if len(point):
            word[point], joined[point] = _points(scan, low[point], a[point])
            odd = (nb[point] & PIERCING != 0) | ((after[point] == CASELESS) & (nb[point] & FAR == 0))
            joined[point] |= np.where(odd, JOINED_ALWAYS, 0)
        s = decisions()[run, after, spaced.astype(int), quoted.astype(int), (closed > b).astype(int), word, joined]
        ends = s != NONE
        found.append((of[a[ends]], s[ends], closed[ends], a[ends]))
    # quotations
    marks = np.nonzero(inside & ((bits & OPENING != 0) | (codes == ord("‘"))))[0]
    if len(marks):
        p = np.where(marks > 0, scan.ink[np.maximum(marks - 1, 0)], -1)
        colon = (p >= starts[of[marks]]) & ((codes[np.maximum(p, 0)] == ord(":")) | (codes[np.maximum(p, 0)] == ord("：")))
        before, behind = bits[np.maximum(marks - 1, 0)], bits[np.minimum(marks + 1, len(codes) - 1)]
        first = marks == 0
        behind_in = marks + 1 < stops[of[marks]]
        opens = ~colon & (bits[marks] & OPENING != 0) & (first | (before & (NAMED | NO_OPEN) == 0)) & behind_in & (behind & (NAMED | FOLLOWS_OPEN) != 0)
        kept = colon | opens
        place = np.where(colon, p, marks)[kept]
        found.append((of[marks[kept]], np.where(colon, OPEN_COLON, OPEN_PLAIN)[kept].astype(np.uint8), place, place))
    # spaces between Thai letters
    thai = inside & (bits & THAI != 0)
    if thai.any():
        at = np.nonzero(thai)[0]
        at = at[at + 1 < len(codes)]
        to = scan.to_ink[at + 1]
        gap = (to > at + 1) & (to < stops[of[at]]) & (bits[np.minimum(to, len(codes) - 1)] & THAI_START != 0) & (codes[at + 1] != 0x200B)
        found.append((of[at[gap]], np.full(int(gap.sum()), ENDS, np.uint8), at[gap] + 1, at[gap] + 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    block_of, symbol, place, order = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(order, kind="stable")
    return block_of[order], symbol[order], place[order]
