"""Defects of prompt and response pairs.

Three models are fitted on counts of all rows: a naive Bayes model of languages on character n-grams, one
of answers that decline on word n-grams, and a model of how likely a text is to end after its last characters. Every pair is
then judged by itself, next to its ground truth.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm import grams
from mnemora.runtime import durable

#: Longest context of the model of ends, and how often a context must have been seen.
#: And how much of a longer text without a final stop must have been seen before.
CONTEXT, SEEN_LEAST, KNOWN = 14, 4, 9
#: Below this chance a text can't end so; above this log ratio a pair is in two languages, or an answer declines.
ENDS_LEAST, FOREIGN_LEAST, DECLINES_LEAST = 0.06, 4.0, 0.0
_STOPS = ".!?。！？؟।…"
_CLOSERS = "”’»\"“)]）】」』*_`'>"
# Word lists made by hand: what stands for an answer without being one, and labels that lead one.
PLACEHOLDERS = {
    "null", "nil", "na", "n a", "nan", "undefined", "tbd", "todo", "to do", "empty", "placeholder", "lorem ipsum", "answer", "response",
    "your answer here", "insert answer here", "answer here", "no answer", "not available",
}
LABELS = ("answer", "response", "assistant", "réponse", "respuesta", "antwort", "resposta", "answer text", "回答", "答案", "答", "助手", "output", "result", "final answer", "a")


def normal(text: str | None) -> str:
    """Letters, marks and digits of a text in compatibility form and without case, words apart by single spaces."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return re.sub(r"[\W_]+", " ", folded).strip()


class WordBayes:
    """Naive Bayes with additive smoothing over words of texts."""

    def __init__(self, alpha: float):
        self.alpha, self.counts, self.totals, self.texts = alpha, defaultdict(Counter), Counter(), Counter()

    def add(self, label: str, features: list[str]) -> None:
        self.counts[label].update(features)
        self.totals[label] += len(features)
        self.texts[label] += 1

    def freeze(self) -> WordBayes:
        """Turns counts into the logs of each word for each label; None is of unknown words."""
        self.labels = sorted(self.counts)
        known = dict.fromkeys(f for c in self.counts.values() for f in c)
        size = [self.totals[x] + self.alpha * (len(known) + 1) for x in self.labels]
        self.logs = {f: [log((self.counts[x][f] + self.alpha) / n) for x, n in zip(self.labels, size)] for f in known}
        self.logs[None] = [log(self.alpha / n) for n in size]
        self.counts = self.totals = None
        return self

    def logliks(self, features: list[str]) -> list[float]:
        """Of each label."""
        unknown = self.logs[None]
        return [sum(x) for x in zip(*(self.logs.get(f, unknown) for f in features))]


#: A text whose n-grams are this much less likely in its best language, in logs, than those of the median text may be in none of them.
ODD = 1.4
#: It is, if the n-grams that the language lacks stand so many times as often with questions of other languages.
ELSEWHERE = 3.0
#: Texts of fewer n-grams don't tell whether they are odd.
TELLING = 40
#: By what an n-gram another language must explain an answer better at first, in logs, for it not to count for its question's.
LEAVES = 0.12
OTHER = "other"
#: N-grams that all labelled texts of a language count as at most, so that smoothing favours no language for having few.
LABELLED_WEIGHT = 600_000


class Languages:
    """Languages of questions and answers by character n-grams.

    Labelled texts name the languages of the questions. These give a model of each; every question and answer then counts for the
    language that explains it best, or its question's if that does nearly as well. Texts that none explains well, in words that stand
    mostly with questions of other languages, make up one more language, which no question is in.
    """

    def __init__(self, labelled: list[tuple[str, str]], pairs: list[tuple[str, str | None]]):
        self.model = grams.Bayes()
        self.asking: set[str] = set()
        texts = list(dict.fromkeys(t for pair in pairs for t in pair if t))
        if labelled and texts:
            at = {t: i for i, t in enumerate(texts)}
            found, of = grams.keys(texts)
            split = _each(found, of, len(texts))
            of_labelled = _each(*grams.keys([t for _, t in labelled]), len(labelled))
            first, seeds = grams.Bayes(), grams.Bayes()
            for (label, _), g in zip(labelled, of_labelled):
                first.add(label, g)
            guess = first.freeze().logliks(found, of, len(texts)).argmax(1)
            known = {q: first.labels[guess[at[q]]] for q, _ in pairs}
            named = set(known.values())
            for (label, _), g in zip(labelled, of_labelled):
                if label in named:
                    seeds.add(label, g)
            for q, label in known.items():
                seeds.add(label, split[at[q]])
            seeds.freeze()
            values = seeds.logliks(found, of, len(texts))
            n = np.maximum(1, [len(g) for g in split])
            best = values.argmax(1)
            asked = np.full(len(texts), -1)  # the language of a question that a text stands with, the one that suits it best
            for q, a in pairs:
                for t, j in ((q, seeds.labels.index(known[q])), *(((a, seeds.labels.index(known[q])),) if a else ())):
                    if asked[at[t]] < 0 or values[at[t], j] > values[at[t], asked[at[t]]]:
                        asked[at[t]] = j
            stays = (values.max(1) - values[np.arange(len(texts)), asked]) < LEAVES * n
            best = np.where(stays, asked, best)
            rate = values[np.arange(len(texts)), best] / n
            telling = n >= TELLING
            for j, label in enumerate(seeds.labels):
                inside = np.nonzero(telling & (best == j))[0]
                if not len(inside):
                    continue
                usual = np.median(rate[inside])
                # n-grams of scripts without spaces are too many to tell
                odd = [i for i in inside.tolist() if rate[i] < usual - ODD and sum(c > "\u2e80" for c in grams.letters(texts[i])) * 12 < len(split[i])]
                other = _elsewhere([split[i] for i in odd], asked[odd] == j, seeds, j)
                strange = {i for i, x in zip(odd, other) if x}
                for i in inside.tolist():
                    self.model.add(OTHER if i in strange else label, split[i])
        self.model.freeze()

    def learn(self, rows: list[tuple]) -> None:
        """How questions end that ask for another language: those with such truths."""
        known = [(q, t) for i, q, t, f, *_ in rows if q and t and not is_abstention(i, f)]
        apart = self.apart(self.posteriors([q for q, _ in known], asked=True), self.posteriors([t for _, t in known]))
        seen = Counter(_tail_words(q) for (q, _), x in zip(known, apart) if x > FOREIGN_LEAST)
        self.asking = {w for w, n in seen.items() if n >= 2}

    def asks(self, question: str) -> bool:
        return _tail_words(question) in self.asking

    def posteriors(self, texts: list[str], asked: bool = False) -> np.ndarray:
        """Log chance of each language for each text, a row each; all alike for a text without letters."""
        values = self.model.logliks(*grams.keys(texts), len(texts)) if texts else np.zeros((0, len(self.model.labels)))
        if asked and OTHER in self.model.labels and len(self.model.labels) > 1:
            values[:, self.model.labels.index(OTHER)] = -np.inf
        return values - _log_sum(values)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How unlikely it is that two texts are in one language: minus the log of the chance, 0 where one has no letters."""
        if not a.shape[1]:
            return np.zeros(len(a))
        tell = (np.ptp(np.where(np.isinf(a), a.max(1, keepdims=True), a), axis=1) > 0) & (np.ptp(b, axis=1) > 0)
        return np.where(tell, -_log_sum(a + b)[:, 0], 0.0)


def _elsewhere(texts: list[np.ndarray], same: np.ndarray, seeds: grams.Bayes, language: int) -> list[bool]:
    """Whether the n-grams of each text that the language lacks stand with questions of other languages, mostly."""
    lacked = [_lacked(g, seeds, language) for g in texts]
    if not lacked:
        return []
    every = np.unique(np.concatenate(lacked))
    counts = np.full((2, len(every)), 0.5)
    for g, x in zip(lacked, same):
        counts[int(x), np.searchsorted(every, g)] += 1
    ratio = np.log(counts[0] / counts[1])
    return [bool(len(g)) and float(ratio[np.searchsorted(every, g)].mean()) > log(ELSEWHERE) for g in lacked]


def _lacked(g: np.ndarray, seeds: grams.Bayes, language: int) -> np.ndarray:
    g = np.unique(g)
    at = np.minimum(np.searchsorted(seeds.known, g), max(0, len(seeds.known) - 1))
    return g[(seeds.known[at] != g) | (seeds.logs[at, language] <= seeds.logs[-1, language])]


def _each(found: np.ndarray, of: np.ndarray, texts: int) -> list[np.ndarray]:
    return np.split(found, np.searchsorted(of, np.arange(1, texts)))


def _log_sum(values: np.ndarray) -> np.ndarray:
    if not values.shape[1]:
        return np.zeros((len(values), 1))
    top = values.max(1, keepdims=True)
    return top + np.log(np.exp(values - top).sum(1, keepdims=True))


def _tail_words(question: str) -> str:
    """The last two words outside quotations."""
    return " ".join(normal(re.sub(r"[“\"«„「].*?[”\"»“」]", " ", question)).split()[-2:])


_START, _OVER = "\x02", "\x03"
#: An abbreviation, whose stops are none of a sentence; they are read as a letter of their own.
_ABBREVIATION = re.compile(r"(?:\b(?:[^\W\d_]\. ?){2,}|\b(?:no|nr|vs|cf|approx|fig|p\. ?ej|p\. ?ex)\.)", re.IGNORECASE)
_INNER = "·"


def _in(c: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(c, np.array([ord(x) for x in chars], np.uint64))


class Ends:
    """How likely a text is to end after its last characters, by the longest context seen often enough."""

    def __init__(self, texts: list[tuple[str, bool]]):
        """From texts and whether they are known to be complete; the end of any other counts only after a final mark."""
        found, seen, ended = [], [], []
        for keys, number, over, whole in self.contexts(texts):
            kept = whole | (number >= SEEN_LEAST)
            found.append(keys[kept])
            seen.append(number[kept])
            ended.append(over[kept])
        self._sorted(np.concatenate(found), np.concatenate(seen), np.concatenate(ended))

    def _sorted(self, found: np.ndarray, seen: np.ndarray, ended: np.ndarray) -> Ends:
        order = np.argsort(found, kind="stable")
        self.found, self.seen, self.ended = found[order], seen[order], ended[order]
        return self

    @classmethod
    def contexts(cls, texts: list[tuple[str, bool]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the keys of contexts, how often they were seen and ended, and which are a text from its start."""
        plain = [(cls._plain(t), complete) for t, complete in texts]
        folded = [t.casefold() for t, _ in plain]
        shown = [t if len(t) == len(f) else f for (t, _), f in zip(plain, folded)]
        t, n = grams.codes([_START + x + _OVER for x in folded])
        r = np.concatenate([grams.codes([_START + x + _OVER for x in shown])[0], np.zeros(2, np.uint64)])
        complete = np.repeat([c for _, c in plain], n) if texts else np.zeros(0, bool)
        at = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)  # place within its text
        c, p, after, later = r[:-2], np.concatenate([[np.uint64(0)], r[:-3]]), r[1:-1], r[2:]
        u = np.unique(r)
        upper = np.array([chr(x).isupper() for x in u.tolist()])
        is_upper = lambda x: upper[np.searchsorted(u, x)]
        over, space = c == ord(_OVER), c == 32
        sure = _in(c, "。！？।") | _in(p, "。！？।")
        stop = _in(c, ".!?؟") & ((after == ord(_OVER)) | (after == 10) | ((after == 32) & is_upper(later)))
        ends = np.where(c == 10, ~_in(p, ":：,，"), sure | stop | (_in(p, ".!?؟…”»") & space & is_upper(after)))
        ends |= over
        counts = (at >= 1) & (~over | complete | _in(p, _STOPS + _CLOSERS))
        # keys of the n characters before each place
        h = np.zeros(len(t), np.uint64)
        for k in range(1, CONTEXT + 1):
            h = np.concatenate([np.zeros(1, np.uint64), grams.chained(h[:-1], t[:-1])]) if len(t) else h
            valid = counts & (at >= k)
            keys, inverse, number = np.unique(h[valid], return_inverse=True, return_counts=True)
            whole = np.zeros(len(keys), bool)
            whole[inverse[at[valid] == k]] = True
            yield keys, number, np.bincount(inverse, ends[valid], len(keys)), whole

    @staticmethod
    def _plain(text: str) -> str:
        t = re.sub(r"[ \t\u00a0\u202f]+", " ", re.sub(r"\d+", "0", unicodedata.normalize("NFC", text).strip()))
        return _ABBREVIATION.sub(lambda m: m[0].replace(".", _INNER), t)

    def chances(self, texts: list[str]) -> list[float]:
        """The chance of each; none for a text without a stop that ends in a word never seen there."""
        whole = [_START + self._plain(t).casefold() for t in texts]
        seen, share = np.zeros((len(texts), CONTEXT + 1)), np.zeros((len(texts), CONTEXT + 1))
        for n, h in enumerate(self._last(whole), 1):
            if len(self.found):
                at = np.minimum(np.searchsorted(self.found, h), len(self.found) - 1)
                hit = self.found[at] == h
                seen[:, n] = np.where(hit, self.seen[at], 0)
                share[:, n] = np.where(hit, self.ended[at] / self.seen[at], 0)
        return [self._chance(t, s, e) for t, s, e in zip(whole, seen.tolist(), share.tolist())]

    @staticmethod
    def _last(whole: list[str]) -> Iterator[np.ndarray]:
        """Keys of the last characters of each text, one, two and so on."""
        last = np.array([[ord(c) for c in t[-CONTEXT:].rjust(CONTEXT, "\0")] for t in whole], np.uint64).reshape(-1, CONTEXT)
        for n in range(1, CONTEXT + 1):
            h = np.zeros(len(whole), np.uint64)
            for k in range(CONTEXT - n, CONTEXT):
                h = grams.chained(h, last[:, k])
            yield h

    @classmethod
    def asked(cls, texts: list[str]) -> np.ndarray:
        """Keys that ``chances`` of the texts looks up."""
        return np.unique(np.concatenate(list(cls._last([_START + cls._plain(t).casefold() for t in texts]))))

    @staticmethod
    def _chance(t: str, seen: list[float], share: list[float]) -> float:
        word = re.search(r"[^\W\d]+$", t)
        for n in range(min(CONTEXT, len(t)), 0, -1):
            if seen[n] >= (1 if n == len(t) else SEEN_LEAST):
                # without a stop, complete texts end in words that were seen together
                if word and len(t) > 30 and n < (max(KNOWN, min(len(word[0]) + 1, CONTEXT)) if t[-1] < "\u2e80" else 3):
                    return 0.0
                return share[n]
        return 0.0 if (word and len(t) > 30) or t[-1:] in ",;:(（[，、：" + _INNER else 0.5


def _words(text: str) -> list[str]:
    """Words and pairs of them, without digits; of scripts without spaces, pairs and triples of characters."""
    t = re.sub(r"\d+", "0", normal(text))
    words = [w for w in t.split() if w.isascii() or not re.search(r"[฀-໿぀-ヿ㐀-鿿]", w)]
    runs = re.findall(r"[฀-໿぀-ヿ㐀-鿿]+", t)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])] + [r[i : i + n] for r in runs for n in (2, 3) for i in range(len(r) - n + 1)]


class Declines:
    """Whether an answer declines: it is more like answers to abstention questions than like others."""

    def __init__(self, labelled: list[tuple[str, str | None, bool]]):
        """Fitted twice: the second time without what the first time takes for mislabelled."""
        first = WordBayes(0.1)  # what others than abstention questions got is mostly answers
        known = [(self.features(a, q), declines) for q, a, declines in labelled if a]
        for f, declines in known:
            first.add("declines" if declines else "answers", f)
        self.model = first.freeze()
        if len(first.labels) == 2:
            again = WordBayes(0.1)
            for f, declines in known:
                if (self._score(f) > 0) == declines:
                    again.add("declines" if declines else "answers", f)
            self.model = again.freeze()

    @staticmethod
    def features(answer: str, question: str) -> list[str]:
        """Words, and thrice a mark if the answer has a number that the question doesn't have."""
        new = set(re.findall(r"\d+", answer)) - set(re.findall(r"\d+", question or ""))
        return _words(answer) + (["#new"] * 3 if new else ["#none"])

    def _score(self, features: list[str]) -> float:
        if not features or len(self.model.labels) < 2:
            return -1.0
        answers, declines = self.model.logliks(features)
        return declines - answers + log(self.model.texts["declines"] / self.model.texts["answers"])

    def score(self, answer: str, question: str) -> float:
        return self._score(self.features(answer, question))


def is_abstention(question_id: str | None, flag: bool | None) -> bool:
    return bool(flag) or (question_id or "").endswith("_abs")


def is_empty(answer: str | None, truth: str | None) -> bool:
    """Nothing but blanks, marks, labels or a placeholder. A placeholder's word that is the truth is an answer."""
    if answer is None:
        return True
    bare = re.sub(r"<[^<>]{0,40}>", " ", answer)
    n = normal(bare)
    if truth and n == normal(truth) and n:
        return False
    for _ in range(2):
        for label in LABELS:
            if re.fullmatch(rf"[\W_]*{re.escape(label)}[\W_]*[:：][\W_]*", bare, re.IGNORECASE) or n == label and re.search(r"[:：<>*#]", answer):
                return True
    return not n or n in PLACEHOLDERS or (not re.search(r"\w", bare.replace("_", "")))


def is_copy(question: str, answer: str, truth: str | None) -> bool:
    """The answer ends with the question, or most of it, and has nothing else but an introduction or the question again."""
    q, a = normal(question).replace(" ", ""), normal(answer).replace(" ", "")
    t = normal(truth).replace(" ", "")
    if not q or not a:
        return False
    # the question without its own introduction, which ends at a comma or colon
    cores = [q] + [c for m in re.finditer(r"[:：,，、]", question) if len(c := normal(question[m.end() :]).replace(" ", "")) >= 0.5 * len(q)]
    for core in cores:
        rest = a.replace(core, "\0")
        if "\0" not in rest:
            continue
        tail = rest.rpartition("\0")[2]
        tail = "" if tail in LABELS else tail
        head = rest.rpartition("\0")[0].replace("\0", "")
        if not tail and (not t or t not in head or t in q) and len(head) <= max(24, 1.2 * len(q)):
            return True
    return False


def holds(text: str, part: str) -> bool:
    """Whether a normal text holds another one, as whole words where words stand apart."""
    if not part:
        return False
    if part.isascii():
        return re.search(rf"(?<![a-z0-9]){re.escape(part)}(?![a-z0-9])", text) is not None
    return part.replace(" ", "") in text.replace(" ", "")


def is_open(answer: str, truth: str | None) -> bool:
    """It stops within a structure: a fence, a list that has fewer items than the truth, a table's row, brackets or quotation marks."""
    text = answer.rstrip()
    if len(re.findall(r"(?m)^\s*(?:```|~~~)", text)) % 2:
        return True
    wanted = [x for x in re.split(r"\s*[;；]\s*", truth or "") if x]
    items = re.findall(r"(?m)^\s*(?:[-*+•]|\d+[.)])\s+\S", text)
    if items and len(wanted) > len(items):
        return True
    if text.count("|") > 3 and text.splitlines()[-1].lstrip().startswith("|") and not text.endswith("|"):
        return True
    if text[-1:] in "“«「『（([{" or any(text.count(a) > text.count(b) for a, b in ("()", "（）", "「」", "«»", "{}", "[]")):
        return True
    return text.count("“") > text.count("”") and "„" not in text


def defects_of(rows: list[tuple], languages: Languages, ends: Ends, declines: Declines) -> list[list[str]]:
    """Defects of each ``(question_id, question, truth, abstention, answer)``."""
    found: list[list[str]] = [[] for _ in rows]
    full = []
    for i, (_, _, truth, _, answer) in enumerate(rows):
        if is_empty(answer, truth):
            found[i].append("empty")
        else:
            full.append(i)
    questions, truths = ([rows[i][k] or "" for i in full] for k in (1, 2))
    asked, true = languages.posteriors(questions, asked=True), languages.posteriors(truths)
    truth_apart = languages.apart(asked, true)
    chances = ends.chances([rows[i][4] for i in full])
    rests, judged = [], []
    for j, i in enumerate(full):
        qid, question, truth, flag, answer = rows[i]
        n, t = normal(answer), normal(truth)
        if question and is_copy(question, answer, truth):
            found[i].append("copy")
            continue
        if not (t and n == t) and (chances[j] < ENDS_LEAST or is_open(answer, truth)):
            found[i].append("truncated")
        gives, abstention = holds(n, t), is_abstention(qid, flag)
        if not abstention:
            # a short truth, or one that the question holds, may stand in an answer by chance
            sure = gives and (len(t) > 3 or not t.isascii() or t.isdigit()) and not holds(normal(question), t)
            if not sure and declines.score(answer, question or "") > (DECLINES_LEAST + 6 if gives else DECLINES_LEAST):
                found[i].append("refusal")
        if question and not (t and n.replace(" ", "") == t.replace(" ", "")):
            # where the truth is in another language, so may be the answer, but for what stands around the truth
            asked_for = gives and not abstention and truth_apart[j] > log(2)
            rest = n.replace(t, " ") if asked_for else answer
            if not t and languages.asks(question):  # what is asked for stands in quotation marks, or alone
                asked_for, rest = True, re.sub(r"[“\"«„「].*?[”\"»“」]", " ", answer)
            if len(grams.letters(rest).replace(" ", "")) >= (25 if asked_for else 2):
                judged.append(j)
                rests.append(rest)
    for j, apart in zip(judged, languages.apart(asked[judged], languages.posteriors(rests)).tolist()):
        if apart > FOREIGN_LEAST:
            found[full[j]].append("language")
    return found


def defects(row: tuple, languages: Languages, ends: Ends, declines: Declines) -> list[str]:
    """Defects of one row."""
    return defects_of([row], languages, ends, declines)[0]


def fit(pairs: list[tuple], labelled: list[tuple[str, str]]) -> tuple[Languages, Ends, Declines]:
    """Models from ``(question_id, question, truth, abstention, answer)`` and ``(language, text)``."""
    usable = [p[:5] for p in pairs if not is_empty(p[4], p[2])]
    languages = Languages(labelled, [(q, a) for _, q, _, _, a in usable if q])
    known = list(dict.fromkeys((q or "", t) for i, q, t, f, _ in usable if t and not is_abstention(i, f)))
    # an answer that ends with the truth is complete
    complete = [(a, bool(t) and normal(a).endswith(normal(t)) and bool(normal(t))) for _, _, t, _, a in usable]
    ends = Ends([*complete, *((t, True) for _, t in known)])
    declines = Declines([(q or "", a, is_abstention(i, f)) for i, q, _, f, a in usable] + [(q, t, False) for q, t in known])
    languages.learn(usable)
    return languages, ends, declines


Tallied = Callable[[list[tuple]], Iterable[tuple[str, np.ndarray]]]


def _tallied(df: DataFrame, each: Tallied, rows: int = 2048) -> DataFrame:
    """``(label, key, n)``: how often each label has each key that ``each`` finds in some rows. Tasks add up before they hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: dict[str, list] = defaultdict(list)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold() -> None:
            for label, found in new.items():
                v = pa.array(np.concatenate(found)).value_counts()
                keys, n = v.field(0).to_numpy(), v.field(1).to_numpy()
                if label in held:
                    keys, at = np.unique(np.concatenate([held[label][0], keys]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[label][1], n])).astype(np.int64)
                held[label] = keys, n
            new.clear()

        size = 0
        for part in _parts(batches, rows):
            for label, found in each(part):
                new[label].append(found)
                size += len(found)
            if size > 4_000_000:
                fold()
                size = 0
        fold()
        for label, (keys, n) in held.items():
            for i in range(0, len(keys), 65_536):
                k = keys[i : i + 65_536].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(k), pa.string()), pa.array(k), pa.array(n[i : i + 65_536])], ["label", "key", "n"])

    return df.mapInArrow(run, "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[list[tuple]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield list(zip(*(c.to_pylist() for c in batch.slice(i, rows).columns)))


def _mapped(df: DataFrame, each: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``each`` makes of some rows."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            columns = list(zip(*each(part))) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds.types)], schema=kinds)

    return df.mapInArrow(run, schema)


def _counts(tallied: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    t = tallied.select("label", "key", "n").toArrow()
    labels = np.array(t.column(0).to_pylist(), object)
    keys, n = (t.column(i).to_numpy() for i in (1, 2))
    out = {}
    for x in sorted(set(labels.tolist())):
        own = np.nonzero(labels == x)[0]
        own = own[np.argsort(keys[own].view(np.uint64))]
        out[x] = keys[own].view(np.uint64), n[own]
    return out


def _bayes(tallied: DataFrame, wanted: DataFrame) -> grams.Bayes:
    """Of all that was counted, without what isn't wanted."""
    sizes = {r.label: r.n for r in tallied.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    counts = _counts(tallied.join(wanted, "key", "left_semi"))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return grams.Bayes().counted({x: counts.get(x, none) for x in sizes}, sizes, tallied.select("key").distinct().count())


def _by_label(labels: list[str], texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    for label in dict.fromkeys(labels):
        yield label, grams.keys([t for x, t in zip(labels, texts) if x == label])[0]


def _languages(usable: DataFrame, labelled: DataFrame) -> Languages:
    """Languages() of all rows, by counts."""
    share = usable.sparkSession.sparkContext.broadcast
    languages = Languages([], [])
    named = durable(_tallied(labelled.select("lang", "text"), lambda rows: _by_label(*map(list, zip(*rows))), 256))
    pairs = usable.where("question <> ''").select("question", "generated_answer")
    if named.isEmpty() or pairs.isEmpty():
        return languages
    weight = named.groupBy("label").agg(F.least(F.lit(1.0), F.lit(LABELLED_WEIGHT) / F.sum("n")).alias("weight"))
    named = durable(named.join(F.broadcast(weight), "label").select("label", "key", (F.col("n") * F.col("weight")).alias("n")))  # a row each language
    texts = pairs.select(F.explode(F.array("question", "generated_answer")).alias("text")).where("text <> ''").distinct()
    wanted = durable(_tallied(texts, lambda rows: [("", grams.keys([t for (t,) in rows])[0])]).select("key"))
    first = share(_bayes(named, wanted))

    def guessed(rows: list[tuple]) -> list[tuple]:
        best = first.value.logliks(*grams.keys([q for q, _ in rows]), len(rows)).argmax(1)
        return [(q, a, first.value.labels[j]) for (q, a), j in zip(rows, best.tolist())]

    known = durable(_mapped(pairs.distinct(), guessed, "question string, answer string, label string"))
    asked = _tallied(known.select("label", "question").distinct(), lambda rows: _by_label(*map(list, zip(*rows))))
    both = named.join(known.select("label").distinct(), "label", "left_semi").unionByName(asked.select("label", "key", F.col("n").cast("double")))
    seeds = share(_bayes(durable(both.groupBy("label", "key").agg(F.sum("n").alias("n"))), wanted))
    stood = known.select(F.explode(F.array("question", "answer")).alias("text"), "label").where("text <> ''").groupBy("text").agg(F.array_join(F.array_sort(F.collect_set("label")), " ").alias("labels"))  # at most all languages

    def rated(rows: list[tuple]) -> list[tuple]:
        """Language, the question's language, rate of an n-gram, and n-grams of each text."""
        m, (found, of) = seeds.value, grams.keys([t for t, _ in rows])
        values, out = m.logliks(found, of, len(rows)), []
        for (t, labels), v, n in zip(rows, values, np.maximum(1, np.bincount(of, minlength=len(rows))).tolist()):
            at = max((m.labels.index(x) for x in labels.split(" ")), key=lambda j: v[j])
            best = at if v.max() - v[at] < LEAVES * n else int(v.argmax())
            out.append((t, best, at, float(v[best]) / n, n))
        return out

    rows = durable(_mapped(stood, rated, "text string, best int, asked int, rate double, n long").where(F.col("n") >= TELLING))
    by = Window.partitionBy("best")
    order = rows.select("best", "rate", F.row_number().over(by.orderBy("rate")).alias("at"), F.count("*").over(by).alias("of"))
    middle = order.where("at in (floor((of + 1) / 2), floor(of / 2) + 1)").groupBy("best").agg(F.avg("rate").alias("rate"))
    usual = share({r.best: r.rate for r in middle.collect()})

    def odd(part: list[tuple]) -> list[tuple]:
        """``(row, its n-grams)`` of odd texts."""
        near = [i for i, r in enumerate(part) if r[3] < usual.value[r[1]] - ODD]
        split = _each(*grams.keys([part[i][0] for i in near]), len(near)) if near else []
        return [(i, g) for i, g in zip(near, split) if sum(c > "\u2e80" for c in grams.letters(part[i][0])) * 12 < len(g)]

    def lacking(part: list[tuple]) -> Iterator[tuple[str, np.ndarray]]:
        for i, g in odd(part):
            yield f"{part[i][1]} {int(part[i][2] == part[i][1])}", _lacked(g, seeds.value, part[i][1])

    seen = _counts(_tallied(rows, lacking))
    ratios = {}
    for j in {int(x.split()[0]) for x in seen}:
        found = [seen.get(f"{j} {same}", (np.zeros(0, np.uint64), np.zeros(0))) for same in (0, 1)]
        every = np.unique(np.concatenate([k for k, _ in found]))
        counts = np.full((2, len(every)), 0.5)
        for same, (k, n) in enumerate(found):
            counts[same, np.searchsorted(every, k)] += n
        ratios[j] = every, np.log(counts[0] / counts[1])
    told = share(ratios)

    def labels(part: list[tuple]) -> Iterator[tuple[str, np.ndarray]]:
        strange = set()
        for i, g in odd(part):
            lacked = _lacked(g, seeds.value, part[i][1])
            if len(lacked):
                every, ratio = told.value[part[i][1]]
                if float(ratio[np.searchsorted(every, lacked)].mean()) > log(ELSEWHERE):
                    strange.add(i)
        yield from _by_label([OTHER if i in strange else seeds.value.labels[r[1]] for i, r in enumerate(part)], [r[0] for r in part])

    languages.model = grams.Bayes().counted(_counts(_tallied(rows, labels)))
    shared = share(languages)

    def tails(part: list[tuple]) -> list[tuple]:
        m = shared.value
        apart = m.apart(m.posteriors([q for q, _ in part], asked=True), m.posteriors([t for _, t in part]))
        return [(_tail_words(q),) for (q, _), x in zip(part, apart.tolist()) if x > FOREIGN_LEAST]

    truths = usable.where("question <> '' and ground_truth <> '' and not abstains").select("question", "ground_truth")
    languages.asking = {r.words for r in _mapped(truths, tails, "words string").groupBy("words").count().where("count >= 2").collect()}
    return languages


def _ends(usable: DataFrame, truths: DataFrame) -> Ends:
    """Ends() of all rows, of the contexts that their answers end with."""
    keys = _tallied(usable.select("generated_answer"), lambda rows: [("", Ends.asked([a for (a,) in rows]))])
    wanted = np.sort(keys.select("key").toArrow().column(0).to_numpy().view(np.uint64))
    shared = usable.sparkSession.sparkContext.broadcast(wanted)
    texts = usable.select(F.col("generated_answer").alias("text"), "ground_truth").unionByName(truths.select(F.col("ground_truth").alias("text"), "ground_truth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        seen, ended = np.zeros(len(wanted), np.int64), np.zeros(len(wanted))
        for part in _parts(batches):
            for keys, number, over, _ in Ends.contexts([(a, bool(t) and bool(normal(t)) and normal(a).endswith(normal(t))) for a, t in part]):
                at = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
                hit = np.nonzero(wanted[at] == keys)[0]
                seen[at[hit]] += number[hit]
                ended[at[hit]] += over[hit]
        held = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held]), pa.array(ended[held])], ["at", "seen", "ended"])

    t = texts.mapInArrow(run, "at long, seen long, ended double").groupBy("at").agg(F.sum("seen"), F.sum("ended")).toArrow()
    at, seen, ended = (t.column(i).to_numpy() for i in range(3))
    return Ends.__new__(Ends)._sorted(wanted[at], seen, ended)


def _declines(usable: DataFrame, truths: DataFrame) -> Declines:
    """Declines() of all rows, by counts."""
    declines = Declines([])
    known = usable.select("question", "generated_answer", "abstains").unionByName(truths.select("question", F.col("ground_truth").alias("generated_answer"), F.lit(False).alias("abstains")))

    def fitted(first: WordBayes | None) -> WordBayes:
        before = Declines([])
        if first:
            before.model = first
        shared = usable.sparkSession.sparkContext.broadcast(before)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[bool, Counter] = {False: Counter(), True: Counter()}
            texts: Counter = Counter()
            for part in _parts(batches):
                for q, a, abstains in part:
                    f = Declines.features(a, q)
                    if first is None or (shared.value._score(f) > 0) == abstains:
                        counts[abstains].update(f)
                        texts[abstains] += 1
            rows = [("declines" if x else "answers", f, n) for x, c in counts.items() for f, n in [*c.items(), *([(None, texts[x])] if texts[x] else [])]]
            for i in range(0, len(rows), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 65_536]), (pa.string(), pa.string(), pa.int64()))], ["label", "word", "n"])

        t = known.where("generated_answer <> ''").mapInArrow(run, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")).toArrow()
        out = WordBayes(0.1)
        for label, word, n in zip(*(t.column(i).to_pylist() for i in range(3))):
            if word is None:
                out.texts[label] = n
                out.counts[label].update()
            else:
                out.counts[label][word] = n
                out.totals[label] += n
        return out.freeze()

    declines.model = fitted(None)
    if len(declines.model.labels) == 2:
        declines.model = fitted(declines.model)
    return declines


def fitted(rows: DataFrame, labelled: DataFrame) -> tuple[Languages, Ends, Declines]:
    """The models of ``fit`` over tables of any size: all that is learned from them is counted where they lie.

    Where a language's labelled texts have more than LABELLED_WEIGHT n-grams, their counts are all scaled down to that sum.
    """
    names = ["question_id", "question", "ground_truth", "is_abstention", "generated_answer"]
    keep = lambda part: [(*r, is_abstention(r[0], r[3])) for r in part if not is_empty(r[4], r[2])]
    usable = durable(_mapped(rows.select(*names).distinct(), keep, "question_id string, question string, ground_truth string, is_abstention boolean, generated_answer string, abstains boolean"))
    of = F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2,3})\b", 1))
    texts = labelled.where("length(text) > 40").select(of.alias("lang"), "text").where("lang <> ''")
    truths = durable(usable.where("ground_truth <> '' and not abstains").select(F.coalesce("question", F.lit("")).alias("question"), "ground_truth").distinct())
    return _languages(usable, texts), _ends(usable, truths), _declines(usable, truths)


def broken(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(question_id, defect)`` of every defective pair, each once.

    ``rows`` has question_id, question, ground_truth, is_abstention and generated_answer, ``labelled`` texts and
    their languages, ``(lang, text)``. A null answer is empty; a null question is in no language and copied by no answer;
    without a truth no answer holds it. An empty input gives an empty result. The models are fitted on all rows and
    all labelled texts; every row is judged.
    """
    once = rows.select("question_id", "question", "ground_truth", "is_abstention", "generated_answer").where("question_id is not null")
    shared = rows.sparkSession.sparkContext.broadcast(fitted(once, labelled))
    judged = _mapped(once, lambda part: [(r[0], d) for r, found in zip(part, defects_of(part, *shared.value)) for d in found], "question_id string, defect string")
    return judged.distinct()
