"""Reading level of each document: classic readability formulas over prose, combined by their median.

Letters, words, sentences and syllables are counted over whole batches of code points. Prose is what lies outside
``` fences on lines that don't start with '#'; words are runs of letters; a sentence ends at '.', '!' or '?' before
white space and at the end of a line. Syllables come from hyphenation rules by language (`skein.llm.syllables`), applied to
the distinct words of a batch. Each language has its own published formulas and constants.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.syllables import syllables

LETTER, SPACE, STOP = 1, 2, 4
_LAST_LETTER = 0x32400
#: Rows and code points worked on at a time, for memory only.
_SLICE = 2 << 20

# Frequent short words by which a text's language is told, lower case.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be this from by not or but at which have has",
    "de": "der die das und ist nicht ein eine den von zu mit auf dem sich des im für als wird auch an es",
    "fr": "le la les des est et une un du dans que qui pour pas sur au par plus ne ce se il elle aux",
    "es": "el los las del que en y es una un por con no se para al lo como su más o la de",
}
LANGUAGES = tuple(FUNCTION_WORDS)

MEASURES = "n_letters bigint, n_words bigint, n_sentences bigint, n_syllables bigint, n_long bigint, n_hard bigint, n_single bigint, language string"


class _Tables:
    kind: np.ndarray | None = None
    lower: np.ndarray | None = None

    @classmethod
    def load(cls) -> None:
        if cls.kind is None:
            kind = np.zeros(sys.maxunicode + 1, np.uint8)
            lower = np.arange(_LAST_LETTER, dtype=np.uint32)
            for c in range(_LAST_LETTER):
                if 0xD800 <= c < 0xE000:
                    continue
                ch = chr(c)
                if ch.isalpha():
                    kind[c] = LETTER
                    low = ch.lower()
                    lower[c] = ord(low) if len(low) == 1 else c
                elif ch.isspace():
                    kind[c] = SPACE
            for ch in ".!?":
                kind[ord(ch)] = STOP
            cls.kind, cls.lower = kind, lower


def _mark(word: str) -> int:
    h = 0
    for ch in word:
        h = (h * 1_000_003 + ord(ch)) & 0xFFFFFFFF
    return h


_SHORT = 5
_MARKS = {k: np.array(sorted(_mark(w) for w in v.split() if len(w) <= _SHORT), np.int64) for k, v in FUNCTION_WORDS.items()}


_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def _sum(values: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    """Sums of `values` by document number `at`."""
    return np.bincount(at, weights=values, minlength=total).astype(np.int64)


class Prose:
    """Counts of the texts of one batch."""

    def __init__(self, texts: list[str]):
        _Tables.load()
        n = len(texts)
        joined = "\n".join(texts) + "\n"
        if joined.isascii():
            points = np.frombuffer(joined.encode("ascii"), np.uint8)
        else:
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
        doc_end = np.cumsum(lengths)
        kind = _Tables.kind[points]
        newline = np.flatnonzero(points == 10)
        line_at = np.concatenate([[0], newline[:-1] + 1])
        line_doc = np.searchsorted(doc_end, line_at, side="right")
        lead = points[line_at]
        # A fence may be indented; only lines that begin with a blank or a tick are looked at more closely.
        fence = np.zeros(len(line_at), bool)
        for i in np.flatnonzero((lead == 96) | (lead == 32) | (lead == 9)).tolist():
            fence[i] = joined[line_at[i] : newline[i]].lstrip(" \t").startswith("```")
        toggles = np.cumsum(fence)
        first = np.searchsorted(line_doc, np.arange(n))
        base = np.where(first > 0, toggles[np.maximum(first - 1, 0)], 0)
        inside = ((toggles - base[line_doc]) & 1).astype(bool) | fence
        prose_line = ~inside & (lead != 35)
        prose = np.repeat(prose_line, newline - line_at + 1)
        letter = (kind == LETTER) & prose
        edge = np.empty(len(letter), bool)
        edge[0] = letter[0]
        np.greater(letter[1:], letter[:-1], out=edge[1:])
        starts = np.flatnonzero(edge)
        np.greater(letter[:-1], letter[1:], out=edge[:-1])
        edge[-1] = False
        ends = np.flatnonzero(edge)
        width = ends - starts + 1
        doc = np.searchsorted(doc_end, starts, side="right")
        self.n_words = np.bincount(doc, minlength=n)
        self.n_letters = _sum(width, doc, n)
        boundary = (kind == STOP) & prose
        boundary[:-1] &= kind[1:] == SPACE
        boundary[newline] = True
        stops = np.flatnonzero(boundary)
        sentence = np.searchsorted(stops, starts)
        new = np.ones(len(starts), bool)
        new[1:] = sentence[1:] != sentence[:-1]
        self.n_sentences = np.bincount(doc[new], minlength=n)
        self.n_long = np.bincount(doc[width > 6], minlength=n)
        low = _Tables.lower[points if points.dtype == np.uint8 else np.minimum(points, _LAST_LETTER - 1)]
        self.language = self._tell(low, starts, width, doc, n)
        counted = self._syllables(low, starts, width, self.language[doc])
        self.n_syllables = _sum(counted, doc, n)
        self.n_hard = np.bincount(doc[counted >= 3], minlength=n)
        self.n_single = np.bincount(doc[counted == 1], minlength=n)

    @staticmethod
    def _tell(low, starts, width, doc, n) -> np.ndarray:
        """The language whose function words a text has most of; English where there are none, or of equals the first."""
        short = np.flatnonzero(width <= _SHORT)
        h = np.zeros(len(short), np.int64)
        s, w = starts[short], width[short]
        for k in range(_SHORT):
            live = w > k
            h[live] = (h[live] * 1_000_003 + low[s[live] + k]) & 0xFFFFFFFF
        votes = []
        for name in LANGUAGES:
            marks = _MARKS[name]
            at = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
            votes.append(np.bincount(doc[short[marks[at] == h]], minlength=n))
        return np.argmax(np.stack(votes), axis=0)

    @staticmethod
    def _syllables(low, starts, width, language) -> np.ndarray:
        """Syllables of each word: the distinct words, told by a 64-bit mark of letters and language, are looked up once."""
        if not len(starts):
            return np.zeros(0, np.int64)
        first = np.cumsum(width) - width
        inside = np.arange(int(width.sum())) - np.repeat(first, width)
        letters = low[np.repeat(starts, width) + inside].astype(np.uint64)
        # A polynomial mark, place by place: words beyond the table of powers wrap around it.
        marks = np.add.reduceat((letters + np.uint64(1)) * _POWERS[inside % len(_POWERS)], first)
        marks = (marks + width.astype(np.uint64) * _POWERS[1]) * np.uint64(len(LANGUAGES)) + language.astype(np.uint64)
        _, at, back = np.unique(marks, return_index=True, return_inverse=True)
        told = np.empty(len(at), np.int64)
        for k, i in enumerate(at.tolist()):
            word = "".join(map(chr, low[starts[i] : starts[i] + width[i]].tolist()))
            told[k] = syllables(word, LANGUAGES[language[i]])
        return told[back]

    def columns(self) -> list[pa.Array]:
        numbers = [self.n_letters, self.n_words, self.n_sentences, self.n_syllables, self.n_long, self.n_hard, self.n_single]
        return [*(pa.array(x, pa.int64()) for x in numbers), pa.array([LANGUAGES[k] for k in self.language], pa.string())]


def prose_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, counts of MEASURES) of documents(doc_id, text): one row a document, whole texts, no shuffle.

    Null texts count as empty ones; a text without prose has only zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < _SLICE):
                    size += len(texts[end])
                    end += 1
                names = ["doc_id", *(c.split()[0] for c in MEASURES.split(", "))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *Prose(texts[at:end]).columns()], names)
                at = end

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, {MEASURES}")


# Reading ease by language, as (constant, words a sentence, syllables a word): Flesch for English, Amstad for
# German, Kandel and Moles for French, Szigriszt-Pazos for Spanish.
EASE = {"en": (206.835, 1.015, 84.6), "de": (180.0, 1.0, 58.5), "fr": (207.0, 1.015, 73.6), "es": (206.835, 1.0, 62.3)}
# School grade of a reading ease (Flesch's table), and of long words a sentence (Anderson's RIX table).
EASE_GRADES = ((90, 5), (80, 6), (70, 7), (60, 8.5), (50, 11), (30, 14.5), (0, 17))
RIX_GRADES = ((0.2, 1), (0.5, 2), (0.8, 3), (1.3, 4), (1.8, 5), (2.4, 6), (3.0, 7), (3.7, 8), (4.5, 9), (5.3, 10), (6.2, 11), (7.2, 12))
GRADES = ("ease_grade", "rix_grade", "flesch_kincaid", "fog", "smog", "coleman_liau", "automated", "wiener", "crawford")


def _between(x: Column, points) -> Column:
    """Straight lines through the (x, grade) points; the outer ones go on."""
    pairs = list(zip(points, points[1:]))
    out = None
    for (x0, y0), (x1, y1) in pairs:
        line = y0 + (x - x0) * ((y1 - y0) / (x1 - x0))
        beyond = x <= x1 if x1 > x0 else x >= x1
        out = F.when(beyond, line) if out is None else out.when(beyond, line)
    (x0, y0), (x1, y1) = pairs[-1]
    return out.otherwise(y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))


def _grades() -> dict[str, Column]:
    """Grade estimates by the formulas made for the text's language; null for those of other languages."""
    words, sentences = F.col("n_words").cast("double"), F.col("n_sentences").cast("double")
    letters, syllables, hard, long, single = (F.col(c).cast("double") for c in ("n_letters", "n_syllables", "n_hard", "n_long", "n_single"))
    by = {k: F.col("language") == k for k in LANGUAGES}
    ease = None
    for k, (whole, sentence, syllable) in EASE.items():
        value = F.lit(whole) - sentence * words / sentences - syllable * syllables / words
        ease = F.when(by[k], value) if ease is None else ease.when(by[k], value)
    smog = 1.043 * F.sqrt(30 * hard / sentences) + 3.1291
    return {
        "ease": ease,
        "ease_grade": _between(ease, EASE_GRADES),
        "rix_grade": _between(long / sentences, RIX_GRADES),
        "flesch_kincaid": F.when(by["en"], 0.39 * words / sentences + 11.8 * syllables / words - 15.59),
        "fog": F.when(by["en"], 0.4 * (words / sentences + 100 * hard / words)),
        # McLaughlin for English, Bamberger and Vanecek for German, Contreras and others for Spanish.
        "smog": F.when(by["en"], smog).when(by["de"], F.sqrt(30 * hard / sentences) - 2).when(by["es"], 0.74 * smog - 2.51),
        "coleman_liau": F.when(by["en"], 5.88 * letters / words - 29.6 * sentences / words - 15.8),
        "automated": F.when(by["en"], 4.71 * letters / words + 0.5 * words / sentences - 21.43),
        "wiener": F.when(by["de"], 0.1935 * 100 * hard / words + 0.1672 * words / sentences + 0.1297 * 100 * long / words - 0.0327 * 100 * single / words - 0.875),
        "crawford": F.when(by["es"], -0.205 * 100 * sentences / words + 0.049 * 100 * syllables / words - 3.407),
    }


def reading_levels(documents: DataFrame) -> DataFrame:
    """The counts with words_per_sentence, letters_per_word, the reading ease, the grade by each formula of the text's language and
    `grade`, their median (the mean of the middle two of an even number).

    Documents without prose words have null rates and grades.
    """
    counts = prose_counts(documents)
    some = F.col("n_words") > 0
    rates = {"words_per_sentence": F.col("n_words") / F.col("n_sentences"), "letters_per_word": F.col("n_letters") / F.col("n_words")}
    made = counts.withColumns({n: F.when(some, c) for n, c in (rates | _grades()).items()})
    grades = F.array_sort(F.array_compact(F.array(*GRADES)))
    n = F.size(grades)
    low, high = F.call_function("div", n + 1, F.lit(2)).cast("int"), (F.call_function("div", n, F.lit(2)) + 1).cast("int")
    return made.withColumn("grade", F.when(some, (F.element_at(grades, low) + F.element_at(grades, high)) / 2))


#: Labelled rows at most that the cut points are fitted on, chosen by a hash of doc_id.
FIT_ROWS = 20_000


def fit_cuts(graded: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> list[float]:
    """Four grades that part the levels 1 to 5 with the least total error on at most `limit` labelled rows.

    `labels`(doc_id, reader_level); repeated, null and impossible labels are left out. Found by dynamic programming over the sorted grades.
    """
    clean = labels.where(F.col("reader_level").between(1, 5)).groupBy("doc_id").agg(F.min("reader_level").alias("level"), F.max("reader_level").alias("_high")).where("level = _high")
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = chosen.join(graded.where(F.col("grade").isNotNull()).select("doc_id", "grade"), "doc_id").select("grade", "level").collect()
    pairs = sorted((float(r["grade"]), int(r["level"])) for r in rows)
    grades, levels = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    if not len(grades):
        return [5.0, 9.0, 13.0, 17.0]
    n = len(grades)
    cost = np.stack([np.concatenate([[0], np.cumsum(np.abs(levels - k))]) for k in range(1, 6)])
    best, back = cost[0].copy(), []
    for k in range(1, 5):
        margin = best - cost[k]
        low = np.minimum.accumulate(margin)
        arg = np.maximum.accumulate(np.where(margin == low, np.arange(n + 1), 0))
        back.append(arg)
        best = low + cost[k]
    cuts, at = [], n
    for arg in reversed(back):
        at = int(arg[at])
        cuts.append(float("-inf") if at == 0 else float("inf") if at == n else (grades[at - 1] + grades[at]) / 2)
    return cuts[::-1]


def level_of(grade: Column, cuts: list[float]) -> Column:
    """1 (plain) to 5 (demanding); null without a grade."""
    level = F.lit(1)
    for c in cuts:
        level = level + (grade >= F.lit(c)).cast("int")
    return F.when(grade.isNotNull(), level)
