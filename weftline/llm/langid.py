"""Problem 8: the language of documents and of their mixed-language segments, by cross-parsing entropy.

For every language a suffix automaton of its labelled text is built; it accepts
exactly the substrings of that text. A line is parsed against each automaton
into phrases, every phrase being the longest match from where the last one
ended; an unknown symbol is a phrase of its own. The cross-entropy of a line is
its phrases times the bits of a pointer into the labelled text, and the language
with the fewest wins. All automata lie in one transition table, in which a
failing transition leads on from the root and carries a mark, so lines of like
length are parsed side by side, one table look-up per symbol and language.

Segments come from a shortest path over the lines of a document: a line costs
each language its bits above the best language's, at most 1 after scaling; a
change of language costs ``SWITCH`` and a segment has at least ``LEAST`` lines.
Running heads cost nothing, and a change just before one is cheaper, so they
belong to the segment after them.

The automata are fitted on a bounded sample of labelled rows: first the labelled
samples in order of ``sample_id``, at most ``SAMPLE_CHARS`` symbols per language,
then, up to the same bound, the texts of those of ``LABELLED_DOCS`` labelled
documents (the least by hash of ``doc_id``) for which the samples alone give one
segment in the language of the label. Every document is judged. Results for odd input: null or empty texts and texts
without words have no segment and are no case; rows with a null or repeated
``doc_id`` are judged row by row; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_CHARS, LABELLED_DOCS, SWITCH, LEAST, SCALE, EVIDENCE, LINES, BATCH = 24_000, 800, 1.2, 3, 3.0, 16, 4096, 2_000_000
SHIFT = 6
# How labels name the languages.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "sv": ("sv", "swe", "swedish"),
}
_CODE = {name: code for code, names in NAMES.items() for name in names}


def label_code(label: str | None, known: frozenset[str] = frozenset()) -> str | None:
    """The code that a label names, whatever its case, region or blanks; None if it names none or several.

    A code names itself if labelled samples have it, also where its language is not among ``NAMES``.
    """
    base = re.split(r"[-_]", (label or "").strip().lower())[0]
    return _CODE.get(base, base if base in known else None)


# --- the automata ----------------------------------------------------------


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of a text; state 0 is its root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    return step


@lru_cache(1)
def _folding() -> np.ndarray:
    """By code point: 0 for what is no letter, else the number of the lower-case Latin letter."""
    fold, number = np.zeros(0x250, np.uint16), {}
    for cp in range(0x250):
        c = chr(cp).lower()
        if len(c) == 1 and unicodedata.category(c).startswith("L") and c not in "ªº":
            fold[cp] = number.setdefault(c, len(number) + 1)
    return fold


class Parser:
    """The automata of all languages in one table."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        fold = _folding()
        # Letters that some sample has get a symbol; the rest share the last one, which no text has.
        folded = {k: self._spaced(fold[np.minimum(self._points(v), len(fold) - 1)]) for k, v in samples.items()}
        letters, often = np.unique(np.concatenate([*folded.values(), [0]]), return_counts=True)
        # A table row has room for so many letters; of more, the rarest share the last symbol as well.
        letters = np.sort(letters[np.argsort(-often, kind="stable")[: (1 << SHIFT) - 1]])
        self.symbol = np.full(int(fold.max()) + 1, len(letters), np.int32)
        self.symbol[letters] = np.arange(len(letters))
        tables, roots, self.bits, base = [], [], [], 0
        for lang in self.langs:
            codes = self.symbol[folded[lang]].tolist()
            step = suffix_automaton(codes)
            root = np.full(1 << SHIFT, base, np.int64)
            for c, to in step[0].items():
                root[c] = base + to
            table = np.tile((root << SHIFT) | 1, (len(step), 1))
            for state, out in enumerate(step):
                for c, to in out.items():
                    table[state, c] = (base + to) << SHIFT
            tables.append(table.astype(np.int32).ravel())
            roots.append(base << SHIFT)
            self.bits.append(np.log2(max(2, len(codes))))
            base += len(step)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        self.bits = np.array(self.bits, np.float32)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @staticmethod
    def _spaced(folded: np.ndarray) -> np.ndarray:
        """One blank for each stretch without letters, and one at either end."""
        x = np.concatenate(([0], folded, [0]))
        return x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of every line in every language, letters of every line, and how many lines each text has."""
        fold = _folding()
        points = self._points("\n".join(texts) + "\n")
        newline = points == 10
        letter = fold[np.minimum(points, len(fold) - 1)]
        letter[points >= len(fold)] = 0
        # Of a stretch without letters its line ends are kept, else its first place.
        blank = letter == 0
        fresh = blank & ~np.concatenate(([False], blank[:-1]))
        stretch = np.cumsum(fresh) - 1
        broken = np.bincount(stretch[newline], minlength=int(stretch[-1]) + 1) > 0
        keep = ~blank | newline | (fresh & ~broken[stretch])
        code, ends = self.symbol[letter[keep]], np.flatnonzero(newline[keep])
        starts = np.concatenate(([0], ends[:-1] + 1))
        letters = np.add.reduceat((letter[keep] != 0).astype(np.int64), starts)
        count = np.zeros((len(self.langs), len(ends)), np.int32)
        size = ends - starts + 1
        order = np.argsort(-size, kind="stable")
        order = order[letters[order] > 0]
        for at in range(0, len(order), LINES):
            some = order[at : at + LINES]
            n, first = size[some], starts[some]
            # All parses begin behind a blank, which the line before ends with.
            state = self.table[self.roots[:, None] + np.zeros(len(some), np.int32)] & np.int32(-(1 << SHIFT))
            got = np.zeros((len(self.langs), len(some)), np.int32)
            for t in range(int(n[0])):
                live = int(np.searchsorted(-n, -t, "left"))
                c = code[first[:live] + t]
                to = self.table.take(state[:, :live] + c)
                got[:, :live] += to & 1
                state[:, :live] = to & np.int32(-(1 << SHIFT))
            count[:, some] = got + 1
        per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
        return count.T * self.bits, letters, per_text


def segment(cost: np.ndarray, pull: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """The language of every line: the cheapest course per text, of runs of at least LEAST lines.

    ``pull`` decides where a line without a language of its own goes: 1 to the segment after it, -1 to the one before.
    """
    out = np.zeros(len(cost), np.int64)
    begin = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    k = cost.shape[1]
    for at in range(0, len(order), 1024):
        some = order[at : at + 1024]
        n, b, d = per_text[some], begin[some], len(some)
        top = int(n[0])
        f = np.full((LEAST, d, k), np.inf, np.float32)  # by lines so far in the run, the last for LEAST or more
        come = np.zeros((top, d), np.int8)  # the best language to come from
        second = np.zeros((top, d), np.int8)
        stay = np.zeros((top, d, k), bool)
        live_at = [int(np.searchsorted(-n, -t, "left")) for t in range(top)]
        for t, live in enumerate(live_at):
            c = cost[b[:live] + t]
            if t == 0:
                f[0, :live] = c
                continue
            done = f[LEAST - 1, :live]
            two = np.argsort(done, axis=1, kind="stable")[:, :2] if k > 1 else np.zeros((live, 2), np.int64)
            row = np.arange(live)
            least, other = done[row, two[:, 0]], done[row, two[:, 1]]
            come[t, :live], second[t, :live] = two[:, 0], two[:, 1]
            start = np.repeat(least[:, None], k, axis=1)
            start[row, two[:, 0]] = other if k > 1 else np.inf
            start += (SWITCH - 0.01 * pull[b[:live] + t])[:, None].astype(np.float32)
            stay[t, :live] = done <= f[LEAST - 2, :live]
            f[LEAST - 1, :live] = np.minimum(done, f[LEAST - 2, :live]) + c
            for j in range(LEAST - 2, 0, -1):
                f[j, :live] = f[j - 1, :live] + c
            f[0, :live] = start + c
        # Texts shorter than a segment end where they are.
        lang = np.where((n < LEAST)[:, None], f[np.minimum(n, LEAST) - 1, np.arange(d)], f[LEAST - 1]).argmin(axis=1)
        left = np.minimum(n, LEAST) - 1  # lines before this one in the run, as counted by the course
        for t in range(top - 1, -1, -1):
            live = live_at[t]
            row, now = np.arange(live), lang[:live]
            out[b[:live] + t] = now
            if t == 0:
                break
            run = left[:live]
            starts = run == 0
            into = np.where(come[t, :live] == now, second[t, :live], come[t, :live])
            keep = (run == LEAST - 1) & stay[t, row, now]
            lang[:live] = np.where(starts, into, now)
            left[:live] = np.where(starts, LEAST - 1, np.where(keep, run, run - 1))
    return out


# A running head: the name of the paper and its date, so a year at the end, perhaps misread.
_YEAR = re.compile(r"[1Il!][0-9OoIlSsBZ]{3}\W*$")


def heads(texts: list[str]) -> np.ndarray:
    """Which lines are running heads: few words, with a day and a year at the end."""
    found = []
    for t in texts:
        for line in t.split("\n"):
            found.append(len(line) < 100 and bool(_YEAR.search(line[-8:])) and any(c.isdigit() for c in line[:-6]) and not line.rstrip().endswith((")", ").")))
    return np.array(found, bool)


# A word broken at a line's end is read whole with the line after it, too.
_BROKEN = re.compile(r"([^\W\d_]+)[-¬‐=]\n")
_WORD = re.compile(r"[^\W\d_]{3}")


def judge(parser: Parser, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """The segments of every text: first line, line after the last, language, confidence."""
    bits, letters, per_text = parser.lines([_BROKEN.sub(r"\1-\n\1", t) for t in texts])
    head = heads(texts)
    above = (bits - bits.min(axis=1, keepdims=True)) / (SCALE * parser.bits.max())
    cost = np.minimum(above, 1).astype(np.float32)
    cost[head | (letters == 0)] = 0
    lang = segment(cost, head.astype(np.int8) - (~head & (letters == 0)), per_text)
    begin = np.cumsum(per_text) - per_text
    fresh = np.concatenate(([True], lang[1:] != lang[:-1]))
    fresh[begin] = True
    at = np.flatnonzero(fresh)
    # Confidence: the share of the language among all, by the mean evidence of a line of the segment, in bits over EVIDENCE.
    told = ~head & (letters > 0)
    total = np.add.reduceat(np.where(told[:, None], bits, 0), at) / np.maximum(1, np.add.reduceat(told.astype(np.int64), at))[:, None]
    gap = (total - total[np.arange(len(at)), lang[at]][:, None]) / EVIDENCE
    sure = 1 / np.exp2(np.clip(-gap, -60, 60)).sum(axis=1)
    owner = np.searchsorted(begin, at, "right") - 1
    end = np.append(at[1:], len(lang))
    result: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for i in range(len(at)):
        o = owner[i]
        result[o].append((int(at[i] - begin[o]), int(end[i] - begin[o]), parser.langs[lang[at[i]]], float(sure[i])))
    return [r if _WORD.search(t) else [] for r, t in zip(result, texts)]


# --- operator --------------------------------------------------------------


def fitted(samples: DataFrame, docs: DataFrame | None = None, chars: int = SAMPLE_CHARS, labelled: int = LABELLED_DOCS) -> dict[str, str]:
    """Labelled text per language: at most ``chars`` symbols of the samples, then whole labelled documents until ``chars`` is reached."""
    w = Window.partitionBy("lang").orderBy("sample_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    known = samples.select("sample_id", "text", F.lower(F.trim("lang")).alias("lang")).where((F.col("lang") != "") & (F.length("text") > 0))
    held = known.withColumn("upto", F.sum(F.length("text")).over(w)).where(F.col("upto") <= chars)
    parts: dict[str, list[str]] = {}
    for r in held.orderBy("lang", "sample_id", "text").collect():
        parts.setdefault(r["lang"], []).append(r["text"])
    text = {k: " \n ".join(v) for k, v in parts.items()}
    if docs is None or not text:
        return text
    # The least hashes are found on the ids alone; only the rows at or below the last of them send their texts.
    known_docs = docs.where(F.trim("lang") != "").withColumn("_h", F.xxhash64("doc_id"))
    least = [r[0] for r in known_docs.select("_h").orderBy("_h").limit(labelled).collect()]
    some = known_docs.where(F.col("_h") <= max(least)).select("lang", "text").orderBy("_h", "doc_id", "text").limit(labelled).collect() if least else []
    some = [(label_code(r["lang"], frozenset(text)), r["text"]) for r in some if r["text"]]
    for (label, t), found in zip(some, judge(Parser(text), [t for _, t in some]) if some else []):
        if label in text and len(found) == 1 and found[0][2] == label and len(text[label]) < chars:
            text[label] += " \n " + _BROKEN.sub(r"\1", t)
    return text


_SCHEMA = "doc_id bigint, label string, segments array<struct<line_beg:int,line_end:int,lang:string,confidence:double>>"


def judged(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, label, segments``: the code that the row's label names, or null, and its segments."""
    text = fitted(samples, docs)
    if not text:
        raise ValueError("no labelled text")
    shared = docs.sparkSession.sparkContext.broadcast(text)
    segment_type = pa.list_(pa.struct([("line_beg", pa.int32()), ("line_end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(tuple(sorted(shared.value.items())))
        known = frozenset(shared.value)
        for batch in batches:
            ids, labels_, texts = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < BATCH):
                    size += len(texts[to] or "")
                    to += 1
                found = judge(parser, [t or "" for t in texts[at:to]])
                rows = [[dict(zip(("line_beg", "line_end", "lang", "confidence"), s)) for s in r] for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:to], pa.int64()), pa.array([label_code(x, known) for x in labels_[at:to]], pa.string()), pa.array(rows, segment_type)], names=["doc_id", "label", "segments"])
                at = to

    return docs.select("doc_id", "lang", "text").mapInArrow(run, _SCHEMA)


@lru_cache(1)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def _lines_of(lang: Column) -> Column:
    """Lines of a document's segments in one language."""
    return F.aggregate("segments", F.lit(0), lambda a, s: a + F.when(s["lang"] == lang, s["line_end"] - s["line_beg"]).otherwise(0))


def languages(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, lang, confidence, segments``: the language that most lines of a document have (of equal ones the first by code); null without words."""
    per = F.transform("segments", lambda s: F.struct((-_lines_of(s["lang"])).alias("few"), s["lang"].alias("lang"), (-s["confidence"]).alias("unsure")))
    best = F.array_min(per)
    found = judged(docs, samples).withColumn("best", best)
    return found.select("doc_id", F.col("best.lang").alias("lang"), (-F.col("best.unsure")).alias("confidence"), "segments")


def relabelled(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, line_beg, lang``: the segments of documents whose label is missing, is not their language, or that have several segments."""
    most = F.array_max(F.transform("segments", lambda s: _lines_of(s["lang"])))
    wrong = F.col("label").isNull() | (F.size("segments") > 1) | (_lines_of(F.col("label")) < most)
    return judged(docs, samples).where((F.size("segments") > 0) & wrong).select("doc_id", F.inline("segments")).select("doc_id", "line_beg", "lang")
