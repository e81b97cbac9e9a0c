"""Secret scan: fixed patterns, and values in credential context whose guess cost is high.

The guess cost of a value is the decimal logarithm of how many guesses an attacker who knows words, dates,
repeats, sequences and keyboard walks needs: the cheapest way to cut the value into such spans and
brute-forced characters, found by dynamic programming from left to right. Words are a list of common passwords
and the commonest words of the scanned texts themselves, counted outside credential contexts. A span may end
anywhere in a run; of the places where a run's span may begin, those are dropped that another one undercuts
for good, so the minimum is exact and long runs take little more than linear time.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6
KINDS = ("assign", "access", "hex", "guess")

#: A name that says credential, a delimiter, and the value: in group 2 up to the quote that closes it on its line, else in group 3
#: up to a blank, without a last comma or semicolon.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)_?key|auth|cred(?:ential)?s?|login|pin)["'`]?[ \t]*(?:=>|[:=])[ \t]*"""
    r"""(?:(["'`])((?:\\[^\r\n]|(?!\1)[^\\\r\n])*)\1|["'`]?(\S*[^\s,;]|\S+))""",
    re.I | re.A,
)
#: Values that take this many guesses (as a power of ten) or more are secrets.
LEAST_GUESSES = 8.0

#: Words people choose for passwords, commonest first; the words of the texts come after them.
WORDS = """password admin qwerty welcome letmein monkey dragon master login princess sunshine shadow football baseball
superman batman iloveyou trustno hello freedom whatever charlie michael jordan hunter ranger secret access flower
cookie summer winter spring autumn orange purple yellow silver golden ginger pepper killer soccer hockey tigger
computer internet server system default changeme example sample test guest root user demo temp token value null none
true false your the and key my love baby angel lovely family friend money lucky happy star moon sun sky blue red green
black white cat dog bird fish horse tiger lion eagle house home work office school london paris berlin madrid america
january february march april june july august september october november december monday friday sunday database
backup public private account bearer basic string secure change enter here insert placeholder redacted xxxx""".split()
#: How many of the texts' commonest words are taken into the dictionary, and their lengths in letters.
MOST_WORDS, SHORTEST, LONGEST = 20_000, 3, 16
#: A worker holds the counts of so many words, and those of one text more; Spark adds them up.
HELD = 1 << 16
_WORD = re.compile(rf"[^\W\d_]{{{SHORTEST},{LONGEST}}}")
#: What is often written for a letter.
_LEET = str.maketrans("430157@$!", "aeoistasi")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_BESIDE = {(a, b) for row in _ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
_BESIDE |= {pair for up, low in zip(_ROWS, _ROWS[1:], strict=False) for i, c in enumerate(low) for o in (up[i : i + 2]) for pair in ((c, o), (o, c))}
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]"
_SEP = "([-/._]?)"
#: Dates with the cost of one written without separators; separators cost 0.6 more. Each is tried on its own.
DATES = [(re.compile(p), cost) for p, cost in ((_YEAR, 2.0), (f"{_YEAR}{_SEP}{_MONTH}\\1{_DAY}", 4.6), (f"{_DAY}{_SEP}{_MONTH}\\1{_YEAR}", 4.6), (f"{_MONTH}{_SEP}{_DAY}\\1{_YEAR}", 4.6), (f"{_DAY}{_SEP}{_MONTH}\\1[0-9][0-9]", 4.6))]
PER_CHARACTER = 1.0  # a brute-forced character: ten guesses
PER_SPAN = 0.3  # where one span ends and the next begins
LONGEST_BLOCK = 16  # characters of a repeated block at most
#: Runs of three characters or more, by what follows what; the cost of one is log10(ways * length).
RUNS = (
    (36, lambda a, b: a == b),
    (36, lambda a, b: ord(b) - ord(a) == 1),
    (72, lambda a, b: ord(a) - ord(b) == 1),
    (94, lambda a, b: (a, b) in _BESIDE),
)
_REPEATED = re.compile(rf"(?=(.{{2,{LONGEST_BLOCK}}}?)\1)", re.S)


def ranks(words: list[str]) -> dict[str, int]:
    """Rank from 1 of each word, the first place it has in WORDS and then in words, in lower case."""
    out: dict[str, int] = {}
    for w in (*WORDS, *words):
        out.setdefault(w, len(out) + 1)
    return out


_OWN = ranks([])


def words_at(value: str, low: str, i: int, rank: dict[str, int]) -> list[tuple[int, float]]:
    """(end, cost) of the words of value (low: in lower case) that begin at i: capitals and letters written as digits cost more."""
    out = []
    for size in range(SHORTEST, min(LONGEST, len(value) - i) + 1):
        part = low[i : i + size]
        for form in {part, part.translate(_LEET)}:
            if n := rank.get(form):
                out.append((i + size, math.log10(n + 1) + 0.3 * (value[i : i + size] != part) + 0.5 * (form != part)))
    return out


def dates_at(low: str, i: int) -> list[tuple[int, float]]:
    """(end, cost) of the dates that begin at i."""
    if not low[i].isdigit():
        return []
    return [(m.end(), cost + 0.6 * bool(m.re.groups and m[1])) for pattern, cost in DATES if (m := pattern.match(low, i))]


class _Run:
    """A longest stretch [start, stop) of one kind: spans in it have `least` units or more of `unit` characters and cost
    log10(units) and what `base` says of where they begin. Of the starts that are apart by whole units only those are
    kept that may still be the cheapest: one that costs no less than a later one never is again, nor is a later one that
    an earlier one undercuts at its shortest span, since the difference of their logarithms only shrinks."""

    def __init__(self, start: int, stop: int, unit: int, least: int, base) -> None:
        self.start, self.stop, self.unit, self.least, self.base = start, stop, unit, least, base
        self.kept: dict[int, list[tuple[int, float]]] = {}

    def ending(self, j: int, cost) -> float:
        """The cheapest span that ends at j, its start at i costing cost(i)."""
        i = j - self.unit * self.least
        if i < self.start:
            return math.inf
        kept = self.kept.setdefault((i - self.start) % self.unit, [])
        here = cost(i)
        if all(c + math.log10((j - s) // self.unit) > here + math.log10(self.least) for s, c in kept):
            kept[:] = [(s, c) for s, c in kept if c < here] + [(i, here)]
        first, most = min(kept, key=lambda k: k[1] + math.log10((j - k[0]) // self.unit))
        return most + self.base(first) + math.log10((j - first) // self.unit)


def _runs(low: str, rank: dict[str, int]) -> list[_Run]:
    out, n = [], len(low)
    for ways, goes_on in RUNS:
        i, base = 0, (lambda i, ways=ways: math.log10(ways))
        while i < n - 2:
            j = i + 1
            while j < n and goes_on(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                out.append(_Run(i, j, 1, 3, base))
            i = max(j - 1, i + 1)
    if _REPEATED.search(low):
        for unit in range(2, min(LONGEST_BLOCK, n // 2) + 1):
            i = 0
            while i < n - 2 * unit + 1:
                j = i
                while j + unit < n and low[j] == low[j + unit]:
                    j += 1
                if j - i >= unit:
                    out.append(_Run(i, j + unit, unit, 2, functools.cache(lambda i, unit=unit: guess_cost(low[i : i + unit], rank))))
                i = j + 1
    return sorted(out, key=lambda r: r.start)


def guess_cost(value: str, rank: dict[str, int] = _OWN) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs; 0 for an empty one. A block of 2 to
    LONGEST_BLOCK characters that comes twice or more in a row costs what it costs once and log10 of its times."""
    value = value if len(value.lower()) == len(value) else value.lower()  # a few letters grow in lower case
    low, n = value.lower(), len(value)
    brute, other = [math.inf] * (n + 1), [math.inf] * (n + 1)  # cheapest that end in a brute-forced character or not
    other[0] = -PER_SPAN
    start = lambda i: min(brute[i], other[i]) + PER_SPAN
    runs, at, active = _runs(low, rank), 0, []
    for i in range(n + 1):
        if i:
            brute[i] = min(brute[i - 1], other[i - 1] + PER_SPAN) + PER_CHARACTER
        while at < len(runs) and runs[at].start <= i:
            active.append(runs[at])
            at += 1
        if active:
            active = [r for r in active if r.stop >= i]
            for run in active:
                other[i] = min(other[i], run.ending(i, start))
        if i < n:
            here = start(i)
            for j, cost in (*words_at(value, low, i, rank), *dates_at(low, i)):
                other[j] = min(other[j], here + cost)
    return max(0.0, min(brute[n], other[n]))


def _words(batches):
    counts: Counter[str] = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            counts.update(_WORD.findall(CONTEXT.sub(" ", text.as_py() or "").lower()))
            if len(counts) > HELD:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def common_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> list[str]:
    """The commonest words of all texts outside credential contexts, commonest first, equal ones by the word: at most
    `most`, and of the words that are as common as the first that would be one too many none."""
    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(_words, "word string, n long")
    counts = stored(found.groupBy("word").agg(F.sum("n").alias("n")), "words")
    least, held = 0, 0  # different counts are few: k of them need k * (k + 1) / 2 words
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        held += row.words
        if held > most:
            least = row.n
            break
    return [r.word for r in counts.where(F.col("n") > least).orderBy(F.desc("n"), "word").collect()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def costly_spans(text: str, least: float = LEAST_GUESSES, rank: dict[str, int] = _OWN) -> list[tuple[int, int, int]]:
    """Spans of the values in credential context that need 10 ** least guesses or more."""
    found = ((m, 2 if m[1] else 3) for m in CONTEXT.finditer(text))
    return [(m.start(k), 3, m.end(k)) for m, k in found if guess_cost(m[k], rank) >= least]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


def _scan(least: float, rank):
    def run(batches):
        for batch in batches:
            counts, digests, all_spans = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                base = base_spans(text or "")
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written(sorted(base + costly_spans(text or "", least, rank.value))))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_GUESSES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; an
    assignment's span is its whole match, a guess's the value. Guesses depend on the words of docs. base_sha256 is of the string of the fixed
    patterns' spans alone. A null or empty text has no spans. Null ids and repeated rows come back as they
    are; an empty table gives no rows.
    """
    rank = _shared(docs, text_col)
    return texts(docs, id_col, text_col).mapInArrow(_scan(least, rank), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _shared(docs: DataFrame, text_col: str):
    """The dictionary of docs, broadcast: MOST_WORDS words of LONGEST letters at most."""
    return docs.sparkSession.sparkContext.broadcast(ranks(common_words(docs, text_col)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", least: float = LEAST_GUESSES) -> DataFrame:
    """docs with the spans of text_col replaced by mask, overlapping ones by one; null stays null."""
    rank = _shared(docs, text_col)

    @F.udf("string", useArrow=True)
    def masked(text):
        if text is None:
            return None
        out, at = [], 0
        for i, _, j in sorted(base_spans(text) + costly_spans(text, least, rank.value)):
            if j > at:
                if i >= at:
                    out += [text[at:i], mask]
                at = j
        return "".join([*out, text[at:]])

    return docs.withColumn(text_col, masked(docs[text_col].cast("string")))
