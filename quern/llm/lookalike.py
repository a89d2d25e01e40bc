"""One form for texts that look the same.

A text is first folded by rule: ignorable characters are deleted, full-width forms, ligatures and
all kinds of spaces become plain ones, accents are composed. Each run of letters is then a lattice
whose columns hold the look-alikes of one letter in every script; Viterbi picks the path with the
best character-bigram score, paying for every change of script. The lattice depends on what the
letters look like, not on which of the look-alikes was typed, so two runs that look the same have
one lattice and get one spelling, while any visible difference keeps the lattices apart.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.scratch import cut
from quern.plans.sizing import sized_join

# Letters of other scripts that are drawn like a Latin one.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
}
GREEK = {
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "α": "a", "υ": "u", "τ": "t", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
ARMENIAN = {"օ": "o", "Օ": "O", "Տ": "S", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Լ": "L", "Ս": "U"}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮢ": "R", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
}
# small capitals of letters whose capital is drawn like the small letter
LATIN = {"ɡ": "g", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z"}

# Characters that are not drawn at all (besides the joiners, which the context decides).
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0e\ufeff\uffa0\U000e0000-\U000e0fff"
ZWJ, EMOJI_STYLE = "\u200d", "\ufe0f"

SWITCH = 6.0  # price of a change of script inside a run of letters, in nats

_DROP = re.compile(f"[{IGNORABLE}]+")
_JOIN = re.compile("[\u200c\u200d\ufe0f]")
_SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_LINE = re.compile("\r\n|[\r\u0085\u2028\u2029]")
_RUN = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
#: Scripts whose letters join up or form clusters: there a joiner changes what is drawn.
_CURSIVE = re.compile("[\u0600-\u08ff\u0900-\u0dff\u1780-\u17ff\u1820-\u18af\ufb50-\ufdff\ufe70-\ufefc]")


def _table() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """(class of each letter, members of each class with the Latin one first)."""
    of: dict[str, str] = {}
    members: dict[str, list[str]] = {}
    for group in (LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE):
        for ch, latin in group.items():
            of[ch] = of[latin] = latin
            members.setdefault(latin, [latin])
            if group is not LATIN:
                members[latin].append(ch)
    return of, {k: tuple(v) for k, v in members.items()}


CLASS_OF, MEMBERS = _table()


def _compat(ch: str) -> str:
    """`ch` in the form it looks like: wide, narrow and no-break forms and letter ligatures are undone.

    Raised, lowered, circled and other forms that a reader sees as different stay.
    """
    d = unicodedata.decomposition(ch)
    if not d.startswith("<"):
        return ch
    tag = d[1 : d.index(">")]
    if tag in ("wide", "narrow", "noBreak"):
        plain = unicodedata.normalize("NFKC", ch)
    elif tag in ("compat", "initial", "medial", "final", "isolated"):
        plain = unicodedata.normalize("NFKC", ch)
        if not all(c.isalpha() or unicodedata.combining(c) for c in plain):
            return ch
    else:
        return ch
    return plain


@functools.lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    """Translation of every single character that another form stands for."""
    out = {}
    for o in (*range(0x132, 0x200), *range(0x2000, 0x2070), *range(0x2100, 0x2190), *range(0x3131, 0x3190), *range(0xFB00, 0xFEFF), *range(0xFF00, 0xFFF0)):
        ch = chr(o)
        plain = _compat(ch)
        if plain != ch:
            out[o] = plain
    out[0x2010] = out[0x2011] = "-"
    return out


@functools.lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """Anything that folding drops or changes; a text without it only has its accents decomposed."""
    points = sorted(_folds())
    ranges, start = [], None
    for i, o in enumerate(points):
        start = o if start is None else start
        if i + 1 == len(points) or points[i + 1] != o + 1:
            ranges.append(f"\\U{start:08x}-\\U{o:08x}")
            start = None
    return re.compile(f"[{IGNORABLE}\u200c\u200d\ufe0f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\r\u0085\u2028\u2029{''.join(ranges)}]")


def _joiner(m: re.Match) -> str:
    """A joiner stays where it shows: between letters of joining scripts or pictures; the picture style stays on pictures."""
    s, i = m.string, m.start()
    before, after = s[i - 1 : i], s[i + 1 : i + 2]
    if m.group() == EMOJI_STYLE:
        return EMOJI_STYLE if before and unicodedata.category(before) in ("So", "Sm", "Po", "Nd") and not before.isalpha() else ""
    if before and after:
        if _CURSIVE.match(before) and _CURSIVE.match(after):
            return m.group()
        picture = lambda c: unicodedata.category(c) in ("So", "Sk") or c == EMOJI_STYLE
        if m.group() == ZWJ and picture(before) and picture(after):
            return ZWJ
    return ""


def fold(text: str) -> str:
    """The text without what cannot be seen, in plain forms, accents decomposed (NFD)."""
    if text.isascii():
        return _LINE.sub("\n", text) if "\r" in text else text
    if _odd().search(text):
        text = _DROP.sub("", text)
        text = _JOIN.sub(_joiner, text)
        text = _SPACE.sub(" ", _LINE.sub("\n", text)).translate(_folds())
    return unicodedata.normalize("NFD", text)


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x250 <= o < 0x2B0 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x530 <= o < 0x590:
        return "A"
    if 0x13A0 <= o < 0x1400:
        return "K"
    if 0x1D00 <= o < 0x1DC0 or 0xA720 <= o < 0xA800:
        return "L"
    return "-"


_LETTERS_ONLY = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def runs_of(folded: str) -> list[str]:
    """The runs of letters of a folded text, in order."""
    if folded.isascii():
        return folded.encode().translate(_LETTERS_ONLY).decode().split()
    return _RUN.findall(folded)


class Spelling:
    """Character-bigram scores per script and the Viterbi search over look-alike lattices."""

    def __init__(self, bigrams: dict[str, int]) -> None:
        """`bigrams` counts pairs of letters of one script; "^x" and "x$" are the ends of a run."""
        totals: Counter = Counter()
        for pair, n in bigrams.items():
            totals[pair[0]] += n
        self._log = {p: math.log((n + 0.5) / (totals[p[0]] + 64.0)) for p, n in bigrams.items()}
        self._unseen = {c: math.log(0.5 / (n + 64.0)) for c, n in totals.items()}
        self._never = math.log(0.5 / 64.0)
        self._memo: dict[str, str] = {}

    def _bigram(self, a: str, b: str) -> float:
        return self._log.get(a + b, self._unseen.get(a, self._never))

    def spell(self, run: str) -> str:
        """The best spelling of a decomposed run of letters; runs that look the same get the same."""
        base = [CLASS_OF.get(c, c) for c in run]
        key = "".join(base)
        known = self._memo.get(key)
        if known is not None:
            return known
        best: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for c in base:
            if "\u0300" <= c <= "\u036f":  # an accent rides on the letter before it
                best = {last: (s, path + c) for last, (s, path) in best.items()}
                continue
            step: dict[str, tuple[float, str]] = {}
            for cand in MEMBERS.get(c, (c,)):
                script = _script(cand)
                top = None
                for last, (s, path) in best.items():
                    s += self._bigram(last, cand)
                    if last != "^" and _script(last) != script:
                        s -= SWITCH
                    if top is None or s > top[0]:
                        top = (s, path)
                step[cand] = (top[0], top[1] + cand)
            best = step
        out, score = "", None
        for last, (s, path) in best.items():  # the Latin member comes first and wins ties
            s += self._bigram(last, "$")
            if score is None or s > score:
                out, score = path, s
        if len(self._memo) < 1 << 18 and len(key) <= 64:
            self._memo[key] = out
        return out

    def canonical(self, text: str) -> str:
        """The one form of all texts that look like `text`, accents composed."""
        return self.canonical_all([text])[0]

    def canonical_all(self, texts: list[str], respelled: dict[str, str] | None = None) -> list[str]:
        """`canonical` of many texts; only texts that hold a run that changes are put together anew.

        `respelled` holds every run of the corpus that changes; without it each distinct run is spelled here.
        """
        folded = [fold(t) for t in texts]
        runs = [runs_of(f) for f in folded]
        changed = {w: k for w in set().union(*runs) if (k := self.spell(w)) != w} if respelled is None else respelled
        out = []
        for f, own in zip(folded, runs):
            if changed and not changed.keys().isdisjoint(own):
                f = _RUN.sub(lambda m: changed.get(m.group(), m.group()), f)
            out.append(f if f.isascii() else unicodedata.normalize("NFC", f))
        return out


def _in_play(run: str) -> bool:
    """Whether a run has letters of a script with look-alikes; others are spelled as they are and tell no bigrams."""
    return run.isascii() or any(_script(c) != "-" for c in run)


def run_bigrams(runs: Iterable[tuple[str, int]]) -> Counter:
    """Bigrams of the runs that are surely of one script: no mixture, and some letter without a look-alike. `runs` are (run, times)."""
    out: Counter = Counter()
    for run, n in runs:
        letters = [c for c in run if not "\u0300" <= c <= "\u036f"]
        scripts = {_script(c) for c in letters}
        if len(scripts) != 1 or "-" in scripts or all(c in CLASS_OF for c in letters):
            continue
        for a, b in zip(["^", *letters], [*letters, "$"]):
            out[a + b] += n
    return out


def count_bigrams(texts: Iterator[str]) -> Counter:
    """`run_bigrams` of the runs of some texts."""
    runs: Counter = Counter()
    for t in texts:
        runs.update(runs_of(fold(t)))
    return run_bigrams(runs.items())


def corpus_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """run, n: every distinct run of letters of the corpus that has look-alikes or tells bigrams, and how often it is there; kept in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    total.update(runs_of(fold(t)))
            own = [r for r in total if _in_play(r)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([total[r] for r in own], pa.int64())], ["run", "n"])

    return cut(documents.select(text).mapInArrow(count, "run string, n long").groupBy("run").agg(F.sum("n").alias("n")))


def corpus_bigrams(runs: DataFrame) -> dict[str, int]:
    """Bigram counts over all documents, from `corpus_runs`. At most (letters of five scripts)^2 rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total.update(run_bigrams(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

    counted = runs.mapInArrow(count, "pair string, n long")
    return {r["pair"]: r["n"] for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


#: Most runs whose spelling changes that are shared with all workers; with more, each worker spells the runs that it meets.
MOST_RESPELLED = 200_000


def respelled_runs(runs: DataFrame, model: tuple) -> dict[str, str] | None:
    """The runs of the corpus whose best spelling is another one, each searched for once; None if there are more than MOST_RESPELLED."""
    shared = runs.sparkSession.sparkContext.broadcast(model)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _spelling(shared.value)
        for b in batches:
            pairs = [(r, k) for r in b.column(0).to_pylist() if (k := spelling.spell(r)) != r]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["run", "spelled"])

    # kept first: all runs are searched at once, and only as many as may be are then brought together
    found = cut(runs.select("run").mapInArrow(spell, "run string, spelled string"))
    return {r["run"]: r["spelled"] for r in found.collect()} if found.count() <= MOST_RESPELLED else None


@functools.lru_cache(maxsize=2)
def _spelling(items: tuple[tuple[str, int], ...]) -> Spelling:
    return Spelling(dict(items))


def canonical_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """`key` and `canonical` of every row (null for a null text); with `digests` instead `look` and `exact`.

    `look` is a 128-bit digest of the canonical form, `exact` one of the text itself; rows whose
    text is null, empty or blank (nothing to see) are left out there.
    """
    runs = corpus_runs(documents, text)
    model = tuple(sorted(corpus_bigrams(runs).items()))
    shared = documents.sparkSession.sparkContext.broadcast((model, respelled_runs(runs, model)))
    kind = documents.schema[key].dataType
    names = [key, "look", "exact"] if digests else [key, "canonical"]
    result = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.BinaryType() if digests else T.StringType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, respelled = shared.value
        spelling = _spelling(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            there = [i for i, t in enumerate(texts) if t is not None]
            forms: list[str | None] = [None] * len(texts)
            for i, form in zip(there, spelling.canonical_all([texts[i] for i in there], respelled)):
                forms[i] = form
            if not digests:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string())], names)
                continue
            seen = [i for i, f in enumerate(forms) if f and not f.isspace()]
            mark = lambda t: hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest()
            look = [mark(forms[i]) for i in seen]
            exact = [k if texts[i] == forms[i] else mark(texts[i]) for i, k in zip(seen, look)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(seen, pa.int64())), pa.array(look, pa.binary()), pa.array(exact, pa.binary())], names)

    return documents.select(key, text).mapInArrow(run, result)


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text has another spelling somewhere: `key`, class_id, spelling_id, spellings, look and exact.

    A class is all rows that look the same, named by its smallest key; `spelling_id` is the smallest
    key of the rows with exactly this text, `spellings` how many there are in the class. One row per
    row however many rows a class has; null, empty and blank texts take no part, repeated rows of one
    key count once.
    """
    # 48 bytes a row, written once to the shared folder: the texts are read and spelled a single time
    rows = cut(canonical_texts(documents, key, text, digests=True).distinct())
    spellings = rows.groupBy("look", "exact").agg(F.min(key).alias("spelling_id"))
    classes = spellings.groupBy("look").agg(F.min("spelling_id").alias("class_id"), F.count(F.lit(1)).alias("spellings")).where(F.col("spellings") > 1)
    # a class that holds a third of all rows is split by adaptive execution: both joins have it on their big side only
    known = spellings.join(classes, "look")
    return sized_join(rows, known, ["look", "exact"]).select(key, "class_id", "spelling_id", "spellings", "look", "exact")


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`_1, `key`_2), smaller first: two rows whose texts look the same but are not the same string.

    The classes of `look_alike_classes` written out as pairs. Exact copies of one text are never
    compared with each other: the distinct spellings of a look are paired first (few, however many
    rows share them), and only those pairs are widened to rows, so the work follows the size of the
    result even where one text holds a third of all rows.
    """
    kept = cut(look_alike_classes(documents, key, text).select(key, "class_id", "spelling_id"))
    forms = kept.select("class_id", "spelling_id").distinct()
    pairs = forms.select("class_id", F.col("spelling_id").alias("s1")).join(forms.select("class_id", F.col("spelling_id").alias("s2")), "class_id").where(F.col("s1") < F.col("s2")).select("s1", "s2")
    first = kept.select(F.col("spelling_id").alias("s1"), F.col(key).alias("k1"))
    second = kept.select(F.col("spelling_id").alias("s2"), F.col(key).alias("k2"))
    wide = pairs.join(first, "s1").join(second, "s2").where(F.col("k1") != F.col("k2"))
    return wide.select(F.least("k1", "k2").alias(f"{key}_1"), F.greatest("k1", "k2").alias(f"{key}_2")).distinct()
