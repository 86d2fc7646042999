"""Toxicity scores on text restored by a noisy-channel decoder."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy

#: What obfuscators write for a letter.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
#: Signs that are punctuation as well: they stand for a letter inside a word, the first two also before one.
WEAK = "!|+("
SEPARATORS = " .-_*"
_WORD = re.compile(r"[^\W\d_]+")
_LETTER, _SIGN, _WEAK, _SEP = 1, 2, 3, 4
#: Classes of code points; those over 127 count as letters.
_CLASS = np.zeros(129, np.uint8)
_CLASS[[*range(97, 123), 128]] = _LETTER
_CLASS[[ord(c) for c in LEET]] = _SIGN
_CLASS[[ord(c) for c in WEAK]] = _WEAK
_CLASS[[ord(c) for c in SEPARATORS]] = _SEP
#: Restored words or trigram scores that a task remembers.
WORDS = 50_000
#: What it costs to read a separator against its usual sense.
BREAK = -3.0


class _Alphabet(dict):
    """The character model's signs: a to z, ^ and $ around a word, and ? for all else."""

    def __missing__(self, code):
        return "?"


_ALPHABET = _Alphabet({ord(c): c for c in "abcdefghijklmnopqrstuvwxyz^$"})


@dataclass
class CharModel:
    """Character trigram model of words, with interpolated lower orders, over 29 signs: at most 29 ** 3 trigrams."""

    counts: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def grams(word: str):
        w = f"^^{word.translate(_ALPHABET)}$"
        for i in range(2, len(w)):
            yield w[i - 2 : i + 1]

    def __post_init__(self):
        self.tri, self.bi, self.uni = Counter(self.counts), Counter(), Counter()
        self.ctx3, self.ctx2, self.total = Counter(), Counter(), 0
        for g, n in self.counts.items():
            self.bi[g[1:]] += n
            self.uni[g[2]] += n
            self.ctx3[g[:2]] += n
            self.ctx2[g[1]] += n
            self.total += n
        self._known: dict[str, float] = {}

    def log_prob(self, gram: str) -> float:
        if gram not in self._known:
            if len(self._known) > WORDS:
                self._known.clear()
            g = gram.translate(_ALPHABET)
            p1 = (self.uni[g[2]] + 0.5) / (self.total + 100)
            p2 = (self.bi[g[1:]] + 5 * p1) / (self.ctx2[g[1]] + 5)
            self._known[gram] = math.log((self.tri[g] + 5 * p2) / (self.ctx3[g[:2]] + 5))
        return self._known[gram]


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """The arcs of a token, place by place: what stands there in the word that was meant, and its cost."""
    runs = [m[0] for m in re.finditer(r"(.)\1*", token, re.DOTALL)]
    # letters spelt singly stand between equal separators; wider ones, or a space among others, rather part words
    gaps = [m[0] for m in re.finditer(r"[ .\-_*]+", token)]
    usual, arcs = max(Counter(gaps).items(), key=lambda x: x[1], default=("", 0))[0], []
    gap = iter(gaps)
    for k, run in enumerate(runs):
        c = run[0]
        if c in LEET:
            arcs += [[*((x, -1.0) for x in LEET[c]), ("", -4.0)]] * min(len(run), 2)
        elif c.isalpha():
            arcs.append([(c, 0.0)] if len(run) == 1 else [(c + c, 0.0), (c, -2.5)] if len(run) == 2 else [(c, -0.5), (c + c, -0.7)])
        elif c in SEPARATORS:
            if not k or runs[k - 1][0] not in SEPARATORS:
                g = next(gap)
                wide = g != usual and (len(g) > len(usual) or g.isspace())
                arcs.append([("", BREAK if wide else 0.0), (" ", 0.0 if wide else BREAK)])
    return arcs


def restore(token: str, model: CharModel) -> str:
    """The likeliest words behind a lower-case token: exact Viterbi over its character lattice.

    Each sign may stand for a letter (LEET) or for nothing; a run of one letter for one or two of it; separators for
    nothing or for a word's end.  States are the last two letters, all of which are kept: at most the square of the
    letters that the last places may stand for.
    """
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    for options in _lattice(token):
        new: dict[str, tuple[float, tuple]] = {}
        for state, (score, word) in states.items():
            for letters, cost in options:
                s, total = state, score + cost
                if letters == " ":
                    if s == "^^":
                        continue  # no word without letters
                    total += model.log_prob(s + "$")
                    s = "^^"
                else:
                    for x in letters:
                        total += model.log_prob(s + x)
                        s = s[1] + x
                if s not in new or new[s][0] < total:
                    new[s] = (total, (word, letters) if letters else word)
        states = new or states
    word, out = max(((score + model.log_prob(s + "$"), word) for s, (score, word) in states.items()), key=lambda x: x[0])[1], []
    while word:
        word, letters = word
        out.append(letters)
    return "".join(reversed(out))


def disguised(low: str) -> list[str]:
    """The disguised words of a lower-case text, each whole.

    Words with a sign beside letters or a run of three equal letters, and runs of three or more single letters or signs
    between one to three separators, at least half of them letters.
    """
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < 3:
        return []
    c = _CLASS[np.minimum(code, 128)]
    pad = np.concatenate([[0], c, [0]])
    before, after = pad[:-2], pad[2:]
    letter, sign, weak = c == _LETTER, c == _SIGN, c == _WEAK
    hit = sign & ((before == _LETTER) | (after == _LETTER))
    inner = (before == _LETTER) | (before == _SIGN)
    hit |= weak & (after == _LETTER) & (inner | ((before == 0) | (before == _SEP)) & ((code == 33) | (code == 124)))
    same = letter[2:] & (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & (code[2:] < 128)
    hit[1:-1] |= same
    out = []
    at = np.flatnonzero(hit)
    if len(at):
        ends = np.flatnonzero((c == 0) | (code == 32))
        k = np.unique(np.searchsorted(ends, at))
        for lo, hi in zip(np.concatenate([[-1], ends])[k].tolist(), np.concatenate([ends, [len(c)]])[k].tolist(), strict=True):
            out.append(low[lo + 1 : hi].strip(WEAK[2:] + SEPARATORS).rstrip(WEAK))
    busy = (pad == _LETTER) | (pad == _SIGN) | (pad == _WEAK)
    alone = np.flatnonzero((letter | sign) & ~busy[:-2] & ~busy[2:])
    if len(alone) >= 3:
        seps, gap = np.cumsum(c == _SEP), np.diff(alone)
        near = (gap <= 4) & (seps[alone[1:] - 1] - seps[alone[:-1]] == gap - 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i >= 2 and 2 * letter[alone[i : j + 1]].sum() >= j - i + 1:
                out.append(low[alone[i] : alone[j] + 1])
    return out


def restored_words(low: str, model: CharModel, known: dict[str, str]) -> list[str]:
    """The restored forms of the disguised words of a lower-case text; ``known`` remembers some."""
    out = []
    for token in disguised(low):
        if len(token) > 1:
            if token not in known:
                if len(known) > WORDS:
                    known.clear()
                known[token] = restore(token, model)
            out.append(known[token])
    return out


def _documents(batch, column: int):
    """(row, lower-case text) of a batch."""
    for k, value in enumerate(batch.column(column)):
        yield k, (value.as_py() or "").lower()


def features(words: set[str]) -> set[str]:
    """A word (=w) and its beginnings of 4 to 7 letters (w)."""
    out = set()
    for w in words:
        out.add("=" + w)
        out.update(w[:k] for k in range(4, min(7, len(w)) + 1))
    return out


@dataclass
class ToxicityModel:
    """What ``fit`` learns: the character model, the lexicon with each entry's precision, the rate without a match."""

    chars: CharModel
    lexicon: dict[str, float]
    rest: float

    def pattern(self):
        words = sorted((re.escape(k[1:]) for k in self.lexicon if k[0] == "="), key=len, reverse=True)
        starts = sorted((re.escape(k) for k in self.lexicon if k[0] != "="), key=len, reverse=True)
        if not self.lexicon:
            return re.compile(r"(?!)")
        tail = r"(?:(?:" + "|".join(words) + r")(?![^\W\d_]))" if words else ""
        return re.compile(r"\b(?:" + "|".join([*starts, *([tail] if tail else [])]) + ")")

    def matches(self, low: str, pattern, known: dict[str, str]) -> set[str]:
        """Entries of the lexicon in a lower-case text and in the restored forms of its disguised words."""
        found = set(pattern.findall(low))
        for words in restored_words(low, self.chars, known):
            found.update(pattern.findall(words))
        return found

    def score(self, matched: set[str]) -> float:
        clean = 1 - self.rest
        for m in matched:
            clean *= 1 - max(self.lexicon.get(m, 0), self.lexicon.get("=" + m, 0))
        return 1 - clean


def held_out(doc_id):
    """The rows whose labels are never learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _symbols() -> np.ndarray:
    """The model's sign of each code point of the first plane: 1 to 26 for a to z, 27 for another letter, 0 for what parts words."""
    out = np.array([27 * (chr(i).isalnum() and not chr(i).isdecimal()) for i in range(1 << 16)], np.int32)
    out[97:123] = np.arange(1, 27)
    return out


_SIGNS = "^abcdefghijklmnopqrstuvwxyz?$"


def _trigram_counts(low: str, symbols: np.ndarray) -> np.ndarray:
    """How often each trigram, numbered by its signs in base 29, stands in the words of a lower-case text."""
    code = np.frombuffer(f"\n\n{low}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols[np.minimum(code, 0xFFFF)]
    s[code > 0xFFFF] = 27
    # what parts words, 0, is the mark before a word as well
    one, two = s[1:-1], np.where(s[1:-1] == 0, 0, s[:-2])
    last = np.where(s[2:] == 0, 28, s[2:])
    use = (s[2:] != 0) | (one != 0)
    return np.bincount(((two * 29 + one) * 29 + last)[use], minlength=29**3)


def character_model(docs: DataFrame) -> CharModel:
    """Counts the trigrams of the words of all of ``docs`` (text), over the 29 signs of ``CharModel``.

    Null and empty texts have no words; extra columns are ignored; an empty table gives an empty model.
    """

    def letters(batches):
        symbols, total = _symbols(), np.zeros(29**3, np.int64)
        held: list[str] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append((text.as_py() or "").lower())
                size += len(held[-1])
                if size > 1 << 20:
                    total += _trigram_counts("\n".join(held), symbols)
                    held, size = [], 0
        total += _trigram_counts("\n".join(held), symbols)
        at = np.flatnonzero(total)
        names = [_SIGNS[g // 841] + _SIGNS[g // 29 % 29] + _SIGNS[g % 29] for g in at.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total[at])], ["g", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(letters), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return CharModel({r["g"]: r["n"] for r in counts.collect()})  # at most 29 ** 3 rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 3) -> ToxicityModel:
    """Learns from at most ``sample`` labelled documents that aren't held out (those with the smallest id hashes).

    The character model counts the words of all documents, without labels.  Features are the words and word beginnings of restored texts.
    Sequential covering (``cover``) then picks the lexicon among features that occur in ``least`` toxic documents and in
    no more than a twentieth as many clean ones, so words that merely stand beside a toxic word in copies of one document
    aren't learned.  Rows with a null id, label or text teach nothing; of several labels of one id the largest holds; repeated
    documents teach as often as they stand there; empty tables give a model that finds nothing; extra columns are ignored.
    ``sample`` is the only bound: the driver holds the features of so many documents.
    """
    spark = docs.sparkSession
    labels = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = spark.createDataFrame(chosen.toPandas(), "doc_id long, toxic int") if sample <= 100_000 else chosen
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    train = train.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # at most ``sample`` rows

    chars = character_model(docs)

    def of(batch, known):
        for k, low in _documents(batch, 1):
            words = set(_WORD.findall(low))
            for w in restored_words(low, chars, known):
                words.update(_WORD.findall(w))
            yield k, features(words)

    def tally(batches):
        bad, good, known, n = Counter(), Counter(), {}, [0, 0]
        for batch in batches:
            toxic = batch.column(2).to_pylist()
            for k, found in of(batch, known):
                n[toxic[k] == 1] += 1
                (bad if toxic[k] == 1 else good).update(found)
        names = list(bad.keys() | {""})
        cols = [pa.array(names), pa.array([bad[x] if x else n[1] for x in names], pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([0 if x else n[0] for x in names], pa.int64())], ["f", "t", "c"])
        names = list(good)
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([good[x] for x in part], pa.int64())], ["f", "t", "c"])

    table = train.mapInArrow(tidy(tally), "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rows = table.where(f"f = '' or (t >= {least} and 20 * c <= t)").collect()
    size = next(((r["t"], r["c"]) for r in rows if r["f"] == ""), (0, 0))
    seen = {r["f"]: (r["t"], r["c"]) for r in rows if r["f"]}
    names = set(seen)

    def toxic_features(batches):
        known: dict[str, str] = {}
        for batch in batches:
            out, groups = [], []
            for _, found in of(batch, known):
                out.append([f for f in found if f in names])
                groups.append(min((zlib.crc32(f.encode()) for f in found), default=0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(groups, pa.int64())], ["f", "g"])

    rows = list(train.where("toxic = 1").mapInArrow(tidy(toxic_features), "f array<string>, g long").toLocalIterator())
    lexicon = cover([set(r["f"]) for r in rows], [r["g"] for r in rows], seen, least)
    bare = sum(not lexicon.keys() & set(r["f"]) for r in rows)
    return ToxicityModel(chars, lexicon, (bare + 0.5) / (bare + size[1] + 10))


def cover(cases: list[set[str]], groups: list[int], seen: dict[str, tuple[int, int]], least: int, times: int = 3, spread: int = 5) -> dict[str, float]:
    """Sequential covering: feature -> precision, until no feature is worth adding.

    A case (a toxic document's features) is covered after ``times`` features.  A feature needs ``least`` cases that
    none covers yet, or cases of ``spread`` (and a hundredth as many as all) different groups; copies of a document share a group, a MinHash value.
    """
    need = [times] * len(cases)
    where: dict[str, list[int]] = {}
    for i, case in enumerate(cases):
        for f in case:
            where.setdefault(f, []).append(i)
    gain = {f: len(at) for f, at in where.items()}
    lexicon: dict[str, float] = {}

    def rank(f):
        # of equal gains, the feature seen in most toxic documents, then the more specific
        return 20 * seen[f][1] - gain[f], -seen[f][0], -len(f), f

    heap = [rank(f) for f in gain]
    heapq.heapify(heap)
    spread = max(spread, len(cases) // 100)
    while heap:
        top = heapq.heappop(heap)
        best = top[-1]
        if gain[best] < least or any(k.startswith(best.lstrip("=")) or best.lstrip("=").startswith(k) for k in (x.lstrip("=") for x in lexicon)):
            continue
        if rank(best) != top:  # gains only fall, so an outdated place is too early
            heapq.heappush(heap, rank(best))
            continue
        at = [i for i in where[best] if need[i]]
        if sum(need[i] == times for i in at) >= least or len({groups[i] for i in at}) >= spread:
            lexicon[best] = (seen[best][0] + 1) / (sum(seen[best]) + 2)
            for i in at:
                need[i] -= 1
                if not need[i]:
                    for f in cases[i]:
                        gain[f] -= 1
    return lexicon


SCORE = "doc_id long, score double, matched array<string>"


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, matched for each row of ``docs`` (doc_id, text).

    The text and the restored forms of its disguised words (``restore``: leetspeak, spacing, repetition) are searched for
    the lexicon; the score is the chance that not every match is innocent: 1 - (1 - rest) * product of (1 - precision).

    Cases: null, empty and wordless texts have the rate of documents without a match; repeated rows score alike; a null
    doc_id isn't held out; whole texts are read, whatever their length; extra columns (labels, lang, source and others)
    are ignored; an empty table gives an empty result; with no toxic rows to learn from every score is near 0.
    """

    def run(batches):
        pattern, known = model.pattern(), {}
        for batch in batches:
            scores, matched = [], []
            for _, low in _documents(batch, 1):
                found = model.matches(low, pattern, known)
                scores.append(model.score(found))
                matched.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(matched, pa.list_(pa.string()))], ["doc_id", "score", "matched"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCORE)
    out = out.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matched")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (text, ...) that score under ``threshold``.

    All columns pass through, whatever their names and order, and rows stay whole; null, empty and repeated texts score as
    in ``score``; an empty table gives an empty result.
    """
    pattern_rows = docs.schema

    def run(batches):
        pattern, known = model.pattern(), {}
        for batch in batches:
            keep = []
            for _, low in _documents(batch, text_at):
                keep.append(model.score(model.matches(low, pattern, known)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    text_at = docs.columns.index("text")
    return docs.mapInArrow(tidy(run), pattern_rows)
