"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel compares sentences by the letter triples they share as gapped subsequences of their words: a triple that spans
s letters counts ``DECAY`` ** s, up to ``SPAN`` letters, so inserted characters weaken a match and do not undo it. Words
carry marks for their start and end. Characters that are no letters are gaps of their own and drop out; runs of single
letters set apart ("x y z") are read as a sentence of one word too. A sentence ends after a full stop, an exclamation or
a question mark, and after ``WORDS`` words at the latest. Letters that the training texts use often have a class each,
all others are spread over the classes by a hash, those of scripts without an alphabet too.

Training: a bounded sample of labelled documents (``SAMPLE_DOCS`` of each label, none over ``SAMPLE_CHARS`` characters) is
cut into sentences. All sentences of clean documents are labelled clean. A toxic document is toxic somewhere: its witnesses
are the sentences that are stronger than nearly all clean ones. At first strength is the rate at which a
sentence's words occur in toxic documents against clean ones, then the machine's value, in rounds, with the hardest clean
sentences as counter-examples; copies of the witnesses with a letter inserted train along. A sentence is mapped to its kernel
values against ``LANDMARKS`` strings, strong words and clean ones, whitened by the landmarks' own kernel (Nyström), and a
linear machine with squared hinge loss is fitted there.

Scoring: the machine is a sum over landmarks of kernel values, and the kernel a sum over letter triples, so the sum is
taken once a triple, and a sentence's value is the sum of its words' - the same numbers as against every landmark. A text
scores as its strongest sentence, through a logistic link fitted on the training documents. Each task looks at a word once
as long as its store, bounded by ``KEEP`` words, holds it.

Defined results: null and empty texts score as texts without words, just over 0; repeated rows score alike; without
labelled rows of both kinds every score is 0; rows with null labels do not train. Scores use the text alone. A column
that has the score's name is replaced in ``score_toxicity``'s result; give another name to keep it.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import plain, release

DECAY, SPAN = 0.8, 5
LANDMARKS, ROUNDS = 192, 3
WORDS = 16
SAMPLE_DOCS, SAMPLE_CHARS = 2500, 12_000
LONGEST, STEP = 24, 12
KEEP = 150_000
#: Texts whose words a task holds at a time.
SLICE = 200
ENDS = (".", "!", "?")
CLEAN_COST = 4.0
CLASSES = 64
GAPS = [(d, e) for e in range(2, SPAN) for d in range(1, e)]
SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[\s.*_\-]+[^\W\d_](?!\w)){2,}")
NO_LETTER = re.compile(r"[\W\d_]+")


def tokens_of(text: str) -> list[str]:
    """The words of a text as they stand; runs of single letters follow, joined, each as a sentence of its own."""
    found = text.lower().split()
    for run in SPACED.finditer(text):
        found += [".", NO_LETTER.sub("", run[0]).lower() + "."]
    return found


def words_of(text: str) -> set[str]:
    """The different words of a text, letters only."""
    return {NO_LETTER.sub("", w) for w in tokens_of(text)} - {""}


def starts_of(ends: np.ndarray) -> np.ndarray:
    """Where sentences start, from whether each token ends one."""
    at = np.arange(len(ends))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ends[:-1]]), at, 0))
    return np.nonzero((at - first) % WORDS == 0)[0]


class Letters:
    """Words as rows of letter classes: 0 is padding, 1 the mark at either end, the rest letters by frequency."""

    def __init__(self, letters: str) -> None:
        self.table = 2 + self._spread(np.arange(0x3000))
        for i, letter in enumerate(letters[: CLASSES - 8]):
            if ord(letter) < len(self.table):
                self.table[ord(letter)] = 8 + i
        self.table[0], self.table[1] = 0, 1

    @staticmethod
    def _spread(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (CLASSES - 2)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(classes, owner): a row for each word, several for words longer than ``LONGEST``, which overlap."""
        parts, owners = [], []
        for i, word in enumerate(words):
            word = "\1" + NO_LETTER.sub("", word) + "\1"
            for at in range(0, max(1, len(word) - STEP), STEP) if len(word) > LONGEST else (0,):
                parts.append(word[at : at + LONGEST].ljust(LONGEST, "\0"))
                owners.append(i)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).reshape(-1, LONGEST)
        known = codes < len(self.table)
        return np.where(known, self.table[np.where(known, codes, 0)], 2 + self._spread(codes)), np.array(owners, dtype=np.int64)


def triples(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(codes, valid, weight) of the gapped triples with each pair of gaps."""
    for d, e in GAPS:
        first, second, third = rows[:, : LONGEST - e], rows[:, d : LONGEST - e + d], rows[:, e:]
        yield (first * CLASSES + second) * CLASSES + third, third > 0, DECAY ** (e - 2)


def norms(rows: np.ndarray) -> np.ndarray:
    """The kernel's scale, by length alone: the root of the squared weights of all triples."""
    return np.sqrt(np.maximum(sum(valid.sum(axis=1) * weight * weight for _, valid, weight in triples(rows)), 1.0))


def explicit(rows: np.ndarray) -> list[dict[int, float]]:
    """Each row's triples with their weights, scaled."""
    found: list[Counter] = [Counter() for _ in rows]
    for codes, valid, weight in triples(rows):
        for row, at in zip(*np.nonzero(valid), strict=True):
            found[row][int(codes[row, at])] += weight
    return [{k: v / n for k, v in x.items()} for x, n in zip(found, norms(rows), strict=True)]


def spread(parts: list[dict[int, float]]) -> np.ndarray:
    """The rows of ``explicit`` as a matrix over the triples that occur in them."""
    names = {k: i for i, k in enumerate(sorted({k for x in parts for k in x}))}
    out = np.zeros((len(names) + 1, len(parts)), dtype=np.float32)
    for i, part in enumerate(parts):
        out[[names[k] for k in part], i] = list(part.values())
    index = np.full(CLASSES**3, len(names), dtype=np.int32)
    index[list(names)] = list(names.values())
    return out, index


def kernel(rows: np.ndarray, landmarks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The kernel of each row with each landmark."""
    values, index = landmarks
    out = np.zeros((len(rows), values.shape[1]), dtype=np.float32)
    for codes, valid, weight in triples(rows):
        at = np.where(valid, index[codes], len(values) - 1)
        for i in range(at.shape[1]):
            out += weight * values[at[:, i]]
    return out / norms(rows)[:, None]


class Scorer:
    """A fitted machine: weights of the triples, and the link from the strongest sentence to a score."""

    def __init__(self, letters: str, weights: np.ndarray, bias: float, slope: float, middle: float) -> None:
        self.letters, self.weights, self.bias, self.slope, self.middle = letters, weights, bias, slope, middle

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word what it adds to its sentence's value, and to its squared length."""
        value, size = np.zeros(len(words)), np.zeros(len(words))
        reader = Letters(self.letters)
        for at in range(0, len(words), 20_000):
            rows, owner = reader.rows(words[at : at + 20_000])
            total = np.zeros(len(rows))
            for codes, valid, weight in triples(rows):
                total += weight * np.where(valid, self.weights[codes], 0).sum(axis=1)
            np.add.at(value, owner + at, total)
            np.add.at(size, owner + at, norms(rows) ** 2 * (rows[:, 2] > 0))
        return value, size

    def sentences(self, value: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The machine's value for each sentence, from its words' parts."""
        return np.add.reduceat(value, starts) / np.maximum(np.add.reduceat(size, starts), 1.0) ** 0.5 + self.bias

    def words(self, words: list[str]) -> np.ndarray:
        """The machine's value for each word as a sentence of its own."""
        return self.sentences(*self.parts(words), np.arange(len(words)))

    def link(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -30, 30)))


class Strength:
    """The values of texts: that of their strongest sentence. Words that were met are remembered."""

    def __init__(self, scorer: Scorer) -> None:
        self.scorer, self.place = scorer, {}
        self.value = self.size = np.zeros(0)
        self.ends = np.zeros(0, dtype=bool)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.place) > KEEP:
            self.__init__(self.scorer)
        new = sorted(set().union(*texts).difference(self.place))
        value, size = self.scorer.parts(new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.value, self.size = np.concatenate([self.value, value]), np.concatenate([self.size, size])
        self.ends = np.concatenate([self.ends, np.array([w.endswith(ENDS) for w in new], dtype=bool)])

    def sentences(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, values) of a learned text's sentences."""
        at = np.fromiter(map(self.place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        starts = starts_of(self.ends[at])
        which = np.zeros(len(at), dtype=np.int64)
        which[starts[1:]] = 1
        once = np.unique(np.cumsum(which) << 32 | at)  # a word counts once in its sentence
        at = once & 0xFFFFFFFF
        firsts = np.nonzero(np.diff(once >> 32, prepend=-1))[0]
        return starts, self.scorer.sentences(self.value[at], self.size[at], firsts)

    def strongest(self, tokens: list[str]) -> float:
        return float(self.sentences(tokens)[1].max()) if tokens else -np.inf

    def of(self, texts: list[str]) -> list[float]:
        """The texts' values; the words of ``SLICE`` texts are held at a time."""
        found = []
        for at in range(0, len(texts), SLICE):
            tokens = [tokens_of(t) for t in texts[at : at + SLICE]]
            self.learn(tokens)
            found += map(self.strongest, tokens)
        return found


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        margin = y * (x @ w)
        on = margin < 1
        a = x[on] * (cost * weight[on])[:, None]
        step = np.linalg.solve(ridge + x[on].T @ a, ridge @ w - a.T @ (y[on] - x[on] @ w))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _marred(word: str, letters: str, turn: int) -> str:
    """The word with one foreign letter inserted, at an inner place."""
    at = 2 + turn % max(1, len(word) - 3)
    return word[:at] + letters[(7 * turn + ord(word[0])) % len(letters)] + word[at:]


def cut(tokens: list[str]) -> list[list[str]]:
    """A text's different words in sentences, letters only."""
    if not tokens:
        return []
    starts = [*starts_of(np.array([w.endswith(ENDS) for w in tokens])).tolist(), len(tokens)]
    found = ([x for x in dict.fromkeys(NO_LETTER.sub("", w) for w in tokens[a:b]) if x] for a, b in zip(starts, starts[1:], strict=False))
    return [x for x in found if x]


def _features(sentences: list[list[str]], reader: Letters, landmarks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The kernel of each sentence with each landmark."""
    words = sorted({w for s in sentences for w in s})
    place = {w: i for i, w in enumerate(words)}
    rows, owner = reader.rows(words)
    scale = norms(rows)
    by_word, size = np.zeros((len(words), landmarks[0].shape[1]), dtype=np.float32), np.zeros(len(words))
    np.add.at(by_word, owner, kernel(rows, landmarks) * scale[:, None].astype(np.float32))
    np.add.at(size, owner, scale**2)
    at, starts = np.array([place[w] for s in sentences for w in s]), np.cumsum([0, *(len(s) for s in sentences[:-1])])
    return np.add.reduceat(by_word[at], starts) / np.add.reduceat(size[at], starts)[:, None] ** 0.5


def fit(texts: list[str], toxic: list[bool]) -> Scorer | None:
    """Trains on labelled texts, cut into sentences; None without both labels. The link is fitted on every fifth text, which
    the machine did not see; where either label has fewer than 50 texts, on all of them."""
    if not any(toxic) or all(toxic):
        return None
    apart = min(toxic.count(True), toxic.count(False)) >= 50
    seen = [not apart or i % 5 < 4 for i in range(len(texts))]
    pick = lambda values, side: [v for v, s in zip(values, seen, strict=True) if s == side or not apart]
    scorer = _fit_machine(pick(texts, True), pick(toxic, True))
    tokens, strength = [tokens_of(t) for t in pick(texts, False)], Strength(scorer)
    strength.learn(tokens)
    margin = np.array([strength.strongest(t) if t else -1.0 for t in tokens])
    scorer.slope, scorer.middle = _link(margin, np.array(pick(toxic, False)))
    return scorer


def _fit_machine(texts: list[str], toxic: list[bool]) -> Scorer:
    tokens = [tokens_of(t) for t in texts]
    bags = [cut(t) for t in tokens]
    letters = "".join(c for c, _ in Counter(c for b in bags for s in b for w in s for c in w if c.isalpha()).most_common(CLASSES - 8))
    n = [toxic.count(False), toxic.count(True)]
    counts = [Counter(w for b, t in zip(bags, toxic, strict=True) if t == side for w in {w for s in b for w in s}) for side in (False, True)]
    rate = {w: np.log((k + 0.1) / n[1]) - np.log((counts[0][w] + 1.0) / n[0]) for w, k in counts[1].items() if k >= 3}
    strong = sorted(rate, key=lambda w: (-rate[w], w))
    clean = [s for b, t in zip(bags, toxic, strict=True) if not t for s in b]
    worst = [max((rate.get(w, 0.0) for w in s), default=0.0) for s in clean]
    bar = max(float(np.quantile(worst, 0.999)), 0.7) if worst else 0.7
    strongest_of = lambda s: max((rate.get(w, 0.0) for w in s), default=0.0)
    bad = [b for b, t in zip(bags, toxic, strict=True) if t and b]
    witnesses = [s for b in bad for s in b if strongest_of(s) > bar] or [max(b, key=strongest_of) for b in bad]
    witnesses = [witnesses[i] for i in np.random.default_rng(11).permutation(len(witnesses))[:3000]]
    dice = np.random.default_rng(7)
    hard = [clean[i] for i in dice.permutation(len(clean))[:2500]]
    plain_words = sorted({w for s in hard for w in s})
    plain_words = [plain_words[i] for i in dice.permutation(len(plain_words))]
    every = sorted({w for b in bags for s in b for w in s})
    place = {w: i for i, w in enumerate(every)}
    reader, scorer = Letters(letters), None
    for _ in range(ROUNDS):
        strongest = [max(s, key=lambda w: rate.get(w, 0.0) if scorer is None else known[w]) for s in witnesses]
        marks = [w for w, _ in Counter(strongest).most_common(LANDMARKS // 2)]
        marks += [w for w in plain_words if w not in marks][: LANDMARKS - len(marks)]
        rows, _ = reader.rows([w[:LONGEST - 2] for w in marks])
        parts = explicit(rows)
        landmarks = spread(parts)
        own = kernel(rows, landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        white = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
        marred = [[_marred(w, letters, i) if w == top and len(w) > 3 else w for w in s] for i, (s, top) in enumerate(zip(witnesses, strongest, strict=True))]
        examples = [*witnesses, *marred, *hard]
        x = np.concatenate([_features(examples, reader, landmarks) @ white, np.ones((len(examples), 1))], axis=1)
        y = np.where(np.arange(len(examples)) < 2 * len(witnesses), 1.0, -1.0)
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / max(1, (y < 0).sum()))
        w = _machine(x, y, share * len(y))
        by_mark, weights = white @ w[:-1], np.zeros(CLASSES**3)
        for part, mark in zip(parts, by_mark, strict=True):
            weights[list(part)] += mark * np.array(list(part.values()))
        scorer = Scorer(letters, weights.astype(np.float32), float(w[-1]), 1.0, 0.0)
        value, size = scorer.parts(every)
        known = dict(zip(every, scorer.sentences(value, size, np.arange(len(every))).tolist(), strict=True))
        of = []
        for bag in bags:
            at, starts = np.array([place[w] for s in bag for w in s], dtype=np.int64), np.cumsum([0, *(len(s) for s in bag[:-1])])
            of.append(scorer.sentences(value[at], size[at], starts) if bag else np.zeros(0))
        at_clean = np.concatenate([v for v, t in zip(of, toxic, strict=True) if not t])
        bar = max(float(np.quantile(at_clean, 0.999)), 0.0)
        found = [s for b, v, t in zip(bags, of, toxic, strict=True) if t for s, x in zip(b, v, strict=True) if x > bar]
        witnesses = [found[i] for i in np.random.default_rng(11).permutation(len(found))[:3000]] or witnesses
        worst = np.argsort(-at_clean)[:1500]
        hard = [*hard, *(clean[i] for i in worst if at_clean[i] > -1)][-6000:]
    return scorer


def _link(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic link with smoothed targets; a clean text that is flagged weighs ``CLEAN_COST`` times a toxic one
    that is missed."""
    hi, lo = margin[toxic], margin[~toxic]
    cuts = np.unique(np.concatenate([hi, lo]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    miss = np.searchsorted(np.sort(hi), cuts) / len(hi) + CLEAN_COST * (1 - np.searchsorted(np.sort(lo), cuts) / len(lo))
    best = cuts[miss <= miss.min() + 1e-9]
    middle = float((best.min() + best.max()) / 2)
    return 4.0, middle


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """text, bad, order, id: at most ``SAMPLE_DOCS`` texts of each label, chosen by a hash of the id, from rows that may train:
    those whose crc32(doc_id as text) mod 5 is not 0."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("bad"))
    marks = marks.where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    some = docs.select(F.col(id_col).alias("id"), plain(text_col).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    order = F.xxhash64("id", F.lit("toxicity"))
    parts = []
    for bad in (True, False):
        chosen = marks.where("bad" if bad else "not bad").orderBy(order, "id").limit(2 * SAMPLE_DOCS).select("id")
        found = some.join(F.broadcast(chosen), "id").withColumn("order", order).orderBy("order", "id", "text").limit(SAMPLE_DOCS)
        parts.append(found.select("text", F.lit(bad).alias("bad"), "order", "id"))
    return parts[0].unionByName(parts[1])


def score_toxicity(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: from 0 to 1, higher where toxic is likelier."""
    if scorer is None:
        return docs.withColumn(name, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strength = Strength(held.value)
        for texts in batches:
            yield pd.Series(held.value.link(np.array(strength.of(texts.tolist()), dtype=np.float64)))
        del strength
        release()

    return docs.withColumn(name, run(plain(text_col)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer | None:
    """Learns in a task, since the sample and what is made of it would be the most that the driver holds."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(text, bad) for batch in batches for text, bad in zip(batch["text"], batch["bad"].tolist(), strict=True)]
        yield pd.DataFrame({"scorer": [pickle.dumps(fit([t for t, _ in rows], [b for _, b in rows]))]})
        del rows
        release()

    sample = labelled_sample(docs, labels, id_col, text_col).repartition(1).sortWithinPartitions(F.desc("bad"), "order", "id", "text")
    found = sample.select("text", "bad").mapInPandas(learn, "scorer binary").collect()
    return pickle.loads(found[0]["scorer"]) if found else None
