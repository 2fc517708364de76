"""Operator 7: toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled rows: words, and stems that many words share, that mark
toxic texts. Words with digits or marks inside are tried as they stand, too. All automata of its words run along its trie as one automaton, whose states are
built when first met, so that a clean word is left after a few letters. Each hit counts by
its kind and by its context: hits within quotation count apart from the others.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold, table
from .quality import _sigmoid, linear_score
from .textstats import bounded, one_label

#: Labelled rows to learn from (toxic, clean), and terms of the lexicon, at most about.
TOXIC, CLEAN, TERMS = 6_000, 14_000, 2_000
#: Words to each side that decide whether a hit is quoted.
CONTEXT = 6
EXACT, STEM, FUZZY, LOOSE = 1, 2, 3, 4
KINDS = ["exact", "stem", "fuzzy", "loose", "quoted"]
FEATURES = [*KINDS, "density"]
_QUOTES = "\"“”„«»"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Marks and digits beyond ASCII that part words.
_MARKS = {c: " " for c in [*range(128, 0x3040), *range(0xFE30, 0xFFF0)] if unicodedata.category(chr(c))[0] in "PSZNC"}
_SPACES = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """The lower-case runs of letters of a text."""
    if not text:
        return []
    plain = text.lower().encode().translate(_SPACES).decode()
    return (plain if text.isascii() else plain.translate(_MARKS)).split()


def disguised(text: str | None) -> list[str]:
    """Words with digits or marks between their letters, without those around them."""
    out = []
    for w in text.lower().split() if text else ():
        if not w.isalpha() and len(w) <= 40:
            runs = [m.span() for m in _LETTERS.finditer(w)]
            if len(runs) > 1:
                out.append(w[runs[0][0] : runs[-1][1]])
    return out


class Automaton:
    """Words within one edit of a term, or with a stem as prefix.

    A state is a set of (trie node, edits) pairs. Stems and terms under four letters take no
    edit; one edit of a term of four is a kind of its own.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for kind, group in ((EXACT, terms), (STEM, stems)):
            for t in group:
                self.ends.setdefault(self._add(t), kind)
        self.edited = {self._add(t): FUZZY if len(t) > 4 else LOOSE for t in terms if len(t) >= 4}
        self.ids: dict[frozenset, int] = {}
        self.states: list[tuple[frozenset, dict[str, int], int]] = []
        self.start = self._state(self._closed({(0, 0)}))
        self.dead = self._state(frozenset())
        self.known: dict[str, int] = {}

    def _add(self, t: str) -> int:
        at = 0
        for c in t:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
            at = self.children[at][c]
        return at

    def _closed(self, pairs: set) -> frozenset:
        """With a letter of the term left out."""
        return frozenset(pairs | {(n, 1) for p, e in pairs if e == 0 for n in self.children[p].values()})

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.ids:
            kinds = [self.ends.get(p) if e == 0 else self.edited.get(p) for p, e in pairs]
            self.ids[pairs] = len(self.states)
            self.states.append((pairs, {}, min(filter(None, kinds), default=0)))
        return self.ids[pairs]

    def _step(self, state: int, c: str) -> int:
        pairs, moves, _ = self.states[state]
        if any(e == 0 and self.ends.get(p) == STEM for p, e in pairs):
            moves[c] = state  # a stem takes any ending
            return state
        out = set()
        for p, e in pairs:
            if c in self.children[p]:
                out.add((self.children[p][c], e))
            if e == 0:
                out.add((p, 1))
                out.update((n, 1) for n in self.children[p].values())
        moves[c] = self._state(self._closed(out)) if out else self.dead
        return moves[c]

    def __call__(self, word: str) -> int:
        kind = self.known.get(word)
        if kind is None:
            at = self.start
            for c in word:
                after = self.states[at][1].get(c)
                at = self._step(at, c) if after is None else after
                if at == self.dead:
                    break
            kind = self.states[at][2]
            if len(self.known) >= 300_000:
                self.known.clear()
            self.known[word] = kind
        return kind


def quoted(text: str, words: set[str]) -> Counter:
    """How often each of the words stands within quotation marks a few words around.

    An odd number of marks in the words before, and one in those after, make a quotation.
    """
    lower, out = text.lower(), Counter()
    spans = [m.span() for m in _LETTERS.finditer(lower)]
    marks = [i for i, c in enumerate(lower) if c in _QUOTES]
    ahead = np.searchsorted(marks, [a for a, _ in spans]) if spans else []
    for k, (a, z) in enumerate(spans):
        if lower[a:z] in words:
            opened = ahead[k] - (ahead[k - CONTEXT] if k > CONTEXT else 0)
            closed = (ahead[k + CONTEXT] if k + CONTEXT < len(spans) else len(marks)) - ahead[k]
            out[lower[a:z]] += bool(opened % 2 and closed)
    return out


def learn_lexicon(known: DataFrame, scratch: Scratch, share: float = 0.006, odds: float = 20.0, stem_odds: float = 40.0) -> tuple[list[str], list[str]]:
    """Words and stems of rows (text, label) whose odds in toxic texts are that much higher.

    A term must be in that share of the toxic texts, and in five. Equal texts count once.
    """
    known = known.select("text", "label").distinct()

    def count(batches):
        for b in batches:
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[1 if y else 0].update(set(words_of(t)))
            words = [*{**n[0], **n[1]}]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array([n[1][x] for x in words], pa.int64()), "clean": pa.array([n[0][x] for x in words], pa.int64())})

    total = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return [], []
    least = max(5, round(share * total[1]))
    df = known.select("text", "label").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    df = scratch.keep(df.where("length(word) > 2"), "words")
    rate = ((F.col("toxic") + 0.5) / total[1]) / ((F.col("clean") + 0.5) / total[0])
    good = lambda x, o: x.withColumn("rate", rate).where((F.col("toxic") >= least) & (F.col("rate") >= o)).orderBy(F.col("rate").desc(), F.col("toxic").desc(), F.col("term")).limit(TERMS).collect()
    terms = good(df.withColumnRenamed("word", "term"), odds)
    cut = df.select(F.explode(F.transform(F.sequence(F.lit(4), F.least(F.lit(7), F.length("word") - 1)), lambda n: F.substring("word", F.lit(1), n))).alias("term"), "toxic", "clean").where("length(term) > 3")
    cut = cut.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("n")).where("n >= 4")
    stems: list[str] = []
    for r in sorted(good(cut, stem_odds), key=lambda r: (len(r.term), r.term)):
        if r.toxic >= 3 * least and not any(r.term.startswith(s) for s in stems):
            stems.append(r.term)
    return [r.term for r in terms], stems


def hits(docs: DataFrame, terms: list[str], stems: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, KINDS (hits by kind, and those quoted), ``n_words`` and ``found`` (terms hit) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        match = Automaton(terms, stems)
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py()
                words = words_of(text)
                found = Counter((w, k) for w, k in zip(words, map(match, words)) if k)
                hidden = Counter(w for w in disguised(text) if match(w) in (FUZZY, LOOSE))
                n = [0] * len(KINDS)
                marks = quoted(text, {w for w, _ in found}) if found and any(q in text for q in _QUOTES) else Counter()
                for (w, k), c in found.items():
                    q = min(c, marks[w])
                    n[k - 1] += c - q
                    n[-1] += q
                n[FUZZY - 1] += hidden.total()
                out.append((*n, len(words), sorted({w for w, _ in found} | set(hidden))))
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(len(KINDS) + 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([x[-1] for x in out], pa.list_(pa.string()))], names=["id", *KINDS, "n_words", "found"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in KINDS) + ", n_words long, found array<string>")


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    z = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = (np.zeros(z.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        g = z.T @ (_sigmoid(z @ w) - y) / len(y) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None) -> DataFrame:
    """Every row's ``id``, ``score`` (the chance of label 1), hits by kind and ``found`` terms.

    ``learn`` (over id_col) says whose labels may be used. The lexicon and the weights are
    fitted on a bounded sample of labelled rows; with one label only, or none, the score is
    that label's share, 0 without labels. Null and empty texts have no hits. Ids may be null
    (never labelled) or repeat: each row is scored for itself, so repeated rows score alike;
    of an id's several labels the least counts. Texts are read whole in one pass over their
    words, however long. Terms of equal odds order by frequency, then by spelling. An empty
    table gives no rows. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    usable = slim if learn is None else docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    label = one_label(labels, id_col, label_col)
    label = label if learn is None else label.withColumnRenamed("id", id_col).where(learn).withColumnRenamed(id_col, "id")
    drawn = bounded(label.where("label = 1"), TOXIC, 1).union(bounded(label.where("label <> 1"), CLEAN, 2)).withColumn("label", (F.col("label") == 1).cast("int"))
    share = label.agg(F.avg((F.col("label") == 1).cast("int"))).first()[0]
    known = scratch.keep(usable.join(drawn, "id"), "known")
    terms, stems = learn_lexicon(known, scratch)
    cols = [F.log1p(k).alias(k) for k in KINDS]
    dense = (100.0 * (F.col("exact") + F.col("stem") + F.col("fuzzy") + F.col("loose")) / F.greatest("n_words", F.lit(1))).alias("density")
    rows = np.array([list(map(float, r)) for r in hits(known, terms, stems, "id").join(drawn, "id").select("label", *cols, dense).collect()]).reshape(-1, 1 + len(FEATURES))
    marked = hits(slim, terms, stems, "id").select("id", *[F.col(k).alias(f"{k}_hits") for k in KINDS], "found", *cols, dense)
    if len(rows) and 0 < rows[:, 0].sum() < len(rows):
        rows = rows[np.lexsort(rows.T)]
        mean, scale = rows[:, 1:].mean(axis=0), np.maximum(rows[:, 1:].std(axis=0), 1e-2)
        score = linear_score(FEATURES, mean, scale, fit_logistic(np.clip((rows[:, 1:] - mean) / scale, -6, 6), rows[:, 0]))
    else:
        score = F.lit(float(share or 0))
    return marked.select("id", score.alias("score"), *[f"{k}_hits" for k in KINDS], "found")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    return out.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[f"{k}_hits" for k in KINDS])
