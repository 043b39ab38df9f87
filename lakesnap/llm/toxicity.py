"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata, judged in context windows.

The lexicon holds words and word beginnings that labels tie to toxic texts. It is a trie; a word is matched by the
intersection of that trie with the word's edits, run as one automaton whose states are sets of (trie node, edits) and
are made when first reached. Hits are then counted by kind, alone and in company, inside quotation and outside, and a
logistic model turns the counts into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesnap.llm.common import Cache, Memo, claim, small_batches

WORD = re.compile(r"\w+")
MARK = re.compile(r"\w+|[\"“”„«»‘’]")
#: Labelled rows that the model is fitted on at most, those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Entries of the lexicon at most; texts that a term must be in; lengths of word beginnings.
TERMS, LEAST, STEMS = 400, 5, (3, 4, 5, 6, 7)
FUZZY_FROM = 5  # letters from which a word may have an edit
WINDOW = 12  # words on either side of a hit
#: Bytes of the memo of words; letters of a word that enters it.
MEMO, LONG = 24 << 20, 64
#: Verbs and nouns that report someone else's words, in four languages.
REPORTING = frozenset("said says called calls wrote quote quoted quoting reported reports cited term word words insult insults sagte nannte zitat wort dit appelé citation mot dijo llamó cita palabra".split())
FEATURES = ("exact", "fuzzy", "stem", "weight", "company", "quoted", "density", "kinds")


@dataclass
class Lexicon:
    """terms: word -> weight; stems: word beginning -> weight."""

    terms: dict[str, float]
    stems: dict[str, float]
    edits: int = 1
    _trie: list[dict[str, int]] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        self._trie, self._ends, self._stops = [{}], {}, {}
        for words, ends in ((self.terms, self._ends), (self.stems, self._stops)):
            for w in words:
                node = 0
                for c in w:
                    nxt = self._trie[node].get(c)
                    if nxt is None:
                        nxt = self._trie[node][c] = len(self._trie)
                        self._trie.append({})
                    node = nxt
                ends[node] = w
        self._states: dict[frozenset, int] = {}
        self._moves: list[dict[str, int]] = []
        self._sets: list[frozenset] = []
        self._start = self._state({(0, 0)})
        self.looked_up = Memo("toxicity", MEMO, lambda w: self.find(w) or (), LONG)
        self._longest_stem, self._longest = max(map(len, self.stems), default=0), max(map(len, self.terms), default=0)

    def _state(self, positions: set[tuple[int, int]]) -> int:
        todo = list(positions)
        while todo:  # letters that the word lacks
            node, e = todo.pop()
            if e < self.edits:
                for child in self._trie[node].values():
                    if (child, e + 1) not in positions:
                        positions.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in positions:
            best[node] = min(e, best.get(node, e))
        key = frozenset(best.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append({})
        return self._states[key]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self._sets[state]:
            child = self._trie[node].get(c)
            if child is not None:
                out.add((child, e))
            if e < self.edits:
                out.add((node, e + 1))
                out |= {(x, e + 1) for x in self._trie[node].values()}
        nxt = self._moves[state][c] = self._state(out)
        return nxt

    def find(self, word: str) -> tuple[str, str] | None:
        """The best match of a word: (kind, entry) of an exact term, a beginning, or a term with an edit; or None."""
        if word in self.terms:
            return "exact", word
        for n in range(min(len(word), self._longest_stem), 0, -1):
            if word[:n] in self.stems:
                return "stem", word[:n]
        if not FUZZY_FROM <= len(word) <= self._longest + self.edits:
            return None
        state = self._start
        for c in word:
            nxt = self._moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if not self._sets[state]:
                return None
        close = [(e, self._ends[n]) for n, e in self._sets[state] if n in self._ends and len(self._ends[n]) >= FUZZY_FROM]
        return ("fuzzy", min(close)[1]) if close else None


def features(lexicon: Lexicon, text: str | None) -> list[float]:
    """FEATURES of a text; all 0 without hits. Time is linear in the text."""
    low = (text or "").lower()
    tokens = WORD.findall(low)
    found = [(k, *hit) for k, hit in enumerate(map(lexicon.looked_up.__getitem__, tokens)) if hit]
    if not found:
        return [0.0] * len(FEATURES)
    kinds = Counter(kind for _, kind, _ in found)
    inside = _inside_quotes(low)
    at = [k for k, _, _ in found]
    quoted = company = 0
    for n, k in enumerate(at):
        near = tokens[max(0, k - 4) : k]
        quoted += k in inside or any(w in REPORTING for w in near)
        company += (n > 0 and k - at[n - 1] <= WINDOW) or (n + 1 < len(at) and at[n + 1] - k <= WINDOW)
    weights = [(lexicon.stems if kind == "stem" else lexicon.terms)[entry] for _, kind, entry in found]
    return [
        math.log1p(kinds["exact"]), math.log1p(kinds["fuzzy"]), math.log1p(kinds["stem"]), math.log1p(sum(sorted(weights)[-8:])),
        math.log1p(company), quoted / len(found), min(1.0, 20 * len(found) / len(tokens)), math.log1p(len({entry for _, _, entry in found})),
    ]


def _inside_quotes(low: str) -> set[int]:
    """Numbers of the words between quotation marks that close within 60 words."""
    if not any(q in low for q in '"“„«‘'):
        return set()
    out: set[int] = set()
    k, opened = 0, -1
    for m in MARK.findall(low):
        if m in '"“”„«»‘’' and not m.isalnum():
            if opened >= 0 and k - opened <= 60:
                out.update(range(opened, k))
                opened = -1
            else:
                opened = k
        else:
            k += 1
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, features(self.lexicon, text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on all but the bias."""
    a = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], penalty), 1e-3]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def choose(counts: pd.DataFrame, positive: int, negative: int, terms: int = TERMS) -> Lexicon:
    """The lexicon from term, pos, neg (texts with the term, by label; beginnings end in '*'): terms whose share of
    toxic texts is far above the base rate, best first; a beginning gives way to words that tell as much."""
    c = counts[counts.pos >= LEAST].copy()
    base = positive / max(1, positive + negative)
    n = c.pos + c.neg
    # lower end of the share's interval
    share = c.pos / n
    c["low"] = (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)
    c["weight"] = np.log((c.pos + 0.5) / (positive + 1)) - np.log((c.neg + 0.5) / (negative + 1))
    c = c[c.low > max(0.5, 2 * base)].sort_values(["pos", "term"], ascending=[False, True])
    words, stems = {}, {}
    for t, w, pos in zip(c.term, c.weight, c.pos, strict=True):
        if len(words) + len(stems) >= terms:
            break
        if t.endswith("*"):
            # a beginning is worth an entry if no shorter one or single word has its texts
            if not any(t[:-1].startswith(s) for s in stems) and not any(x.startswith(t[:-1]) and 10 * p >= 9 * pos for x, (_, p) in words.items()):
                stems[t[:-1]] = float(w)
        elif not any(t.startswith(s) for s in stems):
            words[t] = (float(w), pos)
    return Lexicon({t: w for t, (w, _) in words.items()}, stems)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits lexicon and model on at most `rows` labelled documents whose crc32(doc_id) mod 5 is not 0. Without both
    labels, every text scores the base rate. Only counts of terms and the features of these rows reach the driver."""
    small_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    texts = texts.persist()
    try:

        def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            claim("toxicity")
            count: tuple[Counter, Counter] = Counter(), Counter()
            for pdf in batches:
                for text, toxic in zip(pdf.text, pdf.toxic, strict=True):
                    ws = set(WORD.findall((text or "").lower()))
                    count[toxic].update(w for w in ws if len(w) <= 40)
                    count[toxic].update({w[:n] + "*" for w in ws for n in STEMS if len(w) >= n})
                    count[toxic]["\0"] += 1
            keys = [*count[0].keys() | count[1].keys()]
            for at in range(0, len(keys), 50_000):  # nothing at all for an empty part
                some = keys[at : at + 50_000]
                yield pd.DataFrame({"term": some, "pos": [count[1][k] for k in some], "neg": [count[0][k] for k in some]})

        counted = texts.mapInPandas(terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        counts = counted.where((F.col("term") == "\0") | ((F.col("pos") >= LEAST) & (F.col("pos") > F.col("neg") / 2))).toPandas()
        every = counts[counts.term == "\0"]
        positive, negative = int(every.pos.sum()), int(every.neg.sum())
        lexicon = choose(counts[counts.term != "\0"], positive, negative)
        if not positive or not negative:
            p = (positive + 0.5) / (positive + negative + 1) if positive + negative else 0.05
            return Model(lexicon, [0.0] * len(FEATURES), math.log(p / (1 - p)))

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            claim("toxicity")
            own = _using((tuple(lexicon_terms.items()), tuple(lexicon_stems.items()), (), 0.0)).lexicon
            for pdf in batches:
                yield pd.DataFrame([features(own, t) for t in pdf.text], columns=list(FEATURES)).assign(toxic=pdf.toxic)

        lexicon_terms, lexicon_stems = lexicon.terms, lexicon.stems
        x = texts.mapInPandas(measured, ", ".join(f"{c} double" for c in FEATURES) + ", toxic int").toPandas()
    finally:
        texts.unpersist()
    w, b = fit_logistic(x[list(FEATURES)].to_numpy(float), x.toxic.to_numpy(float))
    return Model(lexicon, w.tolist(), b)


#: The model in use, by what it was made from.
_models: dict[tuple, Model] = Cache("toxicity")


def _using(made: tuple) -> Model:
    if made not in _models:
        _models.clear()
        _models[made] = Model(Lexicon(dict(made[0]), dict(made[1])), list(made[2]), made[3])
    return _models[made]


def score_column(text, model: Model):
    """Score of a text column, 0 to 1; null counts as the empty text."""
    made = (tuple(model.lexicon.terms.items()), tuple(model.lexicon.stems.items()), tuple(model.weights), model.bias)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        own = _using(made)
        for texts in batches:
            yield pd.Series([own.score(x) for x in texts], dtype=float)

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. A null doc_id counts as held out. Null and empty texts
    score what a text without hits scores. Rows that repeat a doc_id are scored one by one, each by its text; a doc_id
    that is labelled several times is toxic if one label says so. Ties at a score of 0.5 are predicted 1. Columns of
    docs other than doc_id and text are not read, nor those of labels other than doc_id and toxic. Without labels, or
    with those of one kind only, all texts get the same score; an empty table gives no rows."""
    model = train(docs, labels)
    found = docs.select("doc_id", score_column(docs["text"], model).alias("score"))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
