"""Toxicity by a weighted finite-state pattern grammar (operator 5).

A word goes through transducers to a symbol: of insults, a trie of word
beginnings whose weights are learned from labels, and of closed lists for
threats, targets, negation and reported speech. A clause of symbols goes
through the grammar: small machines, composed, read it from the left (how long
a negation or an intent reaches, whether someone was addressed, whether speech
was reported) and from the right (whether either follows). At a match the
states on both sides choose the arc, and the arc's weight, learned too, is
what the match counts. Clauses without a match have no part in a score, and a
word has none but by the arcs it is matched on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import share_package, table
from chronomotif.llm.learning import FOLDS, held_out, logistic, training_texts

# Closed word classes in English, French, German and Spanish.
TARGETS = "you your yours yourself u he him she her they them these those people everyone tu toi vous ton votre il elle ils elles lui leur du dich dir sie ihr euch er ihm usted ustedes te ti él ella ellos ellas".split()
NEGATIONS = "not no never nor isn't aren't wasn't don't doesn't didn't won't ne pas jamais aucun nicht kein keine nie niemals nunca jamás ningún".split()
REPORTS = "said says say told tells called calls quoted quote wrote writes reported claimed dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split()
INTENTS = "will gonna going shall should must would want wanna i'll we'll vais va allons werde werden wird voy vamos va".split()
VIOLENCE = "kill killed murder hurt destroy beat stab shoot burn hang strangle punch tuer frapper détruire töten umbringen schlagen matar golpear destruir".split()

#: Letters of a word's beginning that the trie holds, and the mark of a word's end.
LEAST_LETTERS, MOST_LETTERS, END = 3, 16, "$"
#: Words of a text with one beginning that count for it.
MOST_WORDS = 3
#: Standard errors that a beginning's log odds are lowered by: what few texts show counts for little.
ERRORS = 1.0
#: Least weights of a beginning, of which cross-validation inside the training folds chooses one.
LEAST_ODDS = (2.0, 2.5, 3.0, 3.5, 4.0)
NEGATION_REACH, INTENT_REACH = 3, 3
#: Words that a worker keeps what it knows of, and counts that it keeps before it hands them on.
WORDS_KEPT, COUNTS_KEPT = 10_000, 100_000
CLAUSE_END = re.compile(r"[.!?;:](?=[ \n]|$)|\n")
#: The same ends, but for the text's, as plain text.
ENDS = (". ", "! ", "? ", "; ", ": ", "\n")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
#: A letter that is held: read as one.
HELD = re.compile(r"([^\W\d_])\1{2,}")
#: What a match can be, by its context; the arcs of the grammar.
ARCS = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_targeted", "threat_reported")
FEATURES = (*ARCS, "worst_clause", "matched_clauses", "matched_share")


class Machine:
    """A deterministic machine over symbols: ``step(state, symbol)`` gives the next state; 0 is the first."""

    def __init__(self, states: int, step: Callable[[int, str], int]):
        self.states, self.step = states, step


SYMBOLS = "NRTWIVO"  # negation, report, target, intent, insult, violence, other
NEGATION = Machine(NEGATION_REACH + 1, lambda s, x: NEGATION_REACH if x == "N" else max(0, s - 1))
INTENT = Machine(INTENT_REACH + 1, lambda s, x: INTENT_REACH if x == "W" else max(0, s - 1))
REPORT = Machine(2, lambda s, x: 1 if x == "R" else s)
TARGET = Machine(2, lambda s, x: 1 if x == "T" else s)


def compose(machines: tuple[Machine, ...]) -> tuple[list[dict[str, int]], list[tuple[int, ...]]]:
    """The machines run side by side as one: its table (from a state and a symbol to the next state), and what each state is of every machine."""
    every = list(product(*(range(m.states) for m in machines)))
    number = {s: k for k, s in enumerate(every)}
    table_ = [{x: number[tuple(m.step(a, x) for m, a in zip(machines, s, strict=True))] for x in SYMBOLS} for s in every]
    return table_, every


def arc(symbol: str, before: tuple[int, ...], after: tuple[int, ...]) -> str | None:
    """The arc of a match between the states of (negation, intent, report, target) on its left and of (report, target) on its right."""
    negated, intent, reported, aimed = before
    if symbol == "I":
        return "insult_negated" if negated else "insult_reported" if reported or after[0] else "insult_targeted" if aimed or after[1] else "insult"
    if symbol == "V" and intent and not negated:
        return "threat_reported" if reported or after[0] else "threat_targeted" if after[1] else "threat"
    return None


class Grammar:
    """The composition, as tables: both sides' machines, and the arc for each symbol between two states."""

    def __init__(self):
        self.left, lefts = compose((NEGATION, INTENT, REPORT, TARGET))
        self.right, rights = compose((REPORT, TARGET))
        self.arcs = {(x, p, q): arc(x, a, b) for x in "IV" for p, a in enumerate(lefts) for q, b in enumerate(rights)}

    def matches(self, symbols: list[str]) -> list[tuple[int, str]]:
        """Places and arcs of a clause's matches."""
        after, state = [0] * len(symbols), 0
        for k in range(len(symbols) - 1, -1, -1):
            after[k] = state
            state = self.right[state][symbols[k]]
        out, state = [], 0
        for k, x in enumerate(symbols):
            if x in "IV" and (found := self.arcs[x, state, after[k]]):
                out.append((k, found))
            state = self.left[state][x]
        return out


CLASSES = {w: c for c, words in (("V", VIOLENCE), ("W", INTENTS), ("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS)) for w in words}
#: Share of a match that a clause keeps in its context, where the worst clause is looked for.
KEPT = {a: 0.25 if a.endswith(("_negated", "_reported")) else 1.0 for a in ARCS}


def lowered(text: str) -> str:
    """Lower-cased, held letters once."""
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = c[1:] == c[:-1]
    # Few texts hold a letter: the others needn't be searched for it.
    return HELD.sub(r"\1", low) if (same[1:] & same[:-1]).any() else low


class Scorer:
    """Features and scores of texts under a lexicon of weighted word beginnings and the arcs' weights."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None = None):
        import ahocorasick

        self.lexicon, self.weights, self.grammar = lexicon, weights, Grammar()
        self.automaton = ahocorasick.Automaton()
        for w in {*(k.rstrip(END) for k in lexicon), *VIOLENCE}:
            self.automaton.add_word(w, len(w))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's symbol and weight: the most that a state of the trie accepts it with, one for violence, none else."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            lex = self.lexicon
            weight = max((lex.get(word[:k], 0.0) for k in range(LEAST_LETTERS, min(len(word), MOST_LETTERS) + 1)), default=0.0)
            weight = max(weight, lex.get(word + END, 0.0))
            found = ("I", weight) if weight else (CLASSES.get(word, "O"), float(word in VIOLENCE))
            self.known[word] = found
        return found

    def clauses(self, low: str) -> Iterator[str]:
        """The clauses in which a word begins like an insult or an act of violence."""
        upto = -1
        for at, n in self.automaton.iter(low) if len(self.automaton) else ():
            start = at - n + 1
            if start < upto or (start and low[start - 1].isalnum()):
                continue
            end = CLAUSE_END.search(low, at)
            stop = end.start() if end else len(low)
            begin = max(upto, 0)
            for mark in ENDS:
                begin = max(begin, low.rfind(mark, begin, start) + 1)
            upto = stop
            yield low[begin:stop]

    def features(self, low: str) -> list[float]:
        """Of a text as :func:`lowered` gives it."""
        sums = dict.fromkeys(ARCS, 0.0)
        worst, matched = 0.0, 0
        for clause in self.clauses(low):
            read = [self.symbol(w) for w in WORD.findall(clause)]
            found = self.grammar.matches([x for x, _ in read])
            of = 0.0
            for k, name in found:
                sums[name] += read[k][1]
                of += read[k][1] * KEPT[name]
            worst, matched = max(worst, of), matched + bool(found)
        share = matched / (1 + sum(map(low.count, ENDS))) if matched else 0.0
        return [*(float(np.log1p(v)) for v in sums.values()), worst, float(np.log1p(matched)), share]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(lowered(t)) for t in texts]).reshape(-1, len(FEATURES))
        return probabilities(x, self.weights)


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


class Beginnings(dict):
    """A word's beginnings, of some or of all, and the word with an end mark; kept for words that come again."""

    def __init__(self, among: set[str] | None = None):
        self.among = among

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        every = (*(word[:k] for k in range(LEAST_LETTERS, min(len(word), MOST_LETTERS) + 1)), word + END)
        self[word] = found = every if self.among is None else tuple(w for w in every if w in self.among)
        return found

    def counts(self, text: str) -> dict[str, int]:
        """By beginning, how many words of a text have it, a few at most."""
        out: dict[str, int] = {}
        for word in set(WORD.findall(lowered(text))):
            for w in self[word]:
                out[w] = out.get(w, 0) + 1
        return {w: min(n, MOST_WORDS) for w, n in out.items()}


def odds(positive, toxic: float, negative, clean: float) -> np.ndarray:
    """Log odds of beginnings, lowered by their standard error."""
    p, n = np.asarray(positive, float) + 0.5, np.asarray(negative, float) + 0.5
    return np.log(p / (toxic + 1)) - np.log(n / (clean + 1)) - ERRORS * np.sqrt(1 / p + 1 / n)


class Counts:
    """Of the training texts, by fold: texts of each label, and words that begin in each way."""

    def __init__(self, texts: DataFrame):
        sizes = {(r["label"], r["fold"]): r["count"] for r in texts.groupBy("label", "fold").count().collect()}
        self.texts = np.array([[sizes.get((label, f), 0) for f in range(1, FOLDS)] for label in (0, 1)])
        toxic, clean = self.texts[1].sum(), self.texts[0].sum()
        # Beginnings that would be kept if no clean text had them; of those, what clean texts have. The sample bounds both.
        best = min(LEAST_ODDS) + float(np.log(toxic + 1) + np.log(0.5 / (clean + 1)))
        found = counted(texts.filter("label = 1"), None, best) if toxic and clean else {}
        among = list(found)
        against = counted(texts.filter("label = 0"), set(among)) if among else {}
        self.words = among
        none = np.zeros(FOLDS - 1, np.int64)
        self.n = np.array([[against.get(w, none), found[w]] for w in among]).reshape(-1, 2, FOLDS - 1)

    def lexicon(self, least: float, without: int | None = None) -> dict[str, float]:
        """Beginnings with at least so much weight, from all folds but one."""
        use = [f - 1 for f in range(1, FOLDS) if f != without]
        n, texts = self.n[:, :, use].sum(2), self.texts[:, use].sum(1)
        weight = odds(n[:, 1], texts[1], n[:, 0], texts[0])
        kept = {self.words[k]: (float(weight[k]), int(n[k, 1])) for k in np.flatnonzero((weight >= least) & (n[:, 1] > 0))}
        # Of beginnings that the same words have, the longest; what then says no more than a shorter one is the same state of the trie.
        same = {w[:k] for w, (_, m) in kept.items() if w[-1] != END for k in range(LEAST_LETTERS, len(w)) if m >= 0.9 * kept.get(w[:k], (0, np.inf))[1]}
        out = {w: v for w, (v, _) in kept.items() if w not in same}
        return {w: v for w, v in out.items() if not any(out.get(w[:k], 0.0) >= v - 0.7 for k in range(LEAST_LETTERS, len(w)))}


def counted(df: DataFrame, among: set[str] | None, best: float | None = None) -> dict[str, np.ndarray]:
    """Beginnings (of ``among``) to the number of words that have them, by fold; those whose log, less its error, is at least ``best``."""
    sent = df.sparkSession.sparkContext.broadcast(among)

    def flushed(n: Counter[tuple[str, int]]) -> pa.RecordBatch:
        columns = [pa.array([w for w, _ in n], pa.string()), pa.array([f for _, f in n], pa.int32()), pa.array(n.values(), pa.int64())]
        n.clear()
        return pa.RecordBatch.from_arrays(columns, names=["w", "fold", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[str, int]] = Counter()
        known = Beginnings(sent.value)
        for batch in batches:
            for text, f in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w, m in known.counts(text.as_py()).items():
                    n[w, f] += m
                if len(n) >= COUNTS_KEPT:
                    yield flushed(n)
        yield flushed(n)

    rows = df.select("text", "fold").mapInArrow(run, "w string, fold int, n long").groupBy("w").agg(*(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(1, FOLDS)))
    if best is not None:
        total = sum((F.col(f"n{f}") for f in range(1, FOLDS)), F.lit(0.5))
        rows = rows.filter(F.log(total) - ERRORS * F.sqrt(1 / total + 2) >= F.lit(best))
    return {r["w"]: np.array(r[1:], np.int64) for r in rows.collect()}


def _featured(texts: DataFrame, scorers: Callable[[int], list[dict[str, float]]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features of every training text under each of several lexicons, which may depend on its fold; labels and folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, folds = [lowered(t.as_py()) for t in batch.column(0)], np.array(batch.column(2).to_pylist())
            x: list[list[float]] = [[] for _ in low]
            for f in np.unique(folds).tolist():
                mine = np.flatnonzero(folds == f).tolist()
                for lexicon in scorers(f):  # one automaton at a time is held
                    scorer = Scorer(lexicon)
                    for k in mine:
                        x[k].extend(scorer.features(low[k]))
                    del scorer
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "fold"])

    rows = texts.select("text", "label", "fold").mapInArrow(run, "x array<double>, label int, fold int").collect()
    if not rows:
        return [], np.empty(0), np.empty(0)
    x = np.array([r["x"] for r in rows]).reshape(len(rows), -1, len(FEATURES))
    return [x[:, k] for k in range(x.shape[1])], np.array([r["label"] for r in rows], float), np.array([r["fold"] for r in rows])


def chosen_odds(texts: DataFrame, counts: Counts) -> float:
    """The least weight of a beginning with which each training fold is told best by the others: by log loss, the larger of equals."""
    lexicons = {f: [counts.lexicon(t, f) for t in LEAST_ODDS] for f in range(1, FOLDS)}
    sent = texts.sparkSession.sparkContext.broadcast(lexicons)  # bounded by the sample
    xs, y, folds = _featured(texts, lambda f: sent.value[f])
    losses = []
    for x in xs:
        loss = 0.0
        for f in range(1, FOLDS):
            mine = folds == f
            p = np.clip(probabilities(x[mine], logistic(x[~mine], y[~mine])), 1e-6, 1 - 1e-6)
            loss -= (y[mine] * np.log(p) + (1 - y[mine]) * np.log(1 - p)).sum()
        losses.append(round(loss, 6))
    return max(t for t, loss in zip(LEAST_ODDS, losses, strict=True) if loss == min(losses))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the weights of the arcs, from labels outside the held-out fold alone."""
    share_package(docs.sparkSession)
    texts = training_texts(docs, labels, "toxic")
    counts = Counts(texts)
    lexicon = counts.lexicon(chosen_odds(texts, counts)) if counts.words else {}
    xs, y, _ = _featured(texts, lambda f: [lexicon])
    return lexicon, logistic(xs[0] if xs else np.empty((0, len(FEATURES))), y)


def score(df: DataFrame, model: tuple[dict[str, float], np.ndarray], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 for every row; a null text scores as an empty one.

    All columns stay; one that has the name of ``out_col`` is replaced. Equal
    texts score alike, whatever their ids; repeated rows and null ids have a
    row each, an empty table gives an empty result.
    """
    share_package(df.sparkSession)
    kept = [c for c in df.columns if c != out_col]
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    text_at = kept.index(text_col)
    schema = df.select(kept).schema.add(out_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            s = scorer.scores([t.as_py() or "" for t in batch.column(text_at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*kept, out_col])

    return df.select(kept).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
