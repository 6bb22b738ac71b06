"""Toxicity by a weighted finite-state grammar over clauses.

A document is read clause by clause. Five small transducers run side by side over the words of a
clause: insult, threat, target, negation and reported speech. Their composition, built state by
state as it is needed, writes an event for every insult and every completed threat, which says
whether it was negated, reported or aimed at somebody. An event's value is the weight of its arc
times a factor for each mark, as weights multiply along a path: aimed insults count more than bare
ones, negated and reported ones little. A logistic model over the sum of the values, and over how
many clauses hold them, gives the score. Its weights are not negative, so that a higher value never
lowers the score. Words that write no event score nothing.

A short list of insults is the prior; further arcs are learned: from labelled training rows Spark
counts the documents of either class for every word and word beginning, and a covering rule picks
few that together explain the toxic ones. The arcs' weights are the logs of how much they raise the
odds; a threat weighs as the heaviest insult does.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch, byte_slices, field, frame
from replyloom.session import ship_package

#: At most so many labelled rows are learned from, chosen by a hash of their id.
MAX_LABELLED = 20_000
#: So many of the best candidate arcs reach the driver at a time; it asks again when they are used up.
ARCS_AT_A_TIME = 2_000
#: An arc has to occur in so many toxic documents, and be this precise at the lower bound.
MIN_TOXIC, MIN_PRECISION = 4, 0.3
#: Log-odds of an insult of the word list before anything is learned.
PRIOR_ODDS = 3.0
LEAST_WEIGHT = 0.1
#: A toxic document counts for choosing arcs until so many arcs hold for it.
COVER = 4
#: Factor of an event for each of its marks: aimed, negated, reported.
MARKS = {"g": 1.5, "n": 0.1, "r": 0.1}
#: Weights of the features and the bias before anything is learned.
PRIOR_WEIGHTS, PRIOR_BIAS = (1.0, 1.0, 1.0), -4.0
#: Value from which a clause counts whole.
WHOLE_CLAUSE = 2.0
PREFIXES = (4, 5, 6, 7, 8)
WORD_MEMORY = 500_000
FLUSH_COUNTS = 200_000

#: Word lists of the grammar, in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown "
    "clowns jerk dumb imbecile".split())
NEGATIONS = frozenset(
    "not no never neither nor nobody nothing isn't aren't wasn't don't doesn't nicht kein keine "
    "nie pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset(
    "said says say called calls wrote writes quoted claims claimed reported alleged sagte sagt "
    "schrieb dit disait écrit dijo dice escribió".split())
TARGETS = frozenset(
    "you your you're yourself he she they him her them his their u du dich dein ihr euch sie tu "
    "toi vous votre ils elles tú usted ustedes vosotros él ellos".split())
THREATS = frozenset(
    "kill hurt destroy beat shoot burn stab punch crush hunt attack töten schlagen vernichten "
    "tuer frapper détruire brûler matar golpear destruir quemar".split())
_TRIM = ".,!?;:\"'()[]{}<>«»“”„‘’…*_-"
_CLAUSE_ENDS = (".", "!", "?", ";", ":", "…")

Transducer = Callable[[int, str], tuple[int, str]]

# Symbols: I insult, T threat, G target, N negation, R report, o other.
_SCOPE = 3  # words that a negation reaches


def _negation(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "N":
        return _SCOPE, ""
    return max(0, state - 1), "n" if state else ""


def _report(state: int, symbol: str) -> tuple[int, str]:
    return (1, "") if symbol == "R" else (state, "r" if state else "")


def _target(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "G":
        return 5, ""
    return max(0, state - 1), "g" if state else ""


def _threat(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "T":
        return 5, ""
    if symbol == "G" and state:
        return 0, "T"
    return max(0, state - 1), ""


def _insult(state: int, symbol: str) -> tuple[int, str]:
    return 0, "I" if symbol == "I" else ""


class Composition:
    """The five transducers as one, its transitions remembered as they are met."""

    machines: tuple[Transducer, ...] = (_insult, _threat, _target, _negation, _report)
    start = (0,) * 5

    def __init__(self) -> None:
        self._table: dict[tuple, tuple[tuple, str]] = {}

    def step(self, states: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
        """Next states, and the event written: I or T with marks n, r, g, or nothing."""
        key = states, symbol
        if key not in self._table:
            moves = [m(s, symbol) for m, s in zip(self.machines, states)]
            head = moves[0][1] or moves[1][1]
            marks = "".join(w for _, w in moves[2:]) if head else ""
            self._table[key] = tuple(s for s, _ in moves), head + marks
        return self._table[key]


@dataclass
class Grammar:
    """Arcs with their weights, and the logistic weights of the event sums."""

    words: dict[str, float] = dataclass_field(
        default_factory=lambda: dict.fromkeys(INSULTS, PRIOR_ODDS))
    prefixes: dict[str, float] = dataclass_field(default_factory=dict)
    threat: float = PRIOR_ODDS
    bias: float = PRIOR_BIAS
    weights: tuple[float, ...] = PRIOR_WEIGHTS

    def symbol(self, word: str) -> tuple[str, float]:
        weight = max([self.words.get(word, 0.0),
                      *(self.prefixes.get(word[:k], 0.0) for k in PREFIXES)])
        if weight:
            return "I", weight
        if word in THREATS:
            return "T", self.threat
        return ("G" if word in TARGETS else "N" if word in NEGATIONS else
                "R" if word in REPORTS else "o"), 0.0


def _words(text: str) -> list[str]:
    """Raw words, cut at every white space of Unicode, such as no-break spaces."""
    return text.split()


def _plain(word: str) -> str:
    return word.lower().strip(_TRIM)


class _Arcs(dict):
    """Weight of the insult or threat that a raw word starts or completes; 0 for most."""

    def __init__(self, grammar: Grammar) -> None:
        super().__init__()
        self.grammar = grammar

    def __missing__(self, word: str) -> float:
        if len(self) > WORD_MEMORY:
            self.clear()
        value = self[word] = self.grammar.symbol(_plain(word))[1]
        return value


def clauses(text: str) -> Iterator[list[str]]:
    """Words of each clause; clauses end at line ends and at words that end in a mark."""
    for line in text.split("\n"):
        clause: list[str] = []
        for word in _words(line):
            clause.append(_plain(word))
            if word.endswith(_CLAUSE_ENDS):
                yield clause
                clause = []
        if clause:
            yield clause


def event_value(event: str, weight: float) -> float:
    """Value of an event such as ``In``: its arc's weight and the factors of its marks."""
    for mark in event[1:]:
        # A threat is complete only with its target, so that adds nothing.
        weight *= 1.0 if (event[0], mark) == ("T", "g") else MARKS[mark]
    return weight


def clause_value(clause: list[str], grammar: Grammar, machine: Composition) -> float:
    """Sum of the values of the events that the composed transducers write for one clause."""
    states, total = machine.start, 0.0
    for word in clause:
        symbol, weight = grammar.symbol(word)
        states, event = machine.step(states, symbol)
        if event:
            # The word that completes a threat need not be the one that began it.
            total += event_value(event, grammar.threat if event[0] == "T" else weight)
    return total


def features(text: bytes, grammar: Grammar, arcs: dict[str, float],
             machine: Composition) -> list[float]:
    """Logs of the sum of the events' values, of the number of clauses that have them, and of the
    value in a hundred words."""
    whole = text.decode("utf-8", "replace")
    words = _words(whole)
    # Texts without a word that can write an event are not read by clauses.
    if max(map(arcs.__getitem__, words), default=0.0) <= 0:
        return [0.0] * len(PRIOR_WEIGHTS)
    values = [clause_value(clause, grammar, machine) for clause in clauses(whole)]
    total = sum(values)
    return [math.log1p(total), math.log1p(sum(min(1.0, v / WHOLE_CLAUSE) for v in values)),
            math.log1p(100 * total / max(100, len(words)))]


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
              most: int) -> DataFrame:
    """Distinct texts of the chosen labels, each with its largest label and a number ``row``."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .filter(~held_out(F.col(id_col)))
              .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64(id_col), id_col).limit(most))
    # At most MAX_LABELLED pairs of numbers.
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(chosen), id_col)
    return rows.groupBy("text").agg(F.max("label").alias("label")).select(
        "label", "text", F.monotonically_increasing_id().alias("row"))


def _tokens_of(text: bytes) -> set[str]:
    words = {_plain(w) for w in set(_words(text.decode("utf-8", "replace")))}
    words.discard("")
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in PREFIXES if len(w) >= k}


_COUNTED = "token string, rows array<long>, clean long"


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic rows and number of clean rows of every token."""
    toxic: defaultdict[str, list[int]] = defaultdict(list)
    clean: Counter[str] = Counter()
    held = 0

    def flushed() -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        batch = pa.RecordBatch.from_pydict({
            "token": pa.array(names, pa.string()),
            "rows": pa.array([toxic.get(n, []) for n in names], pa.list_(pa.int64())),
            "clean": pa.array([clean[n] for n in names], pa.int64())})
        toxic.clear()
        clean.clear()
        return batch

    for part, texts in byte_slices(batches):
        labels = part.column(part.schema.get_field_index("label")).to_pylist()
        numbers = part.column(part.schema.get_field_index("row")).to_pylist()
        for text, label, number in zip(texts, labels, numbers):
            tokens = _tokens_of(text)
            if label:
                for token in tokens:
                    toxic[token].append(number)
                held += len(tokens)
            else:
                clean.update(tokens)
            if held + len(clean) > FLUSH_COUNTS:
                yield flushed()
                held = 0
    yield flushed()


def _lower_bound(hits: Column, n: Column) -> Column:
    """Lower end of Wilson's 95 % interval of a share; ``n`` is not 0."""
    p, z = hits / n, 1.96
    middle = p + z * z / (2 * n)
    return (middle - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _candidates(training: DataFrame) -> DataFrame:
    """Tokens that are frequent and precise enough: ``token``, ``precise``, ``odds``, toxic ``rows``."""
    toxic = F.size("rows")
    return (training.mapInArrow(_counted, _COUNTED)
            # A list has one number for a toxic training text that holds the token.
            .groupBy("token").agg(F.flatten(F.collect_list("rows")).alias("rows"),
                                  F.sum("clean").alias("clean"))
            .filter(toxic >= MIN_TOXIC)
            .withColumn("precise", _lower_bound(toxic, toxic + F.col("clean")))
            .filter(F.col("precise") >= MIN_PRECISION)
            .select("token", "precise", F.log((toxic + 0.5) / (F.col("clean") + 0.5)).alias("odds"),
                    "rows"))


def _related(one: str, other: str) -> bool:
    return one[1:].startswith(other[1:]) or other[1:].startswith(one[1:])


def _choose(candidates: DataFrame, toxic_rows: list[int],
            at_a_time: int = ARCS_AT_A_TIME) -> dict[str, float]:
    """Few tokens, with their odds, that cover the toxic rows, each up to COVER times.

    Words that only accompany a much copied document add nothing once that document's insults are
    chosen. Of equal gains the longer token wins, then the order of the alphabet.

    Spark ranks all candidates by their present gain and the driver gets the best ``at_a_time``.
    Gains only fall, so these are the right ones to choose from as long as the best of them is not
    below the last one as it was ranked; then Spark ranks all anew.
    """
    number = {row: i for i, row in enumerate(toxic_rows)}
    need = np.full(len(toxic_rows), COVER)
    chosen: dict[str, float] = {}
    # Sets of row numbers as bits, MAX_LABELLED of them for a chosen token.
    where: dict[str, int] = {}

    def bits(rows: Iterable[int]) -> int:
        flags = np.zeros(len(toxic_rows), np.uint8)
        flags[list(rows)] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def spent(token: str, rows: list[int]) -> bool:
        """Chosen, or without a row of its own beside a chosen word of the same beginning."""
        same = [w for c, w in where.items() if _related(c, token)]
        return bool(same) and any(not bits(rows) & ~w for w in same)

    def best_left() -> list:
        wanted = need > 0

        def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, gains = [], []
                lists = batch.column(batch.schema.get_field_index("rows"))
                tokens = batch.column(batch.schema.get_field_index("token")).to_pylist()
                for i, token in enumerate(tokens):
                    rows = [number[r] for r in lists[i].as_py()]
                    gain = int(wanted[rows].sum())
                    if gain >= MIN_TOXIC and not spent(token, rows):
                        kept.append(i)
                        gains.append(gain)
                part = batch.take(pa.array(kept, pa.int64()))
                yield frame(part, ["token", "precise", "odds", "rows"],
                            {"gain": pa.array(gains, pa.int64())})

        schema = "token string, precise double, odds double, rows array<long>, gain long"
        return (candidates.mapInArrow(ranked, schema)
                .orderBy(F.desc(F.col("gain") * F.col("precise")), F.desc(F.length("token")),
                         F.desc("token")).limit(at_a_time).collect())

    while found := best_left():
        rows_of = {r["token"]: [number[n] for n in r["rows"]] for r in found}
        precise = {r["token"]: r["precise"] for r in found}
        odds = {r["token"]: r["odds"] for r in found}
        gains = {r["token"]: r["gain"] for r in found}
        holders: dict[int, list[str]] = defaultdict(list)
        for token, rows in rows_of.items():
            for i in rows:
                holders[i].append(token)

        def rank(token: str) -> tuple[float, int, str]:
            return gains[token] * precise[token], len(token), token

        last = rank(found[-1]["token"])
        while gains:
            best = max(gains, key=rank)
            if len(found) == at_a_time and rank(best) < last:
                break
            if gains.pop(best) < MIN_TOXIC:
                continue
            if spent(best, rows_of[best]):
                continue
            chosen[best], where[best] = odds[best], bits(rows_of[best])
            for i in rows_of[best]:
                need[i] -= 1
                if need[i] == 0:
                    for token in holders[i]:
                        if token in gains:
                            gains[token] -= 1
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights, none negative, and, last, the bias; drawn to the prior by a small ridge.

    ``times`` says how often each row counts. Newton steps of one coordinate at a time, which
    converge as the loss is convex and each bound concerns one coordinate.
    """
    x = np.column_stack([x, np.ones(len(x))])
    prior = np.array([*PRIOR_WEIGHTS, PRIOR_BIAS])
    least = np.array([0.0] * len(PRIOR_WEIGHTS) + [-np.inf])
    w = prior.copy()
    for _ in range(500):
        before = w.copy()
        for k in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = (times * (p - y)) @ x[:, k] + ridge * (w[k] - prior[k])
            curve = (times * (p * (1 - p) + 1e-6)) @ x[:, k] ** 2 + ridge
            w[k] = max(least[k], w[k] - np.clip(slope / curve, -2, 2))
        if np.abs(w - before).max() < 1e-6:
            break
    return w


def learn_grammar(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic",
                  max_labelled: int = MAX_LABELLED) -> Grammar:
    """Fit arcs and weights on at most ``max_labelled`` labelled rows that are not held out.

    Null labels and ids are not learned from; of several labels of an id the largest counts, and
    likewise of an equal text, which is learned from once. Without a toxic training row the grammar
    has its prior arcs and weights.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    # Written once: every later step reads the labelled sample only.
    training = scratch.write(_training(docs, labels, id_col, text_col, label_col, max_labelled),
                             "training")
    candidates = scratch.write(_candidates(training), "candidates")
    toxic_rows = [r["row"] for r in training.filter("label <> 0").select("row").collect()]
    n_clean = training.filter("label = 0").count()
    # Evidence for toxicity: by how much an arc raises the odds above those of any text.
    usual = math.log((len(toxic_rows) + 1) / (n_clean + 1))
    grammar = Grammar()
    for token, odds in _choose(candidates, toxic_rows).items():
        (grammar.words if token[0] == "=" else grammar.prefixes)[token[1:]] = max(
            LEAST_WEIGHT, odds - usual)
    grammar.threat = max(*grammar.words.values(), *grammar.prefixes.values())

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs, machine = _Arcs(grammar), Composition()
        for part, texts in byte_slices(batches):
            rows = [features(t, grammar, arcs, machine) for t in texts]
            yield frame(part, ["label"], {"x": pa.array(rows, pa.list_(pa.float64()))})

    fitted = training.select("label", "text").mapInArrow(measured, "label int, x array<double>")
    rows = fitted.groupBy("label", "x").count().orderBy("label", "x").collect()
    if len({r["label"] for r in rows}) == 2:
        # Equal feature rows come with their number, so the sample stays small.
        w = _logistic(np.array([r["x"] for r in rows]),
                      np.array([float(r["label"] != 0) for r in rows]),
                      np.array([r["count"] for r in rows], float))
        grammar.weights, grammar.bias = tuple(w[:-1].tolist()), float(w[-1])
    scratch.drop()
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id",
                    text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` between 0 and 1, and ``predicted``.

    Whole texts, one narrow pass. Null and empty texts get the score of a text without events.
    Repeated rows come back repeated; a null id is not held out.
    """
    ship_package(docs.sparkSession)
    weights, bias = np.array(grammar.weights), grammar.bias

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs, machine = _Arcs(grammar), Composition()
        for part, texts in byte_slices(batches):
            x = np.array([features(t, grammar, arcs, machine) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            yield frame(part, [id_col], {"score": pa.array(p, pa.float64())})

    rows = docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(
        scored, f"{field(docs, id_col)}, score double")
    return rows.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
