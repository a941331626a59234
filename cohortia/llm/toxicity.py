"""Toxicity scores by weak supervision.

Voters are mined from labelled rows: word starts and whole words whose presence speaks for the label
(a lexicon), and patterns over the whole text.  A voter says toxic, clean or nothing.  A generative
model takes the true label as hidden: expectation maximisation estimates the class balance and each
voter's accuracy, and voters that agree beyond what the label explains share their weight.  A linear
classifier is trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, whole_text

WORDS = re.compile(r"[^\W\d_]+")
START_LENGTHS = range(4, 9)
# A lexicon voter speaks once its words are this share of the text.
VOTER_RATE = 1 / 1000
MOST_KNOWN = 100_000
# A lexicon entry stays if it speaks on so many toxic rows, however many there are, and is right so often.
LEAST_COUNT, LEAST_ACCURACY = 3, 0.9


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def word_marks(word: str) -> list[str]:
    """What a word can be recognised by: its starts, and the whole of it."""
    return [word[:n] for n in START_LENGTHS if n <= len(word)] + [word + "$"]


class Marker(dict):
    """The voter of a word (-1 if none), kept for frequent words; entries from ``single`` on share the voter ``single``."""

    def __init__(self, lexicon: list[str], single: int | None = None):
        super().__init__()
        self.entries = {entry: n if single is None else min(n, single) for n, entry in enumerate(lexicon)}

    def __missing__(self, word: str) -> int:
        found = next((self.entries[m] for m in word_marks(word) if m in self.entries), -1)
        if len(self) < MOST_KNOWN:
            self[word] = found
        return found


def hits(text: str, marker: Marker, size: int) -> tuple[np.ndarray, int, float]:
    """Hits of each lexicon entry, words, and exclamation marks per word."""
    words = WORDS.findall(text.lower())
    counts = Counter(map(marker.__getitem__, words))
    counts.pop(-1, None)
    out = np.zeros(size, np.int64)
    for entry, n in counts.items():
        out[entry] = n
    return out, len(words), text.count("!") / max(1, len(words))


def features(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per entry and in total, the logarithm of the hits per hundred words; a constant last."""
    rate = 100 * counts / (words[:, None] + 10)
    total = rate.sum(axis=1, keepdims=True)
    return np.hstack((np.log1p(rate), np.log(total + 0.02), np.ones((len(words), 1))))


def votes(counts: np.ndarray, words: np.ndarray, shouts: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing; the lexicon voters, then the pattern voters."""
    share = counts / np.maximum(words, 1)[:, None]
    lexicon = (share >= VOTER_RATE).astype(np.int8)
    total = share.sum(axis=1)
    several = (counts > 0).sum(axis=1)
    patterns = np.column_stack(
        (
            np.where(total >= 0.004, 1, np.where(total < 0.002, -1, 0)),
            np.where(several >= 2, 1, np.where(several == 0, -1, 0)),
            np.where(shouts >= 0.05, 1, 0),
        )
    )
    return np.hstack((lexicon, patterns.astype(np.int8)))


def label_model(given: np.ndarray, anchor: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden label for each row of votes, and what was estimated.

    ``anchor``, the label a row was given, starts the estimation and is one more voter, whose errors are
    estimated like the others'.  For each class a voter has a probability of each vote; the posterior
    weighs a voter's log odds by 1 / (1 + its positive correlations with others within the classes), so
    that copies of one signal count about once.
    """
    kinds = (-1, 0, 1)
    given = np.column_stack((given, np.where(anchor, 1, -1))).astype(np.int8)
    seen = np.stack([given == v for v in kinds])
    posterior = np.clip(anchor.astype(float), 0.02, 0.98)
    weight = np.ones(given.shape[1])
    for _ in range(rounds):
        balance = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        chance = []
        for p in (1 - posterior, posterior):
            n = np.einsum("vrj,r->vj", seen, p)
            chance.append((n + 0.5) / (p.sum() + 1.5))
        odds = np.log(chance[1] / chance[0])
        # Correlation of the votes around the means of the likelier class: what the label leaves unexplained.
        likely = posterior >= 0.5
        rest = given.astype(float)
        for side in (likely, ~likely):
            if side.any():
                rest[side] -= rest[side].mean(axis=0)
        spread = np.maximum(np.sqrt((rest**2).mean(axis=0)), 0.02)
        correlation = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.clip(correlation, 0, 1).sum(axis=1))
        each = np.einsum("vrj,vj->rj", seen, odds)
        logit = np.log(balance / (1 - balance)) + each @ weight
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max() < 1e-4:
            posterior = new
            break
        posterior = new
    right = (chance[1][2] * balance + chance[0][0] * (1 - balance)) / np.maximum(
        (chance[1][2] + chance[1][0]) * balance + (chance[0][2] + chance[0][0]) * (1 - balance), 1e-9
    )
    return posterior, {"balance": balance, "accuracy": right, "correlation": correlation, "weight": weight, "chance": np.array(chance)}


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels by damped Newton steps; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - target @ z + 0.5 * (ridge * w * w).sum()

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        new = loss(w)
        if now - new < 1e-6 * max(1.0, abs(now)):
            break
        now = new
    return w


@dataclass
class ToxicModel:
    lexicon: list[str]
    weights: np.ndarray
    estimates: dict
    single: int = 0

    @property
    def voters(self) -> int:
        return min(len(self.lexicon), self.single + 1)

    def scores(self, texts: list[str], marker: Marker) -> np.ndarray:
        size = self.voters
        read = [hits(t, marker, size) for t in texts]
        counts = np.array([r[0] for r in read]).reshape(len(read), size)
        words = np.array([r[1] for r in read], np.int64)
        z = features(counts, words) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def surprise(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """How far presence and label depart from independence (log-likelihood ratio)."""
    a, b, c, d = toxic, clean, all_toxic - toxic, all_clean - clean
    n = all_toxic + all_clean

    def term(observed, row, column):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) * n / np.maximum(row * column, 1e-12)), 0)

    return 2 * (term(a, a + b, all_toxic) + term(b, a + b, all_clean) + term(c, c + d, all_toxic) + term(d, c + d, all_clean))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 30_000, most_voters: int = 64, least: float = 25.0) -> ToxicModel:
    """Learn voters, label model and classifier from at most ``fit_rows`` labelled rows.

    The rows are those with a label whose id is not held out, the first by a hash of the id.  A repeated
    id counts as toxic if any of its labels says so.  A lexicon entry needs a log-likelihood ratio of
    ``least``; all that pass are taken.  Labels without an id or value are left out, and so are ids without a
    document; a missing text counts as empty.  The ``most_voters`` strongest are voters of their own, the
    others speak together as one more.  Without labelled rows of both kinds the model
    gives every text the share of toxic ones (0 without labels).
    """
    known = labels.where(col("toxic").isNotNull() & col("doc_id").isNotNull() & ~held_out(col("doc_id")))
    known = known.groupBy(col("doc_id").alias("doc_id")).agg(F.max(col("toxic").cast("int")).alias("toxic"))
    # At most fit_rows narrow rows, so this side may be broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(col("doc_id").alias("doc_id"), whole_text("text").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def mark(batches):
        for b in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                marks = {m for w in set(WORDS.findall(text.lower())) for m in word_marks(w)}
                for m in marks:
                    counts.setdefault(m, [0, 0])[toxic != 0] += 1
                if len(counts) > 100_000:
                    yield tally(counts)
                    counts = {}
            yield tally(counts)

    def tally(counts):
        keys = list(counts)
        both = np.array([counts[k] for k in keys], np.int64).reshape(len(keys), 2)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["mark", "clean", "toxic"])

    totals = sample.agg(F.sum((F.col("toxic") != 0).cast("long")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = totals["t"] or 0, totals["n"] - (totals["t"] or 0)
    if not n_toxic or not n_clean:
        share = 0.0 if not n_toxic else 1.0
        return ToxicModel([], np.array([0.0, 30.0 if share else -30.0]), {"balance": share})
    marks = sample.mapInArrow(mark, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Far more frequent among toxic rows, by counts that a chance run hardly reaches.
    lift = F.col("toxic") * F.lit(n_clean) > 3 * F.col("clean") * F.lit(n_toxic)
    strong = marks.where((F.col("toxic") >= 3) & lift).select("mark", "clean", "toxic")
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    t, f = F.lit(float(n_toxic)), F.lit(float(n_clean))

    def term(observed, row, column):
        return F.when(observed > 0, observed * F.log(observed * (t + f) / (row * column))).otherwise(0.0)

    ratio = 2 * (term(a, a + b, t) + term(b, a + b, f) + term(t - a, t + f - a - b, t) + term(f - b, t + f - a - b, f))
    top = strong.where(ratio >= least - 1e-6).collect()
    value = surprise(np.array([r["toxic"] for r in top], float), np.array([r["clean"] for r in top], float), float(n_toxic), float(n_clean))
    lexicon: list[str] = []
    taken, starts = set(), set()
    # Of marks that say the same the longest counts; one that starts another taken says nothing new.
    for i in sorted(range(len(top)), key=lambda i: (-round(value[i], 6), -len(top[i]["mark"]), top[i]["mark"])):
        mark_text = top[i]["mark"].rstrip("$")
        if value[i] < least:
            break
        if mark_text not in starts and not any(mark_text[:n] in taken for n in range(1, len(mark_text) + 1)):
            lexicon.append(top[i]["mark"])
            taken.add(mark_text)
            starts.update(mark_text[:n] for n in range(1, len(mark_text) + 1))
    size = len(lexicon)

    def count(batches):
        marker = Marker(lexicon)
        for batch_ in batches:
            read = [hits(t, marker, size) for t in batch_.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.column_stack((np.flatnonzero(r[0]), r[0][r[0] > 0])).ravel().tolist() for r in read], pa.list_(pa.int64()))]
                + [pa.array([r[1] for r in read], pa.int64())]
                + [pa.array([r[2] for r in read], pa.float64()), batch_.column(1)],
                names=["counts", "words", "shouts", "toxic"],
            )

    rows = sample.mapInArrow(count, "counts array<long>, words long, shouts double, toxic int").toPandas()
    # Sums of floating numbers depend on the order of rows: one order for every run.
    rows["key"] = rows["counts"].map(tuple)
    rows = rows.sort_values(["words", "shouts", "toxic", "key"], kind="stable")
    words = rows["words"].to_numpy(np.int64)
    shouts, given = rows["shouts"].to_numpy(), rows["toxic"].to_numpy() != 0
    # What stands in each row: pairs of entry and hits.
    pairs = np.array([x for k in rows["key"] for x in k], np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(rows)), [len(k) // 2 for k in rows["key"]])

    def table_of(place):
        """Hits of each voter; ``place`` gives every entry's rank among those that stay, or -1."""
        out = np.zeros((len(rows), min(int(place.max(initial=-1)) + 1, most_voters + 1)), np.int64)
        use = place[pairs[:, 0]] >= 0
        np.add.at(out, (row[use], np.minimum(place[pairs[use, 0]], most_voters)), pairs[use, 1])
        return out

    # Entries that the label model finds on too few toxic rows, or often wrong, leave; the rest are estimated anew.
    posterior, _ = label_model(votes(table_of(np.arange(size)), words, shouts), given)
    speaks = pairs[:, 1] >= VOTER_RATE * np.maximum(words, 1)[row]
    times = np.bincount(pairs[speaks, 0], minlength=size)
    toxic = np.bincount(pairs[speaks, 0], posterior[row[speaks]], minlength=size)
    good = np.flatnonzero((toxic >= LEAST_COUNT) & (toxic >= LEAST_ACCURACY * times))
    place = np.full(size, -1)
    place[good] = np.arange(len(good))
    counts, lexicon = table_of(place), [lexicon[i] for i in good]
    posterior, estimates = label_model(votes(counts, words, shouts), given)
    return ToxicModel(lexicon, fit_linear(features(counts, words), posterior), estimates, most_voters)


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the score of each text, empty and missing ones included.

    A column of that name in ``docs`` is replaced; other columns stay.  Repeated rows get the same score each, a
    row's id may be missing, and an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != column]
    given = docs.select(*[col(c).alias(c) for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*given.schema.fields, T.StructField(column, T.DoubleType())])
    lexicon, weights, single = model.lexicon, model.weights, model.single

    def score(batches):
        marker, here = Marker(lexicon, single), ToxicModel(lexicon, weights, {}, single)
        for b in batches:
            found = here.scores([t or "" for t in b.column(at).to_pylist()], marker)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, column])

    return given.mapInArrow(score, schema)
