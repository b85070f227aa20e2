"""Quality and toxicity classifiers trained by two views that teach each other.

The content view sees which of its chosen tokens a text holds and how often; the page view sees language,
source, length and layout figures (line and word lengths, shares of capitals, marks, digits and distinct
words), never the words. For each target (low quality, toxic) both views are logistic regressions. They start
from labelled rows; in each round either view labels, for each class, the documents of which it is most certain
among all that are not in the labelled sample, and these go to the other view. Both are then calibrated on rows kept apart, and a last regression
over the two calibrated logits gives the score of every document.

Only the labelled side is a sample: at most ``labelled`` labelled rows, drawn from those whose document exists and class
by class of (low, toxic), so that a rare class gives all its rows. The other
documents, labelled or not, are all scored in each round, without their labels. Rows of a class count as many as they stand for, and an offset takes the drawn odds of the
two classes back to the true ones, so scores are probabilities among all labelled documents. Figures, categories and token counts of all documents are written once; Spark
computes centre, spread and the commonest categories over them, and each round is one pass over them. Token
statistics of the sample are summed by Spark; the driver receives at most ``tokens`` tokens a target and one sparse
row of features for each sampled and each picked row. Scoring covers every document.

Defined cases: null text is the empty text; null language, source and length have their own value; repeated
label rows of a document count as the lower quality and the higher toxicity; label rows with a null are left
out; where no labelled document or all of them are positive for a target, there is nothing to tell apart: every
document gets the share of positive rows as score (0 without any) and is kept; a class of fewer than four rows
has none to keep apart, and its target is calibrated on the rows that it was fitted on; repeated documents get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import fields, map_batches
from passagework.session import written

LABELLED, TOKENS, ROUNDS, PER_ROUND = 6000, 1024, 3, 200
CERTAIN = 0.98
#: Chi-square gain from which a token may enter a vocabulary; lower gains arise by chance among so many tokens.
SIGNIFICANT = 20.0
TARGETS = ("low", "toxic")
TOKEN = re.compile(r"\w+|[^\w\s]+")
NUMBERS = 9
NEEDED = ("text", "lang", "source", "n_chars")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text) if text else []


def content(found: list[str]) -> Counter:
    return Counter(t.lower() for t in found)


def numbers(text: str | None, found: list[str], n_chars: int | None) -> list[float]:
    """Length and layout figures of a page."""
    text = text or ""
    n, marks = len(found) or 1, [t for t in found if not (t[0].isalnum() or t[0] == "_")]
    lines = text.count("\n") + 1
    return [
        np.log1p(max(n_chars or 0, 0)),
        np.log1p(len(text)),
        np.log1p(lines),
        np.log1p(len(text) / lines),
        len(text) / n,
        sum(map(str.isupper, found)) / n,
        len(marks) / n,
        sum(map(len, marks)) / n,
        len(set(found)) / n,
    ]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: np.ndarray, towards: float = 0.0, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression with an intercept last, by Newton steps; the penalty draws slopes ``towards`` a value."""
    width = x.shape[1] + 1
    w, ridge, middle = np.zeros(width), np.full(width, penalty), np.full(width, towards)
    ridge[-1], middle[-1] = 1e-6, 0.0
    for _ in range(steps):
        grad, bend = ridge * (w - middle), np.diag(ridge)
        for at in range(0, len(x), 1000):  # copies stay small
            part = np.hstack([x[at : at + 1000], np.ones((len(x[at : at + 1000]), 1))])
            p, times = sigmoid(part @ w + offset[at : at + 1000]), weight[at : at + 1000]
            grad += part.T @ (times * (p - y[at : at + 1000]))
            bend += (part * (times * (p * (1 - p) + 1e-6))[:, None]).T @ part
        step = np.linalg.solve(bend, grad)
        size = float(np.abs(step).max())
        w -= step * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-4:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def odds_of(y: np.ndarray, stands_for: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights with mean 1 in each class, how far the log odds of the drawn rows lie above the true ones, and the true share."""
    drawn, true = [np.array([f[y == c].sum() for c in (0, 1)]) for f in (np.ones(len(y)), stands_for)]
    return stands_for * (drawn / true)[y.astype(int)], float(np.log(drawn[1] / drawn[0]) - np.log(true[1] / true[0])), float(true[1] / true.sum())


@dataclass
class Target:
    """One target's vocabulary and weights."""

    vocabulary: dict[str, int]
    share: float = 0.0
    content: np.ndarray | None = None
    page: np.ndarray | None = None
    calibration: list[np.ndarray] = field(default_factory=list)
    final: np.ndarray | None = None

    def calibrated(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        raw = [logits(x, w) for x, w in zip(xs, (self.content, self.page), strict=True)]
        return np.column_stack([logits(np.clip(r, -20, 20)[:, None], c) for r, c in zip(raw, self.calibration, strict=True)])

    def score(self, xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if self.final is None:
            return np.full(len(xs[0]), self.share)
        return sigmoid(logits(self.calibrated(xs), self.final))


@dataclass
class Model:
    categories: dict[str, int]
    centre: np.ndarray
    spread: np.ndarray
    targets: dict[str, Target]

    def accepted(self, scores: list[np.ndarray]) -> np.ndarray:
        """Rows that no target calls positive; a target without a fit has no say."""
        return np.all([s < 0.5 if self.targets[t].final is not None else np.ones(len(s), bool) for t, s in zip(TARGETS, scores, strict=True)], axis=0)

    def page(self, langs: list, sources: list, figures: np.ndarray) -> np.ndarray:
        out = np.zeros((len(langs), NUMBERS + len(self.categories)))
        out[:, :NUMBERS] = np.clip((figures - self.centre) / self.spread, -6, 6)
        for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
            for name in (f"lang {lang}", f"source {source}"):
                if (j := self.categories.get(name)) is not None:
                    out[i, NUMBERS + j] = 1
        return out


def bag(counts: list[Counter], vocabulary: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(counts), len(vocabulary)))
    for i, c in enumerate(counts):
        for t in vocabulary.keys() & c.keys():
            out[i, vocabulary[t]] = np.log1p(c[t])
    return out


class Fitting:
    """Both views of a target while they learn; ``x`` holds (content, page) rows, a row ``stands_for`` so many labelled
    documents. Every fourth row of a class is kept for calibration."""

    def __init__(self, target: Target, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, stands_for: np.ndarray) -> None:
        self.target, self.x, self.y = target, x, y
        self.taken: set[int] = set()
        target.share = float(y @ stands_for / stands_for.sum()) if len(y) else 0.0
        self.able = len(set(y)) == 2
        if not self.able:
            return
        self.held = np.zeros(len(y), dtype=bool)
        for c in (0, 1):
            self.held[np.flatnonzero(y == c)[3::4]] = True
        first = ~self.held
        if len(set(y[self.held])) < 2:
            self.held = first = np.ones(len(y), dtype=bool)
        self.weight, above, target.share = odds_of(y, stands_for)
        self.offset = np.full(len(y), above)
        self.own = [(x[v][first], y[first], self.weight[first], self.offset[first]) for v in (0, 1)]
        self.fit()

    def fit(self) -> None:
        self.target.content, self.target.page = [fit(*own) for own in self.own]

    def learn(self, view: int, x: np.ndarray, said: np.ndarray, rows: Iterable[int]) -> None:
        """Rows that the other view labelled. They were picked by class, so their odds are set against the true share."""
        self.taken.update(rows)
        share, positive = self.target.share, said.sum()
        above = np.log((positive + 0.5) / (len(said) - positive + 0.5)) - np.log(share / (1 - share))
        more = (x, said, np.ones(len(said)), np.full(len(said), above))
        self.own[view] = tuple(np.concatenate(pair) for pair in zip(self.own[view], more, strict=True))

    def finish(self) -> None:
        t, held = self.target, self.held
        apart = (self.y[held], self.weight[held], self.offset[held])
        raw = [np.clip(logits(self.x[v][held], w), -20, 20) for v, w in enumerate((t.content, t.page))]
        t.calibration = [fit(r[:, None], *apart, towards=1.0) for r in raw]
        t.final = fit(t.calibrated((self.x[0][held], self.x[1][held])), *apart, towards=0.5)


def _in_tasks(df: DataFrame, keep: tuple[str, ...], schema: T.StructType, rows: Callable) -> DataFrame:
    """Runs ``rows(counts, langs, sources, figures)`` on parts of a batch; it returns the columns after ``keep``."""

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts, langs, sources, sizes = (part.column(f"__{n}").to_pylist() for n in NEEDED)
            found = [tokens_of(t) for t in texts]
            figures = np.array([numbers(*r) for r in zip(texts, found, sizes, strict=True)]).reshape(-1, NUMBERS)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), *rows([content(f) for f in found], langs, sources, figures)],
                names=schema.fieldNames(),
            )

    return map_batches(df.select(*keep, *(df[n].alias(f"__{n}") for n in NEEDED)), run, schema)


def parts(counts: dict, bound: int) -> dict:
    """``bound`` rows dealt evenly to classes; one with fewer rows gives all and leaves the rest to the others."""
    out: dict = {}
    for i, key in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        out[key] = min(counts[key], (bound - sum(out.values())) // (len(counts) - i))
    return out


def _sample(documents: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """Ids of the labelled sample with ``low``, ``toxic`` and how many documents each ``stands_for``; written once."""
    there = documents.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = written(
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((1 - F.min("quality")).cast("double").alias("low"), F.max("toxic").cast("double").alias("toxic"))
        .join(there, "doc_id", "left_semi"),
        "cotraining-known",
    )
    counts = {(r["low"], r["toxic"]): r["count"] for r in known.groupBy(*TARGETS).count().collect()}
    take, most, stands_for = parts(counts, labelled), F.lit(0), F.lit(None).cast("double")
    for (low, toxic), n in take.items():
        here = (F.col("low") == low) & (F.col("toxic") == toxic)
        most, stands_for = F.when(here, n).otherwise(most), F.when(here, counts[low, toxic] / max(n, 1)).otherwise(stands_for)
    by_class = Window.partitionBy(*TARGETS).orderBy(F.xxhash64("doc_id"), "doc_id")
    # the least hashes of a class all lie below a border that about twice as many rows stay below as are taken
    border = F.lit(None).cast("long")
    for (low, toxic), n in take.items():
        share = min(1.0, (2 * n + 200) / counts[low, toxic])
        border = F.when((F.col("low") == low) & (F.col("toxic") == toxic), min(int(-(2**63) + share * 2**64), 2**63 - 1)).otherwise(border)
    first = (
        known.where(F.xxhash64("doc_id") <= border).withColumn("rank", F.row_number().over(by_class)).where(F.col("rank") <= max(take.values(), default=0)).where(F.col("rank") <= most)
        .select("doc_id", *TARGETS, stands_for.alias("stands_for"))
    )
    return written(first, "cotraining-ids")


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, tokens: int = TOKENS, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """Fit on at most ``labelled`` labelled rows and on what the views teach each other about all other documents."""
    asked = _sample(documents, labels, labelled)
    sample = documents.select("doc_id", *NEEDED).join(F.broadcast(asked), "doc_id")
    words = T.StructType([*fields(sample, "doc_id", *TARGETS), T.StructField("tokens", T.ArrayType(T.StringType()))])
    held = written(
        _in_tasks(sample, ("doc_id", *TARGETS), words, lambda counts, *_: [pa.array([list(c) for c in counts], pa.list_(pa.string()))]), "cotraining-sample"
    )
    n = held.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in TARGETS)).first()
    stats = written(
        held.select(F.explode("tokens").alias("token"), *TARGETS)
        .groupBy("token").agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).where("n >= 3"),
        "cotraining-tokens",
    )
    targets = {}
    for t in TARGETS:
        positive, total = float(n[t]), float(n["n"])
        expected = F.col("n") * (positive / max(total, 1.0))
        gain = F.pow(F.col(t) - expected, 2) / (expected + 0.5)
        top = stats.where(gain >= SIGNIFICANT).orderBy(gain.desc(), "token").limit(tokens).select("token").collect()
        targets[t] = Target({r["token"]: i for i, r in enumerate(sorted(top, key=lambda r: r["token"]))})

    names = sorted(set().union(*(t.vocabulary for t in targets.values())))
    numbered = {t: i for i, t in enumerate(names)}
    whole, real = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    columns = [T.StructField("tokens", whole), T.StructField("n", whole), T.StructField("figures", real)]

    def features(counts: list[Counter], langs: list, sources: list, figures: np.ndarray) -> list[pa.Array]:
        held = [sorted(numbered.keys() & c.keys()) for c in counts]
        numbers = [[numbered[t] for t in h] for h in held], [[c[t] for t in h] for h, c in zip(held, counts, strict=True)]
        return [*(pa.array(x, pa.list_(pa.int32())) for x in numbers), pa.array(figures.tolist(), pa.list_(pa.float64()))]

    keys = ("row", "doc_id", *TARGETS, "stands_for", "lang", "source")
    every = documents.select(F.xxhash64("doc_id", *NEEDED).alias("row"), "doc_id", *NEEDED).join(F.broadcast(asked), "doc_id", "left")
    table = written(_in_tasks(every, keys, T.StructType([*fields(every, *keys), *columns]), features), "cotraining-features")
    model = _page_model(table, targets)

    rows = table.where(F.col("low").isNotNull()).orderBy("doc_id", "figures").toArrow()
    stands_for = rows.column("stands_for").to_numpy().astype(float)
    started = {t: Fitting(targets[t], _views(rows, names, model, t), rows.column(t).to_numpy().astype(float), stands_for) for t in TARGETS}
    able = {t: f for t, f in started.items() if f.able}
    for _ in range(rounds if able else 0):
        picked = _most_certain(table.where(F.col("low").isNull()), names, model, able, max(per_round // 2, 1))
        if not picked.num_rows:
            break
        for t, f in able.items():
            for v in (0, 1):
                mine = picked.filter(pc.and_(pc.equal(picked.column("target"), t), pc.equal(picked.column("view"), v)))
                if mine.num_rows:
                    said = mine.column("positive").to_numpy().astype(float)
                    f.learn(1 - v, _views(mine, names, model, t)[1 - v], said, mine.column("row").to_pylist())
            f.fit()
    for f in able.values():
        f.finish()
    return model


def _page_model(table: DataFrame, targets: dict[str, Target]) -> Model:
    """Centre and spread of the figures and the commonest categories of all documents."""
    places = range(NUMBERS)
    at = table.agg(*(F.avg(F.col("figures")[i]).alias(f"m{i}") for i in places), *(F.stddev_pop(F.col("figures")[i]).alias(f"s{i}") for i in places)).first()
    held = [F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in ("lang", "source")]
    seen = table.groupBy(*(h.alias(c) for h, c in zip(held, ("lang", "source"), strict=True))).count().select(F.explode(F.array("lang", "source")).alias("name"), "count")
    common = seen.groupBy("name").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "name").limit(256).collect()
    centre, spread = (np.array([at[f"{k}{i}"] or 0.0 for i in places]) for k in "ms")
    return Model({r["name"]: i for i, r in enumerate(common)}, centre, spread + 1e-6, targets)


def _views(rows: pa.Table, names: list[str], model: Model, target: str) -> tuple[np.ndarray, np.ndarray]:
    """(content, page) features of collected rows."""
    held = np.zeros((rows.num_rows, len(names)), dtype=np.float32)
    for i, (at, n) in enumerate(zip(rows.column("tokens"), rows.column("n"), strict=True)):
        held[i, at.values.to_numpy()] = np.log1p(n.values.to_numpy())
    figures = np.array(rows.column("figures").to_pylist()).reshape(-1, NUMBERS)
    page = model.page(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), figures)
    return held[:, [i for i, t in enumerate(names) if t in model.targets[target].vocabulary]], page


def _most_certain(table: DataFrame, names: list[str], model: Model, able: dict[str, Fitting], most: int) -> pa.Table:
    """For each target, view and class the ``most`` rows of which the view is most certain, none twice and none that was picked before."""
    of_names = {}
    for t in able:
        of_names[t] = np.zeros(len(names))
        of_names[t][[i for i, n in enumerate(names) if n in model.targets[t].vocabulary]] = model.targets[t].content[:-1]
    taken = {t: np.array(sorted(f.taken), dtype=np.int64) for t, f in able.items()}
    shared = table.sparkSession.sparkContext.broadcast((model, of_names, taken))
    least = float(np.log(CERTAIN / (1 - CERTAIN)))
    carried = ("row", "lang", "source", "tokens", "n", "figures")
    marks = [("target", T.StringType()), ("view", T.IntegerType()), ("positive", T.BooleanType()), ("sure", T.DoubleType())]
    schema = T.StructType([*fields(table, *carried), *(T.StructField(*m) for m in marks)])

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        m, content_weights, before = shared.value
        ids, first = np.unique(batch.column("row").to_numpy(), return_index=True)  # equal rows count once
        batch = batch.take(pa.array(first))
        tokens, times = batch.column("tokens"), batch.column("n")
        of_row = np.repeat(np.arange(len(ids)), tokens.value_lengths().to_numpy())
        places, logs = tokens.flatten().to_numpy(), np.log1p(times.flatten().to_numpy())
        figures = batch.column("figures").flatten().to_numpy().reshape(-1, NUMBERS)
        page = m.page(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), figures)
        for t, w in content_weights.items():
            free = ~np.isin(ids, before[t])
            by_words = np.bincount(of_row, w[places] * logs, minlength=len(ids)) + m.targets[t].content[-1]
            for v, z in enumerate((by_words, logits(page, m.targets[t].page))):
                z = np.round(z, 6)
                for positive in (False, True):
                    pick = np.flatnonzero(free & ((z if positive else -z) >= least))
                    pick = pick[np.lexsort((ids[pick], -np.abs(z[pick])))[:most]]
                    if len(pick):
                        part, n = batch.take(pa.array(pick)), len(pick)
                        said = [pa.array([t] * n), pa.array([v] * n, pa.int32()), pa.array([positive] * n), pa.array(np.abs(z[pick]))]
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *said], names=schema.fieldNames())

    found = map_batches(table.select(*carried), run, schema)
    key = ["target", "view", "positive"]
    ranks = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.desc("sure"), "row"))  # equal rows share a rank
    best = found.withColumn("rank", ranks).where(F.col("rank") <= most).dropDuplicates([*key, "row"])
    return best.drop("rank").orderBy(*key, F.desc("sure"), "row").toArrow()


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``low_score``, ``toxic_score`` and ``accepted`` for every document."""
    schema = T.StructType([*fields(documents, *keep), *(T.StructField(f"{t}_score", T.DoubleType()) for t in TARGETS), T.StructField("accepted", T.BooleanType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(counts: list[Counter], langs: list, sources: list, figures: np.ndarray) -> list[pa.Array]:
        m = shared.value
        page = m.page(langs, sources, figures)
        scores = [m.targets[t].score((bag(counts, m.targets[t].vocabulary), page)) for t in TARGETS]
        return [*(pa.array(np.round(s, 6)) for s in scores), pa.array(m.accepted(scores))]

    return _in_tasks(documents, keep, schema, rows)


def classify(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(documents, train(documents, labels, **options))


def accept(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without those that the model calls low or toxic; all columns stay as they are."""
    schema = T.StructType(fields(documents, *documents.columns))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        m = shared.value
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts, langs, sources, sizes = (part.column(n).to_pylist() for n in NEEDED)
            found = [tokens_of(t) for t in texts]
            figures = np.array([numbers(*r) for r in zip(texts, found, sizes, strict=True)]).reshape(-1, NUMBERS)
            counts, page = [content(f) for f in found], m.page(langs, sources, figures)
            scores = [m.targets[t].score((bag(counts, m.targets[t].vocabulary), page)) for t in TARGETS]
            yield part.filter(pa.array(m.accepted(scores)))

    return map_batches(documents, run, schema)
