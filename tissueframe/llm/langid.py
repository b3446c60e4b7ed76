"""Language identification by stages: the language family first, then one-versus-one linear support vector machines
between the languages of that family.

Features are relative frequencies of hashed byte bigrams and trigrams of the lower-cased text, with anything in ASCII
that is no letter taken as a blank. The models are linear, so a text's score is a mean of looked-up weights over all its
n-grams: one pass, whatever its length. Each machine is fitted in a task of its own, on ``per_language`` distinct
labelled texts of each of its languages at most (expected number; chosen by a hash of key and text). Those of a family
against the rest take ``per_machine`` texts, half of the family and half of the others, dealt evenly to languages: rare
ones give all they have, so none is lost. Where families have so many languages that their pairs would take more than
``in_all`` texts, each pair takes fewer, ``LEAST_TEXTS`` a language at least; so the rows sent to machines are bounded.
Only weights come to the driver. Scores follow from margins of texts that a machine of the other folds hasn't seen.

Edge cases: a text that is null or has no letter gets ``und`` and score 0; without any usable label all do. Languages
without a known family form the family "other". A text in which languages are equally likely gets the first by name.
Repeated rows are scored alike, and count once in the fit; other columns pass through, and columns named like the
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, arrow_map, plus, slices

PER_LANGUAGE, PER_FAMILY_MACHINE, IN_ALL, LEAST_TEXTS, FOLDS = 600, 1500, 200_000, 40, 3
#: Buckets of bigrams and of trigrams; one more takes what reaches over a text's end.
TWO, THREE = 1 << 11, 1 << 12
DIM = TWO + THREE
#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters in UTF-8; other ASCII as blanks."""
    out = _FOLD[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigram's and the trigram's bucket at each byte; DIM where they reach over the text's end."""
    b = fold(data).astype(np.uint32)
    pad = np.concatenate([b, np.zeros(2, np.uint32)])
    two = pad[:-2] | pad[1:-1] << np.uint32(8)
    three = two | pad[2:] << np.uint32(16)
    two = (two * np.uint32(0x9E3779B1) >> np.uint32(32 - 11)).astype(np.int64)
    three = (three * np.uint32(0x85EBCA77) >> np.uint32(32 - 12)).astype(np.int64) + TWO
    end, full = offs[1:], np.diff(offs) > 0
    two[end[full] - 1] = DIM
    three[end[full] - 1] = DIM
    long = np.diff(offs) > 1
    three[end[long] - 2] = DIM
    return two, three


def has_letter(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, text: str) -> np.ndarray:
    letter = np.concatenate([[0], np.cumsum(_FOLD[data] != 32)])
    ascii_ = np.concatenate([[0], np.cumsum((_FOLD[data] != 32) & (data < 128))])
    some = ascii_[offs[1:]] > ascii_[offs[:-1]]
    for r in np.flatnonzero(~some & (letter[offs[1:]] > letter[offs[:-1]])).tolist():
        some[r] = any(map(str.isalpha, part.column(text)[r].as_py()))
    return some


def _means(weights: np.ndarray, two: np.ndarray, three: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each column of weights, the mean over each text's n-grams; 0 for empty texts."""
    full = np.flatnonzero(np.diff(offs) > 0)
    out = np.zeros((len(offs) - 1, weights.shape[1]))
    n = np.diff(offs)[full]
    for k in range(weights.shape[1]):
        w = np.append(weights[:, k], 0.0)
        out[full, k] = np.add.reduceat(w[two] + w[three], offs[full]) / np.maximum(1, 2 * n - 3)
    return out


def features(df: DataFrame, text: str, label: str) -> DataFrame:
    """``label`` and the frequencies, as 16-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                some = has_letter(part, data, offs, text)
                two, three = grams(data, offs)
                rows = []
                for r in np.flatnonzero(some).tolist():
                    both = np.concatenate([two[offs[r] : offs[r + 1]], three[offs[r] : offs[r + 1]]])
                    f = np.bincount(both, minlength=DIM + 1)[:DIM] / max(1, 2 * int(offs[r + 1] - offs[r]) - 3)
                    some_ = np.flatnonzero(f)
                    rows.append(some_.astype(np.uint16).tobytes() + (f[some_] * SCALE).astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(label).take(pa.array(np.flatnonzero(some))), pa.array(rows, pa.binary())], ["label", "f"])

    return arrow_map(df.select(F.col(label).cast("string").alias(label), text), run, "label string, f binary")


#: Frequencies are scaled so that a typical text has a length near one.
SCALE = 10.0


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, use: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias of an L1-loss support vector machine, y = +1 or -1, by dual coordinate descent over the rows
    ``use`` (all without it), which aren't copied; each class weighs the same in total."""
    use = np.arange(len(y)) if use is None else use
    size, plus_, minus = len(use), (y[use] > 0).sum(), (y[use] < 0).sum()
    limit = np.where(y > 0, cost * size / (2 * max(1, plus_)), cost * size / (2 * max(1, minus)))
    norm, alpha, w, bias = np.einsum("ij,ij->i", x, x) + 1, np.zeros(len(y)), np.zeros(x.shape[1], x.dtype), 0.0
    rng = np.random.default_rng(17)
    for _ in range(rounds):
        moved = 0.0
        for i in use[rng.permutation(size)]:
            new = min(max(alpha[i] - (y[i] * (float(x[i] @ w) + bias) - 1) / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                w += x.dtype.type((new - alpha[i]) * y[i]) * x[i]
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, x.dtype.type(bias))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of P(y = 1) = 1 / (1 + exp(-(a margin + b))), with the usual smoothed targets, by damped Newton steps."""
    p, n = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    x, w = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (q - t)
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def machines(languages: list[str]) -> list[tuple[str, str, str]]:
    """kind, a, b of all machines: "family", a family and "" against the rest; "pair" and two languages of a family."""
    families = by_family(languages)
    rest = [("family", f, "") for f in families] if len(families) > 1 else []
    pairs = [("pair", a, b) for own in families.values() for a, b in combinations(own, 2)]
    return rest[: 1 if len(rest) == 2 else None] + pairs


def by_family(languages: list[str]) -> dict[str, list[str]]:
    fam = {x: FAMILY_OF.get(x, "other") for x in languages}
    return {f: sorted(x for x in languages if fam[x] == f) for f in sorted(set(fam.values()))}


def train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and the curve from margin to probability of one machine; the curve is fitted on margins of rows
    that the weights of the other folds haven't seen (on their own where a fold would lack a class)."""
    fold = np.arange(len(y)) % FOLDS
    margin = np.empty(len(y))
    for k in range(FOLDS):
        use = np.flatnonzero(fold != k)
        w = linear_svm(x, y, use=use if len(set(y[use])) == 2 else None)
        margin[fold == k] = (x @ w[:-1] + w[-1])[fold == k]
    w = linear_svm(x, y)
    return w[:-1], float(w[-1]), *platt(margin, y)


class Model:
    """Weights of all machines side by side: one for each family against the rest, one for each pair within a family.
    ``trained`` maps a machine to its weights, bias and curve."""

    def __init__(self, languages: list[str], trained: dict[tuple[str, str, str], tuple[np.ndarray, float, float, float]]) -> None:
        self.languages, self.families = sorted(languages), by_family(languages)
        self.machines = [(*m, *trained[m][1:]) for m in machines(languages)]
        self.weights = np.stack([trained[m[:3]][0].astype(np.float64) * SCALE for m in self.machines], 1) if self.machines else np.zeros((DIM, 0))

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offs) - 1
        raw = _means(self.weights, *grams(data, offs), offs)
        p = {m[:3]: 1 / (1 + np.exp(-np.clip(m[4] * (raw[:, k] + m[3]) + m[5], -40, 40))) for k, m in enumerate(self.machines)}
        names = list(self.families)
        family = np.ones((n, len(names)))
        for k, f in enumerate(names):
            if ("family", f, "") in p:
                family[:, k] = p["family", f, ""]
            elif len(names) == 2:
                family[:, k] = 1 - p["family", names[0], ""]
        family /= np.maximum(family.sum(1, keepdims=True), 1e-12)
        score = np.zeros((n, len(self.languages)))
        best_family = family.argmax(1)
        for k, f in enumerate(names):
            own = self.families[f]
            vote = {a: np.zeros(n) for a in own}
            for a, b in combinations(own, 2):
                vote[a] += p["pair", a, b]
                vote[b] += 1 - p["pair", a, b]
            for a in own:
                share = vote[a] / (len(own) * (len(own) - 1) / 2) if len(own) > 1 else np.ones(n)
                score[:, self.languages.index(a)] = np.where(best_family == k, family[:, k] * share, -1)
        top = score.argmax(1)
        return [self.languages[t] for t in top], np.clip(score[np.arange(n), top], 0, 1)


def evenly(counts: dict[str, int], total: float) -> dict[str, float]:
    """How many of each to take so that ``total`` are taken: equally many, or all of those that have fewer."""
    left, out = total, {}
    for n, (name, count) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(count, left / (len(counts) - n))
        left -= out[name]
    return out


def allotted(counts: dict[str, int], per_machine: int, in_all: int) -> list[tuple[str, int, float]]:
    """``label, machine, share``: the share of each language's texts that a machine takes."""
    todo, out = machines(sorted(counts)), []
    pairs = sum(kind == "pair" for kind, *_ in todo)
    most = max(LEAST_TEXTS, in_all / (2 * max(1, pairs)))
    for k, (kind, a, b) in enumerate(todo):
        if kind == "pair":
            take = {x: min(counts[x], most) for x in (a, b)}
        else:
            own = {x: n for x, n in counts.items() if FAMILY_OF.get(x, "other") == a}
            take = evenly(own, per_machine / 2) | evenly({x: n for x, n in counts.items() if x not in own}, per_machine / 2)
        out += [(x, k, n / counts[x]) for x, n in take.items()]
    return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, per_machine: int = PER_FAMILY_MACHINE, in_all: int = IN_ALL) -> Model | None:
    """Fits on the labelled rows of ``df``; which of them depends on a hash of key and text alone."""
    lang_ = F.col(lang).cast("string")
    df = df.select(lang_.alias("label"), F.col(text).alias("text"), F.abs(F.xxhash64(F.col(key), F.col(text)) % 1_000_003).alias("draw")).dropna()
    counts = {r[0]: r[1] for r in df.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    picked = df.filter(F.col("draw") < share[F.col("label")] * 1_000_003).groupBy("label", "text").agg(F.min("draw").alias("draw"))
    known = features(picked, "text", "label")
    languages = sorted(counts)
    todo = machines(languages)
    plan = df.sparkSession.createDataFrame(allotted({x: min(n, per_language) for x, n in counts.items()}, per_machine, in_all), "label string, machine int, share double")
    rows = known.join(F.broadcast(plan), "label").filter(F.abs(F.xxhash64("f", F.lit(3)) % 1_000_003) < F.col("share") * 1_000_003).select("label", "f", "machine")

    def run(group: pa.Table) -> pa.Table:
        # Rows in a fixed, mixed order, read where they lie: the features are in memory once, besides the group itself.
        order = pc.sort_indices(group, [("label", "ascending"), ("f", "ascending")]).to_numpy()
        order = order[np.random.default_rng(5).permutation(len(order))]
        k, column = group.column("machine")[0].as_py(), group.column("f")
        labels = group.column("label").take(pa.array(order)).to_pylist()
        x = np.zeros((len(order), DIM), np.float32)
        for r, at in enumerate(order.tolist()):
            sent = column[at].as_py()
            half = len(sent) // 2
            x[r, np.frombuffer(sent[:half], np.uint16)] = np.frombuffer(sent[half:], np.float16)
        kind, a, _ = todo[k]
        y = np.array([1.0 if (FAMILY_OF.get(v, "other") if kind == "family" else v) == a else -1.0 for v in labels])
        w, bias, p, q = train(x, y)
        return pa.table({"machine": pa.array([k], pa.int32()), "w": pa.array([w.astype("<f4").tobytes()], pa.binary()), **{n: pa.array([v]) for n, v in (("bias", bias), ("p", p), ("q", q))}, "seen": pa.array([sorted(set(labels))])})

    fitted = rows.groupBy("machine").applyInArrow(run, "machine int, w binary, bias double, p double, q double, seen array<string>").collect()
    trained = {todo[r.machine]: (np.frombuffer(r.w, "<f4"), r.bias, r.p, r.q) for r in fitted}
    # A language whose texts all lack letters has no features and is left out.
    seen = {x for r in fitted for x in r.seen} if todo else {r[0] for r in known.select("label").distinct().collect()}
    return Model(sorted(seen), trained) if seen else None


def predict(df: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, under these names or others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, text):
                some = has_letter(part, data, offs, text) & bool(model)
                lang, score = model.predict(data, offs) if model else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield append(part, {names[0]: pa.array([x if s else "und" for x, s in zip(lang, some)]), names[1]: pa.array(np.where(some, score, 0.0))})

    return arrow_map(df, run, plus(df.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())))


def held_out(key: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold
