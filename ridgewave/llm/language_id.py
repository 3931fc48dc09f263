"""Operator 13, language identification by hierarchical discrimination.

First the language family is predicted, by one linear support vector machine for each family against the rest; then
one-versus-one linear support vector machines separate the languages within it, by votes, ties by margins.

*Features.*  Letters in lower case, everything else one space; runs of one, two and three characters of the whole text are
counted in a table of hashed places; logarithms of the counts, scaled to unit length.  Texts are read in slices that carry
their last characters over, so memory is bounded and no run is lost.

*Training.*  Counts of languages cover all rows that may be learned from; the ``languages`` most frequent ones are learned.
Each gives an equal share of at most ``sample`` rows, chosen by digests of their ids; features are made by the tasks, so the
driver gets ``sample`` rows of PLACES numbers (64 MB) however long the texts are.  The machines (squared hinge loss) are fitted by
dual coordinate descent.  A family table is a parameter; a language that it doesn't list is a family of its own.

The score is the logistic of the winning family's lead over the next times that of the weakest margin within the family.

Defined cases: a null text or one without a letter is ``und`` with score 0; null languages and null ids aren't learned from,
and rows with a null id aren't held out; with nothing to learn from, every text is ``und`` with score 0; one language alone
is predicted with score 1; repeated rows give repeated results; an empty table gives an empty result; further columns (lang,
source and the id among them) are no inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table, text_of

#: Hashed places of the features, and characters of a slice.
PLACES, SLICE = 4096, 1 << 20
#: Rows that are learned from and languages at most.
SAMPLE, LANGUAGES = 4000, 64
COST, EPOCHS, SEED = 10.0, 12, 11
#: Rows predicted at once.
RUN = 256
#: Families of languages by their codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es pt it ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "indo-aryan": "hi ur bn mr gu pa ne".split(),
    "semitic": "ar he mt am".split(),
    "turkic": "tr az kk uz tk".split(),
}


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_MIXERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def counts(text: str, places: int = PLACES, size: int = SLICE) -> np.ndarray | None:
    """Counts of hashed runs of one to three characters; None for a text without letters."""
    total, carried, found = np.zeros(places), np.array([32], np.uint32), False
    ends = [*range(size, len(text), size), len(text)]
    for start, end in zip([0, *ends], ends):
        piece = text[start:end] + (" " if end == len(text) else "")
        x = np.concatenate([carried, _alphabet()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")]])
        space = x == 32
        new = len(carried)
        keep = ~(space & np.concatenate([[False], space[:-1]]))
        keep[:new] = True
        x = x[keep]
        found = found or bool((x[new:] != 32).any())
        h = np.zeros(len(x), np.uint32)
        for n, mixer in enumerate(_MIXERS):
            # the run of n + 1 characters that ends at each place
            h[n:] = (h[n:] ^ x[: len(x) - n]) * mixer if n else x * mixer
            at = max(new, n)
            last = h[at:]
            if n == 0:
                last = last[x[at:] != 32]
            total += np.bincount((last ^ (last >> np.uint32(15))) % np.uint32(places), minlength=places)
        carried = x[-2:]
    return total if found else None


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a whole text."""
    c = counts(text) if text else None
    if c is None:
        return None
    x = np.log1p(c)
    return (x / np.sqrt(x @ x)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights, the last one a bias, of a linear machine with squared hinge loss; ``y`` is 1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w, alpha, rng = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.random.default_rng(seed)
    curve = (x * x).sum(axis=1) + 0.5 / cost
    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            slope = y[k] * float(x[k] @ w) - 1 + alpha[k] * 0.5 / cost
            new = max(alpha[k] - slope / curve[k], 0.0)
            if new != alpha[k]:
                w += np.float32((new - alpha[k]) * y[k]) * x[k]
                alpha[k] = new
    return w


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Families with their languages, and the weights of all machines side by side."""

    families: list[list[str]]
    weights: np.ndarray
    pairs: list[list[tuple[int, int, int]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of feature rows."""
        margin = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1) @ self.weights
        n = len(self.families)
        if n > 1:
            top = margin[:, :n].argmax(axis=1)
            by = np.sort(margin[:, :n], axis=1)
            sure = _logistic(by[:, -1] - by[:, -2])
        else:
            top, sure = np.zeros(len(x), int), np.ones(len(x))
        names, score = [], []
        for row, f, s in zip(margin, top, sure):
            votes = {k: [0, 0.0, 1.0] for k in range(len(self.families[f]))}
            for a, b, at in self.pairs[f]:
                for lang, m in ((a, row[at]), (b, -row[at])):
                    votes[lang][0] += m > 0
                    votes[lang][1] += float(m)
                    votes[lang][2] = min(votes[lang][2], float(_logistic(2 * m)))
            best = max(votes, key=lambda k: (votes[k][0], votes[k][1], -k))
            names.append(self.families[f][best])
            score.append(s * votes[best][2])
        return names, np.array(score)


def train(rows: list[tuple[str, np.ndarray]], families: dict[str, list[str]] = FAMILIES) -> Model | None:
    """Fit (language, features); None without rows."""
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    lang, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    home = {code: name for name, codes in families.items() for code in codes}
    groups: dict[str, list[str]] = {}
    for code in sorted(set(lang.tolist())):
        groups.setdefault(home.get(code, f"={code}"), []).append(code)
    named = [groups[k] for k in sorted(groups)]
    weights, pairs = [], []
    for codes in named if len(named) > 1 else ():
        weights.append(machine(x, np.where(np.isin(lang, codes), 1.0, -1.0)))
    offset = 0 if len(named) > 1 else 1  # a lone family needs no machine; its column is empty
    weights += [np.zeros(x.shape[1] + 1, np.float32)] * offset
    for codes in named:
        own = []
        for a, b in combinations(range(len(codes)), 2):
            of = np.isin(lang, [codes[a], codes[b]])
            own.append((a, b, len(weights)))
            weights.append(machine(x[of], np.where(lang[of] == codes[a], 1.0, -1.0)))
        pairs.append(own)
    return Model(named, np.stack(weights, axis=1).astype(np.float32), pairs)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE, languages: int = LANGUAGES) -> list[tuple[str, np.ndarray]]:
    """(language, features) of at most ``rows`` rows that aren't held out, about as many of each language."""
    require(df, id_col, text_col, lang_col)
    usable = df.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = usable.select(F.col(lang_col).cast("string").alias("lang"), F.md5(F.col(id_col).cast("string").cast("binary")).alias("digest"), F.col(text_col).cast("string").alias("text"))
    most = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()  # at most ``languages`` rows
    if not most:
        return []
    each = rows / len(most)
    # a digest below the share of its language that is wanted, with a margin
    share = F.create_map(*(F.lit(v) for r in most for v in (r["lang"], min(1.0, 1.25 * each / r["count"]))))
    draw = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / 2.0**32
    chosen = own.where(draw <= F.element_at(share, F.col("lang"))).select("lang", "digest", "text")

    def made(batches):
        for b in batches:
            xs = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if x is None else x.tobytes() for x in xs], pa.binary())], names=["lang", "digest", "x"])

    got = chosen.mapInArrow(made, "lang string, digest string, x binary").where("x IS NOT NULL").orderBy("digest", "lang", "x").limit(rows).collect()  # at most ``rows`` rows
    return [(r["lang"], np.frombuffer(r["x"], np.float32)) for r in got]


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    require(df, id_col, text_col)

    def predicted(batches):
        for b in batches:
            names, scores = ["und"] * b.num_rows, np.zeros(b.num_rows)
            for at in range(0, b.num_rows if model else 0, RUN):
                xs = [features(t.as_py()) for t in b.column(1)[at : at + RUN]]
                rows = [k for k, x in enumerate(xs) if x is not None]
                if rows:
                    own, score = model.predict(np.stack([xs[k] for k in rows]))
                    for k, name, s in zip(rows, own, score):
                        names[at + k], scores[at + k] = name, s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    return df.select(id_col, text_of(text_col).alias("__rw_text")).mapInArrow(predicted, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(sample(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op13_language_id": op13_language_id}
ORACLES: dict[str, str] = {}
