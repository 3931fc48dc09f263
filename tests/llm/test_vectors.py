"""Vector codes, hard negatives and language identification against full searches, plain loops and held-out rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewave.llm import hard_negatives, language_id, vector_codes
from ridgewave.operators.order import Stored

VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, rank int, score string"


def rows_of(seed: int, n: int, width: int = 64, copies: int = 0, labels: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    hot = rng.normal(0, 0.13, width)
    centres = rng.normal(0, 0.13, (6, width))
    out = []
    for k in range(n):
        x = hot if k < copies else centres[k % 6] + rng.normal(0, 0.04, width) if k % 2 else rng.normal(0, 0.13, width)
        out.append((int(k), [float(np.float32(v)) for v in x], 1 if k < copies else int(rng.integers(labels)), "c", 1, 2, "s"))
    random.Random(seed).shuffle(out)
    return out


def odd_rows() -> list[tuple]:
    """Nulls in every column, parts of vectors that can't be read, huge components, other lengths, repeated rows and ids."""
    base = rows_of(5, 300)
    v = base[0][1]
    extra = [
        (None, v, 1), (301, None, 1), (302, v, None), (303, [*v[:-1], None], 1), (304, [*v[:-1], math.nan], 1), (305, [*v[:-1], math.inf], 1), (306, [], 1), (307, v[:32], 1), (308, [1e30] * 64, 1), (309, [0.0] * 64, 2),
        (310, v, 2), (310, v, 2), (310, [-x for x in v], 2), (400, v, 3), (400, v, 2), (None, None, None), (309, [0.0] * 64, None),
    ]
    return base + [(*r, None, None, None, None) for r in extra]


def kept_rows(rows: list[tuple]) -> list[tuple[int | None, np.ndarray, int | None]]:
    fits = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in r[1])]
    out = [(r[0], np.array([math.floor(256 * float(np.float32(x))) for x in r[1]], np.int64), r[2]) for r in fits]
    first = min(out, key=lambda r: (r[0] is None, r[0], r[1].tolist()), default=None)
    return [r for r in out if len(r[1]) == len(first[1])]


# -- codes -----------------------------------------------------------------------------------------
def plain_codes(rows: list[tuple], parts: int = 16, entries: int = 64, rounds: int = 2):
    """(id, code, error, label error) by a full search, and the codebooks' numbers."""
    kept = sorted(kept_rows(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    cuts = np.array_split(np.arange(len(kept[0][1])), parts)
    v = np.stack([r[1] for r in kept])
    books = [v[:entries][:, c].copy() for c in cuts]
    for last in [False] * rounds + [True]:
        found = []
        for p, c in enumerate(cuts):
            d = ((v[:, None, c] - books[p][None]) ** 2).sum(axis=2)
            e = d.argmin(axis=1)
            found.append((e, d.min(axis=1)))
            if not last:
                for k in set(e.tolist()):
                    of = v[e == k][:, c]
                    books[p][k] = [int(s) // len(of) for s in of.sum(axis=0)]
    errors = sum(d for _, d in found)
    by = Counter()
    for r, e in zip(kept, errors.tolist()):
        by[r[2]] += e
    out = [(r[0], "".join(f"{int(found[p][0][k]):02x}" for p in range(parts)), int(errors[k]), by[r[2]]) for k, r in enumerate(kept)]
    return out, [int(x) for b in books for x in b.ravel()]


@pytest.mark.parametrize("labels", [50_000, 2])  # sums by label joined by a broadcast, and by a shuffle
def test_codes_of_odd_rows(spark, labels):
    rows = odd_rows()
    df = vector_codes.compress(spark.createDataFrame(rows, VECTORS), labels=labels)
    got = df.collect()
    want, numbers = plain_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=key) == sorted(want, key=key)
    import hashlib

    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()}


@pytest.mark.parametrize("width, n, parts, entries", [(10, 40, 4, 64), (7, 200, 3, 256), (3, 20, 16, 8), (64, 1, 16, 64), (33, 500, 2, 30)])
def test_codes_of_any_shape(spark, width, n, parts, entries):
    rows = rows_of(n, n, width, copies=n // 3)
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS), parts=parts, entries=entries).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(rows, parts, entries)[0])


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(none).columns == columns and vector_codes.compress(none).count() == 0
    unusable = spark.createDataFrame([(1, None, 1, "c", 1, 1, "s"), (2, [math.nan], 1, "c", 1, 1, "s")], VECTORS)
    assert vector_codes.compress(unusable).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(none, entries=257)


def test_bounds_drop_entries_and_lose_none():
    rng = np.random.default_rng(2)
    for width, scale in ((4, 40), (16, 40), (8, 1 << 26), (5, 1)):
        x, book = rng.integers(-scale, scale + 1, (700, width)), rng.integers(-scale, scale + 1, (64, width))
        met: list[int] = []
        entry, d = vector_codes.nearest_entries(x, book, met)
        full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        assert met[0] == full.size and sorted(met, reverse=True) == met
        if width == 4:
            assert met[-1] < full.size / 3  # few pairs are computed exactly


# -- hard negatives --------------------------------------------------------------------------------
def plain_negatives(rows: list[tuple], every: int = 100, k: int = 5) -> list[tuple]:
    kept = [(i, v, label) for i, v, label in kept_rows([r for r in rows if r[0] is not None and r[2] is not None])]
    anchors = {}
    for i, v, label in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v.tolist())), (label, v.tolist()))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-int(v @ np.array(q)), i, own) for i, v, own in kept if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [(n, i) for n, i, own in scored if own != label and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fits)]
    return sorted(out)


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("block, cells, leaf", [(2048, 1024, 128), (40, 16, 8), (100, 1, 7), (16, 64, 3)])
def test_negatives_against_full_search(spark, block, cells, leaf):
    rows = rows_of(9, 900, copies=300, labels=3)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, block=block, cells=cells, leaf=leaf).select(*NAMES).collect()
    want = plain_negatives(rows, 20)
    assert len(want) > 200 and sorted(map(tuple, got)) == want


def test_negatives_of_odd_rows(spark):
    rows = odd_rows()
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, block=64, leaf=16).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 10)
    none = hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0)
    assert none.columns == list(NAMES) and none.count() == 0
    alone = spark.createDataFrame(rows_of(1, 1), VECTORS)
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0


def test_huge_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in rng.uniform(-500_000, 500_000, 64) * (1 if k % 3 else -1)], k % 2, "c", 1, 1, "s") for k in range(120)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, block=30, leaf=8).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 10)


def test_trees_leave_out_what_bounds_allow():
    rng = np.random.default_rng(8)
    centres = rng.integers(-60, 60, (40, 16))
    v = (centres[rng.integers(40, size=4000)] + rng.integers(-3, 4, (4000, 16))).astype(float)
    most = float((v**2).sum(axis=1).max())
    tree = hard_negatives.build(v, np.sqrt(most - (v**2).sum(axis=1)), 50)
    ids = np.arange(len(v))
    read = 0
    for k in range(0, 4000, 100):
        scores = np.rint(v @ v[k]).astype(int)
        high, low = int(0.9 * scores[k]), int(0.7 * scores[k])
        wish = hard_negatives.Wish(low, high, 5, [])
        read += hard_negatives.search(v[k], [wish], most, v[tree.order], np.ones(len(v), bool), ids[tree.order], tree)
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if low <= s <= high)[:5]
        assert wish.found == want
    assert read < 0.6 * 40 * (len(tree.starts) - 1)


def test_cells_bound_their_rows():
    rng = np.random.default_rng(3)
    v = rng.integers(-90, 90, (3000, 12)).astype(float)
    most = float((v**2).sum(axis=1).max())
    cells = hard_negatives.Cells(v[:600], most, 16)
    home = cells.place(v)
    assert cells.n >= 16 and len(set(home.tolist())) > 8
    least, largest = cells.scores(v[:50])
    for r in range(50):
        s = v @ v[r]
        assert (s <= largest[r][home]).all() and (s >= least[r][home]).all()


def test_blocks_stay_bounded_for_copies(spark):
    """A vector that half of the rows share makes one cell large, and its blocks no larger than others."""
    rows = rows_of(2, 2000, 8, copies=1000)
    from ridgewave.llm.vectors import integer_vectors

    ints, _ = integer_vectors(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", "label")
    index = hard_negatives.Index(ints, Stored(spark), block=50, cells=16, leaf=10)
    sizes = [r["n"] for r in index.trees.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) < 110


def to_driver(spark, job) -> float:
    """Megabytes that the tasks of one stage send to the driver at most while ``job`` runs, results and what is to be broadcast."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        them = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return {(x.stageId(), x.attemptId()): x.resultSize() for x in map(them.apply, range(them.size()))}

    before = stages()
    job()
    return max(n for k, n in stages().items() if k not in before) / 1e6


def test_anchors_times_blocks_never_reach_the_driver(spark):
    """200 anchors meet 250 blocks each: 50,000 visits, which the planner takes for a table as small as the anchors."""
    rows = rows_of(6, 2000, 32, labels=3)
    df = spark.createDataFrame(rows, VECTORS)
    out = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100_000)  # more than the anchors and less than the blocks
    try:
        mb = to_driver(spark, lambda: out.append(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block=8, cells=1, leaf=8).select(*NAMES).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert mb < 2
    assert sorted(map(tuple, out[0])) == plain_negatives(rows, 10)


def test_the_sample_is_bounded_over_all_partitions(spark):
    df = spark.range(0, 60_000, 1, 12).select("id", F.array(*(F.rand(k) for k in range(8))).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    from ridgewave.llm.vectors import integer_vectors

    ints, _ = integer_vectors(df, "id", "embedding", "label")
    mb = to_driver(spark, lambda: hard_negatives.Index(ints, Stored(spark)))
    assert mb < 1.5


def test_groups_and_chunks_of_any_size(spark, monkeypatch):
    """Many meetings with several chunks of anchors and few blocks give the same rows."""
    for name, n in (("GROUPS", 3), ("GROUP", 2), ("HELD", 7), ("PART", 5)):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = rows_of(12, 300, 16, copies=60, labels=3)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, block=40, cells=8, leaf=8).select(*NAMES).collect()
    assert len(got) > 50 and sorted(map(tuple, got)) == plain_negatives(rows, 20)


@pytest.mark.parametrize("ranked", [1 << 18, 3])
def test_sweeps_equal_full_searches(monkeypatch, ranked):
    monkeypatch.setattr(hard_negatives, "RANKED", ranked)
    rng = np.random.default_rng(8)
    centres = rng.integers(-60, 60, (40, 16))
    v = (centres[rng.integers(40, size=4000)] + rng.integers(-3, 4, (4000, 16))).astype(float)
    v[50:90] = v[0]  # ties
    most = float((v**2).sum(axis=1).max())
    tree = hard_negatives.build(v, np.sqrt(most - (v**2).sum(axis=1)), 50)
    tree.nodes[:, 0] = np.argsort(tree.order)[tree.nodes[:, 0].astype(int)]  # as rows are in the tree's order
    anchors, ids = np.arange(0, 4000, 100), np.arange(len(v))
    scores = np.rint(v @ v[anchors].T).astype(int).T
    own = scores[np.arange(len(anchors)), anchors]
    low, high = np.stack([0.7 * own, -1 * own, own + 1], axis=1).astype(np.int64), np.stack([0.9 * own, own, own], axis=1).astype(np.int64)
    best = hard_negatives.Best(low.copy(), high, 5)
    read = hard_negatives.sweep(v[anchors], np.arange(len(anchors)), best, most, v[tree.order], lambda a, j: tree.order[j] != anchors[a], ids[tree.order], tree)
    for a in range(len(anchors)):
        for w in range(3):
            want = sorted((-int(s), int(i)) for s, i in zip(scores[a], ids) if low[a, w] <= s <= high[a, w] and i != anchors[a])[:5]
            assert [(-int(s), int(i)) for s, i in zip(best.score[a, w], best.id[a, w]) if s > hard_negatives.NONE] == want
    one = hard_negatives.Best(low[:1, :1].copy(), high[:1, :1], 5)  # a narrow window of one anchor
    few = hard_negatives.sweep(v[anchors[:1]], np.zeros(1, int), one, most, v[tree.order], lambda a, j: tree.order[j] != anchors[0], ids[tree.order], tree)
    assert few < len(tree.starts) - 1 and read <= len(tree.starts) - 1


# -- languages -------------------------------------------------------------------------------------
DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, score string, held_out string"


def test_features_are_the_same_in_slices():
    draw = random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice("ab Zß.ÉΣ1\t\nñ中𝒳") for _ in range(draw.randrange(60)))
        whole = language_id.counts(text)
        for size in (1, 2, 3, 7):
            part = language_id.counts(text, size=size)
            assert (whole is None) == (part is None) and (whole is None or (whole == part).all()), (text, size)


def test_features_count_runs():
    """Against plain string slices."""
    text = "Ab, ab3C  é"
    plain = " ab ab c é "
    assert language_id.counts(text).sum() == sum(c != " " for c in plain) + len(plain) - 1 + len(plain) - 2
    assert language_id.counts("123 !?") is None and language_id.features(None) is None and language_id.features("") is None
    same = language_id.counts(plain)
    assert (language_id.counts(text) == same).all()


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 6)).astype(np.float32)
    y = np.where(x @ [1, -2, 0.5, 0, 0, 1] + 0.3 > 0, 1.0, -1.0)
    w = language_id.machine(x, y, epochs=400).astype(float)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.98
    # the optimum of the loss: no small change lowers it
    w = language_id.machine(x, y, cost=0.1, epochs=400).astype(float)
    loss = lambda w: 0.5 * w @ w + 0.1 * (np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum()
    assert all(loss(w + d) > loss(w) - 1e-3 for d in rng.normal(0, 0.01, (50, 7)))


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(language_id.sample(docs))
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"]]
    rows = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = [i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 100 and np.mean([rows[i]["lang_pred"] == lang[i] for i in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    # no other column is an input
    bare = docs.select("doc_id", "text", *(F.lit("x").alias(c) for c in ("lang", "source")))
    assert sorted(map(tuple, language_id.identify(bare, model).collect())) == sorted(map(tuple, rows.values()))


def test_languages_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.sample(docs, rows=100)
    assert len(got) <= 100 and min(Counter(lang for lang, _ in got).values()) >= 10
    assert {lang for lang, _ in language_id.sample(docs, languages=2)} == {"en", "fr"}
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert language_id.sample(held) == []


def test_languages_of_odd_rows(spark):
    long = "der und die " * 300_000
    rows = [(1, "the and of", "en"), (1, "the and of", "en"), (2, None, "en"), (3, "", None), (4, "12 !", "de"), (None, "the of", "en"), (6, long, "de"), (7, "le la les", "xx"), (8, "\0 é", None)] * 2
    df = spark.createDataFrame([(*r, None, k, k, "s", "h") for k, r in enumerate(rows)], DOCS)
    model = language_id.train([(lang, language_id.features(t)) for lang, t in (("en", "the and of to"), ("de", "der und die"), ("xx", "le la les"))])
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 6, 7, None)] == ["en", "und", "und", "und", "de", "xx", "en"] and got[8]["lang_pred"] in ("en", "de", "xx")
    assert got[2]["score"] == got[4]["score"] == 0
    assert len(language_id.identify(df, model).collect()) == len(rows)
    assert {r["lang_pred"] for r in language_id.identify(df, None).collect()} == {"und"}
    one = language_id.train([("en", language_id.features("the"))])
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(df, one).collect()} == {("en", 1.0), ("und", 0.0)}
    empty = spark.createDataFrame([], DOCS)
    assert language_id.sample(empty) == [] and language_id.identify(empty, model).count() == 0
    assert not df.select(language_id.held_out().alias("h")).where("h IS NULL").count()
