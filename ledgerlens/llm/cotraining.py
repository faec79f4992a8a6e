"""A quality classifier by co-training of two views.

The content view sees hashed byte 3-grams of the letters of the text alone. The page view sees the rest: metadata
(language, source and length as given) and the page's form in numbers (lines, shares of capitals, digits and
signs, repetition). Each view is fitted to labelled documents; in each round both score all documents without a label,
on the executors, and each passes the ones that it is surest of to the other as pseudo-labels. Both are then calibrated on
labelled documents kept aside, combined, and applied to all documents.

The labelled documents that are fitted to are a bounded sample, LABELLED rows by a hash of the id. Of those without a
label all take part in every round; PASSED is how many a view passes on in one, as in any co-training.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

LABELLED = 6_000
BINS = 1024
SOURCE_BINS = 32
ROUNDS = 3
#: Documents that a view passes on in a round, of both labels in their proportion, and how sure of each it must be.
PASSED, SURE = 300, 0.9
CALIBRATION_FOLD = 4
SEED = 7

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def content_features(text: str | None):
    """Square roots of the frequencies of hashed byte 3-grams of the letters, as a vector of length 1."""
    import numpy as np

    data = np.frombuffer(b" ".join((text or "").encode("utf-8").translate(_LETTERS).split()), dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(BINS, dtype=np.float32)
    x = (data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)) * np.uint32(2654435761)
    out = np.sqrt(np.bincount(x >> np.uint32(22), minlength=BINS)).astype(np.float32)
    return out / np.linalg.norm(out)


def page_features(text: str | None, lang: str | None, source: str | None, length: int | None = None):
    import numpy as np

    text = text or ""
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(data, minlength=256)
    share = lambda lo, hi: float(kinds[lo : hi + 1].sum()) / n
    words = text.split()
    lines = text.count("\n") + 1
    out = np.zeros(12 + 2 * SOURCE_BINS, dtype=np.float32)
    capitals, small, digits = share(65, 90), share(97, 122), share(48, 57)
    blank = share(9, 13) + share(32, 32)
    signs = share(33, 126) - capitals - small - digits
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    out[:10] = [np.log1p(len(text)) / 10, np.log1p(lines) / 5, len(words) / n, capitals * 4, digits * 4, signs * 4, blank, repeats, len(set(words)) / max(1, len(words)), 1 - capitals - small - digits - blank - signs]
    out[10:12] = [length is None, np.log1p(max(0, length or 0)) / 10]
    out[12 + zlib.crc32(str(lang).encode()) % SOURCE_BINS] = 1
    out[12 + SOURCE_BINS + zlib.crc32(str(source).encode()) % SOURCE_BINS] = 1
    return out


def fit_logistic(x, y, weight=None, l2: float = 1e-3, steps: int = 150, start=None):
    """Weights, the intercept last, of an L2-regularised logistic regression by accelerated gradient steps."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    turned = np.ascontiguousarray(x.T)
    times = lambda a, v: a @ v.astype(a.dtype)  # noqa: E731  # else the whole table is converted in every step
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    # a bound of the largest eigenvalue, by power iteration
    v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
    for _ in range(15):
        v = times(turned, weight * times(x, v)).astype(float)
        v /= max(1e-12, np.linalg.norm(v))
    rate = 1 / (0.25 * 1.2 * float(weight @ times(x, v).astype(float) ** 2) + l2 + 1e-9)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    z = w.copy()
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(x, z).astype(float), -30, 30)))
        grad = times(turned, weight * (p - y)) + l2 * np.r_[z[:-1], 0]
        new = z - rate * grad
        z = new + k / (k + 3) * (new - w)
        w = new
    return w


def margins(x, w):
    return x @ w[:-1] + w[-1]


def co_train(labelled: list[tuple], ask, rounds: int = ROUNDS, passed: int = PASSED) -> dict:
    """The model of views (content, page, label): weights of both and of their combination.

    ask(weights, counts) gives the documents without a label that the views with those weights are surest of: rows (view,
    label, key, content, page), for each view and label counts[label] at most, of no less than SURE.
    """
    import numpy as np

    y = np.array([r[2] for r in labelled], dtype=np.float64)
    aside = np.arange(len(y)) % CALIBRATION_FOLD == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    views = [np.stack([r[v] for r in labelled]) for v in (0, 1)]
    prior = y[~aside].mean()
    counts = {1: max(1, round(passed * prior)), 0: max(1, round(passed * (1 - prior)))}
    taught: list[dict] = [{}, {}]  # what each view has been passed: key -> (features, label)

    def fit(v, start=None):
        rows = [taught[v][k] for k in sorted(taught[v])]
        x = np.vstack([views[v][~aside], *[r[0][None] for r in rows]])
        own = np.concatenate([y[~aside], [r[1] for r in rows]])
        weight = np.concatenate([np.ones((~aside).sum()), np.full(len(rows), 0.5)])
        return fit_logistic(x, own, weight, start=start, steps=150 if start is None else 50)

    w = [fit(0), fit(1)]
    for _ in range(rounds):
        found = ask(w, counts)
        for v, label, key, content, page in found:
            taught[1 - v].setdefault(key, ((content, page)[1 - v], float(label)))
        if not found:
            break
        w = [fit(v, w[v]) for v in (0, 1)]
    # each view's own calibration, then the combination of the calibrated views
    m = [margins(views[v][aside], w[v]) for v in (0, 1)]
    scale = [fit_logistic(x[:, None] / 4, y[aside], l2=1e-4, steps=300) for x in m]
    both = np.stack([margins(x[:, None] / 4, s) for x, s in zip(m, scale, strict=True)], axis=1)
    return {"views": w, "scale": scale, "both": fit_logistic(both / 4, y[aside], l2=1e-3, steps=300), "passed": [len(x) for x in taught]}


def score_views(model: dict, content, page):
    """(content probability, page probability, combined probability), each calibrated."""
    import numpy as np

    if "constant" in model:
        p = np.full(len(content), model["constant"])
        return p, p, p
    own = [margins(margins(x, w)[:, None] / 4, s) for x, w, s in zip((content, page), model["views"], model["scale"], strict=True)]
    both = margins(np.stack(own, axis=1) / 4, model["both"])
    return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*own, both))


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, source_col: str | None, length_col: str | None) -> DataFrame:
    """(_id, text, lang, source, length, key): what the views look at; rows that are equal in all of it have the same key."""
    as_text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    length = F.col(length_col).cast("long") if length_col in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), as_text(text_col).alias("text"), as_text(lang_col).alias("lang"), as_text(source_col).alias("source"), length.alias("length"))
    return rows.withColumn("key", F.xxhash64("_id", "text", "lang", "source", "length", F.lit(SEED)))


def _features(rows: DataFrame) -> list[tuple]:
    """(kept columns, content, page) of the rows of a bounded table (text, lang, source, length, kept ...)."""
    import numpy as np

    kept = rows.columns[4:]
    kind = rows.select(*kept).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def batches(parts):
        import pyarrow as pa

        for batch in parts:
            own = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array([content_features(r[0]).tobytes() for r in own], pa.binary()), pa.array([page_features(*r).tobytes() for r in own], pa.binary())], names=[*kept, "content", "page"])

    got = rows.mapInArrow(batches, f"{kind}, content binary, page binary").collect()
    view = lambda b: np.frombuffer(b, dtype=np.float32)
    return [(*r[:-2], view(r["content"]), view(r["page"])) for r in got]


def _feature_batches(batch, first: int = 1, size: int = 2048):
    """Both views' features of a batch (text, lang, source, length from the column ``first`` on), some rows at a time."""
    import numpy as np

    content, page = [], []
    for t, g, s, n in zip(*(batch.column(first + i) for i in range(4)), strict=True):
        t = t.as_py()
        content.append(content_features(t))
        page.append(page_features(t, g.as_py(), s.as_py(), n.as_py()))
        if len(content) == size:
            yield np.stack(content), np.stack(page)
            content, page = [], []
    if content:
        yield np.stack(content), np.stack(page)


def surest(rows: DataFrame, known: DataFrame, weights, counts: dict) -> DataFrame:
    """(view, label, key, sure) of the rows whose id isn't ``known`` (_id): for each view and label the counts[label] surest, of no less than SURE.

    Every row is scored; ties go to the smaller key, and rows of the same key count once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    kind = rows.schema["_id"].dataType.simpleString()

    def batches(parts):
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            scores = [np.stack([margins(x, w) for x, w in zip(views, shared.value, strict=True)]) for views in _feature_batches(batch)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(scores, axis=1) if scores else np.zeros((2, 0)), -30, 30).astype(float)))
            some = (np.maximum(p, 1 - p) >= SURE).any(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(p[0]), pa.array(p[1])], names=["_id", "key", "p0", "p1"]).filter(pa.array(some))

    scored = rows.mapInArrow(batches, f"_id {kind}, key long, p0 double, p1 double").join(known, "_id", "left_anti")
    told = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(y).alias("label"), (F.col(f"p{v}") if y else 1 - F.col(f"p{v}")).alias("sure")) for v in (0, 1) for y in (1, 0)])
    once = scored.groupBy("key").agg(F.max("p0").alias("p0"), F.max("p1").alias("p1"))  # equal rows share a rank: a row of millions of copies would pass whole into one task
    each = once.select("key", F.inline(told)).where(F.col("sure") >= SURE)
    order = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "key")
    ranked = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("label") == 1, counts[1]).otherwise(counts[0]))
    return ranked.where(F.col("r") <= max(counts.values())).select("view", "label", "key", "sure")


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source", length_col: str | None = "n_chars", label_col: str = "quality", labelled_rows: int = LABELLED, rounds: int = ROUNDS, passed: int = PASSED) -> dict:
    """A model for ``classify_quality``.

    A document's label is the majority of its rows in ``labels`` (good, in a tie); null labels and ids
    don't count. The driver gets the feature vectors, about 4 kB each, of ``labelled_rows`` documents at most, and in each
    round those of the 2 * ``passed`` surest ones. Documents without an id take part as documents without a label do.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    rows = _rows(docs, id_col, text_col, lang_col, source_col, length_col)
    ids = rows.where(F.col("_id").isNotNull()).select("_id").distinct().join(known, "_id")
    few = written(ids.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(labelled_rows), "labelled")
    # of rows that share an id the one of the lowest key
    picked = rows.join(F.broadcast(few), "_id").withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy("key"))).where("_r = 1")
    order = F.xxhash64("_id", F.lit(SEED)).alias("h")
    sample = sorted(_features(picked.select("text", "lang", "source", "length", order, "key", "label")), key=lambda r: r[:2])

    def ask(weights, counts):
        found = written(surest(rows, known.select("_id"), weights, counts), "surest")
        keys = F.broadcast(found.groupBy("key").agg(F.collect_list(F.struct("view", "label")).alias("told")))  # 2 * passed rows at most
        of = rows.join(keys, "key").select("text", "lang", "source", "length", "key", "told").dropDuplicates(["key"])
        got = _features(of)
        return sorted(((v, y, key, content, page) for key, told, content, page in got for v, y in told), key=lambda r: r[:3])

    return co_train([(content, page, label) for *_, label, content, page in sample], ask, rounds, passed)


def classify_quality(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source", length_col: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id_col, content_score, page_score, score, keep (score >= threshold).

    Scores are calibrated probabilities of good quality. A null text counts as empty, a null language,
    source or length as a value of its own. Without labels of both kinds all scores are the share of good
    labels (0.5 without any). Repeated rows stay; empty tables stay empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts):
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            scores = [score_views(shared.value, *views) for views in _feature_batches(batch)]
            columns = [np.concatenate(c) for c in zip(*scores, strict=True)] if scores else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns), pa.array(columns[2] >= threshold)], names=["_id", "content_score", "page_score", "score", "keep"])

    rows = _rows(docs, id_col, text_col, lang_col, source_col, length_col).drop("key")
    return rows.mapInArrow(batches, f"_id {kind}, content_score double, page_score double, score double, keep boolean").withColumnRenamed("_id", id_col)
