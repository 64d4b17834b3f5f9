"""Bounded labelled samples and a small calibrated regression for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize

#: Characters learned from of one document, and the even pieces that a longer one gives.
SAMPLE_CHARS, PIECES = 16_000, 4


def sampled_text(text: F.Column) -> F.Column:
    """The whole text, or of a longer one ``PIECES`` pieces from its beginning to its end."""
    size = SAMPLE_CHARS // PIECES
    step = (F.length(text) - size) / (PIECES - 1)
    cut = [F.substr(text, F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(PIECES)]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws("\n", *cut))


def _depth(lot: F.Column) -> F.Column:
    """How rare so small a lot is: 64 steps for each halving."""
    return F.floor((63 - F.log2(lot.cast("double") + 1)) * 64).cast("int")


def _lots(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with a hash ``lot`` of the id, and its ``depth``."""
    lot = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 63) - 1))
    return rows.withColumn("lot", lot).withColumn("depth", _depth(F.col("lot")))


def smallest_lots(counted: DataFrame, per_class: int, most_classes: int | None = None, in_all: int | None = None, fewest: int = 1) -> tuple[dict, dict, int]:
    """For each label, how deep rows must be for ``per_class`` of them or all, and its rows, from
    (label, depth, count), and the number for each: where there are so many labels that these are more
    than ``in_all`` rows, an even share, but ``fewest``. Of more labels than ``most_classes`` those with
    most rows."""
    if most_classes is not None:
        top = counted.groupBy("label").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "label").limit(most_classes)
        counted = counted.join(F.broadcast(top), "label")
    rows = sorted(counted.select("label", "depth", "count").collect(), key=lambda r: (str(r["label"]), -r["depth"]))
    if in_all is not None:
        per_class = max(fewest, min(per_class, in_all // max(1, len({r["label"] for r in rows}))))
    least: dict = {}
    total: dict = {}
    for r in rows:
        if total.get(r["label"], 0) < per_class:
            least[r["label"]] = r["depth"]
        total[r["label"]] = total.get(r["label"], 0) + r["count"]
    return least, total, per_class


def _deep_enough(least: dict, depth: str = "depth") -> F.Column:
    """Condition on (label, depth); one comparison for each label."""
    if not least:
        return F.lit(False)
    bounds = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    return F.col(depth) >= F.try_element_at(bounds, F.col("label"))


def _first(found: list, per_class: int) -> list[tuple]:
    rows: list[tuple] = []
    seen: dict = {}
    for lot, label, key, text in sorted(found, key=lambda r: (r[0], str(r[1]), r[2], r[3])):
        if seen.get(label, 0) < per_class:
            seen[label] = seen.get(label, 0) + 1
            rows.append((label, key, text))
    return sorted(rows)


def own_sample(docs: DataFrame, label_col: str, folds: int, held_out: int, per_class: int, most_classes: int | None = None, id_col: str = "doc_id", text_col: str = "text", in_all: int | None = None, fewest: int = 1) -> tuple[list[tuple[str, str, str]], dict]:
    """(label, id, text) of ``per_class`` different rows of each label in ``docs`` itself, those whose
    ids hash lowest, and the number of different rows of each label; of very many labels an even share
    of ``in_all`` rows, but ``fewest``. Where many rows share an id, or have none, those are taken whose
    texts hash lowest, so that some more than ``per_class`` rows of a label are fetched at most. Rows of
    the held-out fold and rows without label or text are left out; long texts give pieces."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    rows = _lots(rows.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & (fold("id", folds) != held_out)), "id")
    rows = rows.withColumn("print", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))).withColumn("inner", _depth(F.col("print")))
    slim = rows.select("label", "lot", "depth", "print", "inner").distinct()
    counted = materialize(slim.groupBy("label", "depth").count(), "lots")
    least, total, per_class = smallest_lots(counted, per_class, most_classes, in_all, fewest)
    if not least:
        return [], {}
    wanted = _deep_enough(least)
    many = {r.label for r in counted.filter(wanted).groupBy("label").agg(F.sum("count").alias("n")).filter(F.col("n") > 2 * per_class).collect()}
    if many:
        own = slim.filter(wanted & F.col("label").isin(list(many))).groupBy("label", F.col("inner").alias("depth")).count()
        inner, _, _ = smallest_lots(own, per_class)
        wanted = wanted & (~F.col("label").isin(list(many)) | _deep_enough(inner, "inner"))
    found = rows.filter(wanted).select("lot", "label", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), sampled_text(F.col("text")).alias("text")).distinct()
    return _first([tuple(r) for r in found.collect()], per_class), total


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", classes: tuple = (0, 1)) -> tuple[list[tuple[int, str, str]], dict]:
    """The same with labels from another table. A document labelled twice has its largest label,
    one that stands there twice its smallest text; labels without a text are not counted."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(list(classes)) & (fold("id", folds) != held_out))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    usable = materialize(_lots(known.join(texts.select("id"), "id", "left_semi"), "id"), "labelled")
    least, total, _ = smallest_lots(usable.groupBy("label", "depth").count(), per_class)
    if not least:
        return [], {}
    # At most about per_class rows of each class.
    wanted = usable.filter(_deep_enough(least)).drop("depth")
    found = texts.join(F.broadcast(wanted), "id").groupBy("lot", "label", "id").agg(F.min(sampled_text(F.col("text"))).alias("text"))
    return _first([(r["lot"], r["label"], str(r["id"]), r["text"]) for r in found.collect()], per_class), total


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic regression (the last weight is the constant)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge * w
        curve = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return mean, scale, w


def probability(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)))
