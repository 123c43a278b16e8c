"""Retrieval models, written as SQL expressions.

A model weighs every term position at which document and topic meet, adds or
multiplies the weights, and turns the total into a score. All models of a run
share one aggregation.
"""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """A way to score documents for topics.

    ``weight`` is an expression over one matched term position, with the
    columns ``tf`` and ``dl`` of the document, ``qtf``, ``df`` and ``cf`` of
    the term, ``n_docs``, ``coll_len`` and ``avg_dl`` of the collection.

    ``score`` is an expression over a document and a topic, with ``{total}`` in
    place of the total weight and the columns ``dl``, ``n_docs``, ``coll_len``, and ``n_terms`` and
    ``query_weight`` (the sum of qtf), both over all positions of the topic,
    matched or not. A score of 0, null or NaN means not retrieved.

    Documents without any term of the topic are never looked at, so a model
    must be one that would not retrieve them. A ``conjunctive`` model retrieves
    documents only that hold the term of every position.
    """

    name: str
    weight: str
    score: str = "{total}"
    conjunctive: bool = False
    product: bool = False


# Positions for which a product keeps one aggregate each; later ones share a list.
LEADING_POSITIONS = 32


def totals(model: Model, weight: str, longest: int) -> list[Column]:
    """Aggregates over the column ``weight``, for topics of up to ``longest`` terms.

    Rounding depends on the order of the factors, and documents of equal score
    would change places: a product always runs in query order. The first
    positions have an aggregate each, the factors of later ones are listed, so
    that a long topic leaves the scores of all others as they are.
    """
    if not model.product:
        return [F.sum(weight)]
    leading = min(longest, LEADING_POSITIONS)
    columns = [F.expr(f"max(CASE WHEN pos = {n} THEN {weight} END)") for n in range(leading)]
    if longest > leading:
        later = f"CASE WHEN pos >= {leading} THEN struct(pos, {weight} AS factor) END"
        columns.append(F.expr(f"sort_array(collect_list({later}))"))
    return columns


def total(model: Model, columns: list[str]) -> str:
    """What the columns of :func:`totals` come to."""
    if not model.product:
        return columns[0]
    product = " * ".join(f"coalesce({c}, 1D)" for c in columns[:LEADING_POSITIONS])
    if len(columns) == LEADING_POSITIONS + 1:
        product = f"aggregate({columns[-1]}, {product}, (total, p) -> total * p.factor)"
    return product


def _number(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def unsmoothed_lm(name: str = "LMno") -> Model:
    """Product of relative term frequencies, times document length.

    A plain product, which may underflow to 0.
    """
    p = "CAST(tf AS DOUBLE) / CAST(dl AS DOUBLE)"
    weight = f"CASE WHEN qtf = 1 THEN {p} ELSE pow({p}, qtf) END"
    return Model(name, weight, "{total} * dl", conjunctive=True, product=True)


def interpolated_lm(weight: float, name: str | None = None) -> Model:
    """Linear interpolation of document and collection model, length prior."""
    foreground = f"CAST(tf AS DOUBLE) * CAST(coll_len AS DOUBLE) * {_number(weight)}"
    background = f"CAST(cf AS DOUBLE) * CAST(dl AS DOUBLE) * {_number(1 - weight)}"
    return Model(
        name or f"LMs{weight:.1f}",
        f"qtf * ln(1 + ({foreground}) / ({background}))",
        "CASE WHEN {total} > 0 THEN {total} + ln(CAST(dl AS DOUBLE)) END",
    )


def dirichlet_lm(mu: float = 2500.0, name: str = "LMdi") -> Model:
    """Dirichlet smoothing. The collection part is a whole-number quotient.

    A position without a match adds ``qtf * (ln(mu) - ln(dl + mu))``. That much
    is added for every position at the end, and matches weigh what they have
    beyond it. Without any match the score would be negative.
    """
    m = _number(mu)
    score = f"{{total}} + query_weight * (ln({m}) - ln(dl + {m}))"
    return Model(
        name,
        f"qtf * (ln(tf * (coll_len div cf) + {m}) - ln({m}))",
        f"CASE WHEN {score} > 0 THEN {score} END",
    )


def bm25(k1: float = 1.2, b: float = 0.75, name: str = "BM25") -> Model:
    """Okapi weighting. A term in over half of the documents weighs negative.

    There is no logarithm when df exceeds n_docs, as statistics of another
    collection may have it: such a document is not retrieved.
    """
    k = f"{_number(k1)} * ({_number(1 - b)} + {_number(b)} * (CAST(dl AS DOUBLE) / avg_dl))"
    saturation = f"({_number(k1 + 1)} * tf) / ({k} + tf)"
    odds = "(n_docs - df + 0.5D) / (df + 0.5D)"
    idf = f"CASE WHEN {odds} > 0 THEN ln({odds}) ELSE CAST('NaN' AS DOUBLE) END"
    return Model(name, f"qtf * ({saturation}) * ({idf})")


def lambda_sweep(start: float = 0.1, step: float = 0.2, stop: float = 1.0) -> list[Model]:
    """Interpolated models with weights ``start``, ``start + step``, … below ``stop``."""
    models, weight = [], start
    while weight < stop:
        models.append(interpolated_lm(weight))
        weight += step
    return models


BASELINES = [unsmoothed_lm(), *lambda_sweep(), dirichlet_lm(), bm25()]
