"""Mixing to target weights with soft domain membership.

A labelled table names the domain of some documents. A classifier made of SQL aggregates
learns from them which word beginnings are significantly more frequent in the documents of
a domain than elsewhere; a logistic regression on the sums of their log odds gives every
document a posterior over the domains. Then every
document gets a nonnegative rate, the number of times it is to appear, so that the
expected tokens of each domain, posterior times tokens times rate, match the targets.

The rates are found by projected gradient descent on the squared gap of the domain
totals. Per document a step is ``r = max(floor, r - eta * posterior . gap)``; the gap has
one number per domain, which is all that a step brings to the driver. The steps taken so
far are part of the expression for the rate, and every few steps the rates are written to
the shared folder, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial
from math import log

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row, functions as F

from .common import BLANKS, durable, unused

#: Characters of a word that count unless told otherwise, so that inflected forms are one. Words
#: that differ later only cannot tell domains apart; more characters tell more, and need more learners.
BEGINNING = 4


def _words(text: str) -> Column:
    """Lower-case words between white space; for a text without words one empty string."""
    return F.split(F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS.decode())), r"\s+")


def _beginnings(words: Column, buckets: int, beginning: int) -> Column:
    """Hash buckets of the distinct word beginnings."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(
        F.xxhash64(F.substring(w, 1, beginning)), F.lit(buckets)).cast("int")))


@dataclass
class Classifier:
    """``weights`` has a row per telling bucket; evidence of domain d is ``base[d] + slopes[d] . sums of weights``."""

    weights: DataFrame
    base: list[float]
    slopes: list[list[float]]
    buckets: int
    beginning: int = BEGINNING


def learn(docs: DataFrame, labels: DataFrame, domains: Sequence[str], buckets: int = 1 << 16,
          per_domain: int = 10_000, least_z: float = 3.0, least_odds: float = 1.5, key: str = "doc_id", text: str = "text",
          domain: str = "domain", beginning: int = BEGINNING) -> Classifier:
    """A classifier of ``domains`` from rows of ``labels`` with a key of ``docs``.

    A bucket's weight for a domain is its log odds ratio between the domain's documents
    and the others, where it is at least ``least_odds`` and ``least_z`` standard errors
    above zero, else 0; buckets without any weight are left out, so there are at most
    ``buckets`` rows whatever the data.

    About ``per_domain`` keys of each domain learn, by a hash of the key; the regression
    weighs them by the domains' shares of all labelled keys. Of several labels of a key the
    first in order of ``domains`` counts. Without learners of two domains the posterior is
    the shares alone.
    """
    every = range(len(domains))
    order = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col(domain).cast("string")).cast("int") - 1
    known = labels.filter(F.col(key).isNotNull() & F.col(domain).isNotNull()).select(F.col(key).alias("_key"), order.alias("_d"))
    known = known.filter("_d >= 0").groupBy("_key").agg(F.min("_d").alias("_d"))
    many = {r["_d"]: r["n"] for r in known.groupBy("_d").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for d, n in many.items():
        share = F.when(F.col("_d") == d, per_domain / n).otherwise(share)
    learners = known.filter(F.pmod(F.xxhash64("_key", F.lit("mixing")), F.lit(1 << 30)) < share * (1 << 30))
    learned = durable(
        docs.select(F.col(key).alias("_key"), F.col(text)).join(F.broadcast(learners), "_key")  # bounded by per_domain
        .select("_key", "_d", _beginnings(_words(text), buckets, beginning).alias("_buckets")), "mixing_learners")
    sizes = {r["_d"]: r["n"] for r in learned.groupBy("_d").agg(F.count("*").alias("n")).collect()}
    everyone = sum(sizes.values())
    counts = learned.select("_d", F.explode("_buckets").alias("_bucket")).groupBy("_bucket").agg(
        F.count("*").alias("_all"), *[F.count_if(F.col("_d") == d).alias(f"_n{d}") for d in every])

    def weight(d: int) -> Column:
        inside, outside = F.col(f"_n{d}") + 0.5, F.col("_all") - F.col(f"_n{d}") + 0.5
        odds = F.log(inside) - F.log(outside) + log((everyone - sizes.get(d, 0) + 1) / (sizes.get(d, 0) + 1))
        telling = odds >= F.greatest(F.lit(least_odds), least_z * F.sqrt(1 / inside + 1 / outside))
        return F.when(telling, odds).otherwise(0.0).alias(f"_w{d}")

    weights = counts.select("_bucket", *[weight(d) for d in every])
    weights = durable(weights.filter(F.greatest(F.lit(0.0), *[F.col(f"_w{d}") for d in every]) > 0), "mixing_words")
    base = [log((many.get(d, 0) + 0.5) / (sum(many.values()) + 0.5 * len(domains))) for d in every]
    slopes = [[0.0] * len(domains) for _ in every]
    there = sorted(sizes)
    if len(there) > 1:
        spread = learned.select("_key", "_d", F.explode("_buckets").alias("_bucket")).join(F.broadcast(weights), "_bucket", "left")
        sums = spread.groupBy("_key", "_d").agg(*[F.coalesce(F.sum(f"_w{d}"), F.lit(0.0)).alias(f"_s{d}") for d in every])
        label, weigh = F.lit(0.0), F.lit(1.0)
        for at, d in enumerate(there):
            label = F.when(F.col("_d") == d, float(at)).otherwise(label)
            weigh = F.when(F.col("_d") == d, many[d] / sizes[d]).otherwise(weigh)
        rows = durable(sums.select(label.alias("label"), weigh.alias("weight"), *[f"_s{d}" for d in every]), "mixing_sums")
        rows = VectorAssembler(inputCols=[f"_s{d}" for d in every], outputCol="features").transform(rows)
        fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-4, maxIter=60).fit(rows)
        base = [-30.0] * len(domains)
        for at, d in enumerate(there):
            base[d] = float(fitted.interceptVector[at])
            slopes[d] = [float(fitted.coefficientMatrix[at, e]) for e in every]
    return Classifier(weights, base, slopes, buckets, beginning)


def posteriors(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, _n, tokens, _p0, _p1, ...) for every distinct (key, text), ``_n`` rows of each.

    Tokens are words between white space. The posterior is the softmax of the evidence, to
    which each distinct word beginning of the text counts once. A text without words has
    no tokens and the posterior of a text without telling words.
    """
    domains = range(len(classifier.base))
    body, words = F.coalesce(F.col(text), F.lit("")), _words(text)
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_hash"), words.alias("_words")).select(
        "_key", "_hash", F.when(F.col("_words")[0] == "", 0).otherwise(F.size("_words")).alias("_tokens"),
        F.posexplode(_beginnings(F.col("_words"), classifier.buckets, classifier.beginning)).alias("_at", "_bucket"))
    # at most one row per bucket, 65,536 by default, whatever the data
    scored = rows.join(F.broadcast(classifier.weights), "_bucket", "left")
    sums = scored.groupBy("_key", "_hash").agg(
        F.count_if(F.col("_at") == 0).alias("_n"), F.max("_tokens").cast("long").alias("tokens"),
        *[F.coalesce(F.sum(f"_w{d}"), F.lit(0.0)).alias(f"_s{d}") for d in domains])
    evidence = [sum((F.col(f"_s{e}") / F.col("_n") * slope for e, slope in enumerate(classifier.slopes[d])),
                    F.lit(classifier.base[d])).alias(f"_e{d}") for d in domains]
    sums = sums.select("_key", "_hash", "_n", "tokens", *evidence)
    top = F.array_max(F.array(*[F.col(f"_e{d}") for d in domains]))
    parts = [F.exp(F.col(f"_e{d}") - top) for d in domains]
    total = sum(parts[1:], parts[0])
    return sums.select("_key", "_hash", "_n", "tokens", *[(p / total).alias(f"_p{d}") for d, p in enumerate(parts)])


def _look(state: DataFrame, domains: int, floor: float, ceiling: float, prices: Sequence[float], reach: float) -> tuple[Column, Row]:
    """The rate at ``prices`` of the domains' tokens, and sums over all rows: totals, curvature of free rows, values."""
    price = sum((F.col(f"_p{d}") * float(x) for d, x in enumerate(prices)), F.lit(0.0))
    inner = F.col("rate") - reach * price
    rate = F.least(F.greatest(inner, F.lit(float(floor))), F.lit(float(ceiling)))
    amount = F.col("tokens") * F.col("_n")
    sums = {f"t{d}": F.col(f"_p{d}") * amount * rate for d in range(domains)}
    sums |= {f"c{d}_{e}": F.when((inner > floor) & (inner < ceiling), F.col(f"_p{d}") * F.col(f"_p{e}") * amount)
             for d in range(domains) for e in range(d + 1)}
    sums["cost"] = amount * (rate * price + (rate - F.col("rate")) * (rate - F.col("rate")) / (2 * reach))
    sums["least"] = amount * F.when(price >= 0, price * float(floor)).otherwise(price * float(ceiling))
    return rate, state.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(name) for name, x in sums.items()]).first()


def _settle(look: Callable[[Sequence[float], float], tuple[Column, Row]], targets: Sequence[float], own: Sequence[float],
            near: Sequence[float], most: int = 300) -> Column:
    """The rate whose totals are within ``near`` of the targets, or of the nearest totals that any rates reach.

    Implicit steps of the descent: ``r = clip(r - reach * posterior . prices)`` where the
    prices are the weighted gaps after the step, found by Newton's method with a number per
    domain. Any prices bound the least loss from below, which tells how far the totals are
    from the best; ``reach`` grows until that is near. More than ``most`` scans are an error.
    """
    goal, weigh, near = np.array(targets, float), np.array(own, float), np.array(near, float)
    domains = range(len(goal))
    prices, reach = np.zeros(len(goal)), 1.0
    rate, sums = look(prices, reach)
    step, value, fall, excess = None, 0.0, 0.0, 0.0
    for _ in range(most):
        totals = np.array([sums[f"t{d}"] for d in domains])
        bound = (weigh * prices * prices).sum() / 2 + (goal * prices).sum()
        excess = max(((totals - goal) ** 2 / weigh).sum() / 2 + bound - sums["least"], 0.0)
        if (abs(totals - goal) <= near).all() or (np.sqrt(2 * weigh * excess) <= near).all():
            return rate
        at = bound - sums["cost"]
        if step is not None and at > value - 1e-4 * fall + 1e-13 * abs(value) and abs(step).max() > 1e-12 * abs(prices).max():
            step, fall = step / 2, fall / 2
            prices = prices - step
        else:
            slope = weigh * prices + goal - totals
            if (abs(slope) <= near / 10).all():
                reach, step = reach * 10, None
            else:
                curve = np.array([[sums[f"c{max(d, e)}_{min(d, e)}"] for e in domains] for d in domains])
                step = -np.linalg.solve(np.diag(weigh) + reach * curve, slope)
                value, fall, prices = at, -(slope * step).sum(), prices + step
        rate, sums = look(prices, reach)
    raise RuntimeError(f"rates have not settled after {most} scans: totals {totals.tolist()}, targets {list(targets)}")


def rates(members: DataFrame, domains: int, targets: Sequence[float], floor: float = 0.0, ceiling: float = 100.0,
          steps: int = 60, tolerance: float = 1e-3, per_write: int = 12, scales: Sequence[float] | None = None) -> DataFrame:
    """``members`` (needs _n, tokens, _p0, ...) plus ``rate`` between ``floor`` and ``ceiling``.

    ``targets`` are expected tokens per domain. Projected gradient descent from rate 1 on
    the weighted sum of squared gaps; the gradient of a document is scaled by its tokens.
    It ends when no gap exceeds ``tolerance`` of all target tokens. After ``steps`` plain
    steps the steps are implicit and as long as need be; they also end where no total is
    farther than that from the nearest totals that any rates reach. Neither within 300 scans
    is an error. With ``scales`` the tolerance of each domain is taken of its own scale, or
    of a ten-thousandth of them all if that is more.
    """
    goal = sum(targets) or 1.0
    near = [tolerance * (max(scales[d], 1e-4 * sum(scales)) if scales else goal) for d in range(domains)]
    state = durable(members.withColumn("rate", F.lit(float(min(max(1.0, floor), ceiling)))), "mixing_rates")
    mass = lambda rate: [F.coalesce(F.sum(F.col(f"_p{d}") * F.col("tokens") * F.col("_n") * rate), F.lit(0.0))
                         .alias(f"_t{d}") for d in range(domains)]
    curve = state.agg(*[F.coalesce(F.sum(F.col(f"_p{d}") * F.col(f"_p{e}") * F.col("tokens") * F.col("_n")), F.lit(0.0))
                        .alias(f"_c{d}_{e}") for d in range(domains) for e in range(domains)]).first()
    # the curvatures sum up to all tokens; a domain with next to none of them must not outweigh the others
    least = 1e-4 * sum(curve)
    own = [max(curve[f"_c{d}_{d}"], least) or 1.0 for d in range(domains)]
    # gaps are weighed by the curvature of their domain; the largest row sum bounds what is left
    steepest = max((sum(curve[f"_c{d}_{e}"] / own[e] for e in range(domains)) for d in range(domains)), default=0.0)
    if not steepest:
        return state
    eta = 1.0 / steepest
    rate, taken = F.col("rate"), 0
    for _ in range(steps):
        totals = state.agg(*mass(rate)).first()
        gaps = [totals[f"_t{d}"] - targets[d] for d in range(domains)]
        if all(abs(gap) <= most for gap, most in zip(gaps, near, strict=True)):
            return state.withColumn("rate", rate)
        pull = sum((F.col(f"_p{d}") * float(gap / own[d]) for d, gap in enumerate(gaps)), F.lit(0.0))
        rate = F.least(F.greatest(rate - eta * pull, F.lit(float(floor))), F.lit(float(ceiling)))
        taken += 1
        if taken == per_write:
            state = durable(state.withColumn("rate", rate), "mixing_rates")
            rate, taken = F.col("rate"), 0
    if taken:
        state = durable(state.withColumn("rate", rate), "mixing_rates")
    look = partial(_look, state, domains, floor, ceiling)
    return state.withColumn("rate", _settle(look, targets, own, near))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float = 1.0, floor: float = 0.0,
        ceiling: float = 100.0, buckets: int = 1 << 16, beginning: int = BEGINNING, key: str = "doc_id", text: str = "text",
        domain: str = "domain", of_own: bool = False) -> DataFrame:
    """(key, text hash ``_hash``, tokens, one ``p_<domain>`` per domain, rate, copies) per distinct key and text.

    ``weights`` are the target shares of the domains, ``budget`` the target tokens as a
    multiple of the tokens there are. With ``of_own`` the weights are instead multiples of
    the expected tokens that each domain has, whatever its share, and so is the tolerance;
    ``budget`` does not count then. ``copies`` is the rate rounded to a whole number, up
    or down by a hash of key and text with the right chance. With ``floor`` 1 no document
    is lost.

    Null keys are a key of their own; null, empty and blank texts have no tokens, the
    posterior of a text without known words and with it some rate. Repeated rows share one result row and count as
    often as they occur in the totals. Targets that the floor or ceiling forbids are
    approached as near as these allow, also where the posteriors do not let domains be told
    apart. An empty table gives no rows; without labels all posteriors are even and the
    rates meet the budget alone.
    """
    names = list(weights)
    classifier = learn(docs, labels, names, buckets, key=key, text=text, domain=domain, beginning=beginning)
    members = durable(posteriors(docs, classifier, key, text), "mixing_members")
    if of_own:
        has = list(members.agg(*[F.coalesce(F.sum(F.col(f"_p{d}") * F.col("tokens") * F.col("_n")), F.lit(0.0))
                                 for d in range(len(names))]).first())
        rated = rates(members, len(names), [w * n for w, n in zip(weights.values(), has, strict=True)], floor, ceiling, scales=has)
    else:
        total = members.agg(F.sum(F.col("tokens") * F.col("_n")).alias("t")).first()["t"] or 0
        whole = sum(weights.values())
        rated = rates(members, len(names), [budget * total * w / whole for w in weights.values()], floor, ceiling)
    chance = F.pmod(F.xxhash64("_key", "_hash", F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    rest = F.col("rate") - F.floor("rate")
    return rated.select(
        F.col("_key").alias(key), "_hash", "tokens",
        *[F.col(f"_p{d}").alias(f"p_{name}") for d, name in enumerate(names)], "rate",
        (F.floor("rate") + (chance < rest).cast("int")).cast("int").alias("copies"))


def resample(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as often as ``mixed`` says, with the columns of ``docs``."""
    hashed, copies = unused(docs.columns, "_hash_of_text"), unused(docs.columns, "_copies")
    own = unused(docs.columns, "_key_of_mix")
    plan = mixed.select(F.col(key).alias(own), F.col("_hash").alias(hashed + "2"), F.col("copies").alias(copies))
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(plan, rows[key].eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(hashed + "2")))
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select([f"`{c}`" for c in docs.columns])
