"""Mixing to target weights over soft domains, in DataFrame functions only.

A naive Bayes classifier over the distinct hashed words, word beginnings and word ends of a text, counted
from a labelled table, gives each document a posterior over domains; features whose counts chance
could explain have no say. Words are exploded into their hashes and joined with the table of
telling features; what a document hits is added up by its key.

Rates are fitted by projected gradient on least squares: each round one aggregation gives the
expected tokens of each domain at the present rates, each domain's miss counts in parts of what it
has, and every document's rate takes a step against its gradient and is cut off at 0 (and at the
ceiling). The steps of a few rounds are one expression over a document's posteriors; then the
rates are written, so neither the plan nor its work grows with the rounds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import discard, held_out, written

MOST_LABELLED = 20_000
#: Standard deviations above its expected count, and least log ratio, from which a feature has a say.
SIGNIFICANT = 5.0
TELLING = 1.0
#: Largest log odds of a domain against the first, and most that features which a text lacks count against one.
SUREST = 12.0
LACKING = 5.0
#: Domains by labels, the first of which sets the total: its documents keep about their rate of 1.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.97, "poor": 0.01, "toxic": 0.02}
#: Most rounds, largest miss in parts of all tokens at which they end, least gain in parts of the error by which they go on, and rounds after which rates are written.
ROUNDS = 60
TOLERANCE = 1e-5
GAINING = 1e-3
WRITTEN_AFTER = 8
#: Telling features up to which their table is broadcast, 24 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def labelled_domains(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, domain): toxic, or else poor or clean by quality; at most `most` rows that aren't held out, the same ones each time."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    return one.select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _words(text: str = "text") -> Column:
    """Words of a text; the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")


def tokens(words: Column) -> Column:
    return (F.size(words) - (F.element_at(words, 1) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def featured(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature): hashes of each word, its first six characters and last two, and whether a word follows itself, once for each occurrence; none for a null text."""
    # explode_outer, as Spark guards explode by a filter that would split each text once more
    twice = F.coalesce("text", F.lit("")).rlike(r"(?i)(?<!\S)(\S++)\s++\1(?!\S)")
    words = documents.select(*keys, F.explode_outer(F.array_append(_words(), F.when(twice, F.lit(" ")).otherwise(F.lit("")))).alias("word")).where("word <> ''")
    w = F.col("word")
    found = F.array(F.xxhash64(w), F.xxhash64(F.lit(1), F.substring(w, 1, 6)), F.xxhash64(F.lit(2), F.substring(w, -2, 2)))
    return words.select(*keys, F.explode_outer(found).alias("feature"))


def evidence(documents: DataFrame, domains: DataFrame, names: tuple[str, ...] = DOMAINS) -> tuple[np.ndarray, DataFrame]:
    """Log odds of each domain for a text without features; (feature, r_<domain>...), written: of features that tell domains apart what each adds, the log ratio of their documents' shares in a domain and in the first.

    domains: a bounded (doc_id, domain), as written; those of documents that aren't at hand don't count. A domain
    without any has log odds of minus infinity, unless none has. Only sums come to the driver.
    """
    joined = documents.select("doc_id", "text").join(F.broadcast(domains), "doc_id")
    sizes = {r[0]: r[1] for r in joined.groupBy("domain").count().collect()}
    size = np.array([float(sizes.get(x, 0)) for x in names])
    prior = np.log((size + 1) / (size + 1).sum())
    if size.any():
        prior[size == 0] = -np.inf
    # a row with its text's hash is one document of the sample
    rows = featured(joined.withColumn("one", F.xxhash64("doc_id", "text")), "doc_id", "one", "domain").distinct()
    counts = rows.groupBy("feature").agg(*[F.count_if(F.col("domain") == n).cast("double").alias(n) for n in names])
    first, farthest = F.col(names[0]), F.lit(0.0)
    ratios = []
    for n, k in zip(names[1:], size[1:], strict=True):
        expected = (F.col(n) + first) * float(k / max(1.0, k + size[0]))
        off = F.when(expected > 0, F.abs(F.col(n) - expected) / F.sqrt(F.when(expected > 0, expected))).otherwise(0.0)
        there, here = (F.col(n) + 0.5) / float(k + 1), (first + 0.5) / float(size[0] + 1)
        ratio = F.log(there) - F.log(here)
        lacks = F.log1p(-there) - F.log1p(-here)
        tells = (off >= SIGNIFICANT) & (ratio >= TELLING)
        ratios += [F.when(tells, ratio - lacks).otherwise(0.0).alias(f"r_{n}"), F.when(tells, lacks).otherwise(0.0).alias(f"l_{n}")]
        farthest = F.greatest(farthest, F.when(tells, off).otherwise(0.0))
    telling = written(counts.select("feature", *ratios, farthest.alias("off")).where("off > 0").drop("off"), "telling-features")
    lacks = telling.agg(*[F.sum(f"l_{n}").alias(n) for n in names[1:]]).head()
    lacking = np.array([0.0, *(max(-LACKING, float(lacks[n] or 0.0)) for n in names[1:])])
    return prior + lacking, telling.select("feature", *[f"r_{n}" for n in names[1:]])


def posteriors(documents: DataFrame, prior: np.ndarray, telling: DataFrame, names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """doc_id, tokens long (words), u long (hash of doc_id and text), p_<domain> double, of each row; a text without words has the prior."""
    base = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("u"), F.xxhash64("text", F.lit(1)).alias("v"))
    if telling.count() <= MOST_BROADCAST:
        telling = F.broadcast(telling)
    hits = featured(base, "u", "v").join(telling, "feature").dropDuplicates(["u", "v", "feature"])
    said = hits.groupBy("u", "v").agg(*[F.sum(f"r_{n}").alias(f"s_{n}") for n in names[1:]])
    rows = base.select("doc_id", "u", "v", tokens(_words()).alias("tokens")).join(said, ["u", "v"], "left")
    first = prior[np.isfinite(prior)][0]
    odds = []
    for k, name in enumerate(names):
        if not np.isfinite(prior[k]):
            odds.append(F.lit(0.0))
            continue
        one = F.lit(float(prior[k] - first)) + (F.coalesce(f"s_{name}", F.lit(0.0)) if k else F.lit(0.0))
        odds.append(F.exp(F.least(F.greatest(one, F.lit(-SUREST)), F.lit(SUREST))))
    rows = rows.select("doc_id", "u", "tokens", *[o.alias(f"z_{n}") for o, n in zip(odds, names, strict=True)])
    norm = sum((F.col(f"z_{n}") for n in names), F.lit(0.0))
    return rows.select("doc_id", "u", "tokens", *[(F.col(f"z_{n}") / norm).alias(f"p_{n}") for n in names])


def stepped(gradients: list[np.ndarray], names: tuple[str, ...], ceiling: float | None) -> str:
    """SQL of the column rate after a step against each gradient in turn, cut off at 0 and at the ceiling after each."""
    rate = "rate"
    for g in gradients:
        rate = f"greatest(0D, {rate} - ({' + '.join(f'p_{n} * {float(x)!r}D' for n, x in zip(names, g, strict=True))}))"
        if ceiling is not None:
            rate = f"least({float(ceiling)!r}D, {rate})"
    return rate


def fitted(rows: DataFrame, targets: dict[str, float], names: tuple[str, ...] = DOMAINS, ceiling: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """rows with rate double: the nonnegative rates, at most the ceiling, by which each domain's expected tokens come as near to their targets as least squares allow.

    rows: tokens and posteriors, as written; they are read once a round. A domain's miss is
    weighed by one over its tokens, and a document's step is scaled by one over its own, which
    changes the way and not the end where the targets can be met. The first step is one over the
    greatest curvature, by which none overshoots; later ones follow the curvature that the last
    step met (Barzilai and Borwein); one that made the error grow is taken back and tried again
    with a quarter of its length. Rounds end when every domain is met, or when two steps in turn
    hardly gained.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.agg(
        *[F.sum(F.col("tokens") * F.col(f"p_{n}")).alias(n) for n in names],
        *[F.sum(F.col("tokens") * F.col(f"p_{a}") * F.col(f"p_{b}")).alias(f"h_{a}_{b}") for a, b in pairs],
    ).head()
    now = np.array([float(sums[n] or 0.0) for n in names])
    total = now.sum()
    weights = np.array([targets[n] for n in names]) / math.fsum(targets.values())
    base = rows.withColumn("rate", F.lit(1.0 if ceiling is None else min(1.0, float(ceiling))))
    if not total or not weights[0] or not now[0]:
        return base
    goal = weights * now[0] / weights[0]
    scale = np.where(now > 0, 1 / np.maximum(now, 1e-9 * total), 0.0)
    curve = np.array([[float(sums[f"h_{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"]) for b in names] for a in names])
    safe = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * curve * np.sqrt(scale)[None, :]).max()
    steps: list[np.ndarray] = []
    length, best, before, idle = safe, None, None, 0
    for _ in range(rounds):
        moved = F.expr(f"({stepped(steps, names, ceiling)}) - ({stepped(steps[:-1], names, ceiling)})") if steps else F.lit(0.0)
        rate = F.expr(stepped(steps, names, ceiling))
        got = base.agg(*[F.sum(F.col("tokens") * F.col(f"p_{n}") * rate).alias(n) for n in names], F.sum(F.col("tokens") * moved * moved).alias("moved")).head()
        have = np.array([float(got[n]) for n in names])
        off = have - goal
        error = float((scale * off * off).sum() / total)
        gain = math.inf if best is None else best[0] - error
        idle = idle + 1 if gain < GAINING * error else 0
        if gain > 0:
            best = error, base, list(steps), off
            if np.abs(off).max() < tolerance * total or idle > 1:
                break
            bent = float((scale * (have - before) ** 2).sum()) if before is not None else 0.0
            length = float(got["moved"]) / bent if bent > 0 and got["moved"] > 0 else safe
            before = have
        elif length <= safe or idle > 1 and -gain < GAINING * error:
            break
        else:  # too far
            _, base, steps, off = best[0], best[1], list(best[2]), best[3]
            before, length = off + goal, length / 4
        if len(steps) >= WRITTEN_AFTER:
            base, steps = written(base.withColumn("rate", F.expr(stepped(steps, names, ceiling))), "rates"), []
        steps.append(max(length, safe) * scale * off)
    return best[1].withColumn("rate", F.expr(stepped(best[2], names, ceiling)))


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, names: tuple[str, ...] = DOMAINS, ceiling: float | None = None) -> DataFrame:
    """doc_id, row_hash long (of doc_id and text), tokens long, p_<domain> double, rate double, copies int of each row of documents.

    Rates stay at or above 0 and, if there is one, at or below the ceiling. copies is the rate, rounded up or down by the hash of doc_id and text so that its mean is the
    rate. A null or empty text has no tokens and the prior as its posterior. Repeated rows fare
    alike. Labels of documents that aren't at hand don't count: a domain without labelled documents
    has posteriors of 0; without any, all posteriors are equal. A domain with a target but no tokens can't be
    met, and the others come as near as least squares allow.
    """
    prior, telling = evidence(documents, written(labelled_domains(labels), "labelled-domains"), names)
    rows = written(posteriors(documents, prior, telling, names), "posteriors")
    chance = F.pmod(F.col("u"), F.lit(1 << 40)) / float(1 << 40)
    out = fitted(rows, targets, names, ceiling)
    return out.select("doc_id", F.col("u").alias("row_hash"), "tokens", *[f"p_{n}" for n in names], "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"))
