"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier of text features, trained here on labelled documents, gives each document
a probability of being good: of good quality and, where the labels say so, not toxic. Words, and
word beginnings of six bytes, that the labelled toxic documents have and others don't are learned
with it, on one half of the sample for the features of the other. The probabilities are summed by host
and path; between-host and between-path variances give the strength of the priors (method of moments), so
that a sparse path shrinks to its host and a sparse host to the global mean. A document's own
evidence is taken out of its site's sums, and the posterior of its path replaces the training prior in its odds.

Every text is scored once; what follows reads the scores. Sites are small tables that grow with the number of
hosts and paths, not with documents; they are broadcast below a checked size, and beyond it hot sites are
salted. Hot hosts are summed before they are shuffled.

Null or empty text has features of zero. Null hosts and paths are sites of their own. Rows that
repeat are scored each. Labels of a doc_id are averaged, half counts as good; null labels and
labels without a document are ignored; a null toxic label is none. With labels of one kind only, or none, every document gets
the labels' share (1 without labels) and stays. No rows in, no rows out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import cut, free_name, stored, text_bytes, tune

#: Labelled documents learned from: those with the smallest hashes.
TRAIN_DOCS = 20_000
THRESHOLD = 0.5
#: Bounds of a prior's strength, in documents.
STRENGTH = (1.0, 1e6)
#: Sites up to which their table is broadcast (about 100 bytes each), and pieces of a site beyond.
BROADCAST_SITES, SALT = 200_000, 32
#: Words learned: at most so many, of at least so many distinct toxic texts, and so much oftener there.
LEXICON, LEXICON_TEXTS, LEXICON_RATIO, BEGINNING = 2_000, 5, 50.0, 6

_KINDS = [rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"\n", rb"[ \t\r\x0b\x0c]", rb"[.,;:?'\"()-]", rb"[!-/:-@\[-`{-~]", rb"[\x80-\xff]"]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _k in range(len(_KINDS) - 1, -1, -1):
    _KIND[[b for b in range(256) if re.match(_KINDS[_k], bytes([b]), re.S)]] = _k
FEATURES = len(_KINDS) + 11


def tokens_of(text: bytes) -> set[bytes]:
    """What a lexicon is made of: the words of a text without marks around them, and their beginnings."""
    found = {w.strip(b".,;:?!'\"()") for w in {*text.lower().split()}}
    return found | {w[:BEGINNING] for w in found}


def features_of(texts: list[bytes], lexicon: frozenset[bytes] = frozenset()) -> np.ndarray:
    """Rates of kinds of bytes, how words and lines repeat, words of the lexicon; a row for each text."""
    out = np.zeros((len(texts), FEATURES))
    kinds = len(_KINDS)
    for k, text in enumerate(texts):
        if not text:
            continue
        counts = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=kinds + 1)[:kinds]
        out[k, :kinds] = counts / len(text)
        words = text.split()
        n = max(1, len(words))
        lines = text.split(b"\n")
        half = words[: len(words) // 2]
        out[k, kinds:] = (
            np.log1p(len(words)) / 10,
            min(30, len(text) / n) / 30,
            np.log1p(len(set(words))) / np.log1p(n),
            sum(map(eq, words, words[1:])) / n,
            len({*lines}) / len(lines),
            len({*half} & {*words[len(words) // 2 :]}) / max(1, len({*half})),
            min(1.0, (text.count(b".") + text.count(b"?") + text.count(b"!")) / n),
            float(text.count(b" | ") / n),
            1.0,
            hits := min(1.0, len(tokens_of(text) & lexicon) / 2) if lexicon else 0.0,
            float(hits > 0),
        )
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant
    prior: float  # of good documents among the labelled ones
    lexicon: frozenset[bytes] = frozenset()

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = _terms((x - self.mean) / self.scale)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -20, 20)


def _terms(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Classifier:
    """Ridge logistic regression by Newton steps."""
    prior = float(good.mean()) if len(good) else 1.0
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(FEATURES)
    weights = np.zeros(2 * FEATURES + 1)
    if prior in (0.0, 1.0):
        weights[-1] = 20.0 if prior else -20.0
        return Classifier(mean, scale, weights, prior)
    z = np.concatenate([_terms((x - mean) / scale), np.ones((len(x), 1))], axis=1)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (p - good) + penalty * weights
        bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, weights, prior)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Classifier:
    """Learn from the labelled documents whose doc_id has the smallest hashes."""
    docs, order = docs.select("doc_id", "text"), F.xxhash64(F.lit("quality"), "doc_id")
    toxic = F.coalesce(F.avg("toxic"), F.lit(0.0)) >= 0.5 if "toxic" in labels.columns else F.lit(False)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("fine"), toxic.alias("toxic"))
    known = known.join(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    some = known.select("doc_id", (F.col("fine") & ~F.col("toxic")).alias("good"), "toxic", order.alias("h")).orderBy("h", "doc_id").limit(most)
    # At most `most` labelled documents: they are read twice, for words and for features.
    rows = stored(docs.join(F.broadcast(some), "doc_id").select("h", "good", "toxic", (F.xxhash64("text") % 2 == 0).alias("fold"), text_bytes().alias("text")))
    halves = lexicons(rows)

    def work(batches):
        for batch in batches:
            folds = batch.column(2).to_pylist()
            x = np.zeros((batch.num_rows, FEATURES))
            for fold in (True, False):  # a text's features have the words of the other half
                at = [k for k, f in enumerate(folds) if f == fold]
                x[at] = features_of([batch.column(3)[k].as_py() or b"" for k in at], halves[not fold])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["h", "good", "x"])

    found = rows.select("h", "good", F.coalesce("fold", F.lit(True)).alias("fold"), "text").mapInArrow(work, "h long, good boolean, x array<double>").orderBy("h", "x").limit(most).select("good", "x").collect()
    model = fit(np.array([r.x for r in found]).reshape(-1, FEATURES), np.array([r.good for r in found], float))
    model.lexicon = halves[None]
    return model


def lexicons(rows: DataFrame) -> dict[bool | None, frozenset[bytes]]:
    """The words that tell toxic texts in each fold, and in both (None). rows: toxic, fold, text;
    equal texts count once."""

    def work(batches):
        for batch in batches:
            for toxic, fold, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = pa.array(sorted(tokens_of(text or b"")), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(words)), pa.array([bool(fold)] * len(words)), words], ["toxic", "fold", "word"])

    if not rows.where("toxic").limit(1).count():
        return {True: frozenset(), False: frozenset(), None: frozenset()}
    texts = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.max("toxic").alias("toxic"), F.first("fold").alias("fold"), F.first("text").alias("text")).select("toxic", "fold", "text")
    kinds = {(r.toxic, r.fold): r.n for r in texts.groupBy("toxic", F.coalesce("fold", F.lit(True)).alias("fold")).agg(F.count("*").alias("n")).collect()}
    counts = cut(texts.mapInArrow(work, "toxic boolean, fold boolean, word binary").groupBy("word").agg(*(F.count_if((F.col("toxic") == t) & (F.col("fold") == f)).alias(f"n_{t}_{f}") for t in (True, False) for f in (True, False))))
    out = {}
    for part in (True, False, None):
        folds = (True, False) if part is None else (part,)
        bad, other = (sum((F.col(f"n_{t}_{f}") for f in folds), F.lit(0)) for t in (True, False))
        size, rest = (1 + sum(kinds.get((t, f), 0) for f in folds) for t in (True, False))
        often = (bad >= LEXICON_TEXTS) & (bad * F.lit(float(rest)) > F.lit(LEXICON_RATIO * size) * (other + 0.5)) & (F.octet_length("word") > 0)
        out[part] = frozenset(bytes(r.word) for r in counts.where(often).orderBy(bad.desc(), "word").limit(LEXICON).select("word").collect())
    return out


def scorer(docs: DataFrame, model: Classifier):
    """A function from a column of text bytes to log odds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.log_odds(features_of([t or b"" for t in texts.to_pylist()], shared.value.lexicon)))

    return score.asNondeterministic()  # so that it runs once for a row


def _strength(mean, between) -> float:
    """Of a beta prior whose mean and variance are given."""
    if not mean or between is None or not 0 < mean < 1:
        return STRENGTH[1]
    return float(np.clip(mean * (1 - mean) / max(between, 1e-12) - 1, *STRENGTH))


def site_table(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums of every path and its host (host, path, n, s, host_n, host_s), and the priors.

    scored: host, path, p. The sampling variance of a mean, p(1-p)/n, is taken off the observed
    variance of the means.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    table = cut(paths.alias("p").join(hosts.alias("h"), F.expr("p.host <=> h.host")).select("p.host", "p.path", "n", "s", "q", "host_n", "host_s", "host_q"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = whole.s / whole.n if whole.n else 1.0

    def spread(rows: DataFrame, n: str, s: str, q: str, around: Column) -> float | None:
        own = F.col(s) / F.col(n)
        noise = (F.col(q) / F.col(n) - own * own) / F.greatest(F.col(n) - 1, F.lit(1))
        return rows.where(F.col(n) > 1).agg((F.sum(F.col(n) * (F.pow(own - around, 2) - noise)) / F.sum(n)).alias("v")).first().v

    priors = {"mean": mean}
    priors["host"] = _strength(mean, spread(hosts, "host_n", "host_s", "host_q", F.lit(mean)))
    priors["path"] = _strength(mean, spread(table.where("host_n > n"), "n", "s", "q", F.col("host_s") / F.col("host_n")))
    return table.select("host", "path", "n", "s", "host_n", "host_s"), priors


def assess(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns named in the returned dict: host, path, p (of the text alone),
    host_posterior, path_posterior, quality, kept. Scored rows are written to the shared folder,
    without their text if it isn't to be kept."""
    tune(docs.sparkSession, 500)
    model = train(docs, labels)
    score = scorer(docs, model)
    names = {c: free_name(docs, c) for c in ("host", "path", "odds", "p", "host_posterior", "path_posterior", "quality", "kept")}
    at_host, at_path, salt = (free_name(docs, c) for c in ("host_mean", "path_mean", "salt"))
    odds = names["odds"]
    scored = docs.withColumn(odds, score(text_bytes())).withColumn(names["host"], host).withColumn(names["path"], path)
    columns = [c for c in docs.columns if keep_text or c != "text"]
    scored = stored(scored.select(*(F.col(f"`{c}`") for c in (*columns, odds, names["host"], names["path"]))))
    p = 1 / (1 + F.exp(-F.col(odds)))
    table, priors = site_table(scored.select(F.col(names["host"]).alias("host"), F.col(names["path"]).alias("path"), p.alias("p")))
    d, on = scored.withColumn(names["p"], p), f"d.`{names['host']}` <=> t.host AND d.`{names['path']}` <=> t.path"
    if table.count() <= BROADCAST_SITES:
        t = F.broadcast(table)
    else:  # rows of a hot site are dealt over SALT tasks
        d, t = d.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in columns)), F.lit(SALT))), table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on = f"{on} AND d.`{salt}` = t.salt"
    d = d.alias("d")
    own = F.col(f"d.`{names['p']}`")
    host_mean = (priors["host"] * priors["mean"] + F.col("t.host_s") - own) / (priors["host"] + F.col("t.host_n") - 1)
    path_mean = (priors["path"] * F.col(at_host) + F.col("t.s") - own) / (priors["path"] + F.col("t.n") - 1)
    joined = (
        d.join(t.alias("t"), F.expr(on))
        .withColumn(at_host, F.least(F.greatest(host_mean, F.lit(1e-6)), F.lit(1 - 1e-6)))
        .withColumn(at_path, F.least(F.greatest(path_mean, F.lit(1e-6)), F.lit(1 - 1e-6)))
    )
    base = float(np.clip(model.prior, 1e-6, 1 - 1e-6))
    posterior = F.col(f"d.`{odds}`") - float(np.log(base / (1 - base))) + F.log(F.col(at_path) / (1 - F.col(at_path)))
    quality = 1 / (1 + F.exp(-posterior))
    if model.prior in (0.0, 1.0):
        quality = F.lit(model.prior)
    keep = F.lit(True) if model.prior in (0.0, 1.0) else quality >= threshold
    out = [F.col(f"d.`{c}`") for c in columns] + [F.col(f"d.`{names[c]}`") for c in ("host", "path", "p")]
    return joined.select(*out, F.col(at_host).alias(names["host_posterior"]), F.col(at_path).alias(names["path_posterior"]), quality.alias(names["quality"]), keep.alias(names["kept"])), names


def document_site() -> tuple[Column, Column]:
    """Host and path of documents: the source, and its part in one language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def url_site(url: str = "url") -> tuple[Column, Column]:
    """Host of a URL, and the host with the first step of the path."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    step = F.regexp_extract(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), "^/([^/]*)", 1)
    return host, F.concat_ws("/", host, step)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found, names = assess(docs.select("doc_id", "text", "source", "lang"), labels, *document_site(), keep_text=False)
    return found.select("doc_id", *(F.col(names[c]).alias(c) for c in ("host", "path", "p", "host_posterior", "path_posterior", "quality", "kept")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found, names = assess(docs, labels, *document_site())
    return found.where(F.col(names["kept"])).select(*docs.columns)
