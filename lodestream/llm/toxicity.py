"""Toxicity by weak supervision.

1. Terms: words and beginnings of words, once or twice in a text, whose log odds between toxic and other rows of a bounded
   sample of labelled training rows stay above `LEAST_ODDS` by `SURE` standard errors. All of them are used. Terms of one
   stem (one begins the other) are a family; families of about equal evidence share one of `TERM_VOTERS` voters.
2. Voters: those, voters for a fixed lexicon (plain insults of English, of other languages, words that are insults only
   sometimes) and for patterns (two different words, one word twice, a word next to "you", at an edge, exclaimed; shouting),
   and one that votes for harmless texts. The votes of all documents are counted by vote mask: a histogram of at most
   2 ** VOTERS masks, however many documents there are.
3. A two-class generative model of that histogram. Within a class the votes form a tree: each voter depends on one other,
   and the tree is the one whose edges carry most of the votes' mutual information within the classes, so a voter that
   says what another says adds little. Expectation maximisation gives accuracies, correlations and the tables of the tree;
   labelled training rows hold their class. A mask's posterior is the tree's.
4. A logistic regression over words of the lexicon, terms and the voters themselves is trained on the posteriors (not on
   labels) of the labelled training rows and of about `UNLABELLED` other rows, and scores every document.

`SURE`, `LEAST_ODDS`, `L2` and `REST` were chosen by five folds of the training rows of the driver's sf0.1 (least log loss
of rows outside the fold: 332 of 352 toxic rows caught, 9 of 2803 others rejected), without a look at held-out rows.

Only rows with crc32(doc_id as text) mod 5 other than 0 give labels; labels, lang, source and doc_id are no inputs of a
score. Null and empty texts get the score of a text without any term. Rows with a null doc_id are never labelled and
count as not held out; repeated rows get equal scores; ids with contradictory labels are left out. Texts of any length are
read whole; a worker holds one of them, or about `BATCH` bytes, several times over. Without any label the lexicon's voters
alone shape the model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm._shared import gathered, scratch, small_batches, trim, written

#: Bounds of the sample: labelled rows, and about so many others.
LABELLED, UNLABELLED = 20_000, 20_000
#: Bytes of text that a worker cuts into words at once.
BATCH = 8 << 20
TERM_VOTERS = 6
STRONG, FOREIGN, MILD, TWO, TWICE, NEAR_YOU, EDGE, EXCLAIMED, SHOUTED, NONE = range(TERM_VOTERS, TERM_VOTERS + 10)
VOTERS = NONE + 1
#: Voters of plain insults are taken to be right in so many of their votes before any document is seen.
TRUSTED, TRUST = (STRONG, FOREIGN), 0.9
#: A term's log odds must exceed LEAST_ODDS by SURE standard errors.
SURE, LEAST_ODDS = 1.5, 1.5
#: Step of a term's evidence between one term voter and the next.
STEP = 0.5
#: Weight of all unlabelled documents in the label model, as a multiple of that of the labelled rows, at any size.
REST = 1.0
#: Pull of the classifier's weights towards 0, in rows.
L2 = 10.0
#: Share of toxic documents before any label is seen.
PRIOR = 0.05

#: Common insults, as any public word list has them.
ENGLISH = frozenset(
    "asshole bastard bitch coward cretin degenerate dimwit disgusting douchebag dumbass idiot idiotic imbecile jackass jerk loser lowlife moron moronic pathetic psycho retard scum "
    "shit shitty slut stupid vermin whore worthless wretched clown".split()
)
OTHER_LANGUAGES = frozenset(
    "abschaum arschloch blödmann depp dummkopf ekelhaft erbärmlich idioten nutzlos schwachkopf trottel abruti bouffon connard crétin débile dégoûtant imbécile merde minable ordure "
    "pathétique salaud cabrón escoria estúpido gilipollas idiota imbécil mierda patético asqueroso".split()
)
#: Insults only sometimes.
SOMETIMES = frozenset(
    "crap damn dumb fool freak garbage hate kill nazi nonsense pig puke rat sleazy suck sucks terrible trash ugly useless vile dreckig dumm hässlich mist verlierer inutile laid "
    "stupide basura cerdo inútil payaso perdedor tonto".split()
)
LEXICON = ENGLISH | OTHER_LANGUAGES | SOMETIMES
YOU = frozenset("you your youre du dich dein deine ihr tu toi ton vous votre tú te eres ustedes".split())


@dataclass
class LabelModel:
    """Votes within a class: `rate` by class and voter, `parent` of each voter, and the tables [class, voter, parent's vote]."""

    share: float
    rate: np.ndarray
    parent: np.ndarray
    table: np.ndarray
    accuracies: np.ndarray
    correlations: np.ndarray

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return _sigmoid(_log_odds(_bits(masks, len(self.parent)), self.share, self.parent, self.table))


@dataclass
class Model:
    voters: list[list[str]] = field(default_factory=lambda: [[] for _ in range(TERM_VOTERS)])
    weights: dict[str, float] = field(default_factory=dict)  # of words, beginnings and (as ``#i``) voters
    bias: float = math.log(PRIOR / (1 - PRIOR))
    labels: LabelModel | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n) & 1).astype(float)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Words:
    """Texts of a batch as lower-case runs of letters: `codes` of all words index `values`; `starts` by text."""

    def __init__(self, texts: pa.ChunkedArray):
        flat = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()).combine_chunks())
        lists = pc.split_pattern_regex(flat, r"[^\pL]+")
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.starts = offsets - offsets[0]
        self.codes = coded.indices.to_numpy()
        self.values = coded.dictionary.to_pylist()

    def present(self, table: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts and entries of `table`, each pair once. A key is a word, or its beginning and ``*``; one with ``+`` behind counts from the second occurrence on."""
        bases = list(dict.fromkeys(k.removesuffix("+") for k in table))
        index = {k: i for i, k in enumerate(bases)}
        lists = [[index[f] for f in forms(v) if f in index] for v in self.values]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = np.cumsum(sizes)
        flat = np.array([i for own in lists for i in own], np.int64)
        each = sizes[self.codes] if len(self.codes) else np.zeros(0, np.int64)
        at = np.flatnonzero(each)
        n = each[at]
        code = self.codes[at]
        base = flat[np.repeat(ends[code] - n, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        text = np.repeat(np.searchsorted(self.starts, at, "right") - 1, n)
        pairs, times = np.unique(text * max(1, len(bases)) + base, return_counts=True)
        text, base = pairs // max(1, len(bases)), pairs % max(1, len(bases))
        entry = [np.array([table.get(k + more, -1) for k in bases], np.int64) for more in ("", "+")]
        found = [(text[keep], e[base[keep]]) for e, least in zip(entry, (1, 2), strict=True) if len(bases) for keep in [(e[base] >= 0) & (times >= least)]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def within(self, words: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of these words, and their texts."""
        at = np.flatnonzero(np.isin(self.codes, [i for i, v in enumerate(self.values) if v in words]))
        return at, np.searchsorted(self.starts, at, "right") - 1


def forms(word: str) -> list[str]:
    """A word and its beginnings, which stand for the inflections and compounds of a stem."""
    return [word, *[word[:k] + "*" for k in range(4, min(9, len(word) + 1))]] if word else []


def _sampled_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most LABELLED training rows, chosen by a hash; ids with contradictory labels are left out."""
    own = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_m")).where("toxic = _m")
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, rows with it that are toxic, and that are not) of the rows (text, _toxic) of one task; term "\\n" counts rows."""
    for table in gathered(batches, "text", BATCH):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        words = Words(table["text"])
        own = [forms(v) for v in words.values]
        for y, a, b in zip(table["_toxic"].to_pylist(), words.starts[:-1], words.starts[1:], strict=True):
            seen: Counter = Counter()
            for c, n in zip(*(x.tolist() for x in np.unique(words.codes[a:b], return_counts=True)), strict=True):
                for f in own[c]:
                    seen[f] += n
            counts[1 if y else 0].update([*seen, *(f + "+" for f, n in seen.items() if n > 1)])
            counts[1 if y else 0]["\n"] += 1
        rows = [(w, counts[1][w], counts[0][w]) for w in {*counts[0], *counts[1]} if w]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["term", "pos", "neg"])
        del counts, words, own, rows
        trim()


def log_odds(pos, neg, n_pos: int, n_neg: int, log, sqrt):
    """A term's log odds between the classes and their standard error, for numbers or columns."""
    odds = log((pos + 0.5) / (n_pos + 1)) - log((neg + 0.5) / (n_neg + 1))
    return odds, sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def induce(sample: DataFrame, most: int | None = None) -> tuple[dict[str, float], float]:
    """Terms of the labelled sample with their evidence, surest first, and the share of toxic rows. most: keep so many; by default all."""
    counts = sample.mapInArrow(term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = written(counts, scratch(sample.sparkSession, "terms"))
    total = counts.where("term = '\n'").collect()
    n_pos, n_neg = (total[0].pos, total[0].neg) if total else (0, 0)
    if not n_pos or not n_neg:
        return {}, PRIOR
    odds, error = log_odds(F.col("pos"), F.col("neg"), n_pos, n_neg, F.log, F.sqrt)
    sure = counts.where(F.length("term") > 1).where(F.col("term") != "\n").withColumn("least", odds - SURE * error).where(F.col("least") > LEAST_ODDS)
    best = sure.orderBy(F.desc("least"), "term")
    rows = (best if most is None else best.limit(most)).collect()  # terms that several of the LABELLED rows share
    return {r.term: r.least for r in rows}, n_pos / (n_pos + n_neg)


def families(terms: dict[str, float]) -> list[list[str]]:
    """The terms of each voter: terms of which one begins another are a family, and families of about equal evidence share a voter."""
    stems: dict[str, str] = {}
    stem = "\n"
    for base, t in sorted((t.rstrip("*+"), t) for t in terms):
        stem = stem if base.startswith(stem) else base
        stems[t] = stem
    best: dict[str, float] = {}
    for t, stem in stems.items():
        best[stem] = max(best.get(stem, LEAST_ODDS), terms[t])
    out: list[list[str]] = [[] for _ in range(TERM_VOTERS)]
    for t, stem in stems.items():
        out[min(TERM_VOTERS - 1, int((best[stem] - LEAST_ODDS) / STEP))].append(t)
    return out


def votes(table: pa.Table, voters: list[list[str]]) -> tuple[np.ndarray, Words]:
    """A mask of the voters that speak for each text."""
    words = Words(table["text"])
    n = len(words.starts) - 1
    mask = np.zeros(n, np.int64)
    of_voter = {t: i for i, own in enumerate(voters) for t in own}
    index = {t: i for i, t in enumerate(of_voter)}
    text, entry = words.present(index)
    voter = np.array(list(of_voter.values()), np.int64)[entry] if len(index) else entry
    for i in range(TERM_VOTERS):
        mask[text[voter == i]] |= 1 << i
    for bit, own in ((STRONG, ENGLISH), (FOREIGN, OTHER_LANGUAGES), (MILD, SOMETIMES)):
        mask[words.within(own)[1]] |= 1 << bit
    # Patterns look at words of the lexicon and at whole words among the terms.
    telling = LEXICON | {t for t in index if t[-1] not in "*+"}
    at, of = words.within(frozenset(telling))
    kinds, times = np.unique(of * (len(words.values) + 1) + words.codes[at], return_counts=True)
    mask[np.flatnonzero(np.bincount(kinds // (len(words.values) + 1), minlength=n) >= 2)] |= 1 << TWO
    mask[(kinds // (len(words.values) + 1))[times >= 2]] |= 1 << TWICE
    you, its = words.within(YOU)
    if len(you) and len(at):
        right = np.searchsorted(you, at)
        for near in (np.minimum(right, len(you) - 1), np.maximum(right - 1, 0)):
            mask[of[(its[near] == of) & (np.abs(you[near] - at) <= 3)]] |= 1 << NEAR_YOU
    sizes = np.diff(words.starts)
    edge = (at - words.starts[of]) * 10
    mask[of[(edge < sizes[of]) | (edge >= 9 * sizes[of])]] |= 1 << EDGE
    flat = pc.fill_null(table["text"], "")
    size = pc.utf8_length(flat).to_numpy()
    mask[pc.count_substring_regex(flat, r"\p{Lu}").to_numpy() * 2 > np.maximum(size, 20)] |= 1 << SHOUTED
    mask[pc.count_substring(flat, "!").to_numpy() * 50 > np.maximum(size, 50)] |= 1 << EXCLAIMED
    mask[mask & ((1 << MILD + 1) - 1) == 0] |= 1 << NONE
    return mask, words


def _log_odds(x: np.ndarray, share: float, parent: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log odds of class 1 for rows of votes `x` under the tree."""
    total = np.full(len(x), math.log(share / (1 - share)))
    for j, p in enumerate(parent.tolist()):
        given = np.zeros(len(x), int) if p < 0 else x[:, p].astype(int)
        one, zero = table[1, j][given], table[0, j][given]
        total += np.where(x[:, j] > 0, np.log(one / zero), np.log((1 - one) / (1 - zero)))
    return total


def _pairs(x: np.ndarray, w: np.ndarray, toxic: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, votes of each voter, and common votes of each two, all smoothed by half a vote; TRUSTED voters by less in class 0."""
    first = np.full(x.shape[1], 0.5)
    if not toxic and x.shape[1] > max(TRUSTED):
        first[list(TRUSTED)] = 0.5 * (1 - TRUST) / TRUST
    n, one, both = w.sum() + 1, w @ x + first, (x * w[:, None]).T @ x + np.outer(first, first)
    both[np.diag_indices(len(one))] = one
    return n, one, both


def dependence(x: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(mutual information of each two voters within the classes, their correlation within the classes)."""
    stats = [_pairs(x, w, c == 1) for c, w in enumerate(weights)]
    whole = sum(s[0] for s in stats)
    information = np.zeros((x.shape[1],) * 2)
    covariance = np.zeros_like(information)
    for n, one, both in stats:
        a, b = one[:, None] / n, one[None, :] / n
        p11 = both / n
        for joint, left, right in ((p11, a, b), (a - p11, a, 1 - b), (b - p11, 1 - a, b), (1 - a - b + p11, 1 - a, 1 - b)):
            joint = np.maximum(joint, 1e-12)
            information += n / whole * joint * np.log(joint / (left * right))
        covariance += n / whole * (p11 - a * b)
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    return information, covariance / np.outer(spread, spread)


def spanning(information: np.ndarray) -> np.ndarray:
    """Parents of the maximum spanning tree, from voter 0 on; the first of equal edges."""
    n = len(information)
    parent, best = np.full(n, -1), np.full(n, -np.inf)
    outside = np.ones(n, bool)
    at = 0
    for _ in range(n):
        outside[at] = False
        nearer = outside & (information[at] > best)
        parent[nearer], best[nearer] = at, information[at][nearer]
        if not outside.any():
            break
        at = int(np.flatnonzero(outside)[best[outside].argmax()])
    return parent


def _tables(x: np.ndarray, weights: tuple[np.ndarray, np.ndarray], parent: np.ndarray) -> np.ndarray:
    """Probability of a vote by class, voter and the parent's vote."""
    out = np.empty((2, len(parent), 2))
    for c, w in enumerate(weights):
        n, one, both = _pairs(x, w, c == 1)
        for j, p in enumerate(parent.tolist()):
            base = one[j] / n
            out[c, j] = base if p < 0 else ((one[j] - both[j, p] + base) / (n - one[p] + 1), (both[j, p] + base) / (one[p] + 1))
    return np.clip(out, 1e-6, 1 - 1e-6)


def fit_labels(masks: np.ndarray, known: np.ndarray, counts: np.ndarray, prior: float = PRIOR, rounds: int = 30, voters: int = VOTERS, first: np.ndarray | None = None) -> LabelModel:
    """The generative model of `counts` documents of each (mask, known); known: 0 or 1 for labelled rows, -1 elsewhere.

    First without edges, then with the tree. first: the posterior to begin with; by default words of the lexicon or of
    terms make a text rather toxic.
    """
    x = _bits(masks, voters)
    gold = counts[known >= 0].sum()
    counts = np.where(known >= 0, counts, counts * min(1.0, REST * gold / max(1e-9, counts.sum() - gold))) if gold else counts
    if first is None:
        first = np.where(masks & ((1 << FOREIGN + 1) - 1) != 0, 0.8, 0.03)
    p = np.where(known >= 0, known, first).astype(float)
    parent = np.full(voters, -1)
    for k in range(2 * rounds):
        weights = counts * (1 - p), counts * p
        if k == rounds:
            parent = spanning(dependence(x, weights)[0])
        table = _tables(x, weights, parent)
        share = float(np.clip((counts @ p + prior) / (counts.sum() + 1), 1e-4, 0.9))
        p = np.where(known >= 0, known, _sigmoid(_log_odds(x, share, parent, table)))
    weights = counts * (1 - p), counts * p
    rate = np.stack([(w @ x + 0.5) / (w.sum() + 1) for w in weights])
    accuracy = (weights[1] @ x) / np.maximum(counts @ x, 1e-9)
    return LabelModel(share, rate, parent, table, accuracy, dependence(x, weights)[1])


def fit_classifier(features: list[list[int]], target: np.ndarray, n: int, bias: float, l2: float = L2, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels over sparse presence features, by gradient descent with momentum and a scale for each weight."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.array([i for f in features for i in f], np.int64)
    size = max(1, len(target))
    w, first, second = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(1, rounds + 1):
        error = _sigmoid(np.bincount(rows, w[cols], minlength=size)[:size] + bias)[: len(target)] - target
        grad = (np.bincount(cols, error[rows], minlength=n) + l2 * w) / size
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w = w - 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return w


def feature_index(terms: Iterable[str]) -> dict[str, int]:
    """Places of words, beginnings and voters (``#i``) among the classifier's features."""
    return {t: i for i, t in enumerate(dict.fromkeys([*[f"#{i}" for i in range(VOTERS)], *sorted(LEXICON), *terms]))}


def feature_pairs(mask: np.ndarray, words: Words, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of a batch, each pair once, by text."""
    text, entry = words.present({t: i for t, i in index.items() if t[0] != "#"})
    bit = np.array([index[f"#{i}"] for i in range(VOTERS)])
    row, col = np.nonzero(mask[:, None] >> np.arange(VOTERS) & 1)
    pairs = np.unique(np.append(text * len(index) + entry, row * len(index) + bit[col]))
    return pairs // len(index), pairs % len(index)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the whole model on `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = F.broadcast(written(_sampled_labels(labels), scratch(spark, "labels")))  # LABELLED rows at most
    terms, prior = induce(own.join(known, own.doc_id == known._id).select("text", "_toxic"))
    voters = families(terms)
    index = feature_index(terms)
    share = min(1.0, UNLABELLED / max(1, own.count()))
    picked_too = F.coalesce(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), F.lit(False))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for table in gathered(batches, "text", BATCH):
            mask, words = votes(table, voters)
            y = np.array([-1 if v is None else v for v in table["_toxic"].to_pylist()], np.int64)
            seen.update(zip(mask.tolist(), y.tolist(), strict=True))
            if (picked := np.flatnonzero((y >= 0) | table["_picked"].to_numpy())).size:
                of, feature = feature_pairs(mask, words, index)
                ends = np.searchsorted(of, picked), np.searchsorted(of, picked + 1)
                yield row([(int(mask[i]), int(y[i]), 1, feature[a:b].tolist()) for i, a, b in zip(picked, *ends, strict=True)])
            del table, words
            trim()
        if seen:
            yield row([(m, y, n, None) for (m, y), n in seen.items()])

    def row(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["mask", "y", "n", "features"])

    counted = own.join(known, own.doc_id == known._id, "left").select("text", "_toxic", picked_too.alias("_picked")).mapInArrow(count, "mask long, y long, n long, features array<long>")
    counted = written(counted, scratch(spark, "votes"))
    histogram = counted.where("features is null").groupBy("mask", "y").agg(F.sum("n").alias("n")).collect()  # 3 x 2 ** VOTERS rows at most
    sample = counted.where("features is not null").collect()  # LABELLED rows, and about UNLABELLED
    if not histogram or not sample:
        return Model(voters)
    # In one order whatever tasks came first, so that sums and weights are the same in every run.
    return fitted(voters, index, prior, sorted(tuple(r) for r in histogram), sorted(tuple(r) for r in sample))


def fitted(voters: list[list[str]], index: dict[str, int], prior: float, histogram: list[tuple], sample: list[tuple]) -> Model:
    """The model of a histogram (mask, y, n) and of sampled rows (mask, y, 1, features)."""
    masks, y, n = (np.array([r[i] for r in histogram], np.int64) for i in range(3))
    labels = fit_labels(masks, y, n.astype(float), prior)
    # Plain insults that no sampled row has are learned from texts of the word alone, and of it and the next.
    plain = [*sorted(ENGLISH), *sorted(OTHER_LANGUAGES)]
    around = " q" * 20
    alone = pa.table({"text": pa.array([f"{around} {own} {around}" for own in (*plain, *map(" ".join, zip(plain, plain[1:] + plain[:1], strict=True)))])})
    mask, words = votes(alone, voters)
    of, feature = feature_pairs(mask, words, index)
    target = labels.posterior(np.append(np.array([r[0] for r in sample], np.int64), mask))
    bias = math.log(labels.share / (1 - labels.share))
    weights = fit_classifier([*(r[3] for r in sample), *(feature[of == i].tolist() for i in range(len(mask)))], target, len(index), bias)
    return Model(voters, {t: float(w) for t, w in zip(index, weights, strict=True)}, bias, labels)


def score(docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """`docs` with a column `name` from 0 to 1 beside its own; one of that name in the input is replaced."""
    docs = docs.drop(name)
    small_batches(docs.sparkSession)
    voters, bias = model.voters, model.bias
    index = {t: i for i, t in enumerate(model.weights)} or feature_index([])
    weights = np.array(list(model.weights.values())) if model.weights else np.zeros(len(index))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text", BATCH):
            mask, words = votes(table, voters)
            of, feature = feature_pairs(mask, words, index)
            total = bias + np.bincount(of, weights[feature], minlength=table.num_rows)
            out = table.append_column(name, pa.array(_sigmoid(total), pa.float64()))
            del words, table
            yield from out.to_batches()
            del out
            trim()

    return docs.mapInArrow(work, docs.withColumn(name, F.lit(0.0)).schema)


def rejected_removed(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below `threshold`, with their own columns."""
    name = "toxic_score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name).where(F.col(name) < threshold).select(docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
