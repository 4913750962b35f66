"""Language identification by segmentation-marginalised unigrams.

Every language has its own probabilities over one fixed public vocabulary of
pieces.  A word's probability is the sum over all its segmentations into
pieces, computed by a forward recursion; a text's is the product over its
words.  Probabilities are fitted by expectation-maximisation with the matching
forward-backward recursion.

Both recursions run over all words of one length at once: the pieces that
match are found by hashes of the substrings, and one step advances every word
by one character.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.token_counts import worker_state

WORDS = re.compile(r"[^\W\d_]+")
START = "▁"


def words_of(text: str) -> list[str]:
    """The maximal runs of letters (Unicode category L) of a lower-cased text,
    as the fit's ``\\p{L}+``; other numerals like ½ or Ⅷ are no letters."""
    out = []
    for w in WORDS.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


MAX_WORD, MAX_PIECE = 40, 16
#: Scores are kept near 1 by this factor per character.
SCALE = 8.0
UNKNOWN = 1e-7
CACHE_ENTRIES, CACHE_CELLS, GROUP_CHARS = 400_000, 16_000_000, 1 << 20
#: Long words at once, and the characters of one step through them.
LONG_WORDS, STRETCH = 256, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageRules:
    """The fit uses at most ``fit_docs`` different labelled texts a language, taken
    by hash, and their ``fit_words`` most frequent words of under ``MAX_WORD``
    letters; ``rounds`` of
    expectation-maximisation; ``pooled`` is the weight of the probabilities of
    all languages together.  More languages than ``max_languages`` raise."""

    fit_docs: int = 300
    fit_words: int = 8_000
    rounds: int = 2
    pooled: float = 0.05
    seed: int = 11
    max_languages: int = 200


def vocabulary(path: str) -> list[str]:
    """The lower-case letter pieces of a public sentencepiece file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and len(p) <= MAX_PIECE
                  and re.fullmatch(f"{START}?[^\\W\\d_]*", p))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) \
        .reshape(len(words), -1).astype(np.uint64)


class PieceTable:
    """Finds which substrings of words are pieces."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        keys = np.empty(len(pieces), dtype=np.uint64)
        for i, p in enumerate(pieces):
            h = np.zeros(1, np.uint64)
            for c in _codes([p])[0]:
                h = self.step(h, c)
            keys[i] = h[0]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @staticmethod
    def step(h, c):
        return (h ^ (c + np.uint64(1))) * _BASE ^ (h >> np.uint64(29))

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """Per length l: piece number of codes[:, j:j+l], or -1; an unmatched
        single character is the unknown piece, numbered ``size``."""
        out, h = [], None
        for l in range(1, min(codes.shape[1], self.longest) + 1):
            part = codes[:, l - 1:]
            h = self.step(np.zeros_like(part) if h is None else h[:, :part.shape[1]], part)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ids = np.where(self.keys[at] == h, self.order[at], -1)
            if l == 1:
                ids = np.where(ids < 0, self.size, ids)
            out.append(ids)
        return out


def forward(matches: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """``alpha[word, position, language]``: scaled probability of each prefix,
    summed over all segmentations.  ``prob[piece, language]``; the last row
    (for -1) is 0."""
    m, n = matches[0].shape
    alpha = np.zeros((m, n + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, n + 1):
        for l in range(1, min(end, len(matches)) + 1):
            ids = matches[l - 1][:, end - l]
            alpha[:, end] += alpha[:, end - l] * prob[ids] * SCALE ** l
    return alpha


def forward_long(words: list[str], table: PieceTable, prob: np.ndarray) -> np.ndarray:
    """Log of the last ``forward`` of words of any length: ``[word, language]``.

    Only the last ``table.longest`` positions are held, rescaled as they
    shrink; pieces are looked up a stretch at a time, with as many characters
    before it as a piece can reach back."""
    m, n, k = len(words), max(map(len, words)), table.longest
    codes = np.zeros((m, n), np.uint64)
    for i, w in enumerate(words):
        codes[i, :len(w)] = _codes([w])[0]
    ends = np.array([len(w) for w in words])
    last = np.zeros((m, k, prob.shape[1]))  # last[:, l - 1]: the position l characters back
    last[:, 0] = 1.0
    logs, out = np.zeros((2, m, prob.shape[1]))
    powers = SCALE ** np.arange(1, k + 1)[:, None]
    for s in range(0, n, STRETCH):
        lo, e = max(0, s - k + 1), min(n, s + STRETCH)
        ids = np.full((e - s, m, k), -1)
        for l, found in enumerate(table.matches(codes[:, lo:e]), 1):
            j = max(0, s + 1 - l - lo)
            ids[j + lo + l - 1 - s:, :, l - 1] = found[:, j:].T
        for i in range(e - s):
            now = (last * (prob[ids[i]] * powers)).sum(axis=1)
            last[:, 1:] = last[:, :-1].copy()
            last[:, 0] = now
            here = ends == s + i + 1
            if here.any():
                out[here] = np.log(np.maximum(now[here], 1e-300)) + logs[here]
            if i % 8 == 7:
                top = np.maximum(last.max(axis=1), 1e-300)
                last /= top[:, None]
                logs += np.log(top)
    return out


def backward(matches: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    m, n = matches[0].shape
    beta = np.zeros((m, n + 1, prob.shape[1]))
    beta[:, n] = 1.0
    for start in range(n - 1, -1, -1):
        for l in range(1, min(n - start, len(matches)) + 1):
            ids = matches[l - 1][:, start]
            beta[:, start] += beta[:, start + l] * prob[ids] * SCALE ** l
    return beta


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _rows(prob: np.ndarray) -> np.ndarray:
    """``prob`` with the unknown piece and the never-matching last row."""
    k = prob.shape[1]
    return np.vstack([prob, np.full((1, k), UNKNOWN), np.zeros((1, k))])


def fit_pieces(words: list[str], weights: np.ndarray, table: PieceTable, rounds: int) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation."""
    prob = np.full((table.size, 1), 1.0 / table.size)
    groups = [(g, table.matches(_codes([words[i] for i in g]))) for g in _by_length(words).values()]
    for _ in range(rounds):
        counts = np.zeros(table.size + 2)
        rows = _rows(prob)
        for g, found in groups:
            alpha, beta = forward(found, rows)[:, :, 0], backward(found, rows)[:, :, 0]
            scale = weights[g] / alpha[:, -1]
            n = alpha.shape[1] - 1
            for l, ids in enumerate(found, 1):
                part = alpha[:, :n - l + 1] * rows[ids, 0] * SCALE ** l * beta[:, l:] * scale[:, None]
                counts += np.bincount(np.where(ids < 0, table.size + 1, ids).ravel(), part.ravel(), table.size + 2)
        seen = counts[:table.size]
        prob = (seen / max(seen.sum(), 1e-300))[:, None]
    return prob[:, 0]


class LanguageModel:
    """Scores words under every language; remembers a bounded number of them."""

    def __init__(self, languages: list[str], pieces: list[str], prob: np.ndarray):
        self.languages, self.pieces, self.prob = languages, pieces, prob
        self.key = uuid.uuid4().hex

    def open(self) -> LanguageModel:
        self.table, self.rows = PieceTable(self.pieces), _rows(self.prob)
        self.at: dict[str, int] = {}
        self.room = min(CACHE_ENTRIES, CACHE_CELLS // max(1, len(self.languages)))
        self.vec = np.empty((self.room, len(self.languages)))
        return self

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        out = np.zeros((len(words), len(self.languages)))
        words = [START + w for w in words]
        groups = _by_length(words)
        for n, g in groups.items():
            if n <= MAX_WORD:
                for s in range(0, len(g), 4096):
                    some = g[s:s + 4096]
                    total = forward(self.table.matches(_codes([words[i] for i in some])), self.rows)[:, -1]
                    out[some] = np.log(np.maximum(total, 1e-300)) - n * np.log(SCALE)
        long = [i for n in sorted(groups) if n > MAX_WORD for i in groups[n]]
        while long:
            # alike in length, with a bounded number of characters
            size = max(1, min(LONG_WORDS, GROUP_CHARS // len(words[long[-1]])))
            some, long = long[-size:], long[:-size]
            lengths = np.array([len(words[i]) for i in some])
            out[some] = forward_long([words[i] for i in some], self.table, self.rows) - lengths[:, None] * np.log(SCALE)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Summed log probabilities per text; NaN rows for texts without letters."""
        found = [words_of(t) for t in texts]
        new = list({w for ws in found for w in ws}.difference(self.at))
        if len(self.at) + len(new) > self.room:
            self.at = {}
            new = list({w for ws in found for w in ws})
        if len(new) > len(self.vec):
            self.vec = np.empty((len(new), len(self.languages)))
        base = len(self.at)
        self.vec[base:base + len(new)] = self.log_probs(new)
        self.at.update(zip(new, range(base, base + len(new))))
        out = np.full((len(texts), len(self.languages)), np.nan)
        for i, ws in enumerate(found):
            if ws:
                out[i] = self.vec[list(map(self.at.__getitem__, ws))].sum(axis=0)
        return out


def fit(labelled: DataFrame, vocabulary_path: str, rules: LanguageRules = LanguageRules(),
        text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """A model from labelled texts (rows with a NULL label or text are left out).

    The sample is bounded: per label ``fit_docs`` different texts by hash, copies
    counting once; only their word counts, ``fit_words`` a label, reach the driver."""
    rows = labelled.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).filter(
        F.col("label").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64(F.lit(rules.seed), "text")
    per = rows.groupBy("label").agg(F.approx_count_distinct(h).alias("n")).limit(rules.max_languages + 1).collect()
    if len(per) > rules.max_languages:
        raise ValueError(f"more than {rules.max_languages} labels")
    pieces = vocabulary(vocabulary_path)
    languages = sorted(r["label"] for r in per)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    share = F.create_map(*(F.lit(x) for r in per for x in (r["label"], min(1.0, 2 * rules.fit_docs / max(r["n"], 1)))))
    near = rows.withColumn("h", h).filter(
        F.pmod("h", F.lit(1 << 20)) < F.lit(float(1 << 20)) * F.element_at(share, F.col("label")))
    # one row per text, added up in each task before the shuffle: the window holds the sample only
    near = near.groupBy("label", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("label").orderBy("h", "text")
    some = near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= rules.fit_docs)
    counts = (some.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
              .filter(F.length("word") < MAX_WORD).groupBy("label", "word").agg(F.count("*").alias("n")))
    top = Window.partitionBy("label").orderBy(F.desc("n"), "word")
    counts = counts.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= rules.fit_words) \
        .select("label", "word", "n").toPandas()
    table = PieceTable(pieces)
    own = []
    for lang in languages:
        part = counts[counts.label == lang]
        own.append(fit_pieces([START + w for w in part.word], part.n.to_numpy(float), table, rules.rounds)
                   if len(part) else np.full(len(pieces), 1.0 / len(pieces)))
    own = np.stack(own, axis=1)
    prob = (1 - rules.pooled) * own + rules.pooled * own.mean(axis=1, keepdims=True)
    return LanguageModel(languages, pieces, prob)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (its posterior under
    equal priors) per row; ``und`` and 0 for texts that are NULL or have no
    letter, or when nothing was learned.  Ties go to the first label."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = worker_state("languages", model.key, model.open)
        for frame in batches:
            texts = ["" if t is None else t for t in frame["_text"]]
            pred: list[str] = []
            score: list[float] = []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < GROUP_CHARS:
                    size += len(texts[end])
                    end += 1
                logs = m.score(texts[at:end]) if m.languages else np.full((end - at, 1), np.nan)
                best = np.nanargmax(np.where(np.isnan(logs), -np.inf, logs), axis=1)
                top = logs[np.arange(len(logs)), best]
                post = 1.0 / np.exp(np.clip(logs - top[:, None], -700, 0)).sum(axis=1)
                for b, t, p in zip(best, top, post):
                    pred.append("und" if np.isnan(t) else m.languages[b])
                    score.append(0.0 if np.isnan(t) else float(p))
                at = end
            yield frame.drop(columns="_text").assign(lang_pred=pred, score=score)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInPandas(run, schema)
