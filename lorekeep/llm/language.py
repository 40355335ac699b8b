"""Language identification by unigram piece models, summed over all segmentations.

The pieces are those of a fixed public vocabulary.  A language gives each piece a
probability; the probability of a word is the sum, over all ways to cut it into pieces,
of the product of their probabilities, which the forward algorithm computes.  The piece
probabilities are fitted by expectation-maximisation over the same sums.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import shipping
from . import caches, scratch
from .words import distinct, portions

LETTERS = regex.compile(r"\p{L}+")
START = "▁"
CACHED_WORDS = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """Pieces and their numbers, with their trie: `edges` holds (node, next letter) in order, `child` the node each leads to, `piece` the piece a node spells or -1."""

    def __init__(self, numbered: dict[str, int]):
        super().__init__(numbered)
        nodes = {"": 0}
        for p in self:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        steps = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), nodes[p]) for p in nodes if p)
        self.edges, self.child = np.array(steps, np.int64).reshape(-1, 2).T.copy()
        self.piece = np.array([self.get(p, -1) for p in nodes], np.int32)
        self.longest = max(1, max(map(len, self), default=1))


_pieces: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """The vocabulary's lower-cased letter pieces, numbered; 0 is any other single letter."""
    if path not in _pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
        found = [p for p in found if p == START or p.removeprefix(START).isalpha()]
        _pieces[path] = Pieces({p: i + 1 for i, p in enumerate(dict.fromkeys([START, *found]))})
    return _pieces[path]


def lattice(words: list[str], vocab: dict[str, int]) -> np.ndarray:
    """ids[w, i, k]: the piece that ends before position i + 1 and is k + 1 long; -1 if there is none.  All words have one length.

    k goes as far as any piece in these words is long.

    All places of all words walk down the trie together, a letter a step, until no piece begins so.
    """
    n, trie = len(words[0]), vocab if isinstance(vocab, Pieces) else Pieces(vocab)
    letters = np.array(words, f"U{n}").view(np.uint32).astype(np.int64)
    ids = np.full((len(words) * n, min(n, trie.longest)), -1, np.int32)
    at = np.arange(len(letters))  # where the next letter of each live walk stands
    node = np.zeros(len(letters), np.int64)
    for k in range(ids.shape[1] if len(trie) else 0):
        key = node << 21 | letters[at]
        edge = np.minimum(np.searchsorted(trie.edges, key), len(trie.edges) - 1)
        live = trie.edges[edge] == key
        at, node = at[live], trie.child[edge[live]]
        ids[at, k] = trie.piece[node]
        more = (at + 1) % n != 0  # the word goes on
        at, node = at[more] + 1, node[more]
    ids[ids[:, 0] < 0, 0] = 0
    return ids.reshape(len(words), n, -1)[:, :, : 1 + int(np.flatnonzero((ids >= 0).any(axis=0))[-1])]


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: prob[piece, language], its last row zero (for -1)."""
    w, n, longest = ids.shape
    alphas, scales = deque([np.ones((w, prob.shape[1]))], longest), deque([np.zeros(w)], longest)
    for i in range(1, n + 1):
        total, base = np.zeros_like(alphas[0]), scales[-1]
        for k in range(1, min(longest, i) + 1):
            total += prob[ids[:, i - 1, k - 1]] * (alphas[-k] * np.exp(scales[-k] - base)[:, None])
        top = total.max(axis=1)
        alphas.append(total / top[:, None])
        scales.append(base + np.log(top))
    return np.log(np.maximum(alphas[-1], 1e-300)) + scales[-1][:, None]


def expected(ids: np.ndarray, prob: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts[piece] how often each piece is expected in the words, times each word's number."""
    w, n, longest = ids.shape
    alpha, beta = np.zeros((n + 1, w)), np.zeros((n + 1, w))
    alpha[0], beta[n] = 1, 1
    for i in range(1, n + 1):
        for k in range(1, min(longest, i) + 1):
            alpha[i] += prob[ids[:, i - 1, k - 1]] * alpha[i - k]
    for i in range(n - 1, -1, -1):
        for k in range(1, min(longest, n - i) + 1):
            beta[i] += prob[ids[:, i + k - 1, k - 1]] * beta[i + k]
    for i in range(1, n + 1):
        for k in range(1, min(longest, i) + 1):
            at = ids[:, i - 1, k - 1]
            gain = alpha[i - k] * prob[at] * beta[i] / alpha[n] * times
            np.add.at(counts, at[at >= 0], gain[at >= 0])


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # log probability of each language
    prob: np.ndarray  # [piece, language], last row zero
    vocab_path: str
    name: str


def fit(docs: DataFrame, vocab_path: str, text_col: str = "text", lang_col: str = "lang", max_rows: int = 8000, rounds: int = 3, id_col: str = "doc_id") -> Model:
    """Piece probabilities of each language from at most about `max_rows` labelled rows, chosen by a hash of their id and text.

    Rows without a language or text are left out.  What the driver collects is bounded by
    the vocabulary times the languages.
    """
    shipping.ship(docs.sparkSession)
    known = docs.select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)).alias("h")).filter("lang is not null and text is not null")
    rate = 1_000_000 * min(1.0, max_rows / max(1, known.count()))
    known = known.filter(F.col("h") < F.lit(int(rate) if rate < 1_000_000 else 1_000_000))
    words = known.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{1,32}"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = scratch.table(words, "words")
    by_lang = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(by_lang)
    vocab = vocabulary(vocab_path)
    size = len(vocab) + 1
    prob = np.zeros((size + 1, len(langs)))
    prob[:size] = 1 / size
    for _ in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast(prob)

        def count(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            caches.only("fit")
            own, old = vocabulary(vocab_path), given.value
            sums = {g: np.zeros(size) for g in langs}
            for batch in batches:
                for (g, _), part in batch.groupby(["lang", batch["word"].str.len()]):
                    at = langs.index(g)
                    for lo in range(0, len(part), 4096):
                        some = part.iloc[lo : lo + 4096]
                        expected(lattice([START + x for x in some["word"]], own), old[:, at], some["n"].to_numpy(float), sums[g])
            yield pd.DataFrame([(g, int(i), float(s[i])) for g, s in sums.items() for i in np.flatnonzero(s)], columns=["lang", "piece", "n"])
            caches.clear()

        found = words.mapInPandas(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        new = np.full((size, len(langs)), 0.05)
        for r in found:
            new[r.piece, langs.index(r.lang)] += r.n
        prob = np.vstack([new / new.sum(axis=0), np.zeros((1, len(langs)))])
        given.unpersist()
    prior = np.log(np.array([by_lang[g] for g in langs], float) / max(1, sum(by_lang.values()))) if langs else np.zeros(0)
    return Model(langs, np.maximum(prior, -5), prob, vocab_path, str(hash(prob.tobytes())))


class _Scorer(dict):
    """Row numbers of words in a matrix of (log probability by language, has a letter)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.rows = model, [], np.zeros((0, len(model.langs) + 1), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        self.new.append(word)
        return self[word]

    def score_new(self) -> None:
        m, vocab = self.model, vocabulary(self.model.vocab_path)
        out = np.zeros((len(self.new), len(m.langs) + 1))
        by_length: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for i, w in enumerate(self.new):
            for run in LETTERS.findall(w.lower()):
                by_length[len(run)].append((START + run, i))
        for n, same in by_length.items():
            step = max(1, (1 << 16) // (n + 1))  # letters at a time, so that long runs need no more memory
            for lo in range(0, len(same), step):
                runs, at = zip(*same[lo : lo + step], strict=True)
                gain = forward(lattice(list(runs), vocab), m.prob)
                np.add.at(out, np.array(at), np.hstack([gain, np.ones((len(runs), 1))]))
        self.rows = np.vstack([self.rows, out.astype(np.float32)])
        self.new = []

    def texts(self, texts: pa.Array) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
            self.rows = self.rows[:0]
        found, at, begin = distinct(texts)
        own = np.fromiter(map(self.__getitem__, found.to_pylist()), np.int64, len(found))
        self.score_new()
        rows = self.rows[own][at].astype(np.float64)
        return np.add.reduceat(np.vstack([rows, np.zeros((1, rows.shape[1]))]), begin[:-1]) if len(texts) else rows


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """doc (a struct of the columns of `keep`), lang_pred and score (the probability of lang_pred among the languages).

    Null texts, texts without a letter, and every text if no language was learned: `und`, score 0.
    Ties go to the first language by name.
    """
    spark = docs.sparkSession
    shipping.ship(spark)
    given = spark.sparkContext.broadcast(model)
    kept = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)])
    rows = kept if text_col in keep else docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].alias("text"))
    at, width = keep.index(text_col) if text_col in keep else len(keep), len(keep)
    out = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double")

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        scorer = caches.only(("languages", m.name), lambda: _Scorer(m))
        for whole in batches:
            for lo, hi in portions(whole.column(at)):
                batch = whole.slice(lo, hi - lo)
                sums = scorer.texts(batch.column(at))
                langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
                if m.langs:
                    raw = sums[:, :-1] + m.prior
                    p = np.exp(raw - raw.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for i in np.flatnonzero(sums[:, -1]):
                        j = int(p[i].argmax())
                        langs[i], scores[i] = m.langs[j], float(p[i, j])
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:width], "lang_pred", "score"])
        caches.trim()

    told = rows.mapInArrow(guess, out)
    return told.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]).alias("doc"), "lang_pred", "score")


def crc_part(id_col: Column | str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(0)).cast("string").cast("binary")) % parts


def identify(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; fitted on the rows whose crc32 of the id leaves another remainder than 2 by 4.

    Repeated rows are told alike; an empty table gives an empty table; other columns are ignored.
    A very long text is scored whole, in portions of its words.
    """
    part = crc_part(id_col, 4)
    model = fit(docs.filter(part != 2), vocab_path or default_vocabulary(), text_col, lang_col, id_col=id_col, **options)
    return predict(docs, model, [id_col], text_col).select("doc.*", "lang_pred", "score").select(F.col(id_col), (part == 2).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
