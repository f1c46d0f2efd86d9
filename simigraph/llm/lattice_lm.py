"""Operator 6: subword lattice likelihood, beside a smoothed word model.

The vocabulary of an existing tokenizer gives the pieces and their scores. Its
scores are ranks (a piece's score is minus its rank), so as unigram weights they
are read as 1 / (RANK_SHIFT - score). A word's probability is the sum over all
its segmentations, by forward recursion in logarithms over the lattice of the
word. No word crosses a blank and no piece does, so the product over a text's
words is the marginal over all segmentations of the text; ``marginal`` is that
under the file's scores alone, without an end. Characters without a piece are covered by byte
pieces.

The model learns from the training documents in two ways. The expected uses of
each piece in all training words, under the file's scores, become the pieces'
weights (one round, from the forward and backward sums of the pass that gives
``marginal``). And a word seen in training is one more arc, from its beginning
to its end: with c training occurrences among N tokens of V kinds its
probability is (c + V * lattice) / (N + V), so that the lattice alone carries
new words. ``score`` is the sum over the words and one end symbol, which is
smoothed alike.

``score`` spreads what it leaves for new words over all strings, while the base
gives each new word the same lump, however many there may be; so on unseen text
the base's figure for a token is the higher one, and the two can't be compared
as models. What training adds shows in ``score`` against ``marginal``: on the
held-out tenth of 1,000 documents -4.54 against -8.89 for a token, base -4.10.

Words are counted in one table over all documents, with training counts, and
each distinct word is scored there once. Document sums need that table by word:
words with at least a HEAD-th of all occurrences (so HEAD words at most) are
broadcast, by a digest where they are longer than KEY_BYTES, and summed up where
the documents are read; only the others, none of which can be hot, are shuffled,
once for each document.

Null texts and texts without words are one end symbol. A null id counts as
training (its crc32 is null). Repeated rows count as often as they come. Very
long texts and words are scored whole: texts by their distinct words, words of
more than LONG_WORD characters one at a time. Without training documents N is 0
and base scores are null. Only the two named columns are read, so others may
have any name.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simigraph.llm import common

#: Words that may be broadcast.
HEAD = 1 << 17
#: A longer word is known by its digest.
KEY_BYTES = 64
#: Additive smoothing of words, and of pieces.
WORD_ALPHA, PIECE_ALPHA = 0.1, 0.1
RANK_SHIFT = 50
#: Weight of a byte piece, which has no rank.
BYTE_WEIGHT = 1e-6
#: Longer words are scored one at a time, others side by side.
LONG_WORD = 64
MARK = "▁"


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, ...], np.ndarray]:
    """Pieces by id (byte pieces as one character from the surrogates, control pieces as empty) and scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            pieces.append(chr(0xDC00 + int(sp.id_to_piece(i)[3:5], 16)))
        else:
            pieces.append("" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i))
    return tuple(pieces), np.array([sp.get_score(i) for i in range(len(pieces))])


def first_logs(pieces: tuple[str, ...], scores: np.ndarray) -> np.ndarray:
    """Logarithms of the pieces' weights under the file's scores."""
    weight = np.where([bool(p) for p in pieces], 1 / (RANK_SHIFT - scores), 0.0)
    weight[[i for i, p in enumerate(pieces) if p and "\udc00" <= p <= "\udcff"]] = BYTE_WEIGHT
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


class Trie:
    """The pieces by their characters: edges as sorted numbers of node and character."""

    def __init__(self, pieces: tuple[str, ...]):
        nodes, edges = {"": 0}, {}
        for p in pieces:
            for k in range(len(p)):
                if p[: k + 1] not in nodes:
                    nodes[p[: k + 1]] = len(nodes)
                    edges[nodes[p[:k]] << 21 | ord(p[k])] = nodes[p[: k + 1]]
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(nodes), -1, np.int64)
        self.bytes = np.full(256, -1, np.int64)
        for i, p in enumerate(pieces):
            if p:
                self.piece[nodes[p]] = i
                if "\udc00" <= p <= "\udcff":
                    self.bytes[ord(p) - 0xDC00] = i

    def arcs(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, length and piece of each arc; ``room`` is what is left of the word at each position."""
        at, node, found, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], 0
        while len(at):
            key = node << 21 | codes[at + length]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at, node = at[hit], self.child[k[hit]]
            length += 1
            ends = self.piece[node] >= 0
            found.append((at[ends], np.full(ends.sum(), length), self.piece[node[ends]]))
            more = room[at] > length
            at, node = at[more], node[more]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(vocabulary(path)[0])


class Lattice:
    """Sums over all segmentations of words, under one logarithm for each piece."""

    def __init__(self, trie: Trie, logs: np.ndarray):
        self.trie, self.logs = trie, logs

    def scores(self, words: list[str], counts: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """Logarithm of each word; with counts, adds the expected uses of each piece in so many of each."""
        out = np.zeros(len(words))
        size = np.array([len(w) + 1 for w in words], np.int64)
        groups = [[k] for k in np.flatnonzero(size > LONG_WORD).tolist()]
        short = np.flatnonzero(size <= LONG_WORD)
        for rows in [short, *groups]:
            if len(rows):
                some = None if counts is None else counts[rows]
                out[rows] = self._side_by_side([words[k] for k in rows], size[rows], some, into)
        return out

    def _side_by_side(self, words: list[str], size: np.ndarray, counts: np.ndarray | None, into: np.ndarray | None) -> np.ndarray:
        codes = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        start = np.append(0, np.cumsum(size)[:-1])
        word = np.repeat(np.arange(len(words)), size)
        local = np.arange(len(codes)) - start[word]
        at, length, piece = self.trie.arcs(codes, size[word] - local)
        # Characters that are no piece are the bytes of their own.
        bare = np.ones(len(codes), bool)
        bare[at[length == 1]] = False
        bare = np.flatnonzero(bare)
        chars, which = np.unique(codes[bare], return_inverse=True)
        spelt = [self.trie.bytes[list(chr(c).encode("utf-8", "replace"))] for c in chars.tolist()]
        spelt_logs = np.array([self.logs[b].sum() for b in spelt])
        n = len(at)
        at, length = np.concatenate([at, bare]), np.concatenate([length, np.ones(len(bare), np.int64)])
        log = np.concatenate([self.logs[piece], spelt_logs[which] if len(bare) else np.zeros(0)])
        # A word has a node more than characters. In order of the local start and the length, arcs of a step end at different nodes.
        node = at + word[at]
        step = local[at] << 20 | length
        order = np.argsort(step, kind="stable")
        node, to, w = node[order], (node + length)[order], log[order]
        cut = np.flatnonzero(np.append(True, step[order][1:] != step[order][:-1])).tolist()
        spans = list(zip(cut, [*cut[1:], len(order)], strict=True))
        forward = np.full(len(codes) + len(words), -np.inf)
        first = start + np.arange(len(words))
        forward[first] = 0.0
        for a, z in spans:
            t = to[a:z]
            forward[t] = np.logaddexp(forward[t], forward[node[a:z]] + w[a:z])
        last = first + size
        out = forward[last]
        if counts is not None:
            back = np.full(len(forward), -np.inf)
            back[last] = 0.0
            for a, z in reversed(spans):
                f = node[a:z]
                back[f] = np.logaddexp(back[f], back[to[a:z]] + w[a:z])
            of = word[at[order]]
            share = counts[of] * np.exp(forward[node] + w + back[to] - out[of])
            plain = order < n
            into += np.bincount(piece[order[plain]], share[plain], len(into))
            for c, total in enumerate(np.bincount(which[order[~plain] - n], share[~plain], len(spelt))):
                np.add.at(into, spelt[c], total)
        return out


def count_words(docs: DataFrame, held_out: Column) -> DataFrame:
    """word, n_train and n_all of every distinct word."""
    words = F.explode(F.split(common.lower_ascii(common.text_or_empty()), f"[{common.SPACE}]+")).alias("word")
    rows = docs.select((~F.coalesce(held_out, F.lit(False))).cast("long").alias("train"), words).where("word <> ''")
    return rows.groupBy("word").agg(F.sum("train").alias("n_train"), F.count("*").alias("n_all"))


def weigh(words: DataFrame, model: str, n_ends: int) -> tuple[DataFrame, np.ndarray, float]:
    """The words with their logarithm under the file's scores; logarithms of the learnt pieces and of the end.

    One pass gives both. Of the counts each task returns at most one row for
    each piece, summed up by Spark; the driver gets one row for each piece.
    """
    pieces, scores = vocabulary(model)
    logs = first_logs(pieces, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(trie(model), logs), np.zeros(len(logs))
        for b in batches:
            found = lattice.scores(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float), total)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.float64())], names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), k) for k in (pa.string(), pa.int64(), pa.int64(), pa.float64())), pa.array(used, pa.int32()), pa.array(total[used])], names)

    names = ["word", "n_train", "n_all", "log_0", "piece", "n"]
    both = words.select("word", "n_train", "n_all").mapInArrow(run, "word string, n_train long, n_all long, log_0 double, piece int, n double")
    both = common.materialise(both, "weighed")
    counts = np.zeros(len(pieces))
    for r in both.where("piece is not null").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[r.piece] = r.n
    smooth = (counts + PIECE_ALPHA) * [bool(p) for p in pieces]
    whole = smooth.sum() + n_ends + PIECE_ALPHA
    with np.errstate(divide="ignore"):
        return both.where("piece is null").drop("piece", "n"), np.log(smooth / whole), math.log((n_ends + PIECE_ALPHA) / whole)


def score_words(words: DataFrame, model: str, logs: np.ndarray) -> DataFrame:
    """Adds the learnt lattice's natural logarithm for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(trie(model), logs)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lattice.scores(b.column(0).to_pylist()))], ["word", "n_train", "n_all", "log_0", "log_p"])

    return words.select("word", "n_train", "n_all", "log_0").mapInArrow(run, "word string, n_train long, n_all long, log_0 double, log_p double")


def word_key(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else hashlib.sha256(word).hexdigest().encode()


def score_documents(docs: DataFrame, model: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and marginal (all log10)."""
    spark: SparkSession = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, n_held = docs.select("doc_id").agg(F.count("*"), F.count_if(F.coalesce(held_out, F.lit(False)))).first()
    n_ends = n_docs - n_held
    counted = common.materialise(count_words(docs, held_out).repartition(common.shuffle_partitions(spark), "word"), "words")
    total = counted.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    n, v = total[0] + n_ends, total[1] + (n_ends > 0)
    weighed, logs, end = weigh(counted, model, n_ends)
    words = common.materialise(score_words(weighed, model, logs), "scored")
    mass = float(v or 1)
    seen = F.log(F.col("n_train") + mass * F.exp("log_p"))
    log_word = F.when(F.col("n_train") > 0, seen).otherwise(F.col("log_p") + math.log(mass)) - math.log(n + mass)
    end = math.log(n_ends + mass * math.exp(end)) - math.log(n + mass)
    below = math.log10(n + WORD_ALPHA * (v + 1)) if n else math.nan
    ln10 = math.log(10)
    per_word = words.select("word", (F.col("n_train") > 0).cast("long").alias("known"), (F.log10(F.col("n_train") + WORD_ALPHA) - F.lit(below)).alias("base"), (log_word / ln10).alias("model"), (F.col("log_0") / ln10).alias("pure"), "n_all")
    # At most ``head`` words can have that many of all occurrences.
    key = F.when(F.octet_length("word") <= KEY_BYTES, F.col("word")).otherwise(F.sha2("word", 256))
    top = per_word.where(F.col("n_all") * head >= total[2]).select(key.alias("key"), "known", "base", "model", "pure").toArrow()
    hot = spark.sparkContext.broadcast({w.encode(): values for w, *values in zip(*(c.to_pylist() for c in top.columns), strict=True)})
    end_known, end_base, end_model = int(n_ends > 0), math.log10(n_ends + WORD_ALPHA) - below, end / ln10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, lower = hot.value.get, bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            rid, word, tf, own = [], [], [], []
            for doc, out, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = (text or "").encode().translate(lower).split()
                known, base, model_, pure = end_known, end_base, end_model, 0.0
                row += 1
                for w, k in Counter(found).items():
                    if (h := get(w if len(w) <= KEY_BYTES else word_key(w))) is not None:
                        known += k * h[0]
                        base += k * h[1]
                        model_ += k * h[2]
                        pure += k * h[3]
                    else:
                        rid.append(row)
                        word.append(w)
                        tf.append(k)
                own.append((row, doc, bool(out), len(found) + 1, known, base, model_, pure))
                if len(rid) > 50_000:
                    yield words_batch(rid, word, tf)
                    rid, word, tf = [], [], []
            if rid:
                yield words_batch(rid, word, tf)
            # No word has a blank, so these rows meet none and lie anywhere.
            cols = list(zip(*own, strict=True))
            keys = pa.array([" %d" % r for r in cols[0]], pa.string())
            arrays = [pa.array(cols[0], pa.int64()), keys, pa.array([1] * len(own), pa.int64()), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    names = ["rid", "word", "tf", "doc_id", "held_out", "n_tokens", "known0", "base0", "model0", "pure0"]

    def words_batch(rid: list, word: list, tf: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), *(pa.nulls(len(rid), k) for k in kinds)], names)

    rows = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "rid long, word string, tf long, doc_id long, held_out boolean, n_tokens long, known0 long, base0 double, model0 double, pure0 double")
    rare = per_word.where(F.col("n_all") * head < total[2]).drop("n_all")
    joined = rows.join(rare, "word", "left")
    both = lambda own, other: F.sum(F.coalesce(F.col(own), F.col("tf") * F.col(other)))
    sums = joined.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), both("known0", "known").alias("n_known"), both("base0", "base").alias("base_score"), both("model0", "model").alias("score"), both("pure0", "pure").alias("marginal"))
    base = F.col("base_score") if n else F.lit(None).cast("double")
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "marginal")
