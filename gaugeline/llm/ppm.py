"""Language-model scores by prediction by partial matching (PPM) over bytes, beside a word-count base score.

Model.  A byte-context trie of depth ORDER: for every context of up to ORDER bytes, how often each byte followed it
in the training documents.  A byte is predicted in its longest known context; if it never followed there, an escape
(method D: a byte seen c times of n has (2c - 1) / 2n, an escape q / 2n for q distinct bytes) leads to the next shorter
context, where the bytes already excluded don't count.  Below the empty context all remaining byte values are equally likely.  The model is pretrained: every
training text is counted, in Spark; the sum of the log10 probabilities over a text's bytes and its end is its score.
Texts are read as their words, A-Z in lower case, one space between them, ended by a line feed.

Size.  Counting shuffles partial counts per task, so it grows with the corpus.  What a scoring task holds is bounded, and the
scores don't depend on the bound.  While each order has TRIE_NODES nodes at most, tasks hold the trie.  Beyond that they hold the
scores of TRIE_NODES frequent windows, taken from the whole trie; every other distinct window walks the trie by joins, order
by order: the trie is one row per context with its followers (256 at most) and only windows that a context didn't decide go on to the
next.  The base score meets the vocabulary in two parts: HEAD_WORDS frequent words are broadcast, which also are the hot
keys; all other words are joined by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import crc_mod, cut, id_text, record_batch, slices, words

ORDER = 5
TRIE_NODES = 1 << 22
HEAD_WORDS = 200_000
#: The end of a text: a token of its own, and the last byte that the model predicts.
END = b"\n"
_U = np.uint64
_EMPTY = _U(2**64 - 1)
_COUNTS = pa.schema([("word", pa.binary()), ("win", pa.int64()), ("n", pa.int64())])
_SCORES = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
                     ("score", pa.float64()), ("word", pa.binary()), ("win", pa.int64()), ("n", pa.int64())])
_SCORES_SQL = "rid long, id long, n_tokens long, n_known long, base double, score double, word binary, win long, n long"


def windows(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The windows (ORDER context bytes and the byte they precede) of all texts, and each text's number of windows."""
    pad, parts, size = END * ORDER, [], []
    for ws in texts:
        body = b" ".join(ws)
        parts += [pad, body, END]
        size.append(len(body) + 1)
    raw, size = np.frombuffer(b"".join(parts), np.uint8), np.array(size, np.int64)
    if not len(raw):
        return np.empty(0, _U), size
    win = np.zeros(len(raw) - ORDER, _U)
    for j in range(ORDER + 1):
        win = (win << _U(8)) | raw[j:len(raw) - ORDER + j]
    # the windows that end in a pad are left out: after each text but the last come ORDER of them
    keep = np.ones(len(win), bool)
    ends = np.cumsum(size + ORDER)[:-1] - ORDER
    keep[(ends[:, None] + np.arange(ORDER)).ravel()] = False
    return win[keep], size


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word and window counts of a task, in pieces of bounded size."""
    vocabulary, parts = Counter(), []

    def emit_words():
        keys = list(vocabulary)
        none = pa.nulls(len(keys), pa.int64())
        return record_batch(_COUNTS, keys, none, list(vocabulary.values()))

    def emit_windows():
        key, n = _merged(parts)
        return record_batch(_COUNTS, pa.nulls(len(key), pa.binary()), key.view(np.int64), n)

    for part in slices(batches):
        texts = [words(t) for t in part.column("text").to_pylist()]
        for ws in texts:
            vocabulary.update(ws)
        vocabulary[END] += len(texts)
        parts.append(np.unique(windows(texts)[0], return_counts=True))
        if len(vocabulary) > 250_000:
            yield emit_words()
            vocabulary = Counter()
        if sum(len(k) for k, _ in parts) > 1_500_000:
            parts = [_merged(parts)]
            if len(parts[0][0]) > 800_000:
                yield emit_windows()
                parts = []
    if vocabulary:
        yield emit_words()
    if parts:
        yield emit_windows()


class _Hash:
    """Open-addressing table from 64-bit keys to float32, built and probed with whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(1.3 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), _U((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _EMPTY, _U), np.zeros(1 << bits, np.float32)
        for at in range(0, len(keys), 1 << 17):   # in pieces, so that what a build needs beside the table stays small
            self._put(keys[at:at + (1 << 17)], values[at:at + (1 << 17)])

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[free]
            there = self.keys[slot] == keys
            self.values[slot[there]] = values[there]
            keys, values, slot = keys[~there], values[~there], (slot[~there] + _U(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * _U(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._slot(keys)
        own = self.keys[slot]
        value, found = self.values[slot], own == keys
        open_ = np.flatnonzero(~found & (own != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + _U(1)) & self.mask
            own = self.keys[slot[open_]]
            hit = own == keys[open_]
            value[open_[hit]], found[open_[hit]] = self.values[slot[open_[hit]]], True
            open_ = open_[~hit & (own != _EMPTY)]
        return value, found


def _at(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _low(x: np.ndarray, n_bytes: int) -> np.ndarray:
    return x & _U((1 << (8 * n_bytes)) - 1)


class ByteModel:
    """The trie as sorted arrays by order; ``log10(win)`` gives each window's log probability."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        """grams[o]: sorted (context of o bytes, byte) keys and their counts, nested from order to order."""
        self.gram = [g.astype(_U) for g, _ in grams]
        self.logn = [np.log10(2.0 * n - 1) for _, n in grams]
        self.ctx, self.first, self.escape, self.after, self.after_escape = [], [], [], [], []
        total, kinds = [], []
        for o, (g, n) in enumerate(grams):
            ctx, start = np.unique(g >> _U(8), return_index=True)
            add = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0)  # noqa: B023, E731
            total.append(add(n.astype(float)))
            kinds.append(add(np.ones(len(n))))
            self.ctx.append(ctx)
            self.first.append(np.log10(2 * total[o]))
            self.escape.append(np.log10(kinds[o]) - self.first[o])
            if o == 0:
                self.after.append(np.zeros(len(ctx)))
                self.after_escape.append(np.zeros(len(ctx)))
                continue
            # after an escape from a context: its suffix without the bytes seen in the context
            seen = add(grams[o - 1][1][_at(self.gram[o - 1], _low(self.gram[o], o))].astype(float))
            suffix = _at(self.ctx[o - 1], _low(ctx, o - 1))
            rest, left = total[o - 1][suffix] - seen, kinds[o - 1][suffix] - kinds[o]
            with np.errstate(divide="ignore"):
                self.after.append(np.log10(np.maximum(2 * rest, 1e-300)))
                self.after_escape.append(np.where(left > 0, np.log10(np.maximum(left, 1e-300)) - self.after[o], 0.0))
        self.rest = -np.log10(max(1, 256 - len(self.gram[0])))
        for table in (self.logn, self.first, self.escape, self.after, self.after_escape):
            table[:] = [x.astype(np.float32) for x in table]
        self._hash = None

    def _top(self) -> _Hash:
        if self._hash is None:
            own = np.searchsorted(self.ctx[ORDER], self.gram[ORDER] >> _U(8))
            self._hash = _Hash(self.gram[ORDER], self.logn[ORDER] - self.first[ORDER][own])
        return self._hash

    def __getstate__(self):
        return self.__dict__ | {"_hash": None}

    def log10(self, win: np.ndarray) -> np.ndarray:
        value, found = self._top().get(win)
        out = value.astype(np.float64)
        missing = np.flatnonzero(~found)
        if len(missing):
            key, back = np.unique(win[missing], return_inverse=True)
            out[missing] = self.walk(key)[back.ravel()]
        return out

    def get(self, win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.log10(win), np.ones(len(win), bool)

    def walk(self, win: np.ndarray) -> np.ndarray:
        """From the longest context down, with escapes and exclusion."""
        lp, child, open_ = np.zeros(len(win)), np.full(len(win), -1), np.arange(len(win))
        for o in range(ORDER, -1, -1):
            ctx = _at(self.ctx[o], _low(win[open_] >> _U(8), o))
            known = ctx >= 0
            w, c, x, at = open_[known], child[open_[known]], ctx[known], _at(self.gram[o], _low(win[open_[known]], o + 1))
            came = c >= 0
            if o < ORDER and len(self.after[o + 1]):
                norm = np.where(came, self.after[o + 1][c], self.first[o][x])
                escape = np.where(came, self.after_escape[o + 1][c], self.escape[o][x])
            else:
                norm, escape = self.first[o][x], self.escape[o][x]
            hit = at >= 0
            lp[w[hit]] += self.logn[o][at[hit]] - norm[hit]
            lp[w[~hit]] += escape[~hit]
            child[w] = x
            open_ = np.concatenate([open_[~known], w[~hit]])
        lp[open_] += self.rest
        return lp


def _score(windows_known, head, norm: float):
    """Rows of three kinds: a text's scores; a word that ``head`` lacks; a window that ``windows_known`` lacks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        number = TaskContext.get().partitionId() << 33
        for part in slices(batches):
            texts = [words(t) for t in part.column("text").to_pylist()]
            win, size = windows(texts)
            value, found = windows_known.value.get(win)
            first = np.cumsum(size) - size
            score = np.add.reduceat(np.where(found, value, 0.0).astype(np.float64), first)
            rows, rest = [], []
            for i, ws, s, at, k in zip(part.column("id").to_pylist(), texts, score.tolist(), first.tolist(), size.tolist(), strict=True):
                base = seen = 0
                own = Counter(ws)
                own[END] += 1
                for word, n in own.items():
                    log = known.get(word)
                    if log is None:
                        rest.append((number, None, None, None, None, None, word, None, n))
                    else:
                        base += n * (log - norm)
                        seen += n
                rows.append((number, i, len(ws) + 1, seen, float(base), s, None, None, None))
                open_ = win[at:at + k][~found[at:at + k]]
                if len(open_):
                    keys, n = np.unique(open_, return_counts=True)
                    none = [pa.nulls(len(keys), f.type) for f in _SCORES]
                    yield record_batch(_SCORES, np.full(len(keys), number), *none[1:7], keys.view(np.int64), n)
                number += 1
            rows += rest
            yield record_batch(_SCORES, *([r[k] for r in rows] for k in range(len(_SCORES))))
    return run


def _limit(counts: DataFrame, most: int) -> int:
    """The least count at which no more than ``most`` rows are left, from a histogram of fixed size."""
    step = F.floor(F.log2(F.col("n")) * 16)
    rows = 0
    for at, n in sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("at")).count().collect()), reverse=True):
        rows += n
        if rows > most:
            return int(np.ceil(2 ** ((at + 1) / 16)))
    return 1


def _pairs(df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    table = df.select(key, "n").toArrow()
    keys, n = table.column(key).to_numpy().astype(np.int64).view(_U), table.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _context_tables(wins: DataFrame) -> list[DataFrame]:
    """The trie by order: ``ctx, total, next``; ``next`` lists the bytes that followed the context (256 at most) with their counts."""
    tables, grams = [], wins
    for o in range(ORDER, -1, -1):
        table = cut(grams.groupBy(F.expr("shiftright(win, 8)").alias("ctx"))
                    .agg(F.sum("n").alias("total"), F.collect_list(F.expr("struct(cast(win & 255 as int) as b, n)")).alias("next")), f"ppm-order-{o}")
        tables.insert(0, table)
        if o:
            shorter = F.expr(f"shiftleft(ctx & {(1 << 8 * (o - 1)) - 1}L, 8) | one.b").alias("win")
            grams = table.select("ctx", F.explode("next").alias("one")).select(shorter, "one.n").groupBy("win").agg(F.sum("n").alias("n"))
    return tables


def _frequent(tables: list[DataFrame], least: int) -> _Hash:
    """Windows counted ``least`` times or more with their log10 probabilities; the caller bounds their number."""
    lp = F.expr("log10(2 * one.n - 1) - log10(2 * total)").alias("lp")
    table = (tables[ORDER].select("ctx", "total", F.explode("next").alias("one")).where(F.col("one.n") >= least)
             .select(F.expr("shiftleft(ctx, 8) | one.b").alias("win"), lp).toArrow())
    return _Hash(table.column("win").to_numpy().astype(np.int64).view(_U), table.column("lp").to_numpy().astype(np.float32))


def _walk(wins: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``win, lp`` of distinct windows: the walk of ByteModel as joins with the whole trie, one per order.

    ``gone`` holds the bytes seen in the longer contexts.  Orders 0 and 1 have 1 and 256 contexts at most and are
    broadcast; in the others a context that very many windows share is a skewed join, which Spark splits.
    """
    open_ = wins.selectExpr("win", "0d as lp", "cast(array() as array<int>) as gone")
    done = []
    for o in range(ORDER, -1, -1):
        table = F.broadcast(tables[o]) if o < 2 else tables[o]
        context = F.expr(f"shiftright(win, 8) & {(1 << 8 * o) - 1}L")
        step = open_.join(table, context == F.col("ctx"), "left")
        # the bytes that the longer contexts excluded don't count; where none is left, the context says nothing
        step = step.withColumn("left_", F.expr("case when size(gone) = 0 then next else filter(next, x -> not array_contains(gone, x.b)) end"))
        step = step.withColumn("all", F.when(F.size("gone") == 0, F.col("total")).otherwise(F.expr("aggregate(left_, 0L, (s, x) -> s + x.n)")))
        step = step.withColumn("own", F.expr("get(filter(next, x -> x.b = (win & 255)), 0).n"))
        step = cut(step.select("win", F.col("own").isNotNull().alias("hit"),
                               F.expr("lp + case when own is not null then log10(2 * own - 1) - log10(2 * all) "
                                      "when all > 0 then log10(size(left_)) - log10(2 * all) else 0d end").alias("lp"),
                               F.expr("case when own is not null then cast(array() as array<int>) when next is null then gone else transform(next, x -> x.b) end").alias("gone")), f"ppm-walk-{o}")
        done.append(step.where("hit").select("win", "lp"))
        open_ = step.where("not hit").select("win", "lp", "gone")
    out = open_.select("win", F.expr("lp - log10(256 - size(gone))").alias("lp"))
    for part in done:
        out = out.unionAll(part)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
                head_words: int = HEAD_WORDS, trie_nodes: int = TRIE_NODES) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Training documents are those whose crc32 of the id modulo ``folds`` isn't ``held``.  Defined cases: a NULL or empty
    text is its end only; rows that repeat an id are scored one by one (and all counted); a NULL id is not held out; an
    empty table gives no rows; with no training document every byte value is equally likely and the base score is 0;
    further columns are ignored.  Texts are read whole.
    """
    spark, source = docs.sparkSession, id_text(docs, id_col, text_col, binary=True)
    out = F.coalesce(crc_mod("id", folds) == held, F.lit(False))
    counts = cut(source.where(~out).mapInArrow(_count, "word binary, win long, n long")
                 .groupBy("word", "win").agg(F.sum("n").alias("n")), "ppm-counts")
    vocabulary, wins = counts.where("word is not null").select("word", "n"), counts.where("win is not null").select("win", "n")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = float(np.log10(n + v + 1))
    least = _limit(vocabulary, head_words)
    log_count = F.log10(F.col("n") + 1)
    # head_words rows at most
    head = {bytes(r[0]): r[1] for r in vocabulary.where(F.col("n") >= least).select("word", log_count).collect()}
    orders = [wins.groupBy(F.col("win").bitwiseAND((1 << (8 * (o + 1))) - 1).alias("win")).agg(F.sum("n").alias("n")) for o in range(ORDER)] + [wins]
    sc = spark.sparkContext
    whole = all(_limit(x, trie_nodes) == 1 for x in orders)
    if whole:
        model = ByteModel([_pairs(x, "win") for x in orders])
    else:
        tables = _context_tables(wins)
        model = _frequent(tables, _limit(wins, trie_nodes))
    scored = cut(source.mapInArrow(_score(sc.broadcast(model), sc.broadcast(head), norm), _SCORES_SQL), "ppm-scores")
    texts = scored.where("n_tokens is not null").drop("word", "win", "n")
    if not whole:
        far = scored.where("win is not null").select("rid", F.col("win").alias("far"), "n")
        walked = _walk(far.select(F.col("far").alias("win")).distinct(), tables)
        more = far.join(walked, F.col("far") == F.col("win")).groupBy("rid").agg(F.sum(F.col("n") * F.col("lp")).alias("more"))
        texts = texts.join(more, "rid", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    rare = vocabulary.where(F.col("n") < least).select(F.col("word").alias("rare"), (F.col("n") + 1).alias("c"))
    rest = (scored.where("word is not null").select("rid", "word", "n").join(rare, F.col("word") == F.col("rare"), "left")
            .groupBy("rid").agg(F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(1))) - norm)).alias("rest"),
                                F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rest_known")))
    zero = F.lit(0).cast("long")
    return (texts.join(rest, "rid", "left")
            .select("id", out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rest_known", zero)).alias("n_known"),
                    F.lit(int(n)).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score"))
