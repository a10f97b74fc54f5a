"""Brown class-based bigram model: exchange clustering of words, class transitions and word emissions.

P(w | v) = P(class w | class v) * P(w | class w). Tokens are words (A-Z lower-cased) and one end per text; the end is
a class of its own and stands before the first word.

1. Texts are encoded in blocks, each with a dictionary of its own, so a word is sent once per block and not once
   per occurrence. Words are counted over all training texts and the counts go back to the blocks.
2. Units are clustered: a word with 1/UNIT_SHARE of all training tokens or more is a unit; the others start
   together by their last two bytes, if those hold as much, and the rest is one unit. So there are at most
   2 * UNIT_SHARE + 2 units, however large the corpus, and every word, also a new one, has a unit and so a class to start in.
3. Exchange: the commonest units open the classes, the others join by size, then each round moves a third of the units,
   each to the class that gains most likelihood of the class bigrams over all training texts. Neighbour counts of a unit
   are one row; tasks weigh the moves.
4. Every other training word is then weighed by itself: its own neighbours in all training texts, by class, are brought
   together from all blocks, and it goes to the class in which the model so far gives its bigrams the largest
   probability. (The gain of a move alone would send all of them to an empty class at once: each would be best off
   there by itself.) Words are dealt by hash. Only words that no training text has keep the class of their unit.
5. A text's score is the sum of log10 of smoothed transitions and emissions, by the class of each word; all words share the
   class's mass by count + 1, and a class keeps 1 for a new word.

Nulls: a null text is empty (its only token is the end); a null id is not held out. Repeated rows count each. With no
training text the model is uniform over the classes. An empty table gives no rows. Extra columns are ignored.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_path
from .common import utf8, width, words_of

CLASSES, ROUNDS, UNIT_SHARE, ALPHA = 64, 12, 5_000, 1.0
BLOCK_BYTES, PAIRS_AT_ONCE = 24 << 20, 1 << 22
UNIT_PARTS = 16
WORDS_AT_ONCE = 8_192
SELF = 0xFFFF  # in lists of units: the word itself
END, OTHER = b"e", b"o"


def _saved(df: DataFrame, label: str) -> DataFrame:
    """Written below the shared folder, tightly compressed."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planes(ids: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes first."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


ENCODED = "is_doc boolean, block long, local int, word binary, n long, doc_id long, held boolean, ids binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    parts = [x.split() for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(n, _KINDS[k]) for c, k in parts], names=[c for c, _ in parts])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, held, data) to ENCODED: a row per text with its local word numbers, and per word of a block.

    Local number 0 is the end (the empty word). `n` counts training occurrences in the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0

        def settle() -> Iterator[pa.RecordBatch]:
            block = (part << 32) | serial
            counts = np.zeros(len(known), np.int64)
            for _, held, ids in texts:
                if not held:
                    counts += np.bincount(ids, minlength=len(known))
            yield _batch(ENCODED, {"is_doc": [True] * len(texts), "block": [block] * len(texts), "doc_id": [x[0] for x in texts], "held": [x[1] for x in texts], "ids": [planes(x[2]) for x in texts]})
            words = list(known)
            for i in range(0, len(words), 100_000):
                some = words[i: i + 100_000]
                yield _batch(ENCODED, {"is_doc": [False] * len(some), "block": [block] * len(some), "local": np.arange(i, i + len(some), dtype=np.int32), "word": some, "n": counts[i: i + len(some)]})

        known: dict[bytes, int] = {b"": 0}
        texts: list[tuple] = []
        size = 0
        for b in batches:
            for doc_id, held, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held", "data")), strict=True):
                words = words_of(data)
                words.append(b"")
                texts.append((doc_id, held, np.array([known.setdefault(w, len(known)) for w in words], np.uint32)))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from settle()
                    known, texts, size, serial = {b"": 0}, [], 0, serial + 1
        if texts:
            yield from settle()

    return docs.select("doc_id", "held", "data").mapInArrow(run, ENCODED)


def count_words(encoded: DataFrame, total: int) -> DataFrame:
    """(block, local, c, home, first, alone, unit): the corpus count of each word of each block, and its unit.

    `home` is the first block and number that has the word, the same in all blocks; `alone` words are units by themselves.
    """
    every = Window.partitionBy("word")
    words = encoded.where("not is_doc").select("block", "local", "word", "n")
    words = words.withColumn("c", F.sum("n").over(every)).withColumn("home", F.min(F.struct("block", "local")).over(every))
    large = (F.col("c") > 0) & (F.col("c") * UNIT_SHARE >= total)
    tail = F.substring(F.col("word"), -2, 2)
    unit = F.when(F.octet_length("word") == 0, F.lit(END)).when(large, F.concat(F.lit(b"w"), "word")).otherwise(F.concat(F.lit(b"s"), tail))
    first, alone = F.col("home") == F.struct("block", "local"), (F.octet_length("word") == 0) | large
    return words.select("block", "local", "c", F.col("home.block").alias("home_block"), F.col("home.local").alias("home_local"), first.alias("first"), alone.alias("alone"), unit.alias("unit"))


class PairCounts:
    """How often one number follows another, folded as it grows."""

    def __init__(self) -> None:
        self.keys, self.n, self.held, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, before: np.ndarray, at: np.ndarray) -> None:
        self.held.append((before.astype(np.int64) << 16) | at)
        self.size += len(at)
        if self.size >= PAIRS_AT_ONCE:
            self.fold()

    def fold(self) -> None:
        if self.held:
            fresh, m = np.unique(np.concatenate(self.held), return_counts=True)
            keys, at = np.unique(np.concatenate([self.keys, fresh]), return_inverse=True)
            self.n = np.bincount(at, np.concatenate([self.n, m]), len(keys)).astype(np.int64)
            self.keys, self.held, self.size = keys, [], 0

    def columns(self) -> dict:
        self.fold()
        return {"a": (self.keys >> 16).astype(np.int32), "b": (self.keys & 0xFFFF).astype(np.int32), "n": self.n}


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers of `kind` as bytes, lowest bytes first."""
    data = np.ascontiguousarray(numbers.astype(kind))
    return zlib.compress(np.ascontiguousarray(data.view(np.uint8).reshape(len(data), -1).T).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    width_of = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(width_of, -1).T).view(kind).ravel()


#: Kind 0: a unit pair and its number. Kind 1: words of a block that are no units, with the units beside each occurrence.
#: Kind 2: the units and counts of all words of a block.
LAID = "kind int, a int, b int, n long, part int, block long, local binary, home_block binary, home_local binary, unit binary, times binary, nexts binary, prevs binary, counts binary"
_LOCALS = ("local", "home_block", "home_local", "unit", "times")
_WIDTHS = {"local": "<u4", "home_block": "<i8", "home_local": "<u4", "unit": "<u2", "times": "<u4", "nexts": "<u2", "prevs": "<u2"}


def lay_out(encoded: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """LAID, from the texts and the dictionary (block, local, c, u, rare, home_block, home_local) of each block.

    The words of a block go to `parts` parts by the hash of their home, so that a word's rows of all blocks meet.
    """
    own = ("local", "c", "u", "rare", "home_block", "home_local")
    left = words.select("block", F.lit(0).alias("kind"), *own, F.lit(None).cast("boolean").alias("held"), F.lit(None).cast("binary").alias("ids"))
    right = encoded.where("is_doc").select("block", F.lit(1).alias("kind"), *[F.lit(None).cast(words.schema[c].dataType).alias(c) for c in own], "held", "ids")
    dealt = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "kind", "local")

    def settle(block: int, table: dict, texts: list, pairs: PairCounts) -> Iterator[pa.RecordBatch]:
        u = table["u"].astype("<u2")
        yield _batch(LAID, {"kind": [2], "block": [block], "unit": [_packed(u, "<u2")], "counts": [_packed(table["c"], "<i8")]})
        at = np.concatenate([np.zeros(0, np.uint32), *texts])
        # a text ends with the end, which so stands before the first word of the next one
        before, after = np.concatenate([at[:1] * 0, at[:-1]]), np.concatenate([at[1:], at[:1] * 0])
        pairs.add(u[before], u[at])
        # also words that only held-out texts of the block have: other blocks say where they go
        local = np.flatnonzero(table["rare"])
        if not len(local):
            return
        spots = np.flatnonzero(table["rare"][at])
        spots = spots[np.argsort(at[spots], kind="stable")]
        times = np.bincount(at[spots], minlength=len(u))[local]
        home_block, home_local = table["home_block"][local], table["home_local"][local].astype(np.uint64)
        mixed = (home_block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + home_local) * np.uint64(0xD6E8FEB86659FD93)
        to = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        spots = spots[np.argsort(np.repeat(to, times), kind="stable")]
        order = np.argsort(to, kind="stable")
        to, local, times, home_block, home_local = to[order], local[order], times[order], home_block[order], home_local[order]
        cur, nxt, prv = at[spots], after[spots], before[spots]
        flat = {"nexts": np.where(nxt == cur, SELF, u[nxt]), "prevs": np.where(prv == cur, SELF, u[prv])}
        listed = {"local": local, "home_block": home_block, "home_local": home_local, "unit": u[local], "times": times}
        found, starts = np.unique(to, return_index=True)
        edges, ends = np.append(starts, len(to)), np.append(0, np.cumsum(times))
        out: dict[str, list] = {"kind": [1] * len(found), "part": found.tolist(), "block": [block] * len(found)}
        for columns, cuts in ((listed, edges), (flat, ends[edges])):
            for c, numbers in columns.items():
                out[c] = [_packed(numbers[lo:hi], _WIDTHS[c]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        yield _batch(LAID, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, block, table, texts = PairCounts(), None, {}, []
        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if lo == hi:
                    continue
                some = b.slice(lo, hi - lo)
                if blocks[lo] != block:
                    if block is not None:
                        yield from settle(block, _joined(table), texts, pairs)
                    block, table, texts = int(blocks[lo]), {c: [] for c in own}, []
                if kinds[lo] == 0:
                    for c in own:
                        table[c].append(some.column(c).to_numpy(zero_copy_only=False))
                else:
                    texts += [from_planes(ids) for ids, held in zip(some.column("ids").to_pylist(), some.column("held").to_pylist(), strict=True) if not held]
        if block is not None:
            yield from settle(block, _joined(table), texts, pairs)
        columns = pairs.columns()
        yield _batch(LAID, {"kind": np.zeros(len(columns["n"]), np.int32), **columns})

    return dealt.mapInArrow(run, LAID)


def _joined(table: dict[str, list]) -> dict[str, np.ndarray]:
    return {c: np.concatenate(some) for c, some in table.items()}


def _plog(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


MOVED = "block long, locals binary, classes binary, sums binary"


def likeliest(after: np.ndarray, before: np.ndarray, own: np.ndarray, now: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The class of each word (row) in which its bigrams are likeliest, by how often each class comes after and before it
    and itself after itself; the end's class, the last, is not one of them. Equal classes leave it where it is."""
    rows, times = np.arange(len(now)), before.sum(1) + own
    logs = (after @ trans.T + before @ trans + own[:, None] * np.diag(trans) + times[:, None] * emit)[:, :-1]
    best = np.argmax(logs, axis=1)
    return np.where(logs[rows, best] > logs[rows, now] + 1e-9, best, now)


def move_words(laid: DataFrame, of: np.ndarray, trans: np.ndarray, emit: np.ndarray, parts: int) -> DataFrame:
    """MOVED: the class of each word that is no unit, for each block that has it, by its neighbours in all blocks.

    `of` are the classes of the units. A row without a block has the tokens and the words of each class, of one part.
    """
    k = len(trans)
    near = laid.where("kind = 1").select("part", "block", *_LOCALS, "nexts", "prevs").repartition(parts, "part").sortWithinPartitions("part")

    def settle(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        some = {c: [_unpacked(r[c], _WIDTHS[c]) for r in rows] for c in (*_LOCALS, "nexts", "prevs")}
        lengths = [len(x) for x in some["local"]]
        every = _joined({c: some[c] for c in (*_LOCALS, "nexts", "prevs")})
        _, block = np.unique(every["home_block"], return_inverse=True)
        _, word = np.unique((block.astype(np.int64) << 32) | every["home_local"], return_inverse=True)
        size = int(word.max()) + 1
        owner = np.repeat(word, every["times"])
        own = np.bincount(owner[every["nexts"] == SELF], minlength=size)
        now = np.zeros(size, np.int64)
        now[word] = of[every["unit"]]
        sides = []
        for c in ("nexts", "prevs"):
            other = every[c] != SELF
            sides.append(np.unique(owner[other] * k + of[every[c][other]], return_counts=True))
        best = np.empty(size, np.int64)
        for lo in range(0, size, WORDS_AT_ONCE):
            hi = min(lo + WORDS_AT_ONCE, size)
            dense = []
            for keys, n in sides:
                i, j = np.searchsorted(keys, [lo * k, hi * k])
                one = np.zeros((hi - lo) * k)
                one[keys[i:j] - lo * k] = n[i:j]
                dense.append(one.reshape(-1, k))
            best[lo:hi] = likeliest(*dense, own[lo:hi], now[lo:hi], trans, emit)
        tokens = np.bincount(word, every["times"], size)
        sums = np.concatenate([np.bincount(best, tokens, k), np.bincount(best, minlength=k)])
        cuts = np.cumsum([0, *lengths])
        yield _batch(MOVED, {
            "block": [*[r["block"] for r in rows], None], "locals": [*[r["local"] for r in rows], None],
            "classes": [*[_packed(best[word[lo:hi]], "<u2") for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], None],
            "sums": [*[None] * len(rows), sums.astype("<f8").tobytes()],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if rows and rows[0]["part"] != row["part"]:
                    yield from settle(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from settle(rows)

    return near.mapInArrow(run, MOVED)


JOINED = "doc_id long, held boolean, n_tokens long, n_known long, count_logs double, units binary"


def attach(encoded: DataFrame, laid: DataFrame, moved: DataFrame, of: np.ndarray, parts: int) -> DataFrame:
    """JOINED: each text with the classes of its words (`units`), from its block's dictionary and what moved in it."""
    none = [F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("held", "boolean"))]
    dictionary = laid.where("kind = 2").select("block", F.lit(0).alias("kind"), F.col("unit").alias("x"), F.col("counts").alias("y"), *none)
    changes = moved.where("block is not null").select("block", F.lit(1).alias("kind"), F.col("locals").alias("x"), F.col("classes").alias("y"), *none)
    texts = encoded.where("is_doc").select("block", F.lit(2).alias("kind"), F.col("ids").alias("x"), F.lit(None).cast("binary").alias("y"), "doc_id", "held")
    dealt = dictionary.unionByName(changes).unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = logs = u = None
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                if row["kind"] == 0:
                    u, c = of[_unpacked(row["x"], "<u2")].astype("<u2"), _unpacked(row["y"], "<i8")
                    logs = np.log10(c + 1.0)
                elif row["kind"] == 1:
                    u[_unpacked(row["x"], "<u4")] = _unpacked(row["y"], "<u2")
                else:
                    at = from_planes(row["x"])
                    out.append((row["doc_id"], row["held"], len(at), int((c[at] > 0).sum()), float(logs[at].sum()), u[at].tobytes()))
            names = [x.split()[0] for x in JOINED.split(", ")]
            yield _batch(JOINED, {n: [r[i] for r in out] for i, n in enumerate(names)})

    return dealt.mapInArrow(run, JOINED)


def unit_pairs(texts: DataFrame, end: int) -> DataFrame:
    """(a, b, n): how often b follows a in training texts; the end stands before the first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = PairCounts()
        for b in batches:
            for units in b.column("units").to_pylist():
                u = np.frombuffer(units, "<u2").astype(np.int64)
                pairs.add(np.concatenate([[end], u[:-1]]), u)
        yield _batch("a int, b int, n long", pairs.columns())

    return texts.where("not held").select("units").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass
class Classes:
    """Class of each unit; the last class is that of the end alone."""

    of: np.ndarray
    pairs: np.ndarray  # class bigrams


def _neighbours(row: dict, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of the classes after and before a unit, without itself, and how often it follows itself."""
    out, own = [], 0
    for others, n in (("nexts", "next_n"), ("prevs", "prev_n")):
        at, m = np.array(row[others] or [], np.int64), np.array(row[n] or [], np.int64)
        me = at == row["u"]
        own = int(m[me].sum()) or own
        out.append(np.bincount(of[at[~me]], m[~me], k))
    return out[0], out[1], own


def best_class(after: np.ndarray, before: np.ndarray, own: int, now: int, pairs: np.ndarray, movable: int) -> int:
    """The class that gives the class bigrams the largest likelihood, if the unit is taken out and put in there.

    A unit in no movable class goes to one in any case.
    """
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    m = pairs.astype(float).copy()
    m[now, :] -= after
    m[:, now] -= before
    m[now, now] -= own
    # sums of the classes: the unit's neighbours keep their pairs with it, wherever it goes
    rows, cols = m.sum(1) + before, m.sum(0) + after
    k = np.arange(len(m))
    diag = m[k, k]
    gain = (f(m + after) - f(m)).sum(1) + (f(m + before[:, None]) - f(m)).sum(0)
    gain -= f(diag + after) - f(diag) + f(diag + before) - f(diag)
    gain += f(diag + after + before + own) - f(diag)
    gain -= f(rows + after.sum() + own) - f(rows) + f(cols + before.sum() + own) - f(cols)
    best = int(np.argmax(gain[:movable]))
    return best if now >= movable or gain[best] > gain[now] + 1e-9 else now


def likelihood(pairs: np.ndarray) -> float:
    """Of class bigrams, but for what no exchange changes."""
    return float(_plog(pairs).sum() - _plog(pairs.sum(1)).sum() - _plog(pairs.sum(0)).sum())


def exchange(pairs: DataFrame, sizes: np.ndarray, end: int, classes: int = CLASSES, rounds: int = ROUNDS) -> Classes:
    """Cluster units 0 to len(sizes) - 1 by exchange over all unit bigrams (a, b, n).

    The commonest units open the classes; the others wait in one beside them and are put in by size, each time as many as
    are in already. Then thirds of the units move, and a round's moves are kept if the likelihood is larger by them.
    """
    nexts = pairs.groupBy(F.col("a").alias("u")).agg(F.collect_list("b").alias("nexts"), F.collect_list("n").alias("next_n"))
    prevs = pairs.groupBy(F.col("b").alias("u")).agg(F.collect_list("a").alias("prevs"), F.collect_list("n").alias("prev_n"))
    # one row per unit, as many neighbours as units at most
    rows = _saved(nexts.join(prevs, "u", "full").repartition(UNIT_PARTS), "lm-units")
    of = np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[order != end]
    waiting = classes + 1
    of[order] = waiting
    of[order[:classes]] = np.arange(len(order[:classes]))
    of[end] = classes
    k = classes + 2

    def bigrams(of: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros((k, k))
            for b in batches:
                for row in b.select(["u", "nexts", "next_n"]).to_pylist():
                    m[of[row["u"]]] += np.bincount(of[np.array(row["nexts"] or [], np.int64)], np.array(row["next_n"] or [], np.int64), k)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

        return sum((np.frombuffer(bytes(r[0])).reshape(k, k) for r in rows.mapInArrow(run, "m binary").collect()), np.zeros((k, k)))

    def moved(of: np.ndarray, m: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for row in b.to_pylist():
                    u = row["u"]
                    if chosen[u]:
                        to = best_class(*_neighbours(row, of, k), int(of[u]), m, classes)
                        if to != of[u]:
                            out.append((u, to))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int32()) for j in (0, 1)], names=["u", "to"])

        moves = rows.mapInArrow(run, "u int, to int").collect()  # no more than there are units
        of = of.copy()
        of[[r[0] for r in moves]] = [r[1] for r in moves]
        return of

    m, placed = bigrams(of), classes
    while placed < len(order):
        chosen = np.zeros(len(sizes), bool)
        chosen[order[placed: 2 * placed]] = True
        of, placed = moved(of, m, chosen), 2 * placed
        m = bigrams(of)
    left = np.flatnonzero(of == waiting)  # units that no training text has
    of[left] = np.arange(len(left)) % classes
    for i in range(rounds):
        chosen = (np.arange(len(sizes)) + i) % 3 == 0
        chosen[end] = False
        to = moved(of, m, chosen)
        if (to != of).any():
            after = bigrams(to)
            if likelihood(after) > likelihood(m):
                of, m = to, after
    return Classes(of, m[:waiting, :waiting])


def score_tables(found: Classes, tokens: np.ndarray, types: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the transitions, and of the share that a count of one has in its class."""
    k = len(found.pairs)
    n_class, v_class = np.bincount(found.of, tokens, k), np.bincount(found.of, types, k)
    prior = (n_class + 1) / (n_class.sum() + k)
    trans = (found.pairs + alpha * prior) / (found.pairs.sum(1, keepdims=True) + alpha)
    emit = -np.log10(n_class + v_class + 1)
    return np.log10(trans), emit


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", classes: int = CLASSES) -> DataFrame:
    """RESULT for every text, with the model of those that are not held out."""
    spark = docs.sparkSession
    encoded = _saved(encode(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), utf8(text).alias("data"))), "lm-encoded")
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = _saved(count_words(encoded, total), "lm-words")
    units = words.where("first").groupBy("unit").agg(F.sum("c").alias("tokens"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("types"), F.bool_or("alone").alias("alone"))
    listed = units.collect()  # at most UNIT_SHARE words, all ends of two bytes, and the end
    vocabulary = sum(r["types"] for r in listed)
    kept = sorted(bytes(r["unit"]) for r in listed if bytes(r["unit"]) == END or (r["tokens"] and r["tokens"] * UNIT_SHARE >= total))
    names = [OTHER, *(kept or [END])]
    number = {name: i for i, name in enumerate(names)}
    tokens, types, alone_tokens, alone_types = (np.zeros(len(names)) for _ in range(4))
    for r in listed:
        i = number.get(bytes(r["unit"]), 0)
        tokens[i] += r["tokens"]
        types[i] += r["types"]
        if r["alone"]:
            alone_tokens[i], alone_types[i] = r["tokens"], r["types"]
    end = number[END]
    ids = cut_lineage(spark.createDataFrame([(k, i) for k, i in number.items()], "unit binary, u int"), "lm-unit-ids")
    rare = ~F.col("alone") & (F.col("c") > 0)
    numbered = words.join(ids, "unit", "left").select("block", "local", "c", F.coalesce("u", F.lit(0)).alias("u"), rare.alias("rare"), "home_block", "home_local")
    laid = _saved(lay_out(encoded, numbered, width(spark)), "lm-laid")
    pairs = laid.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    start = exchange(cut_lineage(pairs, "lm-pairs"), tokens, end, classes)
    moved = _saved(move_words(laid, start.of, *score_tables(start, tokens, types), width(spark)), "lm-moved")
    k = classes + 1
    sums = sum((np.frombuffer(bytes(r[0]), "<f8").reshape(2, k) for r in moved.where("block is null").select("sums").collect()), np.zeros((2, k)))  # a row per part
    texts = _saved(attach(encoded, laid, moved, start.of, width(spark)), "lm-texts")
    bigrams = np.zeros((k, k))
    for r in unit_pairs(texts, classes).collect():  # pairs of classes
        bigrams[r["a"], r["b"]] = r["n"]
    found = Classes(np.concatenate([start.of, np.arange(k)]), bigrams)
    trans, emit = score_tables(found, np.concatenate([alone_tokens, sums[0]]), np.concatenate([alone_types, sums[1]]))
    sent = spark.sparkContext.broadcast((trans, emit))  # by classes
    base = float(np.log10(total + vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trans, emit = sent.value
        for b in batches:
            logs = []
            for units in b.column("units").to_pylist():
                c = np.frombuffer(units, "<u2").astype(np.int64)
                logs.append(float(trans[np.concatenate([[classes], c[:-1]]), c].sum() + emit[c[:-1]].sum()))
            n, counts = b.column("n_tokens").to_numpy(), b.column("count_logs").to_numpy()
            ends = b.column("end_log").to_numpy()
            yield _batch(RESULT, {
                "doc_id": b.column("doc_id"), "held_out": b.column("held"), "n_tokens": n, "n_known": b.column("n_known"), "train_tokens": np.full(len(n), total),
                "base_score": counts - n * base, "score": np.array(logs) + counts - ends,
            })

    end_log = F.lit(float(np.log10(tokens[end] + 1.0)))  # the end is the only word of its class: it is certain there
    return texts.withColumn("end_log", end_log).mapInArrow(run, RESULT)
