"""Toxicity by a subsequence string-kernel machine with Nystroem landmarks.

The kernel of two strings sums, over all triples of characters that stand in both
in order, powers of a decay for the lengths that the triples span, so strings with
gaps and inserted characters stay close; it is normalised to 1 for equal strings.
A document is scored by its worst windows: words, parts of long words, letters that
stand apart, and runs of consecutive words, joined whatever separates them, of up to
RUN letters.  Windows do not end at sentence ends, which insults can hold.  Runs
count from a margin of RUN_FROM on; a bound on the kernel, from short triples and
the greatest weight between two characters, leaves out only runs that can't reach
it.  Scoring covers every window of the whole text.

Labels are of documents, so training is by multiple instances on the windows of
labelled documents, not on labelled sentences, which the tables don't have: words,
word beginnings, parts of long words and runs that explain most toxic documents
give the first positive windows, words of clean documents the negative ones;
windows of clean documents that score highest join the negatives, and the machine
is trained again.  A linear machine on landmark features is one weight for each
triple, which is all that the workers get.  A logistic scale over a document's
three worst windows makes the score.

Only the fit is bounded: words of three letters or more, FIT_ROWS labelled documents, CANDIDATES words and as many
runs looked at as first positives, NEGATIVES words drawn and as many hard windows
added in each of ROUNDS rounds, LANDMARKS landmarks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.tables import read_table, written

#: Labelled rows that the fit uses at most, the smallest by hash of doc_id.
FIT_ROWS = 10_000
#: Words and runs of toxic documents considered as first positives (each), negatives drawn, and landmarks, at most.
CANDIDATES, NEGATIVES, LANDMARKS = 4000, 6000, 160
DECAY, CODES, SPAN = 0.5, 64, 16
ROUNDS = 2
#: Letters of a run of words at most, with marks at its ends a window; and the margin from which it counts.
RUN, RUN_FROM = SPAN - 2, -0.5
#: Triples that span up to EXACT characters are summed in a run's bound, up to NEAR bounded by their ends.
EXACT, NEAR = 6, 8
#: Texts and their characters that one call scores together, at most (a longer text has a call of its own).
BLOCK, BLOCK_CHARS = 64, 1 << 17
#: Pieces of texts whose runs are bounded at once.
SLICE = 8192
#: Worst windows of a document that make its score.
TOP = 3
SEED = 17

_SPACED = re.compile(r"(?<!\w)\w(?:[\W_]{1,3}\w){2,}(?!\w)")
_WORD = re.compile(r"\w+")
_I, _J, _K = (np.array(x) for x in zip(*[(i, j, k) for i in range(SPAN) for j in range(i + 1, SPAN) for k in range(j + 1, SPAN)], strict=True))
_WEIGHT = DECAY ** (_K - _I + 1.0)
_WITHIN = [np.flatnonzero(_K < width) for width in range(SPAN + 1)]


def windows(word: str) -> list[str]:
    """A word with marks at its ends, or overlapping parts of SPAN characters of a longer one."""
    word = f"^{word}$"
    if len(word) <= SPAN:
        return [word]
    return [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def words_in(text: str) -> tuple[set[str], list[str]]:
    """Distinct lower-case words, with letters that stand apart joined as well; and all letters and digits between other characters, in order."""
    text = text.lower()
    words = _WORD.findall(text)
    found = set(words)
    if _SPACED.search(text):
        found.update(re.sub(r"[\W_]+", "", m.group()) for m in _SPACED.finditer(text))
    return found, [p for w in words for p in w.split("_") if p] if "_" in text else words


def words_of(text: str) -> set[str]:
    return words_in(text)[0]


def coded(strings: list[str]) -> np.ndarray:
    """Character codes, 0 where a string has ended."""
    cut = [s[:SPAN] for s in strings]
    out = np.zeros((len(strings), SPAN), dtype=np.int64)
    out[np.arange(SPAN) < np.array([len(s) for s in cut], dtype=np.int64)[:, None]] = letter_codes("".join(cut))
    return out


def letter_codes(letters: str) -> np.ndarray:
    """The code of every letter of one string."""
    o = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where((o >= 97) & (o <= 122), o - 96, 27 + (o * 2654435761 >> 8) % (CODES - 27))


def runs_of(texts: list[list[str]]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the letters of texts, given as pieces, with starts and ends in them of every run of two or more pieces, and its text's place."""
    pieces = [p for t in texts for p in t]
    owners = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for at in range(0, len(pieces), SLICE):
        some, owner = pieces[at : at + SLICE + RUN], owners[at : at + SLICE + RUN]
        ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
        starts = np.concatenate([[0], ends[:-1]])
        first, last, of = [ends[:0]], [ends[:0]], [owner[:0]]
        for more in range(1, min(RUN, len(some))):
            to = min(SLICE, len(some) - more)
            a, b = starts[:to], ends[more : more + to]
            short = (b - a <= RUN) & (owner[:to] == owner[more : more + to])
            if not short.any():
                break
            first.append(a[short])
            last.append(b[short])
            of.append(owner[:to][short])
        yield "".join(some), np.concatenate(first), np.concatenate(last), np.concatenate(of)


def norms(codes: np.ndarray) -> np.ndarray:
    """Square root of each string's kernel with itself; codes may be cut to the longest string."""
    by_place = np.ascontiguousarray(codes.T)
    width = len(by_place)
    same = ((by_place[:, None] == by_place) & (by_place[:, None] > 0)).astype(np.float64) * DECAY**2
    t = same
    for _ in range(2):
        below, ahead = np.zeros_like(t), np.zeros_like(t)
        for i in range(1, width):
            below[i] = DECAY * (below[i - 1] + t[i - 1])
        for j in range(1, width):
            ahead[:, j] = DECAY * (ahead[:, j - 1] + below[:, j - 1])
        t = same / DECAY**2 * ahead
    return np.sqrt(t.sum(axis=(0, 1)))


def indexes(codes: np.ndarray) -> np.ndarray:
    """Index of every triple of the given places."""
    within = _WITHIN[codes.shape[1]]
    return (codes[:, _I[within]] * CODES + codes[:, _J[within]]) * CODES + codes[:, _K[within]]


def triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and weight of every triple; weight 0 beyond a string's end."""
    return indexes(codes), np.where(codes[:, _K] > 0, _WEIGHT, 0.0)


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = coded(strings)
    return *triples(codes), norms(codes)


def applied(table: np.ndarray, strings: list[str]) -> np.ndarray:
    """Normalised products of strings with a table of triple weights; strings of one length share a call."""
    out, codes = np.zeros(len(strings)), coded(strings)
    sizes = (codes > 0).sum(axis=1)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), 512):
            some = codes[rows[at : at + 512], :size]
            norm = norms(some)
            products = np.einsum("ij,j->i", table.take(indexes(some)), _WEIGHT[_WITHIN[size]])
            out[rows[at : at + 512]] = products / np.where(norm > 0, norm, 1)
    return out


class Machine:
    """Weights of triples, bias, and the scale (one factor for each of the worst margins, and a constant)."""

    def __init__(self, table: np.ndarray, bias: float, scale: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)):
        self.table, self.bias, self.scale = table.astype(np.float32), bias, scale
        self.seen: dict[str, float] = {}
        cube = self.table.reshape(CODES, CODES, CODES)
        self.ends = np.maximum(cube.max(axis=1), 0).ravel()
        self.open, self.close = (int(c) for c in letter_codes("^$"))
        length = np.arange(RUN + 1)
        far = [(d - 1) * DECAY ** (d + 1) * np.maximum(length + 2 - d, 0) for d in range(NEAR + 1, SPAN)]
        across = np.where(length < NEAR, length * DECAY ** (length + 2.0), 0) * self.ends[self.open * CODES + self.close]
        self.far = sum(far) * self.ends.max() + across
        # equal characters only add to a norm
        self.least = norms(np.where(np.arange(SPAN) < length[:, None] + 2, np.arange(SPAN) + 1, 0))

    def _between(self, i, middle: list, k) -> np.ndarray:
        """Weights of triples with ends i and k, summed over the middles; bounded if they are too far apart."""
        if len(middle) < EXACT:
            ends = i * (CODES * CODES) + k
            total = self.table.take(ends + middle[0] * CODES)
            for j in middle[1:]:
                total += self.table.take(ends + j * CODES)
            return total * DECAY ** (len(middle) + 2)
        return self.ends.take(i * CODES + k) * (len(middle) * DECAY ** (len(middle) + 2))

    def bounds(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Upper bounds of the kernel sums of runs, marks included."""
        size, n = last - first, len(codes)
        out = self.far[size].copy()
        padded = np.concatenate([np.zeros(NEAR, dtype=np.int64), codes, np.zeros(NEAR, dtype=np.int64)])
        marked = np.zeros((2, n + 1), dtype=bool)
        marked[0, first], marked[1, last] = True, True
        begins, stops = np.flatnonzero(marked[0]), np.flatnonzero(marked[1])
        opened, closed = np.zeros((2, n + 1), dtype=np.float32)
        for d in range(2, NEAR + 1):
            if n > d:
                total = np.zeros(n + 1)
                np.cumsum(self._between(codes[: n - d], [codes[j : n - d + j] for j in range(1, d)], codes[d:]), dtype=np.float64, out=total[d + 1 :])
                out += total[last] - total[np.minimum(first + d, last)]
            at, to = begins + NEAR - 1, stops + NEAR
            opened[begins] = self._between(self.open, [padded[at + j] for j in range(1, d)], padded[at + d])
            closed[stops] = self._between(padded[to - d], [padded[to - d + j] for j in range(1, d)], self.close)
            out += np.where(size >= d, opened[first] + closed[last], 0)
        return out + 1e-4

    def runs(self, texts: list[list[str]]) -> list[set[str]]:
        """For texts, given as pieces, the distinct runs whose margin may reach RUN_FROM."""
        out: list[set[str]] = [set() for _ in texts]
        for letters, first, last, owner in runs_of(texts):
            reach = (RUN_FROM - self.bias) * self.least[last - first] if self.bias < RUN_FROM else -np.inf
            able = np.flatnonzero(self.bounds(letter_codes(letters), first, last) >= reach)
            for a, b, text in zip(first[able].tolist(), last[able].tolist(), owner[able].tolist(), strict=True):
                out[text].add(letters[a:b])
        return out

    def margins(self, words: list[str]) -> list[float]:
        parts = [windows(w) for w in words]
        flat = applied(self.table, [p for x in parts for p in x]) + self.bias
        return np.maximum.reduceat(flat, np.cumsum([0, *map(len, parts[:-1])])).tolist() if words else []

    def _block(self, texts: list[str]) -> list[tuple[list[float], str]]:
        own, pieces = zip(*map(words_in, texts), strict=True)
        joined = [r - w for r, w in zip(self.runs(list(pieces)), own, strict=True)]
        if len(self.seen) > 400_000:
            self.seen.clear()
        new = [w for w in set().union(*own, *joined) if w not in self.seen]
        if new:
            self.seen.update(zip(new, self.margins(new), strict=True))
        out = []
        for words, runs in zip(own, joined, strict=True):
            counted = [*words, *(w for w in runs if self.seen[w] >= RUN_FROM)]
            found = list(map(self.seen.__getitem__, counted))
            top = sorted(found, reverse=True)[:TOP]
            word = max((w for w, m in zip(counted, found, strict=True) if m == top[0]), default="")
            out.append((top + [self.bias] * (TOP - len(top)), word))
        return out

    def worst(self, texts: list[str | None]) -> list[tuple[list[float], str]]:
        """For each text the three highest margins of its words and runs, and the worst of them; missing ones have the bias alone."""
        out, block, chars = [], [], 0
        for text in texts:
            if block and (len(block) == BLOCK or chars + len(text or "") > BLOCK_CHARS):
                out += self._block(block)
                block, chars = [], 0
            block.append(text or "")
            chars += len(text or "")
        return out + self._block(block) if block else out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss, by dual coordinate descent; the last column of x is the bias."""
    rng = np.random.default_rng(SEED)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = 1 / (2 * cost)
    q = (x * x).sum(axis=1) + diagonal
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = max(alpha[i] - (y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]) / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def trained(positive: list[str], negative: list[str], landmarks: int = LANDMARKS) -> Machine:
    """A machine from positive and negative windows, on at most so many landmarks of both kinds."""
    if not positive or not negative:
        return Machine(np.zeros(CODES**3), -1.0)
    marks = list(dict.fromkeys(positive[: landmarks * 3 // 4] + negative[: landmarks // 4]))
    index, weight, norm = features(marks)
    ok = norm > 0
    marks, index, weight, norm = [m for m, k in zip(marks, ok, strict=True) if k], index[ok], weight[ok], norm[ok]
    # only triples of landmarks matter: a row of weights for each landmark over those, 0 in the last column
    known, place = np.unique(index[weight > 0], return_inverse=True)
    compact = np.full(CODES**3, len(known), dtype=np.int32)
    compact[known] = np.arange(len(known), dtype=np.int32)
    rows = np.zeros((len(marks), len(known) + 1), dtype=np.float32)
    owner = np.repeat(np.arange(len(marks)), (weight > 0).sum(axis=1))
    np.add.at(rows, (owner, place), (weight / norm[:, None])[weight > 0])

    def products(strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(marks)))
        for at in range(0, len(strings), 128):
            i, v, n = features(strings[at : at + 128])
            i, v = compact[i], (v / np.where(n > 0, n, 1)[:, None]).astype(np.float32)
            for m in range(len(marks)):
                out[at : at + 128, m] = (rows[m][i] * v).sum(axis=1)
        return out

    among = products(marks)
    values, vectors = np.linalg.eigh((among + among.T) / 2 + 1e-6 * np.eye(len(marks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    x = np.hstack([products(positive + negative) @ root, np.ones((len(positive) + len(negative), 1))])
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.where(y > 0, len(negative) / max(len(positive), 1), 1.0)
    w = _svm(x, y, np.clip(cost, 0.1, 50))
    table = np.zeros(CODES**3, dtype=np.float32)
    table[known] = (root @ w[:-1]) @ rows[:, :-1]
    return Machine(table, float(w[-1]))


def explaining(rows: list[tuple[str, list[int], int]], n_toxic: int, n_clean: int) -> list[str]:
    """Words and beginnings that explain toxic documents: greedily the one in most documents not yet explained.

    rows: string, the toxic documents it stands in, the number of clean ones.  A
    string counts only if it is at least 10 times as frequent in toxic documents,
    with one clean document added against chance, and explains three or more.
    """
    left = [(w, set(d)) for w, d, clean in rows if len(d) / max(n_toxic, 1) >= 10 * (clean + 1) / max(n_clean, 1)]
    open_docs: set[int] = set().union(*[d for _, d in left]) if left else set()
    chosen: list[str] = []
    while left:
        word, docs = max(left, key=lambda x: (len(x[1]), len(x[0]), x[0]))
        if len(docs) < 3:
            break
        chosen.append(word)
        open_docs -= docs
        left = [(w, d & open_docs) for w, d in left if w != word]
    return chosen


def _worst(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    machine = Machine(*shared.value)
    for batch in batches:
        found = machine.worst(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([m for m, _ in found], pa.list_(pa.float64())), pa.array([w for _, w in found], pa.string())],
            names=["doc_id", "margins", "word"])


def worst_windows(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, the TOP highest margins of every text, and the word of the first.

    The machine is broadcast: CODES**3 weights, 1 MB whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.table, machine.bias, machine.scale))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda b: _worst(b, shared), "doc_id long, margins array<double>, word string")


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct marked words, parts of longer ones, and word beginnings of 4 to 7 characters."""
    for batch in batches:
        for i, y, t in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = [w for w in words_of(t or "") if len(w) > 2]
            out = [*{p for w in words for p in windows(w)}, *{f"^{w[:n]}" for w in words for n in range(4, min(len(w), 8))}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(out), pa.int64()), pa.array([y] * len(out), pa.int32()), pa.array(out, pa.string())], names=["doc_id", "toxic", "word"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct marked runs that aren't among its words."""
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words, pieces = words_in(t or "")
            runs = {letters[a:b] for letters, first, last, _ in runs_of([pieces]) for a, b in zip(first.tolist(), last.tolist(), strict=True)}
            out = [f"^{w}$" for w in runs - words if len(w) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(out), pa.int64()), pa.array(out, pa.string())], names=["doc_id", "word"])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Machine:
    """A machine from labelled documents (doc_id, toxic), at most `most` of them.

    The driver gets at most CANDIDATES words with the toxic documents they stand
    in, NEGATIVES words, and the margins of each fitted row.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)").dropDuplicates(["doc_id"]).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most))
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known), "doc_id").withColumn("copy", F.xxhash64("text", "toxic")).dropDuplicates(["copy"]).drop("copy"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Machine(np.zeros(CODES**3), -1.0)
    words = written(
        rows.select("doc_id", "toxic", "text").mapInArrow(_word_rows, "doc_id long, toxic int, word string")
        .groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"),
                             F.collect_list(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("docs")), "words")
    odd = F.col("bad") / sizes[1] >= 10 * F.col("good") / sizes[0]
    some = words.where(odd & (F.col("bad") > 1)).orderBy(F.desc("bad"), "good", "word").limit(CANDIDATES).collect()
    # runs of clean documents are counted only where three toxic ones have them
    runs = [rows.where(F.col("toxic") == y).select("doc_id", "text").mapInArrow(_run_rows, "doc_id long, word string") for y in (0, 1)]
    often = written(runs[1].groupBy("word").agg(F.count("*").alias("bad"), F.collect_list("doc_id").alias("docs")).where("bad > 2"), "runs")
    good = runs[0].join(F.broadcast(often.select("word")), "word").groupBy("word").agg(F.count("*").alias("good"))
    joined = often.join(good, "word", "left").na.fill(0, ["good"]).where(odd).orderBy(F.desc("bad"), "good", "word").limit(CANDIDATES).collect()
    chosen = explaining([(r["word"], r["docs"], r["good"]) for r in [*some, *joined]], sizes[1], sizes[0])
    starts = tuple(c for c in chosen if c[-1] != "$")
    family = [r["word"] for r in some if r["word"][-1] == "$" and starts and r["word"].startswith(starts)]
    positive = list(dict.fromkeys([*chosen, *family]))
    common = F.xxhash64(F.lit(SEED), "word").bitwiseAND(0xFFFFFFFF) / F.log2(F.col("good") + 1)
    drawn = words.where("good > 0 AND word LIKE '%$'").orderBy(common, "word").limit(NEGATIVES).collect()
    negative = [r["word"] for r in drawn if r["word"] not in set(positive)]
    machine = trained(positive, negative)
    for again in range(ROUNDS, -1, -1):
        top = worst_windows(rows, machine).join(rows.select("doc_id", "toxic"), "doc_id").select("toxic", "margins", "word").collect()
        if not again:
            break
        hard = {w for r in top if not r["toxic"] and r["margins"][0] > -0.5 for w in windows(r["word"])} - set(positive)
        negative = sorted(hard)[:NEGATIVES] + [n for n in negative if n not in hard]
        machine = trained(positive, negative)
    machine.scale = logistic(np.array([r["margins"] for r in top]), np.array([r["toxic"] for r in top], dtype=float))
    return machine


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Factors of the margins and a constant, by Newton's method."""
    x = np.hstack([np.clip(x, -3, 3), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - y) + ridge * len(x) * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _probability(machine: Machine) -> Column:
    z = F.lit(machine.scale[-1])
    for i, factor in enumerate(machine.scale[:-1]):
        z = z + F.lit(factor) * F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("margins")[i]))
    return 1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), z))))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) and word (the worst window's) of every document.

    Nulls and edge cases: null, empty and wordless texts get the bias's score;
    null ids stay; repeated rows get equal scores; empty tables give empty
    results; without labels of both kinds every score is below 0.5.
    """
    return (
        worst_windows(docs, machine).select("doc_id", _probability(machine).alias("score"), "word")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def _marked(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    machine = Machine(*shared.value)
    for batch in batches:
        found = [m for m, _ in machine.worst(batch.column("text").cast(pa.string()).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "margins"])


def marked(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with _predicted (0 or 1), whole rows passing through the scoring, without a join.

    Existing columns named margins or _predicted are replaced; the rules of `score` hold.
    """
    plain = docs.drop("margins", "_predicted")
    shared = docs.sparkSession.sparkContext.broadcast((machine.table, machine.bias, machine.scale))
    schema = T.StructType([*plain.schema.fields, T.StructField("margins", T.ArrayType(T.DoubleType()))])
    return plain.mapInArrow(lambda b: _marked(b, shared), schema).withColumn("_predicted", (_probability(machine) >= 0.5).cast("int")).drop("margins")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of held-out documents are not used."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    machine = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, machine).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "word")
