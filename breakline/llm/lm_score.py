"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts. Texts are dealt into blocks; each block sends the 64-bit hashes and training counts of its distinct tokens to shards,
packed. A shard sums them over all blocks and answers each block with the totals in the same order, so every token's count
over the whole corpus is known where the token stands, and a token in every document is one entry per block.

Model. The model's units are the end, the most frequent training tokens, and ``CLASSES`` classes of all other tokens, by a hash of a
token's last bytes; ``MODEL_WORDS`` units in all, each with vectors. The two units before predict the next: score(u) = (C1 r1 + C2 r2) . q_u + b_u.
A token of a class gets the probability of its class times its share (count + 1) in that class over the whole corpus, one part of each class
being kept for tokens never seen. So the vocabulary is all of the corpus, in two levels, and the part that grows is counted, not trained. Every task trains on its
own share of the training documents with numpy, by noise-contrastive estimation against the unigram distribution; the tasks' parameters are
averaged, weighted by tokens, after each of ``ROUNDS`` rounds over another part of the documents, and the next round starts from the average. Scoring is normalised: for
A1 = E C1 Q' and A2 = E C2 Q' + b the normaliser of all pairs of contexts is one matrix product, log(exp(A1) exp(A2)').

Hashes of 64 bits stand for tokens: for a thousand million distinct tokens the chance that any two are taken for one is below 3 %.

Defined results: null text is empty text, whose only token is the end. A null id counts as empty text for the fold. Without any training
token the base is log10(1) and the model is uniform over its units. Repeated rows repeat; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_count, block_of, materialise, text_batches, text_bytes

#: Units with vectors, and how many of them are classes.
MODEL_WORDS = 2048
CLASSES = 1024
#: Bytes at a token's end that tell its class.
_TAIL = 4
#: Parts of the documents, each of which is one round of training.
ROUNDS = 4
WIDTH = 16
#: Noise tokens that each step draws, shared by its positions.
NOISE = 96
STEP = 4096
RATE = 0.08
#: Where the sums of squared gradients, by which steps shrink, begin; they are averaged and go on over the rounds, too.
_LEAST_SQUARE = 1e-8
#: The end's number; the classes follow it, then the words. 0 is no unit, and no token has it.
_END = 1
#: No word holds white space, so this is the end's own key.
_END_KEY = b"\n"
#: Distinct tokens that a shard holds, about, at a token for each 8 bytes of text at most.
SHARD_BYTES = 32 << 20
#: Positions that a task shuffles and passes over at once.
_AT_ONCE = 1 << 19
#: Text that a task reads, about; only for the number of groups that average.
_TASK_BYTES = 16 << 20
#: Parameters that one group averages at once, about: the averages form a tree of this width.
_AVERAGED = 8

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at white space (space, tab to carriage return); then the end."""
    return [*text.lower().split(), _END_KEY] if text else [_END_KEY]


def _hash(words) -> np.ndarray:
    words = list(words)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _classes(words) -> np.ndarray:
    """The class of each token, by its last bytes."""
    words = list(words)
    return (np.fromiter((xxhash.xxh3_64_intdigest(w[-_TAIL:]) for w in words), np.uint64, len(words)) % np.uint64(CLASSES)).astype(np.uint16)


def _block_words(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's distinct tokens in order, how often each stands in training documents, and its class."""
    count: dict[bytes, int] = {}
    every: set[bytes] = set()
    for held, text in zip(block.column("held_out").to_pylist(), block.column("text").cast(pa.binary()), strict=True):
        tokens = tokens_of(text.as_py())
        if held:
            every.update(tokens)
        else:
            for t in tokens:
                count[t] = count.get(t, 0) + 1
    every.update(count)
    words = list(every)
    h = _hash(words)
    n = np.fromiter((count.get(w, 0) for w in words), np.int64, len(words))
    keys, first, at = np.unique(h, return_index=True, return_inverse=True)
    return keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64) if len(first) < len(h) else n[first], _classes(words)[first]


def _ask(shards: int):
    """A block's distinct tokens, packed for each shard."""

    def run(block: pa.Table) -> pa.Table:
        keys, n, cls = _block_words(block)
        shard = (keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        keys, n, cls, shard = keys[order], n[order], cls[order], shard[order]
        cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        number = block.column("block")[0].as_py()
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        return pa.table({
            "shard": pa.array([int(shard[a]) for a, _ in spans], pa.int32()),
            "block": pa.array([number] * len(spans), pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            "counts": pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
            "classes": pa.array([cls[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    return run


def _total(most: int):
    """A shard's totals: for each block in the order it asked; and, in a row without a block, sums and the most frequent tokens."""

    def run(asked: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in asked.column("keys").to_pylist()]
        counts = [np.frombuffer(c, np.uint32).astype(np.int64) for c in asked.column("counts").to_pylist()]
        every, one, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        cls = np.concatenate([np.frombuffer(c, np.uint16) for c in asked.column("classes").to_pylist()])[one]
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        told = [total[at[b - len(k) : b]] for k, b in zip(keys, ends, strict=True)]
        first = np.lexsort((every, -total))[:most]
        first = first[total[first] > 0]
        n = len(keys) + 1
        return pa.table({
            "shard": pa.array([asked.column("shard")[0].as_py()] * n, pa.int32()),
            "block": pa.array([*asked.column("block").to_pylist(), None], pa.int32()),
            "keys": pa.array([None] * len(keys) + [every[first].tobytes()], pa.binary()),
            "counts": pa.array([*(t.tobytes() for t in told), total[first].tobytes()], pa.binary()),
            "n": pa.array([None] * len(keys) + [int(total.sum())], pa.int64()),
            "v": pa.array([None] * len(keys) + [int((total > 0).sum())], pa.int64()),
            "classes": pa.array([None] * len(keys) + [cls[first].tobytes()], pa.binary()),
            "class_n": pa.array([None] * len(keys) + [np.bincount(cls, weights=total, minlength=CLASSES).astype(np.int64).tolist()], pa.list_(pa.int64())),
            "class_v": pa.array([None] * len(keys) + [np.bincount(cls[total > 0], minlength=CLASSES).astype(np.int64).tolist()], pa.list_(pa.int64())),
        })

    return run


class Vocabulary:
    """The model's units by number: the end, the classes, then words by frequency; and what each class holds besides those words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray, n: int, v: int, class_n: np.ndarray, class_v: np.ndarray, size: int):
        end = _hash([_END_KEY])[0]
        ends = int(counts[keys == end].sum())
        order = np.lexsort((keys, -counts))
        order = order[keys[order] != end][: max(size - 2 - CLASSES, 0)]
        self.keys = keys[order]
        self.n, self.v = n, v
        end_class = int(_classes([_END_KEY])[0])
        self.class_n = class_n - np.bincount(classes[order], weights=counts[order], minlength=CLASSES).astype(np.int64)
        self.class_v = class_v - np.bincount(classes[order], minlength=CLASSES)
        self.class_n[end_class] -= ends
        self.class_v[end_class] -= ends > 0
        self.counts = np.concatenate(([0, ends], self.class_n, counts[order])).astype(np.float64)
        self._sorted = np.argsort(self.keys)
        self._end = end

    def __len__(self) -> int:
        return len(self.counts)

    def numbers(self, h: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The unit of each token, by its hash and class."""
        out = classes.astype(np.int32) + 2
        if len(self.keys):
            s = self.keys[self._sorted]
            at = np.minimum(np.searchsorted(s, h), len(s) - 1)
            out = np.where(s[at] == h, self._sorted[at] + 2 + CLASSES, out).astype(np.int32)
        out[h == self._end] = _END
        return out

    def share(self, numbers: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a token's share in its unit: 0 for the end and words."""
        cls = np.clip(numbers - 2, 0, CLASSES - 1)
        inside = np.log10((count + 1) / (self.class_n[cls] + self.class_v[cls] + 1))
        return np.where((numbers > _END) & (numbers < CLASSES + 2), inside, 0.0)


class LogBilinear:
    """Parameters in one flat array: E, Q, C1, C2, b."""

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 1):
        self.v, self.d = len(unigram), width
        self.noise = (unigram + 0.5) / (unigram + 0.5).sum()
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.1, (self.v, width))
        q = rng.normal(0, 0.1, (self.v, width))
        self.flat = np.concatenate((e.ravel(), q.ravel(), np.eye(width).ravel() * 0.5, np.eye(width).ravel() * 0.3, np.log(self.noise))).astype(np.float32)

    def parts(self, flat: np.ndarray | None = None):
        flat = self.flat if flat is None else flat
        v, d = self.v, self.d
        a, b = v * d, 2 * v * d
        return flat[:a].reshape(v, d), flat[a:b].reshape(v, d), flat[b : b + d * d].reshape(d, d), flat[b + d * d : b + 2 * d * d].reshape(d, d), flat[b + 2 * d * d :]

    def train(self, tokens: np.ndarray, rng: np.random.Generator, square: np.ndarray) -> None:
        """One pass over positions (before last, last, next) by noise-contrastive estimation, with Adagrad."""
        e, q, c1, c2, b = self.parts()
        se, sq, s1, s2, sb = self.parts(square)
        log_kq = np.log(self.noise * NOISE).astype(np.float32)
        cumulated = np.cumsum(self.noise)
        for i in range(0, len(tokens), STEP):
            x, y, w = tokens[i : i + STEP].T
            noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), self.v - 1)
            ex, ey, qw, qn = e[x], e[y], q[w], q[noise]
            h = ex @ c1 + ey @ c2
            gp = 1 / (1 + np.exp((h * qw).sum(axis=1) + b[w] - log_kq[w])) / len(w)
            gn = -1 / (1 + np.exp(-(h @ qn.T + b[noise] - log_kq[noise]))) / len(w)
            gh = gp[:, None] * qw + gn @ qn
            for par, sq_par, grad in ((c1, s1, ex.T @ gh), (c2, s2, ey.T @ gh)):
                sq_par += grad * grad
                par += RATE * grad / np.sqrt(sq_par)
            for par, sq_par, at, grad in ((e, se, np.concatenate((x, y)), np.concatenate((gh @ c1.T, gh @ c2.T))), (q, sq, np.concatenate((w, noise)), np.concatenate((gp[:, None] * h, gn.T @ h))), (b, sb, np.concatenate((w, noise)), np.concatenate((gp, gn.sum(axis=0)))) ):
                self._step(par, sq_par, at, grad)

    def _step(self, par, square, at, grad) -> None:
        order = np.argsort(at, kind="stable")
        at, grad = at[order], grad[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        total = np.add.reduceat(grad, first, axis=0)
        rows = at[first]
        square[rows] += total * total
        par[rows] += RATE * total / np.sqrt(square[rows])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A1, A2 and the normaliser of each pair of contexts."""
        e, q, c1, c2, b = self.parts()
        a1 = (e @ c1) @ q.T
        a2 = (e @ c2) @ q.T + b
        m1, m2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
        z = np.log(np.maximum(np.exp(a1 - m1) @ np.exp(a2 - m2).T, 1e-30)) + m1 + m2.T
        return a1, a2, z


def _positions(numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(before last, last, this) of each token; a document starts after two ends. ``ends``: index after each document."""
    y = np.concatenate(([_END], numbers[:-1])) if len(numbers) else numbers
    x = np.concatenate(([_END, _END], numbers[:-2])) if len(numbers) > 1 else np.full(len(numbers), _END, np.int32)
    start = np.concatenate(([0], ends[:-1]))
    x[start] = _END
    second = start + 1
    x[second[second < ends]] = _END
    return np.stack((x, y, numbers), axis=1)


def _train(vocabulary: Vocabulary, start: np.ndarray, square: np.ndarray, groups: int):
    """A task's parameters and summed squares after training on its documents, with the number of tokens."""

    def run(batches):
        own, squares, seen, rng = None, None, 0, None
        known: dict[bytes, int] = {}
        numbers: list[int] = []
        ends: list[int] = []

        def pass_over() -> None:
            nonlocal own, squares, rng, seen
            if own is None:
                own = LogBilinear(vocabulary.counts)
                own.flat, squares = start.copy(), square.copy()
                rng = np.random.default_rng(len(numbers))
            tokens = _positions(np.array(numbers, np.int32), np.array(ends))
            own.train(tokens[rng.permutation(len(tokens))], rng, squares)
            seen += len(numbers)
            numbers.clear()
            ends.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                tokens = tokens_of(text.as_py())
                got = list(map(known.get, tokens))
                if None in got:
                    if len(known) > 500_000:
                        known.clear()
                    new = [t for t in set(tokens) if t not in known]
                    known.update(zip(new, vocabulary.numbers(_hash(new), _classes(new)).tolist(), strict=True))
                    got = [known[t] for t in tokens]
                numbers.extend(got)
                ends.append(len(numbers))
                if len(numbers) >= _AT_ONCE:
                    pass_over()
        if numbers:
            pass_over()
        if own is not None:
            group = int(xxhash.xxh3_64_intdigest(own.flat[:64].tobytes()) % groups)
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([np.concatenate((own.flat, squares)).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["g", "flat", "n"])

    return run


def _average(shares: pa.Table) -> pa.Table:
    total, n = None, 0
    for flat, k in zip(shares.column("flat"), shares.column("n").to_pylist(), strict=True):
        part = np.frombuffer(flat.as_py(), np.float32).astype(np.float64) * k
        total, n = part if total is None else total + part, n + k
    return pa.table({"g": pa.array([0], pa.int32()), "flat": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def train(texts: DataFrame, vocabulary: Vocabulary, n_bytes: int, rounds: int = ROUNDS) -> LogBilinear:
    """Train on all rows of ``texts`` (text), about ``n_bytes`` of it: each row in one of the rounds."""
    model = LogBilinear(vocabulary.counts)
    tree = _AVERAGED
    while tree * _AVERAGED < n_bytes // rounds // _TASK_BYTES:
        tree *= _AVERAGED
    part = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(rounds))
    square = np.full(len(model.flat), _LEAST_SQUARE, np.float32)
    for k in range(rounds):
        groups = tree
        shares = texts.where(part == k).select("text").mapInArrow(_train(vocabulary, model.flat, square, groups), "g int, flat binary, n long")
        while True:
            shares = materialise(shares.groupBy("g").applyInArrow(_average, "g int, flat binary, n long"), "averages")
            if groups == 1:
                break
            groups //= _AVERAGED
            shares = shares.withColumn("g", F.pmod(F.xxhash64("flat"), F.lit(groups)).cast("int"))
        if got := shares.first():  # one model of a fixed size
            model.flat, square = np.split(np.frombuffer(got["flat"], np.float32).copy(), 2)
    return model


def _score(shards: int, vocabulary: Vocabulary, model: LogBilinear):
    tables: list = []

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not tables:
            tables.extend(model.tables())
        a1, a2, z = tables
        words: dict[bytes, int] = {}
        numbers: list[int] = []
        ends: list[int] = []
        for text in docs.column("text").cast(pa.binary()):
            for t in tokens_of(text.as_py()):
                numbers.append(words.setdefault(t, len(words)))
            ends.append(len(numbers))
        at, ends = np.array(numbers, np.int32), np.array(ends, np.int64)
        del numbers
        h = _hash(words)
        keys = np.unique(h)
        # the shards' answers follow the order in which the block asked
        shard = (keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        answer = [np.frombuffer(c, np.int64) for _, c in sorted(zip(told.column("shard").to_pylist(), told.column("counts").to_pylist(), strict=True))]
        total = np.empty(len(keys), np.int64)
        total[order] = np.concatenate(answer) if answer else 0
        count = total[np.searchsorted(keys, h)]
        base = np.log10((count + 1) / (vocabulary.n + (vocabulary.v + 1)))
        number = vocabulary.numbers(h, _classes(words))
        share = vocabulary.share(number, count)
        out: dict[str, list] = {"known": [], "base": [], "score": []}
        start = np.concatenate(([0], ends[:-1]))
        for i in range(0, len(ends), 256):  # documents at a time
            lo, hi = int(start[i]), int(ends[min(i + 256, len(ends)) - 1])
            w = at[lo:hi]
            x, y, m = _positions(number[w], ends[i : i + 256] - lo).T
            p = (a1[x, m] + a2[y, m] - z[x, y]).astype(np.float64) / np.log(10) + share[w]
            cut = start[i : i + 256] - lo
            out["known"].append(np.add.reduceat((count[w] > 0).astype(np.int64), cut))
            out["base"].append(np.add.reduceat(base[w], cut))
            out["score"].append(np.add.reduceat(p, cut))
        known, base_score, score = (np.concatenate(v) if v else np.zeros(0) for v in out.values())
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(ends - start, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(ends), vocabulary.n), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", model_words: int = MODEL_WORDS) -> DataFrame:
    """Train on the rows that aren't ``held_out`` and score every row."""
    text_batches(docs)
    n_bytes = text_bytes(docs, text_col)
    blocks, shards = block_count(n_bytes), block_count(n_bytes, SHARD_BYTES)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"), block_of(docs[id_col], docs[text_col], blocks).alias("block"))
    asked = own.groupBy("block").applyInArrow(_ask(shards), "shard int, block int, keys binary, counts binary, classes binary")
    told = materialise(asked.groupBy("shard").applyInArrow(_total(model_words), "shard int, block int, keys binary, counts binary, n long, v long, classes binary, class_n array<long>, class_v array<long>"), "totals")
    sums = told.where(F.col("block").isNull())
    n, v = sums.agg(F.sum("n"), F.sum("v")).first()
    keys, counts, classes = _most_frequent(sums, model_words)
    per = {r["cls"]: (r["n"], r["v"]) for r in sums.select(F.posexplode(F.arrays_zip("class_n", "class_v")).alias("cls", "x")).groupBy("cls").agg(F.sum("x.class_n").alias("n"), F.sum("x.class_v").alias("v")).collect()}
    class_n, class_v = (np.array([per.get(c, (0, 0))[i] for c in range(CLASSES)], np.int64) for i in (0, 1))
    vocabulary = Vocabulary(keys, counts, classes, n or 0, v or 0, class_n, class_v, model_words)
    model = train(own.where(~F.col("held_out")), vocabulary, n_bytes)
    answers = told.where(F.col("block").isNotNull()).select("block", "shard", "counts")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shards, vocabulary, model), SCHEMA)


def _most_frequent(sums: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent tokens over all shards, with counts and classes."""

    def rows(batches):
        for batch in batches:
            for k, c, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(c, np.int64)), pa.array(np.frombuffer(x, np.uint16).astype(np.int32))], names=["key", "count", "cls"])

    first = sums.select("keys", "counts", "classes").mapInArrow(rows, "key long, count long, cls int").orderBy(F.desc("count"), "key").limit(most).collect()
    return np.array([r["key"] for r in first], np.int64).view(np.uint64), np.array([r["count"] for r in first], np.int64), np.array([r["cls"] for r in first], np.int64)
