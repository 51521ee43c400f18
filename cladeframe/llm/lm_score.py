"""Language-model scores by the subword lattice of an existing unigram vocabulary (operator 6)."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm._common import Scratch, in_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts travel to every task: the most frequent ones, so many at most, which bounds the broadcast.
HEAD_WORDS = 1 << 17
#: Words that a counting task holds before it hands them on.
FLUSH = 1 << 18
#: Weight of the existing scores against the shares counted in training words, whatever the corpus' size.
EXISTING = 0.1
_START = "▁"


class Lattice:
    """All segmentations of a word into vocabulary pieces; bytes stand in for characters that are no piece."""

    def __init__(self, pieces: dict[str, float], data: list[float]):
        """pieces: natural log probabilities; data: those of the 256 bytes."""
        self.bytes = data
        self.pieces: dict[str, float | None] = {}
        for piece in pieces:
            for n in range(1, len(piece)):
                self.pieces.setdefault(piece[:n], None)
        self.pieces |= pieces

    def _edges(self, s: str, at: int):
        table = self.pieces
        for to in range(at + 1, len(s) + 1):
            piece = s[at:to]
            p = table.get(piece, False)
            if p is False:
                break
            if p is not None:
                yield to, p
        if table.get(s[at]) is None:
            yield at + 1, sum(self.bytes[b] for b in s[at].encode("utf-8", "surrogatepass"))

    def log_probability(self, word: str) -> float:
        """Log-space forward recursion: the sum over all segmentations of a word and the space before it."""
        s = _START + word
        alpha = [-math.inf] * (len(s) + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for at in range(len(s)):
            have = alpha[at]
            for to, p in self._edges(s, at):
                x, y = have + p, alpha[to]
                alpha[to] = x if y == -math.inf else x + log1p(exp(y - x)) if x >= y else y + log1p(exp(x - y))
        return alpha[-1]

    def expected(self, word: str) -> dict[str | bytes, float]:
        """How often each piece occurs in a segmentation of the word, over all of them by their probability; bytes for characters that are no piece."""
        s = _START + word
        n = len(s)
        alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0
        edges = [list(self._edges(s, at)) for at in range(n)]
        exp, log1p = math.exp, math.log1p
        for at in range(n):
            have = alpha[at]
            for to, p in edges[at]:
                x, y = have + p, alpha[to]
                alpha[to] = x if y == -math.inf else x + log1p(exp(y - x)) if x >= y else y + log1p(exp(x - y))
        for at in range(n - 1, -1, -1):
            y = -math.inf
            for to, p in edges[at]:
                x = p + beta[to]
                y = x if y == -math.inf else x + log1p(exp(y - x)) if x >= y else y + log1p(exp(x - y))
            beta[at] = y
        out: dict[str | bytes, float] = {}
        total = alpha[n]
        for at in range(n):
            have = alpha[at] - total
            for to, p in edges[at]:
                w = exp(have + p + beta[to])
                if w > 1e-9:
                    piece = s[at:to]
                    key = piece if to > at + 1 or self.pieces.get(piece) is not None else piece.encode("utf-8", "surrogatepass")
                    out[key] = out.get(key, 0.0) + w
        return out


def existing_scores(path: str = VOCABULARY) -> tuple[dict[str, float], list[float]]:
    """Prior probabilities of the pieces and bytes from the vocabulary's scores.

    The scores of this public vocabulary are ranks, 0, -1, -2 ...; a piece of rank r gets a share 1 / (r + 2), as
    word ranks have. Bytes have no rank and get the share of the last one.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    last = max(score.values()) + 2
    total = sum(1 / (r + 2) for r in score.values()) + 256 / last
    return {piece: 1 / (r + 2) / total for piece, r in score.items()}, [1 / last / total] * 256


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at exactly the contract's spaces


def _count(batches):
    """word, count in training documents (0 for words of the others) by bounded runs of documents."""
    train, other = Counter(), set()

    def flush():
        words = [*train, *(w for w in other if w not in train)]
        counts = [train[w] for w in words]
        train.clear()
        other.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(counts, pa.int64())], names=["word", "c"])

    for batch in batches:
        for held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = _tokens(text.as_py())
            if held:
                other.update(words)
            else:
                train.update(words)
            if len(train) + len(other) >= FLUSH:
                yield flush()
    yield flush()


def _segment(lattice):
    def run(batches):
        pieces: dict[tuple[str, bool], float] = {}
        for batch in batches:
            model = lattice.value
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece, w in model.expected(word).items():
                    for key in [(f"<{b}>", True) for b in piece] if isinstance(piece, bytes) else [(piece, False)]:
                        pieces[key] = pieces.get(key, 0.0) + c * w
        keys = list(pieces)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.bool_()), pa.array([pieces[k] for k in keys], pa.float64())], names=["piece", "is_byte", "c"])

    return run


def _forward(lattice):
    def run(batches):
        for batch in batches:
            scores = [lattice.value.log_probability(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["word", "c", "lp"])

    return run


def _score_head(head):
    """Sums over the head words of each document, and its other words with their counts."""

    def run(batches):
        for batch in batches:
            table = head.value
            n, known, base, score, words, counts = [], [], [], [], [], []
            for text in batch.column(2):
                seen = Counter(_tokens(text.as_py()))
                k, b, s, rest, times = 0, 0.0, 0.0, [], []
                for word, c in seen.items():
                    row = table.get(word)
                    if row is None:
                        rest.append(word.decode("utf-8", "replace"))
                        times.append(c)
                    else:
                        k += c
                        b += c * row[0]
                        s += c * row[1]
                n.append(sum(seen.values()))
                known.append(k)
                base.append(b)
                score.append(s)
                words.append(rest)
                counts.append(times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "words", "known", "base", "score", "rest", "times"],
            )

    return run


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def lattice_scores(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Scores of all whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Needs doc_id and text; other columns are ignored. Training documents are those whose crc32 of the id as text is
    not divisible by 10 (a null id counts as an empty text). base_score is the smoothed word unigram of the contract.

    score is the log10 probability of the text under a unigram model over the pieces of an existing vocabulary,
    summed over all its segmentations: no piece spans a space, so a text factors into its words, each summed by
    log-space forward recursion, and an end. The existing scores weight all segmentations of the training words in one
    counting pass over the whole corpus, each piece by how often it is expected; the counted shares and the existing
    ones, with a weight of EXISTING, make the piece probabilities.

    Counts are of all documents. Each distinct word is segmented once, in a table of words; documents meet that
    table by a join on the word. The most frequent words, HEAD_WORDS at most, are broadcast instead, so no key of
    the join is hot and most tokens are never shuffled. The pieces collected are at most those of the vocabulary.
    A null text is empty and scores as its end; repeated rows count as often as they stand and each has its row.
    """
    spark = documents.sparkSession
    context = spark.sparkContext
    scratch = Scratch(spark, "lattice")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc % 10 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    words = scratch.write(docs.select("held_out", "text").mapInArrow(in_slices(_count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = docs.where(~F.col("held_out")).count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = total + ends, distinct + (1 if ends else 0)

    prior, data = existing_scores(vocabulary)
    first = context.broadcast(Lattice({k: math.log(p) for k, p in prior.items()}, [math.log(p) for p in data]))
    counted = words.where("c > 0").mapInArrow(in_slices(_segment(first)), "piece string, is_byte boolean, c double").groupBy("piece", "is_byte").agg(F.sum("c").alias("c")).collect()
    c_piece = {r["piece"]: r["c"] for r in counted if not r["is_byte"]}
    c_byte = {int(r["piece"][1:-1]): r["c"] for r in counted if r["is_byte"]}
    counts = sum(c_piece.values()) + sum(c_byte.values())
    weight = EXISTING if counts else 1.0
    share = lambda c, p: math.log((1 - weight) * (c / counts if counts else 0.0) + weight * p)
    # The end is a token of its own beside the pieces: its share is that of the training documents' ends.
    log_end, log_piece = math.log((ends + 1) / (counts + ends + 2)), math.log((counts + 1) / (counts + ends + 2))
    model = context.broadcast(Lattice({k: log_piece + share(c_piece.get(k, 0), p) for k, p in prior.items()}, [log_piece + share(c_byte.get(b, 0), p) for b, p in enumerate(data)]))
    scored = scratch.write(words.mapInArrow(in_slices(_forward(model)), "word string, c long, lp double"), "scored")
    scratch.drop("words")

    bottom = n + 0.1 * (v + 1)
    base = F.log10((F.col("c") + F.lit(0.1)) / F.lit(bottom))
    scored = scored.select("word", "c", base.alias("base"), (F.col("lp") / F.lit(math.log(10))).alias("lp"))
    # Classes of counts, an eighth of a doubling each, tell without a sort which counts the head can hold.
    step = F.floor(F.log2("c") * 8)
    least, held = None, 0
    for row in sorted(scored.where("c > 0").groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if (held := held + row["count"]) > HEAD_WORDS:
            break
        least = row["step"]
    in_head = (F.col("c") > 0) & (step >= F.lit(least if least is not None else 1 << 30))
    head = context.broadcast({r["word"].encode("utf-8", "surrogatepass"): (r["base"], r["lp"]) for r in scored.where(in_head).select("word", "base", "lp").toLocalIterator()})

    schema = "doc_id long, held_out boolean, words long, known long, base double, score double, rest array<string>, times array<long>"
    parts = scratch.write(docs.mapInArrow(in_slices(_score_head(head)), schema).withColumn("row", F.monotonically_increasing_id()), "parts")
    tail = parts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", F.col("t.rest").alias("word"), F.col("t.times").alias("times"))
    other = scored.where(~in_head)
    sums = tail.join(other, "word").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("lp")).alias("s"))
    sums = scratch.write(sums, "sums")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    end_base = math.log10((ends + 0.1) / bottom)
    end_score = log_end / math.log(10)
    return (
        parts.drop("rest", "times").join(sums, "row", "left").select(
            "doc_id", "held_out",
            (F.col("words") + 1).alias("n_tokens"),
            (F.col("known") + nought("k") + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + nought("b") + F.lit(end_base)).alias("base_score"),
            (F.col("score") + nought("s") + F.lit(end_score)).alias("score"),
        )
    )
