"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Training.  zstandard trains each dictionary on one class's samples, group by group of
like documents.  A sample is what
sets a document of the class off from the other's: the stretches of its words that are
made of pieces of five bytes which more of its class's documents hold, once or often,
than the other's documents of the same kind (most of all: language) lead to expect.
How often a stretch comes, and so whether and where zstandard puts it, is up to the
documents.  A window is a word; each window is compressed with
either dictionary, and the difference of the two lengths is its toxicity in bytes.
(Every window begins with the same 64 bytes, which end both dictionaries: so even the
shortest window is worth compressing, and the difference shows single matches.  It ends
with eight bytes that neither has, as zstandard begins no match in a block's last eight.)  A
logistic model over a few sums of these differences calibrates the threshold.

Labels are learnt only from rows whose crc32 of the doc_id as text isn't 0 modulo 5,
from a sample bounded by TOXIC, ORDINARY and SAMPLE_BYTES: the documents with the least
hashes of their doc_id, those left out that the bytes have no room for; of rows that
share a doc_id the one whose text has the least hash.  Scoring reads whole texts and nothing but texts.

A text without words, or null, scores 0.  Without labels of both classes
every score is the share of toxic ones, or 0.  Of labels that repeat a doc_id the
largest counts; a null label doesn't.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import mix
from .bytesops import pieces as small
from .common import cut, give_back, set_aside

#: Bounds of the training sample: documents of each class, bytes of each class's text.
TOXIC, ORDINARY, SAMPLE_BYTES = 1200, 2400, 16 << 20
#: Bytes of a dictionary for each group of like documents, and of the segments and the substrings that zstandard makes it of; bytes of a piece.
DICTIONARY_BYTES, SEGMENT, SUBSTRING = 512, 16, 6
PIECE = 5
#: A document holds a piece so many times or more: each is counted by itself.
OFTEN = 1, 2, 4
#: A piece counts if more documents hold it than expected by this much, as a logarithm, and its likelihood ratio is one that chance gives any of all the pieces tried in so small a part of cases.
LEAST_CONTRAST, LUCK = 2.0, 2e-4
#: Groups of like documents at most, documents that a group has at least, bytes of a text that its group is told by.
GROUPS, MEMBERS, STRETCH = 8, 20, 1 << 14
FOLDS = 5
#: Ordinary rows that one toxic row weighs as much as, when the threshold is calibrated.
TOXIC_WEIGHT = 3.0
#: Bytes by which a window's lengths differ, beyond which differences are summed.
OVER = 1, 2, 4
#: Bytes of remembered windows and differences, beyond which a worker forgets them and begins anew.
REMEMBERED = 32 << 20

_HEAD, _TAIL = bytes(range(128, 192)), bytes(range(192, 200))
# Fixed value: the offsets 1, 4 and 8, with which the tables of a trained dictionary end.
_OFFSETS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])
_FOREVER = 1 << 60


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _codes(text: str) -> np.ndarray:
    """Every piece of every word with the space before it, as a number, repeats included."""
    s = np.frombuffer(b" " + b" ".join(words(text)), np.uint8)
    n = len(s) - PIECE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(PIECE):
        out = out << np.uint64(8) | s[k : k + n]
        if k:
            whole &= s[k : k + n] != 32
    return out[whole]


def _kind(text: str) -> np.ndarray:
    """How often a text has each three bytes, hashed, as a vector of length 1."""
    s = np.frombuffer(b" ".join(words(text))[:STRETCH], np.uint8).astype(np.int64)
    x = np.sqrt(np.bincount((s[:-2] * 40503 + s[1:-1] * 7919 + s[2:] * 31) % 1021, minlength=1024)) if len(s) > 2 else np.zeros(1024)
    return (x / max(float(np.linalg.norm(x)), 1e-9)).astype(np.float32)


def alike(own: list[str], other: list[str]) -> np.ndarray:
    """A number under GROUPS for each text: the group of `other` that it is most like, so one of its language or kind."""
    x = np.array([_kind(t) for t in other], np.float32).reshape(-1, 1024)
    centers = x.mean(axis=0, keepdims=True) if len(x) else np.zeros((1, 1024), np.float32)
    if len(x) >= 2 * MEMBERS:
        rng = np.random.default_rng(7)
        for _ in range(GROUPS - 1):
            far = np.maximum(1 - (x @ centers.T).max(axis=1), 0).astype(np.float64) + 1e-9
            centers = np.concatenate((centers, x[rng.choice(len(x), p=far / far.sum())][None]))
        for _ in range(20):
            near = (x @ centers.T).argmax(axis=1)
            size = np.bincount(near)
            enough = np.flatnonzero(size >= min(MEMBERS, size.max()))
            sums = np.stack([x[near == k].sum(axis=0) for k in enough])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return np.concatenate([(np.array([_kind(t) for t in side], np.float32).reshape(-1, 1024) @ centers.T).argmax(axis=1) for side in (own, other)])


def _times_log(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1) / np.maximum(expected, 1e-9))


def marks(own: list[str], other: list[str], group: np.ndarray) -> dict[bytes, float]:
    """Pieces that occur in more documents of `own`, once or often, than documents like them of `other` lead to expect: their worth."""
    if not own:
        return {}
    # Pieces that three documents hold; no others can be told from chance.
    held, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for a in range(0, len(own), 256):
        every = np.concatenate([held, *(np.unique(_codes(t)) for t in own[a : a + 256])])
        held, place = np.unique(every, return_inverse=True)
        times = np.bincount(place, np.concatenate((times, np.ones(len(place) - len(times), np.int64))), len(held)).astype(np.int64)
    held = held[times >= 3]
    if not len(held):
        return {}
    count = np.zeros((2, GROUPS, len(OFTEN), len(held)), np.int32)
    sizes = np.zeros((2, GROUPS))
    for i, text in enumerate([*own, *other]):
        side, g = int(i >= len(own)), group[i]
        sizes[side, g] += 1
        code, n = np.unique(_codes(text), return_counts=True)
        at = np.minimum(np.searchsorted(held, code), len(held) - 1)
        known = held[at] == code
        at, n = at[known], n[known]
        for k, least in enumerate(OFTEN):
            count[side, g, k, at[n >= least]] += 1
    best, sure_from = np.zeros(len(held)), 2 * math.log(len(held) / LUCK)
    share = (sizes[0] / np.maximum(sizes.sum(axis=0), 1))[:, None]
    for k in range(len(OFTEN)):
        mine, theirs = count[0, :, k], count[1, :, k]
        seen, both = mine.sum(axis=0), (mine + theirs).sum(axis=0)
        # Had the class nothing to do with it, each group would split in the proportion of its documents.
        expected = ((mine + theirs) * share).sum(axis=0)
        contrast = np.log(((mine * (1 - share)).sum(axis=0) + 0.5) / ((theirs * share).sum(axis=0) + 0.5))
        sure = 2 * (_times_log(seen, expected) + _times_log(both - seen, both - expected))
        best = np.maximum(best, np.where((contrast > LEAST_CONTRAST) & (sure > sure_from), seen * contrast, 0))
    return {int(held[i]).to_bytes(PIECE, "big"): float(best[i]) for i in np.flatnonzero(best)}


def stretches(text: str, worth: dict[bytes, float]) -> list[bytes]:
    """Of each word of a text that has marked pieces, the part from the first to the last of them."""
    out = []
    for w in words(text):
        w = b" " + w
        at = [i for i in range(len(w) - PIECE + 1) if w[i : i + PIECE] in worth]
        if at:
            out.append(w[at[0] : at[-1] + PIECE])
    return out


def trained(samples: list[bytes]) -> bytes:
    """The content of the dictionary that zstandard makes of samples: what follows its tables, which end with three offsets."""
    try:
        raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:  # it refuses samples that are too few or too short: they are few enough to be the dictionary
        return b"".join(dict.fromkeys(samples))[-DICTIONARY_BYTES:]
    return raw[raw.index(_OFFSETS) + len(_OFFSETS) :]


def dictionary(own: list[str], other: list[str]) -> bytes:
    """What zstandard trains on what sets `own` off from `other`, group by group of like texts, so that a rare kind has its part; its head alone if nothing does."""
    group = alike(own, other)
    worth = marks(own, other, group)
    samples: dict[int, list[bytes]] = {}
    for g, text in zip(group.tolist(), own if worth else (), strict=False):
        if found := stretches(text, worth):
            samples.setdefault(g, []).append(b"".join(found))
    return b"".join([trained(samples[g]) for g in sorted(samples)]) + _HEAD


class Compressor:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, raw: bytes):
        settings = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
            window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
        )
        self._c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)

    def length(self, word: bytes) -> int:
        return len(self._c.compress(_HEAD + b" " + word + b" " + _TAIL))


def features(excess: np.ndarray) -> list[float]:
    """What the windows' differences come to, whatever the number of windows."""
    n = len(excess)
    top = np.sort(excess)[::-1][:2]
    over = [float(np.maximum(excess - k, 0).sum()) for k in OVER]
    return [1.0, float(top[0]), float(top[-1]), *(x / math.sqrt(n) for x in over), *(math.log1p(x) for x in over), math.log(n)]


class Model:
    """Two dictionaries and a calibrated threshold; small, and the same on every worker."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.prior = len(toxic) / max(1, len(toxic) + len(ordinary))
        self.raw = dictionary(toxic, ordinary), dictionary(ordinary, toxic)
        self.weights, self.scale = None, None
        if toxic and ordinary:
            x = np.array([self.features(t) for t in [*toxic, *ordinary]])
            self.scale = np.maximum(x.std(axis=0), 1e-9)
            self.scale[0] = 1.0
            self.weights = _logistic(x / self.scale, np.array([1.0] * len(toxic) + [0.0] * len(ordinary)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_pair", "_known", "_held")}

    def excess(self, text: str | None) -> np.ndarray:
        """By how much the toxic dictionary makes each word of a text shorter than the ordinary one does; a word that is remembered isn't compressed again."""
        if "_pair" not in self.__dict__:
            self._pair, self._known, self._held = tuple(map(Compressor, self.raw)), {}, 0
        if self._held > REMEMBERED:
            self._known, self._held = {}, 0
        toxic, ordinary = self._pair
        known, found = self._known, words(text) or [b""]
        for w in found:
            if w not in known:
                known[w] = ordinary.length(w) - toxic.length(w)
                self._held += len(w) + 128
        return np.fromiter(map(known.__getitem__, found), np.int32, len(found))

    def features(self, text: str | None) -> list[float]:
        return features(self.excess(text))

    def forget(self) -> None:
        """Let go of the remembered words: the worker may have other work next."""
        self._known, self._held = {}, 0

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return float(self.prior)
        if not text or not text.strip():
            return 0.0
        z = float(np.dot(np.array(self.features(text)) / self.scale, self.weights))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method, a toxic row weighted TOXIC_WEIGHT."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled documents that aren't held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    sample: list[list[str]] = []
    spark = docs.sparkSession
    for mark, most in ((1, TOXIC), (0, ORDINARY)):
        chosen = marks.where(F.col("_toxic") == mark).orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where(F.col("text").isNotNull())
        # One text for each id: what comes to the driver is bounded in rows, then in bytes, before it comes.
        held = cut(spark, rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), most)
        fitting, size = [], 0
        sizes = held.select("doc_id", F.octet_length("text").alias("n")).collect()
        for i, n in sorted(sizes, key=lambda r: int(mix(np.array([r[0]], np.int64).view(np.uint64))[0])):
            if size + n <= SAMPLE_BYTES:
                fitting.append(i)
                size += n
        found = {r["doc_id"]: r["text"] for r in held.where(F.col("doc_id").isin(fitting)).collect()} if fitting else {}
        sample.append(list(dict.fromkeys(found[i] for i in fitting)))
    return Model(*sample)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row and column of docs with held_out, score and predicted; columns of these names are replaced."""
    from pyspark.sql import types as T

    new = ["held_out", "score", "predicted"]
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    keep = docs.drop(*new).withColumn("text", F.col("text").cast("string"))
    keep = keep.withColumn("held_out", held_out())

    def run(batches):
        own = model.value
        for b in small(batches):
            score = np.array([own.score(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*b.schema.names, "score", "predicted"])
        own.forget()
        give_back()

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return scored(docs.select(F.col("doc_id").cast("long"), "text"), labels).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted toxic."""
    plain, own = set_aside(docs, ["held_out", "score", "predicted"])
    return scored(plain, labels).where("predicted = 0").select(*own)
