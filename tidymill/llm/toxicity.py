"""Toxicity by compression distance: which of two zstandard dictionaries makes a window shorter.

Windows are runs of WINDOW words, one every STEP words of the whole text. From a bounded sample of labelled documents a
dictionary is trained on windows of both classes without such strings as follow; both dictionaries begin with it. Behind it stand, in the toxic one,
the telling strings: parts of words, stems or whole words, that toxic documents hold significantly more often than ordinary ones, however few of them do; and in the ordinary
one as many line ends. (Two dictionaries trained apart, one on each class, differ by chance more than by what tells; see the README.) A window's
distance is its length compressed with the ordinary dictionary less that with the toxic one; symbols are not coded, so a match counts in whole bytes. On the half of the
sample that the dictionaries have not seen, each distance is given its log likelihood ratio between windows of toxic and of ordinary documents, and a document's sum of
these a probability (pool adjacent violators, brought to the labels' true shares).

Defined results: null, empty and wordless texts have the sum 0 and the score of that sum; without labels of both classes every score is
the share of toxic labels (0 without labels); a document labelled twice counts as toxic if one label says so; null labels are ignored;
repeated rows are scored each; an empty table gives no rows; columns other than those named are not read.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import of_text, pick, whole_text
from .learning import bounded_sample, held_out, texts_of

WINDOW, STEP = 8, 4
#: Documents of each class that the model is fitted on, at most.
PER_CLASS = 3000
#: Bytes of a telling string. It is in at least LEAST_DOCUMENTS toxic ones, is RATIO times as frequent there as in ordinary ones, and its log likelihood ratio statistic is at least SURE.
SHORTEST, LONGEST, LEAST_DOCUMENTS, RATIO, SURE = 5, 12, 4, 5, 25
#: A string counts so often in one document, at most.
REPEATS = 3
SHARED_BYTES, OWN_BYTES, SAMPLES, LEVEL = 4096, 16384, 4000, 5
#: No match begins in the last bytes of a dictionary.
UNSEEN = b"\n" * 8
LONGEST_WORD = 64
THRESHOLD = 0.7


def words(text: str) -> list[bytes]:
    found = text.lower().encode().split()
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[i:i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    #: Log likelihood ratio of a window by its distance: the first and last value hold for all beyond.
    lowest: int
    evidence: tuple[float, ...]
    sums: tuple[float, ...]      # ascending
    scores: tuple[float, ...]    # of sums from that one on
    share: float

    def total(self, found: list[int]) -> float:
        last = len(self.evidence) - 1
        return sum(self.evidence[min(last, max(0, d - self.lowest))] for d in found)

    def score(self, text: str) -> float:
        return self.score_of(self.total(distances(text, self.toxic, self.ordinary))) if self.scores else self.share

    def score_of(self, total: float) -> float:
        return self.scores[max(0, bisect_right(self.sums, total) - 1)]


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes):
    # The fast strategy with a target length leaves symbols that match nothing as they are.
    params = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=SHORTEST, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress


def distances(text: str, toxic: bytes, ordinary: bytes) -> list[int]:
    near, far = _compressor(toxic), _compressor(ordinary)
    return [len(far(w)) - len(near(w)) for w in windows(text)]


def windows(text: str) -> list[bytes]:
    found = words(text)
    return [b" %s " % b" ".join(found[i:i + WINDOW]) for i in range(0, max(1, len(found) - WINDOW + STEP) if found else 0, STEP)]


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on at most SAMPLES of the windows, dealt evenly."""
    samples = samples[::max(1, len(samples) // SAMPLES)]
    try:
        return zstandard.train_dictionary(SHARED_BYTES, samples, k=64, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:     # too few for the trainer: their bytes are the dictionary
        return (b"".join(samples) or b" " * 8).ljust(8)[-SHARED_BYTES:]


def _held(counted: list[tuple[bytes, int]], size: int, wanted) -> Counter:
    """How often one document holds each wanted string of so many bytes."""
    out = Counter()
    for word, k in counted:
        for i in range(len(word) - size + 1):
            if wanted(part := word[i:i + size]):
                out[part] += k
    return out


def telling(rows: list[tuple[str, int]]) -> list[bytes]:
    """The strings that tell toxic documents, the surest first, without those that mostly stand in words that hold a surer one."""
    n = Counter(label for _, label in rows)
    counted = [([(b" %s " % w, min(k, REPEATS)) for w, k in Counter(words(text)).items()], label) for text, label in rows]
    often, last = {}, None
    for size in range(SHORTEST, LONGEST + 1):   # a string is no more frequent than its parts
        docs, total = Counter(), Counter()
        for found, label in counted:
            if label:
                for part, k in _held(found, size, lambda s: last is None or (s[:-1] in last and s[1:] in last)).items():
                    docs[part] += 1
                    total[part] += min(k, REPEATS)
        last = {s for s, k in docs.items() if k >= LEAST_DOCUMENTS}
        often.update((s, total[s]) for s in last)
    ordinary = Counter()
    for found, label in counted:
        if not label:
            for size in range(SHORTEST, LONGEST + 1):
                ordinary.update({s: min(k, REPEATS) for s, k in _held(found, size, often.__contains__).items()})
    share, sure = n[1] / (n[0] + n[1]), {}
    for s, a in often.items():
        b = ordinary[s]
        if a / n[1] >= RATIO * (b + 0.5) / n[0]:
            statistic = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
            if statistic >= SURE:
                sure[s] = statistic
    inside = {s: Counter() for s in sure}
    for word, k in Counter(w for found, label in counted if label for w, _ in found).items():
        for size in range(SHORTEST, LONGEST + 1):
            for s in _held([(word, 1)], size, inside.__contains__):
                inside[s][word] = k
    chosen, told = [], set()
    for s in sorted(sure, key=lambda s: (-sure[s], -len(s), s)):
        if 2 * sum(k for w, k in inside[s].items() if w not in told) > sum(inside[s].values()):
            chosen.append(s)
            told.update(inside[s])
    return chosen


def _strings_up_to(chosen: list[bytes], size: int) -> bytes:
    out = b""
    for s in chosen:
        if len(out) + len(s) + 1 <= size:
            out = s + b"\n" + out
    return out


def rising(points: list[tuple[int, float, float]]) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Weighted isotonic means of (x, y, weight), x ascending: where each step begins and its height."""
    steps = []
    for x, y, w in points:
        steps.append([x, y * w, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, s, w = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += w
    return tuple(x for x, _, _ in steps), tuple(s / w for _, s, w in steps)


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """rows: (text, 0 or 1) of a bounded sample; share: of toxic documents among all labelled ones that may be learned from."""
    halves = [[], []]
    seen = Counter()
    for text, label in rows:
        halves[seen[label] % 2].append((text, label))
        seen[label] += 1
    learn, calibrate = halves
    if min(seen.get(0, 0), seen.get(1, 0)) < 2:
        return Model(b"", b"", 0, (), (), (), share)
    told = telling(learn)
    if not told:
        return Model(b"", b"", 0, (), (), (), share)
    tells = re.compile(b"|".join(map(re.escape, told))).search
    shared = _dictionary([w for text, _ in learn for w in windows(text) if not tells(w)])
    own = _strings_up_to(told, OWN_BYTES)
    toxic, ordinary = shared + own + UNSEEN, shared + b"\n" * len(own) + UNSEEN

    # What a distance tells: its share among windows of toxic documents against that among windows of ordinary ones, rising.
    measured, counts = [], [Counter(), Counter()]
    for text, label in calibrate:
        found = distances(text, toxic, ordinary)
        measured.append((found, label))
        counts[label].update(found)
    low, high = min([-1, *counts[0], *counts[1]]), max([1, *counts[0], *counts[1]])
    span = range(low, high + 1)
    part = (sum(counts[1].values()) + 1) / (sum(counts[0].values()) + 1)
    starts, ratios = rising([(d, (counts[1][d] + part) / (counts[0][d] + 1) / part, counts[0][d] + 1) for d in span])
    evidence = tuple(math.log(ratios[bisect_right(starts, d) - 1]) for d in span)

    model = Model(toxic, ordinary, low, evidence, (), (), share)
    count = Counter(label for _, label in calibrate)
    weight = {1: share / count[1], 0: (1 - share) / count[0]}
    by_sum = {}
    for found, label in measured:
        mass = by_sum.setdefault(round(model.total(found) * 4) / 4, [0.0, 0.0])
        mass[0] += weight[label] * label
        mass[1] += weight[label]
    sums, scores = rising([(x, a / b, b) for x, (a, b) in sorted(by_sum.items())])
    return replace(model, sums=tuple(x - 0.125 for x in sums), scores=scores)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    known = pick(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    total, toxic = known.agg(F.count("*"), F.sum("label")).first()
    texts = pick(docs, "doc_id", "text").select("doc_id", whole_text().alias("text"))
    return fit(texts_of(texts, bounded_sample(known, per_class)), (toxic or 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, held_out, score, predicted."""
    source = pick(docs, *dict.fromkeys((*keep, "doc_id", "text")))
    found = source.select(*keep, held_out(F.col("doc_id")).alias("held_out"), of_text(whole_text(), lambda texts: ((model.score(t),) for t in texts), "score double").alias("_found"))
    return found.select(*keep, "held_out", "_found.score", (F.col("_found.score") >= THRESHOLD).cast("int").alias("predicted"))
