"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of insults, threats and learned stems;
nearness of second-person words to them; shares of capitals, punctuation and
obfuscated words (digits or symbols between letters, which are undone before the
lexicons are asked).  The learned stems are first letters of words that toxic
training texts have significantly more often than the others; at most ``max_stems``.

Everything is fitted on at most ``max_train_docs`` labelled documents, chosen by
a hash of their ids: the stems and trees on four fifths of them, the isotonic
curve on the rest.  The score is the curve's value, with a thousandth of the
trees' own probability so that texts of one step keep their order.  Without
labels of both kinds among that rest there is no curve, and the score is the
trees' probability.

A null or empty text has the features zero.  Rows with one id are scored each on
its own; in fitting, an id stands for one of its texts (that of the least hash), so
a frequent id adds no rows to the sample.  Labels that are null are not used; an id
with labels of both kinds counts once for each.  With labels of one kind only, the
score is the lexicons'.  Only the named columns are read; ``drop_toxic`` keeps the
others, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import is_held_out, map_texts, per_text, stage_table

INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown "
    "imbecile fool freak jerk bastard bitch asshole pig vermin filth ugly retard creep coward liar "
    "idiote imbécile débile connard connasse salaud crétin ordure abruti dummkopf trottel vollidiot arschloch abschaum "
    "schwachkopf idiota imbécil estúpido estúpida basura tonto payaso inútil asqueroso cabrón".encode().split()
)
THREATS = frozenset(
    "kill die hurt hate destroy burn beat shoot suffer choke tuer crever détruire sterben töten hassen matar morir odio".encode().split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta vous votre du dich dir dein deine ihr euch tú ti usted ustedes tus".encode().split())
#: Letters, as UTF-8 bytes above ASCII and a-z; all else parts words.
WORDS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PUNCTUATION = b"!?*#$%&@~^|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
MIXED = re.compile(rb"(?:[0-9@$!]+[A-Za-z]+|[A-Za-z]+)(?:[0-9@$*!.\-_]+[A-Za-z]+)+")
PLAIN_FOR = bytes.maketrans(b"013457@$!", b"oieastasi")
FEATURES = [
    "insults", "any_insult", "threats", "stems", "any_stem", "near_person", "person", "capitals", "punctuation", "obfuscated", "hidden", "log_words",
]


def hidden_word(mixed: bytes) -> bytes:
    """A word with its digits and symbols undone: ``1d10t``-like or ``i.d.i.o.t``-like."""
    return mixed.translate(PLAIN_FOR, b"*.-_").lower()


def stem(word: bytes, letters: int = 5) -> bytes:
    return word.decode("utf-8", "ignore")[:letters].encode() if len(word) > letters else word


def features(text: str | None, stems: frozenset = frozenset()) -> list[float]:
    raw = (text or "").encode("utf-8")
    words = raw.translate(WORDS).split()
    n = max(1, len(words))
    mixed = MIXED.findall(raw)
    hidden = sum(hidden_word(m) in INSULTS for m in mixed)
    found = [i for i, w in enumerate(words) if w in INSULTS]
    learned = [i for i, w in enumerate(words) if stem(w) in stems] if stems else []
    near = 0.0
    people = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    hits = sorted({*found, *learned})
    if people and hits:
        j = 0
        for i in hits:
            while j + 1 < len(people) and abs(people[j + 1] - i) <= abs(people[j] - i):
                j += 1
            near += 1.0 / (1 + abs(people[j] - i))
        near /= len(hits)
    upper, lower = (len(raw) - len(raw.translate(None, s)) for s in (UPPER, LOWER))
    return [
        1000.0 * len(found) / n,
        float(min(3, len(found) + hidden)),
        1000.0 * sum(w in THREATS for w in words) / n,
        1000.0 * len(learned) / n,
        float(min(3, len(learned))),
        near,
        1000.0 * len(people) / n,
        upper / max(1, upper + lower),
        (len(raw) - len(raw.translate(None, PUNCTUATION))) / max(1, len(raw)),
        1000.0 * len(mixed) / n,
        1000.0 * hidden / n,
        log(1 + len(words)),
    ]


def _base(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def learn_stems(sample: DataFrame, max_stems: int = 400, least: int = 4, evidence: float = 12.0) -> frozenset:
    """First letters of words that at least ``least`` toxic texts have, that are
    three times as frequent in these as in the others, and whose log-likelihood
    ratio is ``evidence`` or more; sample: text, y."""

    def count(texts: list) -> tuple[list, list]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for t in texts:
            seen[t["y"]].update({stem(w) for w in (t["text"] or "").encode("utf-8").translate(WORDS).split()})
        rows = [(w.decode("utf-8", "replace"), y, c) for y in (0, 1) for w, c in seen[y].items()]
        return [0] * len(rows), rows

    rows = sample.select(F.lit(0).alias("one"), F.struct("y", "text").alias("text"))
    counted = map_texts(rows, ["one"], count, "stem string, y int, n long", rows=2000)
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    both = counted.groupBy("stem").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    usual = (F.col("n0") + 0.5) * totals.get(1, 1) / max(1, totals.get(0, 1))  # texts to expect
    gain = F.col("n1") * F.log(F.col("n1") / usual) - (F.col("n1") - usual)
    best = both.filter((F.col("n1") >= least) & (F.col("n1") >= 3 * usual)).withColumn("gain", gain).filter(F.col("gain") >= evidence)
    best = best.orderBy(F.desc("gain"), "stem").limit(max_stems)
    return frozenset(r["stem"].encode() for r in best.collect())  # max_stems rows at most


class ToxicityModel:
    """Stems, trees and the isotonic curve; ``score`` adds score and predicted."""

    def __init__(self, df: DataFrame, labels: DataFrame, max_train_docs: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "toxic"):
        spark = df.sparkSession
        known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y"))
        known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out("doc_id")).distinct()
        # at most max_train_docs rows
        chosen = known.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "y").limit(max_train_docs)
        rows = _base(df, key, text).join(F.broadcast(chosen), "doc_id")
        one = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text").isNull()))
        sample = stage_table(spark, rows.groupBy("doc_id", "y").agg(one.alias("text")), "toxic-sample")
        folded = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)))
        train = folded.filter("fold <> 0")
        self.stems = self.trees = self.curve = None
        self.stems = learn_stems(train)
        if {r["y"] for r in train.select("y").distinct().collect()} != {0, 1}:
            return
        # every class weighs by its share, so that the probability stays one
        dense = stage_table(spark, folded.select("y", "fold", self._vector(spark)("text").alias("x")), "toxic-features")
        dense = dense.withColumn("features", array_to_vector("x")).coalesce(4)
        self.trees = GBTClassifier(labelCol="y", maxIter=15, maxDepth=4, stepSize=0.2, maxBins=32, seed=7).fit(dense.filter("fold <> 0").select("y", "features"))
        tuned = self.trees.transform(dense.filter("fold = 0")).select(F.col("y").cast("double").alias("label"), vector_to_array("probability")[1].alias("features"))
        if tuned.select("label").distinct().count() == 2:
            self.curve = IsotonicRegression().fit(tuned)

    def _vector(self, spark):
        stems = self.stems
        return per_text(spark, lambda t: features(t, stems), "array<double>")

    def score(self, rows: DataFrame, keep: list[str], text: Column | str = "text") -> DataFrame:
        """``keep``, score and predicted; rows: the columns ``keep`` and text."""
        # not deterministic: no filter on the score moves below, where the texts would be read again
        vector = self._vector(rows.sparkSession).asNondeterministic()
        dense = rows.select(*keep, vector(text).alias("x"))
        if self.trees is None:
            score = F.least(F.lit(1.0), (F.col("x")[1] + F.col("x")[4]) / 3)
        else:
            dense = self.trees.transform(dense.withColumn("raw", array_to_vector("x")).withColumnRenamed("raw", "features"))
            score = vector_to_array("probability")[1]
        dense = dense.select(*keep, score.alias("p"))
        if self.curve is not None:
            known = self.curve.transform(dense.withColumnRenamed("p", "features")).withColumnRenamed("features", "p")
            dense = known.withColumn("p", F.lit(0.999) * F.col("prediction") + F.lit(0.001) * F.col("p"))
        return dense.select(*keep, F.col("p").alias("score"), (F.col("p") >= 0.5).cast("int").alias("predicted"))


def score_documents(df: DataFrame, labels: DataFrame, max_train_docs: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    model = ToxicityModel(df, labels, max_train_docs, key, text, label)
    scored = model.score(_base(df, key, text), ["doc_id"])
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")


def drop_toxic(df: DataFrame, labels: DataFrame, max_train_docs: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with all their columns."""
    model = ToxicityModel(df, labels, max_train_docs, key, text, label)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    scored = model.score(rows, ["row"], F.col("row").getField(text))
    return scored.filter("predicted = 0").select(*[F.col("row").getField(c).alias(c) for c in df.columns])
