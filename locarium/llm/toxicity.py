"""Toxicity scores of texts restored from obfuscation by a noisy-channel decoder.

Writers hide words by look-alike symbols, spacing and repetition. Each
token that may be read in more than one way becomes a lattice of the letters its symbols may stand for;
Viterbi search under a character trigram model finds the likeliest reading,
and a logistic model of words and word beginnings scores the restored text.
The trigram model counts all documents; labels come from a bounded sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled rows that the classifier is fitted on, at most; those of least hash are taken.
MAX_LABELLED = 20_000
#: Square root of the likelihood-ratio statistic from which a whole word enters the lexicon, and a feature the model.
LEXICON, TELLING = 5.0, 4.4
THRESHOLD = 0.7
FOLD = 1

#: Letters that a symbol may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
GAPS = " .-_*,'`~"
_WORDS = re.compile(r"[^\W\d_]+")
_SYMBOL = re.escape("".join(k for k in LOOKS) + GAPS.strip())
_EDGE = rf"(?:(?![{re.escape(''.join(LOOKS))}])[\W\d_])+"
_TRIM = re.compile(rf"^{_EDGE}|{_EDGE}$")
#: A token that the lattice reads in one way only: letters, none twice in a row.
_PLAIN = re.compile(r"(?:([^\W\d_])(?!\1))+")
#: A token whose parts between symbols aren't words of their own.
_TORN = re.compile(rf"[^\W\d_][{_SYMBOL}]+[^\W\d_]|([^\W\d_])\1\1")
_ENDS = r"[.,;:?\"]*"
_SINGLE = rf"{_ENDS}[^\s.,;:?\"]{_ENDS}"
#: Three letters or more that stand by themselves.
_SPACED = re.compile(rf"(?<!\S){_SINGLE}(?:\s+{_SINGLE}){{2,}}(?!\S)")
#: Symbols of the character model: 0 a boundary, 1-26 the letters, 27 any other letter.
_SIZE = 28


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points >= 128, np.uint32(27), np.uint32(0))
    letter = (points >= 97) & (points <= 122)
    codes[letter] = points[letter] - 96
    return codes.astype(np.int64)


def _trigrams(text: str) -> np.ndarray:
    c = np.concatenate(([0, 0], _codes(text), [0]))
    return np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)


def _count_trigrams(text: str, total: np.ndarray, part: int = 1 << 20) -> None:
    """Add a text's trigrams to ``total``, in parts that overlap by two characters."""
    for i in range(0, len(text), part):
        before, after = _codes(text[i - 2 : i]) if i else [0, 0], [0] if i + part >= len(text) else []
        c = np.concatenate((before, _codes(text[i : i + part]), after)).astype(np.int64)
        total += np.bincount((c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all documents: a table of 28 x 28 x 28 whatever the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SIZE**3, np.int64)
        for b in batches:
            for t in b["text"]:
                if t:
                    _count_trigrams(t.lower(), total)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    counts = np.zeros(_SIZE**3)
    grams = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "gram long, n long")
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts


def _conditional(counts: np.ndarray) -> np.ndarray:
    """P(c | a, b), interpolated with shorter contexts."""
    tri = counts.reshape(_SIZE, _SIZE, _SIZE)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + _SIZE)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    return (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)


class Decoder:
    """Restores tokens under a mixture of the corpus's character model and that of known words."""

    def __init__(self, counts: np.ndarray, words: list[str]):
        own = np.zeros(_SIZE**3)
        for w in words:
            own += _trigrams(w)
        self.cost = np.log(0.5 * _conditional(counts) + 0.5 * _conditional(own * 50)) if words else np.log(_conditional(counts))
        self.known: dict[str, str] = {}
        self.tokens: dict[str, tuple[str, ...]] = {}

    def forget(self) -> None:
        self.known.clear()
        self.tokens.clear()

    def lattice(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """Readings of each symbol with the channel's log-probabilities; an empty reading drops the symbol."""
        before = ""
        for ch in token:
            if ch in LOOKS:
                out = [(x, math.log(0.6 / len(LOOKS[ch]))) for x in LOOKS[ch]] + [("", math.log(0.1)), (" ", math.log(0.3))]
            elif ch in GAPS or not ch.isalpha():
                out = [("", math.log(0.5)), (" ", math.log(0.5))]
            else:
                out = [(ch, 0.0)]
            if ch == before and ch.isalpha():
                out.append(("", math.log(0.5)))
            before = ch
            yield out

    def restore(self, token: str) -> str:
        if token in self.known:
            return self.known[token]
        cost = self.cost
        # state: the codes of the last two symbols; value: score and a chain of readings
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for readings in self.lattice(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in beam.items():
                for text, p in readings:
                    if not text:
                        state, s, chain = (a, b), score + p, path
                    else:
                        c = ord(text) - 96 if "a" <= text <= "z" else 0 if text == " " else 27
                        state, s, chain = (b, c), score + p + cost[a, b, c], (text, path)
                    if state not in new or s > new[state][0]:
                        new[state] = (s, chain)
            beam = new
        best = max(beam, key=lambda k: beam[k][0] + cost[k[0], k[1], 0])
        chain, out = beam[best][1], []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[token] = said = "".join(reversed(out))
        return said

    def token(self, token: str) -> tuple[str, ...]:
        """The words that a token may say: as it stands where its letters are whole, and as the decoder reads it.

        Every token is decoded whose lattice has more than one reading; one
        without letters is a number or a mark and says none.
        """
        if token in self.tokens:
            return self.tokens[token]
        core = _TRIM.sub("", token)
        found = _WORDS.findall(core)
        if found and not _PLAIN.fullmatch(core):
            read = self.restore(core).split()
            found = read if _TORN.search(core) else found + read
        out = tuple(found)
        if len(token) <= 64:
            if len(self.tokens) > 200_000:
                self.tokens.clear()
            self.tokens[token] = out
        return out

    def words(self, text: str) -> set[str]:
        """The distinct lower-case words of the restored text."""
        text = text.lower()
        out: set[str] = set()
        for token in set(text.split()):
            out.update(self.token(token))
        for m in _SPACED.finditer(text):
            single: list[str] = []
            for token in [*m[0].split(), ""]:
                core = token.strip(".,;:?\"")
                if core and (core.isalpha() or core in LOOKS):
                    if len(set(single)) > 1 or len(single) < 4 or core != single[-1]:  # a letter said over and over is no word
                        single.append(core)
                    continue
                if len(single) > 2:
                    out.update(self.restore(" ".join(single)).split())
                single.clear()
        return out


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings of 4 to 8 letters."""
    out = set(words)
    for w in words:
        for k in range(4, min(9, len(w))):
            out.add("^" + w[:k])
    return out


class ToxicityModel:
    """A decoder and the weights of features; ``score`` gives the probability of label 1."""

    def __init__(self, decoder: Decoder | None, weights: dict[str, float], bias: float):
        self.decoder, self.weights, self.bias = decoder, weights, bias
        self.whole = {k: v for k, v in weights.items() if k[0] != "^"}
        self.start = {k[1:]: v for k, v in weights.items() if k[0] == "^"}

    def score(self, text: str | None) -> float:
        z, seen = self.bias, set()
        if text and self.weights:
            for w in self.decoder.words(text):
                z += self.whole.get(w, 0.0)
                for k in range(4, min(9, len(w))):
                    if (p := w[:k]) in self.start and p not in seen:
                        seen.add(p)
                        z += self.start[p]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def column(self, docs: DataFrame, text_col: str = "text") -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            model = shared.value
            return pd.Series([model.score(t) for t in texts], dtype="float64")

        return score(F.col(text_col).cast("string"))


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def _logistic(sets: list[np.ndarray], y: np.ndarray, n: int, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients over the features present.

    Rows with the same features are one weighted row; nothing of rows x features is held.
    """
    groups: dict[bytes, list[float]] = {}
    for s, label in zip(sets, y, strict=True):
        g = groups.setdefault(np.sort(s).astype(np.int32).tobytes(), [0.0, 0.0])
        g[0] += 1
        g[1] += label
    keys = sorted(groups)
    held = [np.frombuffer(k, np.int32) for k in keys]
    # the last column, of every row, is the bias
    col = np.concatenate([np.append(h, n) for h in held]).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), [len(h) + 1 for h in held])
    total, ones = (np.array([groups[k][c] for k in keys]) for c in (0, 1))
    penalty = np.append(np.full(n, ridge), 1e-6)
    of_rows = lambda v: np.bincount(row, v[col], len(keys))
    of_columns = lambda u: np.bincount(col, u[row], n + 1)
    w = np.zeros(n + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(of_rows(w), -30, 30)))
        curve = total * p * (1 - p) + 1e-9
        step = np.zeros(n + 1)
        left = of_columns(ones - total * p) - penalty * w
        scale = 1 / (of_columns(curve) + penalty)
        z = scale * left
        way, size = z.copy(), float(left @ z)
        for _ in range(300):
            if size < 1e-14:
                break
            ahead = of_columns(curve * of_rows(way)) + penalty * way
            far = size / float(way @ ahead)
            step += far * way
            left = left - far * ahead
            z = scale * left
            size, last = float(left @ z), size
            way = z + size / last * way
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _signed_deviance(ones: np.ndarray, zeros: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Square root of the likelihood-ratio statistic of presence against label, negative for signs of label 0."""

    def term(n: np.ndarray, of: np.ndarray | float) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(n, 1e-12) / of), 0.0)

    share = (ones + zeros) / (toxic + clean)
    g = term(ones, toxic * share) + term(zeros, clean * share) + term(toxic - ones, toxic * (1 - share) + 1e-12) + term(clean - zeros, clean * (1 - share) + 1e-12)
    return np.sqrt(np.maximum(2 * g, 0)) * np.sign(ones * clean - zeros * toxic)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from at most ``max_labelled`` labelled rows outside fold 1, and from the characters of all documents.

    Every feature that tells enough enters the model; what there is of them
    the sample bounds. Of several labels of one document the largest counts; null labels and ids
    are ignored. Without labels of both kinds the score is the smoothed share
    of label 1, or 0 without any.
    """
    sample = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    sample = sample.where(fold_of("id") != FOLD).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # At most max_labelled rows of two numbers.
    train = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(stored(sample)), "id").select("text", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)"))
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows, toxic = sum(size.values()), size.get(1, 0)
    if not toxic or toxic == rows:
        p = toxic / (rows + 2) if rows else 1e-9
        return ToxicityModel(None, {}, math.log(max(p, 1e-9) / (1 - p)))
    sc = docs.sparkSession.sparkContext

    def common(decoder: Decoder | None, whole_words: bool) -> list[str]:
        """Features of at least 4 toxic documents of the sample."""
        shared = sc.broadcast(decoder)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: Counter[str] = Counter()
            for b in batches:
                for t in b["text"]:
                    words = shared.value.words(t or "") if shared.value else set(_WORDS.findall((t or "").lower()))
                    counts.update(words if whole_words else features(words))
            names = list(counts)
            for i in range(0, len(names), 20_000):
                part = names[i : i + 20_000]
                yield pd.DataFrame({"feature": pd.Series(part, dtype=object), "n": [counts[x] for x in part]})

        f = train.where("toxic = 1").select("text").mapInPandas(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        return [r["feature"] for r in f.where("n >= 4").orderBy("feature").collect()]

    def found(shared, whole_words: bool, batch: pd.DataFrame) -> Iterator[tuple[int, list[int]]]:
        """Label and sorted places of the features of each row."""
        decoder, index = shared.value
        for label, t in zip(batch["toxic"], batch["text"], strict=True):
            words = decoder.words(t or "") if decoder else set(_WORDS.findall((t or "").lower()))
            yield label, sorted(index[f] for f in (words if whole_words else features(words)) if f in index)

    def telling(candidates: list[str], decoder: Decoder | None, whole_words: bool, least: float) -> list[str]:
        """Candidates that speak for label 1, by the likelihood-ratio statistic."""
        shared = sc.broadcast((decoder, {f: i for i, f in enumerate(candidates)}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros((2, len(candidates)), np.int64)
            for b in batches:
                for label, at in found(shared, whole_words, b):
                    counts[int(label), at] += 1
            at = np.flatnonzero(counts.sum(axis=0))
            yield pd.DataFrame({"at": at, "zeros": counts[0, at], "ones": counts[1, at]})

        got = np.zeros((2, len(candidates)))
        for r in train.mapInPandas(run, "at long, zeros long, ones long").groupBy("at").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect():
            got[:, r["at"]] = r["zeros"], r["ones"]
        z = _signed_deviance(got[1], got[0], toxic, rows - toxic)
        return [candidates[i] for i in sorted(np.flatnonzero(z > least).tolist(), key=lambda i: (-z[i], candidates[i]))]

    def occurrences(chosen: list[str], decoder: Decoder) -> tuple[np.ndarray, list[np.ndarray]]:
        """Labels and chosen features of the sample's rows: at most max_labelled short byte strings."""
        shared = sc.broadcast((decoder, {f: i for i, f in enumerate(chosen)}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                pairs = list(found(shared, False, b))
                yield pd.DataFrame({"toxic": [int(p[0]) for p in pairs], "at": [np.array(p[1], np.int32).tobytes() for p in pairs]})

        got = train.mapInPandas(run, "toxic int, at binary").groupBy("toxic", "at").agg(F.count("*").alias("n")).collect()
        y = np.concatenate([np.full(r["n"], r["toxic"], float) for r in got])
        return y, [np.frombuffer(bytes(r["at"]), np.int32) for r in got for _ in range(r["n"])]

    lexicon = telling(common(None, True), None, True, LEXICON)
    decoder = Decoder(character_counts(docs, text_col), lexicon)
    chosen = telling(common(decoder, False), decoder, False, TELLING)
    y, sets = occurrences(chosen, decoder)
    w = _logistic(sets, y, len(chosen))
    decoder.forget()
    return ToxicityModel(decoder, {f: float(x) for f, x in zip(chosen, w, strict=False)}, float(w[-1]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` for every document; null and empty texts get the base score.

    Repeated rows each get their score; other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("id"), (fold_of(id_col) == FOLD).alias("held_out"), model.column(docs, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = fit(docs, labels, text_col=text_col)
    names = docs.columns
    return docs.withColumn("__score", model.column(docs, text_col)).where(F.col("__score") < threshold).select(*names)
