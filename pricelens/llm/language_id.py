"""Language identification: multinomial naive Bayes over hashed character bigrams and trigrams.

Texts are lower-cased; every character that is no letter counts as a space; the grams are those whose last (bigram) or
middle (trigram) character is a letter, hashed into BUCKETS cells each. The model is a matrix of log probabilities, cells
by languages, whose size depends on the languages alone; it is broadcast, and whole batches are scored in numpy by sparse
row sums.

Training and calibration read every labelled row, whole. Tasks send sums: of training at most a row for each cell and
language, of calibration three numbers.

Whether a text is of any learned language at all is another question than of which: its evidence is the mean, over its
letters, of the largest log probability that some language gives the letter's grams, so texts in several languages don't
suffer. The floor lies at FLOOR of the way from the evidence of the training texts to that of the same texts with their
letters shuffled. Texts of other scripts, and strings of letters, stay below it; a text that holds a key or two doesn't.

Defined results: a text without letters (null, empty, digits) is `und` with score 0, as is every text if nothing is
labelled; ties go to the first language in order; repeated rows get equal results; a null id isn't held out; columns
named like an output are replaced, all others pass by. Evidence of a text without letters, or without a model, is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType

from .common import release, table
from .packing import slices
from .textkernel import mix

BUCKETS = 1 << 16
#: Languages that a model may have; the broadcast matrix takes half a megabyte for each.
MOST = 200
#: A score is the posterior if the text had as many grams at most, as neighbouring grams aren't independent.
EVIDENCE = 50
UNKNOWN = "und"
#: Letters that a text must have before its evidence can speak against it.
ENOUGH = 100
FLOOR = 0.75
#: Text of a slice; numpy holds about a hundred times as much while it counts one.
BYTES = 256 << 10


@cache
def _letters() -> np.ndarray:
    """Each code point, or a space for those that are no letters."""
    n = 0x110000
    keep = np.fromiter((chr(k).isalpha() for k in range(n)), dtype=bool, count=n)
    return np.where(keep, np.arange(n, dtype=np.uint32), np.uint32(32))


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, others as spaces, and where each text starts."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low], dtype=np.int64)
    code = np.frombuffer((" " + " ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _letters()[code], np.concatenate([[0], np.cumsum(sizes)]) + 1


def _cells(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = code.astype(np.uint64)
    at = np.flatnonzero(code != 32)
    last, here, after = code[at - 1], code[at], code[at + 1]
    pair = (last << np.uint64(21)) | here
    cells = np.empty((len(at), 2), dtype=np.int64)
    cells[:, 0] = mix(pair + np.uint64(1)) >> np.uint64(48)
    cells[:, 1] = (mix(((pair << np.uint64(21)) | after) + np.uint64(7)) >> np.uint64(48)) + np.uint64(BUCKETS)
    return cells, np.searchsorted(at, starts)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the texts' letters, (n, 2): bigram's and trigram's; and the texts' bounds among them."""
    return _cells(*_codes(texts))


def shuffled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """grams() of the texts with the letters of all of them dealt anew over their places, by a fixed seed."""
    code, starts = _codes(texts)
    at = np.flatnonzero(code != 32)
    code = code.copy()
    code[at] = code[np.random.default_rng(len(at)).permutation(at)]
    return _cells(code, starts)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log: np.ndarray  # float32, (2 * BUCKETS, languages)
    prior: np.ndarray
    #: Least evidence of a text of these languages; none unless calibrated.
    floor: float | None = None

    def evidence(self, cells: np.ndarray) -> np.ndarray:
        """Of each letter: the largest log probability of its grams."""
        best = np.full(len(cells), -np.inf, dtype=np.float32)
        for k in range(len(self.languages)):
            np.maximum(best, self.log[cells[:, 0], k] + self.log[cells[:, 1], k], out=best)
        return best

    def recognised(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's evidence (nan without letters or model), and whether it is text of the languages: it has letters,
        and not ENOUGH of them with evidence below the floor. Without a model every text with letters counts."""
        cells, bounds = grams(texts)
        n = np.diff(bounds)
        mean = np.full(len(texts), np.nan)
        if self.languages and (n > 0).any():
            mean[n > 0] = np.add.reduceat(self.evidence(cells).astype(np.float64), bounds[:-1][n > 0]) / n[n > 0]
        low = (n >= ENOUGH) & (mean < self.floor) if self.floor is not None else np.zeros(len(texts), dtype=bool)
        return mean, (n > 0) & ~low

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        cells, bounds = grams(texts)
        n = np.diff(bounds)
        if not self.languages or not len(cells):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        full = n > 0
        for k in range(len(self.languages)):
            column = self.log[:, k]
            each = column[cells[:, 0]] + column[cells[:, 1]]
            total[full, k] = np.add.reduceat(each.astype(np.float64), bounds[:-1][full])
        best = np.argmax(total + self.prior, axis=1)
        mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None] + self.prior
        odds = np.exp(mean - mean.max(axis=1, keepdims=True))
        score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        return [self.languages[b] if f else UNKNOWN for b, f in zip(best, full, strict=True)], np.where(full, score, 0.0)


def _known(df: DataFrame) -> DataFrame:
    return df.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))


def _sizes(known: DataFrame, most: int = MOST) -> dict[str, int]:
    """Rows of each language. More than `most` languages are refused, as the matrix grows with them."""
    rows = known.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages are labelled")
    return {r["lang"]: r["n"] for r in rows}


def _drawn(known: DataFrame, per_language: int) -> DataFrame:
    sizes = _sizes(known)
    if not sizes:
        return known
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_language / v))])
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    return known.filter(draw < F.element_at(share, F.col("lang")))


def train(df: DataFrame) -> Model:
    """The model of all labelled rows of (text, lang). Counts are summed by Spark; the driver gets the summed cells,
    2 * BUCKETS a language at most."""
    known = _known(df)
    sizes = _sizes(known)
    if not sizes:
        return Model((), np.zeros((2 * BUCKETS, 0), np.float32), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi in slices(b.column(0), BYTES):
                cells, bounds = grams(b.column(0).slice(lo, hi - lo).to_pylist())
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                of = np.array(b.column(1).slice(lo, hi - lo).to_pylist(), dtype=object)
                for lang in set(of):
                    own = cells[(of == lang)[row]].reshape(-1)
                    if lang not in sums:
                        sums[lang] = np.zeros(2 * BUCKETS, dtype=np.int64)
                    sums[lang] += np.bincount(own, minlength=2 * BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "cell", "n"])

    cells = known.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(sizes))
    counts = np.zeros((2 * BUCKETS, len(languages)))
    at = {k: j for j, k in enumerate(languages)}
    column = np.array([at[x] for x in cells.column("lang").to_pylist()], dtype=np.int64)
    counts[cells.column("cell").to_numpy(), column] = cells.column("n").to_numpy()
    log = np.empty_like(counts)
    for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        c = counts[part] + 0.5
        log[part] = np.log(c / c.sum(axis=0))
    n = np.array([sizes[k] for k in languages], dtype=float)
    return Model(languages, log.astype(np.float32), np.log(n / n.sum()))


def calibrated(df: DataFrame, model: Model, per_language: int | None = None) -> Model:
    """The model with the floor that all labelled rows of (text, lang) give it, or about per_language of each language if
    that is set; the driver gets sums only."""
    if not model.languages:
        return model
    shared = df.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = np.zeros(3)
        for b in batches:
            for lo, hi in slices(b.column(0), BYTES):
                texts = b.column(0).slice(lo, hi - lo).to_pylist()
                real, _ = grams(texts)
                mixed, _ = shuffled(texts)
                sums += (len(real), shared.value.evidence(real).sum(dtype=np.float64), shared.value.evidence(mixed).sum(dtype=np.float64))
        yield pa.RecordBatch.from_pydict({"n": [sums[0]], "real": [sums[1]], "mixed": [sums[2]]})

    known = _known(df)
    picked = known if per_language is None else _drawn(known, per_language)
    r = picked.mapInArrow(add, "n double, real double, mixed double").agg(F.sum("n").alias("n"), F.sum("real").alias("real"), F.sum("mixed").alias("mixed")).first()
    return replace(model, floor=((1 - FLOOR) * r["real"] + FLOOR * r["mixed"]) / r["n"]) if r["n"] else model


def _with(spark: SparkSession, df: DataFrame, text: str, out: list[tuple[str, DataType, pa.DataType]], compute) -> DataFrame:
    """df with the columns that compute(texts) gives, in place of columns of those names."""
    keep = [f for f in df.schema.fields if f.name not in {n for n, _, _ in out}]
    schema = StructType([*keep, *(StructField(n, t) for n, t, _ in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(len(keep)), BYTES):
                part = b.slice(lo, hi - lo)
                made = compute(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(x, t) for x, (_, _, t) in zip(made, out, strict=True))], names=schema.names)

    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text}`").cast("string").alias("text to read")).mapInArrow(run, schema)


def identify(spark: SparkSession, df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    shared = spark.sparkContext.broadcast(model)
    out = [("lang_pred", StringType(), pa.string()), ("score", DoubleType(), pa.float64())]
    return _with(spark, df, text, out, lambda texts: shared.value.predict(texts))


def select_languages(spark: SparkSession, df: DataFrame, model: Model, text: str = "text", wanted: frozenset[str] | None = None) -> DataFrame:
    """The rows of df whose text is of a learned language (Model.recognised) and, if `wanted` names languages, predicted
    to be of one of those."""
    shared, names = spark.sparkContext.broadcast(model), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi in slices(b.column(0), BYTES):
                part = b.slice(lo, hi - lo)
                texts = part.column(0).to_pylist()
                keep = m.recognised(texts)[1]
                if wanted is not None:
                    keep &= np.array([x in wanted for x in m.predict(texts)[0]], dtype=bool)
                yield pa.RecordBatch.from_arrays(part.columns[1:], names=names).filter(pa.array(keep))

    return df.select(F.col(f"`{text}`").cast("string").alias("text to read"), *(F.col(f"`{c}`") for c in df.columns)).mapInArrow(run, df.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(df.filter(~F.col("held_out")).select("text", "lang"))
    return identify(spark, df.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
