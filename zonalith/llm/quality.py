"""Quality rules: simple counts, and the divergence of a text's histograms from its language's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalith.llm.common import nullable, small_batches, text_batches, written

#: Frequent function words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec on son aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
WORDS = sorted({w for own in COMMON.values() for w in own})
#: Character classes: lower, upper, other letters, digits, white space, sentence marks, symbols, the rest.
N_CLASSES = 8
_SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 7, np.uint8)
for _cls, _own in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0xC0, 0x100)), b"0123456789", b" \t\n\x0b\x0c\r", b".,;:!?'\"()-", _SYMBOLS)):
    _CLASS[list(_own)] = _cls
_CLASS[0x80:0xC0] = N_CLASSES  # later bytes of a character do not count

#: Stands for a null language within a task; a language of this name has the reference of all texts, as a null one has.
NO_LANGUAGE = "\0"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.  A histogram is judged only from its minimum length on; shorter texts have only the base rules."""

    least_chars: int = 200
    least_words: int = 50
    most_char_js: float = 0.06**0.5
    #: For words the square of the limit is that of this, and so much over the number of words: short texts stray by chance.
    most_word_js: float = 0.095**0.5
    word_slack: float = 1.5


def char_classes(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


_FORMS = [(w.encode(), w.capitalize().encode()) for w in WORDS]
_FORM_AT = {form: i for i, forms in enumerate(_FORMS) for form in forms}


def common_counts(words: list[bytes]) -> np.ndarray:
    get = _FORM_AT.get
    found = Counter(map(get, words))
    out = np.zeros(len(WORDS) + 1, np.int64)
    for at, n in found.items():
        out[-1 if at is None else at] = n
    return out


def js(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, the root of the divergence in bits: 0 for alike, 1 for disjoint."""
    p, q = counts / max(1, counts.sum()), reference / max(1, reference.sum())
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, kl / 2)))


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that stand in a window of `size` words which the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    at: dict[bytes, int] = {}
    ids = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, size):
        if len(at) ** (k + 1) >= 1 << 62:  # pairs renumbered, for exactness
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(at) + ids[k : n + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    met: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in met:
            n += 1
        elif line.split():
            met.add(line)
    return n


def measure(text: bytes) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The counts of the base rules, and the two histograms."""
    words = text.split()
    chars = char_classes(text)
    symbols = int(chars[6])
    base = {
        "n_words": len(words), "word_chars": int(chars.sum() - chars[4]), "n_symbols": symbols,
        "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeat_words(words),
    }
    return base, chars, common_counts(words)


class _Histograms:
    """One row for each language of a task: the sums of both histograms."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in text_batches(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    own = np.concatenate([char_classes(text), common_counts(text.split())])
                    key = NO_LANGUAGE if lang is None else lang
                    sums[key] = sums[key] + own if key in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])


#: Languages up to which the references go to every task; more are joined to the documents by language.
KNOWN_LANGUAGES = 10_000
_REFERENCE = "_z_reference"


def references(docs: DataFrame) -> DataFrame:
    """lang, sums: both histograms of each language, one after the other, over all its texts; over all languages where lang is null."""
    n = N_CLASSES + len(WORDS) + 1
    per_task = docs.select(F.col("lang").cast("string"), "text").mapInArrow(_Histograms(), "lang string, sums array<long>")
    sums = written(per_task.groupBy("lang").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)]), "references")
    total = sums.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(n)]).withColumn("lang", F.lit(None).cast("string"))
    both = sums.filter(F.col("lang") != NO_LANGUAGE).unionByName(total)
    return both.select("lang", F.array(*[F.col(f"s{i}") for i in range(n)]).alias("sums"))


def _with_references(docs: DataFrame, known: int) -> tuple[DataFrame, dict[str | None, np.ndarray]]:
    """The documents, with their language's reference as last column if there are many languages; else the references."""
    found = references(docs)
    if found.count() <= known:
        return docs, {r["lang"]: np.array(r["sums"], np.float64) for r in found.collect()}
    side = found.select(F.col("lang").alias("_z_lang"), F.col("sums").alias(_REFERENCE))
    return docs.join(side, F.col("lang").cast("string").eqNullSafe(F.col("_z_lang")), "left").drop("_z_lang"), {}


def verdict(base: dict[str, int], chars: np.ndarray, common: np.ndarray, reference: np.ndarray, rules: Rules) -> tuple[bool, bool, float | None, float | None]:
    """(base_failed, kept, distance of characters, distance of words); a distance is None below its minimum length."""
    failed = base["n_words"] < 50 or 100 * base["n_repeat_words"] > 50 * base["n_words"]
    char_js = js(chars, reference[:N_CLASSES]) if chars.sum() >= rules.least_chars else None
    word_js = js(common, reference[N_CLASSES:]) if base["n_words"] >= rules.least_words else None
    far = (char_js is not None and char_js > rules.most_char_js) or (word_js is not None and word_js**2 > rules.most_word_js**2 + rules.word_slack / base["n_words"])
    return failed, not failed and not far, char_js, word_js


class _Judge:
    def __init__(self, known: dict[str | None, np.ndarray], rules: Rules, names: list[str], filtering: bool):
        self.known, self.rules, self.names, self.filtering = known, rules, names, filtering

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(N_CLASSES + len(WORDS) + 1)
        for b in text_batches(batches):
            langs, texts = b.column(self.names.index("lang")).cast(pa.string()).to_pylist(), b.column(self.names.index("text")).cast(pa.binary()).to_pylist()
            if self.known:
                own = [self.known.get(lang, self.known.get(None, empty)) for lang in langs]
            else:
                own = [empty if x is None else np.array(x, np.float64) for x in b.column(b.num_columns - 1).to_pylist()] if b.num_columns > len(self.names) else [empty] * b.num_rows
            found = []
            for text, reference in zip(texts, own, strict=True):
                base, chars, common = measure(text or b"")
                found.append((*base.values(), *verdict(base, chars, common, reference, self.rules)))
            if self.filtering:
                yield b.select(self.names).filter(pa.array([r[6] for r in found], pa.bool_()))
            else:
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
                columns = list(zip(*found, strict=True)) if found else [[]] * 9
                yield pa.RecordBatch.from_arrays([b.column(self.names.index("doc_id")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *VERDICT])


VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_js", "word_js"]
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_js double, word_js double"


def judge(docs: DataFrame, rules: Rules | None = None, known: int = KNOWN_LANGUAGES) -> DataFrame:
    """A verdict for each row of docs(doc_id, text, lang), with the counts and Jensen-Shannon distances behind it.

    Two passes over the texts and no shuffle of them: sums of histograms for each language, then the verdicts.  More than
    `known` languages are joined to the documents instead of sent to all tasks, with the same result.  A null text is the
    empty one and fails the base rules; a null language is compared with all texts; repeated rows are judged alike; texts
    of any length are read whole; an empty table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    own, found = _with_references(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), known)
    return own.mapInArrow(_Judge(found, rules or Rules(), ["doc_id", "text", "lang"], False), _SCHEMA)


def keep_good(docs: DataFrame, rules: Rules | None = None, known: int = KNOWN_LANGUAGES) -> DataFrame:
    """The rows of docs(doc_id, text, lang, ...) that judge() keeps, with all their columns, whatever their names."""
    small_batches(docs.sparkSession)
    own, found = _with_references(docs, known)
    return own.mapInArrow(_Judge(found, rules or Rules(), docs.columns, True), T.StructType(list(nullable(docs.schema))))
