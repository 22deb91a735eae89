"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Each rule is a vectorised test over documents.  On a bounded hash sample every rule is
timed and its rejections counted; the cascade then runs the rules in falling order of
rejections per second, each over the documents that all rules before it kept.  The order
changes how much work is done, never which documents are kept: a document is kept if no
rule rejects it.

Defined results: a null text has no words; a text without words fails the base rule;
lines without a word never count as repeated; extra columns are ignored; repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, read_table, text_groups, trimmed

WORDS = re.compile("[^\x20\x09-\x0d]+").findall
#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_IS_SYMBOL = str.maketrans("", "", SYMBOLS)
_SPACES = str.maketrans("", "", "\x20\x09\x0a\x0b\x0c\x0d")


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    gram, have = code, 1
    while have < width:  # exact ranks of ever longer runs, no hashing
        step = min(have, width - have)
        joined = gram[: len(gram) - step] * (int(gram.max()) + 1) + gram[step:]
        _, gram = np.unique(joined, return_inverse=True)
        have += step
        if len(gram) and int(gram.max()) + 1 == len(gram):
            return 0
    twice = np.bincount(gram)[gram] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.translate(_SPACES):
            n += line in seen
            seen.add(line)
    return n


@dataclass
class Document:
    """What rules look at; base figures are computed once."""

    text: str
    words: list[str]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @classmethod
    def of(cls, text: str | None) -> Document:
        text = text or ""
        words = WORDS(text)
        return cls(text, words, sum(map(len, words)), len(text) - len(text.translate(_IS_SYMBOL)), repeated_lines(text), repeated_words(words))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents to drop; a rule sees documents with ten words at least."""

    name: str
    rejects: Callable[[Document], bool]


def base_failed(d: Document) -> bool:
    return len(d.words) < 10 or 100 * d.n_repeat_words > 20 * len(d.words)


def _upper_share(d: Document) -> bool:
    upper = sum(map(str.isupper, d.words))
    return 100 * upper > 50 * len(d.words)


def _bullet_share(d: Document) -> bool:
    lines = [x for x in d.text.split("\n") if x.translate(_SPACES)]
    return 100 * sum(x.lstrip()[:1] in ("-", "*", "•") for x in lines) > 90 * len(lines)


def _alphabetic_share(d: Document) -> bool:
    """Under half the words have a letter."""
    return 2 * sum(any(map(str.isalpha, w)) for w in d.words) < len(d.words)


#: The rules beyond the base; thresholds after published heuristics for web text.
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > len(d.words)),
    Rule("word_length", lambda d: not 2 * len(d.words) <= d.word_chars <= 14 * len(d.words)),
    Rule("dup_lines", lambda d: d.n_dup_lines >= 3 and 10 * d.n_dup_lines > 3 * (d.text.count("\n") + 1)),
    Rule("upper_words", _upper_share),
    Rule("bullets", _bullet_share),
    Rule("alphabetic_words", _alphabetic_share),
)


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: int
    seen: int

    @property
    def rate(self) -> float:
        """Rejections a second."""
        return self.rejected / max(self.seconds, 1e-9)


def measure(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """Cost and selectivity of each rule on the texts that pass the base rule."""
    docs = [d for d in map(Document.of, texts) if not base_failed(d)]
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, docs))
        found.append(Measured(rule.name, time.perf_counter() - began, rejected, len(docs)))
    return found


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", bound: int = 500) -> list[Rule]:
    """The rules by falling rejections per second, measured on executors over at most ``bound`` whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(0).to_pylist(), rules)
            yield pa.RecordBatch.from_pylist([{"name": m.name, "seconds": m.seconds, "rejected": m.rejected, "seen": m.seen} for m in found])

    some = df.where(F.pmod(F.xxhash64(id_col), F.lit(64)) == 0).select(F.col(text_col).cast("string").alias("t")).limit(bound)
    figures = some.mapInArrow(trimmed(run), "name string, seconds double, rejected long, seen long")
    sums = figures.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "seen"))).collect()
    by = {r["name"]: Measured(r["name"], r["seconds"], r["rejected"], r["seen"]) for r in sums}
    return sorted(rules, key=lambda r: (-by[r.name].rate, by[r.name].seconds) if r.name in by else (0.0, 0.0))


def apply_rules(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    sample_bound: int = 500,
    keep_columns: bool = False,
) -> DataFrame:
    """Base figures, ``base_failed``, ``rejected_by`` and ``kept`` of each row.

    ``sample_bound`` is how many documents the order of the rules is estimated on.  With
    ``keep_columns`` all columns of df are returned for the rows that are kept, and no more.
    """
    cascade = order_rules(df, rules, id_col=id_col, text_col=text_col, bound=sample_bound)
    names = [r.name for r in cascade]

    def judge(texts: list[str | None]) -> tuple[list[Document], list[bool], list[str | None]]:
        docs = [Document.of(t) for t in texts]
        failed = [base_failed(d) for d in docs]
        by: list[str | None] = ["base" if f else None for f in failed]
        alive = [i for i, f in enumerate(failed) if not f]
        for name, rule in zip(names, cascade, strict=True):
            out = {i for i in alive if rule.rejects(docs[i])}
            for i in out:
                by[i] = name
            alive = [i for i in alive if i not in out]
        return docs, failed, by

    if keep_columns:
        at = df.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                for a, b in text_groups(texts, 4_000_000):
                    by = judge(texts[a:b])[2]
                    yield batch.slice(a, b - a).filter(pa.array([x is None for x in by]))

        return df.mapInArrow(trimmed(keep), df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts, 4_000_000):
                docs, failed, by = judge(texts[a:b])
                figures = [[len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words] for d in docs]
                columns = [pa.array(c, pa.int64()) for c in zip(*figures, strict=True)]
                columns += [pa.array(failed), pa.array(by, pa.string()), pa.array([x is None for x in by])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], out_names)

    out_names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"]
    kinds = ["long"] * 6 + ["boolean", "string", "boolean"]
    rows = df.select(long_id(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(trimmed(run), ", ".join(f"{n} {k}" for n, k in zip(out_names, kinds, strict=True)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents")).drop("rejected_by")
