"""Quality rules as a short-circuit cascade.

A rule rejects a document by a few measures of its text. The rules are tried in turn and the first that rejects ends the
work on that document, so their order decides the cost and nothing else. It is chosen from a sample: each measure's time
and each rule's rejections are recorded there, then the rule with the most rejections per second goes first, the
rejections counted among the documents that earlier rules leave and the time without measures already taken.

Edge cases: a NULL text has no words and is rejected by ``few_words``; an empty table gives an empty result, and rules
keep the given order; equal rejections per cost keep the given order; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from clickmart.llm.common import flat_schema, map_rows, text_at, texts_of, utf8

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8



class Measures:
    """Measures of one UTF-8 text, each taken when first asked for. Words are parted by the six ASCII white spaces."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, b" \t\n\v\f\r" + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def codes(self) -> np.ndarray:
        """Equal numbers for equal words."""
        return pd.factorize(np.array(self.words, dtype=object))[0]

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of eight that occur twice or more; pairs, fours and eights are numbered in turn."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        codes, step = self.codes.astype(np.int64), 1
        while step < WINDOW:
            pairs = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
            codes, uniques = pd.factorize(pairs)
            if len(uniques) == len(codes):
                return 0
            step *= 2
        repeated = np.bincount(codes)[codes] > 1
        covered = np.zeros(self.n_words + 1, dtype=np.int64)
        np.add.at(covered, np.flatnonzero(repeated), 1)
        np.add.at(covered, np.flatnonzero(repeated) + WINDOW, -1)
        return int(np.count_nonzero(np.cumsum(covered)))

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return int(np.count_nonzero(self.codes[1:] == self.codes[:-1]))

    @cached_property
    def n_upper(self) -> int:
        return len(self.text) - len(self.text.translate(None, UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.text) - len(self.text.translate(None, LOWER))

    @cached_property
    def n_digits(self) -> int:
        return len(self.text) - len(self.text.translate(None, DIGITS))

    @cached_property
    def n_open_lines(self) -> int:
        """Lines that trail off."""
        return sum(line.rstrip().endswith((b"...", "…".encode())) for line in self.lines)

    @cached_property
    def longest_word(self) -> int:
        return max(map(len, self.words), default=0)

    @cached_property
    def placeholder(self) -> bool:
        return bool(re.search(rb"lorem ipsum|\bjavascript (?:is|must be) (?:disabled|enabled)", self.text.lower()))


@dataclass(frozen=True)
class Rule:
    """``rejects`` looks at the measures named in ``needs`` and says whether the document goes."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measures], bool]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m.n_words < 20),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", ("lines", "n_dup_lines"), lambda m: 100 * m.n_dup_lines > 40 * len(m.lines)),
    Rule("stutter", ("n_words", "n_stutters"), lambda m: 100 * m.n_stutters > 30 * m.n_words),
    Rule("word_length", ("n_words", "word_chars"), lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("shouting", ("n_upper", "n_lower"), lambda m: m.n_upper > m.n_lower),
    Rule("digits", ("word_chars", "n_digits"), lambda m: 2 * m.n_digits > m.word_chars),
    Rule("trailing_off", ("lines", "n_open_lines"), lambda m: 100 * m.n_open_lines > 50 * len(m.lines)),
    Rule("endless_word", ("longest_word",), lambda m: m.longest_word > 5000),
    Rule("placeholder", ("placeholder",), lambda m: m.placeholder),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> list[Rule]:
    """``rules``, most rejections per cost first, as measured on about ``sample_rows`` documents."""
    sample = texts_of(docs).sample(min(1.0, sample_rows / max(1, docs.count())), seed=0)
    needs = list(dict.fromkeys(n for rule in rules for n in rule.needs))

    def measured(_: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        for text in utf8(texts):
            measures, took = Measures(text), []
            for need in needs:
                start = time.perf_counter()
                getattr(measures, need)
                took.append(time.perf_counter() - start)
            yield sum(rule.rejects(measures) << i for i, rule in enumerate(rules)), took

    schema = StructType().add("rejected_by", "long").add("took", ArrayType(DoubleType()))
    found = map_rows(sample, measured, schema)
    sums = [F.sum(F.col("took")[i]).alias(need) for i, need in enumerate(needs)]
    # At most a row for each document of the sample.
    patterns = found.groupBy("rejected_by").agg(F.count("*").alias("rows"), *sums).collect()
    rows = {p["rejected_by"]: p["rows"] for p in patterns}
    cost = {need: sum(p[need] for p in patterns) for need in needs}

    ordered: list[Rule] = []
    left, known = list(enumerate(rules)), set()
    while left:
        rejected = [sum(n for bits, n in rows.items() if bits >> i & 1) for i, _ in left]
        dear = [sum(cost[need] for need in set(rule.needs) - known) for _, rule in left]
        worth = [n / (1e-9 + seconds) for n, seconds in zip(rejected, dear, strict=True)]
        i, rule = left.pop(max(range(len(left)), key=lambda k: (worth[k], -k)))
        ordered.append(rule)
        known |= set(rule.needs)
        rows = {bits: n for bits, n in rows.items() if not bits >> i & 1}
    return ordered


def first_rejection(rules: list[Rule], measures: Measures) -> tuple[str | None, int]:
    """The rule that ends the cascade, and how many were tried."""
    for tried, rule in enumerate(rules, 1):
        if rule.rejects(measures):
            return rule.name, tried
    return None, len(rules)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    ordered, at = order_rules(docs, rules), text_at(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [first_rejection(ordered, Measures(text))[0] is None for text in utf8(batch.column(at))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, kept, the rule that rejected the document and the number of rules tried on it."""
    ordered = order_rules(docs, rules)

    def judged(ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        for doc_id, text in zip(ids.to_pylist(), utf8(texts), strict=True):
            m = Measures(text)
            by, tried = first_rejection(ordered, m)
            base = any(rule.rejects(m) for rule in BASE_RULES)
            yield doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, base, by is None, by, tried

    schema = flat_schema(
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, rejected_by string, rules_tried integer"
    )
    return map_rows(texts_of(docs), judged, schema)
