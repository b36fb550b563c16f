"""Licence scan by ordered signature rules.

A text becomes its lower-cased words of ASCII letters, digits and other than ASCII characters, joined by single spaces.
A rule is tried only where the text has one of its gate words; what the rules find are detections, runs of words with a
priority. A detection that lies within another of the same licence family is suppressed, whatever their priorities, so
"gpl 2 0 or later" is not version 2 alone. Of the others, taken by falling priority, then length, then place, one that lies
within one taken before is suppressed, so "gpl 3 0" inside a full notice says nothing of its own. Detections that only
overlap stay both. Signs are no words: the plus of "GPLv2+" is not seen.

Three base phrases are counted wherever their words stand. Their labels always stay.

Edge cases: NULL and empty texts have no words; overlapping places of a phrase all count; equal detections are reported
once, by the rule written first; rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType

from clickmart.llm.common import flat_schema, map_rows, texts_of, utf8
from clickmart.llm.license_rules import BASE_PHRASES, Rule, family, rules

#: Every ASCII byte but letters and digits becomes a space; A-Z are lower-cased before.
SPACED = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256))
BASE_STRENGTH = 0.5


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(SPACED).split()


class Scanner:
    """Rules by gate word."""

    def __init__(self, all_rules: list[Rule]):
        self.rules = all_rules
        self.gated: dict[bytes, list[int]] = {}
        for i, rule in enumerate(all_rules):
            for gate in rule.gates:
                self.gated.setdefault(gate.encode(), []).append(i)
        self.gates = frozenset(self.gated)

    def detections(self, words: list[bytes]) -> list[tuple[int, int, Rule]]:
        """(first word, word after the last, rule) of what stays, by place."""
        present = self.gates.intersection(words)
        if not present:
            return []
        joined = " " + b" ".join(words).decode() + " "
        found = []
        for i in sorted({i for gate in present for i in self.gated[gate]}):
            for match in self.rules[i].pattern.finditer(joined):
                found.append((match.start(), match.end(), i))
        found = self._widest_of_family(found)
        found.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[0], d[2]))
        kept: list[tuple[int, int, int]] = []  # by place
        widest = max((end - start for start, end, _ in found), default=0)
        for start, end, i in found:
            at = bisect_left(kept, (start - widest, 0, 0))
            before = takewhile(lambda d, start=start: d[0] <= start, islice(kept, at, None))
            if not any(end <= e for _, e, _ in before):
                insort(kept, (start, end, i))
        place = lambda at: joined.count(" ", 1, at)  # noqa: E731  spaces before a word, without the first
        return [(place(s), place(s) + joined.count(" ", s, e) + 1, self.rules[i]) for s, e, i in kept]

    def _widest_of_family(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Without what lies within another detection of its family; of equal places the first rule's stays."""
        kept, reached = [], {}
        for start, end, i in sorted(found, key=lambda d: (d[0], -d[1], d[2])):
            of = family(self.rules[i].label)
            if end > reached.get(of, -1):
                kept.append((start, end, i))
                reached[of] = end
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand one after another, overlapping places included."""
    found, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return found
        if words[at : at + len(phrase)] == phrase:
            found.append(at)


DETECTION = flat_schema("label string, form string, first_word long, n_words long")
SCAN = flat_schema(
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
).add("detections", ArrayType(DETECTION))


def scan(docs: DataFrame) -> DataFrame:
    """The base places and labels, all labels, the strength of the best detection, and the detections, for each document."""
    phrases = [(phrase.encode().split(), label) for phrase, label in BASE_PHRASES.items()]

    def run(ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        for doc_id, text in zip(ids.to_pylist(), utf8(texts), strict=True):
            words = words_of(text)
            places = [(at, label) for phrase, label in phrases for at in phrase_places(words, phrase)]
            found = scanner().detections(words)
            base = {label for _, label in places}
            labels = base | {rule.label for _, _, rule in found}
            score = max([rule.strength for _, _, rule in found] + [BASE_STRENGTH] * bool(places), default=0.0)
            starts = [at for at, _ in places]
            yield (
                doc_id,
                len(words),
                len(places),
                min(starts, default=None),
                max(starts, default=None),
                ",".join(sorted(base)),
                ",".join(sorted(labels)),
                score,
                [(rule.label, rule.form, start, end - start) for start, end, rule in found],
            )

    return map_rows(texts_of(docs), run, SCAN)
