"""Repeated passages: against paragraphs compared by brute force, and planted ones."""

import numpy as np
import pytest

from clickmart.llm import substring_dedup as sub
from tests.llm import brute
from tests.llm.conftest import ODD, rows_of


def sets_of(docs):
    """Each paragraph's place and set of five-word shingles, from the operator's own borders."""
    out = []
    for doc_id, text in docs:
        if doc_id is None or not text:
            continue
        p = sub.Paragraphs([text.encode()])
        words = [w.encode() for w in brute.WORD.findall(brute.ascii_lower(text))]
        for s, e in zip((p.start - p.first_word).tolist(), (p.end - p.first_word).tolist(), strict=True):
            out.append((doc_id, s, e - s, frozenset(tuple(words[k : k + 5]) for k in range(s, e - 4))))
    return out


def brute_passages(held, min_words=sub.MIN_WORDS):
    """Classes by comparing all paragraphs that share a shingle, then sequences that two documents hold.

    For each document its repeated places with the smallest doc_id that has them, and the links.
    """
    texts = {s: i for i, s in enumerate(sorted({h[3] for h in held}, key=sorted))}
    having = {}
    for s, i in texts.items():
        for shingle in s:
            having.setdefault(shingle, []).append(i)
    sets = list(texts)
    pairs = {(a, b) for some in having.values() for k, a in enumerate(some) for b in some[:k]}
    edges = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = brute.smallest_reachable(range(len(texts)), edges)
    docs_of = {}
    for doc_id, _, _, s in held:
        docs_of.setdefault(root[texts[s]], set()).add(doc_id)
    held_by, sequences = {}, {}
    for doc_id in {h[0] for h in held}:
        mine = sorted({(a, n, root[texts[s]]) for d, a, n, s in held if d == doc_id and len(docs_of[root[texts[s]]]) > 1})
        for k in range(len(mine)):
            words, end, members = 0, mine[k][0], []
            for a, n, c in mine[k:]:
                if words >= min_words or a > end + sub.GAP:
                    break
                words, end = words + n, max(end, a + n)
                members.append((a, n, c))
            if words >= min_words:
                key = tuple(c for _, _, c in members)
                held_by.setdefault(key, set()).add(doc_id)
                sequences.setdefault(doc_id, []).append((key, members))
    places, links = {}, []
    for doc_id, found in sequences.items():
        for key, members in found:
            if len(held_by[key]) > 1:
                links.append((doc_id, min(held_by[key])))
                for a, n, _ in members:
                    least = places.setdefault(doc_id, {})
                    least[a, n] = min(held_by[key] | {least.get((a, n), doc_id)})
    return places, links


def brute_report(docs, min_words=sub.MIN_WORDS):
    """As ``sub.report``: the places of paragraphs cut in lines."""
    places, links = brute_passages(sets_of(docs), min_words)
    out = {}
    for doc_id, least in places.items():
        gone = [n for (_, n), first in least.items() if first < doc_id]
        out[doc_id] = (len(least), len(gone), sum(gone))
    classes = brute.smallest_reachable({d for d, _ in docs if d is not None}, links)
    return sorted(((d, classes.get(d), *out.get(d, (0, 0, 0))) for d, _ in docs), key=repr)


def random_words(seed, n):
    random = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in random.integers(0, 26, 6)) for _ in range(n)]


def planted():
    """Documents of their own words; some hold the same passage, others a short line that everybody has."""
    passage = random_words(1, 60)
    passage[30] += "\n" + passage[31]
    docs = []
    for i in range(40):
        own = random_words(100 + i, 150)
        if i % 4 == 0:
            cut = 10 + 3 * i
            own = own[:cut] + passage + own[cut:]
        docs.append((i, " ".join(own) + "\nevery document has this one short line of words\n" + " ".join(random_words(900 + i, 40))))
    return docs


def test_planted_passages_are_found_and_others_left_alone(as_documents):
    docs = planted()
    found = {r["doc_id"]: r for r in sub.report(as_documents(docs)).collect()}
    assert {i for i, r in found.items() if r["n_repeated"]} == {i for i in range(40) if i % 4 == 0}
    assert {r["class_id"] for i, r in found.items() if i % 4 == 0} == {0}
    assert all(r["class_id"] == i for i, r in found.items() if i % 4)
    assert all(r["words_removed"] >= 30 for i, r in found.items() if i and i % 4 == 0)


def variants():
    """Copies of a long line that differ in few words: near ones, and a chain of ever more different ones."""
    line = random_words(5, 60)
    docs = [(i, " ".join([*line[:-1], f"end{i}"])) for i in range(30)]
    for i in range(30, 45):
        line = [*line[:-2], f"x{i}", f"y{i}"] if i % 3 else [f"z{i}", *line[1:]]
        docs.append((i, " ".join(line)))
    return docs


@pytest.mark.parametrize("source", ["odd", "planted", "variants", "given"])
def test_report(as_documents, given, source, monkeypatch):
    rows = {"odd": [r for r in ODD if r[0] not in (9, 10)], "planted": planted(), "variants": variants(), "given": given}[source]
    # With many bands no similar pair is missed, so that brute force must agree.
    found = sub.report(as_documents(rows), recall=1 - 1e-9)
    assert rows_of(found, "doc_id", "class_id", "n_repeated", "n_removed", "words_removed") == brute_report(rows)


def test_dropping(as_documents):
    docs = as_documents(planted())
    kept = sub.drop_repeats(docs)
    assert kept.columns == docs.columns
    before, after = dict(planted()), {r["doc_id"]: r["text"] for r in kept.collect()}
    removed = {r["doc_id"]: r["words_removed"] for r in sub.report(docs).collect()}
    for i, text in before.items():
        assert len(text.split()) - len(after[i].split()) == removed[i]
        assert removed[i] or after[i] == text
    assert sub.report(kept).where("n_removed > 0").count() == 0


def test_dropping_of_odd_texts(as_documents):
    assert sub.drop_repeats(as_documents(ODD)).count() == len(ODD)
    assert sub.report(as_documents(ODD).where("false")).count() == 0


def test_words_are_cut_out_of_lines():
    spans = [{"start": 1, "n_words": 1}, {"start": 3, "n_words": 2}]
    assert sub.without(b"a b c\n\nd  e\nf g", spans) == b"a c\n\nf g"


def test_bands_reach_the_recall():
    for recall in (0.9, 0.98, 0.999):
        bands, rows = sub.tuned(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall
    assert sub.tuned(false_cost=0)[1] == 1


def test_paragraphs_do_not_depend_on_what_else_is_read():
    texts = [t.encode() for _, t in planted()]
    together = sub.Paragraphs(texts)
    for i in (0, 7, 39):
        alone = sub.Paragraphs([texts[i]])
        mine = together.of == i
        assert (together.start[mine] - together.first_word[mine]).tolist() == (alone.start - alone.first_word).tolist()
        assert together.texts()[mine].tolist() == alone.texts().tolist()
        assert all((a[mine] == b).all() for a, b in zip(together.bands(3, 2), alone.bands(3, 2), strict=True))
